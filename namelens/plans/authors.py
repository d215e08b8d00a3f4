"""An author corpus derived from the orders table, with the same derivation as SQL.

The test tables hold no person names, so each order becomes an author record by
arithmetic on its keys. The columns are those of a name record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namelens.functions.scratch import spread

SURNAMES = ["Wang", "Li", "Zhang", "Liu", "Chen", "Yang", "Ouyang", "Hsu", "Wong", "Lee", "Smith", "Ivanov", "García", "Müller", "Tanaka", "Kim", "Savolainen", "Xu", "Ming", "Bo"]
GIVENS = ["Wei", "Tianxiang", "Xiaohua", "Yuhui", "John", "David", "Anna", "José", "Li-Ming", "Petr", "Ming", "Fangan", "Michael", "Ivan", "Jian", "Xiang"]
SOURCES = ["CROSSREF", "ORCID", "ISTINA", "DEFAULT"]
AFFILIATIONS = [
    "Tsinghua University, Beijing, China", "University of Helsinki, Finland", "Tsinghua University, Moscow", "Duke University",
    "MIT, Cambridge, USA", None, "", "Fudan University, Shanghai", "Indian Institute of Technology, Delhi, India",
]


def _pick(words: list, at) -> F.Column:
    return F.get(F.array(*[F.lit(w).cast("string") for w in words]), (at % len(words)).cast("int"))


def authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, source, person_id, publication_id, name_raw, affiliation_raw, lastname, firstname."""
    o = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    x = o.select(
        k.cast("string").alias("record_id"),
        _pick(SOURCES, k).alias("source"),
        F.when(c % 11 == 0, F.lit("")).otherwise(c.cast("string")).alias("person_id"),
        F.expr("cast(o_orderkey div 5 as string)").alias("publication_id"),
        ((k * 31) % 7).alias("layout"),
        _pick(SURNAMES, c * 7 + k).alias("lastname"),
        _pick(GIVENS, c * 13 + F.expr("o_orderkey div 3")).alias("firstname"),
        _pick(AFFILIATIONS, c).alias("affiliation_raw"),
    )
    s, g, at = F.col("lastname"), F.col("firstname"), F.col("layout")
    dot = F.concat(F.substring(g, 1, 1), F.lit("."))
    name = (
        F.when(at == 0, F.concat(s, F.lit(" "), g))
        .when(at == 1, F.concat(g, F.lit(" "), s))
        .when(at == 2, F.concat(s, F.lit(" "), dot))
        .when(at == 3, F.concat(dot, F.lit(" "), s))
        .when(at == 4, F.concat(s, F.lit(", "), g))
        .when(at == 5, F.concat(s, F.lit(" "), dot, F.lit(" "), F.lit("B.")))
        .otherwise(s)
    )
    return x.withColumn("name_raw", name).drop("layout")


#: Names of several scripts and forms.
NAMES = [
    "王小明", "欧阳娜娜", "司马 相如", "Wang Xiaoming", "Ван Сяомин", "Иванов Иван Петрович", "Li-Ming Chen", "Chen Li-Ming", "Müller, Hans", "(Zhang) Wei",
    "Zhang Wei (张伟)", "J. Smith", "Smith J.", "Liu Y.", "Y. Liu", "张", "", " ", None, "爱新觉罗溥仪", "Ouyang Xiu", "Petr Ivanovich Sidorov", "WANG, Xiao+Ming",
    "Li Wang", "Wang Wei Li", "陈", "*Zhao Jian", "Xu-Dong Li", "Anna Maria Kim", "Сидорова Анна", "ВАН ВЭЙ", "李（Li）明", "Ma Jr", "Kh. Ivanov", "José García", "Choi Min", "Tan", "Han Solo",
]


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name_id, name, other: of each customer, two of the names above."""
    c = spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"))
    k = F.col("c_custkey")
    return c.select(k.alias("name_id"), _pick(NAMES, k).alias("name"), _pick(NAMES, k * 7 + F.expr("c_custkey div 38")).alias("other"))


def _list(words: list) -> str:
    return "[" + ", ".join("NULL" if w is None else "'" + w.replace("'", "''") + "'" for w in words) + "]"


#: The same table in DuckDB.
AUTHORS_SQL = f"""
a0 AS (
  SELECT o_orderkey::VARCHAR AS record_id, {_list(SOURCES)}[1 + o_orderkey % {len(SOURCES)}] AS source,
         CASE WHEN o_custkey % 11 = 0 THEN '' ELSE o_custkey::VARCHAR END AS person_id, (o_orderkey // 5)::VARCHAR AS publication_id,
         (o_orderkey * 31) % 7 AS layout, {_list(SURNAMES)}[1 + (o_custkey * 7 + o_orderkey) % {len(SURNAMES)}] AS lastname,
         {_list(GIVENS)}[1 + (o_custkey * 13 + o_orderkey // 3) % {len(GIVENS)}] AS firstname,
         {_list(AFFILIATIONS)}[1 + o_custkey % {len(AFFILIATIONS)}] AS affiliation_raw
  FROM orders),
authors AS (
  SELECT *, CASE layout WHEN 0 THEN lastname || ' ' || firstname WHEN 1 THEN firstname || ' ' || lastname
      WHEN 2 THEN lastname || ' ' || left(firstname, 1) || '.' WHEN 3 THEN left(firstname, 1) || '. ' || lastname
      WHEN 4 THEN lastname || ', ' || firstname WHEN 5 THEN lastname || ' ' || left(firstname, 1) || '. B.' ELSE lastname END AS name_raw
  FROM a0)"""

NAMES_SQL = f"""
names AS (
  SELECT c_custkey AS name_id, {_list(NAMES)}[1 + c_custkey % {len(NAMES)}] AS name, {_list(NAMES)}[1 + (c_custkey * 7 + c_custkey // 38) % {len(NAMES)}] AS other
  FROM customer)"""
