"""The registered queries; their SQL twins are in sql.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namelens.functions import dims, pinyin
from namelens.functions import text as t
from namelens.operators import author_filter, author_lists, institutions, processor, quality, surname_older, surname_v8
from namelens.plans import sql, sql_names
from namelens.plans.authors import authors, names

FLAGSHIP = "v8_summary"


def _shown(df: DataFrame) -> DataFrame:
    return df.select("record_id", F.col("order").alias("name_order"), F.round("confidence", 6).alias("confidence"), "mode", F.array_join("reason_codes", ", ").alias("reasons"))


def v8_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(surname_v8.decide(authors(spark, sf_dir)))


def v8_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(surname_v8.identify(authors(spark, sf_dir)))


def v8_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = surname_v8.identify(authors(spark, sf_dir))
    return d.groupBy("source", F.col("order").alias("name_order"), "mode").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def v8_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.surname_accuracy(surname_v8.identify(authors(spark, sf_dir)))


def v7(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = surname_older.identify_v7(authors(spark, sf_dir))
    return d.select("record_id", F.col("order").alias("name_order"), F.round("confidence", 6).alias("confidence"), "mode")


def v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = surname_older.identify_v3(authors(spark, sf_dir))
    return d.select("record_id", F.col("order").alias("name_order"), F.round("confidence", 6).alias("confidence"))


def affiliations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t.with_affiliation(authors(spark, sf_dir), "a", "affiliation_raw")
    return d.select("record_id", "a.is_chinese", "a.country", F.round("a.confidence", 6).alias("confidence"))


def pinyin_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    w = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("token")).distinct()
    w = pinyin.with_syllables(w, s="token")
    return w.select("token", (F.size("s") > 0).alias("valid"), F.size("s").cast("long").alias("n_syllables"), F.array_join("s", " ").alias("syllables"))


def western_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    w = docs.select(F.explode(F.split(F.lower("text"), r"[ \t\n\r\f\x0B]+")).alias("token")).distinct().filter("token <> ''")
    c = F.col("token")
    return w.select("token", t.western_suffix(c).alias("suffix"), t.western_cluster(c).alias("cluster"), t.latin_extended(c).alias("extended"), t.western_surname(c).alias("common"), t.strip_diacritics(c).alias("plain"))


def surname_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = authors(spark, sf_dir).select(F.lower("lastname").alias("surname"), F.lower("firstname").alias("given")).distinct()
    s, g = F.col("surname"), F.col("given")
    x = x.withColumn("c", t.compare_ranks(s, g)).withColumn("tr", t.traditional(s))
    return x.select(
        "surname", "given", F.col("c.rank_a").alias("rank"), F.col("c.rank_b").alias("given_rank"), "c.more_common", F.array_join(t.variant_readings(s), " ").alias("readings"),
        t.is_variant(s).alias("is_variant"), F.col("tr.hanzi").alias("traditional_hanzi"), F.col("tr.pinyin").alias("traditional_pinyin"), t.surname_origin(s).alias("origin"),
        t.is_surname_pinyin(s).alias("is_pinyin"), F.array_join(t.hanzi_of(s), " ").alias("hanzi"),
    )


def name_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = author_lists.details(authors(spark, sf_dir), "name_raw")
    return d.select("record_id", "name_order", "detected_order", F.array_join("name_parts", "|").alias("parts"), "is_non_chinese", "confidence")


def author_list_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = authors(spark, sf_dir).withColumn("n", F.replace("name_raw", F.lit(","), F.lit("")))
    lists = a.groupBy(F.col("publication_id").alias("list_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("record_id").cast("long").alias("k"), "n"))), lambda x: x["n"]), "; ").alias("authors"))
    return author_lists.parse_lists(lists)


def author_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return author_filter.with_verdict(authors(spark, sf_dir)).select("record_id", "is_chinese", "confidence", "reason", "surname_token")


def class_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.class_shares(author_filter.with_verdict(authors(spark, sf_dir)))


def exclusion_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.exclusion_reasons(author_filter.with_verdict(authors(spark, sf_dir)))


def false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.false_positives(author_filter.with_verdict(authors(spark, sf_dir))).select("record_id", "lastname", "name_raw", "reason")


def wrongly_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.wrongly_excluded(author_filter.with_verdict(authors(spark, sf_dir))).select("record_id", "lastname", "name_raw", "reason")


def version_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the three generations give which orders."""
    a = authors(spark, sf_dir)
    x = surname_v8.decide(a).drop("confidence", "mode", "reason_codes").withColumnRenamed("order", "v8")
    x = surname_older.identify_v7(x).drop("confidence", "mode").withColumnRenamed("order", "v7")
    x = surname_older.identify_v3(x).drop("confidence").withColumnRenamed("order", "v3")
    return x.groupBy("v3", "v7", "v8").agg(F.count("*").alias("n"))


def institutions_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("affiliation_raw")
    return authors(spark, sf_dir).select("record_id", institutions.is_institution(c).alias("found"), F.array_join(institutions.matched(c), "|").alias("keywords"), institutions.confidence(c).alias("confidence"))


def transliterations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every surname of the dictionary with its reading, its Cyrillic form and lookups by either."""
    rows = spark.createDataFrame([(h,) for h in dims.DEFAULT.hanzi], "hanzi string")
    c = F.col("hanzi")
    return rows.select(
        "hanzi", F.array_join(pinyin.readings(c), " ").alias("reading"), pinyin.cyrillic(c).alias("cyrillic"), pinyin.cyrillic(c, sep=" ").alias("cyrillic_spaced"),
        pinyin.cyrillic_surname(c).alias("cyrillic_surname"), t.surname_of(F.concat(c, F.lit("某"))).alias("surname"),
    )


def palladius_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of pinyin syllables and their Cyrillic forms, as the dimension that it is."""
    return dims.palladius_table(spark)


def surname_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted index from readings to surnames."""
    rows = spark.createDataFrame(list(dims.DEFAULT.surnames), "hanzi string, pinyin string")
    return rows.groupBy("pinyin").agg(F.array_join(F.sort_array(F.collect_set("hanzi")), " ").alias("hanzi"))


def surname_index_cyrillic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted index from Cyrillic forms to surnames."""
    rows = spark.createDataFrame([(h,) for h in dims.DEFAULT.hanzi], "hanzi string")
    rows = rows.withColumn("cyrillic", F.lower(pinyin.cyrillic(F.col("hanzi"))))
    return rows.groupBy("cyrillic").agg(F.array_join(F.sort_array(F.collect_set("hanzi")), " ").alias("hanzi"))


def processed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of several scripts taken apart."""
    d = processor.process(names(spark, sf_dir), "name")
    return d.select("name_id", "surname", "first_name", "confidence")


def processed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = processor.detect_order(names(spark, sf_dir), "name")
    return d.select("name_id", F.array_join("name_parts", "|").alias("parts"), "name_order", "detected_order", "confidence")


def mixed_name_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = author_lists.details(names(spark, sf_dir), "name")
    given = F.array_join(F.transform("is_first_name_map", lambda x: x.cast("int").cast("string")), "")
    return d.select("name_id", "name_order", "detected_order", F.array_join("name_parts", "|").alias("parts"), given.alias("given"), "is_non_chinese", "confidence")


def mixed_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of names of several scripts; every third one without an id, every seventh with an id that others have too."""
    n = names(spark, sf_dir)
    k = F.col("name_id")
    text = F.concat_ws("; ", "name", "other", F.when(k % 2 == 0, F.col("name")))
    text = F.when(k % 5 == 0, F.concat_ws(", ", "other", F.replace("name", F.lit(","), F.lit(" ")))).otherwise(text)
    lists = n.select(F.when(k % 3 != 0, F.when(k % 7 == 0, F.lit(-1)).otherwise(k)).cast("long").alias("list_id"), text.alias("authors"))
    return author_lists.parse_lists(lists).select("list_id", "position", "author", "used_order", "surname", "given_name", "middle_name", "is_first_author")


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests of script, cleaning and lookups on names of several scripts."""
    c = F.col("name")
    first = F.substring(t.strip_space(F.coalesce(c, F.lit(""))), 1, 1)
    return names(spark, sf_dir).select(
        "name_id", t.script_of(c).alias("script"), t.has_hanzi(c).alias("has_hanzi"), t.all_hanzi(c).alias("all_hanzi"), t.is_hanzi_char(first).alias("first_is_hanzi"),
        t.clean_name(c).alias("clean"), t.without_parentheses(c).alias("without_parentheses"), t.is_ambiguous(c).alias("ambiguous"),
        t.is_known_surname(F.split(t.clean_name(F.coalesce(c, F.lit(""))), " ")[0]).alias("known_first"),
    )


def syllables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tokens of documents are a syllable of the table, or one that is frequent in given names."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    w = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("token")).distinct()
    return w.select("token", pinyin.is_syllable(F.col("token")).alias("syllable"), pinyin.is_given_syllable(F.col("token")).alias("given"))


def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of a validation, as one row."""
    judged = author_filter.with_verdict(authors(spark, sf_dir)).drop("confidence", "reason", "surname_token")
    return quality.summary(surname_v8.identify(judged))


def author_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.sample(authors(spark, sf_dir), "record_id", 100).select("record_id", "name_raw")


QUERIES = {
    f.__name__: f
    for f in (
        v8_local, v8_batch, v8_summary, v8_accuracy, v7, v3, affiliations, pinyin_segments, western_features, surname_lookups,
        name_orders, author_list_parsing, author_verdicts, class_shares, exclusion_reasons, false_positives, wrongly_excluded, version_disagreement,
        institutions_found, transliterations, surname_index, author_sample, palladius_table, surname_index_cyrillic, processed_names, processed_orders,
        mixed_name_orders, mixed_lists, scripts, syllables, validation_report,
    )
}
ORACLE_SQL = {**sql.SQL, **sql_names.SQL}
