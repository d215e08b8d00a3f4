"""JSON author files as DataFrames, and results as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namelens.operators import quality

AUTHOR = "original_name string, lastname string, firstname string, affiliation string"
COUNT = "name string, people_count bigint"
PERSON = "orcid string, given string, family string, name string, authenticated boolean, affiliation array<string>"
DOCUMENT = (
    "all_authors array<struct<original_name:string,given:string,family:string,orcid:string,affiliation:array<string>,sequence:string>>, "
    "orcid_authors map<string,struct<orcid:string,given:string,family:string,name:string,authenticated:boolean,affiliation:array<string>>>"
)


def read_authors(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """Author records of a JSON array (or of JSON lines, which can be split over tasks)."""
    return spark.read.schema(AUTHOR).option("multiLine", not lines).json(path)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COUNT).option("multiLine", True).json(path)


def read_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(authors of works, persons) of a nested document."""
    doc = spark.read.schema(DOCUMENT).option("multiLine", True).json(path)
    authors = doc.select(F.explode("all_authors").alias("a")).select("a.*")
    persons = doc.select(F.explode("orcid_authors").alias("key", "p")).select("key", "p.*")
    return authors, persons


def as_records(authors: DataFrame) -> DataFrame:
    """Authors of works as name records: affiliations joined, ids as person ids."""
    return authors.select(
        F.sha2(F.concat_ws("|", "original_name", "orcid", "sequence"), 256).alias("record_id"),
        F.lit("ORCID").alias("source"), F.col("orcid").alias("person_id"), F.lit(None).cast("string").alias("publication_id"),
        F.col("original_name").alias("name_raw"), F.array_join("affiliation", "; ").alias("affiliation_raw"),
    )


def write_results(df: DataFrame, path: str, *, sample: int | None = None, order_by: str | None = None) -> None:
    """Rows as JSON lines; with sample, the first rows by order_by alone."""
    out = df.orderBy(order_by).limit(sample) if sample and order_by else df
    out.write.mode("overwrite").json(path)


def write_report(df: DataFrame, path: str, *, cases: int = 200) -> None:
    """A report as JSON: summary, exclusion reasons, and at most `cases` examples of each kind of error (the feature of a report).

    df has name_raw and lastname, the verdict's is_chinese and reason, and order.
    """
    some = lambda x: x.select("name_raw", "lastname", "reason").orderBy("name_raw", "lastname", "reason").limit(cases)
    parts = {
        "summary": quality.summary(df),
        "exclusion_reasons": quality.exclusion_reasons(df),
        "wrongly_excluded_cases": some(quality.wrongly_excluded(df)),
        "false_positive_cases": some(quality.false_positives(df)),
    }
    for name, x in parts.items():
        x.coalesce(1).write.mode("overwrite").json(f"{path}/{name}")
