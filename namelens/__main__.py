"""python -m namelens: judges the authors of a JSON file and writes a report."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from namelens.functions import labels
from namelens.operators import author_filter, quality, surname_v8
from namelens.sources import json_authors


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="namelens", description="Author names: classes, surnames and a report of their quality.")
    p.add_argument("--data-path", required=True, help="JSON array of authors (original_name, lastname, firstname, affiliation)")
    p.add_argument("--output", required=True, help="folder of the report")
    p.add_argument("--language", choices=sorted(labels.TEXTS), default="ru", help="language of what is printed")
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    a = arguments(argv)
    spark = SparkSession.builder.appName("namelens").getOrCreate()
    authors = json_authors.read_authors(spark, a.data_path)
    rows = authors.select(F.col("original_name").alias("name_raw"), "lastname", "firstname", F.col("affiliation").alias("affiliation_raw"), F.lit("CROSSREF").alias("source"))
    judged = surname_v8.decide(author_filter.with_verdict(rows).drop("confidence", "surname_token")).drop("confidence")
    json_authors.write_report(judged, a.output)
    s = quality.summary(judged).first().asDict()
    shown = labels.formatted({"total": s["total_authors"], "accuracy": s["surname_accuracy"], "chinese_count": s["chinese_count"], "non_chinese_count": s["non_chinese_count"]}, a.language)
    print(labels.separator())
    for k, v in shown.items():
        print(f"{k}: {v}")


if __name__ == "__main__":
    main()
