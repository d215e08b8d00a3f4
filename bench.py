"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = ["v8_batch", "v7", "v3", "affiliations", "western_features", "author_verdicts", "name_orders"]


def main() -> None:
    from namelens.plans import catalog

    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):  # the first also compiles; the second counts
            began = time.time()
            catalog.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(runs[-1], 3)
    records = spark.read.parquet(f"{d}/orders.parquet").count()
    out = {"metric": "sum of warm query times", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": d.rpartition("sf")[2]}
    print(json.dumps(out | {"v8_batch_records_per_sec": round(records / took["v8_batch"])}))


if __name__ == "__main__":
    main()
