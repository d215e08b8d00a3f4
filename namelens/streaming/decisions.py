"""Name decisions over streams; an extension.

Decisions are projections, so `decide` works on a stream as it is. Counts per
person are an aggregation in update mode with a watermark, which bounds state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namelens.operators import surname_v8


def person_counts(records: DataFrame, *, time: str = "ts", delay: str = "1 hour", window: str = "1 day", least: float = 0.7) -> DataFrame:
    """Confident decisions of each order by person and time window."""
    d = surname_v8.decide(records.withWatermark(time, delay))
    sure = lambda o: F.sum(((F.col("order") == o) & (F.col("confidence") >= least)).cast("long"))
    return d.filter(F.coalesce("person_id", F.lit("")) != "").groupBy(F.window(time, window), "person_id").agg(sure("family_first").alias("family_first"), sure("given_first").alias("given_first"))
