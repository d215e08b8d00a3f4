"""Source mixing without Python workers, and its look-up of a point's source."""

import numpy as np
from pyspark.sql import functions as F

from namelens.llm import source_mixing

DOCS = [(i, ("a", "b", None, "ü'\"")[i % 4], "word " * (3 + i % 7)) for i in range(60)]


def test_no_python_workers(spark, capfd):
    """Two Python nodes in a row, or rows of the driver as an RDD, would leave workers with every executor."""
    docs = spark.createDataFrame(DOCS, "doc_id long, source string, text string").coalesce(1)
    _, pieces, shares = source_mixing.mix(docs)
    pieces.explain("extended")
    slots = source_mixing.schedule(spark, shares, 1000)
    slots.filter("source_no is not null").explain("extended")
    plan = capfd.readouterr().out
    assert "Exchange" in plan and "EvalPython" not in plan and "ExistingRDD" not in plan
    source_mixing.taken_words(docs).explain("extended")
    plan = capfd.readouterr().out
    assert "of#" in plan and "ExistingRDD" not in plan


def test_source_of_a_point(spark):
    top = source_mixing.POINTS
    points = [0, 1, 5, 6, 7, 8, 9, 10, 99, 100, 101, top - 1]
    d = spark.createDataFrame([(p,) for p in points], "point long")
    for highs in ([], [top], [0, 0, 7, 7, top], [5, 6, 9, 100, top, top], sorted(np.random.default_rng(1).integers(0, 110, 1000).tolist()) + [top]):
        got = [r[0] for r in d.select(source_mixing.source_at(highs, F.col("point"))).collect()]
        assert got == np.searchsorted(np.array(highs, np.int64), points, side="right").tolist()
