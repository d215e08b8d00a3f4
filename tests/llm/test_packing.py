"""The grouping genetic algorithm against plain best fit and lower bounds, and packing of odd tables."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from namelens.llm import packing
from namelens.llm.queries import tokenizer_path


def best_fit(sizes, capacity=2048):
    bins, fill = [], []
    packing.best_fit(bins, fill, list(range(len(sizes))), sizes, capacity)
    return bins, fill


def whole(p, sizes, capacity=2048):
    assert sorted(x for g in p[0] for x in g) == list(range(len(sizes)))
    assert [sum(sizes[x] for x in g) for g in p[0]] == p[1] and all(0 < f <= capacity for f in p[1])


@pytest.mark.parametrize("low, high, gain", [(500, 900, 0.02), (600, 760, 0.03), (300, 1000, 0.005)])
def test_evolution_beats_best_fit(low, high, gain):
    rng = random.Random(low)
    sizes = [rng.randint(low, high) for _ in range(600)]
    plain = len(best_fit(sizes)[0])
    people = packing.evolve(sizes, [], capacity=2048, generations=60, members=6, patience=15, seed=1)
    for p in people:
        whole(p, sizes)
    assert packing.lower_bound(sizes, 2048) <= len(people[0][0]) <= (1 - gain) * plain


def test_operators_lose_no_piece():
    rng = random.Random(5)
    for _ in range(50):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(1, 40))]
        a, b = best_fit(sizes, 100), packing.packing_of([[x] for x in range(len(sizes))], sizes)
        whole(packing.cross(a, b, sizes, 100, rng), sizes, 100)
        whole(packing.cross(b, a, sizes, 100, rng), sizes, 100)


def test_lower_bound_is_one():
    """Never more than the fewest bins, by trying all; more than the sum's bound where pieces cannot share."""
    rng = random.Random(6)
    for _ in range(60):
        sizes = [rng.randint(1, 10) for _ in range(rng.randint(1, 7))]
        fewest = min(sum(1 for _ in groups(order, 10)) for order in ([sizes[i] for i in p] for p in itertools.permutations(range(len(sizes)))))
        assert -(-sum(sizes) // 10) <= packing.lower_bound(sizes, 10) <= fewest
    assert packing.lower_bound([6] * 5, 10) == 5 and packing.lower_bound([], 10) == 0


def groups(order, capacity):
    """Next fit; over all orders, the best of it is optimal."""
    fill = None
    for s in order:
        if fill is None or fill + s > capacity:
            yield s
            fill = s
        else:
            fill += s


def test_islands_beat_best_fit(spark):
    rng = random.Random(8)
    sizes = [rng.randint(500, 900) for _ in range(600)]
    d = spark.createDataFrame(list(enumerate(sizes)), "row_id long, length long").withColumn("block", F.col("row_id") % 2)
    params = {"capacity": 2048, "patience": 15}
    plain = packing.pack_blocks(d, islands=1, epochs=1, generations=0, members=1, **params)
    evolved = packing.pack_blocks(d, islands=2, epochs=2, generations=60, members=6, **params).cache()
    n = lambda x: x.select("block", "bin").distinct().count()
    assert n(evolved) < n(plain)
    assert evolved.groupBy("block", "bin").agg(F.sum("length").alias("f")).filter("f > 2048").isEmpty() and evolved.select("row_id").distinct().count() == 600


def test_odd_rows(spark):
    """Null and shared ids, ties, repeated rows, blank texts, clashing columns, a text of several sequences."""
    long = " ".join(f"word{i}" for i in range(4000))
    rows = [(None, "a b"), (None, "a b"), (7, "x"), (7, "y"), (8, None), (9, ""), (10, " \n"), (11, long)]
    d = spark.createDataFrame([(i, t, 1, 2, "s") for i, t in rows], "doc_id long, text string, row_id int, length int, sequence_id string")
    got = packing.pack(d, tokenizer_path()).toPandas()
    assert len(got[got.doc_id.isna()]) == 2 and sorted(got[got.doc_id == 7].piece) == [0, 0] and len(got[got.doc_id.isin([8, 9, 10])]) == 3
    assert got[got.doc_id.isin([8, 9])].length.tolist() == [1, 1]
    parts = got[got.doc_id == 11].sort_values("piece")
    assert len(parts) > 2 and (parts.length.iloc[1:] == 2048).all()
    for _, x in got.sort_values("offset").groupby("sequence_id"):
        assert x.offset.tolist() == [0, *x.length.cumsum().tolist()][:-1] and x.length.sum() <= 2048
