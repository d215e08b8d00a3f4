"""Co-training: what the exchange between the views is worth, its parts against plain Python, odd tables."""

import random

import numpy as np
import pytest

from namelens.llm import cotraining

SCHEMA = "doc_id long, text string, lang string, source string, key string, y double"


def corpus(n=2400, seed=4):
    """The source gives the class away, where it is known; good and bad words are many, so a few texts show few of them."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        bad = rng.random() < 0.4
        w = [f"{'bad' if bad else 'good'}{rng.randrange(1500)}" if rng.random() < 0.2 else f"w{rng.randrange(200)}" for _ in range(40)]
        source = None if i % 4 == 0 else f"{'x' if bad else 'y'}{rng.randrange(3)}"
        rows.append((i, " ".join(w), "en", source, "k", 2.0, bad))
    return rows


def accuracy(spark, rows, labelled, rounds):
    d = spark.createDataFrame([r[:6] for r in rows], SCHEMA).repartition(4)
    labels = spark.createDataFrame([(r[0], int(not r[6])) for r in rows if r[0] in labelled], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in cotraining.quality(d, labels, rounds=rounds, share=0.2).collect()}
    assert len(got) == len(rows)
    unknown = [r for r in rows if r[3] is None and r[0] not in labelled]
    known = [r for r in rows if r[3] is not None and r[0] not in labelled]
    right = lambda some, name: sum((got[r[0]][name] >= 0.5) != r[6] for r in some) / len(some)
    return right(unknown, "text_score"), right(known, "score")


def test_exchange_teaches_the_text_view(spark):
    """Where the source is unknown, the text view alone sees too few labelled words; labels from the other view make up for it."""
    rows = corpus()
    labelled = {r[0] for r in rows[:150] if r[3] is not None}
    alone, _ = accuracy(spark, rows, labelled, 0)
    taught, known = accuracy(spark, rows, labelled, 3)
    assert taught >= 0.9 and taught >= alone + 0.05 and known >= 0.97, (alone, taught, known)


def test_odd_tables(spark):
    rows = [r[:6] for r in corpus(300)]
    d = spark.createDataFrame([*rows, (None, None, None, None, None, None), (900, "", "en", "x1", "k", 1.0), (1, "other text", None, None, None, None), rows[5]], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (7, None)], "doc_id long, quality int")
    got = cotraining.quality(d, labels).collect()
    assert len(got) == 304 and all(0 <= r["score"] <= 1 for r in got)
    five = [r for r in got if r["doc_id"] == 5]
    assert len(five) == 2 and five[0] == five[1]
    assert {r["score"] for r in cotraining.quality(d, labels.limit(0)).collect()} == {0.5}
    assert cotraining.quality(d.limit(0), labels).count() == 0


def test_views_and_counts():
    shares, buckets = cotraining.text_view("Good GOOD good good x1 !!")
    assert shares[2] == pytest.approx(1 / 6) and shares[3] == pytest.approx(4 / 6) and shares[4] == pytest.approx(5 / 6) and shares[5] == pytest.approx(1 / 6)
    assert len(buckets) == 5 + 5 and cotraining.text_view(None)[0] == [0.0] * 9 and len(cotraining.text_view("")[1]) == 0
    c = cotraining.Counts()
    for y, k in ((1, 3), (0, 1)):
        for _ in range(k):
            c.add(0, y, np.array([7]))
    c.add(1, 0, np.array([9]))
    assert c.odds(1)[7] == pytest.approx((np.log(3.5 / 4) - np.log(1.5 / 2)) * 4 / 7, rel=1e-5) and c.odds(0)[7] == 0


def test_cut_offs_cover_the_share():
    rng = np.random.default_rng(1)
    odds = rng.normal(0, 5, 20000).clip(-14.9, 14.9)
    h = np.bincount(((odds + cotraining.ENDS) / cotraining.STEP).astype(int), minlength=600)
    low, high = cotraining.cut_offs(h, 0.1, 0.3)
    assert 0.065 <= (odds < low).mean() <= 0.08 and 0.028 <= (odds > high).mean() <= 0.034
    assert cotraining.cut_offs(h, 1.0, 0.5) == (-2.2, 2.2)
