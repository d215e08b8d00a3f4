"""The n-gram join against all pairs: links within components, rows without ids, lists that are narrowed, and its filters."""

import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from namelens.llm import ngram_join
from namelens.llm.common import WIDTH, mix


def near_copies(n=40):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(i % 4):
            w[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(w)))
    return [*rows, (100, "a b c d e"), (101, "a b c d e f"), (102, "q r s t u"), (103, None), (104, rows[1][1])]


def paragraphs(n):
    """Texts of 4 of 30 passages that many texts share, with a few words of their own, and some near copies of them."""
    rng = random.Random(3)
    passages = [" ".join(f"p{j}w{i}" for i in range(12)) for j in range(30)]
    texts = [" ".join(rng.sample(passages, 4)) + f" own{i}" for i in range(n)]
    return list(enumerate(texts + [t + " more" for t in texts[: n // 10]]))


def sets_of(rows, k):
    return {i: frozenset(zip(*[(t or "").split()[j:] for j in range(k)], strict=False)) for i, t in rows}


def n_links(sets, percent):
    kinds = set(sets.values()) - {frozenset()}
    return {i: sum(o != s and 100 * len(s & o) >= percent * len(s | o) for o in kinds) for i, s in sets.items()}


@pytest.mark.parametrize("block", [1024, 4])
def test_n_links_are_all_links(spark, monkeypatch, block):
    rows, k, percent = near_copies(), 3, 80
    want = n_links(sets_of(rows, k), percent)
    monkeypatch.setattr(ngram_join.verified, "__defaults__", (block,))
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=k, percent=percent).collect()
    assert {r["doc_id"]: r["n_links"] for r in got} == want and max(want.values()) > 5 and len(got) == len(rows)


def test_narrowed_lists_lose_no_link(spark, monkeypatch):
    """Every list that centres leave mixed goes through the parts."""
    monkeypatch.setattr(ngram_join, "MOST_PAIRS", -1)
    monkeypatch.setattr(ngram_join, "CENTRES", 1)
    rows = paragraphs(120)
    sets = sets_of(rows, 3)
    got = {r["doc_id"]: r for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=80).collect()}
    assert {i: r["n_links"] for i, r in got.items()} == n_links(sets, 80)
    for i in sets:
        for j in sets:
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                assert got[i]["component_id"] == got[j]["component_id"]


def test_rows_without_ids_join_nothing(spark):
    words = lambda p: " ".join(f"{p}{i}" for i in range(60))
    rows = [(1, words("a")), (2, words("b")), (None, words("a") + " x"), (None, words("b") + " x"), (None, None), (3, words("c")), (3, words("d")), (4, words("d") + " y")]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=90).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["n_links"]) for r in got) == [(-1, -1, 0), (-1, 1, 1), (-1, 2, 1), (1, 1, 1), (2, 2, 1), (3, 3, 0), (3, 3, 1), (4, 3, 1)]


@given(st.lists(st.integers(0, 1 << 40), min_size=1, max_size=400, unique=True), st.integers(0, 12), st.integers(0, 12), st.sampled_from([70, 80, 90]))
def test_filters_keep_linked_pairs(values, drop, add, percent):
    mixed = lambda v: np.unique(mix(np.array(v, np.uint64))).view(np.int64)
    x, y = mixed(values), mixed(values[min(drop, len(values) - 1) :] + [(1 << 50) + i for i in range(add)])
    x, y = (np.sort(v) for v in (x, y))
    both = len(np.intersect1d(x, y))
    if 100 * both < percent * (len(x) + len(y) - both):
        return
    common = np.random.default_rng(1).integers(0, 100, WIDTH).astype(np.uint8)
    assert len(np.intersect1d(ngram_join.prefix_of(x, percent, common), ngram_join.prefix_of(y, percent, common)))
    assert len(np.intersect1d(ngram_join.part_keys(x, percent), ngram_join.part_keys(y, percent)))
    a, b = (np.array(ngram_join.signature(v, percent), np.int64) for v in (x, y))
    m = ngram_join.BITS
    assert all((a[i * m : i * m + m] & b[i * m : i * m + m]).any() for i in range(len(ngram_join.ORDERS)))
    most = (100 - percent) * (len(x) + len(y)) // (100 + percent)
    odd = (a[-ngram_join.PARITY :] ^ b[-ngram_join.PARITY :]).view(np.uint8)
    assert np.unpackbits(odd).sum() <= most
    p, q = sorted((ngram_join.long_parity(x), ngram_join.long_parity(y)), key=len)
    assert len(q) in (len(p), 2 * len(p))
    q = q if len(q) == len(p) else q[: len(p)] ^ q[len(p) :]
    assert np.unpackbits((p ^ q).view(np.uint8)).sum() <= most


def test_long_parity_folds(spark):
    """Near copies on both sides of a power of two of shingles link."""
    base = [f"w{i}" for i in range(600)]
    rows = [(i, " ".join(base[:n])) for i, n in enumerate((500, 510, 514, 515, 516, 530, 300))]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_links"] for r in got} == n_links(sets_of(rows, 3), 90)


def test_candidates_of_shared_passages_are_few(spark, monkeypatch):
    """Twice the texts over the same passages give no more than about twice the candidates to verify."""
    seen = []
    verified = ngram_join.verified

    def counted(labels, *args):
        seen.append(labels.count())
        return verified(labels, *args)

    monkeypatch.setattr(ngram_join, "verified", counted)
    for n in (200, 400):
        ngram_join.near_duplicates(spark.createDataFrame(paragraphs(n), "doc_id long, text string"), counts=False)
    assert seen[0] < 100 and seen[1] <= 3 * seen[0], seen
