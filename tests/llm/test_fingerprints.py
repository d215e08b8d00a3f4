"""Fingerprints, edited texts and likenesses against plain Python, hashes included."""

import hashlib
import random
import struct

import pytest
import xxhash

from namelens.llm import fingerprints, queries


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def chain(*values):
    """Spark's xxhash64 of strings and longs: each is hashed with the hash before as seed."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), h)
    return signed(h)


def anchors(text, size=64):
    h = [chain(w.decode()) for w in text.encode().split()]
    s = [chain(a, b) for a, b in zip(h, h[1:], strict=False)]
    first = {}
    for i in range(len(h) - 4):
        if min(s[i : i + 4]) in (s[i], s[i + 3]):
            first.setdefault(chain(chain(s[i], h[i + 2]), s[i + 3]), i)
    return dict(sorted(first.items())[:size]) or {chain("whole", text): 0}


def likeness(a, b, size=64):
    u = sorted(set(a) | set(b))[:size]
    d = sorted(b[v] - a[v] for v in u if v in a and v in b)
    return sum(abs(x - d[len(d) // 2]) <= 16 for x in d) / len(u)


def shown(a):
    return " ".join(f"{h & (1 << 64) - 1:x}@{p}" for h, p in a.items())


def texts(n, seed):
    rng = random.Random(seed)
    words = ["a", "bb", "é", "ЖЖ", "x#y", *map(str, range(30))]
    some = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 4, 5, 6, 9, 30, 200]))) for _ in range(n)]
    return [*some, some[0], some[n - 1] + " tail", None, "", " \n\t "]


IDS = {
    "plain": lambda i: i * 3,
    "repeated and null": lambda i: None if i % 7 == 0 else i // 2,
    "63 bits": lambda i: [0, 1, (1 << 63) - 1, -(1 << 63), -(1 << 62) - 5, 7, (1 << 62) + 5][i % 7] if i < 14 else i,
    "one far off": lambda i: i if i else 1 << 60,
}


@pytest.mark.parametrize("ids", sorted(IDS))
def test_all_columns(spark, ids):
    rows = [(IDS[ids](i), t) for i, t in enumerate(texts(40, 5))]
    rows.append(rows[3])
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, range int, following string").repartition(3)
    got = fingerprints.edited_fingerprints(d).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, chain(r[1])))
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, e, n = anchors(t), anchors(edited), anchors(after)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), shown(a), shown(e), round(likeness(a, e), 9), round(likeness(a, n), 9)))
    assert sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in got), key=repr) == sorted(want, key=repr)


def test_all_anchors_and_sizes(spark):
    """size=None keeps every anchor; each word of a short text matters."""
    rng = random.Random(2)
    long = " ".join(str(rng.randrange(500)) for _ in range(3000))
    x = fingerprints.with_anchors(spark.createDataFrame([(long,)], "text string"), "text", "t", None).first()
    want = anchors(long, 1 << 30)
    assert dict(zip(x["t_h"], x["t_p"], strict=True)) == want and len(want) > 1000
    rows = []
    for k in range(60):
        w = [str(rng.randrange(10**6)) for _ in range(5)]
        rows += [(k, -1, " ".join(w)), *((k, j, " ".join(w[:j] + ["other"] + w[j + 1 :])) for j in range(5))]
    d = fingerprints.with_anchors(spark.createDataFrame(rows, "k int, j int, text string"), "text", "t")
    shown = {(r["k"], r["j"]): tuple(r["t_h"]) for r in d.collect()}
    assert all(shown[k, j] != shown[k, -1] for k in range(60) for j in range(5))


def test_ranges_are_even_and_in_order(spark):
    ids = [*range(3000), 1 << 62, -(1 << 62), *[5] * 50]
    d = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    got = sorted((r[0], r[1]) for r in d.select("doc_id", fingerprints.id_ranges(d, 16)).collect())
    assert [r for _, r in got] == sorted(r for _, r in got)
    sizes = [sum(1 for _, r in got if r == k) for k in {r for _, r in got}]
    assert max(sizes) <= 3100 / 16 + 60


def test_empty(spark):
    assert fingerprints.edited_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_keeps_every_anchor(spark, tmp_path):
    """The registered query keeps all anchors of a text of any length, and compares all of them: a change outside the least 64 shows."""
    rng = random.Random(8)
    base = [str(rng.randrange(10**6)) for _ in range(3000)]
    kept = set(anchors(" ".join(base)).values())
    j = next(j for j in range(100, 2900) if not kept & set(range(j - 4, j + 1)) and set(anchors(" ".join(base), 1 << 30).values()) & set(range(j - 4, j + 1)))
    changed = [*base[:j], "other", *base[j + 1 :]]
    assert anchors(" ".join(base)) == anchors(" ".join(changed))
    repeats = [str(rng.randrange(40)) for _ in range(2000)]
    words = [base, changed, changed, base[:2000] + base[1000:], repeats, base[7:], [str(i % 20_000) for i in range(30_000)], [], ["a"] * 500, base[:100]]
    rows = [(3 * i, " ".join(w)) for i, w in enumerate(words)]
    spark.createDataFrame([*rows, (100, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op10_fingerprints(spark, str(tmp_path)).collect()}
    assert len(got) == len(words) + 1 and got[0]["fingerprint"] != got[3]["fingerprint"] == got[6]["fingerprint"]
    every, texts = 1 << 30, [t for _, t in rows] + [""]
    for i, (k, t) in enumerate(zip([*(3 * i for i in range(len(words))), 100], texts, strict=True)):
        after, half = texts[(i + 1) % len(texts)], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, e, n = (anchors(x, every) for x in (t, edited, after))
        assert (got[k]["fingerprint"], got[k]["edited_fingerprint"]) == (shown(a), shown(e)), k
        assert (got[k]["near_edited"], got[k]["near_next"]) == pytest.approx((likeness(a, e, every), likeness(a, n, every)), abs=1e-9), k
    assert len(got[0]["fingerprint"].split()) > 1000 and got[0]["near_next"] < 1
