"""Licence notices: the usual texts wrapped, amid other words and altered, and all passages by brute force."""

import random
import re
import textwrap

import pytest

from namelens.llm import licenses

PROSE = "The quick brown fox jumps over the lazy dog and runs on through the wood until it is dark"


def words(t):
    return re.findall(r"[^\W_]+", t.lower())


def dice(a, b):
    return 2 * len(a & b) / (len(a) + len(b))


def brute(text, rows=None, least=licenses.LEAST_DICE):
    """Every run of bigrams of an allowed size against every template, joined where they overlap and share the ends' bigrams."""
    w = words(text or "")
    g = list(zip(w, w[1:], strict=False))
    found = []
    for licence, t in licenses.TEMPLATES if rows is None else rows:
        tw = words(t)
        grams = set(zip(tw, tw[1:], strict=False))
        low, high, _ = licenses.bounds(len(grams), least)
        for s in range(len(g)):
            for e in range(s + low, min(len(g), s + high) + 1):
                if g[s] in grams and g[e - 1] in grams and (d := dice(set(g[s:e]), grams)) >= least:
                    found.append((s, e - 1, d, licence))
    out = []
    for s, e, d, licence in sorted(found):
        if out and s <= out[-1][1]:
            a, b, c, name = out[-1]
            out[-1] = (a, max(b, e), *((d, licence) if (-d, licence) < (-c, name) else (c, name)))
        else:
            out.append((s, e, d, licence))
    best = min(((-d, n) for _, _, d, n in out), default=(None, None))
    return best[1], None if best[0] is None else round(-best[0], 6), len(out), ",".join(sorted({n for *_, n in out}))


def scanned(spark, texts, **params):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, w int, notices string")
    got = {r["doc_id"]: tuple(r)[1:] for r in licenses.scan(d, **params).collect()}
    return [got[i] for i in range(len(texts))]


@pytest.mark.parametrize("i", range(len(licenses.TEMPLATES)))
def test_bounds_lose_no_passage(i):
    """A passage that matches has an allowed size, enough of the template's bigrams, and a needed word."""
    rng = random.Random(i)
    rows = [licenses.TEMPLATES[i]]
    tw = words(rows[0][1])
    grams = set(zip(tw, tw[1:], strict=False))
    low, high, need = licenses.bounds(len(grams), 0.85)
    gate = set(licenses.needed_words(rows, 0.85))
    for _ in range(60):
        w = [x for x in tw if rng.random() > 0.03]
        for _ in range(rng.randrange(4)):
            w.insert(rng.randrange(len(w) + 1), "other")
        g = set(zip(w, w[1:], strict=False))
        if g and dice(g, grams) >= 0.85:
            assert low <= len(g) <= high and len(g & grams) >= need and gate & set(w)


def test_whole_texts_are_found(spark):
    """All templates, wrapped at 70 columns in a longer text, and amid a line of other words."""
    texts, want = [], []
    for licence, t in licenses.TEMPLATES:
        for text in (PROSE + "\n\n" + textwrap.fill(t, 70, initial_indent=" * ", subsequent_indent=" * ") + "\n\n" + PROSE, f"{PROSE}. {' '.join(t.split())} {PROSE}"):
            texts.append(text)
            want.append(licence)
    got = scanned(spark, texts)
    assert [(r[0], r[1], r[2]) for r in got] == [(x, 1.0, 1) for x in want]


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = [licenses.TEMPLATES[i] for i in range(len(licenses.TEMPLATES)) if len(licenses.TEMPLATES[i][1]) < 400]
    texts = [None, "", "MIT", " \n", "licensed\tunder\tthe apache license version 2.0", PROSE * 3]
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            w = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(4)):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], ["other"], [w[k], w[k]], ["the"]])
            parts += [" ".join(w), rng.choice(["", "\n", PROSE, "é ЖЖ "])]
        texts.append(rng.choice([" ", "\n", "; "]).join(parts))
    texts += [texts[6], ("Released under the MIT License.\n" + PROSE + "\n") * 50]
    got = scanned(spark, texts, rows=rows)
    assert got == [brute(t, rows) for t in texts]
    assert got[-1][2] == 50 and sum(r[2] > 1 for r in got) > 10


def test_rows_are_judged_on_their_own(spark):
    d = spark.createDataFrame([(1, "x y z w"), (1, "Released under the MIT License."), (None, "x"), (None, "Licensed under CC BY 4.0.")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["licence"]) for r in licenses.scan(d).collect()), key=repr)
    assert got == sorted([(1, None), (1, "MIT"), (None, None), (None, "CC-BY-4.0")], key=repr)
    assert licenses.scan(d.limit(0)).count() == 0 and licenses.scan(d, rows=[]).filter("n_matches > 0").count() == 0
