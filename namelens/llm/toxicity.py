"""Operator 3: toxic passages as maximum-scoring segments.

Training: each word and its prefixes get the log-odds of standing in a toxic
document against a clean one, with an informative Dirichlet prior, and the
z-score of that. Significant ones score their log-odds, any other word a fixed
negative amount. Scoring: one linear scan (Ruzzo and Tompa) finds all maximal
segments of a text. A segment of score s in n words has the expected number of
equals E = K n exp(-lambda s) under the clean background (Karlin and Altschul);
the text's -log E is calibrated to a probability on the training rows.

Labels come only from rows whose crc32(doc_id as text) mod 4 is not 2, from a
sample of at most about max_toxic and max_clean of them chosen by hash (the
documented bound of the training sample). Only the text is an input of a score.

Defined results: null and empty texts have no segment and get the score of the
weakest evidence; without labels of both kinds every score is 0; repeated rows
are scored alike; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namelens.llm.common import id_columns, ids_of, saved

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    background: float = -1.0
    lam: float = 1.0
    k: float = 0.1
    slope: float = 0.0
    intercept: float = -math.inf

    def word(self, w: str) -> float:
        """The strongest of the word and its prefixes, else the background score."""
        got = [self.scores[x] for x in (w + "$", *(w[:n] for n in PREFIXES if len(w) >= n)) if x in self.scores]
        return max(got, default=self.background)


def segments(at: list[int], scores: list[float], background: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, as (first word, last word, score), in order.

    at, scores: where the words with a positive score stand; all others score background < 0.
    Ruzzo and Tompa's algorithm over cumulative sums; each candidate is (first, last, sum before, sum up to its end).
    """
    kept: list[tuple[int, int, float, float]] = []
    total, last = 0.0, -1
    for i, s in zip(at, scores, strict=True):
        total += background * (i - last - 1)
        x = (i, i, total, total + s)
        total, last = total + s, i
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= x[2]:
                j -= 1
            if j < 0 or kept[j][3] >= x[3]:
                kept.append(x)
                break
            x = (kept[j][0], x[1], kept[j][2], x[3])
            del kept[j:]
    return [(a, b, r - l) for a, b, l, r in kept]


def scan(text: str | None, model: Model, seen: dict[str, float]) -> tuple[int, list[tuple[int, int, float]]]:
    """The number of words and the maximal segments. seen: scores of words met before."""
    words = WORD.findall(text.lower()) if text else []
    at, scores = [], []
    for i, w in enumerate(words):
        s = seen.get(w)
        if s is None:
            if len(seen) > 500_000:
                seen.clear()
            s = seen[w] = model.word(w)
        if s > 0:
            at.append(i)
            scores.append(s)
    return len(words), segments(at, scores, model.background)


def evidence(n_words: int, found: list[tuple[int, int, float]], model: Model) -> float:
    """-log of the expected number of such segments by chance: of the best segment, plus what other significant ones add."""
    if not found:
        return -5.0
    x = sorted((model.lam * s - math.log(model.k * max(n_words, 1)) for _, _, s in found), reverse=True)
    return max(-5.0, min(60.0, x[0] + sum(v for v in x[1:] if v > 0)))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, *, max_toxic: int = 8000, max_clean: int = 16000, prior: float = 0.05, least_z: float = 2.5, least_odds: float = 2.0) -> Model:
    """docs: doc_id and text; labels: doc_id and toxic."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Model()
    part = lambda most, has: int(min(1.0, most / has) * (1 << 30))
    bound = F.when(F.col("toxic"), part(max_toxic, n[True])).otherwise(part(max_clean, n[False]))
    known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < bound)
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    # copies of one text count once
    sample = saved(sample.dropDuplicates(["text", "toxic"]), "toxic-sample")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, list[int]] = {}

        def out() -> pd.DataFrame:
            df = pd.DataFrame({"feature": pd.Series(list(counts), dtype=object), "toxic": [c[1] for c in counts.values()], "clean": [c[0] for c in counts.values()]})
            counts.clear()
            return df

        for b in batches:
            for text, toxic in zip(b["text"], b["toxic"], strict=True):
                words = set(WORD.findall((text or "").lower()))
                for x in {w + "$" for w in words} | {w[:n] for w in words for n in PREFIXES if len(w) >= n}:
                    counts.setdefault(x, [0, 0])[int(toxic)] += 1
            if len(counts) > 400_000:
                yield out()
        yield out()

    f = sample.select("text", "toxic").mapInPandas(count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    f = saved(f, "toxic-features")
    total = f.agg(F.sum("t"), F.sum("c")).first()
    nt, nc = float(total[0] or 0), float(total[1] or 0)
    if not nt or not nc:
        return Model()
    a0 = F.lit(prior * (nt + nc))  # the prior weighs as much as this share of the sample
    a = a0 * (F.col("t") + F.col("c")) / F.lit(nt + nc) + F.lit(0.01)
    odds = lambda y, n: F.log((y + a) / (F.lit(n) + a0 - y - a))
    f = f.withColumns({"odds": odds(F.col("t"), nt) - odds(F.col("c"), nc), "z": (odds(F.col("t"), nt) - odds(F.col("c"), nc)) / F.sqrt(1 / (F.col("t") + a) + 1 / (F.col("c") + a))})
    # each holds in several toxic texts of the sample, so max_toxic bounds their number, whatever the corpus
    found = f.filter((F.col("z") >= least_z) & (F.col("odds") >= least_odds)).select("feature", "odds").collect()
    model = Model(scores={r["feature"]: float(r["odds"]) for r in found})
    return _calibrate(sample, model)


def _calibrate(sample: DataFrame, model: Model) -> Model:
    """lambda from the clean background's word scores, K and the logistic curve from texts' best segments."""

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, float] = {}
        for b in batches:
            out = []
            for text, toxic in zip(b["text"], b["toxic"], strict=True):
                n, found = scan(text, model, seen)
                out.append((bool(toxic), n, max((s for *_, s in found), default=0.0), sum(s for *_, s in found)))
            yield pd.DataFrame(out, columns=["toxic", "n", "best", "all"])

    # one row of four numbers per sampled text, of which there are at most about max_toxic + max_clean
    x = sample.select("text", "toxic").mapInPandas(best, "toxic boolean, n long, best double, all double").toPandas()
    clean = x[~x["toxic"]]
    words = float(clean["n"].sum()) or 1.0
    hits = clean.loc[clean["best"] > 0, "all"]
    typical = float(np.median(list(model.scores.values()))) if model.scores else 1.0
    p = min(0.05, max((hits.sum() / typical) / words, 1 / (words + 1)))  # share of words that score in clean texts
    # lambda: (1 - p) exp(lambda b) + p exp(lambda typical) = 1
    low, high = 1e-6, 50.0
    for _ in range(100):
        mid = (low + high) / 2
        v = (1 - p) * math.exp(mid * model.background) + p * math.exp(min(700.0, mid * typical))
        low, high = (mid, high) if v < 1 else (low, mid)
    model.lam = low
    # K from the share of clean texts whose best segment reaches the typical score
    reached = float((clean["best"] >= typical).mean()) if len(clean) else 0.0
    mean_n = max(1.0, words / max(1, len(clean)))
    model.k = max(1e-9, -math.log(1 - min(0.99, max(reached, 1e-6))) / (mean_n * math.exp(-model.lam * typical)))

    def evident(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, float] = {}
        for b in batches:
            yield pd.DataFrame({"toxic": b["toxic"], "e": [evidence(*scan(text, model, seen), model) for text in b["text"]]})

    x = sample.select("text", "toxic").mapInPandas(evident, "toxic boolean, e double").toPandas()
    e, y = x["e"].to_numpy(float), x["toxic"].to_numpy(float)
    w = np.zeros(2)
    m = np.column_stack([e / 10, np.ones(len(e))])
    for _ in range(50):  # Newton's method with a small ridge
        q = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        h = (m * (q * (1 - q))[:, None]).T @ m + 1e-3 * np.eye(2) * max(1, len(e)) / 1000
        step = np.linalg.solve(h, m.T @ (y - q) - 1e-6 * len(e) * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    model.slope, model.intercept = float(max(0.0, w[0]) / 10), float(w[1])
    return model


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, and passages: the significant ones (expected less than once by chance), as word spans with their scores."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, float] = {}
        for b in batches:
            out = []
            for text in b["text"]:
                n, found = scan(text, model, seen)
                z = model.slope * evidence(n, found, model) + model.intercept
                p = 0.0 if z == -math.inf else 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))
                passages = [{"first": a, "last": c, "score": s} for a, c, s in found if evidence(n, [(a, c, s)], model) > 0]
                out.append((p, passages))
            yield pd.DataFrame(out, columns=["score", "passages"], index=b.index).assign(doc_id=ids_of(b))[["doc_id", "score", "passages"]]

    d = docs.select(*id_columns(F.col(id_col)), F.col(text_col).cast("string").alias("text"))
    return d.mapInPandas(run, "doc_id long, score double, passages array<struct<first:long,last:long,score:double>>")
