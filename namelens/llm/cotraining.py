"""Operator 2: quality scores by co-training of a text view and a metadata view.

The text view sees the words: the mean log-odds of a text's words and word pairs
(hashed into BUCKETS, naive Bayes over documents), and shares that describe what
they are like. The metadata view sees what is known around them (source,
language, length, shape of the lines). Each view ends in a logistic regression.

Features are made once for every document. Then, round after round, each view
scores all documents; a histogram of all scores gives the cut-offs beyond which
it is surest, in the labelled share of both classes and a growing share of the
table; and what lies beyond is labelled for the other view. Counts of words are
taken over all rows so labelled. At the end both views are calibrated on
labelled rows kept apart, and their log-odds combined by weights fitted there.

Bounds: at most about max_labelled labelled rows are used, and a regression is
fitted on at most about max_fitted of the rows that the other view has labelled
(chosen by hash); candidates, cut-offs and counts of words cover the whole table.

Defined results: null and empty texts have no words and zero shares; null sources
and languages are values of their own; without labels of both kinds all scores
are 0.5; repeated rows are scored alike; rows that share a doc_id share its
label and are scored by their own text; a null doc_id has no label; equally sure
rows at a cut-off are all labelled; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namelens.llm.common import byte_words, gram_hashes, hash_words, id_columns, ids_of, saved

#: Hashed words and word pairs of the text view; hashed sources and languages.
BUCKETS = 1 << 16
PLACES = 16
#: A histogram of log-odds: its step, and the log-odds at which it ends.
STEP, ENDS = 0.05, 15.0


def text_view(text: str | None) -> tuple[list[float], np.ndarray]:
    """Shares that describe the words of a text, and the buckets of its words and word pairs."""
    h = hash_words(byte_words(text))
    n = len(h)
    if not n:
        return [0.0] * 9, np.zeros(0, np.uint16)
    w = text.split()
    pairs, triples = gram_hashes(h, 2), gram_hashes(h, 3)
    joined = "".join(w)
    shares = [
        math.log1p(sum(joined.count(c) for c in "#*$%&|<>") * 10 / n),
        math.log1p(joined.count("!") * 10 / n),
        sum(map(str.isupper, w)) / n,
        sum(map(str.isalpha, w)) / n,
        len(np.unique(h)) / n,
        float((h[1:] == h[:-1]).sum()) / n,
        min(12.0, len(joined) / n) / 12,
        min(1.0, 10 * sum(joined.count(c) for c in "0123456789") / len(text)),
        min(1.0, len(np.unique(triples)) / max(1, n - 2)),
    ]
    return shares, np.unique(np.concatenate([h, pairs]) % np.uint64(BUCKETS)).astype(np.uint16)


def metadata_view(text: str | None, source: str | None, lang: str | None) -> list[float]:
    """Hashed source and language, and the sizes of the text and its lines."""
    t = text or ""
    lines = t.count("\n") + 1
    one_hot = [0.0] * (2 * PLACES)
    for i, v in enumerate((source, lang)):
        one_hot[i * PLACES + (0 if v is None else 1 + zlib.crc32(v.encode()) % (PLACES - 1))] = 1.0
    size = math.log1p(len(t))
    return [size / 10, size * size / 100, math.log1p(lines) / 5, math.log1p(len(t) / lines) / 8, (math.log1p(len(t) / lines) / 8) ** 2, *one_hot]


@dataclass
class Linear:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def odds(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.clip(z @ self.weights[:-1] + self.weights[-1], -30, 30)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Linear:
    """Logistic regression by Newton's method."""
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale < 1e-9, 1.0, scale)
    m = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(m.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        h = (m * (p * (1 - p))[:, None]).T @ m + np.diag(penalty)
        step = np.linalg.solve(h, m.T @ (y - p) - penalty * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return Linear(mean, scale, w)


class Counts:
    """In how many documents of each class (and each of two folds) a bucket occurs."""

    def __init__(self) -> None:
        self.of = np.zeros((2, 2, BUCKETS + 1), np.int64)  # the last place counts documents

    def add(self, fold: int, y: int, buckets: np.ndarray) -> None:
        self.of[fold, y, buckets] += 1
        self.of[fold, y, BUCKETS] += 1

    def odds(self, without: int | None = None) -> np.ndarray:
        """The log-odds of each bucket, less for rare ones; of the rows outside a fold."""
        c = (self.of.sum(0) if without is None else self.of[1 - without]).astype(float)
        n, seen = c[:, -1:], c[:, :-1]
        p = (seen + 0.5) / (n + 1)
        both = seen.sum(0)
        return ((np.log(p[1]) - np.log(p[0])) * both / (both + 3)).astype(np.float32)


@dataclass
class Model:
    words: np.ndarray
    views: list[Linear]
    calibration: list[tuple[float, float]] = field(default_factory=lambda: [(1.0, 0.0), (1.0, 0.0)])
    combined: np.ndarray = field(default_factory=lambda: np.array([1.0, 1.0, 0.0]))

    def raw(self, f: pd.DataFrame) -> list[np.ndarray]:
        """The log-odds of both views, not yet calibrated."""
        return [v.odds(x) for v, x in zip(self.views, matrices(f, [self.words] * len(f)), strict=True)]

    def scores(self, f: pd.DataFrame) -> list[np.ndarray]:
        """Text, metadata and combined probabilities."""
        odds = [a * o + b for o, (a, b) in zip(self.raw(f), self.calibration, strict=True)]
        both = self.combined[0] * odds[0] + self.combined[1] * odds[1] + self.combined[2]
        return [1 / (1 + np.exp(-np.clip(o, -30, 30))) for o in (*odds, both)]


def buckets_of(f: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(w, np.uint16) for w in f["w"]]


def matrices(f: pd.DataFrame, words: list[np.ndarray]) -> list[np.ndarray]:
    """Features of both views; words: the log-odds of buckets to use for each row."""
    numbers = lambda c, n: np.frombuffer(b"".join(f[c]), np.float32).reshape(-1, n).astype(float)
    mean = [float(w[b].mean()) if len(b) else 0.0 for b, w in zip(buckets_of(f), words, strict=True)]
    return [np.column_stack([numbers("t", 9), np.array(mean, float)]), numbers("m", 5 + 2 * PLACES)]


def slices(batches: Iterator[pd.DataFrame], rows: int = 2000) -> Iterator[pd.DataFrame]:
    """The same rows, fewer at a time."""
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.iloc[at : at + rows]


def fold(key: int) -> int:
    return key & 1


def features(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, key, y (null: none or not known) and the features of every document, written once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 500):  # what leaves Python at a time is bounded by this many texts
                b = whole.iloc[at : at + 500]
                texts = [text_view(x) for x in b["text"]]
                m = [np.array(metadata_view(*r), np.float32).tobytes() for r in zip(b["text"], b["source"], b["lang"], strict=True)]
                t, w = [np.array(x[0], np.float32).tobytes() for x in texts], [x[1].tobytes() for x in texts]
                yield pd.DataFrame({"doc_id": ids_of(b), "key": b["key"], "y": b["y"], "t": t, "m": m, "w": w})

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("text", "source", "lang")])
    d = d.withColumn("key", F.xxhash64("doc_id", "text"))
    # at most about max_labelled rows
    d = d.join(F.broadcast(known), "doc_id", "left") if known is not None else d.withColumn("y", F.lit(None).cast("double"))
    d = d.select(*id_columns(F.col("doc_id")), "text", "source", "lang", "key", "y")
    return saved(d.mapInPandas(run, "doc_id long, key long, y double, t binary, m binary, w binary"), "quality-features")


def histograms(pool: DataFrame, model: Model) -> np.ndarray:
    """How many rows have which log-odds, for both views: a number for each step."""
    size = int(2 * ENDS / STEP)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = np.zeros((2, size), np.int64)
        for b in batches:
            for v, odds in enumerate(model.raw(b)):
                got[v] += np.bincount(np.clip(((odds + ENDS) / STEP).astype(int), 0, size - 1), minlength=size)
        view, at = np.nonzero(got)
        yield pd.DataFrame({"view": view, "at": at, "n": got[view, at]})

    out = np.zeros((2, size), np.int64)
    for r in pool.mapInPandas(count, "view int, at int, n long").groupBy("view", "at").agg(F.sum("n").alias("n")).collect():  # 2 * size rows
        out[r["view"], r["at"]] = r["n"]
    return out


def cut_offs(histogram: np.ndarray, share: float, rate: float, surest: float = 2.2) -> tuple[float, float]:
    """The log-odds below and above which the surest share of rows lies, in the labelled share of classes; odds of 9 to 1 at least."""
    n = histogram.sum()
    low = int(np.searchsorted(np.cumsum(histogram), max(1, n * share * (1 - rate))))
    high = len(histogram) - 1 - int(np.searchsorted(np.cumsum(histogram[::-1]), max(1, n * share * rate)))
    return min(-surest, (low + 1) * STEP - ENDS), max(surest, high * STEP - ENDS)


def exchanged(pool: DataFrame, model: Model, cuts: list[tuple[float, float]], picked: list[float]) -> tuple[Counts, list[pd.DataFrame]]:
    """Counts of words over all rows that the metadata view labels, and a sample (by hash, of shares `picked`) of the rows that each view labels, for the other."""
    limits = [int(p * (1 << 30)) for p in picked]

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = Counts()
        for b in slices(batches):
            for v, odds in enumerate(model.raw(b)):
                sure = (odds < cuts[v][0]) | (odds > cuts[v][1])
                x = b.loc[sure, ["key", "t", "m", "w"]].assign(view=v, label=(odds[sure] > 0).astype(int))
                if v == 1:
                    for key, y, w in zip(x["key"].tolist(), x["label"].tolist(), buckets_of(x), strict=True):
                        counts.add(fold(key), y, w)
                chosen = ((x["key"].to_numpy() >> 7) & ((1 << 30) - 1)) < limits[v]
                yield x[chosen].assign(part=-1, counts=None)
        flat = counts.of.ravel()
        for at in range(0, len(flat), BUCKETS):
            if flat[at : at + BUCKETS].any():
                yield pd.DataFrame({"key": [0], "t": None, "m": None, "w": None, "view": -1, "label": 0, "part": at // BUCKETS, "counts": [flat[at : at + BUCKETS].tobytes()]})

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for at, x in zip(b["part"].tolist(), b["counts"], strict=True):
                sums[at] = sums.get(at, 0) + np.frombuffer(x, np.int64)
        yield pd.DataFrame({"part": list(sums), "counts": [x.tobytes() for x in sums.values()]}, columns=["part", "counts"])

    both = saved(pool.mapInPandas(label, "view int, key long, label int, t binary, m binary, w binary, part int, counts binary"), "quality-exchange")
    counts = Counts()
    flat = counts.of.ravel()
    sums = both.filter("part >= 0").select("part", "counts").repartition("part").mapInPandas(added, "part int, counts binary")
    for r in sums.collect():  # the size of Counts
        x = np.frombuffer(r["counts"], np.int64)
        flat[r["part"] * BUCKETS : r["part"] * BUCKETS + len(x)] = x
    return counts, [both.filter(f"part < 0 and view = {v}").select("key", F.col("label").alias("y"), "t", "m", "w").toPandas() for v in (0, 1)]


def co_train(f: DataFrame, *, rounds: int = 3, share: float = 0.05, max_fitted: int = 2000) -> Model | None:
    """f: features(). Rounds of labelling by both views; in round r each labels share * r of the rows."""
    x = f.filter("y is not null").toPandas()  # at most about max_labelled rows
    apart = np.array([zlib.crc32(str(i).encode()) % 3 == 0 for i in x["doc_id"]], bool)
    y = x["y"].to_numpy(float)
    if len(set(y[~apart])) < 2 or len(set(y[apart])) < 2:
        return None
    pool = f.filter("y is null")
    base, rate = x[~apart], y[~apart].mean()
    extra, more = Counts(), [base.iloc[:0], base.iloc[:0]]
    for r in range(rounds + 1):
        counts = Counts()
        for key, label, w in zip(base["key"].tolist(), y[~apart].astype(int).tolist(), buckets_of(base), strict=True):
            counts.add(fold(key), label, w)
        counts.of += extra.of
        # rows are seen through word odds of the other fold, which they are not part of
        halves = [counts.odds(0), counts.odds(1)]
        views = []
        for v in (0, 1):
            rows = pd.concat([base, more[v]]) if len(more[v]) else base
            views.append(fit(matrices(rows, [halves[fold(k)] for k in rows["key"].tolist()])[v], rows["y"].to_numpy(float)))
        model = Model(counts.odds(), views)
        if r == rounds:
            break
        seen = histograms(pool, model)
        if not seen.any():
            continue
        cuts = [cut_offs(h, share * (r + 1), rate) for h in seen]
        centres = (np.arange(seen.shape[1]) + 0.5) * STEP - ENDS
        found = [seen[v][(centres < lo) | (centres > hi)].sum() for v, (lo, hi) in enumerate(cuts)]
        extra, labelled = exchanged(pool, model, cuts, [min(1.0, max_fitted / max(1, n)) for n in found])
        more = [labelled[1], labelled[0]]
    raw = model.raw(x[apart])
    model.calibration = []
    for o in raw:
        c = fit(o[:, None], y[apart], ridge=0.1)
        a = max(0.0, float(c.weights[0] / c.scale[0]))
        model.calibration.append((a, float(c.weights[1] - c.weights[0] / c.scale[0] * c.mean[0]) if a else float(c.weights[1])))
    odds = np.column_stack([a * o + b for o, (a, b) in zip(raw, model.calibration, strict=True)])
    c = fit(odds, y[apart], ridge=1.0)
    w = np.maximum(c.weights[:2] / c.scale, 0)
    model.combined = np.array([*w, c.weights[2] - (w * c.mean).sum()])
    return model


def quality(docs: DataFrame, labels: DataFrame, *, max_labelled: int = 4000, threshold: float = 0.5, **params) -> DataFrame:
    """doc_id, text_score, metadata_score, score and kept of every document. docs: doc_id, text, source, lang; labels: doc_id, quality."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") > 0).cast("double").alias("y"))
    part = min(1.0, max_labelled / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < int(part * (1 << 30)))
    f = features(docs, known)
    model = co_train(f, **params)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            t, m, s = [np.full(len(b), 0.5)] * 3 if model is None or b.empty else model.scores(b)
            yield pd.DataFrame({"doc_id": ids_of(b), "text_score": t, "metadata_score": m, "score": s, "kept": s >= threshold})

    return f.select(*id_columns(F.col("doc_id")), "t", "m", "w").mapInPandas(run, "doc_id long, text_score double, metadata_score double, score double, kept boolean")
