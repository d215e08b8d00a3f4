"""Operator 1: a learned decision list over quality statistics, in DataFrame expressions only.

Sequential covering learns rules "reject if f1 > a and f2 <= b ...": each rule
grows one threshold condition at a time by FOIL gain over per-threshold counts
of labelled rows, is pruned on rows kept apart, and takes the rows it covers
away. The counts come from Spark aggregations; only these counts (features x
thresholds) reach the driver. The list becomes one CASE WHEN over all rows.

Defined results: null and empty texts have zero counts and fail the base rule;
repeated documents are judged alike; without labels the list is empty and only
the base rule rejects; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namelens.llm.common import SPACE, saved, words_col

WINDOW = 5
_ALL = 1 << 30
#: The statistics that rules may test, as expressions over the columns of statistics().
FEATURES = {
    "mean_word": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "bangs_per_word": "n_bangs / n_words",
    "dup_line_share": "n_dup_lines / n_lines",
    "repeat_share": "n_repeat_words / n_words",
    "distinct_share": "n_distinct_words / n_words",
    "log_words": "log2(n_words + 1D)",
}


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and the counts of each text. keep: columns of docs that come along as __keep0, __keep1 ...

    Repeated five-word windows are found by their 64-bit hashes within one text.
    Texts without one (most) leave after one hash-set pass; the others sort
    (hash, position) pairs, so that no text costs more than n log n.
    """
    text = F.col("text")
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), words_col(F.col(text_col)).alias("w"), *[F.col(f"`{c}`").alias(f"__keep{i}") for i, c in enumerate(keep)])
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    d = d.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long").alias("n_bangs"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct_words"),
        lines.alias("lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
        *[f"__keep{i}" for i in range(len(keep))],
    )
    # hashes of 2, 4 and then 5 words from the word hashes; the last WINDOW - 1 are cut off
    d = d.withColumn("h2", F.zip_with("h", F.slice("h", 2, _ALL), lambda a, b: F.xxhash64(a, b)))
    d = d.withColumn("h4", F.zip_with("h2", F.slice("h2", 3, _ALL), lambda a, b: F.xxhash64(a, b))).drop("h2")
    d = d.withColumn(
        "grams",
        F.when(
            F.size("h") >= WINDOW,
            F.zip_with(F.slice("h4", F.lit(1), F.size("h") - (WINDOW - 1)), F.slice("h", WINDOW, _ALL), lambda a, b: F.xxhash64(a, b)),
        ).otherwise(F.array().cast("array<long>")),
    ).drop("h", "h4")
    d = d.withColumns(
        {
            "n_lines": F.size("lines").cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "pairs": F.when(
                F.size(F.array_distinct("grams")) < F.size("grams"),
                F.sort_array(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            ),
        }
    ).drop("lines", "grams")
    # of the sorted pairs, those whose hash is also the next one's or the previous one's
    as_next = F.zip_with("pairs", F.slice("pairs", 2, _ALL), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
    d = d.withColumn("as_next", as_next)
    d = d.withColumn("as_previous", F.concat(F.array(F.lit(False)), F.slice("as_next", F.lit(1), F.greatest(F.size("as_next") - 1, F.lit(0)))))
    d = d.withColumn("twice", F.zip_with("as_next", "as_previous", lambda a, b: a | b)).drop("as_next", "as_previous")
    at = F.sort_array(F.array_compact(F.zip_with("pairs", "twice", lambda x, f: F.when(f, x["i"]))))
    d = d.withColumn("at", at).drop("pairs", "twice")
    steps = F.zip_with("at", F.slice("at", 2, _ALL), lambda p, q: F.least(F.lit(WINDOW), F.coalesce(q - p, F.lit(WINDOW))))
    covered = F.aggregate(steps, F.lit(0), lambda a, x: a + x)
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("at")


def base_failed() -> Column:
    """The base rule: under ten words, or over a fifth of the words in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def features() -> dict[str, Column]:
    """Values of FEATURES; 0 where a denominator is 0."""
    return {k: F.coalesce(F.expr("try_divide(" + v.replace(" / ", ", ") + ")" if " / " in v else v).cast("double"), F.lit(0.0)) for k, v in FEATURES.items()}


@dataclass
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = features()[self.feature]
        return c > self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass
class Rule:
    """Rejects where all conditions hold. good/bad: rows kept apart that it covers."""

    conditions: list[Condition] = field(default_factory=list)
    bad: int = 0
    good: int = 0

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out


def rejected(rules: list[Rule]) -> Column:
    """The ordered list as one conditional expression; rows that no rule covers are not rejected."""
    out = None
    for r in rules:
        out = (F if out is None else out).when(r.column(), F.lit(True))
    return F.lit(False) if out is None else out.otherwise(F.lit(False))


def _foil(bad: float, good: float, bad0: float, good0: float) -> float:
    if bad == 0 or bad0 == 0:
        return 0.0
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad0 / (bad0 + good0)))


def _below(name: str):
    return lambda cut: cut < F.col(name)


def learn(
    labelled: DataFrame, *, bins: int = 24, max_rules: int = 8, max_conditions: int = 3,
    min_precision: float = 0.97, min_covered: int = 5,
) -> list[Rule]:
    """labelled: columns of statistics(), plus good (boolean, not null). All of its rows are used.

    A rule is kept if, of the held-apart rows that it covers, min_precision are bad
    and at least min_covered (fewer if there are few bad rows) are.
    """
    x = labelled.select((~F.col("good")).cast("int").alias("bad"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("apart"), *[c.alias(k) for k, c in features().items()])
    x = saved(x.coalesce(4), "rules-sample").cache()
    try:
        probs = [i / bins for i in range(1, bins)]
        # quantiles of each class, so that thresholds between a rare class and the other exist
        q = x.groupBy("bad").agg(*[F.percentile_approx(k, probs, 1000).alias(k) for k in FEATURES]).collect()
        values = {k: sorted({float(v) for r in q for v in (r[k] or [])}) for k in FEATURES}
        # halfway between neighbours, so that a rule leaves room beside the rows it was learned from
        cuts = {k: [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)] for k, v in values.items()}
        # the bin of a value: how many cuts lie below it
        bin_of = [F.struct(F.lit(k).alias("f"), F.size(F.filter(F.array(*map(F.lit, v)), _below(k))).alias("b")) for k, v in cuts.items() if v]
        if not bin_of or len(q) < 2:
            return []
        rules: list[Rule] = []
        over = {k: c for k, c in ((k, F.col(k)) for k in FEATURES)}
        as_col = lambda c: over[c.feature] > c.threshold if c.above else over[c.feature] <= c.threshold
        left = F.lit(True)
        while len(rules) < max_rules:
            conditions: list[Condition] = []
            held = left
            while len(conditions) < max_conditions:
                rows = x.filter(~F.col("apart") & held).select("bad", F.explode(F.array(*bin_of)).alias("s")).groupBy("s.f", "s.b").agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good")).collect()
                by: dict[str, dict[int, tuple[int, int]]] = {}
                for r in rows:
                    by.setdefault(r["f"], {})[r["b"]] = (r["bad"], r["good"])
                if not by:
                    break
                bad0, good0 = map(sum, zip(*next(iter(by.values())).values(), strict=True))
                if bad0 == 0 or good0 == 0:
                    break
                best = (1e-9, None)
                for k in FEATURES:
                    low_bad = low_good = 0
                    for b, t in enumerate(cuts.get(k, [])):
                        p, n = by.get(k, {}).get(b, (0, 0))
                        low_bad, low_good = low_bad + p, low_good + n
                        for above, p, n in ((False, low_bad, low_good), (True, bad0 - low_bad, good0 - low_good)):
                            if (gain := _foil(p, n, bad0, good0)) > best[0]:
                                best = (gain, Condition(k, above, t))
                if best[1] is None:
                    break
                conditions.append(best[1])
                held = held & as_col(best[1])
            if not conditions:
                break
            # pruning: the shortest prefix with the best (bad - good) / (bad + good) on the rows kept apart
            ends, held = [], F.lit(True)
            for c in conditions:
                held = held & as_col(c)
                ends.append(held)
            got = x.filter(F.col("apart") & left).agg(*[F.sum(F.when(e, b)).alias(f"{n}{i}") for i, e in enumerate(ends) for n, b in (("b", F.col("bad")), ("g", 1 - F.col("bad")))], F.sum("bad").alias("all_bad")).first()
            n = lambda k, got=got: got[k] or 0
            i = max(range(len(ends)), key=lambda i: ((n(f"b{i}") - n(f"g{i}")) / max(1, n(f"b{i}") + n(f"g{i}")), n(f"b{i}"), -i))
            bad, good = n(f"b{i}"), n(f"g{i}")
            if bad < max(1, min(min_covered, n("all_bad") // 4)) or bad < min_precision * (bad + good):
                break
            rules.append(Rule(conditions[: i + 1], bad, good))
            left = left & ~ends[i]
        return rules
    finally:
        x.unpersist()


def labelled_statistics(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> DataFrame:
    """Statistics of the labelled rows: all of them, or about max_labelled chosen by hash.

    max_labelled is the documented bound of the training sample; its ids are broadcast.
    """
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    n = known.count()
    if n > max_labelled:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < int(max_labelled / n * (1 << 30)))
    chosen = statistics(docs.join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")).join(F.broadcast(known), "doc_id")
    # written: a filter on a statistic would otherwise be pushed below the arrays it is made of, and make them anew
    return saved(chosen, "labelled-statistics")


def quality_rules(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = (), **params) -> DataFrame:
    """Statistics of every document with base_failed and kept. keep: as in statistics()."""
    rules = learn(labelled_statistics(docs, labels).filter(~base_failed()), **params)
    out = statistics(docs, keep=keep).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & ~rejected(rules))


def kept_documents(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    names = docs.columns
    out = quality_rules(docs, labels, keep=tuple(names), **params)
    # the number in the filter keeps Spark from pushing it below the arrays that the statistics are made of
    out = out.withColumn("__row", F.monotonically_increasing_id()).filter(F.col("kept") & (F.col("__row") >= 0))
    return out.select(*[F.col(f"__keep{i}").alias(c) for i, c in enumerate(names)])
