"""Operator 10: document fingerprints of closed syncmers, in DataFrame expressions only.

The letters are words. A run of five words holds four runs of two; it is chosen
if the least hash of these four is the first or the last (a closed syncmer). The
choice depends on the run alone, so equal passages choose equal anchors wherever
they stand. The fingerprint keeps every anchor, each with its first place, where
`size` is None, as in the query; a number makes a sketch of the `size` least
hashes. Likeness is the share of the hashes of both (of the `size` least: the
bottom-k estimate of the Jaccard similarity) that both have, at places whose
distance lies near the median of their distances. Work per text is in proportion
to its words, but for sorting.

Defined results: null texts are empty; texts without an anchor (under five
words, or none chosen) have one anchor, the hash of the whole text; rows with
equal ids come in order of a hash of the text; a null doc_id comes first; a
single document is its own next; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namelens.llm.common import words_col

K, S = 5, 2
_ALL = 1 << 30


def with_anchors(df: DataFrame, text: str, prefix: str, size: int | None = 64) -> DataFrame:
    """df with prefix_h (least anchor hashes, ascending) and prefix_p (first place of each), of a text column without nulls."""
    n, after = F.size("__h"), lambda c, by: F.slice(c, by + 1, _ALL)
    d = df.withColumn("__h", F.transform(words_col(F.col(text)), lambda x: F.xxhash64(x)))
    d = d.withColumn("__s", F.zip_with("__h", after("__h", 1), lambda a, b: F.xxhash64(a, b)))
    # zip_with fills the shorter array with nulls, so the ends of these arrays mean nothing; only the first n - 4 places are read
    d = d.withColumn("__m", F.zip_with("__s", after("__s", 1), lambda a, b: F.least(a, b)))
    d = d.withColumn("__m", F.zip_with("__m", after("__m", 2), lambda a, b: F.least(a, b)))
    # the run's hash covers all five words: the first two, the third, the last two
    d = d.withColumn("__k", F.zip_with("__s", after("__h", 2), lambda a, b: F.xxhash64(a, b)))
    last = after("__s", K - S)
    edge, whole = F.zip_with("__s", last, lambda a, b: F.least(a, b)), F.zip_with("__k", last, lambda a, b: F.xxhash64(a, b))
    d = d.withColumns({"__c": F.zip_with("__m", edge, lambda m, e: m == e), "__k": whole})
    d = d.withColumn("__k", F.when(n >= K, F.slice(F.zip_with("__c", "__k", lambda c, x: F.when(c, x)), F.lit(1), F.greatest(n - (K - 1), F.lit(0)))))
    # sorted by hash and place, of equal hashes the first: no search for each hash's place
    found = F.transform(F.coalesce("__k", F.array().cast("array<long>")), lambda v, i: F.struct(v.alias("h"), i.cast("int").alias("p")))
    d = d.withColumn("__a", F.sort_array(F.filter(found, lambda x: x["h"].isNotNull())))
    firsts = F.filter("__a", lambda x, i: (i == 0) | (x["h"] != F.get("__a", i - 1)["h"]))
    d = d.withColumn("__a", firsts if size is None else F.slice(firsts, 1, size))
    none = F.size("__a") == 0
    d = d.withColumn(f"{prefix}_p", F.when(none, F.array(F.lit(0))).otherwise(F.col("__a")["p"]))
    d = d.withColumn(f"{prefix}_h", F.when(none, F.array(F.xxhash64(F.lit("whole"), F.col(text)))).otherwise(F.col("__a")["h"]))
    return d.drop("__h", "__s", "__m", "__c", "__k", "__a")


def shown(prefix: str) -> Column:
    """The fingerprint as text: hash in hexadecimal, @, place."""
    return F.array_join(F.zip_with(f"{prefix}_h", f"{prefix}_p", lambda h, p: F.concat(F.lower(F.hex(h)), F.lit("@"), p.cast("string"))), " ")


def with_likeness(df: DataFrame, a: str, b: str, name: str, size: int | None = 64, slack: int = 16) -> DataFrame:
    """df with the likeness (0 to 1) of the fingerprints a and b."""
    side = lambda p, k: F.zip_with(f"{p}_h", f"{p}_p", lambda h, at: F.struct(h.alias("h"), F.lit(k).alias("k"), at.alias("p")))
    # in order of hash, so that a hash of both stands twice: a's place, then b's
    d = df.withColumn("__u", F.sort_array(F.concat(side(a, 0), side(b, 1))))
    before, then = lambda i: F.get("__u", i - 1), lambda i: F.get("__u", i + 1)
    merged = F.transform(
        "__u", lambda x, i: F.struct(before(i)["h"].eqNullSafe(x["h"]).alias("again"), F.when(then(i)["h"] == x["h"], then(i)["p"] - x["p"]).alias("d"))
    )
    union = F.filter(merged, lambda x: ~x["again"])
    d = d.withColumn("__u", union if size is None else F.slice(union, 1, size))
    d = d.withColumn("__d", F.sort_array(F.array_compact(F.col("__u")["d"])))
    d = d.withColumn("__mid", F.get("__d", F.floor(F.size("__d") / 2).cast("int")))
    near = F.size(F.filter("__d", lambda x: F.abs(x - F.col("__mid")) <= slack))
    d = d.withColumn(name, F.when(F.size("__u") > 0, F.greatest(near, F.lit(0)) / F.size("__u")).otherwise(F.lit(0.0)))
    return d.drop("__u", "__d", "__mid")


def id_ranges(ids: DataFrame, most: int = 1024) -> Column:
    """A number that does not fall as the id (first column, long) rises; null ids are -1.

    Ids are dealt at quantiles into up to `most` ranges, and these by equal widths
    into as many as make about the square root of the number of rows in all.
    """
    name = ids.columns[0]
    n = ids.count()
    wanted = max(1, math.isqrt(n))
    parts = min(wanted, most)
    lows = ids.agg(F.percentile_approx(name, [i / parts for i in range(parts)], 20 * most)).first()[0] or [0]
    lows = sorted(set(lows))
    widths = [float(max(1, b - a)) for a, b in zip(lows, lows[1:], strict=False)] + [float(max(1, (ids.agg(F.max(name)).first()[0] or 0) - lows[-1] + 1))]
    at, starts = F.col(name), F.lit(np.array(lows, np.int64))
    # binary search for the last start that is not beyond the id
    steps = F.array(*[F.lit(1 << j) for j in reversed(range(max(1, len(lows).bit_length())))])
    i = F.aggregate(steps, F.lit(0), lambda acc, step: F.when((acc + step < len(lows)) & (F.get(starts, acc + step) <= at), acc + step).otherwise(acc))
    sub = -(-wanted // len(lows))
    within = (at.cast("double") - F.get(starts, i).cast("double")) / F.get(F.lit(np.array(widths)), i) * sub
    return F.when(at.isNull(), F.lit(-1)).otherwise(i * sub + F.greatest(F.lit(0), F.least(F.lit(sub - 1), F.floor(within)))).cast("long")


def edited_pairs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int | None = 64) -> DataFrame:
    """doc_id, text, anchors t, next_text and anchors n of the next document in order of doc_id (after the last: the first).

    Ids are dealt into ranges; a window holds one range, and a range's last
    document meets the first of the next range.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    d = d.withColumns({"range": id_ranges(d.select("doc_id")), "text_hash": F.xxhash64("text")})
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_hash").asc()]
    w = Window.partitionBy("range").orderBy(*order)
    following = F.struct(F.col("text").alias("text"), F.col("t_h").alias("h"), F.col("t_p").alias("p"))
    firsts = d.groupBy("range").agg(F.min_by("text", F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))), "text_hash")).alias("text"))
    # one row per range, with the range before it
    every = Window.orderBy("range")
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbers = d.select("range").distinct().withColumn("before", F.coalesce(F.lag("range").over(every), F.max("range").over(whole)))
    firsts = with_anchors(firsts, "text", "f", size).join(numbers, "range")
    firsts = firsts.select(F.col("before").alias("range"), F.struct("text", F.col("f_h").alias("h"), F.col("f_p").alias("p")).alias("first"))
    # texts alone are shuffled and sorted: their anchors are computed where the window reads them
    d = d.repartition("range").sortWithinPartitions("range", *order)
    d = with_anchors(d, "text", "t", size).withColumn("following", F.lead(following).over(w))
    d = d.join(firsts, "range", "left").withColumn("following", F.coalesce("following", "first"))
    return d.select("doc_id", "text", "t_h", "t_p", F.col("following.text").alias("next_text"), F.col("following.h").alias("n_h"), F.col("following.p").alias("n_p"))


def edited_fingerprints(docs: DataFrame, *, size: int | None = 64, **cols) -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likeness and that to the next document."""
    d = edited_pairs(docs, size=size, **cols).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half))
    d = d.withColumn("edited", edited).drop("text", "next_text")
    d = with_anchors(d, "edited", "e", size)
    d = with_likeness(with_likeness(d, "t", "e", "near_edited", size), "t", "n", "near_next", size)
    return d.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), shown("t").alias("fingerprint"), shown("e").alias("edited_fingerprint"), "near_edited", "near_next")
