"""Operator 5: mix sources to target weights along a low-discrepancy schedule.

Slot i of the schedule is the point frac((i + 1) / golden ratio); the point falls
into one source's share of the cumulative targets. The slots of a source are
ranked; slot r takes block r (modulo their number, then again) of the source's
equal blocks of words, cut from its documents in shuffled (MD5) order. So any
prefix of the schedule has the target mix to within a few blocks.

No step gathers a source: running totals go through buckets of about the square
root of the rows, within which rows are ranked, and the buckets' sums.

Defined results: null and blank texts have size 0 and nothing is taken of them; a
null source is a source of its own, last in order; rows with equal ids and texts
share one place in the order; an empty table gives an empty mix; other columns
are kept out of the way.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from namelens.llm.common import saved, words_col

#: Points are integers below 2^31; the step is 2^31 / golden ratio, rounded to an odd number.
POINTS = 1 << 31
GOLDEN = 1327217885
#: One row per source goes to the driver.
MAX_SOURCES = 100_000


@dataclass
class Share:
    source: str | None
    size: int
    weight: float
    target: float
    low: int = 0
    high: int = 0


def water_fill(sizes: list[tuple[str | None, int]], weights: list[float], total: float, most: float) -> list[Share]:
    """Targets in proportion to weights that sum to total, none above most times its size.

    Sources in order of most * size / weight reach their limit one after the other;
    the rest share what is left in proportion.
    """
    out = [Share(s, n, w, 0.0) for (s, n), w in zip(sizes, weights, strict=True)]
    left, weight = total, float(sum(weights))
    for x in sorted(out, key=lambda x: (most * x.size / x.weight, x.weight)):
        level = left / weight if weight > 0 else 0.0
        if most * x.size <= level * x.weight:
            x.target = most * x.size
            left, weight = left - x.target, weight - x.weight
        else:
            x.target = level * x.weight
    return out


def by_code_point(sizes: list[tuple[str | None, int]]) -> list[tuple[str | None, int]]:
    return sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))


def running_total(df: DataFrame, keys: list[str], order: list[str], bucket: str, value: Column, name: str) -> DataFrame:
    """df with the sum of value over earlier rows of the same keys, in order of bucket, then order.

    A window over rows holds one bucket; a window over the buckets' sums holds one row per bucket.
    """
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    within = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, bucket]]
    joined = rows.alias("a").join(sums.alias("b"), on, "left")
    return joined.select("a.*", (F.col("_before") + F.col("_within")).alias(name)).drop("_within")


def source_at(highs: list[int], point: Column) -> Column:
    """How many of the ascending highs are at most point, by binary search.

    A Python function would be in the plan twice in a row, as the join by its result filters
    by it too: each task would hold two workers, which stay with the executor.
    """
    held = F.split(F.lit(",".join(map(str, highs or [POINTS]))), ",").cast("array<bigint>")  # folded into one literal
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(highs).bit_length() or 1))])
    # beyond the last one get() is null, so the step is not taken
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(held, n + step - 1) <= point, n + step).otherwise(n)).cast("long")


def local_table(spark: SparkSession, **columns: pa.Array) -> DataFrame:
    """A small table made on the driver, through Arrow: of plain rows Spark makes an RDD that starts Python workers of its own on every executor."""
    return spark.createDataFrame(pa.table(columns))


def schedule(spark: SparkSession, shares: list[Share], slots: int, *, slots_per_bucket: int | None = None) -> DataFrame:
    """slot, source_no (index into shares) and rank (from 0, within the source) of every slot."""
    size = slots_per_bucket or max(1, math.isqrt(slots))
    s = spark.range(slots).withColumnRenamed("id", "slot")
    s = s.withColumn("point", F.pmod(F.pmod(F.col("slot") + 1, F.lit(POINTS)) * F.lit(GOLDEN), F.lit(POINTS)))
    s = s.select("slot", source_at([x.high for x in shares], F.col("point")).alias("source_no"), F.floor(F.col("slot") / size).alias("slot_bucket"))
    s = running_total(s, ["source_no"], ["slot"], "slot_bucket", F.lit(1), "rank")
    return s.select("slot", "source_no", "rank")


def plan_shares(sizes: list[tuple[str | None, int]], *, weights: tuple[float, ...], share: float, most: float) -> list[Share]:
    sizes = by_code_point(sizes)
    shares = water_fill(sizes, [float(weights[i % len(weights)]) for i in range(len(sizes))], share * sum(n for _, n in sizes), most)
    total, cum, low = sum(x.target for x in shares), 0.0, 0
    for x in shares:
        cum += x.target
        x.low, low = low, min(POINTS, round(cum / total * POINTS)) if total else 0
        x.high = low
    if shares and total:
        last = max(i for i, x in enumerate(shares) if x.target > 0)
        for x in shares[last:]:
            x.high = POINTS
    return shares


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
    block_words: int = 2048, least_slots: int = 200_000,
    keep: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame, list[Share]]:
    """(rows, pieces, shares).

    rows: row_id, doc_id, source, size and the columns in keep of every document.
    pieces: row_id, start (word offset in the document), length and times of each
    part of a document that lies in one block and is taken. A block has block_words
    words, or fewer in a small mix so that there are least_slots slots.
    """
    spark = docs.sparkSession
    d = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.size(words_col(F.col(text_col))).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("shuffled"),
        F.monotonically_increasing_id().alias("row_id"),
        *keep,
    )
    base = saved(d, "mix-sizes")
    d = base.drop(*keep)
    sizes = [(r["source"], r["n"]) for r in d.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()]
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    shares = plan_shares(sizes, weights=weights, share=share, most=most)
    total = sum(x.target for x in shares)
    block = max(1, min(block_words, int(total // least_slots)))
    # a multiple of the buckets' number, in hexadecimal digits of the shuffle key
    rows = d.count()
    digits = max(1, math.ceil(math.log(max(2, math.isqrt(max(1, rows)))) / math.log(16)))
    d = d.withColumn("bucket", F.substring("shuffled", 1, digits))
    d = running_total(d, ["source"], ["shuffled", "doc_id", "size", "row_id"], "bucket", F.col("size"), "start")

    numbers = local_table(spark, source_no=pa.array(range(len(shares)), pa.int64()), source=pa.array([x.source for x in shares], pa.string()), blocks=pa.array([-(-x.size // block) for x in shares], pa.int64()))
    numbers = F.broadcast(numbers)
    slots = schedule(spark, shares, math.ceil(total / block))
    took = slots.join(numbers.select("source_no", "blocks"), "source_no")
    # what a whole number of passes over the source may take
    took = took.filter((F.col("blocks") > 0) & (F.col("rank") < F.floor(F.col("blocks") * F.lit(float(most)))))
    took = took.groupBy("source_no", F.pmod("rank", "blocks").alias("block")).agg(F.count("*").alias("times"))

    parts = d.join(numbers.select("source_no", "source"), d["source"].eqNullSafe(numbers["source"])).filter("size > 0").drop(numbers["source"])
    b = F.lit(block)
    parts = parts.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))))
    low = F.greatest(F.col("start"), F.col("block") * b)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b)
    parts = parts.select("row_id", "source_no", "block", (low - F.col("start")).alias("at"), (high - low).alias("length"))
    pieces = parts.join(took, ["source_no", "block"]).select("row_id", F.col("at").alias("start"), "length", "times")
    return base, pieces, shares


def taken_words(docs: DataFrame, **params) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    rows, pieces, shares = mix(docs, **params)
    taken = pieces.groupBy("row_id").agg(F.sum(F.col("length") * F.col("times")).alias("taken"))
    n = local_table(docs.sparkSession, of=pa.array([x.source for x in shares], pa.string()), source_size=pa.array([x.size for x in shares], pa.int64()), target=pa.array([x.target for x in shares], pa.float64()))
    n = F.broadcast(n)
    out = rows.select("row_id", "doc_id", "source", "size").join(taken, "row_id", "left").join(n, F.col("source").eqNullSafe(F.col("of")), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **params) -> DataFrame:
    """The mix as documents: a row for each taken run of blocks of a document and pass over its source.

    Columns: those of docs; the text holds the taken words, joined by one space
    unless all are taken (then it is unchanged), n_chars is its length if docs has it.
    """
    text_col = params.get("text_col", "text")
    names = docs.columns
    flat = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    at = {c: f"c{i}" for i, c in enumerate(names)}
    cols = {k: at[params.get(k, v)] for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}
    rows, pieces, _ = mix(flat, **{**params, **cols}, keep=tuple(flat.columns))
    # per document: for each pass, the runs of words taken; a document has few passes (most) and adjacent parts are merged
    passes = pieces.withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    runs = passes.groupBy("row_id", "pass").agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("parts"), F.sum("length").alias("n_taken"))
    words = words_col(F.col(at[text_col]))
    out = rows.join(runs, "row_id")
    out = out.withColumn("w", F.when(F.col("n_taken") < F.col("size"), words))
    cut = F.array_join(F.flatten(F.transform("parts", lambda p: F.slice(F.col("w"), (p["start"] + 1).cast("int"), p["length"].cast("int")))), " ")
    text = F.when(F.col("n_taken") < F.col("size"), cut).otherwise(F.col(at[text_col]))
    out = out.withColumn("mixed", text)
    return out.select(*[(F.col("mixed") if c == text_col else F.length("mixed").cast(docs.schema[c].dataType) if c == "n_chars" else F.col(at[c])).alias(c) for c in names])
