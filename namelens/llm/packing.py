"""Operator 9: best-fit packing by a grouping genetic algorithm on islands.

Documents become token ids plus an end token; those longer than a sequence are
cut into full pieces, the first of which may be shorter. Full pieces are
sequences of their own. The others are dealt into blocks, and each block is
packed by a few islands. An individual of an island is a list of bins (groups).
Crossover injects the best-filled bins of one parent into the other, drops the
bins that hold a duplicate, and puts the displaced pieces back best fit first.
Between epochs each island sends its elite to the next one of its block. At the
end, bins of the best individual that are not well filled are dissolved, and
their pieces are packed again together with those of other blocks.

Defined results: null texts count as empty and give the end token alone; rows
with equal ids and texts are packed each on its own; an empty table gives no
rows; other columns are ignored. A block, not the corpus, is in memory.
"""

from __future__ import annotations

import bisect
import json
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from namelens.llm.common import id_columns, ids_of, saved, trimmed

CAPACITY = 2048
_ENCODERS: dict = {}


def encoder(path: str):
    """text -> ids of the byte-level BPE in a tokenizers file, without special tokens.

    The vocabulary is run by tiktoken, several times as fast and with the same ids;
    texts that spell a special token go through the tokenizers library itself.
    """
    if path not in _ENCODERS:
        import tiktoken

        spec = json.loads(open(path, encoding="utf-8").read())
        special = [x["content"] for x in spec.get("added_tokens", [])]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(shown[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        # the splitting rule of byte-level BPE; a fixed value
        split = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        fast = tiktoken.Encoding("from-file", pat_str=split, mergeable_ranks=ranks, special_tokens={})
        slow: list = []  # read when the first such text comes

        def encode(text: str) -> list[int]:
            if any(s in text for s in special):
                if not slow:
                    from tokenizers import Tokenizer

                    slow.append(Tokenizer.from_file(path))
                return slow[0].encode(text, add_special_tokens=False).ids
            return fast.encode_ordinary(text)

        _ENCODERS[path] = encode
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        for b in batches:
            out = []
            for doc, none, text in zip(b["doc"].tolist(), b["doc_null"], b["text"], strict=True):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                at, first = 0, len(ids) % capacity or capacity
                for k in range(-(-len(ids) // capacity)):
                    to = first if k == 0 else at + capacity
                    out.append((doc, none, k, at, to - at, zlib.crc32(ids[at:to].tobytes())))
                    at = to
            x = pd.DataFrame(out, columns=["doc", "doc_null", "piece", "start", "length", "ids_crc32"])
            yield x.assign(doc_id=ids_of(x))[["doc_id", "piece", "start", "length", "ids_crc32"]]

    d = docs.select(*id_columns(F.col(id_col)), F.col(text_col).cast("string").alias("text"))
    return d.mapInPandas(trimmed(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(bins: list[list[int]], fill: list[int], items: list[int], size: list[int], capacity: int) -> None:
    """Puts items, largest first, each into the fullest bin that has room, in place."""
    room = sorted((capacity - f, i) for i, f in enumerate(fill) if f < capacity)
    for x in sorted(items, key=lambda x: -size[x]):
        k = bisect.bisect_left(room, (size[x], -1))
        if k < len(room):
            left, i = room.pop(k)
            bins[i].append(x)
            fill[i] += size[x]
            if left > size[x]:
                bisect.insort(room, (left - size[x], i))
        else:
            bins.append([x])
            fill.append(size[x])
            if size[x] < capacity:
                bisect.insort(room, (capacity - size[x], len(bins) - 1))


def lower_bound(size: list[int], capacity: int) -> int:
    """No packing has fewer bins (Martello and Toth's L2): for each k, items over capacity - k are alone, items over half are apart, and those of k to half go beside the latter."""
    x = np.sort(np.array(size, np.int64))
    if not len(x):
        return 0
    sums = np.concatenate([[0], np.cumsum(x)])
    upto = lambda v: np.searchsorted(x, v, "right")
    half = upto(capacity // 2)
    k = np.unique(np.concatenate([[0], x[:half]]))
    alone, low = upto(capacity - k), np.searchsorted(x, k, "left")
    apart = len(x) - half
    room = (alone - half) * capacity - (sums[alone] - sums[half])
    beside = np.maximum(0, -(-(sums[half] - sums[np.minimum(low, half)] - room) // capacity))
    return int((apart + beside).max())


Packing = tuple[list[list[int]], list[int]]  # bins and their fills


def fitness(fill: list[int], capacity: int) -> float:
    """Mean squared fill: more for fewer and more unevenly filled bins."""
    return sum((f / capacity) ** 2 for f in fill) / max(1, len(fill))


def swap_in(bins: list[list[int]], fill: list[int], loose: list[int], size: list[int], capacity: int) -> list[int]:
    """Replaces one or two pieces of a bin by a loose one that fills it better, in place; returns what is loose then (Martello and Toth's dominance)."""
    left = sorted((size[x], x) for x in loose)
    for g, items in enumerate(bins):
        space = capacity - fill[g]
        if not space or not left:
            continue
        best = None
        for i, x in enumerate(items):
            for j in range(i, len(items)):
                out = size[x] + (size[items[j]] if j > i else 0)
                k = bisect.bisect_right(left, (out + space, 1 << 62)) - 1
                if k >= 0 and (gain := left[k][0] - out) > 0 and (best is None or gain > best[0]):
                    best = (gain, i, j, k)
        if best:
            gain, i, j, k = best
            new = left.pop(k)[1]
            gone = {i, j}
            for v in gone:
                bisect.insort(left, (size[items[v]], items[v]))
            bins[g] = [x for v, x in enumerate(items) if v not in gone] + [new]
            fill[g] += gain
    return [x for _, x in left]


def cross(a: Packing, b: Packing, size: list[int], capacity: int, rng: random.Random) -> Packing:
    """b with well-filled bins of a injected: bins of b that share a piece with them go, the pieces displaced go in by swaps and then best fit."""
    ranked = sorted(range(len(a[0])), key=lambda g: (-a[1][g], rng.random()))
    n = max(1, int(len(ranked) * (0.1 + 0.4 * rng.random())))
    taken = ranked[:n]
    inside = {x for g in taken for x in a[0][g]}
    kept = [g for g in range(len(b[0])) if inside.isdisjoint(b[0][g])]
    # the worst of the bins kept are opened too, so that displaced pieces find partners
    kept.sort(key=lambda g: -b[1][g])
    kept = kept[: len(kept) - max(1, len(kept) // 20)] if kept else []
    bins = [list(a[0][g]) for g in taken] + [list(b[0][g]) for g in kept]
    fill = [a[1][g] for g in taken] + [b[1][g] for g in kept]
    held = {x for g in bins for x in g}
    loose = [x for x in range(len(size)) if x not in held]
    for _ in range(2):
        loose = swap_in(bins, fill, loose, size, capacity)
    best_fit(bins, fill, loose, size, capacity)
    return bins, fill


def packing_of(bins: list[list[int]], size: list[int]) -> Packing:
    return bins, [sum(size[x] for x in g) for g in bins]


def evolve(size: list[int], population: list[Packing], *, capacity: int, generations: int, members: int, patience: int, seed: int) -> list[Packing]:
    """The population after generations, best first. It stops at the lower bound of the number of bins, or where `patience` generations in a row gain nothing."""
    rng = random.Random(seed)
    items = list(range(len(size)))
    bound = lower_bound(size, capacity)
    score = lambda p: (len(p[0]), -fitness(p[1], capacity))
    people = list(population)
    if not people:
        bins, fill = [], []
        best_fit(bins, fill, items, size, capacity)
        people.append((bins, fill))
    while len(people) < members and len(min(people, key=score)[0]) > bound:
        # others: a random part dissolved and put back, some of it in random order
        bins, fill = [list(g) for g in people[0][0]], list(people[0][1])
        out = set(rng.sample(range(len(bins)), len(bins) // 2))
        loose = [x for g in out for x in bins[g]]
        bins, fill = [g for i, g in enumerate(bins) if i not in out], [f for i, f in enumerate(fill) if i not in out]
        rng.shuffle(loose)
        some = loose[: len(loose) // 3]
        for x in some:
            if fill and fill[-1] + size[x] <= capacity:
                bins[-1].append(x)
                fill[-1] += size[x]
            else:
                bins.append([x])
                fill.append(size[x])
        best_fit(bins, fill, loose[len(loose) // 3 :], size, capacity)
        people.append((bins, fill))
    people.sort(key=score)
    idle = 0
    for _ in range(generations):
        if len(people[0][0]) <= bound or idle >= patience or len(people) < 2:
            break
        i, j = rng.sample(range(len(people)), 2)
        before = score(people[0])
        people = sorted([*people, cross(people[i], people[j], size, capacity, rng)], key=score)[:members]
        idle = 0 if score(people[0]) < before else idle + 1
    return people


def _epoch(capacity: int, generations: int, members: int, patience: int, migrants: bool):
    """One epoch of one island: rows are its pieces, with the elite's bin of each in column elite (or null)."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_id")
        size = [int(x) for x in pdf["length"]]
        population = []
        if migrants:
            for name in ("own", "elite"):
                groups: dict[int, list[int]] = {}
                for x, g in enumerate(pdf[name]):
                    groups.setdefault(int(g), []).append(x)
                population.append(packing_of(list(groups.values()), size))
        people = evolve(size, population, capacity=capacity, generations=generations, members=members, patience=patience, seed=int(key[0]) * 31 + int(key[1]) * 7 + migrants)
        best = np.zeros(len(size), np.int64)
        for g, xs in enumerate(people[0][0]):
            best[xs] = g
        return pd.DataFrame({"block": key[0], "island": key[1], "row_id": pdf["row_id"], "length": size, "bin": best, "bins": len(people[0][0])})

    return run


def pack_blocks(items: DataFrame, *, capacity: int, islands: int, epochs: int, generations: int, members: int, patience: int) -> DataFrame:
    """items (row_id, length, block) with the bin in their block's best individual of any island."""
    kind = "block long, island long, row_id long, length long, bin long, bins long"
    d = items.select("block", "row_id", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(islands - 1).cast("long"))).alias("island"))
    got = d.groupBy("block", "island").applyInPandas(_epoch(capacity, generations, members, patience, False), kind)
    for _ in range(epochs - 1):
        got = saved(got, "pack-epoch")
        elite = got.select("block", "row_id", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("bin").alias("elite"))
        both = got.withColumnRenamed("bin", "own").drop("bins").join(elite, ["block", "island", "row_id"])
        got = both.groupBy("block", "island").applyInPandas(_epoch(capacity, generations, members, patience, True), kind)
    got = saved(got, "pack-islands")
    won = got.groupBy("block").agg(F.min(F.struct("bins", "island")).alias("best"))
    return got.join(won, "block").filter(F.col("island") == F.col("best.island")).select("block", "row_id", "length", "bin")


def pack(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0,
    block_items: int = 2000, islands: int = 2, epochs: int = 2, generations: int = 60, members: int = 6, patience: int = 15, well_filled: float = 0.995,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    p = pieces(docs, tokenizer, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id)
    p = saved(p.withColumn("row_id", F.monotonically_increasing_id()), "pack-pieces")
    full = p.filter(F.col("length") == capacity).select("row_id", F.concat(F.lit("f"), F.col("row_id")).alias("sequence"))
    small = p.filter(F.col("length") < capacity).select("row_id", "length")
    done = [full]
    for last in (False, True):
        n = small.count()
        if not n:
            break
        blocks = max(1, n // block_items)
        params = {"capacity": capacity, "islands": islands, "epochs": epochs, "generations": generations, "members": members, "patience": patience}
        got = saved(pack_blocks(small.withColumn("block", F.pmod(F.xxhash64("row_id"), F.lit(blocks))), **params), "pack-round")
        fill = got.groupBy("block", "bin").agg(F.sum("length").alias("fill"))
        got = got.join(fill, ["block", "bin"])
        keep = F.lit(True) if last else F.col("fill") >= well_filled * capacity
        done.append(got.filter(keep).select("row_id", F.concat_ws("-", F.lit(int(last)), "block", "bin").alias("sequence")))
        small = got.filter(~keep).select("row_id", "length")
    placed = done[0]
    for x in done[1:]:
        placed = placed.unionByName(x)
    out = p.join(placed, "row_id")
    # a sequence holds at most capacity pieces, as each has a token at least; its id is its least row_id
    w = Window.partitionBy("sequence").orderBy("row_id")
    before = F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = out.withColumns({"offset": F.coalesce(before, F.lit(0)).cast("long"), "sequence_id": F.min("row_id").over(w)})
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
