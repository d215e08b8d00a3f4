"""Operator 6: join of documents whose sets of word shingles have a high Jaccard similarity.

Two documents link when 100 * intersection >= percent * union. Nodes are classes
of documents with equal sets (told apart by a 64-bit digest, as shingles are),
so null or reused ids join nothing. No filter loses a link:

1. Under any global order of shingles, a linked pair shares one within the
   first n - ceil(percent * n / 100) + 1 of each. Three orders are used: by how
   common a shingle is (the logarithm of a count sketch over all documents,
   then a hash), and by two hashes alone. Candidates meet at a prefix shingle
   of the first order, where sizes and places bound the overlap; they must also
   share bits of both other prefixes, and the parity bits of their whole sets
   (about as many as shingles) may differ in no more places than the sets may.
2. Not all pairs of a list are tried. At first each list's members meet two of
   them. Then, in lists that still hold several components of candidates,
   members outside the largest one meet the members of other components.
3. Lists where that would still be many pairs (a shingle in very many documents
   that are not alike) are replaced by narrower ones: shingles are dealt by hash
   into one part more than the sets of a linked pair can differ in, so such a
   pair is alike in all shingles of some part, and meets at that part's hash.
4. Sets are made of the documents that have a candidate only, and travel once to
   their component of candidates, in which all pairs are verified in blocks:
   that gives the links' components and the number of each one's links.

Defined results: null and blank texts have an empty set and link with nothing;
rows with a null doc_id are documents like others, and a component's id is its
least doc_id that is not null; rows that share an id but not the text are
different documents; repeated rows share a class; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namelens.llm.common import Sketch, commonness, gram_hashes, hash_words, id_columns, ids_of, lower_ascii_words, mix, rare_first, released, saved, trimmed

#: Seeds of the two orders by hash, and the longs of a prefix's bitmap and of the parity bitmap.
ORDERS = (0x51ED270B, 0x2545F491)
BITS, PARITY = 2, 4
#: Centres of each list, and the pairs that a list may still make after them.
CENTRES = 2
MOST_PAIRS = 2_000_000
SIGNATURE = [*(f"o{j}_{i}" for j in range(len(ORDERS)) for i in range(BITS)), *(f"y{i}" for i in range(PARITY))]


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of k words; of all words if there are fewer."""
    w = lower_ascii_words(text)
    if not w:
        return np.zeros(0, np.int64)
    h = hash_words(w)
    return np.unique(gram_hashes(h, k) if len(h) >= k else gram_hashes(h, len(h), 2 * len(h) + 1)).view(np.int64)


def class_of(s: np.ndarray) -> int:
    """A 64-bit digest of a set."""
    return int(np.frombuffer(xxhash.xxh3_64_digest(s.tobytes()), ">i8")[0])


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def parity(s: np.ndarray, bits: int) -> np.ndarray:
    """For each of so many counters (a power of two), whether an odd number of the set's shingles fall on it, as longs."""
    odd = np.bincount(((s.view(np.uint64) >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def long_parity(s: np.ndarray) -> np.ndarray:
    """As many parity bits as shingles, or up to twice as many. Linked sets have equal numbers of them, or one twice the other's: halves then fold into each other."""
    return parity(s, max(64 * PARITY, 1 << (len(s) - 1).bit_length()))


def signature(s: np.ndarray, percent: int) -> list[int]:
    """Bitmaps of the prefixes under the orders by hash, then the parity bitmap of the whole set."""
    p, out, t = prefix_length(len(s), percent), [], s.view(np.uint64)
    for seed in ORDERS:
        o = mix(t ^ np.uint64(seed))
        first = np.partition(o, p - 1)[:p] if p < len(o) else o
        bits = np.zeros(64 * BITS, np.uint8)
        bits[(first % np.uint64(64 * BITS)).astype(np.int64)] = 1
        out += np.packbits(bits).view(np.int64).tolist()
    return out + parity(s, 64 * PARITY).tolist()


def prefix_of(s: np.ndarray, percent: int, levels: np.ndarray) -> np.ndarray:
    """The first shingles in the order by commonness; ties, 1 in 2^56, keep the order of s."""
    return s[np.argsort(rare_first(s.view(np.uint64), levels), kind="stable")[: prefix_length(len(s), percent)]]


def size_classes(n: int, percent: int) -> list[tuple[int, int]]:
    """(class, parts) of the two size classes where a set of n meets all that it may link with.

    A class starts just beyond 100 / percent times the start of the one before, so
    linked sets are in one class or in neighbours; parts is one more than the
    elements in which linked sets may differ if the smaller is in the class.
    """
    i, low, before = 0, 1, None
    while True:
        high = low * 100 // percent + 1
        most = high - 1
        here = (i, (most + most * 100 // percent) * (100 - percent) // (100 + percent) + 1)
        if n < high:
            return [here] if before is None else [before, here]
        i, low, before = i + 1, high, here


def part_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """A hash of the shingles in each part, for both size classes of the set."""
    t, keys = s.view(np.uint64), []
    for c, parts in size_classes(len(s), percent):
        part = (mix(t ^ np.uint64(77)) % np.uint64(parts)).astype(np.int64)
        sums = np.zeros(parts, np.uint64)
        np.add.at(sums, part, mix(t ^ np.uint64(99)))
        keys.append(mix(sums ^ mix(np.arange(parts, dtype=np.uint64) + np.uint64(c << 32))))
    return np.concatenate(keys).view(np.int64)


def components(edges: DataFrame, what: str) -> DataFrame:
    """doc, component (least node that links reach) of the nodes in edges (a, b).

    Minimum labels go along links and along labels (pointer jumping) until none changes.
    """
    both = saved(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), what + "-edges")
    if both.isEmpty():
        return both.select(F.col("a").alias("doc"), F.col("b").alias("component"))
    labels = saved(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")).withColumnRenamed("a", "doc"), what + "-labels")
    while True:
        now = labels.select("doc", F.col("to").alias("component"))
        seen = both.join(now, F.col("b") == F.col("doc")).groupBy("a").agg(F.min("component").alias("near"))
        step = now.join(seen, F.col("doc") == F.col("a"), "left").select("doc", "component", F.least("component", F.coalesce("near", "component")).alias("to"))
        step = saved(step, what + "-step")
        jump = step.select(F.col("doc").alias("d"), F.col("to").alias("far"))
        next_ = step.join(jump, F.col("to") == F.col("d"), "left").select("doc", "component", F.least("to", F.coalesce("far", "to")).alias("to"))
        next_ = saved(next_, what + "-labels")
        released(step, labels)
        labels = next_
        if labels.filter(F.col("to") < F.col("component")).isEmpty():
            released(both)
            return labels.select("doc", F.col("to").alias("component"))


def _may_meet(a: str, b: str, percent: int) -> Column:
    """Whether rows a and b of one list may hold a linked pair's first shared shingle."""
    need = F.expr(f"({percent} * ({a}.n + {b}.n) + {99 + percent}) div {100 + percent}")
    return (need <= F.least(f"{a}.n", f"{b}.n")) & (F.col(f"{a}.pos") <= F.col(f"{a}.n") - need) & (F.col(f"{b}.pos") <= F.col(f"{b}.n") - need)


def _alike(a: str, b: str, percent: int, whole: bool = True) -> Column:
    """Whether signatures a and b may be those of a linked pair; whole: by the long parity bits too."""
    ok = F.lit(True)
    for j in range(len(ORDERS)):
        shared = F.lit(False)
        for i in range(BITS):
            shared = shared | (F.col(f"{a}.o{j}_{i}").bitwiseAND(F.col(f"{b}.o{j}_{i}")) != 0)
        ok = ok & shared
    odd = sum((F.bit_count(F.col(f"{a}.y{i}").bitwiseXOR(F.col(f"{b}.y{i}"))) for i in range(PARITY)), F.lit(0))
    most = F.expr(f"({100 - percent} * ({a}.n + {b}.n)) div {100 + percent}")
    ok = ok & (odd <= most)
    if not whole:
        return ok
    x, y = F.col(f"{a}.y"), F.col(f"{b}.y")
    half = lambda v: F.zip_with(F.slice(v, F.lit(1), F.size(v) / 2), F.slice(v, F.size(v) / 2 + 1, F.size(v)), lambda p, q: p.bitwiseXOR(q))
    folded = lambda v, w: F.when(F.size(v) > F.size(w), half(v)).otherwise(v)
    differ = F.aggregate(F.zip_with(folded(x, y), folded(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda acc, v: acc + v)
    return ok & (differ <= most)


def verified(labels: DataFrame, sets: DataFrame, percent: int, block: int = 1024) -> DataFrame:
    """c, to, n_links: rows whose numbers of links add up to each class's, and whose `to` gives the links' components.

    labels are components of candidates, outside which there are no links. All
    members of one meet, in blocks of about `block` classes (or 1 M shingles), a
    task for each pair of blocks. There each set is what it lacks of the shingles that most of
    them hold, and what it adds, which near copies have little of; a pair's overlap
    follows from how many of these it shares.
    """
    x = labels.withColumnRenamed("doc", "c").join(sets.select("c", F.size("tokens").cast("long").alias("n")), "c")
    sizes = x.groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    sizes = sizes.select("component", F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("total") / 1_000_000)).alias("blocks"))
    x = x.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("c"), "blocks"))
    x = x.select("c", "component", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    x = x.select("c", "component", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).join(sets, "c")

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        held, times = np.unique(np.concatenate(pdf["tokens"].tolist()), return_counts=True)
        base = held[2 * times > len(pdf)]

        def apart(rows: pd.DataFrame) -> tuple:
            """Classes, sizes, sizes of the overlap with base, and what sets add to or lack of it (as values and owners)."""
            sets = rows["tokens"].tolist()
            added = [np.setdiff1d(s, base, assume_unique=True) for s in sets]
            lacks = [np.setdiff1d(base, s, assume_unique=True) for s in sets]
            n = np.array([len(s) for s in sets], np.int64)
            shared = n - np.array([len(a) for a in added], np.int64)
            flat = [(np.concatenate(v) if v else np.zeros(0, np.int64), np.repeat(np.arange(len(v)), [len(a) for a in v])) for v in (added, lacks)]
            return rows["c"].to_numpy(), n, shared, flat

        c, n, s, lists = apart(pdf[pdf["own"] == i])
        d, m, t, others = (c, n, s, lists) if i == j else apart(pdf[pdf["own"] == j])
        # |x & y| = |x & base| + |y & base| - |base| + elements that both lack + elements that both add
        both = s[:, None] + t[None, :] - len(base)
        for (v, owner), (w, at) in zip(lists, others, strict=True):
            order = np.argsort(w, kind="stable")
            w, at = w[order], at[order]
            low = np.searchsorted(w, v, "left")
            reps = np.searchsorted(w, v, "right") - low
            # some elements at a time, so that what they share is bounded
            ends, first = np.cumsum(reps), 0
            while first < len(v):
                to = max(first + 1, int(np.searchsorted(ends, ends[first] + (1 << 20))))
                r, l = reps[first:to], low[first:to]
                pos = np.repeat(l - np.cumsum(r) + r, r) + np.arange(r.sum())
                np.add.at(both, (np.repeat(owner[first:to], r), at[pos]), 1)
                first = to
        hit = (100 * both >= percent * (n[:, None] + m[None, :] - both)) & (c[:, None] != d[None, :])
        # the least class that links within these blocks reach
        x, y = c.copy(), d.copy()
        while len(x) and len(y):
            to = np.minimum(x, np.where(hit, y[None, :], np.iinfo(np.int64).max).min(1))
            back = np.minimum(y, np.where(hit, to[:, None], np.iinfo(np.int64).max).min(0))
            if i == j:
                to = back = np.minimum(to, back)
            if (to == x).all() and (back == y).all():
                break
            x, y = to, back
        out = pd.DataFrame({"c": c, "to": x, "n_links": hit.sum(1)})
        return out if i == j else pd.concat([out, pd.DataFrame({"c": d, "to": y, "n_links": hit.sum(0)})])

    return x.groupBy("component", "i", "j").applyInPandas(count, "c long, to long, n_links long")


def _with_centres(rows: DataFrame, signs: DataFrame, percent: int, seed: int) -> DataFrame:
    """Candidates (a, b) of each list's members with one of them, a."""
    centre = rows.groupBy("token").agg(F.min(F.struct(F.xxhash64("c", F.lit(seed)).alias("by"), "c", "n", "pos")).alias("y"))
    x = rows.alias("x").join(centre, "token").filter(F.col("x.c") != F.col("y.c"))
    pairs = x.filter(_may_meet("x", "y", percent)).select(F.col("y.c").alias("a"), F.col("x.c").alias("b")).distinct()
    return pairs.join(signs.alias("x"), F.col("b") == F.col("x.c")).join(signs.alias("y"), F.col("a") == F.col("y.c")).filter(_alike("x", "y", percent)).select("a", "b")


def _across(rows: DataFrame, signs: DataFrame, percent: int, meet: bool = True) -> DataFrame:
    """Candidates (a, b) of each list's members outside its major component with the members of other components."""
    full = rows.join(signs.drop("n", "y"), "c")
    x, y = full.filter("component != major").alias("x"), full.alias("y")
    on = (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.major")) | (F.col("x.component") < F.col("y.component")))
    x = x.join(y, F.col("x.token") == F.col("y.token")).filter(on & _alike("x", "y", percent, False) & (_may_meet("x", "y", percent) if meet else F.lit(True)))
    pairs = x.select(F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b")).distinct()
    return pairs.join(signs.alias("x"), F.col("b") == F.col("x.c")).join(signs.alias("y"), F.col("a") == F.col("y.c")).filter(_alike("x", "y", percent)).select("a", "b")


def _mixed(rows: DataFrame, labels: DataFrame, what: str) -> DataFrame:
    """The rows of lists that hold several components: with component, the list's largest one and how many pairs are left."""
    named = rows.drop("component").join(labels, F.col("c") == F.col("doc"), "left").withColumn("component", F.coalesce("component", F.col("c"))).drop("doc")
    each = named.groupBy("token", "component").agg(F.count("*").alias("m"))
    lists = each.groupBy("token").agg(F.max(F.struct("m", "component")).alias("most"), F.sum("m").alias("size")).filter(F.col("size") > F.col("most.m"))
    lists = lists.select("token", F.col("most.component").alias("major"), ((F.col("size") - F.col("most.m")) * F.col("size")).alias("left"))
    return saved(named.join(lists, "token"), what)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 90, counts: bool = True, keep_keys: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (least doc_id of the documents with an equal set) and, with counts, n_links (how many different sets its set links with).

    keep_keys adds what tells rows apart: row_key (a hash of id and text) and
    component_key (null for empty sets), for joins back where ids are null or reused.
    """

    def sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["key", "n", "c", *SIGNATURE, "y"]
        sketch = Sketch()
        for b in batches:
            out = []
            for key, text in zip(b["key"].tolist(), b["text"], strict=True):
                s = shingle_set(text, k)
                out.append((key, len(s), class_of(s), *(signature(s, percent) if len(s) else [0] * len(SIGNATURE)), long_parity(s) if len(s) else None))
                sketch.add(s)
            yield pd.DataFrame(out, columns=names, index=b.index).assign(doc=ids_of(b), chunk=pd.Series(pd.NA, index=b.index, dtype="Int32"), counts=None)
        none = pd.DataFrame({x: pd.Series([pd.NA], dtype="Int64") for x in ["doc", *names[:-1]]}).assign(y=None)
        for chunk, counts in sketch.chunks():
            yield none.assign(chunk=pd.Series([chunk], dtype="Int32"), counts=[counts])

    d = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).withColumn("key", F.xxhash64("doc", "text"))
    kind = "doc long, key long, n long, c long, " + ", ".join(f"{x} long" for x in SIGNATURE) + ", y array<long>, chunk int, counts binary"
    written = saved(d.select(*id_columns(F.col("doc")), "key", "text").mapInPandas(trimmed(sketched), kind), "join-members")
    members = written.filter("chunk is null")
    levels = commonness(written.filter("chunk is not null").select("chunk", "counts"))
    common = d.sparkSession.sparkContext.broadcast(levels)  # WIDTH bytes

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()  # copies within a task give their rows once
        parts: list[tuple] = []

        def frame() -> pd.DataFrame:
            x = pd.DataFrame(dict(zip(("token", "c", "n", "pos"), map(np.concatenate, zip((np.zeros(0, np.int64),) * 4, *parts, strict=True)), strict=True)))
            parts.clear()
            return x

        for b in batches:
            size = 0
            for text in b["text"]:
                s = shingle_set(text, k)
                c = class_of(s)
                if len(s) and c not in seen:
                    if len(seen) >= 100_000:
                        seen.clear()
                    seen.add(c)
                    first = prefix_of(s, percent, common.value)
                    parts.append((first, np.full(len(first), c), np.full(len(first), len(s)), np.arange(len(first))))
                    size += len(first)
                    if size > 200_000:
                        yield frame()
                        size = 0
            yield frame()

    t = d.select("text").mapInPandas(trimmed(prefixes), "token long, c long, n int, pos int")
    shared = t.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("token")
    rows = saved(t.join(shared, "token", "left_semi").distinct(), "join-prefixes")
    signed = members.filter("n > 0").groupBy("c").agg(F.min("key").alias("key"), F.first("n").alias("n"), *[F.first(x).alias(x) for x in [*SIGNATURE, "y"]])
    wanted = saved(signed.join(rows.select("c").distinct(), "c", "left_semi"), "join-signatures")
    signs = wanted.drop("key")
    # 2. candidates of centres, then across their components
    pairs = _with_centres(rows, signs, percent, 0)
    for seed in range(1, CENTRES):
        pairs = pairs.unionByName(_with_centres(rows, signs, percent, seed))
    pairs = saved(pairs, "join-candidates")
    labels = components(pairs, "join-labels")
    left = _mixed(rows, labels, "join-mixed")
    more = _across(left.filter(F.col("left") <= MOST_PAIRS), signs, percent)
    large = left.filter(F.col("left") > MOST_PAIRS)
    if not large.isEmpty():

        def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for at in range(0, len(b), 1000):
                    some = b.iloc[at : at + 1000]
                    sets = [shingle_set(text, k) for text in some["text"]]
                    keys = [part_keys(s, percent) for s in sets]
                    n = [len(x) for x in keys]
                    yield pd.DataFrame({"token": np.concatenate(keys), "c": np.repeat(some["c"].to_numpy(), n), "n": np.repeat([len(s) for s in sets], n), "pos": 0})

        # 3. narrower lists
        narrow = d.join(wanted.select("key", "c").join(large.select("c").distinct(), "c", "left_semi"), "key").select("text", "c")
        narrow = saved(narrow.mapInPandas(trimmed(parts), "token long, c long, n int, pos int").distinct(), "join-parts")
        more = more.unionByName(_across(_mixed(narrow, labels, "join-mixed"), signs, percent, False)).distinct()
    more = saved(more, "join-candidates")
    if not more.isEmpty():
        labels = components(pairs.unionByName(more), "join-labels")

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, size = [], 0
            for text, c in zip(b["text"], b["c"].tolist(), strict=True):
                if class_of(s := shingle_set(text, k)) == c:
                    out.append((c, s))
                    size += len(s)
                    if size > 1 << 20:
                        yield pd.DataFrame(out, columns=["c", "tokens"])
                        out, size = [], 0
            yield pd.DataFrame(out, columns=["c", "tokens"])

    # 4. sets of documents with candidates, and the links among them
    wanted = wanted.select("key", "c").join(labels.select(F.col("doc").alias("c")), "c", "left_semi")
    sets = d.join(wanted, "key").select("text", "c").mapInPandas(trimmed(sets_of), "c long, tokens array<long>")
    sets = saved(sets.dropDuplicates(["c"]), "join-sets")
    links = saved(verified(labels, sets, percent), "join-links")
    labels = components(links.filter("c != to").select(F.col("c").alias("a"), F.col("to").alias("b")), "join-labels")
    # back to documents
    classes = members.filter("n > 0").groupBy("c").agg(F.min("doc").alias("least"))
    of = classes.join(labels, F.col("c") == F.col("doc"), "left").select("c", "least", F.coalesce("component", "c").alias("component"))
    ids = of.groupBy("component").agg(F.min("least").alias("component_id"))
    of = of.join(ids, "component")
    more = []
    if counts:
        of = of.join(links.groupBy("c").agg(F.sum("n_links").alias("n_links")), "c", "left")
        more = [F.coalesce("n_links", F.lit(0)).alias("n_links")]
    if keep_keys:
        more += [F.col("key").alias("row_key"), F.when(F.col("n") > 0, F.col("component")).alias("component_key")]
    out = members.select("doc", "key", "n", "c").join(of, "c", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc"))
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), own.alias("component_id"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc")).alias("class_id"), *more)
