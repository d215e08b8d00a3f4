"""Operator 8: removal of passages that an earlier document holds, by suffix automata of reference shards.

A window is `window` consecutive words of one document. A word goes if some
window over it also starts in a document with a smaller doc_id.

Broadcasting automata of the whole corpus to all documents would cost the
square of the corpus, so the corpus is sharded by content. Each window belongs
to its minimizer, the rarest of its runs of `anchor` words (by a count sketch over
all documents, then by hash), so that a common line is an anchor of windows inside
common passages only; the windows of
one minimizer form a piece of at most 2 * window - anchor words. Equal windows
have equal minimizers, so they meet in one shard, and a shard needs only the
distinct pieces of its anchor. Pieces that are alike in all words are settled
by the smallest doc_id. The distinct pieces of an anchor stream, in order of
doc_id, through the suffix automaton of the pieces before: matching statistics
of `window` and more mark covered words. Anchors with more than max_shard
distinct pieces are settled window by window instead, which is exact too and
keeps every automaton within a bound.

Documents are told apart by doc_id and 24 bits of a hash of the text. Words are
compared by 64-bit hashes; a chance match needs a collision within one anchor.

Defined results: null texts have no words; a null doc_id counts as smaller than
any other; repeated rows do not cover each other; rows that share a doc_id but
not the text are judged each on its own and do not cover each other; an empty
table gives no rows; other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from namelens.llm.common import Sketch, byte_words, commonness, free_names, gram_hashes, hash_words, mix, rare_first, saved, trimmed

WINDOW = 13
ANCHOR = 6
MAX_SHARD = 5_000
_NULL = -(1 << 63)
_P = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd constant and of its inverse modulo 2^64, at least n of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        m = max(n, 1 << 16)
        inverse = pow(_P, -1, 1 << 64)
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(m, x, np.uint64)])) for x in (_P, inverse)]
    return _POWERS[0], _POWERS[1]


def tag(text: str | None) -> int:
    """24 bits of a hash of the text."""
    return xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass")) & 0xFFFFFF


def pieces_of(h: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR, levels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, content hash, first word, number of words) of the pieces of one document's word hashes."""
    n = len(h) - window + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z.view(np.uint64), z.view(np.uint64), z, z
    g = gram_hashes(h, anchor)
    order = rare_first(g, levels)
    best, at = order[:n].copy(), np.arange(n)
    for j in range(1, window - anchor + 1):  # the leftmost least of each window
        less = order[j : j + n] < best
        best[less] = order[j : j + n][less]
        at[less] = np.flatnonzero(less) + j
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [n]]) - 1
    powers, inverse = _powers(len(h) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers[: len(h)])])
    content = mix((sums[last + window] - sums[first]) * inverse[first] + (last - first).astype(np.uint64))
    return g[at[first]], content, first, last - first + window


class SuffixAutomaton:
    """Of several sequences; grows by one sequence at a time."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state for the part of q that p reaches by c."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: list[int]) -> None:
        last = 0
        for c in sequence:
            if c in self.next[last]:
                last = self._split(last, c, self.next[last][c])
                continue
            new = self._state(self.length[last] + 1, {}, 0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, c, self.next[p][c])
            last = new

    def matching_statistics(self, sequence: list[int]) -> list[int]:
        """For each place, the length of the longest match that ends there."""
        v = n = 0
        out = []
        for c in sequence:
            while v and c not in self.next[v]:
                v = self.link[v]
                n = self.length[v]
            if c in self.next[v]:
                v, n = self.next[v][c], n + 1
            else:
                n = 0
            out.append(n)
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans [start, end), sorted."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def covered_by(stats: list[int], window: int) -> list[tuple[int, int]]:
    """The spans under windows whose matching statistic reaches the window's length."""
    return merged([(i - window + 1, i + 1) for i, n in enumerate(stats) if n >= window])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL)).alias("doc"), F.col(text_col).alias("text"))


def covered_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, max_shard: int = MAX_SHARD) -> DataFrame:
    """doc, tag and spans (each start * 2^24 + number of words) of the words to remove."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch = Sketch()
        for b in batches:
            for text in b["text"]:
                sketch.add(gram_hashes(hash_words(byte_words(text)), anchor))
        yield pd.DataFrame(list(sketch.chunks()), columns=["chunk", "counts"])

    keyed = _keyed(docs, id_col, text_col)
    levels = commonness(saved(keyed.select("text").mapInPandas(trimmed(counted), "chunk int, counts binary"), "anchor-counts"))
    common = docs.sparkSession.sparkContext.broadcast(levels)  # a byte for each counter of the sketch

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("key", "anchor", "content", "doc", "at")
        seen: dict[int, int] = {}  # least doc so far of a piece, by a hash of it

        def frame(parts: list[tuple]) -> pd.DataFrame:
            a, c, doc, at = (np.concatenate(v) for v in zip(*parts, strict=True))
            if len(seen) > 300_000:
                seen.clear()
            late = np.zeros(len(a), bool)
            for i, (k, d) in enumerate(zip((mix(a) ^ c).tolist(), doc.tolist(), strict=True)):
                least = seen.setdefault(k, d)
                if d > least:
                    late[i] = True
                elif d < least:
                    seen[k] = d
            key = np.where(late, mix(at.view(np.uint64) ^ mix(doc.view(np.uint64))), a)
            return pd.DataFrame(dict(zip(names, [key.view(np.int64), a.view(np.int64), c.view(np.int64), doc, at], strict=True))).assign(late=late)

        for b in batches:
            parts: list[tuple] = []
            for doc, text in zip(b["doc"].tolist(), b["text"], strict=True):
                a, c, first, n = pieces_of(hash_words(byte_words(text)), window, anchor, common.value)
                if len(a):
                    parts.append((a, c, np.full(len(a), doc, np.int64), (first << 32) | (n << 24) | tag(text)))
                if sum(len(p[0]) for p in parts) > 100_000:
                    yield frame(parts)
                    parts = []
            if parts:
                yield frame(parts)

    # pieces that a task has met in an earlier document are settled there; they are dealt out by themselves, so that a passage in very many documents gathers nowhere
    p = keyed.mapInPandas(trimmed(cut), "key long, anchor long, content long, doc long, at long, late boolean").repartition("key")
    alike, of_anchor = Window.partitionBy("key", "content"), Window.partitionBy("key")
    p = p.withColumn("first_doc", F.min("doc").over(alike))
    p = p.withColumns({"low": F.min("content").over(of_anchor), "high": F.max("content").over(of_anchor)})
    settled = F.col("late") | (F.col("doc") > F.col("first_doc"))
    p = p.filter(settled | ((F.col("low") != F.col("high")) & (F.col("doc") == F.col("first_doc"))))
    p = saved(p.select(F.when(~settled, F.col("anchor")).alias("anchor"), F.when(~settled, F.col("content")).alias("content"), "doc", "at"), "pieces")
    span = F.shiftleft(F.shiftrightunsigned("at", 32), 24) + F.shiftrightunsigned("at", 24).bitwiseAND(F.lit(0xFF))
    text_tag = F.col("at").bitwiseAND(F.lit(0xFFFFFF))
    whole = p.filter(F.col("anchor").isNull()).select("doc", text_tag.alias("tag"), span.alias("span"))

    compared = _with_words(docs, p.filter(F.col("anchor").isNotNull()), id_col, text_col)
    compared = saved(compared, "piece-words")
    sizes = compared.groupBy("anchor", "content").agg(F.count("*").alias("n")).groupBy("anchor").agg(F.count("*").alias("distinct")).filter(F.col("distinct") > max_shard)
    large = saved(sizes, "large-shards")
    small = compared.join(large, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor", "doc")

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now_anchor = now_doc = None
        automaton, waiting, done = SuffixAutomaton(), [], {}
        for b in batches:
            out = []
            for a, content, doc, at, w in zip(b["anchor"].tolist(), b["content"].tolist(), b["doc"].tolist(), b["at"].tolist(), b["words"], strict=True):
                if a != now_anchor:
                    automaton, waiting, done, now_anchor, now_doc = SuffixAutomaton(), [], {}, a, doc
                elif doc != now_doc:
                    for x in waiting:
                        automaton.add(x)
                    waiting, done, now_doc = [], {}, doc
                if content not in done:
                    words = w.tolist()
                    done[content] = covered_by(automaton.matching_statistics(words), window)
                    waiting.append(words)
                out += [(doc, at & 0xFFFFFF, (((at >> 32) + s) << 24) + e - s) for s, e in done[content]]
            yield pd.DataFrame(out, columns=["doc", "tag", "span"])

    partly = small.mapInPandas(trimmed(shards), "doc long, tag long, span long")
    # shards beyond the bound: the smallest doc_id of each window
    rest = compared.join(F.broadcast(large.select("anchor")) if large.count() < 100_000 else large.select("anchor"), "anchor")
    rest = rest.select("doc", "at", "words", F.explode(F.sequence(F.lit(0), F.size("words") - window)).alias("i"))
    rest = rest.select("doc", "at", "i", F.xxhash64(F.slice("words", F.col("i") + 1, window)).alias("w1"), F.hash(F.slice("words", F.col("i") + 1, window)).alias("w2"))
    least = rest.groupBy("w1", "w2").agg(F.min("doc").alias("least"))
    late = rest.join(least, ["w1", "w2"]).filter(F.col("doc") > F.col("least"))
    late = late.select("doc", text_tag.alias("tag"), (F.shiftleft(F.shiftrightunsigned("at", 32) + F.col("i"), 24) + F.lit(window)).alias("span"))
    spans = whole.unionByName(partly).unionByName(late)
    return spans.groupBy("doc", "tag").agg(F.collect_list("span").alias("spans"))


def _with_words(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """wanted (anchor, content, doc, at) with the word hashes of each piece."""

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["anchor", "content", "doc", "at", "words"]
        for b in batches:
            out = []
            for doc, text, want in zip(b["doc"].tolist(), b["text"], b["want"], strict=True):
                h, t = hash_words(byte_words(text)).view(np.int64), tag(text)
                for x in want:
                    at = x["at"]
                    if at & 0xFFFFFF == t:
                        start, n = at >> 32, (at >> 24) & 0xFF
                        out.append((x["anchor"], x["content"], doc, at, h[start : start + n]))
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    lists = wanted.groupBy("doc").agg(F.collect_list(F.struct("anchor", "content", "at")).alias("want"))
    d = _keyed(docs, id_col, text_col).join(lists, "doc")
    return d.mapInPandas(trimmed(fetch), "anchor long, content long, doc long, at long, words array<long>").dropDuplicates(["anchor", "doc", "at"])


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """docs with n_words, n_removed and kept_text: the words that stay, joined by one space.

    All columns of docs are kept; where they have one of these names, the new one gets an underscore before it.
    """
    names = docs.columns
    made = free_names(names, ["n_words", "n_removed", "kept_text"])
    doc, own, key = free_names([*names, *made], ["doc", "spans", "key"])
    spans = covered_spans(docs, id_col=id_col, text_col=text_col, **params)
    # the text's tag is made in Python, so that a document meets the spans of its doc_id and picks its own there
    lists = spans.groupBy(F.col("doc").alias(key)).agg(F.collect_list(F.struct("tag", "spans")).alias(own))
    d = docs.withColumn(doc, F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NULL)))
    d = d.join(lists, F.col(doc) == F.col(key), "left")
    schema = T.StructType([*docs.schema.fields]).add(made[0], "long").add(made[1], "long").add(made[2], "string")

    def keep(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            n_words, n_removed, kept = [], [], []
            for text, found in zip(b.column(text_col).to_pylist(), b.column(own).to_pylist(), strict=True):
                w = byte_words(text)
                t = tag(text) if found else -1
                found = merged([(s >> 24, (s >> 24) + (s & 0xFFFFFF)) for x in found or [] if x["tag"] == t for s in x["spans"]])
                stay, at = [], 0
                for s, e in found:
                    stay += w[at:s]
                    at = e
                stay += w[at:]
                n_words.append(len(w))
                n_removed.append(len(w) - len(stay))
                kept.append(b" ".join(stay).decode("utf-8", "surrogatepass"))
            cols = [b.column(c) for c in names] + [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, *made])

    return d.select(*[F.col(f"`{c}`") for c in [*names, own]]).mapInArrow(trimmed(keep), schema)


def removed_digests(docs: DataFrame, **params) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the words that stay."""
    out = remove_repeats(docs.select("doc_id", "text"), **params)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
