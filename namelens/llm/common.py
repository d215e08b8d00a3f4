"""What the corpus operators share: the word definition, shared scratch tables, hashes.

A word is a maximal run of characters other than the six ASCII white-space
characters (space, tab, line feed, vertical tab, form feed, carriage return).
Null texts have no words.
"""

from __future__ import annotations

import contextlib
import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Functions of this subpackage travel to the workers by value, so that a worker
#: needs no particular PYTHONPATH.
cloudpickle.register_pickle_by_value(sys.modules[__name__.rpartition(".")[0]])

#: The white space that separates words, for btrim/translate and for a regular expression.
SPACE = " \t\n\x0b\f\r"
SPACE_RE = r"[ \t\n\x0B\f\r]+"


def words_col(text: Column) -> Column:
    """The words of a text as array<string>; empty for null or blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RE))


def byte_words(text: str | None) -> list[bytes]:
    """The same words in Python: bytes.split() splits at exactly the six ASCII characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def lower_ascii_words(text: str | None) -> list[bytes]:
    """Words after lower-casing A-Z only."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def hash_words(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word (keyed SipHash of pandas, alike in every process)."""
    if not words:
        return np.zeros(0, np.uint64)
    a = np.empty(len(words), object)
    a[:] = words
    return pd.util.hash_array(a, categorize=False)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: a bijection of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(h: np.ndarray, k: int, seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """64-bit hashes of all runs of k consecutive word hashes, in order."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    m, acc = np.uint64(seed | 1), np.zeros(n, np.uint64)
    for j in range(k):
        acc = acc * m + h[j : j + n]
    return mix(acc)


#: Counters of a sketch, a power of two: four bytes each in a task, one byte each on the driver and when broadcast.
WIDTH = 1 << 20
CHUNK = 1 << 14


class Sketch:
    """How often hashes occur, by their low bits: counts that are too high by chance, never too low."""

    def __init__(self) -> None:
        self.counts, self.waiting, self.size = np.zeros(WIDTH, np.int32), [], 0

    def add(self, values: np.ndarray) -> None:
        self.waiting.append(values)
        self.size += len(values)
        if self.size > 1 << 20:
            self.flush()

    def flush(self) -> None:
        if self.size:
            x = np.concatenate(self.waiting).view(np.uint64) & np.uint64(WIDTH - 1)
            self.counts += np.bincount(x.astype(np.int64), minlength=WIDTH).astype(np.int32)
        self.waiting, self.size = [], 0

    def chunks(self) -> Iterator[tuple[int, bytes]]:
        self.flush()
        for at in range(0, WIDTH, CHUNK):
            if (part := self.counts[at : at + CHUNK]).any():
                yield at // CHUNK, part.tobytes()


def commonness(chunks: DataFrame) -> np.ndarray:
    """Of all tasks' chunks (chunk, counts): 4 times the logarithm of each counter, WIDTH bytes whatever the corpus."""

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for at, counts in zip(b["chunk"].tolist(), b["counts"], strict=True):
                x = np.frombuffer(counts, np.int32).astype(np.int64)
                sums[at] = sums[at] + x if at in sums else x
        yield pd.DataFrame({"chunk": list(sums), "levels": [np.round(4 * np.log2(x + 1)).astype(np.uint8).tobytes() for x in sums.values()]}, columns=["chunk", "levels"])

    levels = np.zeros(WIDTH, np.uint8)
    for r in chunks.repartition("chunk").mapInPandas(trimmed(added), "chunk int, levels binary").collect():  # WIDTH bytes in all
        levels[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["levels"], np.uint8)
    return levels


def rare_first(h: np.ndarray, levels: np.ndarray | None) -> np.ndarray:
    """Numbers that order hashes by commonness, then by a hash; by the hash alone without levels."""
    x = mix(h)
    return x if levels is None else (levels[(h & np.uint64(WIDTH - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (x >> np.uint64(8))


def give_back() -> None:
    """Returns the free memory of this process, which allocators would keep, to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # of glibc only
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(made: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """made, after whose last batch the worker, which waits for other tasks then, gives back memory."""

    def run(batches: Iterator) -> Iterator:
        yield from made(batches)
        give_back()

    return run


def id_columns(c: Column, name: str = "doc") -> list[Column]:
    """An id as two columns without nulls: pandas would turn a nullable long into a float, which holds 53 bits."""
    return [F.coalesce(c.cast("long"), F.lit(0)).alias(name), c.isNull().alias(name + "_null")]


def ids_of(b: pd.DataFrame, name: str = "doc") -> pd.Series:
    """The ids again, from the columns of id_columns(), as nullable integers."""
    return pd.Series(pd.arrays.IntegerArray(b[name].to_numpy(np.int64), b[name + "_null"].to_numpy(bool)), index=b.index)


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a local session (tests) gets a temporary one, a cluster an error."""
    sc = spark.sparkContext
    got = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not got:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        got = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(got)
        got = sc.getCheckpointDir()
    return got.rstrip("/")


def saved(df: DataFrame, what: str, partition_by: list[str] | None = None) -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    w = df.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def released(*dfs: DataFrame) -> None:
    """Deletes tables that saved() wrote and nothing reads any more."""
    for df in dfs:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.saved_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_names(taken: list[str], wanted: list[str]) -> list[str]:
    """wanted, each with as many underscores before it as it takes to be in no column's way."""
    out, used = [], {c.lower() for c in taken}
    for c in wanted:
        while c.lower() in used:
            c = "_" + c
        used.add(c.lower())
        out.append(c)
    return out


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns named c0, c1 ..., and the new name of each old one."""
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*at.values()), at


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
