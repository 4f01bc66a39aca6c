"""Shared pieces of the training-data operators: byte-level tokenising, chunking, checkpoints, components."""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that the vectorised passes take at a time; one longer text is taken alone.
CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse for i < n, modulo 2**64; kept for later calls of usual size."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, CHUNK_BYTES)

        def run(base: int) -> np.ndarray:
            a = np.full(size, base, np.uint64)
            a[0] = 1
            return np.multiply.accumulate(a)

        up, down = run(_BASE), run(pow(_BASE, -1, 1 << 64))
        if size > 4 * CHUNK_BYTES:
            return up, down
        _POWERS["up"], _POWERS["down"] = up, down
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; works in place."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def rolling(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k consecutive codes; fewer than k codes give none."""
    n = len(codes)
    if n < k or n == 0:
        return np.empty(0, np.uint64)
    up, down = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: n - k + 1])


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def string_chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column, each of at most `most` bytes or one row."""
    ends = string_offsets(column)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(ends, ends[at] + most, "right")) - 1
        to = min(max(to, at + 1), len(column))
        yield at, to
        at = to


def string_offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    raw = column.buffers()[1]
    if raw is None:
        return np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(raw, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def filled(column: pa.Array) -> pa.Array:
    """The column with nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null("") if column.null_count else column


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of all rows, A-Z lowered, and where each row's words begin.

    The second array has one entry more than there are rows. `column` has no nulls."""
    ends = string_offsets(column)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None and ends[-1] > ends[0] else np.empty(0, np.uint8)
    cuts = ends - ends[0]
    n = len(data)
    if n == 0:
        return np.empty(0, np.uint64), np.zeros(len(cuts), np.int64)
    word = ~_SPACE[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, word[:-1]
    before[cuts[cuts < n]] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, word[1:]
    inner = cuts[(cuts > 0) & (cuts <= n)] - 1
    after[inner] = False
    stops = np.flatnonzero(word & ~after) + 1
    up, down = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    h = (total[stops] - total[starts]) * down[starts]
    h += (stops - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    return mix(h), np.searchsorted(starts, cuts).astype(np.int64)


def checkpoint(df: DataFrame) -> DataFrame:
    """The table cut from its lineage in spark.checkpoint.dir. Where no folder is set, as in tests, a local session gets one of its own; a cluster has to say one."""
    spark = df.sparkSession
    ctx = spark.sparkContext
    if ctx.getCheckpointDir() is None:
        where = ctx.getConf().get("spark.checkpoint.dir")
        if not where and not re.fullmatch(r"local(\[.*\])?", ctx.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        ctx.setCheckpointDir(where or tempfile.mkdtemp(prefix="lodestone-checkpoint-"))
    return df.checkpoint(eager=True)


def draw(*cols: str) -> Column:
    """A 62-bit number of the values, to be held against threshold(); fine enough for any number of rows."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 62))


def threshold(share: float) -> int:
    return min(1 << 62, round(share * (1 << 62)))


def packed(df: DataFrame) -> DataFrame:
    """The table as one column `row`, so that no name of its own can meet a name of an operator's."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


#: Arrow batches of texts in bytes; Spark's default lets one grow to the whole of a usual partition, in the JVM and in Python
BATCH_BYTES = "4m"
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"

#: large caches that operators keep in a Python worker, by operator, each cleared when a task of another one begins or ends there
HELD: dict[str, dict] = {}


def give_back(but: str | None = None) -> None:
    """Return memory to the system, but the cache of operator `but`: Python workers live on, idle, between stages."""
    for name, cache in HELD.items():
        if name != but:
            cache.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim is not None:
        trim(0)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str, operator: str | None = None) -> DataFrame:
    """df.mapInArrow in small batches, whose tasks return memory, but the cache of `operator`, when they begin and end.

    The size of batches is a setting of the session, made here only where the session has none of its own."""
    conf = df.sparkSession.conf
    if _BATCH_KEY not in conf.getAll:
        conf.set(_BATCH_KEY, BATCH_BYTES)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back(but=operator)
        yield from run(batches)
        give_back(but=operator)

    return df.mapInArrow(task, schema)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def components(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(node, root) for every node of an undirected edge table (a, b): root is the smallest node it can reach.

    Alternates large-star and small-star steps (Kiveris and others, 2014). Every step is a minimum with map-side
    combining and an equi-join whose large keys Spark may split, so no neighbour list is ever held together. Each round shortens every
    path, so a few dozen rounds settle the longest ones; `rounds` is only a guard against a table that changes while it is read.

    Defined results. Links with a null end and of a node with itself are left out, repeated ones count once; an empty table
    gives no rows; columns other than a and b are not read."""
    spark = edges.sparkSession

    def star(both: DataFrame, large: bool) -> DataFrame:
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        linked = both.join(low, "a")
        if large:
            return linked.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    now = checkpoint(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = state(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        wide = star(now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))), large=True)
        # small star: each node with its smaller neighbours only
        wide = wide.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        now = checkpoint(star(wide, large=False).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
        then, seen = seen, state(now)
        if then == seen:
            break
    else:
        raise RuntimeError("components did not settle")
    leaves = now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return leaves.unionByName(roots.join(leaves, "node", "left_anti")) if seen[0] else spark.createDataFrame([], "node long, root long")


def find_root(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def all_of(conditions: list) -> object:
    return reduce(lambda a, b: a & b, conditions)
