"""Products of wide matrices, tile by tile.

A matrix is a table of entries (row, column, value), cut into tiles by a block of its rows and a block of its columns; a tile is one row (i, k, t)
with its entries in an array. Two matrices are joined on the block they share, so a joined row is a pair of tiles, which Arrow tasks
multiply: no row exists for a product of two numbers. Partial products of a tile of the result are summed where they meet, as they
stream past; where the shared side has one block there is nothing to sum and no second shuffle.

Few blocks on the shared side would make few join keys, so the left tiles of a block are dealt over `spread` keys by their rows' block and the
right ones repeated for each. Where a result tile is needed no further than its best entries, its pairs of tiles meet in one task instead (`gathered`):
sparse rows times a wide layer have far more partial products than entries. Numbers of the shared side are matched by value, so they may be sparse; what only one side has adds nothing.
Tiles hold at most as many entries as a block of rows times a block of columns. Memory of a task is one result tile and a pair."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDE = 1024
DENSE = 1 / 16
_ENTRIES = "i long, j long, r array<long>, c array<long>, z array<double>"


def by_range(number: Column, side: int = SIDE) -> Column:
    """Blocks of `side` consecutive numbers; -1, which stands for the bias, is in block 0."""
    return F.floor((number + 1) / side)


def by_hash(number: Column, blocks: int) -> Column:
    """Blocks of ids that need not be dense."""
    return F.pmod(F.xxhash64(number), F.lit(blocks))


def cut(entries: DataFrame, row: str, col: str, value: str, row_block: Column, col_block: Column) -> DataFrame:
    """The tiles (i, k, t) of entries."""
    entry = F.struct(F.col(row).cast("long").alias("r"), F.col(col).cast("long").alias("c"), F.col(value).cast("double").alias("v"))
    return entries.groupBy(row_block.cast("long").alias("i"), col_block.cast("long").alias("k")).agg(F.collect_list(entry).alias("t"))


class Tile:
    """A tile's row numbers, column numbers and entries by their places."""

    def __init__(self, t: pa.Array, at: int) -> None:
        lo, hi = t.offsets[at].as_py(), t.offsets[at + 1].as_py()
        r, c, self.v = (t.values.field(k)[lo:hi].to_numpy() for k in range(3))
        self.rows, self.r = np.unique(r, return_inverse=True)
        self.cols, self.c = np.unique(c, return_inverse=True)

    def matrix(self) -> np.ndarray:
        out = np.zeros((len(self.rows), len(self.cols)))
        np.add.at(out, (self.r, self.c), self.v)
        return out


def times(a: Tile, b: Tile) -> np.ndarray:
    """The product of two tiles over the numbers that the columns of one and the rows of the other share."""
    right = b.matrix()
    place = np.minimum(np.searchsorted(b.rows, a.cols), max(0, len(b.rows) - 1))
    shared = b.rows[place] == a.cols if len(b.rows) else np.zeros(len(a.cols), bool)
    if len(a.v) >= DENSE * len(a.rows) * len(a.cols):
        return a.matrix()[:, shared] @ right[place[shared]]
    out = np.zeros((len(a.rows), len(b.cols)))
    keep = np.flatnonzero(shared[a.c])
    keep = keep[np.argsort(a.r[keep], kind="stable")]
    for s in range(0, len(keep), 4096):
        some = keep[s : s + 4096]
        terms = a.v[some, None] * right[place[a.c[some]]]
        begins = np.flatnonzero(np.r_[True, a.r[some][1:] != a.r[some][:-1]])
        out[a.r[some][begins]] += np.add.reduceat(terms, begins, axis=0)
    return out


class Sum:
    """The sum of partial products, whose rows and columns need not be the same ones."""

    def __init__(self) -> None:
        self.rows = self.cols = np.empty(0, np.int64)
        self.z = np.zeros((0, 0))

    def add(self, rows: np.ndarray, cols: np.ndarray, z: np.ndarray) -> None:
        if not (np.array_equal(rows, self.rows) and np.array_equal(cols, self.cols)):
            all_rows, all_cols = np.union1d(self.rows, rows), np.union1d(self.cols, cols)
            wide = np.zeros((len(all_rows), len(all_cols)))
            wide[np.ix_(np.searchsorted(all_rows, self.rows), np.searchsorted(all_cols, self.cols))] = self.z
            self.rows, self.cols, self.z = all_rows, all_cols, wide
        self.z[np.ix_(np.searchsorted(self.rows, rows), np.searchsorted(self.cols, cols))] += z


def product(a: DataFrame, b: DataFrame, inner: int, finish: Callable[[np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch], schema: str, spread: int | None = None, gathered: bool = False) -> DataFrame:
    """finish(rows, columns, values) of every tile of the product of tiles a (i, k, t) and b (i, k, t), where a's k meets b's i.

    inner is the number of blocks of the shared side, as far as known; 1 says that no tile of the result has two parts. What is shuffled to be
    summed are partial products, or, if gathered, the pairs of tiles, which are multiplied where they are summed: a's entries once for each
    block of b's columns."""
    parts = max(1, int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = spread or max(1, -(-parts // max(1, inner)))
    left = a.select("i", F.col("k").alias("m"), F.pmod(F.xxhash64("i"), F.lit(spread)).cast("int").alias("s"), F.col("t").alias("a"))
    right = b.select(F.col("i").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("s"), F.col("k").alias("j"), F.col("t").alias("b"))
    pairs = left.join(right, ["m", "s"]).select("i", "j", "a", "b")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            i, j = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(batch.num_rows):
                x, y = Tile(batch.column(2), at), Tile(batch.column(3), at)
                yield i[at], j[at], x.rows, y.cols, times(x, y)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, rows, cols, z in each(batches):
            yield finish(rows, cols, z)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, j, rows, cols, z in each(batches):
            lists = [pa.array([x.tolist() if x.dtype != np.float64 else x], pa.list_(kind)) for x, kind in ((rows, pa.int64()), (cols, pa.int64()), (z.ravel(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([j], pa.int64()), *lists], names=["i", "j", "r", "c", "z"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, Sum()
        for i, j, rows, cols, z in each(batches):
            if (i, j) != now:
                if now is not None:
                    yield finish(total.rows, total.cols, total.z)
                now, total = (i, j), Sum()
            total.add(rows, cols, z)
        if now is not None:
            yield finish(total.rows, total.cols, total.z)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, Sum()
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for at, key in enumerate(keys):
                if key != now:
                    if now is not None:
                        yield finish(total.rows, total.cols, total.z)
                    now, total = key, Sum()
                rows, cols, z = (batch.column(c)[at].values.to_numpy() for c in (2, 3, 4))
                total.add(rows, cols, z.reshape(len(rows), len(cols)))
        if now is not None:
            yield finish(total.rows, total.cols, total.z)

    if inner == 1:
        return pairs.mapInArrow(whole, schema)
    if gathered:
        return pairs.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(together, schema)
    return pairs.mapInArrow(partial, _ENTRIES).repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(summed, schema)


def multiply(a: DataFrame, b: DataFrame, inner: int, names: tuple[str, str, str]) -> DataFrame:
    """The product's entries (row, column, value) under the given names; a row for each of the result, none for a term."""

    def finish(rows: np.ndarray, cols: np.ndarray, z: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(rows, len(cols))), pa.array(np.tile(cols, len(rows))), pa.array(z.ravel())], names=list(names))

    return product(a, b, inner, finish, f"{names[0]} long, {names[1]} long, {names[2]} double")


def best(a: DataFrame, b: DataFrame, inner: int, names: tuple[str, str, str], decimals: int = 9) -> DataFrame:
    """(row, column, value) of the largest rounded value of each row, of equal ones that of the lowest column. A tile of the result
    leaves its task as one row for each of its rows, never as all its entries."""

    def finish(rows: np.ndarray, cols: np.ndarray, z: np.ndarray) -> pa.RecordBatch:
        z = np.round(z, decimals)
        top = z.argmax(axis=1)
        return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(cols[top]), pa.array(z[np.arange(len(rows)), top])], names=list(names))

    row, col, value = names
    each = product(a, b, inner, finish, f"{row} long, {col} long, {value} double", gathered=True)
    winner = F.max(F.struct(F.col(value).alias("z"), (-F.col(col)).alias("low"))).alias("x")
    return each.groupBy(row).agg(winner).select(row, (-F.col("x.low")).alias(col), F.col("x.z").alias(value))


# --- a layer's products


def blocks(n: int, side: int = SIDE) -> int:
    """How many blocks by_range makes of -1..n-1."""
    return n // side + 1


def forward(x: DataFrame, w: DataFrame, dim: int, records: int, side: int = SIDE) -> tuple[DataFrame, DataFrame, int]:
    """Tiles of activations (record_id, f, v) and of weights (node, f, w), and the blocks of features; `records` is how many blocks the records make."""
    f = by_range(F.col("f"), side)
    return cut(x, "record_id", "f", "v", by_hash(F.col("record_id"), records), f), cut(w, "f", "node", "w", f, by_range(F.col("node"), side)), blocks(dim, side)


def dots(x: DataFrame, w: DataFrame, dim: int, records: int = 1, side: int = SIDE) -> DataFrame:
    """(record_id, node, z): dot products of all records with all nodes."""
    return multiply(*forward(x, w, dim, records, side), ("record_id", "node", "z"))


def predicted(x: DataFrame, w: DataFrame, dim: int, records: int = 1, side: int = SIDE) -> DataFrame:
    """(record_id, predicted): the node of the largest dot product, of equal ones the lowest."""
    return best(*forward(x, w, dim, records, side), ("record_id", "predicted", "z")).select("record_id", "predicted")


def hidden_delta(delta: DataFrame, w: DataFrame, act: DataFrame, nodes: int, records: int = 1, side: int = SIDE) -> DataFrame:
    """(record_id, node, delta) of the layer before, where its activation is above 0."""
    n = by_range(F.col("node"), side)
    a = cut(delta, "record_id", "node", "delta", by_hash(F.col("record_id"), records), n)
    b = cut(w, "node", "f", "w", n, by_range(F.col("f"), side))
    back = multiply(a, b, blocks(nodes, side), ("record_id", "f", "delta"))
    return back.join(act.filter("v > 0").select("record_id", "f"), ["record_id", "f"], "left_semi").select("record_id", F.col("f").alias("node"), "delta")


def gradient(delta: DataFrame, act: DataFrame, records: int = 1, side: int = SIDE) -> DataFrame:
    """(node, f, g): sums of delta times activation over the records."""
    r = by_hash(F.col("record_id"), records)
    a = cut(delta.filter("delta <> 0"), "node", "record_id", "delta", by_range(F.col("node"), side), r)
    b = cut(act.filter("v <> 0"), "record_id", "f", "v", r, by_range(F.col("f"), side))
    return multiply(a, b, records, ("node", "f", "g"))
