"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine >= c have squared distance at most 2(1 - c). They are rotated by a seeded orthogonal matrix and
cut into blocks of about BLOCK dimensions; a block of d of D dimensions has the budget 2(1 - c) d / D, and of two vectors
within the whole distance at least one block is within its budget. So each block is range-joined under its own budget,
and each candidate is verified by its cosine in double precision.

Range join of a block: a k-d tree, built from a sample, gives boxes, whose number grows with the rows: one for each chunk of
them, as far as a sample of PER_LEAF vectors a leaf fits the driver's bound (SAMPLE_CELLS components). The vectors of a box are
cut into chunks of about CHUNK, so no box is too large for a task. Each vector goes home to its own chunk and, as a guest,
to each later chunk whose box is within the block's radius of it, found by descending the tree and leaving out each branch
beyond the radius. The home vectors of a chunk stay in memory and its guests stream past. The tree only routes; its sample changes no result.

Vectors are scaled by powers of two first, so very large and very small ones link like others.

Pairs are never written out: a task returns each vector's number of partners and the links that connect its classes. A
pair found in several blocks counts in the first one; block distances are of coordinates rounded to 2**-20, so they are
exact numbers, equal in every task. Equal vectors are one vector with a weight.

Defined results. A vector that is null, empty, zero, or holds null or non-finite components, and a row with a null id,
links with nothing. Vectors of different lengths do not link. Repeated rows count as separate vectors. An empty table
gives no rows; other columns are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common

BLOCK, CHUNK, SEED = 16, 4096, 7
LEAST_SAMPLE, PER_LEAF, SAMPLE_CELLS = 16384, 8, 1 << 23
GRID, SLACK = float(1 << 20), 1e-5


def levelled(x: np.ndarray) -> np.ndarray:
    """The vectors by powers of two that bring each one's largest component near 1, so that no square leaves the doubles' range. Cosines stay."""
    top = np.frexp(np.abs(x).max(axis=1, initial=0))[1]
    return np.ldexp(x, -top[:, None])


def sample_size(dim: int, rows: int, chunk: int) -> int:
    """How many vectors of one length to build the trees from: PER_LEAF for each chunk of rows, at most SAMPLE_CELLS components in all."""
    return max(1, min(SAMPLE_CELLS // dim, max(LEAST_SAMPLE, PER_LEAF * -(-rows // chunk))))


class Plan:
    """The rotation, the blocks and the trees for vectors of one length."""

    def __init__(self, dim: int, cosine: float, sample: np.ndarray, rows: int, chunk: int) -> None:
        self.dim, self.cosine = dim, cosine
        q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
        self.turn = q * np.sign(np.diag(r))
        n = max(1, round(dim / BLOCK))
        edges = np.linspace(0, dim, n + 1).round().astype(int)
        self.blocks = [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]
        whole = 2 * (1 - cosine)
        self.budget = [whole * (b.stop - b.start) / dim + SLACK for b in self.blocks]
        depth = int(np.ceil(np.log2(max(1.0, min(rows / chunk, len(sample) / PER_LEAF)))))
        seen = self.rotated(sample)[1] / GRID if len(sample) else np.zeros((1, dim))
        self.trees = [self._tree(seen[:, b], depth) for b in self.blocks]
        self.first: list[np.ndarray] = []  # of each block and leaf, its first chunk's number; set by chunks()

    def rotated(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Norms, and the rotated unit vectors on the grid."""
        norm = np.sqrt((x * x).sum(axis=1))
        return norm, np.rint((x / norm[:, None]) @ self.turn * GRID)

    @staticmethod
    def _tree(points: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """The nodes' axes and cuts, level by level; a point goes to the second branch if it is not below the cut."""
        groups, levels = [points], []
        for _ in range(depth):
            axis = [int(g.var(axis=0).argmax()) if len(g) else 0 for g in groups]
            cut = [float(np.median(g[:, a])) if len(g) else 0.0 for g, a in zip(groups, axis, strict=True)]
            levels.append((np.array(axis), np.array(cut)))
            groups = [g[(g[:, a] >= c) == bool(side)] for g, a, c in zip(groups, axis, cut, strict=True) for side in (0, 1)]
        return levels

    def leaf(self, block: int, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), np.int64)
        for axis, cut in self.trees[block]:
            at = 2 * at + (points[np.arange(len(points)), axis[at]] >= cut[at])
        return at

    def near(self, block: int, points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, points): the leaves whose boxes are within the block's radius of some points, and which."""
        levels = self.trees[block]
        waiting = [(0, 0, np.arange(len(points)), np.zeros_like(points))]
        while waiting:
            level, node, at, off = waiting.pop()
            if level == len(levels):
                yield node, at
                continue
            axis, cut = levels[level][0][node], levels[level][1][node]
            over = points[at, axis] - cut
            for side, beyond in ((0, over), (1, -over)):  # beyond: how far a point lies outside this branch, if above zero
                far = off.copy()
                far[:, axis] = np.maximum(far[:, axis], beyond)
                within = (far * far).sum(axis=1) <= self.budget[block] + SLACK
                if within.any():
                    waiting.append((level + 1, 2 * node + side, at[within], far[within]))

    def chunks(self, counts: dict[tuple[int, int], int], chunk: int, start: int) -> int:
        """Numbers the chunks from start on; returns the next free number."""
        self.first = []
        for b in range(len(self.blocks)):
            n = [max(1, -(-counts.get((b, leaf), 0) // chunk)) for leaf in range(1 << len(self.trees[b]))]
            self.first.append(start + np.concatenate([[0], np.cumsum(n)]))
            start = int(self.first[-1][-1])
        return start

    def route(self, uid: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, chunk, guest) for each place a row goes to."""
        rows, units, guests = [], [], []
        salt = common.mix(uid.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        for b, cols in enumerate(self.blocks):
            p, first = grid[:, cols] / GRID, self.first[b]
            home = self.leaf(b, p)
            own = first[home] + (salt % (first[home + 1] - first[home]).astype(np.uint64)).astype(np.int64)
            rows.append(np.arange(len(p)))
            units.append(own)
            guests.append(np.zeros(len(p), bool))
            for leaf, at in self.near(b, p):
                low = np.maximum(own[at] + 1, first[leaf])  # each pair of chunks meets in the later one
                n = np.maximum(first[leaf + 1] - low, 0)
                rows.append(np.repeat(at, n))
                units.append(np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum()))
                guests.append(np.ones(n.sum(), bool))
        return np.concatenate(rows), np.concatenate(units), np.concatenate(guests)

    def block_of(self, unit: int) -> int:
        return next(b for b, f in enumerate(self.first) if unit < f[-1])


class Side:
    """Vectors of one side of a block join."""

    def __init__(self, plan: Plan, block: int, uid: np.ndarray, weight: np.ndarray, x: np.ndarray) -> None:
        self.uid, self.weight, self.x = uid, weight, x
        self.norm, self.grid = plan.rotated(x)
        p = (self.grid[:, plan.blocks[block]] / GRID).astype(np.float32)
        square, one = (p * p).sum(axis=1), np.ones(len(p), np.float32)
        self.left, self.right = np.column_stack([p, square, one]), np.column_stack([-2 * p, one, square])
        self.count = np.zeros(len(uid), np.int64)


def linked(plan: Plan, block: int, a: Side, b: Side, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs that link and whose first block within budget is this one; of one side with itself, each once."""
    limit = plan.budget[block]
    for at in range(0, len(a.uid), 512):
        tile = a.left[at : at + 512] @ b.right.T
        i, j = np.nonzero(tile <= limit + 1e-4)
        i += at
        if same:
            i, j = i[j > i], j[j > i]
        for s in range(0, len(i), 1 << 16):
            p, q = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
            cos = (a.x[p] * b.x[q]).sum(axis=1) / (a.norm[p] * b.norm[q])
            p, q = p[cos >= plan.cosine], q[cos >= plan.cosine]
            if not len(p):
                continue
            off = a.grid[p] - b.grid[q]
            off *= off
            within = [off[:, c].sum(axis=1) <= t * GRID * GRID for c, t in zip(plan.blocks[: block + 1], plan.budget, strict=False)]
            mine = within[-1] & ~np.any(within[:-1], axis=0) if block else within[-1]
            if mine.any():
                yield p[mine], q[mine]


def near_duplicates(df: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", chunk: int = CHUNK) -> DataFrame:
    """(id, n_links, component_id, kept) for every row."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias(id_col), F.col(vector_col).cast("array<double>").alias("v"))
    x = F.col("v")
    usable = F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(x, lambda c: c != 0.0)
    distinct = common.checkpoint(rows.filter(F.coalesce(usable, F.lit(False))).groupBy("v").agg(F.min(id_col).alias("low"), F.count("*").alias("n")).withColumn("uid", F.monotonically_increasing_id()))
    sizes = {r.d: r.c for r in distinct.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("c")).collect()}  # as many rows as there are lengths
    plans: dict[int, Plan] = {}
    for dim, n in sorted(sizes.items()):
        size = sample_size(dim, n, chunk)
        some = distinct.filter(F.size("v") == dim).filter(common.draw("uid") < common.threshold(min(1.0, size / n))).limit(size)
        sample = some.select("v").toArrow().column(0).combine_chunks()  # SAMPLE_CELLS components at most
        plans[dim] = Plan(dim, cosine, levelled(sample.flatten().to_numpy().reshape(-1, dim)), n, chunk)

    def vectors(b: pa.RecordBatch, col: int) -> tuple[np.ndarray, np.ndarray]:
        flat = b.column(col)
        return flat.flatten().to_numpy(), np.diff(flat.offsets.to_numpy())

    def by_length(b: pa.RecordBatch, col: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        flat, sizes_ = vectors(b, col)
        starts = np.concatenate([[0], np.cumsum(sizes_)])
        for dim in np.unique(sizes_):
            at = np.flatnonzero(sizes_ == dim)
            yield int(dim), at, levelled(flat[starts[at][:, None] + np.arange(dim)[None, :]])

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], int] = {}
        for b in batches:
            for dim, _, v in by_length(b, 0):
                plan = plans[dim]
                grid = plan.rotated(v)[1] / GRID
                for k, cols in enumerate(plan.blocks):
                    leaf, n = np.unique(plan.leaf(k, grid[:, cols]), return_counts=True)
                    for x_, c in zip(leaf.tolist(), n.tolist(), strict=True):
                        total[dim, k, x_] = total.get((dim, k, x_), 0) + c
        keys = np.array(list(total), np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([*(pa.array(keys[:, i]) for i in range(3)), pa.array(list(total.values()), pa.int64())], names=["d", "b", "leaf", "c"])

    counts: dict[int, dict[tuple[int, int], int]] = {}
    for r in distinct.select("v").mapInArrow(homes, "d long, b long, leaf long, c long").groupBy("d", "b", "leaf").agg(F.sum("c").alias("c")).collect():  # a row for each leaf of a block
        counts.setdefault(r.d, {})[r.b, r.leaf] = r.c
    top = 0
    for dim, plan in plans.items():
        top = plan.chunks(counts.get(dim, {}), chunk, top)
    lengths = [(int(p.first[0][0]), dim) for dim, p in plans.items()]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                uid, n = part.column(0).to_numpy(), part.column(1).to_numpy()
                for dim, who, v in by_length(part, 2):
                    row, unit, guest = plans[dim].route(uid[who], plans[dim].rotated(v)[1])
                    order = np.argsort(row, kind="stable")
                    row, unit, guest = row[order], unit[order], guest[order]
                    raw = [r.tobytes() for r in v]
                    for s in range(0, len(row), 20000):
                        r_ = row[s : s + 20000]
                        yield pa.RecordBatch.from_arrays([pa.array(unit[s : s + 20000]), pa.array(guest[s : s + 20000]), pa.array(uid[who][r_]), pa.array(n[who][r_]), pa.array([raw[k] for k in r_], pa.binary())], names=["unit", "guest", "uid", "n", "v"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, plan, block, home, parent = -1, None, 0, None, np.empty(0, np.int64)
        waiting: list[pa.RecordBatch] = []

        def result(uid: np.ndarray, n: np.ndarray, other: np.ndarray | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(n, pa.int64()), pa.nulls(len(uid), pa.int64()) if other is None else pa.array(other, pa.int64())], names=["uid", "links", "other"])

        def side(parts: list[pa.RecordBatch]) -> Side:
            t = pa.Table.from_batches(parts)
            raw = b"".join(t.column(4).to_pylist())
            return Side(plan, block, t.column(2).to_numpy(), t.column(3).to_numpy(), np.frombuffer(raw, np.float64).reshape(-1, plan.dim))

        def settle() -> None:
            nonlocal home, parent, waiting
            if home is None and waiting:
                home, waiting = side(waiting), []
                parent = np.arange(len(home.uid))
                for p, q in linked(plan, block, home, home, same=True):
                    np.add.at(home.count, p, home.weight[q])
                    np.add.at(home.count, q, home.weight[p])
                    merge(p, q)

        def merge(p: np.ndarray, q: np.ndarray) -> None:
            for s, e in zip(p.tolist(), q.tolist(), strict=True):
                s, e = common.find_root(parent, s), common.find_root(parent, e)
                parent[max(s, e)] = min(s, e)

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal home
            settle()
            if home is not None:
                roots = np.array([common.find_root(parent, k) for k in range(len(parent))])
                got = np.flatnonzero(home.count > 0)
                yield result(home.uid[got], home.count[got], None)
                tied = np.flatnonzero(roots != np.arange(len(roots)))
                yield result(home.uid[tied], np.zeros(len(tied), np.int64), home.uid[roots[tied]])
            home = None

        for b in batches:
            unit, guest = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((unit[1:] != unit[:-1]) | (guest[1:] != guest[:-1])) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(unit)], strict=True):
                if unit[s] != now:
                    yield from close()
                    now = int(unit[s])
                    plan = plans[max(x_ for x_ in lengths if x_[0] <= now)[1]]
                    block = plan.block_of(now)
                if not guest[s]:
                    waiting.append(b.slice(s, e - s))
                    continue
                settle()
                if home is None:
                    continue  # no vector lives in this chunk
                for at in range(s, e, 4096):
                    other = side([b.slice(at, min(4096, e - at))])
                    tied_to = np.full(len(other.uid), -1)
                    for p, q in linked(plan, block, home, other, same=False):
                        np.add.at(home.count, p, other.weight[q])
                        np.add.at(other.count, q, home.weight[p])
                        new = tied_to[q] < 0
                        tied_to[q[new]] = p[new]
                        merge(p, tied_to[q])
                    got = np.flatnonzero(tied_to >= 0)
                    if len(got):
                        yield result(other.uid[got], other.count[got], home.uid[tied_to[got]])
        yield from close()

    dealt = distinct.select("uid", "n", "v").mapInArrow(deal, "unit long, guest boolean, uid long, n long, v binary")
    found = common.checkpoint(dealt.repartition(common.partitions(spark), "unit").sortWithinPartitions("unit", "guest").mapInArrow(join, "uid long, links long, other long"))
    counted = found.groupBy("uid").agg(F.sum("links").alias("links"))
    roots = common.components(found.filter("other is not null").select(F.col("uid").alias("a"), F.col("other").alias("b")))
    whole = distinct.join(counted, "uid", "left").join(roots, F.col("uid") == F.col("node"), "left").select("v", "low", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "uid").alias("root"))
    lowest = whole.groupBy("root").agg(F.min("low").alias("component_id"))
    by_vector = common.checkpoint(whole.join(lowest, "root").select(F.col("v").alias("v2"), "n_links", "component_id"))
    alone = rows.withColumn("v", F.when(F.coalesce(usable, F.lit(False)), x))
    return alone.join(by_vector, F.col("v") == F.col("v2"), "left").select(
        id_col, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", id_col).alias("component_id"), (F.coalesce("component_id", id_col) == F.col(id_col)).alias("kept")
    )
