"""Hard negatives by bit-sliced integer products.

Vectors are quantised to integers, x -> floor(scale * x), and packed in blocks of rows as bit-planes: plane j of a block
holds bit j of every component (two's complement), one bit a component. The integer product of an anchor with a
row is the weighted sum of its products with the row's planes. Planes are taken most significant first; after each one a row's score lies
in an interval, whose width is what the planes left could still add: (2**j - 1) times the sum of the anchor's negative, and of its positive
components. A row goes as soon as its interval can't qualify: its upper end is under the anchor's k-th best score so far or
under every window's lower end, or its lower end is over all windows. Planes are multiplied for the whole block while many rows are left
and for the pairs that are left afterwards, so scores that remain are exact when the planes end.

Two passes, each over all rows: the first finds an anchor's positives, the second the negatives in each positive's window. In both,
a unit of work is a group of about GROUP anchors with a slice of the blocks; anchors are dealt by a hash of their place in
the table, blocks by their number, so no label, id or score decides a task's size. A unit keeps k rows for each
anchor (and positive) and streams the blocks past; the few best of the units are ranked in the end.

Defined results. Rows with a null id, label or vector, an empty vector, a null or non-finite component, or components so
large that length * max**2 of the quantised ones exceeds 2**59 (their scores need not fit a long) take no part. Vectors
of different lengths don't meet. Rows that share an id are separate rows; of several with one score and id any one
stands for the others, as the result shows only these. Anchors without a positive, and positives without a negative, give no
rows; a negative score of a positive leaves its window empty. An empty table gives no rows; other columns are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import common

SCALE, POSITIVES, NEGATIVES, MARGIN = 256, 5, 5, 80
#: rows of a block, anchors of a group, share of a block's pairs under which they are taken one by one
BLOCK, GROUP, SPARSE = 2048, 512, 1 / 16
#: bits of a row's place in its block, of a block's place in its partition
ROW_BITS, BLOCK_BITS = 11, 20
_PACKED = "d int, n int, ids binary, labels binary, planes binary"
_LOWEST = np.iinfo(np.int64).min


def quantised(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(vector: Column, scale: int = SCALE) -> Column:
    """Whether the vector's scores are defined and fit a long."""
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    top = F.aggregate(vector, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(F.floor(F.lit(float(scale)) * x).cast("double"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & (top < 2.0**31) & (F.size(vector) * top * top <= 2.0**59), F.lit(False))


def sliced(q: np.ndarray) -> np.ndarray:
    """Packed bit-planes of integer vectors, most significant (the sign) first: planes x rows x ceil(length / 8) bytes."""
    width = int(max(int(q.max()), -int(q.min()) - 1, 0)).bit_length() + 1
    return np.stack([np.packbits((q >> np.int64(j)).astype(np.uint8) & 1, axis=1) for j in range(width - 1, -1, -1)])


def pack(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks of at most `block` rows (id, label, q) of one length with their bit-planes, and the block's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(d: int) -> pa.RecordBatch:
            parts = held.pop(d)
            ids, labels, q = (np.concatenate([p[i] for p in parts]) for i in range(3))
            values = [[d], [len(ids)], [ids.tobytes()], [labels.tobytes()], [sliced(q).tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["d", "n", "ids", "labels", "planes"])

        for b in batches:
            flat = b.column(2)
            offsets, values = flat.offsets.to_numpy(), flat.values.to_numpy()
            ids, labels, sizes = b.column(0).to_numpy(), b.column(1).to_numpy(), np.diff(offsets)
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                while len(at):
                    have = sum(len(p[0]) for p in held.get(d, []))
                    now, at = at[: block - have], at[block - have :]
                    held.setdefault(d, []).append((ids[now], labels[now], values[offsets[now][:, None] + np.arange(d)[None, :]]))
                    if have + len(now) == block:
                        yield out(d)
        for d in list(held):
            yield out(d)

    # partition and place of the block, closer together than monotonically_increasing_id has them
    place = F.monotonically_increasing_id()
    return common.in_arrow(rows, run, _PACKED).withColumn("block", F.shiftleft(F.shiftright(place, 33), BLOCK_BITS) + place.bitwiseAND((1 << 33) - 1))


def bits(planes: bytes, n: int, d: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(planes, np.uint8).reshape(-1, n, (d + 7) // 8), axis=2, count=d)


def integers(planes: bytes, n: int, d: int) -> np.ndarray:
    b = bits(planes, n, d)
    out = -b[0].astype(np.int64)
    for plane in b[1:]:
        out = 2 * out + plane
    return out


def progressive(a: np.ndarray, rows: np.ndarray, alive: np.ndarray, low: np.ndarray, high: np.ndarray, k: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the pairs in `alive` whose score lies between the anchor's `low` and `high`.

    With k, an anchor's k-th largest lower end also raises its low: what lies under it is not among its k best."""
    width = len(rows)
    less, more = np.minimum(a, 0).sum(axis=1), np.maximum(a, 0).sum(axis=1)
    exact = a.astype(np.float64)
    total = np.zeros(alive.shape, np.int64)
    low = low.copy()
    for at in range(width):
        rest = width - 1 - at
        total += ((exact @ rows[at].T.astype(np.float64)).astype(np.int64) << rest) * (1 if at else -1)
        span = (1 << rest) - 1
        if k and alive.shape[1] >= k:
            certain = np.where(alive, total, _LOWEST)
            kth = np.partition(certain, -k, axis=1)[:, -k]
            low = np.maximum(low, np.where(kth == _LOWEST, _LOWEST, kth + span * less))
        # the ends are taken to the other side, where nothing can overflow
        alive &= total >= np.where(low == _LOWEST, low, low - span * more)[:, None]
        alive &= total <= (high - span * less)[:, None]
        if rest and alive.sum() < SPARSE * alive.size:
            break
    i, j = np.nonzero(alive)
    score = total[i, j]
    for at in range(at + 1, width):
        rest = width - 1 - at
        if len(i):
            dot = np.empty(len(i), np.int64)
            for s in range(0, len(i), 1 << 14):
                dot[s : s + (1 << 14)] = (a[i[s : s + (1 << 14)]] * rows[at][j[s : s + (1 << 14)]]).sum(axis=1)
            score += dot << rest
        span = (1 << rest) - 1
        keep = (score + span * more[i] >= low[i]) & (score + span * less[i] <= high[i])
        i, j, score = i[keep], j[keep], score[keep]
    return i, j, score


def best(slot: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the k best of their slot, by score and then smaller id; ordered by slot and rank."""
    order = np.lexsort((ids, -score, slot))
    s = slot[order]
    first = np.r_[True, s[1:] != s[:-1]] if len(s) else np.empty(0, bool)
    begins = np.flatnonzero(first)
    rank = np.arange(len(s)) - np.repeat(begins, np.diff(np.r_[begins, len(s)]))
    return order[rank < k]


class Group:
    """The anchors of a unit, with what is best for each so far."""

    def __init__(self, parts: list[pa.RecordBatch], d: int, k: int) -> None:
        t = pa.Table.from_batches(parts)
        self.k, self.uid, self.label = k, t.column("uid").to_numpy(), t.column("label").to_numpy()
        self.a = np.frombuffer(b"".join(t.column("q").to_pylist()), np.int64).reshape(-1, d)
        lists = t.column("windows").to_pylist()
        #: of each window its anchor, its place in the anchor's list, and its ends; none in the first pass
        self.of = np.array([i for i, x in enumerate(lists) for _ in x or ()], np.int64)
        self.place = np.array([p for x in lists for p, _ in enumerate(x or ())], np.int64)
        self.high = np.array([v for x in lists for v in x or ()], np.int64)
        self.low = -((-MARGIN * self.high) // 100)
        self.slots = len(self.of) if lists[0] is not None else len(self.uid)
        self.slot, self.score, self.ids = (np.empty(0, np.int64) for _ in range(3))

    def kth(self) -> np.ndarray:
        """The k-th best score of each slot, the lowest number if it has fewer."""
        out = np.full(self.slots, _LOWEST)
        full = np.bincount(self.slot, minlength=self.slots) == self.k
        np.minimum.at(worst := np.full(self.slots, np.iinfo(np.int64).max), self.slot, self.score)
        out[full] = worst[full]
        return out

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slot, score, ids = np.r_[self.slot, slot], np.r_[self.score, score], np.r_[self.ids, ids]
        keep = best(slot, score, ids, self.k)
        self.slot, self.score, self.ids = slot[keep], score[keep], ids[keep]

    def positives(self, block: int, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> None:
        alive = self.label[:, None] == labels[None, :]
        own = np.flatnonzero(self.uid >> ROW_BITS == block)  # an anchor is not its own positive
        alive[own, self.uid[own] & ((1 << ROW_BITS) - 1)] = False
        some = np.flatnonzero(alive.any(axis=1))
        if len(some):
            i, j, score = progressive(self.a[some], rows, alive[some], self.kth()[some], np.full(len(some), 1 << 62), self.k)
            self.add(some[i], score, ids[j])

    def negatives(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> None:
        low, high = np.full(len(self.uid), 1 << 62), np.full(len(self.uid), -(1 << 62))
        np.minimum.at(low, self.of, np.maximum(self.low, self.kth()))
        np.maximum.at(high, self.of, self.high)
        i, j, score = progressive(self.a, rows, self.label[:, None] != labels[None, :], low, high)
        begins = np.searchsorted(self.of, np.arange(len(self.uid) + 1))
        for p in range(int(self.place.max(initial=-1)) + 1):
            mine = begins[i] + p < begins[i + 1]
            w = (begins[i] + p)[mine]
            fits = (score[mine] >= self.low[w]) & (score[mine] <= self.high[w])
            self.add(w[fits], score[mine][fits], ids[j[mine][fits]])

    def result(self) -> pa.RecordBatch:
        anchor, place = (self.of[self.slot], self.place[self.slot]) if len(self.of) else (self.slot, np.zeros(len(self.slot), np.int64))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (self.uid[anchor], place, self.ids, self.score)], names=["uid", "place", "other", "score"])


def scan(blocks: DataFrame, anchors: DataFrame, groups: int, slices: int, k: int) -> DataFrame:
    """(uid, place, other, score): of each unit the k best rows of its anchors, or of each of their windows."""
    one = F.lit(None)
    left = anchors.select("g", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("s"), "d", F.lit(False).alias("is_block"), "uid", "label", "q", "windows", *[one.cast(t).alias(c) for c, t in (("n", "int"), ("ids", "binary"), ("labels", "binary"), ("planes", "binary"))])
    right = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int").alias("s"), "d", F.lit(True).alias("is_block"), F.col("block").alias("uid"), one.cast("long").alias("label"), one.cast("binary").alias("q"), one.cast("array<long>").alias("windows"), "n", "ids", "labels", "planes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, group = None, [], None
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in ("g", "s", "d")), strict=True))
            is_block = b.column("is_block").to_pylist()
            for r, (key, packed) in enumerate(zip(keys, is_block, strict=True)):
                if key != now:
                    if group is not None:
                        yield group.result()
                    now, waiting, group = key, [], None
                if not packed:
                    waiting.append(b.slice(r, 1))
                    continue
                if group is None:
                    if not waiting:
                        continue  # no anchor of this length in the group
                    group, waiting = Group(waiting, key[2], k), []
                n, ids, labels, planes = (b.column(c)[r].as_py() for c in ("n", "ids", "labels", "planes"))
                ids, labels, rows = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), bits(planes, n, key[2])
                if len(group.of):
                    group.negatives(ids, labels, rows)
                else:
                    group.positives(b.column("uid")[r].as_py(), ids, labels, rows)
        if group is not None:
            yield group.result()

    placed = left.unionByName(right).repartition(common.partitions(blocks.sparkSession), "g", "s").sortWithinPartitions("g", "s", "d", "is_block")
    return common.in_arrow(placed, run, "uid long, place long, other long, score long")


def mine(df: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of df for which is_anchor, a condition on `id`, holds."""
    v = F.col("v")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(v, scale)).select("id", "label", quantised(v, scale).alias("q"))
    blocks = common.checkpoint(pack(rows))
    flags = "uid long, id long, label long, d int, q binary"

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                d, n, ids, labels, planes, block = (b.column(c)[r].as_py() for c in ("d", "n", "ids", "labels", "planes", "block"))
                ids, q = np.frombuffer(ids, np.int64), integers(planes, n, d)
                yield pa.RecordBatch.from_arrays([pa.array((block << ROW_BITS) + np.arange(n)), pa.array(ids), pa.array(np.frombuffer(labels, np.int64)), pa.array(np.full(n, d, np.int32)), pa.array([x.tobytes() for x in q], pa.binary())], names=["uid", "id", "label", "d", "q"])

    chosen = common.checkpoint(common.in_arrow(blocks, unpack, flags).filter(is_anchor))
    n = chosen.count()
    groups = max(1, -(-n // GROUP))
    slices = max(1, -(-4 * common.partitions(df.sparkSession) // groups))
    placed = chosen.withColumn("g", F.pmod(F.xxhash64("uid"), F.lit(groups)).cast("int"))

    def ranked(found: DataFrame, k: int, *slot: str) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(Window.partitionBy(*slot).orderBy(F.desc("score"), "other"))).filter(F.col("rank") <= k)

    best_first = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("low"), "other")))
    near = scan(blocks, placed.withColumn("windows", F.lit(None).cast("array<long>")), groups, slices, POSITIVES)
    # at most POSITIVES entries an anchor
    positives = ranked(near, POSITIVES, "uid").groupBy("uid").agg(best_first.alias("p"))
    anchors = common.checkpoint(placed.join(positives, "uid").withColumn("windows", F.transform("p", lambda x: -x["low"])))
    far = ranked(scan(blocks, anchors, groups, slices, NEGATIVES), NEGATIVES, "uid", "place")
    of = anchors.select("uid", F.col("id").alias("anchor_id"), F.posexplode("p").alias("place", "p"))
    return far.withColumn("place", F.col("place").cast("int")).join(of, ["uid", "place"]).select(
        "anchor_id", F.col("p.other").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), (-F.col("p.low")).alias("positive_score"), F.col("score").alias("negative_score")
    )


def query(df: DataFrame) -> DataFrame:
    """op11: the contract's label noise, then the hard negatives of the rows whose id is divisible by 100."""
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(df.select("vec_id", "embedding", noisy.alias("label")), F.col("id") % 100 == 0)


ORACLE = """
with rows as (
  select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
products as (
  select a.id as anchor_id, b.id as other, a.label = b.label as same, list_inner_product(a.q, b.q)::bigint as score
  from rows a join rows b on a.id % 100 = 0 and a.id <> b.id and len(a.q) = len(b.q)),
positives as (
  select anchor_id, other as positive_id, score as positive_score from products where same
  qualify row_number() over (partition by anchor_id order by score desc, other) <= 5),
met as (
  select p.*, n.other as negative_id, n.score as negative_score,
    row_number() over (partition by p.anchor_id, p.positive_id order by n.score desc, n.other) as rank
  from positives p join products n on p.anchor_id = n.anchor_id and not n.same
  where 80 * positive_score <= 100 * n.score and n.score <= positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from met where rank <= 5"""
