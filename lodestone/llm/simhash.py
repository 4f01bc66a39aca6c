"""SimHash near-duplicates by covering locality-sensitive hashing (Pagh 2016).

Fingerprint: A-Z lowered, words [^\\x20\\x09-\\x0D]+, 3-word shingles with repeats joined by one space (fewer words: the
whole sequence; none: zero), XXH64 with seed 42 of each, a bit set where over half the shingles set it.

Join: each bit position is given a non-zero vector of r + 1 bits; for each of the 2**(r+1) - 1 non-zero vectors v, mask v
keeps the positions whose vector has odd inner product with v. The vectors of at most r differing positions leave some v
orthogonal to all of them, so two fingerprints within radius r agree under mask v: no pair can be missed.

Equal fingerprints are one from the start. A bucket of more than MANY fingerprints is dealt out further, and exactly: its
mask leaves under 32 free bits, cut in r + 1 parts of which one must agree, twice over, so a bucket holds few thousand
distinct fingerprints at most whatever the data. Within a bucket only links that join classes leave the task.

Defined results. A null text counts as empty, and has fingerprint zero, which links like any other. Rows with a null
doc_id get a fingerprint and, as they have no id, the component of the rows they link with (null if none has an id).
Repeated rows stay repeated; an empty table gives no rows; other columns are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common

RADIUS, SHINGLE, SEED, MANY = 2, 3, 42, 1000


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of one UTF-8 text, unsigned."""
    words = text.lower().split()  # bytes: A-Z only, and exactly the six ASCII spaces
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.zeros(len(words), np.int64)
    np.cumsum(sizes[:-1] + 1, out=starts[1:])
    stops = starts + sizes
    n = max(1, len(words) - shingle + 1)
    to = stops[shingle - 1 :] if len(words) >= shingle else stops[-1:]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(line[i:j], seed) for i, j in zip(starts[:n].tolist(), to.tolist(), strict=True)], np.uint64, n)
    total = np.zeros(64, np.int64)
    for at in range(0, n, 65536):  # very long texts in blocks
        total += np.unpackbits(h[at : at + 65536].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The kept columns (the id alone if not said) and fp bigint, the fingerprint's 64 bits as a signed number, for every row."""
    src = df.select(*[F.col(f"`{c}`") for c in keep or (id_col,)], F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint((x.as_py() or "").encode()) for x in b.column(b.num_columns - 1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp.view(np.int64))], names=[*b.schema.names[:-1], "fp"])

    from pyspark.sql import types as T

    return common.in_arrow(src, run, T.StructType([*src.schema.fields[:-1], T.StructField("fp", T.LongType())]))


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The covering masks, as unsigned numbers; position i has vector i mod (2**(radius+1) - 1) + 1."""
    vectors = [i % ((1 << (radius + 1)) - 1) + 1 for i in range(bits)]
    return [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() & 1) for v in range(1, 1 << (radius + 1))]


def parts(positions: list[int], n: int) -> list[int]:
    """n masks that share the positions out."""
    return [sum(1 << p for p in positions[i::n]) for i in range(n)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def refinements(radius: int) -> list[tuple[int, int]]:
    """(table, mask) for crowded buckets: each covering mask with one of r + 1 parts of its free bits, then one of r + 1 of the rest."""
    out = []
    for table, m in enumerate(masks(radius)):
        free = [i for i in range(64) if not m >> i & 1]
        for first in parts(free, radius + 1):
            rest = [i for i in free if not first >> i & 1]
            out += [(table, m | first | second) for second in parts(rest, radius + 1)]
    return out


def links(fps: DataFrame, radius: int = RADIUS, many: int = MANY) -> DataFrame:
    """(a, b) of distinct fingerprints within the radius, enough of them to connect every class; fps has one column fp, distinct."""
    first = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(masks(radius))])
    dealt = fps.select("fp", F.explode(first).alias("x")).select("fp", "x.t", "x.key")
    # rows of a key of its own go, before anything is sorted; the join deals large keys out
    crowd = dealt.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    met = dealt.join(crowd, ["t", "key"])
    finer = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, (t, m) in enumerate(refinements(radius))])
    again = F.filter(finer, lambda x: x["t"] == F.col("t"))
    once = F.array(F.struct(F.lit(-1).alias("i"), F.col("t"), F.col("key")))
    keyed = met.select("fp", F.explode(F.when(F.col("n") > many, again).otherwise(once)).alias("x")).select("fp", "x.i", "x.t", "x.key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        now = None
        for b in batches:
            i, t, key = (b.column(c).to_numpy() for c in (1, 2, 3))
            fp = b.column(0).to_numpy().view(np.uint64)
            cuts = np.flatnonzero((i[1:] != i[:-1]) | (t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)], strict=True):
                this = (i[s], t[s], key[s])
                if held and this != now:
                    yield from joined(held)
                    held = []
                now = this
                held.append(fp[s:e])
        if held:
            yield from joined(held)

    def joined(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        a, b = spanning(np.unique(np.concatenate(held)), radius)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    n = common.partitions(fps.sparkSession)
    placed = keyed.repartition(n, "i", "t", "key").sortWithinPartitions("i", "t", "key")
    return common.in_arrow(placed, run, "a long, b long")


def spanning(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within the radius that connect each class of the bucket, found block by block."""
    n = len(x)
    parent = np.arange(n)
    left, right = [], []
    for at in range(0, n - 1, 256):
        rows = x[at : at + 256]
        i, j = np.nonzero(np.bitwise_count(rows[:, None] ^ x[None, at:]) <= radius)
        keep = j > i
        for p, q in zip((i[keep] + at).tolist(), (j[keep] + at).tolist(), strict=True):
            p0, q0 = common.find_root(parent, p), common.find_root(parent, q)
            if p0 != q0:
                parent[max(p0, q0)] = min(p0, q0)
                left.append(p)
                right.append(q)
    return x[left], x[right]


def near_duplicates(df: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id, fp, root) for every row; component_id is the smallest id that links reach, itself included, root the
    smallest fp, which names the class also where no row of it has an id."""
    marked = common.checkpoint(fingerprints(df, id_col, text_col))
    least = marked.groupBy("fp").agg(F.min(id_col).alias("low"))
    roots = common.components(links(least.select("fp"), radius))
    classed = least.join(roots, least.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = classed.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = common.checkpoint(classed.join(lowest, "root").select(F.col("fp").alias("fp2"), "component_id", "root"))
    return marked.join(by_fp, marked.fp == by_fp.fp2, "left").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp", "root")
