"""Document fingerprints by winnowing (Schleimer, Wilkerson, Aiken 2003).

Every run of k code points is hashed; of each window of w hashes the smallest is chosen, the rightmost on a tie, and a
hash chosen again by the next window is kept once. A passage of at least w + k - 1 code points that two texts share
gives both a common hash, and the kept positions say where.

Defined results. A null text counts as empty; an empty text has an empty fingerprint. A text of fewer than k code points
has one gram, itself. Two empty fingerprints have likeness 1, an empty and another 0. Rows with equal doc_id are ordered
by a hash of their text, null ids come before all others, and an id of many rows is spread over many ranges by
that hash (copies of one text under one id stay together, and stream past); an empty table gives no rows. Other columns are not read."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common

#: Code points a gram, and grams a window: every shared passage of 87 code points is caught.
GRAM, WINDOW = 24, 64


def sliding_min(keys: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w keys, by doubling; of all keys when there are fewer."""
    w = min(w, len(keys))
    out, span = keys, 1
    while 2 * span <= w:
        out, span = np.minimum(out[:-span], out[span:]), 2 * span
    return out if span == w else np.minimum(out[: len(out) - (w - span)], out[w - span :])


def winnow(text: str, k: int = GRAM, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the chosen grams, in order of position."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if not len(codes):
        return np.empty(0, np.uint32), np.empty(0, np.uint32)
    high = common.rolling(codes, min(k, len(codes))) >> np.uint64(32)
    keys = (high << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(len(high), dtype=np.uint64))
    best = sliding_min(keys, w)
    best = best[np.concatenate([[True], best[1:] != best[:-1]])]
    return (best >> np.uint64(32)).astype(np.uint32), (np.uint64(0xFFFFFFFF) - (best & np.uint64(0xFFFFFFFF))).astype(np.uint32)


def packed(hashes: np.ndarray, positions: np.ndarray) -> str:
    """Sixteen hex digits for each chosen gram: its hash, then its position."""
    both = np.empty((len(hashes), 2), ">u4")
    both[:, 0], both[:, 1] = hashes, positions
    return both.tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard resemblance of two fingerprints' distinct hashes (both sorted and distinct)."""
    if not len(a) and not len(b):
        return 1.0
    same = len(np.intersect1d(a, b, assume_unique=True))
    return same / (len(a) + len(b) - same)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """(id, n_chars, hashes array<bigint>, positions array<int>) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = common.filled(b.column(1)).to_pylist()
            found = [winnow(t, k, w) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([h.astype(np.int64) for h, _ in found], pa.list_(pa.int64())), pa.array([p.astype(np.int32) for _, p in found], pa.list_(pa.int32()))], names=[id_col, "n_chars", "hashes", "positions"])

    src = df.select(id_col, text_col)
    return src.mapInArrow(run, f"{id_col} {src.schema[0].dataType.simpleString()}, n_chars long, hashes array<bigint>, positions array<int>")


_LEAST = -(1 << 63)


def range_bounds(src: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k, tie, hot) of the first row of each of about n ranges of (k, tie), in order; where an id is not hot its tie is the least number.

    Bounds are quantiles of k. An id that holds several of them (rows without an id are one) is hot: it is cut by its ties, which are hashes,
    into as many ranges, each of which begins with a tie that occurs."""
    shares = ",".join(f"{i / n:.9f}" for i in range(n))
    found = src.selectExpr(f"percentile_approx(k, array({shares}), {max(10_000, 50 * n)}) as b", "min(k) as low").first()
    if found.low is None:
        return np.array([_LEAST], np.int64), np.array([_LEAST], np.int64), np.zeros(1, bool)
    times = Counter(x for x in found.b if x >= found.low)
    times[found.low] += 0
    hot = {k: m for k, m in times.items() if m > 2}
    bounds = [(k, _LEAST, False) for k in times if k not in hot]
    if hot:
        cuts = F.create_map(*[F.lit(x) for k, m in hot.items() for x in (k, m)])
        part = F.floor((F.shiftright("tie", 32) + F.lit(1 << 31)) * cuts[F.col("k")] / F.lit(1 << 32))
        bounds += [(r.k, r.tie, True) for r in src.filter(F.col("k").isin(list(hot))).groupBy("k", part.alias("part")).agg(F.min("tie").alias("tie")).collect()]  # n rows at most
    bounds.sort()
    return np.array([x[0] for x in bounds], np.int64), np.array([x[1] for x in bounds], np.int64), np.array([x[2] for x in bounds], bool)


def with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every text (compressed) in one of many ranges of id and hash of text, each range followed by the first text of the next one.

    Every range begins with its bound, so the rows of that bound alone go to two ranges: of a hot id, one of them for each batch.
    One shuffle of compressed texts; only the bounds, about four times the partitions, reach the driver."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST)).alias("k"), F.xxhash64(text).alias("tie"), F.col(id_col).cast("long").alias("id"), text.alias("t"))
    bk, bt, hot = range_bounds(src, 4 * common.partitions(df.sparkSession))

    def homes(k: np.ndarray, tie: np.ndarray) -> np.ndarray:
        """The last bound at or before each row."""
        home = np.searchsorted(bk, k, "right") - 1
        for x in np.unique(k[hot[home] & (bk[home] == k)]):
            lo, hi = np.searchsorted(bk, x, "left"), np.searchsorted(bk, x, "right")
            mine = np.flatnonzero(k == x)
            home[mine] = lo + np.searchsorted(bt[lo:hi], tie[mine], "right") - 1
        return home

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            for i, j in common.string_chunks(texts := b.column(3), 4 * common.CHUNK_BYTES):
                k, tie = (b.column(c)[i:j].to_numpy(zero_copy_only=False) for c in (0, 1))
                home = homes(k, tie)
                data = [press.compress(x.encode()) for x in texts[i:j].to_pylist()]
                opens = (bk[home] == k) & (~hot[home] | (bt[home] == tie))
                once = np.zeros(j - i, bool)
                once[np.unique(np.where(opens & hot[home], home, -1), return_index=True)[1]] = True
                first = np.flatnonzero(opens & (~hot[home] | once))
                at = np.concatenate([np.arange(j - i), first])
                where = np.concatenate([home, (home[first] - 1) % len(bk)])
                tail = np.concatenate([np.zeros(j - i, bool), np.ones(len(first), bool)])
                yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int32)), pa.array(tail), pa.array(k[at]), pa.array(tie[at]), b.column(2)[i:j].take(pa.array(at)), pa.array([data[x] for x in at], pa.binary())], names=["bucket", "tail", "k", "tie", "id", "z"])

    spread = src.mapInArrow(run, "bucket int, tail boolean, k long, tie long, id long, z binary")
    return spread.repartition(common.partitions(df.sparkSession), "bucket").sortWithinPartitions("bucket", "tail", "k", "tie")


def edited_query(df: DataFrame, k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """op1: each document's fingerprint beside that of its edited text, and their likeness; see the module's text for edge cases."""

    def flush(rows: list[tuple], ends: list[bool]) -> pa.RecordBatch:
        own = [winnow(t, k, w) for _, t in rows]
        sets = [np.unique(h) for h, _ in own]
        out: dict[str, list] = {c: [] for c in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_grams")}
        for i, last in enumerate(ends):
            if last:
                continue
            (doc, t), nxt = rows[i], rows[i + 1][1]
            half = len(t) // 2
            edited = t[: len(t) - half] + nxt[:half]
            there = winnow(edited, k, w)
            for c, v in zip(out, (doc, len(t), hashlib.sha256(edited.encode()).hexdigest(), packed(*own[i]), packed(*there), likeness(sets[i], np.unique(there[0])), likeness(sets[i], sets[i + 1]), len(own[i][0])), strict=True):
                out[c].append(v)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        rows: list[tuple] = []
        ends: list[bool] = []  # whether a row closes its range
        bucket, closed, held = None, False, 0
        for b in batches:
            for where, tail, doc, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(4).to_pylist(), b.column(5), strict=True):
                if where == bucket and closed:
                    continue  # further rows of the id that opens the next range
                text = opener.decompress(z.as_py()).decode() if len(z.as_py()) else ""
                bucket, closed = where, tail
                rows.append((doc, text))
                ends.append(tail)
                held += len(text)
                if held > 2 * common.CHUNK_BYTES:
                    yield flush(rows, [*ends[:-1], True])
                    rows, ends, held = ([], [], 0) if tail else (rows[-1:], ends[-1:], len(text))
        if len(rows) > 1:
            yield flush(rows, [*ends[:-1], True])

    return with_next(df, "doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_grams long")
