"""Repeated passages across documents by collinear chaining.

Seeds: the winnowed k-word grams of each text (every run of WINDOW + GRAM - 1 words has one), at all their places, and each seed
together with the next one, which every exact run of LEAST words has. A seed or pair that occurs in several documents links
each occurrence to the first in the smallest doc_id, so n occurrences make fewer than n links, not n squared. Pairs tell
passages from their parts: where each seed of a passage occurs in some smaller document, those across two parts don't. Links of a document pair are chained: in order of place, the best chain that
ends in a link is found among the links at most GAP words before it in both texts, each link worth its words, less a cost for each word
of gap in either text: a Fenwick tree over places in the second text, in which links stay for as long as they lie within the gap in the first,
gives the largest of a range. Chains of one diagonal are joined where the words between them agree too (their seeds may have smaller
documents). Then the words of both texts around each chain are aligned: exactly between links, by edit distance where they differ, and along the
diagonal beyond the ends until the score has dropped, for BEYOND words at most: what lies further has links of its own, to this or a smaller document. Every stretch of that alignment of at least LEAST words a side and LIKE of words in common is kept, so a chain over
passages with other words between them gives a row for each of them.

Result: one row per passage of a document that a document of smaller doc_id has too: doc_id, ref_doc_id, places in words
(ends exclusive), matched words, identity. Membership of a passage is by its ref; two documents with a passage of a third
link through it. Of a pair's rows, one inside another in the document is that passage again, as in texts of one line many times
over, and left out, and so are its overlapping places that others cover; copies at other places of the document have rows of their own. Where parts of one passage have different smallest documents, each part is extended by alignment.

Defined results. Null texts and rows with a null id have no passages. Rows that share an id but not a text are documents of their own, which
may be each other's ref; rows equal in both are one document. Repeats inside one document are not reported. Words are [^\\x20\\x09-\\x0D]+ with A-Z lowered. An empty table gives
no rows; texts are read whole; only the id and text columns are read."""

from __future__ import annotations

import bisect
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common
from lodestone.llm.winnowing import sliding_min

GRAM, WINDOW, LEAST, LIKE, GAP, BEYOND = 8, 16, 50, 0.8, 40, 96
COST, DROP = 0.1, 12.0


def seeds_of(h: np.ndarray, k: int = GRAM, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of a text's seeds, in order of place; h are its words' hashes."""
    if len(h) < k:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    place = np.arange(len(h))
    begins = np.concatenate([[True], h[1:] != h[:-1]])
    run = place - np.maximum.accumulate(np.where(begins, place, 0))  # a word's place in a run of itself, so that such runs have grams of their own
    full = common.rolling(np.where(run > 0, h + run.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25), h), k)
    if not len(full):
        return full, np.empty(0, np.int64)
    keys = (full & ~np.uint64(0xFFFFFFFF)) | (np.uint64(0xFFFFFFFF) - np.arange(len(full), dtype=np.uint64))
    best = sliding_min(keys, w)
    at = np.unique((np.uint64(0xFFFFFFFF) - (best & np.uint64(0xFFFFFFFF))).astype(np.int64))
    return full[at], at


def keys_of(h: np.ndarray, k: int = GRAM, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, places, whether it is the key's first place): a text's seeds, then each seed together with the next one, at the first one's place."""
    full, at = seeds_of(h, k, w)
    keys = np.concatenate([full, common.rolling(full, 2)])
    first = np.zeros(len(keys), bool)
    first[np.unique(keys, return_index=True)[1]] = True
    return keys, np.concatenate([at, at[:-1]]), first


def seeds(docs: DataFrame, k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """(h, doc, pos, first) of all seeds and pairs of seeds; docs has doc and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, doc = common.filled(b.column(1)), b.column(0).to_numpy()
            for s, e in common.string_chunks(text):
                h, cuts = common.word_hashes(text[s:e])
                found = [keys_of(h[i:j], k, w) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                n = np.array([len(f[1]) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[0] for f in found]).view(np.int64)), pa.array(np.repeat(doc[s:e], n)), pa.array(np.concatenate([f[1] for f in found]).astype(np.int32)), pa.array(np.concatenate([f[2] for f in found]))], names=["h", "doc", "pos", "first"])

    return docs.mapInArrow(run, "h long, doc long, pos int, first boolean")


class Fenwick:
    """The place of the largest value in any range of places, where values may also fall."""

    def __init__(self, n: int) -> None:
        self.n, self.value, self.best = n, [-1.0] * n, list(range(-1, n))  # best[p]: of the p & -p places up to p - 1

    def put(self, at: int, value: float) -> None:
        v, best, down = self.value, self.best, value < self.value[at]
        v[at] = value
        p = at + 1
        while p <= self.n:
            if down:
                top, q, stop = p - 1, p - 1, p - (p & -p)
                while q > stop:
                    if v[best[q]] > v[top]:
                        top = best[q]
                    q -= q & -q
                best[p] = top
            elif value >= v[best[p]]:
                best[p] = at
            p += p & -p

    def largest(self, low: int, end: int) -> int:
        """Of low <= place < end; -1 if the range is empty."""
        v, best, top, p = self.value, self.best, -1, end
        while p > low:
            if p - (p & -p) >= low:
                at, p = best[p], p - (p & -p)
            else:
                p -= 1
                at = p
            if top < 0 or v[at] > v[top]:
                top = at
        return top


def chains(x: np.ndarray, y: np.ndarray, k: int = GRAM, gap: int = GAP) -> list[list[int]]:
    """Index lists of collinear chains of the links (x, then y ascending), best first. Each link is in one chain at most.

    A chain's value is k a link, less COST a word of gap in either text. Only links within the gap can come before another: the
    tree holds those within it in x, and is asked for the range within it in y, so the best of them is found however much a
    chain further back is worth."""
    n, reach = len(x), gap + k
    value, prior = [0.0] * n, [-1] * n
    xs, ys = x.tolist(), y.tolist()
    places = np.unique(y)
    rank, low = np.searchsorted(places, y).tolist(), np.searchsorted(places, y - reach).tolist()
    tree = Fenwick(len(places))
    held: list[deque[int]] = [deque() for _ in range(len(places))]  # links of a place, each worth more than those after it
    worth = [0.0] * n  # a link's value, and the cost of all words up to it, which a later link takes off again
    behind = entered = 0
    for j in range(n):
        while xs[entered] < xs[j]:
            mine = held[rank[entered]]
            while mine and worth[mine[-1]] <= worth[entered]:
                mine.pop()
            mine.append(entered)
            if len(mine) == 1:
                tree.put(rank[entered], worth[entered])
            entered += 1
        while xs[behind] < xs[j] - reach:
            mine = held[rank[behind]]
            if mine and mine[0] == behind:
                mine.popleft()
                tree.put(rank[behind], worth[mine[0]] if mine else -1.0)
            behind += 1
        at = tree.largest(low[j], rank[j])
        got = tree.value[at] - COST * (xs[j] + ys[j]) if at >= 0 and held[at] else 0.0
        if got > 0:
            prior[j] = held[at][0]
        value[j] = k + max(got, 0.0)
        worth[j] = value[j] + COST * (xs[j] + ys[j])
    used, out = [False] * n, []
    for j in sorted(range(n), key=lambda i: (-value[i], i)):
        chain: list[int] = []
        while j >= 0 and not used[j]:
            used[j] = True
            chain.append(j)
            j = prior[j]
        if chain:
            out.append(chain[::-1])
    return out


def bridges(px: list[np.ndarray], py: list[np.ndarray], k: int = GRAM) -> list[tuple[int, int]]:
    """(chain, next chain) that begins where the first one's diagonal goes on."""
    out: list[tuple[int, int]] = []
    open_: dict[int, int] = {}  # of each diagonal, the last chain that ended on it
    for c in sorted(range(len(px)), key=lambda c: (int(px[c][0]), int(py[c][0]))):
        before = open_.get(int(py[c][0] - px[c][0]))
        if before is not None and px[before][-1] + k <= px[c][0]:
            out.append((before, c))
        open_[int(py[c][-1] - px[c][-1])] = c
    return out


def spans(chains_: list[np.ndarray], between: list[tuple[int, int]], k: int = GRAM) -> list[dict]:
    """The words around chains, {at, to}, in order and apart: each up to BEYOND words past the ends of the chains in it, and those between bridged chains."""
    out: list[dict] = []
    places = [(max(0, int(c[0]) - BEYOND), int(c[-1]) + k + BEYOND) for c in chains_] + [(int(chains_[c][-1]), int(chains_[d][0])) for c, d in between]
    for at, to in sorted(places):
        if out and at <= out[-1]["to"]:
            out[-1]["to"] = max(out[-1]["to"], to)
        else:
            out.append({"at": at, "to": to})
    return out


def joined(px: list[np.ndarray], py: list[np.ndarray], same: Callable[[int, int, int, int], np.ndarray], k: int = GRAM) -> list[tuple[np.ndarray, np.ndarray]]:
    """The chains, with bridged ones joined where the words between them agree; same(x0, x1, y0, y1) compares words pair by pair."""
    after = dict(bridges(px, py, k))
    whole = {c: ([px[c]], [py[c]]) for c in range(len(px))}
    head = list(range(len(px)))
    for c in sorted(after, key=lambda c: int(px[c][0])):
        d = after[c]
        equal = same(int(px[c][-1]) + k, int(px[d][0]), int(py[c][-1]) + k, int(py[d][0]))
        score = np.cumsum(np.where(equal, 1.0, -2.0))
        if not len(score) or (np.maximum.accumulate(np.maximum(score, 0)) - score).max() <= DROP:
            x, y = whole.pop(d)
            whole[head[c]][0].extend(x)
            whole[head[c]][1].extend(y)
            head[d] = head[c]
    return [(np.concatenate(x), np.concatenate(y)) for x, y in whole.values()]


def candidates(links: DataFrame, k: int = GRAM) -> DataFrame:
    """(doc, ref, xs, ys, around, ref_around): the chains of each pair and the words around them, from rows (doc, ref, pos, ref_pos)."""
    span = "array<struct<at: int, to: int>>"
    kind = pa.list_(pa.struct([("at", pa.int32()), ("to", pa.int32())]))
    many = pa.list_(pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> pa.RecordBatch:
            x, y = np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held])
            new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])  # a seed and its pair often link the same places
            x, y = x[new], y[new]
            found = chains(x, y, k)
            px, py = [x[c] for c in found], [y[c] for c in found]
            over = bridges(px, py, k)
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([px], many), pa.array([py], many), pa.array([spans(px, over, k)], kind), pa.array([spans(py, over, k)], kind)], names=["doc", "ref", "xs", "ys", "around", "ref_around"])

        for b in batches:
            doc, ref, x, y = (b.column(i).to_numpy() for i in range(4))
            cuts = np.flatnonzero((doc[1:] != doc[:-1]) | (ref[1:] != ref[:-1])) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(doc)], strict=True):
                if now is not None and now != (int(doc[s]), int(ref[s])):
                    yield close()
                    held = []
                now = (int(doc[s]), int(ref[s]))
                held.append((x[s:e], y[s:e]))
        if held:
            yield close()

    n = common.partitions(links.sparkSession)
    return links.repartition(n, "doc", "ref").sortWithinPartitions("doc", "ref", "pos", "ref_pos").mapInArrow(run, f"doc long, ref long, xs array<array<int>>, ys array<array<int>>, around {span}, ref_around {span}")


def common_words(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Places in a and in b of the words that the best alignment of two short runs has in common, each in order."""
    most, head = min(len(a), len(b)), 0
    while head < most and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < most - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    u, v = a[head : len(a) - tail], b[head : len(b) - tail]
    x, y = list(range(head)), list(range(head))
    if len(u) and len(v):
        rows = [[0] * (len(v) + 1)]
        for hit in (u[:, None] == v[None, :]).tolist():
            over, row = rows[-1], [0]
            for j, h in enumerate(hit, 1):
                row.append(over[j - 1] + 1 if h else max(over[j], row[-1]))
            rows.append(row)
        i, j, back = len(u), len(v), []
        while rows[i][j]:
            if rows[i - 1][j] == rows[i][j]:
                i -= 1
            elif rows[i][j - 1] == rows[i][j]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                back.append((i, j))
        x += [head + i for i, _ in back[::-1]]
        y += [head + j for _, j in back[::-1]]
    return x + list(range(len(a) - tail, len(a))), y + list(range(len(b) - tail, len(b)))


def extended(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the matches in the best run of a and b from their start on one diagonal; it ends where the score drops too far."""
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    score = np.cumsum(np.where(same, 1.0, -2.0))
    over = np.flatnonzero(np.maximum.accumulate(np.maximum(score, 0)) - score > DROP)
    score = score[: over[0]] if len(over) else score
    if not len(score) or score.max() <= 0:
        return np.empty(0, np.int64)
    best = int(len(score) - 1 - score[::-1].argmax())
    return np.flatnonzero(same[: best + 1])


def aligned(a: np.ndarray, b: np.ndarray, xs: np.ndarray, ys: np.ndarray, k: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places of the matching words of the slices a and b around a chain, ascending in both."""
    x, y = int(xs[0]), int(ys[0])
    back = extended(a[:x][::-1], b[:y][::-1])[::-1]
    px, py = [x - 1 - back], [y - 1 - back]
    for i, j in zip([*xs[1:].tolist(), int(xs[-1]) + k], [*ys[1:].tolist(), int(ys[-1]) + k], strict=True):
        if i - x == j - y > GAP + k:  # joined along a diagonal
            u = v = np.flatnonzero(a[x:i] == b[y:j])
        else:
            u, v = common_words(a[x:i], b[y:j])
        px.append(np.array(u, np.int64) + x)
        py.append(np.array(v, np.int64) + y)
        x, y = i, j
    on = extended(a[x:], b[y:])
    return np.concatenate([*px, x + on]), np.concatenate([*py, y + on])


def stretches(x: np.ndarray, y: np.ndarray, least: int = LEAST, like: float = LIKE) -> list[tuple[int, int]]:
    """(first, last) matches of the fewest stretches that cover every match which lies in a stretch of at least `least` words a side
    and `like` of words in common; each is as long as its start allows. Stretches that share good parts may overlap.

    A stretch that ends or begins inside a run of matches is never maximal, so only the ends of runs are tried."""
    m = np.arange(len(x))
    if not len(x):
        return []
    step = (np.diff(x) != 1) | (np.diff(y) != 1)
    first, last = np.flatnonzero(np.concatenate([[True], step])), np.flatnonzero(np.concatenate([step, [True]]))
    found: list[tuple[int, int]] = []
    for p in first.tolist():
        q = last[np.searchsorted(last, p) :]
        u, v, n = x[q] - x[p] + 1, y[q] - y[p] + 1, m[q] - p + 1
        good = np.flatnonzero((np.minimum(u, v) >= least) & (n >= like * np.maximum(u, v)))
        if len(good) and (not found or q[good[-1]] > found[-1][1]):
            found.append((p, int(q[good[-1]])))
            if len(good) and good[-1] == len(q) - 1:
                break
    out: list[tuple[int, int]] = []
    done, at = -1, 0
    while at < len(found):
        # of the stretches that hold the first match not covered yet, the one that reaches farthest
        while at + 1 < len(found) and found[at + 1][0] <= done + 1:
            at += 1
        if found[at][1] > done:
            out.append(found[at])
            done = found[at][1]
        at += 1
    return out


def apart(rows: list[tuple]) -> list[tuple]:
    """Rows (doc, ref, x0, x1, y0, y1, ...) of a pair without those inside another in the document, and without those overlapping places
    of one ref passage, as in text of one line many times over, that the others of it cover."""
    done, places = -1, {}
    for row in sorted(rows, key=lambda g: (g[2], -g[3], -g[6], g)):
        if row[3] > done:
            done = row[3]
            mine = places.setdefault(row[4:6], [])
            while len(mine) > 1 and row[2] <= mine[-2][3]:
                mine.pop()
            mine.append(row)
    return [row for mine in places.values() for row in mine]


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, like: float = LIKE) -> DataFrame:
    """One row per repeated passage; see the module's text."""
    docs = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).filter("doc is not null and text is not null")
    if docs.groupBy("doc").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return passages(docs, id_col, least, like)
    # numbers in order of id and text stand for rows; ranges of both split an id that many rows share
    told = docs.select("doc", F.xxhash64("text").alias("t")).distinct().repartitionByRange(common.partitions(df.sparkSession), "doc", "t").sortWithinPartitions("doc", "t")
    told = common.checkpoint(told.withColumn("row", F.monotonically_increasing_id()))
    rows = common.checkpoint(docs.withColumn("t", F.xxhash64("text")).join(told, ["doc", "t"]).select(F.col("row").alias("doc"), "text"))
    got = passages(rows, "row", least, like)
    ids = told.select("row", F.col("doc").alias("__doc"))
    refs = told.select(F.col("row").alias("ref_doc_id"), F.col("doc").alias("__ref"))
    named = got.join(ids, "row").join(refs, "ref_doc_id")
    return named.select(F.col("__doc").alias(id_col), F.col("__ref").alias("ref_doc_id"), *got.columns[2:])


def passages(docs: DataFrame, id_col: str, least: int, like: float) -> DataFrame:
    """The passages of texts (doc, text), where rows of one doc have the same text."""
    found = seeds(docs)
    shared = found.filter("first").groupBy("h").agg(F.min("doc").alias("ref"), F.max("doc").alias("most"), F.min_by("pos", "doc").alias("ref_pos")).filter("ref <> most").select("h", "ref", "ref_pos")
    shared = common.checkpoint(shared)  # so that the join's sides are plain exchanges, of which Spark splits a seed's many places
    links = found.join(shared, "h").filter("doc <> ref").select("doc", "ref", "pos", "ref_pos")
    cand = common.checkpoint(candidates(links).withColumn("c", F.monotonically_increasing_id()))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = common.filled(b.column(1))
            for s, e in common.string_chunks(text):
                h, cuts = common.word_hashes(text[s:e])
                h = (h >> np.uint64(48)).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([b.column(0)[s:e], pa.array([h[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=["doc", "words"])

    asks = cand.select("doc", "c", F.lit(0).alias("side"), "around").unionByName(cand.select(F.col("ref").alias("doc"), "c", F.lit(1).alias("side"), F.col("ref_around").alias("around")))
    text = docs.mapInArrow(words, "doc long, words binary")
    slices = asks.join(text, "doc").select("c", "side", "around", F.expr("transform(around, i -> substring(words, 2 * i.at + 1, 2 * (i.to - i.at)))").alias("words"))

    def place(around: list[dict], raw: list[bytes], chain: np.ndarray) -> tuple[int, np.ndarray]:
        """The place and the words of the slice that a chain lies in."""
        i = bisect.bisect_right([s["at"] for s in around], int(chain[0])) - 1
        return around[i]["at"], np.frombuffer(raw[i], np.uint16)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        now = None
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(b.num_columns)]
            rows = []
            for c, side, around, raw, doc, ref, xs, ys in zip(*cols, strict=True):
                if c != now:
                    held, now = {}, c
                if side == 2:
                    held[2] = (doc, ref, xs, ys)
                    continue
                held.setdefault(side, (around, raw))
                if 0 in held and 1 in held and 2 in held and side == 1:
                    (d, r, xs, ys), mine = held[2], []

                    def same(x0: int, x1: int, y0: int, y1: int) -> np.ndarray:
                        (x_at, u), (y_at, v) = place(*held[0], [x0]), place(*held[1], [y0])  # noqa: B023
                        return u[x0 - x_at : x1 - x_at] == v[y0 - y_at : y1 - y_at]

                    for px, py in joined(list(map(np.array, xs)), list(map(np.array, ys)), same):
                        (x_at, u), (y_at, v) = place(*held[0], px), place(*held[1], py)
                        mx, my = aligned(u, v, px - x_at, py - y_at)
                        for i, j in stretches(mx, my, least, like):
                            x0, x1, y0, y1, m = int(mx[i]), int(mx[j]) + 1, int(my[i]), int(my[j]) + 1, j - i + 1
                            mine.append((d, r, x0 + x_at, x1 + x_at, y0 + y_at, y1 + y_at, m, m / max(x1 - x0, y1 - y0)))
                    rows += apart(mine)
                    held = {}
            if rows:
                got = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(got[i], pa.int64()) for i in range(7)), pa.array(got[7], pa.float64())], names=[id_col, "ref_doc_id", "start_word", "end_word", "ref_start_word", "ref_end_word", "n_matched", "identity"])

    empty = [F.lit(None).cast(cand.schema[c].dataType).alias(c) for c in ("doc", "ref", "xs", "ys")]
    heads = cand.select("c", F.lit(2).alias("side"), F.lit(None).cast(cand.schema["around"].dataType).alias("around"), F.lit(None).cast("array<binary>").alias("words"), "doc", "ref", "xs", "ys")
    parts = slices.select("c", "side", "around", "words", *empty).unionByName(heads)
    n = common.partitions(docs.sparkSession)
    out = f"{id_col} long, ref_doc_id long, start_word long, end_word long, ref_start_word long, ref_end_word long, n_matched long, identity double"
    return parts.repartition(n, "c").sortWithinPartitions("c", F.expr("case side when 2 then -1 else side end")).mapInArrow(align, out).distinct()
