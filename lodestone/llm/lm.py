"""Language-model scores by deleted interpolation (Jelinek and Mercer 1980).

Tokens are words [^\\x20\\x09-\\x0D]+ with A-Z lowered, and one end after each text; a text begins after an end. Every word of the training
texts is a class of its own, and one more class is for words never seen. With g the class of token w and h the class before it

    P(w | h) = (l2 c(h, g) / c(h)  +  l1 c(g) / N  +  l0 / classes) * E(w | g)

where the weights l depend on the bucket (power of two) of the context's frequency c(h), and E is 1. Weights are learned by
expectation-maximisation on held-out counts: a tenth of the training texts is kept apart while they are learned, and all training texts make the
final counts. For the weights alone, chances are rounded to quarter octaves, so that all held-out pairs make a table of bounded size.

`shared` above 0 is an option for a coarser model: words under that share of all training tokens are one class, with those never seen, and E for such a word is
m c(w) / c(rare) + (1 - m) / (rare words + 1), the last share for words never seen; m is learned as the weights are.

Scale. Counts of words and of pairs grow with the corpus and stay distributed. At most 1 / CACHED words, and as
many pairs, have a share of CACHED: these two tables are bounded whatever the corpus, and broadcast, which changes no score. Every other pair and word of a
text meets its count in a range of keys: pairs of broadcast words by the numbers of the two, pairs with another word by a 64-bit hash of the two words' hashes. There are as
many ranges as the corpus needs (RANGE tokens each), counts are summed before
they are sent, and no key left has more than a share CACHED of the tokens, so ranges stay even. A block of texts (about HELD_TOKENS
tokens) asks for each of its distinct keys once, and the counts come back to it, where its texts are scored: so questions and answers grow
with the texts, whatever the number of ranges and tasks. Texts kept apart ask in the same way for the weights. Keys, counts and places travel as sorted, compressed blocks.

Defined results. A null text counts as empty and is one end token. A null id counts as training. With no training text every
score is that of an empty model (V = N = 0). Repeated rows give repeated rows and count each time; an empty table gives
none; texts are read whole; only the id and text columns are read. Texts are read twice for their score, to ask and to be scored, and blocks are
told apart by their place in their task, so where rows come in another order each time the table is computed, checkpoint it first."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common

SHARED, CACHED, RANGE, ROUNDS = 0.0, 2.0**-21, 1 << 19, 50
END = np.uint64(0x5EED0F0E4D0C1A55)
HELD_TOKENS = 2 << 20  # tokens that a task gathers before it sends sorted blocks
PAIR_BITS, CLASS_BITS = 44, 22  # 1 / CACHED + 2 classes fit in 22 bits
PAIR_COUNTS, WORD_COUNTS, PAIRS, WORDS = range(4)  # kinds of blocks; in a range the counts come first. Pairs with a word that is not broadcast go with the words
_ODD, _MASK = 0x9E3779B97F5, (1 << PAIR_BITS) - 1


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def apart(id_col: str = "doc_id") -> Column:
    """Training texts kept apart while weights are learned."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 1, F.lit(False))


def grouped(h: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and their number, or the sums of n."""
    if not len(h):
        return h, np.empty(0, np.int64)
    order = np.argsort(h) if n is not None else None
    s = np.sort(h) if order is None else h[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    return s[first], np.diff(np.append(first, len(s))) if order is None else np.add.reduceat(n[order], first)


def word_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(h, kept, apart) of training tokens: how often each word occurs in texts that make the first counts, and in those kept apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[bool, list[np.ndarray]] = {False: [], True: []}
        size = 0

        def out() -> pa.RecordBatch:
            sums = {k: grouped(np.concatenate([*v, np.empty(0, np.uint64)])) for k, v in parts.items()}
            h = np.concatenate([sums[False][0], sums[True][0]])
            zero = [np.zeros(len(sums[k][0]), np.int64) for k in (False, True)]
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.concatenate([sums[False][1], zero[1]])), pa.array(np.concatenate([zero[0], sums[True][1]]))], names=["h", "kept", "apart"])

        for b in batches:
            aside = b.column(0).to_numpy(zero_copy_only=False)
            text = common.filled(b.column(1))
            for s, e in common.string_chunks(text):
                h, cuts = common.word_hashes(text[s:e])
                mine = np.repeat(aside[s:e], np.diff(cuts))
                for k in (False, True):
                    parts[k] += [h[mine == k], np.full(int((aside[s:e] == k).sum()), END)]
                size += len(h)
                if size > 2 << 20:
                    yield out()
                    parts, size = {False: [], True: []}, 0
        yield out()

    train = df.filter(~held_out()).select(apart().alias("aside"), F.col(text_col).cast("string").alias("t"))
    return train.mapInArrow(run, "h long, kept long, apart long").groupBy("h").agg(F.sum("kept").alias("kept"), F.sum("apart").alias("apart"))


def classes(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Class numbers: the place among the (sorted) known hashes, or their number for others."""
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, at, len(known))


def sequence(h: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of consecutive texts with their ends, and each text's first token."""
    docs = len(cuts) - 1
    out = np.full(len(h) + docs, END)
    starts = cuts[:-1] + np.arange(docs)
    out[np.arange(len(h)) + np.repeat(np.arange(docs), np.diff(cuts))] = h
    return out, starts


def pair_keys(g: np.ndarray, end: int) -> np.ndarray:
    """Keys of the pairs (class before, class), spread over PAIR_BITS by a product that can be undone."""
    plain = (np.concatenate([[end], g[:-1]]).astype(np.uint64) << np.uint64(CLASS_BITS)) | g.astype(np.uint64)
    return (plain * np.uint64(_ODD)) & np.uint64(_MASK)


def pair_classes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    plain = (keys * np.uint64(pow(_ODD, -1, 1 << PAIR_BITS))) & np.uint64(_MASK)
    return (plain >> np.uint64(CLASS_BITS)).astype(np.int64), (plain & np.uint64((1 << CLASS_BITS) - 1)).astype(np.int64)


def far_keys(tokens: np.ndarray) -> np.ndarray:
    """Keys of the pairs (word before, word) by the hashes of both, for words without a class number."""
    return common.mix(np.concatenate([[END], tokens[:-1]]) * np.uint64(0x9E3779B97F4A7C15) + tokens)


def packed(keys: np.ndarray, *others: np.ndarray) -> bytes:
    """Sorted keys as differences, beside other numbers, byte plane by byte plane, compressed."""
    table = np.stack([np.diff(keys, prepend=np.uint64(0)), *[a.astype(np.uint64) for a in others]])
    return pa.Codec("zstd", 1).compress(np.ascontiguousarray(table.view(np.uint8).reshape(len(table), len(keys), 8).transpose(0, 2, 1)), asbytes=True)


def unpacked(raw: bytes, n: int, columns: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(raw, columns * 8 * n, asbytes=True), np.uint8)
    table = planes.reshape(columns, 8, n).transpose(0, 2, 1).copy().view(np.uint64).reshape(columns, n)
    table[0] = np.cumsum(table[0])
    return table


def blocks(kind: int, keys: np.ndarray, ranges: int, *others: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """(range, kind, n, blob) of keys in any order: one block for each range they fall in."""
    if not len(keys):
        return []
    order = np.argsort(keys)
    keys, others = keys[order], [a[order] for a in others]
    bits = PAIR_BITS if kind in (PAIR_COUNTS, PAIRS) else 64
    at = (keys >> np.uint64(bits - ranges.bit_length() + 1)).astype(np.int64) if ranges > 1 else np.zeros(len(keys), np.int64)
    cuts = np.append(np.flatnonzero(np.diff(at, prepend=-1)), len(keys))
    return [(int(at[s]), kind, int(e - s), packed(keys[s:e], *[a[s:e] for a in others])) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]


BLOCK = "range int, kind int, n int, blob binary"


def block_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["range", "kind", "n", "blob"])


class Summed:
    """Sums of kept and apart by key, merged as blocks come."""

    def __init__(self) -> None:
        self.merged, self.more, self.size = np.empty((3, 0), np.uint64), [], 0

    def add(self, table: np.ndarray) -> None:
        self.more.append(table)
        self.size += table.shape[1]
        if self.size > self.merged.shape[1] + HELD_TOKENS:
            self.table()

    def table(self) -> np.ndarray:
        whole = np.concatenate([self.merged, *self.more], axis=1)
        if self.size:
            whole = whole[:, np.argsort(whole[0])]
            first = np.flatnonzero(np.concatenate([[True], whole[0, 1:] != whole[0, :-1]]))
            whole = np.stack([whole[0, first], *[np.add.reduceat(a, first) for a in whole[1:]]])
        self.merged, self.more, self.size = whole, [], 0
        return whole


def key_counts(df: DataFrame, known: np.ndarray, ranges: int, text_col: str = "text", folded: bool = False) -> DataFrame:
    """Blocks of (key, kept, apart) of training pairs and of training words that are not known: each range's keys once.

    Where words that are not known aren't `folded` into one class, pairs with such a word are counted by the words themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], list[np.ndarray]] = {}
        size = 0

        def out() -> pa.RecordBatch:
            rows = []
            for kind in (PAIR_COUNTS, WORD_COUNTS):
                both = [grouped(np.concatenate([*held.get((kind, k), []), np.empty(0, np.uint64)])) for k in (False, True)]
                zero = [np.zeros(len(b[0]), np.int64) for b in both]
                rows += blocks(kind, np.concatenate([b[0] for b in both]), ranges, np.concatenate([both[0][1], zero[1]]), np.concatenate([zero[0], both[1][1]]))
            return block_batch(rows)

        end = int(classes(np.array([END]), known)[0])
        for b in batches:
            aside = b.column(0).to_numpy(zero_copy_only=False)
            text = common.filled(b.column(1))
            for s, e in common.string_chunks(text):
                tokens, starts = sequence(*common.word_hashes(text[s:e]))
                g = classes(tokens, known)
                keys, rare = pair_keys(g, end), g == len(known)
                far = np.zeros(len(g), bool) if folded else rare | np.concatenate([[False], rare[:-1]])
                pairs = far_keys(tokens)
                mine = np.repeat(aside[s:e], np.diff(np.append(starts, len(tokens))))
                for k in (False, True):
                    held.setdefault((PAIR_COUNTS, k), []).append(keys[~far & (mine == k)])
                    held.setdefault((WORD_COUNTS, k), []).extend([tokens[rare & (mine == k)], pairs[far & (mine == k)]])
                size += len(tokens)
                if size > HELD_TOKENS:
                    yield out()
                    held, size = {}, 0
        yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, Summed()

        def out() -> Iterator[pa.RecordBatch]:
            table = sums.table()
            for at in range(0, table.shape[1], 1 << 20):
                part = table[:, at : at + (1 << 20)]
                yield block_batch([(*now, part.shape[1], packed(*part))])

        for b in batches:
            for r, kind, n, blob in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if (r, kind) != now:
                    if now is not None:
                        yield from out()
                    now, sums = (r, kind), Summed()
                sums.add(unpacked(blob, n, 3))
        if now is not None:
            yield from out()

    train = df.filter(~held_out()).select(apart().alias("aside"), F.col(text_col).cast("string").alias("t"))
    sent = common.in_arrow(train, run, BLOCK).repartition(common.partitions(df.sparkSession), "range").sortWithinPartitions("range", "kind")
    return common.in_arrow(sent, merge, BLOCK)


class Model(NamedTuple):
    """What is broadcast; all of it bounded by 1 / CACHED rows."""

    known: np.ndarray  # hashes of the words that have a number, sorted
    count: np.ndarray  # tokens of each of them; the last is that of all other words
    bucket: np.ndarray  # of each class as a context
    weights: np.ndarray  # of each bucket: l2, l1, l0
    hot: np.ndarray  # keys of frequent pairs, sorted
    hot_count: np.ndarray
    n: int
    classes: int
    folded: bool  # all other words are one class
    m0: float
    m1: float
    floor: float

    def value(self, bucket: np.ndarray, context: np.ndarray, single: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """log10 of the class mixture by the bucket and the count of the context, the count of the class and that of the pair."""
        l2, l1, l0 = self.weights[bucket].T
        rest, never = l1 + l0, context == 0
        p = np.where(never, 0, l2) * pair / np.maximum(context, 1) + (l1 * single / max(1, self.n) + l0 / self.classes) / np.where(never, rest, 1)
        return np.log10(np.maximum(p, 1e-300))


def buckets(kept: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(kept, 1))).astype(np.uint8)


def learned(chances: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights of the components (rows of chances) that make the weighted events likeliest, by EM; equal without events."""
    mix = np.full(len(chances), 1.0 / len(chances))
    if weight.sum() <= 0:
        return mix
    for _ in range(rounds):
        share = mix[:, None] * chances
        share /= np.maximum(share.sum(axis=0), 1e-300)
        mix = (share * weight).sum(axis=1) / weight.sum()
    return mix


_NONE = 1023  # the rounded chance of what never occurs


def rounded(p: np.ndarray) -> np.ndarray:
    """-log2 in quarters."""
    return np.where(p > 0, np.minimum(np.round(-4 * np.log2(np.where(p > 0, p, 1))), _NONE - 1), _NONE).astype(np.int64)


def held_out_cells(pairs: DataFrame, kept: np.ndarray, bucket: np.ndarray, hot: float) -> DataFrame:
    """(frequent, key, n): of pairs of at least `hot` tokens the key and count, and of all pairs kept apart their number by bucket and rounded chances."""
    whole = max(1, int(kept.sum()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                key, k, a = unpacked(blob, n, 3)
                often = k + a >= hot
                at = np.flatnonzero(a)
                h, g = pair_classes(key[at])
                cell = (bucket[h].astype(np.int64) << 20) | (rounded(k[at] / np.maximum(kept[h], 1)) << 10) | rounded(kept[g] / whole)
                cells, sums = grouped(cell, a[at].astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([True, False], [often.sum(), len(cells)])), pa.array(np.concatenate([key[often].astype(np.int64), cells])), pa.array(np.concatenate([(k + a)[often].astype(np.int64), sums]))],
                    names=["frequent", "key", "n"],
                )

    return common.in_arrow(pairs.filter(F.col("kind") == PAIR_COUNTS).select("n", "blob"), run, "frequent boolean, key long, n long").groupBy("frequent", "key").agg(F.sum("n").alias("n"))


def far_cells(m: Model, block: Answered) -> pa.RecordBatch:
    """(key, n) as held_out_cells has them, of a block's pairs with a word that is not known; the model has the kept counts."""
    k, _ = block.counts[WORDS]
    at, h, g = block.links.astype(np.int64)
    kept, bucket = np.concatenate([m.count, k]), np.concatenate([m.bucket, buckets(k)])
    cell = (bucket[h].astype(np.int64) << 20) | (rounded(k[at] / np.maximum(kept[h], 1)) << 10) | rounded(kept[g] / max(1, m.n))
    key, sums = grouped(cell, np.bincount(block.places[WORDS][1], minlength=len(at)).astype(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(sums)], names=["key", "n"])


def fit(docs: DataFrame, shared: float = SHARED, tokens_a_range: int = RANGE, cached: float = CACHED) -> tuple[Model, DataFrame, int]:
    """The model, the blocks of its counts and the number of their ranges."""
    counts, folded = common.checkpoint(word_counts(docs)), shared > 0
    total = counts.agg(F.sum("kept").alias("kept"), F.sum(F.col("kept") + F.col("apart")).alias("n"), F.count("*").alias("v")).first()
    n, n_kept, v = total.n or 0, total.kept or 0, total.v
    c, end = F.col("kept") + F.col("apart"), int(END.view(np.int64))
    often = max(1.0, (shared if folded else cached) * n)
    t = counts.filter((c >= often) | (F.col("h") == end)).toArrow()  # at most 1 / shared or 1 / cached rows, and 1
    known, kept, both = t["h"].to_numpy().view(np.uint64), t["kept"].to_numpy(), t["kept"].to_numpy() + t["apart"].to_numpy()
    if END not in known:
        known, kept, both = np.append(known, END), np.append(kept, 0), np.append(both, 0)
    if len(known) >= 1 << CLASS_BITS:
        raise ValueError("shared or cached is too small for this table")
    order = np.argsort(known)
    known, kept, both = known[order].copy(), kept[order], both[order]
    rare_n, rare_v = n - int(both.sum()), v - int((both > 0).sum())
    size = len(known) + 1 if folded else max(1, v) + 1
    kept, both = np.append(kept, n_kept - kept.sum()), np.append(both, rare_n)
    bucket = buckets(kept)
    ranges = 1 << max(0, int(n // tokens_a_range)).bit_length()
    pairs = common.checkpoint(key_counts(docs, known, ranges, folded=folded))
    cells = held_out_cells(pairs, kept, bucket, often).toArrow()  # at most 1 / shared or 1 / cached rows, and a bounded number of cells
    frequent, key, m = (cells[name].to_numpy() for name in ("frequent", "key", "n"))
    order = np.argsort(key[frequent])
    hot, hot_count = key[frequent][order].astype(np.uint64), m[frequent][order]
    cell, m = key[~frequent], m[~frequent].astype(float)
    weights = np.full((64, 3), 1 / 3)
    first = Model(known, kept, bucket, weights, hot[:0], hot_count[:0], n_kept, size, folded, 0.0, 1.0, n + 0.1 * (v + 1))
    if not folded and rare_v:
        far = looked_up(docs.filter(~held_out() & apart()), pairs.filter(F.col("kind") == WORD_COUNTS), first, ranges, far_cells, "key long, n long", near=False)
        far = far.groupBy("key").agg(F.sum("n").alias("n")).toArrow()
        cell, m = np.concatenate([cell, far["key"].to_numpy()]), np.concatenate([m, far["n"].to_numpy()])
    chance = lambda q: np.where(q == _NONE, 0.0, 2.0 ** (-q / 4))
    for b in np.unique(cell >> 20):
        of = cell[cell >> 20 == b]
        weights[b] = learned(np.stack([chance((of >> 10) & 1023), chance(of & 1023), np.full(len(of), 1 / size)]), m[cell >> 20 == b])
    m0, m1 = 0.0, 1.0
    if folded:
        # rare words: how often held-out tokens fall on words of each count, counts above 64 cut to their highest four bits
        fewer = "cast(greatest(0, floor(log2(greatest(kept, 1))) - 3) as int)"
        seen = (
            counts.filter((c < often) & (F.col("h") != end))
            .withColumn("r", F.expr(f"case when kept < 64 then kept else shiftleft(shiftright(kept, {fewer}), {fewer}) end"))
            .groupBy("r").agg(F.sum("apart").alias("m"), F.count("*").alias("words"), F.sum("kept").alias("kept"))
        )
        hist = seen.collect()  # fewer than 64 + 8 * 64 rows
        rare_kept, rare_words = max(1, sum(r.kept for r in hist)), sum(r.words for r in hist if r.r > 0)
        emit = learned(np.array([[r.r / rare_kept for r in hist], [1.0 / (rare_words + 1)] * len(hist)]).reshape(2, -1), np.array([float(r.m) for r in hist])) if hist else np.array([0.5, 0.5])
        m0, m1 = float(emit[0]) / max(1, rare_n), max(float(emit[1]) / (rare_v + 1), 1e-300)
    return first._replace(count=both, weights=weights, hot=hot, hot_count=hot_count, n=n, m0=m0, m1=m1), pairs, ranges


def distinct(h: np.ndarray) -> np.ndarray:
    return grouped(h)[0]


class Held(NamedTuple):
    """A block of consecutive texts of about HELD_TOKENS tokens: its number, its texts' ids and what the broadcast model says of them, and the
    keys that it has to ask for, by kind: distinct ones in order. Of each kind then text and target of each place, and the number of targets: keys, or
    for words that are not folded the links, which are a key's place for each pair with such a word, and of both its words the number, or that of the last class and 1 more than the key's place."""

    number: int
    ids: list[pa.Array]
    sums: list[list[np.ndarray]]
    keys: dict[int, np.ndarray]
    places: dict[int, tuple[np.ndarray, int]]
    links: np.ndarray


def held_texts(batches: Iterator[pa.RecordBatch], m: Model, near: bool = True, places: bool = True) -> Iterator[Held]:
    """The blocks of a task's rows (id, text); a block's number is the task's and that of its first row. Without `near`, pairs of known words are left out; without `places`, all but number and keys."""
    end, rare = int(classes(np.array([END]), m.known)[0]), len(m.known)
    number = row = TaskContext.get().partitionId() << 33
    ids: list[pa.Array] = []
    sums: list[list[np.ndarray]] = []
    held: dict[str, list[np.ndarray]] = {}
    size = 0

    def block() -> Held:
        got = {k: np.concatenate(v) for k, v in held.items()}
        if not places:
            return Held(number, [], [], {PAIRS: distinct(got["pair"]), WORDS: distinct(np.concatenate([got["word"], got["far"]]))}, {}, np.empty((3, 0), np.uint64))
        keys, at = {}, {}

        def placed(kind: int, texts: np.ndarray, target: np.ndarray, targets: int) -> None:
            at[kind] = np.sort(texts.astype(np.uint64) * np.uint64(max(1, targets)) + target.astype(np.uint64)), targets

        keys[PAIRS], target = np.unique(got["pair"], return_inverse=True)
        placed(PAIRS, got["pair_text"], target, len(keys[PAIRS]))
        if m.folded:
            keys[WORDS], target = np.unique(got["word"], return_inverse=True)
            placed(WORDS, got["word_text"], target, len(keys[WORDS]))
            return Held(number, ids, sums, keys, at, np.empty((3, 0), np.uint64))
        far, first, target = np.unique(got["far"], return_index=True, return_inverse=True)
        placed(WORDS, got["far_text"], target, len(far))
        keys[WORDS] = distinct(np.concatenate([far, got["word"]]))
        links = [np.searchsorted(keys[WORDS], far)]
        for word in (got["before"][first], got["after"][first]):
            g = classes(word, m.known)
            links.append(np.where(g < rare, g, rare + 1 + np.searchsorted(keys[WORDS], word)))
        return Held(number, ids, sums, keys, at, np.stack(links).astype(np.uint64))

    for b in batches:
        text = common.filled(b.column(1))
        for s, e in common.string_chunks(text):
            tokens, starts = sequence(*common.word_hashes(text[s:e]))
            g = classes(tokens, m.known)
            h, keys = np.concatenate([[end], g[:-1]]), pair_keys(g, end)
            own = g != rare
            far = np.zeros(len(g), bool) if m.folded else ~own | (h == rare)
            at = np.minimum(np.searchsorted(m.hot, keys), max(0, len(m.hot) - 1))
            hot = (m.hot[at] == keys) & ~far if len(m.hot) else np.zeros(len(keys), bool)
            asked = ~(hot | far) if near else np.zeros(len(keys), bool)
            more = {"pair": keys[asked], "word": tokens[~own], "far": far_keys(tokens)[far]}
            if places:
                value = np.zeros(len(keys))
                value[hot] = m.value(m.bucket[h[hot]], m.count[h[hot]], m.count[g[hot]], m.hot_count[at[hot]])
                base = np.where(own, np.log10((m.count[g] + 0.1) / m.floor), 0.0)
                n = np.diff(np.append(starts, len(tokens)))
                sums.append([n.astype(np.int64), *[np.add.reduceat(x, starts) for x in ((own & (m.count[g] > 0)).astype(np.int64), base, value)]])
                texts = (row - number + np.repeat(np.arange(e - s), n)).astype(np.uint32)
                more |= {"pair_text": texts[asked], "word_text": texts[~own], "far_text": texts[far], "before": np.concatenate([[END], tokens[:-1]])[far], "after": tokens[far]}
            for name, x in more.items():
                held.setdefault(name, []).append(x)
            ids.append(b.column(0)[s:e])
            row += e - s
            size += len(tokens)
            if size > HELD_TOKENS:
                yield block()
                number, ids, sums, held, size = row, [], [], {}, 0
    if ids:
        yield block()


class Answered(NamedTuple):
    """A block whose counts have come: its rows, the keys of its pairs of known words, its links, and by kind the kept and apart counts of its keys, and text and target of each place."""

    rows: pa.RecordBatch
    keys: np.ndarray
    links: np.ndarray
    counts: dict[int, tuple[np.ndarray, np.ndarray]]
    places: dict[int, tuple[np.ndarray, np.ndarray]]


def small(numbers: np.ndarray) -> bytes:
    """Numbers, most of them small, byte plane by byte plane, compressed."""
    return pa.Codec("zstd", 1).compress(np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(len(numbers), 8).T), asbytes=True)


def unsmall(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(raw, 8 * n, asbytes=True), np.uint8).reshape(8, n).T.copy().view("<u8").ravel()


_SUMS = ["n_tokens", "n_known", "base", "value"]


def looked_up(docs: DataFrame, counts: DataFrame, fitted: Model, ranges: int, finish: Callable[[Model, Answered], pa.RecordBatch], schema: str, near: bool = True) -> DataFrame:
    """What `finish` makes of each block of texts (doc_id, text), with the counts of all its keys."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(tuple(fitted))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block's distinct keys, by range."""
        for held in held_texts(batches, Model(*model.value), near, places=False):
            rows = [r for kind, known in held.keys.items() for r in blocks(kind, known, ranges)]
            yield pa.RecordBatch.from_arrays([*block_batch(rows).columns, pa.array(np.full(len(rows), held.number))], names=["range", "kind", "n", "blob", "block"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The counts of the keys asked for, kept and apart, in their order."""
        now, known = None, {}
        for b in batches:
            got = []
            for r, kind, n, blob, block in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
                if r != now:
                    now, known = r, {}
                if kind in (PAIR_COUNTS, WORD_COUNTS):
                    known.setdefault(kind, []).append(unpacked(blob, n, 3))
                    continue
                key = unpacked(blob, n, 1)[0]
                parts = known.get(kind - PAIRS, [])
                if len(parts) > 1:
                    have = np.concatenate(parts, axis=1)
                    parts = known[kind - PAIRS] = [have[:, np.argsort(have[0])]]
                c = np.zeros((2, n), np.uint64)
                if parts:
                    at = np.minimum(np.searchsorted(parts[0][0], key), parts[0].shape[1] - 1)
                    c = parts[0][1:, at] * (parts[0][0, at] == key)
                got.append((block, kind, r, n, small(c.ravel())))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["block", "kind", "range", "n", "blob"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block's rows, with what is known of them, and its places."""
        names = ["block", "kind", "range", "n", "blob", "places", "id", *_SUMS]
        for held in held_texts(batches, Model(*model.value), near):
            for ids, numbers in zip(held.ids, held.sums, strict=True):
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, held.number)), pa.array(np.full(n, -1, np.int32)), *[pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.binary(), pa.int32())], ids, *map(pa.array, numbers)], names=names)
            for kind, (places, targets) in held.places.items():
                # of pairs of known words the keys themselves are needed too, to tell their classes
                for part, x in ((-3, held.keys[PAIRS][None] if kind == PAIRS else held.links), (-2, places[None])):
                    yield pa.RecordBatch.from_arrays([*[pa.array([v], t) for v, t in ((held.number, pa.int64()), (kind, pa.int32()), (part, pa.int32()), (x.shape[1], pa.int32()), (packed(*x), pa.binary()), (targets, pa.int32()))], *[pa.nulls(1, t) for t in (held.ids[0].type, pa.int64(), pa.int64(), pa.float64(), pa.float64())]], names=names)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*model.value)
        now, rows, kept, places, answers = None, [], {}, {}, {}

        def out() -> pa.RecordBatch:
            counts = {}
            for kind in (PAIRS, WORDS):
                both = [x.reshape(2, -1) for x in answers.get(kind, [])]
                counts[kind] = tuple(np.concatenate([np.empty((2, 0), np.uint64), *both], axis=1).astype(np.int64))
            split = {kind: ((at // np.uint64(max(1, size))).astype(np.int64), (at % np.uint64(max(1, size))).astype(np.int64)) for kind, (at, size) in places.items()}
            return finish(m, Answered(pa.Table.from_batches(rows).combine_chunks().to_batches()[0], kept[PAIRS][0], kept[WORDS], counts, split))

        for b in batches:
            block, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.append(np.flatnonzero((np.diff(block, prepend=-1) != 0) | (np.diff(kind, prepend=-9) != 0)), len(block))
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if block[s] != now:
                    if now is not None:
                        yield out()
                    now, rows, kept, places, answers = block[s], [], {}, {}, {}
                if kind[s] < 0:
                    rows.append(b.slice(s, e - s).select(["id", *_SUMS]))
                    continue
                for part, n, blob, size in zip(*[b.column(i)[s:e].to_pylist() for i in (2, 3, 4, 5)], strict=True):
                    if part == -3:
                        kept[int(kind[s])] = unpacked(blob, n, 1 if kind[s] == PAIRS else 3)
                    elif part == -2:
                        places[int(kind[s])] = unpacked(blob, n, 1)[0], size
                    else:
                        answers.setdefault(int(kind[s]), []).append(unsmall(blob, 2 * n))
        if now is not None:
            yield out()

    parts, id_type = common.partitions(spark), docs.schema[0].dataType.simpleString()
    asked = common.in_arrow(docs, ask, f"{BLOCK}, block long").unionByName(counts, allowMissingColumns=True)
    answers = common.in_arrow(asked.repartition(parts, "range").sortWithinPartitions("range", "kind"), answer, "block long, kind int, range int, n int, blob binary")
    own = common.in_arrow(docs, keep, f"block long, kind int, range int, n int, blob binary, places int, id {id_type}, n_tokens long, n_known long, base double, value double")
    whole = own.withColumn("at", F.monotonically_increasing_id()).unionByName(answers, allowMissingColumns=True)
    # a block's rows in their order, then of each kind its keys or links and places, then the answers by range, which is the order of the keys
    return common.in_arrow(whole.repartition(parts, "block").sortWithinPartitions("block", "kind", "range", "at"), total, schema)


def scored(m: Model, block: Answered) -> pa.RecordBatch:
    """The sums of a block's rows, with what its counts add."""
    c = {kind: k + a for kind, (k, a) in block.counts.items()}
    h, g = pair_classes(block.keys)
    found = {PAIRS: [np.zeros(len(h)), np.zeros(len(h)), m.value(m.bucket[h], m.count[h], m.count[g], c[PAIRS])]}
    if m.folded:
        found[WORDS] = [(c[WORDS] > 0).astype(float), np.log10((c[WORDS] + 0.1) / m.floor), np.log10(m.m0 * c[WORDS] + m.m1)]
    else:
        at, h, g = block.links.astype(np.int64)
        count, bucket = np.concatenate([m.count, c[WORDS]]), np.concatenate([m.bucket, buckets(block.counts[WORDS][0])])
        far = g >= len(m.count)  # a known word's own count is in its row's sums
        found[WORDS] = [(far & (count[g] > 0)).astype(float), np.where(far, np.log10((count[g] + 0.1) / m.floor), 0.0), m.value(bucket[h], count[h], count[g], c[WORDS][at])]
    n = len(block.rows)
    more = [np.zeros(n), np.zeros(n), np.zeros(n)]
    for kind, (row, target) in block.places.items():
        for a, x in zip(more, found[kind], strict=True):
            a += np.bincount(row, x[target], n)
    rows = block.rows
    return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(rows.column(2).to_numpy() + np.rint(more[0]).astype(np.int64)), *[pa.array(rows.column(2 + i).to_numpy() + more[i]) for i in (1, 2)]], names=["id", *_SUMS])


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shared: float = SHARED, tokens_a_range: int = RANGE, cached: float = CACHED) -> DataFrame:
    """op10: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fitted, counts, ranges = fit(docs, shared, tokens_a_range, cached)
    id_type = docs.schema[0].dataType.simpleString()
    summed = looked_up(docs, counts, fitted, ranges, scored, f"id {id_type}, n_tokens long, n_known long, base double, value double")
    return summed.select(
        F.col("id").alias(id_col),
        held_out("id").alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(fitted.n).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        F.col("value").alias("score"),
    )
