"""Groups of spelling variants by full neighbourhood generation.

The words of a vocabulary within one inserted, deleted or replaced character of each other are found without comparing
any two: each word emits all its distinct deletions, replacements and insertions over the alphabet that the vocabulary
shows, and what it emits is joined to the vocabulary by equality. A deletion within a run of equal characters is taken at the
run's first one, an insertion of a character before a run of it at the run's end, so no string is emitted twice.

Candidates are made as 64-bit hashes, all positions and letters of many words at once. A bitmap of the vocabulary's hashes, of
BITS bits at most whatever the vocabulary, tells most of those that are no word; only the rest are spelled out, shuffled
and joined by their text. A full bitmap costs shuffled rows, never a result.

Neighbourhood is symmetric, so what reaches a word in the join are its own near words with their counts; they are combined
before the shuffle. A word's form is the near word of largest count (ties: smallest in code-point order) if that count is at
least twice the word's; counts at least double along a chain of forms, which therefore ends, and roots are found by pointer
doubling in at most six joins.

Defined results. A null text has no words and a null id counts as an empty one; repeated rows count again; texts are read
whole, whatever a word's length; an empty table or one without a word frequent enough gives no rows; other columns are not
read."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common

#: one occurrence in so many loses a character in the query's own noise
NOISE = 97
LEAST_LENGTH, LEAST_COUNT, FACTOR = 5, 3, 2
#: bits of the largest bitmap, bits of one of its rows, probes of a hash, words counted before a task sends them on
BITS, ROW, PROBES, HELD = 1 << 28, 1 << 15, 4, 1 << 19
#: candidates made at a time
BLOCK = 1 << 18

_LETTER = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0xC0, 0x100))
#: Latin-1 bytes of a text to words: A-Z lowered, everything else but letters a space
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if c in _LETTER else 32 for c in range(256))


def runs(text: str) -> list[bytes]:
    """The maximal runs of [A-Za-z\\u00C0-\\u00FF] in Latin-1, A-Z lowered."""
    return text.encode("latin-1", "replace").translate(_TABLE).split()


def noisy(text: str, doc_id: object, least: int = LEAST_LENGTH) -> Counter:
    """Occurrences of the runs of at least `least` characters after the noise."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for word, n in Counter([w for w in runs(text) if len(w) >= least]).items():
        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
        if not h % NOISE:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
            if len(word) < least:
                continue
        out[word] += n
    return out


def plain(text: str, doc_id: object, least: int = LEAST_LENGTH) -> Counter:
    """Occurrences of the runs of at least `least` characters as they are."""
    return Counter([w for w in runs(text) if len(w) >= least])


def counted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words=plain, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words frequent enough; a task sends on what it has counted whenever that is HELD words."""
    src = df.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t")).filter("t is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            names = list(total)
            for s in range(0, len(names), 1 << 16):
                some = names[s : s + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in some], pa.string()), pa.array([total[w] for w in some], pa.int64())], names=["word", "n"])
            total.clear()

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                total.update(words(t.as_py(), i, least_length))
                if len(total) >= HELD:
                    yield from out()
        yield from out()

    return common.in_arrow(src, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def codes(words: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: which words, and their code points as a matrix."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    out = {}
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        out[size] = at, np.frombuffer("".join(words[i] for i in at).encode("utf-32-le"), "<u4").reshape(len(at), size)
    return out


def scaled(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the first 0..size terms (code + 1) * base**i, and the powers."""
    up = common.powers(size + 2)[0]
    total = np.zeros((len(x), size + 1), np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[:size], axis=1, out=total[:, 1:])
    return total, up


def hashes(words: list[str]) -> np.ndarray:
    """A 64-bit hash of each word."""
    out = np.zeros(len(words), np.uint64)
    for size, (at, x) in codes(words).items():
        out[at] = common.mix(scaled(x, size)[0][:, -1].copy())
    return out


def neighbours(x: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[str, int, int, np.ndarray, np.ndarray]]:
    """Deletions, replacements and insertions of words of one length, in blocks: (kind, first word, first place, hash by word, place and
    letter, mask of those to emit, so that none is emitted twice)."""
    size = x.shape[1]
    letters = (alphabet.astype(np.uint64) + np.uint64(1))[None, None, :]
    few = max(1, BLOCK // max(1, size * len(alphabet)))
    for top in range(0, len(x), few):
        part = x[top : top + few]
        total, up = scaled(part, size)
        down = common.powers(2)[1][1]
        whole = total[:, -1:]
        own = part.astype(np.uint64) + np.uint64(1)
        first = np.ones(part.shape, bool)
        first[:, 1:] = part[:, 1:] != part[:, :-1]
        yield "deletion", top, 0, common.mix(total[:, :-1] + (whole - total[:, 1:]) * down)[:, :, None], first[:, :, None]
        other = part[:, :, None] != alphabet[None, None, :] if size * len(alphabet) <= BLOCK else None
        step = max(1, BLOCK // max(1, len(part) * len(alphabet)))  # of one long word only some places at a time
        for s in range(0, size + 1, step):
            e, to = min(s + step, size), min(s + step, size + 1)
            differ = other[:, s:e] if other is not None else part[:, s:e, None] != alphabet[None, None, :]
            if e > s:
                yield "replacement", top, s, common.mix(whole[:, :, None] + (letters - own[:, s:e, None]) * up[s:e][None, :, None]), differ
            h = (total[:, s:to] + (whole - total[:, s:to]) * up[1])[:, :, None] + letters * up[s:to][None, :, None]
            new = np.ones(h.shape, bool)  # at the end any letter is new
            new[:, : e - s] = differ
            yield "insertion", top, s, common.mix(h), new


def spelled(word: str, kind: str, at: int, letter: int) -> str:
    return word[:at] + ("" if kind == "deletion" else chr(letter)) + word[at + (kind != "insertion") :]


def probes(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """PROBES places of each hash in a bitmap of `bits`, a power of two."""
    second = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + second * np.uint64(k)) & np.uint64(bits - 1)).astype(np.int64) for k in range(PROBES)]


def maybe(held: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """Which of the hashes have all their probes set."""
    left = np.arange(len(h))
    for at in probes(h, bits):
        left = left[(held[at[left] >> 3] >> (at[left] & 7).astype(np.uint8)) & 1 == 1]
    return left


def bitmap(words: DataFrame, bits: int) -> np.ndarray:
    """Bytes of a bitmap in which the probes of column h are set; at most BITS / 8 bytes reach the driver."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(np.concatenate(probes(b.column(0).to_numpy().view(np.uint64), bits)))
            yield pa.RecordBatch.from_arrays([pa.array(at // ROW), pa.array(at % ROW)], names=["row", "at"])

    rows = common.in_arrow(words.select("h"), places, "row long, at long").groupBy("row").agg(F.bitmap_construct_agg("at").alias("b"))
    out = np.zeros(bits // 8, np.uint8)
    for r in rows.toLocalIterator():
        out[r.row * (ROW // 8) : (r.row + 1) * (ROW // 8)] = np.frombuffer(bytes(r.b), np.uint8)
    return out


def variants(words: DataFrame, factor: int = FACTOR, most_bits: int = BITS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a table (word, n) of distinct words."""
    spark = words.sparkSession

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hashes(b.column(0).to_pylist()).view(np.int64))], names=["word", "n", "h"])

    vocabulary = common.checkpoint(common.in_arrow(words.select("word", "n"), hashed, "word string, n long, h long"))
    size = vocabulary.count()
    bits = min(most_bits, max(ROW, 1 << (256 * max(1, size) - 1).bit_length()))
    letters = vocabulary.select(F.explode(F.split("word", "")).alias("c")).filter("c <> ''").distinct()
    # at most as many rows as there are letters of the runs' alphabet
    alphabet = np.array(sorted(ord(r.c) for r in letters.collect()), np.uint32)
    known = spark.sparkContext.broadcast(bitmap(vocabulary, bits))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = known.value
        for b in batches:
            names, counts = b.column(0).to_pylist(), b.column(1).to_numpy()
            for at, x in codes(names).values():
                for kind, top, s, h, mask in neighbours(x, alphabet):
                    first = (h & np.uint64(bits - 1)).astype(np.int64)
                    w, p, c = np.nonzero((held[first >> 3] >> (first & 7).astype(np.uint8)) & mask)
                    left = maybe(held, h[w, p, c], bits)
                    for bit in (left[k : k + (1 << 16)] for k in range(0, len(left), 1 << 16)):
                        who = at[top + w[bit]]
                        found = [spelled(names[i], kind, q, d) for i, q, d in zip(who.tolist(), (s + p[bit]).tolist(), alphabet[c[bit]].tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([names[i] for i in who.tolist()], pa.string()), pa.array(counts[who])], names=["word", "other", "n"])

    emitted = common.in_arrow(vocabulary.select("word", "n").repartition(common.partitions(spark)), near, "word string, other string, n long")
    # of largest n and, of equal ones, smallest in code-point order, which is that of UTF-8
    best = F.min(F.struct((-F.col("n")).alias("low"), F.col("other").alias("other")))
    reached = emitted.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    found = vocabulary.select("word", "n").join(reached, "word", "left")
    taken = -F.col("best.low") >= factor * F.col("n")
    formed = common.checkpoint(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best.other")).alias("form"), F.when(taken, -F.col("best.low")).alias("form_n")))
    return formed.join(roots(formed), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(formed: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: each round replaces a word's target by its target's target."""
    now = formed.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        onward = now.select(F.col("word").alias("mid"), F.col("root").alias("far"))
        then = common.checkpoint(now.join(onward, F.col("root") == F.col("mid"), "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        if then.filter("moved").isEmpty():
            return then.select("word", "root")
        now = then.select("word", "root")


def query(df: DataFrame) -> DataFrame:
    """op13: words of the documents after the contract's noise, in their groups."""
    return variants(counted(df, words=noisy))
