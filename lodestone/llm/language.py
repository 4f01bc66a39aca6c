"""Language identification by rank-order n-gram profiles (Cavnar and Trenkle 1994).

A text is lowered and cut to letters, words set apart by one mark; its 1- to 4-grams (a mark may begin or end a gram) are
ranked by frequency. Grams are told by the upper 40 bits of a 64-bit hash. A language's profile is the ranking over its labelled texts. The out-of-place distance adds, over the
text's TOP most frequent grams, how far each one's rank lies from its rank in the profile, TOP where the profile lacks it;
the nearest language is predicted. score is 1 - distance / (TOP x grams).

Profiles are fitted on a bounded sample: about SAMPLE labelled texts of each language, drawn by a 62-bit hash of id and text (equal rows are drawn together).

Defined results. `und` with score 0 for a text that is null or has no letter, and for all texts when no labelled text has
a letter. Ties between languages go to the first by name, ties between grams to the smaller hash. Repeated rows give
repeated rows; texts are read whole; only the id, text and label columns are read, the label for fitting only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestone.llm import common

GRAMS, TOP, SAMPLE = (1, 2, 3, 4), 300, 2000
_BITS = 40
_LOW = (1 << _BITS) - 1
_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def grams(text: str) -> np.ndarray:
    """Sorted hashes of all n-grams of the text, with repeats."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    real = letters()[codes] if len(codes) else np.empty(0, bool)
    if not real.any():
        return np.empty(0, np.uint64)
    padded = np.zeros(len(codes) + 2, np.uint32)
    padded[1:-1] = np.where(real, codes, 0)
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != 0) | (padded[:-1] != 0)
    padded = padded[keep]
    mark = np.concatenate([[0], np.cumsum(padded == 0)])
    total = []
    for n in GRAMS:
        if len(padded) < n:
            break
        h = common.rolling(padded, n) + np.uint64(n)
        good = padded != 0 if n == 1 else (mark[n - 1 : len(mark) - 1] - mark[1 : len(mark) - n + 1] == 0) if n > 2 else np.ones(len(h), bool)
        total.append(h[good])
    out = np.concatenate(total) >> np.uint64(64 - _BITS)
    out.sort()
    return out


def counted(sorted_grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_grams):
        return sorted_grams, np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], sorted_grams[1:] != sorted_grams[:-1]]))
    return sorted_grams[first], np.diff(np.append(first, len(sorted_grams)))


def ranked(text: str, top: int = TOP) -> np.ndarray:
    """The text's most frequent grams, most frequent first; of equal counts the smaller hash first."""
    g = grams(text)
    if not len(g):
        return g
    gram, count = counted(g)
    if count.max() >> (64 - _BITS):  # too many to stand beside the gram in one number
        return gram[np.lexsort((gram, -count))[:top]]
    key = (count.astype(np.uint64) << np.uint64(_BITS)) | (np.uint64(_LOW) - gram)
    if len(key) > top:
        key = np.partition(key, len(key) - top)[-top:]
    key = np.sort(key)[::-1]
    return np.uint64(_LOW) - (key & np.uint64(_LOW))


def fit(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE, top: int = TOP) -> dict[str, list[int]]:
    """Each language's profile: its grams, most frequent first."""
    known = df.filter(train & F.col(label_col).isNotNull()).select(F.col(label_col).alias("label"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    share = {r.label: min(1.0, sample / r.n) for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not share:
        return {}
    least = F.create_map(*[F.lit(x) for k, v in share.items() for x in (k, common.threshold(v))])[F.col("label")]
    drawn = known.filter(common.draw("id", "t") < least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for label, parts in held.items():
                gram, n = counted(np.sort(np.concatenate(parts)))
                if len(gram):
                    yield pa.RecordBatch.from_arrays([pa.array([label] * len(gram)), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], names=["label", "gram", "n"])
            held.clear()

        for b in batches:
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.setdefault(label, []).append(g := grams(text or ""))
                size += len(g)
                if size > 1 << 20:
                    yield from out()
                    size = 0
        yield from out()

    total = common.in_arrow(drawn.select("label", "t"), run, "label string, gram long, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "gram"))
    best = total.withColumn("rank", rank).filter(F.col("rank") <= top).collect()  # TOP rows a language
    profiles: dict[str, list[int]] = {}
    for r in sorted(best, key=lambda r: (r.label, r["rank"])):
        profiles.setdefault(r.label, []).append(r.gram)
    return profiles


class Model:
    """Profiles laid out for lookup."""

    def __init__(self, profiles: dict[str, list[int]], top: int = TOP) -> None:
        self.names, self.top = sorted(profiles), top
        self.known = np.unique(np.array([g for p in profiles.values() for g in p], np.uint64))
        self.rank = np.full((len(self.names), len(self.known) + 1), -1, np.int64)
        for i, name in enumerate(self.names):
            self.rank[i, np.searchsorted(self.known, np.array(profiles[name], np.uint64))] = np.arange(len(profiles[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        own = ranked(text or "", self.top)
        if not len(own) or not self.names:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
        there = np.where(self.known[at] == own, at, len(self.known))
        theirs = self.rank[:, there]
        far = np.where(theirs < 0, self.top, np.abs(theirs - np.arange(len(own)))).sum(axis=1)
        best = int(far.argmin())
        return self.names[best], 1.0 - float(far[best]) / (self.top * len(own))


def predict(df: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", top: int = TOP) -> DataFrame:
    """(row, lang_pred, score): each row of the table as one column, whatever the names in it, beside its prediction."""
    src = common.packed(df).select("row", F.col(f"row.`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(profiles, top)
        for b in batches:
            for s, e in common.string_chunks(common.filled(b.column(1)), 8 * common.CHUNK_BYTES):
                p = b.slice(s, e - s)
                got = [model.predict(t.as_py()) for t in p.column(1)]
                yield pa.RecordBatch.from_arrays([p.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=["row", "lang_pred", "score"])

    return common.in_arrow(src, run, T.StructType([src.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(df: DataFrame) -> DataFrame:
    """op6: (doc_id, held_out, lang_pred, score); learns from rows that are not held out."""
    profiles = fit(df, ~held_out())
    return predict(df.select("doc_id", "text"), profiles).select(F.col("row.doc_id").alias("doc_id"), held_out("row.doc_id").alias("held_out"), "lang_pred", "score")
