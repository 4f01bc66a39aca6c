"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is normalised (spaces become U+2581, one more goes before a text that isn't empty), and its symbols, single
characters at first, stand in a linked list. The agenda holds every pair of adjacent symbols whose joined text is a piece,
best score first and, of equal scores, leftmost first. The best pair is merged, its new pairs with its neighbours join the
agenda, and entries whose symbols have changed meanwhile are passed over when they come up. What no piece covers is spelled in
byte pieces.

No merge crosses two characters that stand side by side in no piece, so a text is cut there and the agenda runs over one
stem at a time. Where no piece holds U+2581 after another character, words (with the U+2581 before them) are cut first. Words and stems met
before are looked up; the caches change speed alone. Very long texts are taken in parts that end before a word.

The decoder turns ids into bytes, drops the U+2581 that normalisation put first, turns the others into spaces and
replaces each byte that can't be part of a character by U+FFFD, incrementally, as the library does.

differences() holds both against the sentencepiece library in Arrow batches.

Defined results. A null text counts as empty and has no ids; repeated rows give repeated rows; texts are read whole; an
empty table gives no rows; columns other than those asked for are not read. An unknown id raises IndexError. Models with a
normaliser other than identity, user-defined or unused pieces, or without byte pieces raise ValueError."""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
from collections.abc import Callable, Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import islice
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import common

MARK = "▁"
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: words (and half as many stems) kept by a worker, about 200 bytes each; code points of a word worth keeping, of a text taken at a time
CACHE, WORD, SEGMENT = 1 << 20, 64, 1 << 20
PLACES = (1 << 40) - 1
WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
CUT = re.compile(f"(?<=[^ {MARK}])(?=[ {MARK}])")


def _each_byte(e: UnicodeError) -> tuple[str, int]:
    if not isinstance(e, UnicodeDecodeError):
        raise e
    return "�" * (e.end - e.start), e.end


codecs.register_error("lodestone-each-byte", _each_byte)


def messages(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = raw[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, raw[at : at + size]
        at += size


class Known(dict):
    """The ids of strings as little-endian bytes, found when first asked for; forgets all when full."""

    def __init__(self, find: Callable[[str], bytes], most: int) -> None:
        super().__init__()
        self.find, self.most = find, most

    def __missing__(self, word: str) -> bytes:
        ids = self.find(word)
        if len(word) <= WORD:
            if len(self) >= self.most:
                self.clear()
            self[word] = ids
        return ids


class Model:
    """A merge-type vocabulary with its encoder and decoder."""

    def __init__(self, raw: bytes) -> None:
        pieces, trainer, normal = [], {}, {}
        for field, value in messages(raw):
            if field == 1:
                x = dict(messages(value))
                pieces.append((x[1].decode(), struct.unpack("<f", x[2])[0] if 2 in x else 0.0, x.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(messages(value))
            elif field == 3:
                normal = dict(messages(value))
        kinds = {kind for _, _, kind in pieces}
        if trainer.get(3, 1) != 2 or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE} or sum(kind == BYTE for _, _, kind in pieces) != 256:
            raise ValueError("only merge-type models with byte pieces and without pieces of users are supported")
        if normal.get(2, b"") or normal.get(4, 1) or not normal.get(3, 1) or not normal.get(5, 1) or trainer.get(24, 0):
            raise ValueError("only the identity normaliser with a space put first is supported")
        self.ids = {text: i for i, (text, _, kind) in enumerate(pieces) if kind == NORMAL}
        order = {score: k for k, score in enumerate(sorted({s for _, s, kind in pieces if kind == NORMAL}, reverse=True))}
        #: of each piece its place by score, which equal scores share, shifted to leave room for a place in the text
        self.place = {text: order[score] << 40 for text, score, kind in pieces if kind == NORMAL}
        self.byte = {int(text[3:-1], 16): i for i, (text, _, kind) in enumerate(pieces) if kind == BYTE}
        spelled = {i: bytes([b]) for b, i in self.byte.items()}
        unknown = trainer.get(44, b" \xe2\x81\x87 ")
        self.bytes_of = [spelled[i] if kind == BYTE else text.replace(MARK, " ").encode() if kind == NORMAL else unknown if kind == UNKNOWN else b"" for i, (text, _, kind) in enumerate(pieces)]
        self.control = {i for i, (_, _, kind) in enumerate(pieces) if kind == CONTROL}
        self.marked = [kind == NORMAL and text.startswith(MARK) for text, _, kind in pieces]
        self.by_words = not any(re.search(f"[^{MARK}]{MARK}", text) for text in self.ids)
        self.beside = {text[i : i + 2] for text in self.ids for i in range(len(text) - 1)}
        self.words, self.stems = Known(lambda word: self.spell(MARK + word), CACHE), Known(self.merge, CACHE // 2)

    def symbols(self, text: str) -> list[str]:
        """The symbols that remain of a normalised text when the agenda is empty."""
        n, place = len(text), self.place.get
        agenda = [k + i for i, k in enumerate(map(place, map(add, text, text[1:]))) if k is not None]
        if n < 2 or not agenda:
            return list(text)
        symbol, before, after = list(text), list(range(-1, n - 1)), list(range(1, n + 1))
        heapify(agenda)
        while agenda:
            best = heappop(agenda)
            i = best & PLACES
            j = after[i]
            if not symbol[i] or j >= n or place(whole := symbol[i] + symbol[j]) != best - i:
                continue  # a neighbour was merged into something else
            symbol[i], symbol[j] = whole, ""
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                if (k := place(whole + symbol[j])) is not None:
                    heappush(agenda, k + i)
            if (h := before[i]) >= 0 and (k := place(symbol[h] + whole)) is not None:
                heappush(agenda, k + h)
        return [s for s in symbol if s]

    def merge(self, text: str) -> bytes:
        """Ids of a stem, as little-endian 32-bit numbers."""
        out: list[int] = []
        for s in self.symbols(text):
            i = self.ids.get(s)
            if i is None:
                out += [self.byte[b] for b in s.encode()]
            else:
                out.append(i)
        return struct.pack(f"<{len(out)}i", *out)

    def spell(self, text: str) -> bytes:
        """Ids of a normalised text: of its stems, one after the other."""
        cuts = [i for i, pair in enumerate(map(add, text, text[1:]), 1) if pair not in self.beside]
        return b"".join([self.stems[text[i:j]] for i, j in zip([0, *cuts], [*cuts, len(text)], strict=True)])

    def parts(self, text: str) -> Iterator[str]:
        """The normalised text, cut where no merge crosses."""
        at = 0
        while self.by_words and len(text) - at > 2 * SEGMENT and (cut := CUT.search(text, at + SEGMENT)):
            yield (MARK if not at else "") + text[at : cut.start()].replace(" ", MARK)
            at = cut.start()
        if text:
            yield (MARK if not at else "") + text[at:].replace(" ", MARK)

    def flow(self, text: str) -> Iterator[bytes]:
        """The text's ids in bounded parts."""
        for part in self.parts(text):
            if not self.by_words:
                yield self.spell(part)
                continue
            words = part[1:].split(MARK)
            if "" in words:  # runs of spaces belong to the word after them
                words = [w[1:] for w in WORDS.findall(part)]
            yield b"".join(map(self.words.__getitem__, words))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.flow(text)), "<i4")

    def decoder(self) -> Decoder:
        return Decoder(self)

    def decode(self, ids: Iterable[int]) -> str:
        d, ids, out = self.decoder(), iter(ids), []
        while block := list(islice(ids, 65536)):
            out.append(d.feed(block))
        return "".join([*out, d.feed([], True)])


class Decoder:
    """Ids to text, block by block; holds the bytes of one character at most."""

    def __init__(self, model: Model) -> None:
        self.model, self.begun = model, False
        self.machine = codecs.getincrementaldecoder("utf-8")("lodestone-each-byte")

    def feed(self, ids: list[int], final: bool = False) -> str:
        """The text that is complete by now; a control piece shows nothing, and ends a character that isn't."""
        if ids and min(ids) < 0:
            raise IndexError("ids are not negative")
        out, at = [], 0
        if not self.model.control.isdisjoint(ids):
            for k, i in enumerate(ids):
                if i in self.model.control:
                    out.append(self._plain(ids[at:k], True))
                    at = k + 1
        out.append(self._plain(ids[at:] if at else ids, final))
        return "".join(out)

    def _plain(self, ids: list[int], final: bool) -> str:
        raw = b"".join(map(self.model.bytes_of.__getitem__, ids))
        if ids and not self.begun:
            self.begun = True
            raw = raw[self.model.marked[ids[0]] :]
        return self.machine.decode(raw, final)


_MODELS: dict[str, Model] = common.HELD.setdefault("pieces", {})


def model(raw: bytes) -> Model:
    """The process's model of this file."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(raw)
    return _MODELS[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def texts_of(df: DataFrame, path: str, text_col: str, keep: tuple[str, ...], add: str, row) -> DataFrame:
    """The kept columns with those of `add`, whose values row(model, text) gives. The model at `path` is read by the driver; its size is fixed."""
    shared = df.sparkSession.sparkContext.broadcast(read_model(path))
    src = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias("__text"))
    kinds = T._parse_datatype_string(add).fields
    schema = T.StructType([*src.schema.fields[:-1], *kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(shared.value)
        types = [pa.list_(pa.int32()) if isinstance(f.dataType, T.ArrayType) else pa.int64() if isinstance(f.dataType, T.LongType) else pa.string() for f in kinds]
        for b in batches:
            texts = common.filled(b.column(b.num_columns - 1))
            for s, e in common.string_chunks(texts, 4 * common.CHUNK_BYTES):
                rows = [row(m, t) for t in texts[s:e].to_pylist()]
                new = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*(c[s:e] for c in b.columns[:-1]), *new], names=[*b.schema.names[:-1], *(f.name for f in kinds)])

    return common.in_arrow(src, run, schema, "pieces")


def encode(df: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with n_tokens and ids (array<int>)."""

    def row(m: Model, text: str) -> tuple:
        ids = m.encode(text)
        return len(ids), ids

    return texts_of(df, path, text_col, keep, "n_tokens long, ids array<int>", row)


def decode(df: DataFrame, path: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with text, decoded from the ids; null ids give a null text, null entries are passed over."""
    shared = df.sparkSession.sparkContext.broadcast(read_model(path))
    src = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{ids_col}`").cast("array<int>").alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(shared.value)
        for b in batches:
            texts = [None if not x.is_valid else m.decode(i for i in x.as_py() if i is not None) for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[*b.schema.names[:-1], "text"])

    return common.in_arrow(src, run, T.StructType([*src.schema.fields[:-1], T.StructField("text", T.StringType())]), "pieces")


def digests(m: Model, text: str) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of the decimal ids joined by commas, SHA-256 of the text decoded from the ids."""
    n, g, h, d = 0, hashlib.sha256(), hashlib.sha256(), m.decoder()
    for part in m.flow(text):
        ids = memoryview(part).cast("i").tolist()
        for at in range(0, len(ids), 1 << 16):
            block = ids[at : at + (1 << 16)]
            g.update((("," if n else "") + ",".join(map(str, block))).encode())
            h.update(d.feed(block).encode())
            n += len(block)
    h.update(d.feed([], True).encode())
    return n, g.hexdigest(), h.hexdigest()


def round_trip(df: DataFrame, path: str) -> DataFrame:
    """op12: (doc_id, n_tokens, ids_sha256, decoded_sha256); ids stay in the task that encodes and decodes them."""
    return texts_of(df, path, "text", ("doc_id",), "n_tokens long, ids_sha256 string, decoded_sha256 string", digests)


def differences(df: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of rows whose ids or decoded text are not those of the sentencepiece library, with both numbers of ids."""
    library: dict[str, object] = {}

    def row(m: Model, text: str) -> tuple:
        import sentencepiece

        if "it" not in library:
            library["it"] = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        ids, theirs = m.encode(text).tolist(), library["it"].encode(text)
        return len(ids), len(theirs), "" if ids == theirs and m.decode(ids) == library["it"].decode(theirs) else "differs"

    shared = df.sparkSession.sparkContext.broadcast(read_model(path))
    return texts_of(df, path, text_col, keep, "n_ids long, n_library long, verdict string", row).filter("verdict <> ''").drop("verdict")
