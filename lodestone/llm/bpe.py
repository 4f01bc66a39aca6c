"""Byte-level BPE encoding and decoding as streaming transducers.

A prefix's encoding ends in exactly one token, and a run of tokens is an encoding if and only if each two neighbours stay
apart: no merge across their border comes before the merges that use up its two sides. So the encoder keeps, for each
byte position it may still need, the last token of the prefix that ends there, and extends this table byte by byte
(a token that ends here is right if the prefix before it ends in a token from which it stays apart). The merge list bounds how
far later bytes reach back: lookahead() follows chains of ever earlier merges that overlap to the right. A token is emitted once
that many bytes have been read beyond it, and the table is cut there, so memory stays constant however long a piece runs.

Texts are cut by the tokenizer's own pattern, and special tokens are taken out before that, as the tokenizers library does. Both
cuts end a stream: Encoder runs one long piece in windows, Lanes runs many short pieces side by side, one byte of each at a
time, with the same table as arrays. Texts are taken in segments of bounded size, and ids leave segment by segment. Words met
before are looked up in a cache of two generations; it changes speed alone.

The decoder turns ids to bytes block by block and bytes to text by an incremental UTF-8 state machine, which holds at most
three bytes and replaces what cannot be part of a character.

Defined results. A null text counts as empty and has no tokens; repeated rows give repeated rows; texts are read whole;
only the id and text columns are read. An unknown id raises KeyError."""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, filterfalse, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common

# The byte-level pattern of the public tokenizer, with its white space spelled out.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
CUT = regex.compile(rf"(?<=[^{SPACE}]) (?=[^{SPACE}])")
CROWDED = re.compile(f" [{SPACE}]")  # else a space always belongs to the word after it
CACHE = 1 << 17
#: bytes of the longest piece that Lanes takes and bytes it takes at a time; code points of a segment, and of a word worth keeping
LANE, LANES, SEGMENT, WORD = 64, 1 << 16, 1 << 18, 128
LATIN = "\u0250"  # below it, isalpha() and \p{L} agree in every Unicode version
NEVER = 1 << 30


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """A merge list with what the transducers look up."""

    def __init__(self, definition: str) -> None:
        spec = json.loads(definition)
        model = spec["model"]
        if model["type"] != "BPE" or spec.get("normalizer") or model.get("dropout") or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("only byte-level BPE without normaliser, dropout and prefix space is supported")
        letters = byte_letters()

        def raw(s: str) -> bytes:
            return bytes(letters[c] for c in s)

        self.ids = {raw(k): v for k, v in model["vocab"].items()}
        self.bytes_of = {v: k for k, v in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        # the decoder reads a special token's letters as byte letters where all of them are
        self.bytes_of |= {i: raw(s) if all(c in letters for c in s) else s.encode() for s, i in self.special.items()}
        self.joins: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.joins.setdefault(self.ids[raw(a)] << 20 | self.ids[raw(b)], rank)
        self.longest = max(map(len, self.ids))
        #: of each token that is its own encoding: what its last and its first byte belong to, and the merge that ends it
        self.right: dict[int, list[tuple[int, int]]] = {}
        self.left: dict[int, list[tuple[int, int]]] = {}
        self.rank: dict[int, int] = {}
        for token, i in self.ids.items():
            if len(token) == 1:
                self.rank[i], self.right[i], self.left[i] = -1, [(i, NEVER)], [(i, NEVER)]
        self.apart: dict[int, bool] = {}
        for key, rank in self.joins.items():  # in order of rank
            a, b = key >> 20, key & ((1 << 20) - 1)
            i = self.ids[self.bytes_of[a] + self.bytes_of[b]]
            if i not in self.right and a in self.right and b in self.right and self._first(a, b) == rank:
                self.rank[i] = rank
                self.right[i] = [(i, NEVER), (b, rank), *self.right[b][1:]]
                self.left[i] = [(i, NEVER), (a, rank), *self.left[a][1:]]
        self.starts = {t: i for t, i in self.ids.items() if i in self.right}

    def _first(self, a: int, b: int) -> int:
        """Rank of a merge that fires across the border of a and b, NEVER if none does.

        It fires if its rank comes before the merge that uses up its left side, and not after the one that uses up its
        right side (of equal merges the left one goes first)."""
        joins = self.joins
        for x, x_ends in self.right[a]:
            for y, y_ends in self.left[b]:
                k = joins.get(x << 20 | y, NEVER)
                if k < x_ends and k <= y_ends and k < NEVER and not (x == a and y == b):
                    return k
        return joins.get(a << 20 | b, NEVER)

    def stays_apart(self, a: int, b: int) -> bool:
        """Whether a and b, next to each other, are the encoding of their bytes."""
        key = a << 20 | b
        known = self.apart.get(key)
        if known is None:
            known = self._first(a, b) == NEVER
            if len(self.apart) < 4 * CACHE:
                self.apart[key] = known
        return known

    def lookahead(self) -> int:
        """Bytes after which a token's end cannot change any more: the longest chain of tokens, each made by an earlier merge
        than the one before it and overlapping it to the right, counted in bytes."""
        reach: dict[bytes, int] = {}  # of a string: most bytes beyond it in chains that begin with a token which it opens
        most = 1
        for token, rank in sorted(((self.bytes_of[t], r) for t, r in self.rank.items()), key=lambda x: x[1]):
            ahead = len(token) + max((reach.get(token[i:], 0) for i in range(1, len(token))), default=0)
            most = max(most, ahead)
            for i in range(1, len(token)):
                if ahead - i > reach.get(token[:i], 0):
                    reach[token[:i]] = ahead - i
        return most


class Table:
    """A fixed map of non-negative numbers to numbers for whole arrays of keys, by open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int) -> None:
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, missing, np.int64)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]] = keys[free]  # of several keys for one slot the last one gets it
            self.values[at[free]] = values[free]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        there = self.keys[at]
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            there = self.keys[at[left]]
            left = left[(there != keys[left]) & (there >= 0)]
        return self.values[at]  # an empty slot holds the value for missing keys


class Lanes:
    """The transducer over many short pieces at once: each is a lane, and all lanes move on by one byte together."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        v = vocabulary
        # the tokens that are their own encodings as a trie: node * 256 + byte to node
        nodes: dict[bytes, int] = {b"": 0}
        steps: dict[int, int] = {}
        token: list[int] = [-1]
        for text, i in v.starts.items():
            for n in range(1, len(text) + 1):
                if text[:n] not in nodes:
                    nodes[text[:n]] = len(token)
                    steps[nodes[text[: n - 1]] << 8 | text[n - 1]] = len(token)
                    token.append(-1)
            token[nodes[text]] = i
        self.token = np.array(token, np.int64)
        self.step = Table(np.fromiter(steps, np.int64, len(steps)), np.fromiter(steps.values(), np.int64, len(steps)), -1)
        self.joins = Table(np.fromiter(v.joins, np.int64, len(v.joins)), np.fromiter(v.joins.values(), np.int64, len(v.joins)), NEVER)
        self.length = np.zeros(max(v.bytes_of) + 1, np.int64)
        for i, text in v.bytes_of.items():
            self.length[i] = len(text)
        self.right, self.left = self._spines(v.right), self._spines(v.left)
        self.pair, self.known = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)

    def _spines(self, of: dict[int, list[tuple[int, int]]]) -> tuple[np.ndarray, ...]:
        """Where each token's entries begin, how many they are, and the entries."""
        n = np.zeros(len(self.length), np.int64)
        for i, x in of.items():
            n[i] = len(x)
        flat = np.array([y for i in sorted(of) for y in of[i]], np.int64)
        return np.cumsum(n) - n, n, flat[:, 0], flat[:, 1]

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Vocabulary.stays_apart of arrays; answers are kept in a table of fixed size, where later ones overwrite."""
        key = a << 20 | b
        slot = ((key.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(44)).astype(np.int64)
        out = self.known[slot]
        new = np.flatnonzero(self.pair[slot] != key)
        if len(new):
            found, back = np.unique(key[new], return_inverse=True)
            got = self._stay(found >> 20, found & ((1 << 20) - 1))
            out[new] = got[back]
            self.pair[slot[new]], self.known[slot[new]] = key[new], out[new]
            clash = self.pair[slot[new]] != key[new]  # two new pairs of one slot: neither is kept
            self.pair[slot[new][clash]] = -1
        return out

    def _stay(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        (a_at, a_n, x, x_ends), (b_at, b_n, y, y_ends) = self.right, self.left
        wide = b_n[b]
        n = a_n[a] * wide
        starts = np.cumsum(n) - n
        who = np.repeat(np.arange(len(a)), n)
        local = np.arange(len(who)) - starts[who]
        i, j = a_at[a][who] + local // wide[who], b_at[b][who] + local % wide[who]
        rank = self.joins(x[i] << 20 | y[j])
        return ~np.logical_or.reduceat((rank < x_ends[i]) & (rank <= y_ends[j]) & (rank < NEVER), starts)

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian unsigned 32-bit numbers; no piece is empty."""
        out: list[bytes] = []
        at = 0
        while at < len(pieces):
            to, size = at, 0
            while to < len(pieces) and (to == at or size + len(pieces[to]) <= LANES):
                size += len(pieces[to])
                to += 1
            out += self._run(pieces[at:to])
            at = to
        return out

    def _run(self, pieces: list[bytes]) -> list[bytes]:
        data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        size = np.array([len(p) for p in pieces], np.int64)
        first = np.cumsum(size) - size
        lane = np.repeat(np.arange(len(pieces)), size)
        stop = (first + size)[lane]
        # every place of every token: walk the trie from all bytes at once
        at, node, depth = np.arange(len(data)), np.zeros(len(data), np.int64), 0
        starts, ends, tokens = [], [], []
        while len(at):
            node = self.step(node << 8 | data[at + depth])
            at, node, depth = at[node >= 0], node[node >= 0], depth + 1
            t = self.token[node]
            hit = t >= 0
            starts.append(at[hit])
            ends.append(at[hit] + depth)
            tokens.append(t[hit])
            more = at + depth < stop[at]
            at, node = at[more], node[more]
        start, end, t = np.concatenate(starts), np.concatenate(ends), np.concatenate(tokens)
        begins = first[lane[start]]
        order = np.argsort(end - begins, kind="stable")
        start, end, t, opening = start[order], end[order], t[order], (start == begins)[order]
        cuts = np.searchsorted((end - begins[order]), np.arange(1, int(size.max()) + 2))
        last = np.full(len(data) + 1, -1, np.int64)  # of the prefix that ends before a byte; of a lane's first byte it is never asked
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            mine = opening[s:e].copy()
            inner = np.flatnonzero(~mine)
            mine[inner] = self.apart(last[start[s:e][inner] - 1], t[s:e][inner])
            last[end[s:e][mine] - 1] = t[s:e][mine]
        # back from each lane's end
        now, who, found, count = (first + size).copy(), np.arange(len(pieces)), [], np.zeros(len(pieces), np.int64)
        while len(who):
            got = last[now - 1]
            found.append((who, got))
            count[who] += 1
            now = now - self.length[got]
            more = now > first[who]
            now, who = now[more], who[more]
        ids, free = np.empty(int(count.sum()), "<u4"), np.cumsum(count)
        for who, got in found:
            free[who] -= 1
            ids[free[who]] = got
        raw, bounds = ids.tobytes(), [0, *(4 * np.cumsum(count)).tolist()]
        return [raw[i:j] for i, j in zip(bounds, bounds[1:], strict=False)]


class Encoder:
    """Streaming transducer for one piece: feed() bytes and take the tokens that are stable, then finish()."""

    def __init__(self, vocabulary: Vocabulary, window: int = 4096) -> None:
        self.v, self.window, self.ahead = vocabulary, window, vocabulary.lookahead()
        self.reset()

    def reset(self) -> None:
        self.text = b""
        self.last: list[int] = [-1]  # of each position of text, the last token of the prefix that ends there
        self.before = -1  # the last token emitted

    def _advance(self, n: int) -> None:
        text, last, starts, apart, known, longest = self.text, self.last, self.v.starts.get, self.v.stays_apart, self.v.apart.get, self.v.longest
        for end in range(len(last), n + 1):
            for start in range(end - 1, max(-1, end - longest - 1), -1):
                t = starts(text[start:end])
                if t is None:
                    continue
                prior = last[start] if start else self.before
                if prior < 0:
                    if start:
                        continue
                else:
                    ok = known(prior << 20 | t)
                    if not (apart(prior, t) if ok is None else ok):
                        continue
                last.append(t)
                break
            else:
                last.append(-1)

    def _path(self, end: int) -> list[int]:
        out = []
        while end:
            out.append(t := self.last[end])
            end -= len(self.v.bytes_of[t])
        return out[::-1]

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for at in range(0, len(data), self.window):
            self.text += data[at : at + self.window]
            self._advance(n := len(self.text))
            stable = n
            while stable > n - self.ahead and stable:  # back to the last token that has the whole lookahead after it
                stable -= len(self.v.bytes_of[self.last[stable]])
            if stable:
                out += self._path(stable)
                self.before = self.last[stable]
                self.text, self.last = self.text[stable:], [-1, *self.last[stable + 1 :]]
                self.last[1:] = [t if t >= 0 and len(self.v.bytes_of[t]) <= i else -1 for i, t in enumerate(self.last[1:], 1)]
        return out

    def finish(self) -> list[int]:
        out = self._path(len(self.text))
        self.reset()
        return out


def little(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


class Tokenizer:
    """Texts to ids (as little-endian unsigned 32-bit numbers) and back."""

    def __init__(self, definition: str, cache: int = CACHE) -> None:
        self.v = Vocabulary(definition)
        self.lanes, self.encoder, self.cache = Lanes(self.v), Encoder(self.v), cache
        self.young: dict[str, bytes] = {}  # ids of words after a space
        self.old: dict[str, bytes] = {}
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.v.special, key=len, reverse=True)))) if self.v.special else None

    def _pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of distinct pieces."""
        raw = [p.encode() for p in pieces]
        short = [i for i, r in enumerate(raw) if len(r) <= LANE]
        out = dict(zip((pieces[i] for i in short), self.lanes.encode([raw[i] for i in short]), strict=True))
        for p, r in zip(pieces, raw, strict=True) if len(short) < len(raw) else ():
            if len(r) > LANE:
                out[p] = little(self.encoder.feed(r) + self.encoder.finish())
        return out

    def _segments(self, segments: list[str]) -> list[bytes]:
        """The ids of segments; words that the cache lacks are encoded together."""
        split = [CUT.split(s) if "  " in s or CROWDED.search(s) else s.split(" ") for s in segments]
        if len(self.young) > self.cache:
            self.old, self.young = self.young, {}
        met: set[str] = set()
        for words in split:
            met.update(words)
        young, old, need, cut = self.young, self.old, [], {}
        for w in filterfalse(young.__contains__, met):
            ids = old.get(w)
            if ids is not None:
                young[w] = ids
            elif w.isalpha() and max(w) < LATIN:
                need.append(w)
            elif w[-1:] in (".", ",") and w[:-1].isalpha() and max(w) < LATIN:
                cut[w] = (" " + w[:-1], w[-1])
            else:
                cut[w] = PIECE.findall(" " + w)
        heads = [PIECE.findall(words[0]) for words in split]  # a segment's first word has no space before it
        pieces = {" " + w for w in need}
        pieces.update(*cut.values(), *heads)
        known = self._pieces(list(pieces))
        long: dict[str, bytes] = {}
        for w in need:
            (young if len(w) <= WORD else long)[w] = known[" " + w]
        for w, parts in cut.items():
            (young if len(w) <= WORD else long)[w] = b"".join(map(known.__getitem__, parts))

        def either(w: str) -> bytes:
            return long[w] if w in long else young[w]

        look = either if long else young.__getitem__
        return [b"".join(map(known.__getitem__, head)) + b"".join(map(look, words[1:])) for head, words in zip(heads, split, strict=True)]

    def _giant(self, stretch: str) -> Iterator[bytes]:
        """The ids of a long stretch without a place to cut, piece by piece; a long piece leaves window by window."""
        held: list[str] = []

        def out() -> bytes:
            known = self._pieces(list(set(held)))
            return b"".join(map(known.__getitem__, held))

        for m in PIECE.finditer(stretch):
            piece = m[0]
            if len(piece) > LANE:
                yield out()
                held = []
                for at in range(0, len(piece), self.encoder.window):
                    yield little(self.encoder.feed(piece[at : at + self.encoder.window].encode()))
                yield little(self.encoder.finish())
                continue
            held.append(piece)
            if len(held) >= 1 << 14:
                yield out()
                held = []
        yield out()

    def _parts(self, text: str) -> Iterator[str | int]:
        """Special tokens as ids, and segments between them, cut before a single space between two words."""
        at = 0
        for m in [*(self.special.finditer(text) if self.special else ()), None]:
            end = m.start() if m else len(text)
            while at < end:
                to = end
                if end - at > 2 * SEGMENT:
                    cut = CUT.search(text, at + SEGMENT, end)
                    to = cut.start() if cut else end
                yield text[at:to]
                at = to
            if m:
                yield self.v.special[m[0]]
                at = m.end()

    def flow(self, texts: Iterable[str]) -> Iterator[tuple[int, bytes]]:
        """(row, ids) of the texts in order, each text in as many parts as its size asks for."""
        held: list[tuple[int, str]] = []
        size = 0

        def out() -> Iterator[tuple[int, bytes]]:
            yield from zip([row for row, _ in held], self._segments([s for _, s in held]), strict=True)

        for row, text in enumerate(texts):
            for part in self._parts(text):
                if isinstance(part, str) and len(part) <= 4 * SEGMENT:
                    held.append((row, part))
                    size += len(part)
                    if size <= 2 * SEGMENT:
                        continue
                yield from out()
                held, size = [], 0
                if isinstance(part, int):
                    yield row, part.to_bytes(4, "little")
                elif len(part) > 4 * SEGMENT:
                    yield from ((row, ids) for ids in self._giant(part))
        yield from out()

    def encode(self, text: str) -> bytes:
        return b"".join(ids for _, ids in self.flow([text]))

    def decoder(self) -> Callable[[bytes, bool], str]:
        """A function of one text's next ids, and whether they are its last, to the text that is complete by then."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        return lambda ids, final=False: machine.decode(b"".join(map(self.v.bytes_of.__getitem__, memoryview(ids).cast("I"))), final)

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """The text in parts, each block of ids as soon as it is read."""
        machine, ids = self.decoder(), iter(ids)
        while block := list(islice(ids, 65536)):
            yield machine(np.array(block, "<u4").tobytes())
        yield machine(b"", True)


_TOKENIZERS: dict[str, Tokenizer] = common.HELD.setdefault("bpe", {})


def tokenizer(definition: str) -> Tokenizer:
    """The process's tokenizer of this definition."""
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[key] = Tokenizer(definition)
    return _TOKENIZERS[key]


def read_definition(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(df: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with n_tokens and ids (array<int>). The definition at `path` is read by the driver; its size is fixed."""
    from pyspark.sql import types as T

    shared = df.sparkSession.sparkContext.broadcast(read_definition(path))
    src = df.select(*keep, F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(shared.value)
        for b in batches:
            texts = common.filled(b.column(b.num_columns - 1))
            for s, e in common.string_chunks(texts, 4 * common.CHUNK_BYTES):
                parts = list(t.flow(texts[s:e].to_pylist()))
                ends = np.zeros(e - s + 1, np.int32)
                np.add.at(ends, np.array([row + 1 for row, _ in parts], np.int64), np.array([len(x) // 4 for _, x in parts], np.int32))
                np.cumsum(ends, out=ends)
                flat = pa.array(np.frombuffer(b"".join(x for _, x in parts), "<i4"))
                yield pa.RecordBatch.from_arrays([*(c[s:e] for c in b.columns[:-1]), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), flat)], names=[*keep, "n_tokens", "ids"])

    return common.in_arrow(src, run, T.StructType([*src.schema.fields[:-1], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]), "bpe")


def round_trip(df: DataFrame, path: str) -> DataFrame:
    """op5: (doc_id, n_tokens, ids_sha256, decoded_sha256); ids stay in the task that encodes and decodes them."""
    shared = df.sparkSession.sparkContext.broadcast(read_definition(path))
    src = df.select(F.col("doc_id"), F.col("text").cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(shared.value)
        for b in batches:
            texts = common.filled(b.column(1)).to_pylist()
            n, ids_sha, text_sha, at = [], [], [], -1

            def close() -> None:
                h.update(read(b"", True).encode())
                ids_sha.append(g.hexdigest())
                text_sha.append(h.hexdigest())

            for row, ids in chain(t.flow(texts), [(len(texts), b"")]):
                while at < row:  # texts without ids have no part
                    if at >= 0:
                        close()
                    at += 1
                    if at < len(texts):
                        n.append(0)
                        g, h, read = hashlib.sha256(), hashlib.sha256(), t.decoder()
                if at < len(texts):
                    n[at] += len(ids) // 4
                    g.update(ids)
                    h.update(read(ids).encode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return common.in_arrow(src, run, f"doc_id {src.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string", "bpe")
