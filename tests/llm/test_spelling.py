from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows):
    c = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 5:
                c[w] += 1
    return {w: n for w, n in c.items() if n >= 3}


def brute(v):
    by_size = defaultdict(list)
    for w in v:
        by_size[len(w)].append(w)
    near = {w: [x for s in (-1, 0, 1) for x in by_size[len(w) + s] if one_apart(w, x)] for w in v}
    form = {}
    for w in v:
        if near[w]:
            b = min(near[w], key=lambda x: (-v[x], x))
            if v[b] >= 2 * v[w]:
                form[w] = b

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), v.get(form.get(w))) for w, n in v.items())


def test_op13(spark, docs):
    got = sorted(tuple(r) for r in spelling.query(docs).collect())
    expected = brute(brute_words([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))
    assert sorted(got, key=lambda r: r[0]) == sorted(expected, key=lambda r: r[0])
    assert any(r[1] for r in got) and any(r[2] not in (r[0], r[1]) for r in got)


def test_edges(spark, edges, nothing):
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    assert sorted((tuple(r) for r in spelling.query(edges).collect()), key=lambda r: r[0]) == sorted(brute(brute_words(rows)), key=lambda r: r[0])
    empty = spelling.query(nothing)
    assert empty.collect() == [] and [f.name for f in empty.schema] == ["word", "form", "root", "n", "n_near", "form_n"]
    odd = [(None, "Straße Strasse STRASSE strasse ××××× ××××× ×××××"), (1, "ÉCOLE École école écoles ecole ecole ecoleİcole Kelvin"), (1, "aaaaa aaaaa aaaaa aaaaaa aaaaaa aaaaaa"), (2, None), (3, "")]
    got = spelling.query(spark.createDataFrame(odd, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[0]) == sorted(brute(brute_words(odd)), key=lambda r: r[0])


def test_very_long_words(spark):
    rows = [(i, w) for i, w in enumerate(["ab" * 20000 + "q", "ab" * 20000 + "q", "ab" * 20000 + "q", *["ab" * 20000] * 6])]
    got = sorted((len(r.word), r.form and len(r.form), r.n, r.n_near) for r in spelling.variants(spelling.counted(spark.createDataFrame(rows, "doc_id long, text string"))).collect())
    assert got == [(40000, None, 6, 1), (40001, 40000, 3, 1)]


def test_full_bitmap_costs_no_result(spark):
    v = {w: n for n, w in enumerate(["carat", "caret", "carets", "cared", "cares", "scares", "bared", "barred", "bareds"], 3)}
    words = spark.createDataFrame(list(v.items()), "word string, n long")
    for bits in (spelling.ROW, 1 << 18):
        assert sorted((tuple(r) for r in spelling.variants(words, most_bits=bits).collect()), key=lambda r: r[0]) == sorted(brute(v), key=lambda r: r[0])


def test_long_chains(spark):
    v = {"a" * (5 + i): 3 * 2**i for i in range(20)}
    words = spark.createDataFrame(list(v.items()), "word string, n long")
    got = {r.word: r.root for r in spelling.variants(words).collect()}
    assert set(got.values()) == {"a" * 24}


@given(st.lists(st.text("abc", min_size=1, max_size=6), min_size=1, max_size=4, unique=True))
@settings(max_examples=80, deadline=None)
def test_neighbourhood_is_whole_and_distinct(words):
    alphabet = np.array(sorted({ord(c) for w in words for c in w}), np.uint32)
    for at, x in spelling.codes(words).values():
        emitted = defaultdict(list)
        for kind, top, s, h, mask in spelling.neighbours(x, alphabet):
            for w, p, c in zip(*np.nonzero(mask), strict=True):
                word = spelling.spelled(words[at[top + w]], kind, s + int(p), int(alphabet[c]))
                assert spelling.hashes([word])[0] == h[w, p, c]
                emitted[words[at[top + w]]].append(word)
        letters = [chr(c) for c in alphabet]
        for w, found in emitted.items():
            whole = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + k :] for k in (0, 1) for i in range(len(w) + 1 - k) for c in letters}
            assert len(found) == len(set(found)) and set(found) == whole - {w}
