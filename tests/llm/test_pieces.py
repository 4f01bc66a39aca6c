from __future__ import annotations

import hashlib
import time

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import pieces, queries

PATH = queries.vocabulary_path(queries.PIECES)


@pytest.fixture(scope="module")
def own():
    return pieces.Model(pieces.read_model(PATH))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


WORDS = st.lists(st.sampled_from(["the", " ", "  ", "    ", "▁", "▁▁", "tion", "é", "😀", "中文", "\n", "\x00", "<s>", "<0x0A>", "A", "ing", ".", "1999"]), max_size=30).map("".join)


@given(st.one_of(st.text(max_size=40), WORDS))
@settings(max_examples=600, deadline=None)
def test_any_text(own, library, s):
    ids = library.encode(s)
    assert own.encode(s).tolist() == ids and own.decode(ids) == library.decode(ids)


@given(st.lists(st.one_of(st.integers(0, 260), st.integers(0, 31999), st.just(28705)), max_size=12), st.integers(1, 4))
@settings(max_examples=600, deadline=None)
def test_any_ids(own, library, ids, block):
    d = own.decoder()
    assert own.decode(ids) == library.decode(ids)
    assert "".join([*(d.feed(ids[i : i + block]) for i in range(0, len(ids), block)), d.feed([], True)]) == library.decode(ids)


def test_parts_and_cache(own, library, monkeypatch):
    text = "  lorem ipsum▁ dolor  sit   amet, 中文 consectetur " * 60 + " "
    expected = library.encode(text)
    monkeypatch.setattr(pieces, "SEGMENT", 50)
    monkeypatch.setattr(pieces, "CACHE", 5)
    fresh = pieces.Model(pieces.read_model(PATH))
    assert len(list(fresh.parts(text))) > 10 and "".join(fresh.parts(text)) == "▁" + text.replace(" ", "▁")
    assert fresh.encode(text).tolist() == expected and len(fresh.words) <= 5


def test_whole_texts_without_word_borders(own, library, monkeypatch):
    monkeypatch.setattr(own, "by_words", False)
    text = "the cat  sat▁on the mat " * 20
    assert own.encode(text).tolist() == library.encode(text)


def test_time_grows_gently(own):
    def seconds(n):
        began = time.process_time()
        own.symbols("x" * n)
        return time.process_time() - began

    seconds(1000)
    assert seconds(400_000) < 12 * max(0.05, seconds(100_000))


def test_refuses_other_models():
    raw = pieces.read_model(PATH)
    with pytest.raises(ValueError):
        pieces.Model(raw + bytes([0x0A, 7, 0x0A, 1, 65, 0x18, 4, 0x18, 4]))  # a piece of a user
    with pytest.raises(IndexError):
        pieces.Model(raw).decode([-1])


def test_op12(spark, docs, edges, nothing, own, library):
    for df in (docs, edges):
        expected = []
        for r in df.collect():
            ids = library.encode(r.text or "")
            sha = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids))]
            expected.append((r.doc_id, len(ids), *sha))
        assert sorted(map(tuple, pieces.round_trip(df, PATH).collect()), key=str) == sorted(expected, key=str)
    assert pieces.round_trip(nothing, PATH).collect() == [] and pieces.differences(nothing, PATH).collect() == []


def test_library_in_arrow_batches(spark, edges, monkeypatch):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert pieces.differences(documents, PATH).collect() == [] and pieces.differences(edges, PATH).collect() == []


def test_tables(spark, edges):
    ids = pieces.encode(edges, PATH, keep=("doc_id", "text"))
    back = pieces.decode(ids.withColumnRenamed("text", "before"), PATH, keep=("doc_id", "before"))
    rows = back.collect()
    assert len(rows) == edges.count() and all(r.text == (r.before or "") for r in rows)
    odd = spark.createDataFrame([(1, None), (2, []), (3, [None, 264])], "doc_id long, ids array<int>")
    assert sorted(map(tuple, pieces.decode(odd, PATH).collect()), key=str) == [(1, None), (2, ""), (3, "a")]
