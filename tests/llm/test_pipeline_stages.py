"""Each stage of the pipeline against another implementation of what it decides, on what its predecessor kept."""

from __future__ import annotations

import collections
import re

import duckdb
import numpy as np
import pytest
import xxhash
from test_operators import PATTERNS, classes, valid, words

import corpus_pipeline as cp
from lodestone.llm import common, language, mixing, pii

DATA = "/root/testdata/sf0.001"


MORE = [(10**6, "12 34 !!", "en"), (10**6 + 1, None, "en"), (10**6 + 2, "", None), (10**6 + 3, "Der schnelle braune Fuchs und die faulen Hunde schlafen", None), (10**6 + 4, "Write to someone@example.org or +1 234 567 8901 today", "en")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The given documents and some without a letter or a language."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    more = spark.createDataFrame([(i, t, lang, "src1", len(t or "")) for i, t, lang in MORE], docs.schema)
    where = str(tmp_path_factory.mktemp("pipeline"))
    docs.unionByName(more).write.parquet(f"{where}/documents.parquet")
    return where


@pytest.fixture(scope="module")
def stages(spark, folder):
    """The rows that enter each stage, and the last one's output."""
    now = spark.read.parquet(f"{folder}/documents.parquet")
    out = [now]
    for _, stage in cp.STAGES:
        now = common.checkpoint(stage(spark, now, folder))
        out.append(now)
    return out


def by_id(df):
    rows = df.collect()
    got = {r.doc_id: r for r in rows}
    assert len(got) == len(rows)
    return got


def test_language(stages):
    before, after = by_id(stages[0]), by_id(stages[1])
    assert set(after) == {i for i, r in before.items() if any(c.isalpha() for c in r.text or "")}
    assert set(before) - set(after) == {10**6, 10**6 + 1, 10**6 + 2} and all(after[i].text == before[i].text for i in after)
    profiles = language.fit(stages[0], ~language.held_out())
    model = language.Model(profiles)
    filled = [i for i in after if before[i].lang is None]
    assert all(after[i].lang == (before[i].lang or model.predict(before[i].text)[0]) for i in after)
    named = [r for r in before.values() if r.lang and r.doc_id in after and len(r.text) > 200]
    assert np.mean([model.predict(r.text)[0] == r.lang for r in named]) > 0.95 and 10**6 + 3 in filled


def fingerprint(text):
    w = words(text)
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    set_bits = collections.Counter()
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        set_bits.update(i for i in range(64) if h >> i & 1)
    return sum(1 << i for i in range(64) if 2 * set_bits[i] > len(shingles))


def test_simhash(stages):
    before, after = by_id(stages[1]), by_id(stages[2])
    ids = sorted(before)
    fp = [fingerprint(before[i].text) for i in ids]
    pairs = [(a, b) for a in range(len(ids)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 2]
    root = classes(len(ids), pairs)
    assert set(after) == {i for k, i in enumerate(ids) if root[k] == k} and len(after) < len(before)
    assert all(tuple(after[i]) == tuple(before[i]) for i in after)


def test_pii(stages):
    before, after = by_id(stages[2]), by_id(stages[3])
    spans = {r.doc_id: r.spans for r in pii.find(stages[2]).collect()}
    assert set(after) == set(before)
    changed = 0
    for i, r in before.items():
        found = []
        for k, s in enumerate(x for x in spans[i].split(",") if x):
            kind, a, b = s.rsplit(":", 2)
            found.append((int(a), k, int(b), kind))
        base = {(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, r.text) if valid(k, m[0])}
        assert base <= {(kind, a, b) for a, _, b, kind in found}
        merged = []
        for a, _, b, kind in sorted(found):
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b, kind])
        text, at = "", 0
        for a, b, kind in merged:
            text, at = f"{text}{r.text[at:a]}<{kind.upper()}>", b
        text += r.text[at:]
        assert after[i].text == text and after[i].n_chars == len(text)
        changed += bool(merged)
    assert changed


def test_mixing(stages):
    con = duckdb.connect()
    documents = stages[3].select("doc_id", "text", "lang", "source").toArrow()
    con.register("documents", documents)
    sql = mixing.ORACLE.replace("sum(tokens) * 60 / 100", f"sum(tokens) * {cp.BUDGET} / 100")
    assert sql != mixing.ORACLE
    cursor = con.execute(sql)
    at = [c[0] for c in cursor.description]
    want = {r[at.index("doc_id")]: r[at.index("copies")] for r in cursor.fetchall()}
    got = collections.Counter(r.doc_id for r in stages[4].select("doc_id").collect())
    assert got == {i: n for i, n in want.items() if n}
    texts = by_id(stages[3])
    assert all(tuple(r) == tuple(texts[r.doc_id]) for r in stages[4].collect())


def test_bpe(stages):
    from tokenizers import Tokenizer

    from lodestone.llm import queries

    library = Tokenizer.from_file(queries.vocabulary_path())
    before = {r.doc_id: r for r in stages[4].collect()}
    after = stages[5].collect()
    assert len(after) == stages[4].count()
    for r in after:
        assert r.ids == library.encode(before[r.doc_id].text, add_special_tokens=False).ids and (r.lang, r.source, r.n_tokens) == (before[r.doc_id].lang, before[r.doc_id].source, len(r.ids))


def test_run_is_its_stages(spark, stages, folder):
    key = lambda r: (r.doc_id, tuple(r.ids))
    assert sorted(map(key, cp.run(spark, folder).collect())) == sorted(map(key, stages[5].collect()))
