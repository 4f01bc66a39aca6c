"""Mixing where ids repeat or are missing, over several levels of ranges, against the SQL; what a plan costs the texts."""

from __future__ import annotations

import collections

import duckdb
import numpy as np
import pytest

from lodestone.llm import mixing

NAMES = ["doc_id", "domain", "lang", "source", "n_tokens", "copies"]


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows without an id and a third with the same one, most of them of one source, some without words."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(1200):
        doc = [None, 7, i][i % 3]
        lang = ["en", "en", "en", "de", None][int(rng.integers(5))]
        source = ["src2", "src2", "src2", "src1", "other", None][int(rng.integers(6))]
        rows.append((doc, " ".join(["w"] * int(rng.integers(0, 9))) or None, lang, source, i))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).checkpoint()


def by_sql(df, hundredths):
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text", "lang", "source").toArrow())
    sql = mixing.ORACLE.replace("sum(tokens) * 60 / 100", f"sum(tokens) * {hundredths} / 100")
    return collections.Counter(con.execute(f"SELECT {', '.join(NAMES)} FROM ({sql})").fetchall())


@pytest.mark.parametrize(("per_range", "level", "most", "hundredths"), [(4096, 3, 32 << 20, 60), (1, 1, 0, 60), (1, 2, 32 << 20, 130), (2, 1, 0, 100), (4096, 3, 0, 0), (1, 1, 32 << 20, 250)])
def test_repeated_and_missing_ids(spark, hot, monkeypatch, per_range, level, most, hundredths):
    monkeypatch.setattr(mixing, "PER_RANGE", per_range)
    monkeypatch.setattr(mixing, "LEVEL", level)
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", most)
    want = by_sql(hot, hundredths)
    got = mixing.mix(hot, hundredths=hundredths)
    assert collections.Counter(map(tuple, got.select(*NAMES).collect())) == want
    # the documents themselves: as many of each id, language and source as the copies say
    there = collections.Counter((r.doc_id, r.lang or "", r.source or "", len((r.text or "").split())) for r in mixing.mixed(hot, hundredths=hundredths).collect())
    told = collections.Counter()
    for (doc, _, lang, source, n, copies), rows in want.items():
        if copies:
            told[doc, lang, source, n] += copies * rows
    assert there == told


def test_one_id_in_two_sources(spark):
    """Each row goes by its own source's budget."""
    rows = [(1, "a b c d", "en", "src1", 7)] + [(i, "a b c d", "en", "src2", 7) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = collections.Counter(r.source for r in mixing.mixed(df, hundredths=10).collect())
    copies = {(r.doc_id, r.source): r.copies for r in mixing.mix(df, hundredths=10).collect()}
    assert got["src1"] == copies[1, "src1"] and got["src2"] == sum(n for (_, s), n in copies.items() if s == "src2")


def test_domains_are_an_option(spark, hot):
    """Any column of the source may be the domain; one that is null is a domain named ''."""
    got = mixing.mix(hot, weights={"domain": {"src2": 3}}, domain=lambda source: source).collect()
    assert {r.domain for r in got} == {"src1", "src2", "other", ""} and all(r.domain == r.source for r in got)


def test_texts_are_not_shuffled(spark, hot):
    plan = mixing.mixed(hot)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "Sort" not in plan
    assert "regexp_replace" not in plan  # words are counted once, before


def test_the_last_range_is_sorted_by_id_not_by_row(spark, hot, monkeypatch):
    """The window that ends an epoch holds ids: 1,200 rows of 402 ids make no more than a row an id and leaf."""
    seen = []
    real = mixing.common.checkpoint
    monkeypatch.setattr(mixing.common, "checkpoint", lambda df: seen.append(df) or real(df))
    mixing.mix(hot)
    last = seen[-1]._jdf.queryExecution().optimizedPlan().toString()
    assert last.index("Window") < last.rindex("Aggregate")  # read from the leaves up, rows are summed first
