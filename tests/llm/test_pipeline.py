"""The corpus pipeline, stage by stage and against brute force."""

from __future__ import annotations

import corpus_pipeline as cp

DATA = "/root/testdata/sf0.001"


def test_run(spark):
    from tokenizers import Tokenizer

    from lodestone.llm import queries

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    now, kept = docs, []
    for name, stage in cp.STAGES[:-1]:
        now = stage(spark, now, DATA)
        assert now.columns == docs.columns, name
        kept.append(now.count())
    assert kept[0] >= kept[1] == kept[2]
    theirs = Tokenizer.from_file(queries.vocabulary_path())
    texts = {}
    for r in now.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    out = cp.run(spark, DATA).collect()
    assert len(out) == kept[-1]
    for r in out:
        assert r.ids == theirs.encode(texts[r.doc_id][0], add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_edges(spark, edges, nothing):
    for start in (edges, nothing):
        now = start
        for i, (_, stage) in enumerate(cp.STAGES):
            now = stage(spark, now, DATA)
            assert i == len(cp.STAGES) - 1 or now.columns == start.columns
        assert now.count() <= start.count() * 2


def test_documents_without_an_id(spark):
    """Texts of their own stay, one of each group of copies, whether or not the others have an id."""
    rows = [(None, "one two three four five"), (None, "six seven eight nine ten"), (None, "six seven eight nine ten"), (3, "alpha beta gamma delta"), (None, "alpha beta gamma delta"), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t or ""), "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score string, lang_pred int")
    got = sorted(((r.doc_id, r.text or "") for r in cp.deduplicate(spark, docs, DATA).collect()), key=str)
    assert got == sorted([(None, "one two three four five"), (None, "six seven eight nine ten"), (3, "alpha beta gamma delta"), (None, "")], key=str)
    named = cp.identify(spark, docs, DATA)
    assert named.columns == docs.columns and sorted(r.text for r in named.collect()) == sorted(t for _, t in rows if t)


def test_repeated_ids(spark):
    """Of rows that share an id, the one in the kept group stays; one that is a copy of a smaller document goes."""
    a, b = "alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight"
    rows = [(1, a), (2, a), (2, b), (2, b), (3, b), (4, a + " iota")]
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id, r.text) for r in cp.deduplicate(spark, docs, DATA).collect())
    from lodestone.llm import simhash

    fp = {t: simhash.fingerprint(t.encode()) for _, t in rows}
    assert (fp[a] ^ fp[b]).bit_count() > 2 and (fp[a] ^ fp[a + " iota"]).bit_count() > 2
    assert got == [(1, a), (2, b), (4, a + " iota")]
