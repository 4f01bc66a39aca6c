"""Documents to training tokens in five stages, each written as Parquet and read again by whoever runs them one by one.

Language ID drops documents without a language (no letter at all); SimHash keeps the document of smallest doc_id of each
group of near copies; PII replaces personal data in the text; mixing takes documents as often as the budgets of their
sources say; BPE encodes. All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, common, language, mixing, pii, queries, simhash

#: the mixture's budget in hundredths of the tokens that reach it
BUDGET = 100


def columns(df: DataFrame, row: str, names: list[str]) -> DataFrame:
    return df.select(*[F.col(row)[c].alias(c) for c in names])


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; lang is the predicted one where it was null. Learns from labelled documents.

    Null, empty and letterless texts are rejected (all texts stay where no labelled text has a letter); a null id counts as not held out;
    ties go to the first language by name; repeated rows stay repeated; an empty table gives none; other columns, of whatever name, pass unread."""
    profiles = language.fit(docs, ~language.held_out())
    named = language.predict(docs, profiles)
    kept = named.filter(F.col("lang_pred") != "und") if profiles else named
    lang = F.coalesce(F.col("row")["lang"], F.col("lang_pred"))
    return kept.select(*[lang.alias(c) if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns])


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of smallest doc_id; a null id is larger than all others.

    Of a group's rows that share the id, that of smallest fingerprint stays, and of equal fingerprints any one. Rows that share an id
    but not a group are judged apart. Null and empty texts are copies of one another; texts are read whole; an empty table gives no rows; other
    columns, of whatever name, pass unread."""
    near = common.checkpoint(simhash.near_duplicates(docs).select("doc_id", "component_id", "fp", "root"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    ids = near.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.max(kept).alias("kept"))
    ids = common.checkpoint(ids)
    rows = common.packed(docs)
    once = columns(rows.join(ids.filter("n = 1 and kept").select(F.col("doc_id").alias("id")), F.col("row.doc_id") == F.col("id"), "left_semi"), "row", docs.columns)
    many = ids.filter("n > 1").select(F.col("doc_id").alias("id"))
    unclear = near.join(many, F.col("doc_id") == F.col("id"), "left_semi").unionByName(near.filter("doc_id is null"))
    if unclear.isEmpty():
        return once
    # of each group, the kept row's id and fingerprint; then one row of those that have both
    chosen = unclear.filter(kept).groupBy("root").agg(F.first("component_id").alias("id"), F.min("fp").alias("fp1"))
    some = rows.join(many, F.col("row.doc_id") == F.col("id"), "left_semi").unionByName(rows.filter("row.doc_id is null"))
    marked = simhash.fingerprints(some.select("row", F.col("row.text").alias("text")), keep=("row",))
    same = marked.join(chosen, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("fp") == F.col("fp1")), "left_semi")
    return once.unionByName(columns(same.withColumn("doc_id", F.col("row.doc_id")).dropDuplicates(["doc_id", "fp"]), "row", docs.columns))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars counts the new text.

    Null and empty texts and texts without personal data stay as they are; every row stays, repeated ones and those without an id too; very long
    texts are read whole, in time in proportion to them; an empty table gives none; other columns pass unread."""
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the target weights of their sources, each as often as its leaf's budget says.

    Null languages and sources are names of their own; null and wordless texts have no tokens and are taken in whole epochs; ties in
    the order cannot arise but between rows that share an id (null ids share one), which are taken alike within a source; an empty table gives none;
    other columns pass unread."""
    return mixing.mixed(docs, hundredths=BUDGET)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids).

    A null or empty text has no ids; repeated rows and rows without an id stay; texts are read whole; an empty table gives none; of other
    columns none is kept."""
    return bpe.encode(docs, queries.vocabulary_path(), keep=("doc_id", "lang", "source"))


STAGES = [("language_id", identify), ("simhash_dedup", deduplicate), ("pii", redact), ("mixing", mix), ("bpe", encode)]
ORACLE_SQL = None  # SimHash classes and BPE have no SQL form; tests hold run() against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.checkpoint(docs)
    return docs
