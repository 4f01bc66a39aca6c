"""The queries of the engine's own operators over the shared tables, and the SQL that gives the same results.

Dense records are the embeddings; sparse multi-label records are the orders of lineitem: feature part mod 500, value
quantity / 50, label supplier mod 50."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import config, hashing
from lodestone.operators import lsh, network, selection, tiles
from lodestone.plans import model, oracle, replicas
from lodestone.sources import array_rows, arrays, params, sparse_text
from lodestone.streaming import trainer

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
K, L, H, NODES, BATCH = 2, 20, 40, 200, 128


def query(sql: str | None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def dense(s: SparkSession, d: str, name: str = "id") -> DataFrame:
    """(id, f, v) of the embeddings."""
    return table(s, d, "embeddings").select(F.col("vec_id").alias(name), F.posexplode("embedding").alias("p", "e")).select(name, F.col("p").cast("long").alias("f"), F.col("e").cast("double").alias("v"))


def labels(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("record_id"), F.col("label").cast("long").alias("label"))


def sparse(s: SparkSession, d: str, name: str = "id") -> DataFrame:
    return table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias(name), (F.col("l_partkey") % 500).alias("f")).agg((F.sum("l_quantity") / 50).alias("v"))


def sparse_labels(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("record_id"), (F.col("l_suppkey") % 50).alias("label")).distinct()


# --- sources -------------------------------------------------------------------------------------------------------


def lines(s: SparkSession, d: str) -> DataFrame:
    """Sparse text lines of the orders (record_id, value), some with tokens that do not parse."""
    li = table(s, d, "lineitem")
    feats = li.groupBy("l_orderkey", (F.col("l_partkey") % 500).alias("f")).agg(F.sum("l_quantity").cast("long").alias("q")).groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", F.col("f").cast("string"), F.col("q").cast("string")))), " ").alias("fs"))
    labs = li.groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_set((F.col("l_suppkey") % 50).cast("string"))), ",").alias("ls"))
    odd = F.when(F.col("l_orderkey") % 7 == 0, F.lit(" x 9: :3  2:z")).otherwise("")
    return labs.join(feats, "l_orderkey").select(F.col("l_orderkey").alias("record_id"), F.concat(F.when(F.col("l_orderkey") % 7 == 0, F.lit("q,,")).otherwise(""), "ls", F.lit(" "), "fs", odd).alias("value"))


@query("WITH f AS (SELECT l_orderkey AS record_id, l_partkey % 500 AS f, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY ALL), g AS (SELECT record_id, count(*) AS n_features, CAST(sum(f) AS BIGINT) AS feature_sum, CAST(sum(q) AS DOUBLE) AS value_sum FROM f GROUP BY ALL), h AS (SELECT l_orderkey AS record_id, count(DISTINCT l_suppkey % 50) AS n_labels FROM lineitem GROUP BY ALL) SELECT g.record_id, n_labels, n_features, feature_sum, value_sum FROM g JOIN h ON g.record_id = h.record_id")
def sparse_text_parse(s: SparkSession, d: str) -> DataFrame:
    r = sparse_text.parse(lines(s, d))
    return r.selectExpr("record_id", "cast(size(labels) as long) as n_labels", "cast(size(features) as long) as n_features", "aggregate(features, 0L, (a, x) -> a + x.f) as feature_sum", "aggregate(features, 0D, (a, x) -> a + x.v) as value_sum")


@query("SELECT l_orderkey AS record_id, CAST(max(CASE WHEN l_orderkey % 7 = 0 THEN 5 ELSE 0 END) AS BIGINT) AS n_rejected FROM lineitem GROUP BY ALL")
def sparse_text_reject_count(s: SparkSession, d: str) -> DataFrame:
    return sparse_text.parse(lines(s, d)).select("record_id", F.col("n_rejected").cast("long").alias("n_rejected"))


BATCHED = "b AS (SELECT record_id, row_number() OVER (ORDER BY record_id) - 1 AS row_idx FROM (SELECT DISTINCT l_orderkey AS record_id FROM lineitem)), bb AS (SELECT record_id, row_idx, row_idx // 128 AS batch_id FROM b)"


def batched(s: SparkSession, d: str) -> DataFrame:
    return sparse_text.batches(table(s, d, "lineitem").select(F.col("l_orderkey").alias("record_id")).distinct(), BATCH)


@query(f"WITH {BATCHED} SELECT record_id, row_idx, batch_id FROM bb")
def batch_assign(s: SparkSession, d: str) -> DataFrame:
    return batched(s, d).select("record_id", "row_idx", "batch_id")


@query(f"WITH {BATCHED}, {oracle.SPARSE_LABELS} SELECT batch_id, count(DISTINCT bb.record_id) AS n_records, count(*) AS n_labels FROM bb JOIN st ON bb.record_id = st.record_id GROUP BY ALL")
def batch_label_counts(s: SparkSession, d: str) -> DataFrame:
    return batched(s, d).join(sparse_labels(s, d), "record_id").groupBy("batch_id").agg(F.countDistinct("record_id").alias("n_records"), F.count("*").alias("n_labels"))


@query(f"WITH {BATCHED} SELECT batch_id, least((row_idx % 128) // 42, 2) AS worker, count(*) AS n FROM bb GROUP BY ALL")
def batch_work_split(s: SparkSession, d: str) -> DataFrame:
    """Three workers share a batch by contiguous chunks; the last one takes what is left."""
    return batched(s, d).groupBy("batch_id", F.least(F.floor(F.col("row_idx") % BATCH / (BATCH // 3)), F.lit(2)).alias("worker")).agg(F.count("*").alias("n"))


def numbered(s: SparkSession, d: str) -> DataFrame:
    """The embeddings by their place in order of id."""
    return sparse_text.batches(table(s, d, "embeddings"), BATCH, "vec_id").withColumnRenamed("row_idx", "row")


# Lines that settings are read from, by kind; each embedding gives one.
CONFIG = ("concat('# K=', vec_id)", "concat('K=', label, ',', vec_id)", "concat(' Lr = 0.', vec_id, ' ')", "concat('Unknown=', vec_id)", "'ab'", "'noequals'", "concat('Batchsize = ', vec_id)", "concat('logFile=a=', vec_id)")
CONFIG_LINE = "CASE vec_id % 8 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(CONFIG)) + " END"
CONFIG_KEYS = ", ".join(f"'{k}'" for k in config.KEYS)


@query(f"WITH c AS (SELECT vec_id AS line_no, {CONFIG_LINE} AS raw FROM embeddings), t AS (SELECT line_no, trim(raw) AS line FROM c WHERE length(trim(raw)) >= 3 AND NOT starts_with(trim(raw), '#') AND contains(raw, '=')), k AS (SELECT line_no, trim(regexp_extract(line, '^([^=]*)=', 1)) AS key, trim(regexp_extract(line, '^[^=]*=(.*)$', 1)) AS value FROM t) SELECT key, arg_max(value, line_no) AS value FROM k WHERE key IN ({CONFIG_KEYS}) GROUP BY key")
def config_parse(s: SparkSession, d: str) -> DataFrame:
    """Settings from a table of lines, of which the last of a key counts."""
    return config.rows(table(s, d, "embeddings").select(F.col("vec_id").alias("line_no"), F.expr(CONFIG_LINE).alias("value")))


@query("WITH c AS (SELECT count(*) AS n, CAST(ceil(ceil(count(*) / 128) / 2) * 128 AS BIGINT) AS b FROM embeddings), r AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, label FROM embeddings) SELECT i // b AS worker, i // b * b AS start, least((i // b + 1) * b, any_value(n)) AS stop, count(*) AS n, CAST(sum(label) AS BIGINT) AS total FROM r, c GROUP BY i // b, b")
def array_partition_ranges(s: SparkSession, d: str) -> DataFrame:
    """The ranges of an array of labels that two workers have, and what lies in them."""
    rows = numbered(s, d)
    parts = [(w, a, b) for w, (a, b) in enumerate(config.ranges(rows.count(), 2, 128))]
    at = F.floor(F.col("row") / (parts[0][2] - parts[0][1]))
    return rows.groupBy(at.alias("worker")).agg(F.count("*").alias("n"), F.sum("label").alias("total")).join(s.createDataFrame(parts, "worker long, start long, stop long"), "worker")


@query("SELECT vec_id // 64 AS block, 'layer0_weights_' || (vec_id // 64 * 64) || '_' || least((vec_id // 64 + 1) * 64, (SELECT count(*) FROM embeddings)) AS key, min(vec_id) AS first_idx, max(vec_id) AS last_idx, count(*) AS n FROM embeddings GROUP BY ALL")
def array_block_keys(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings").select("vec_id", params.block_of(F.col("vec_id"), 64).alias("block"))
    return e.groupBy("block", params.block_key(F.lit("layer0_weights"), F.col("block"), e.count(), 64).alias("key")).agg(F.min("vec_id").alias("first_idx"), F.max("vec_id").alias("last_idx"), F.count("*").alias("n"))


@query("SELECT row_number() OVER (ORDER BY (vec_id * 2654435761 + 1234) % 2147483647, vec_id) - 1 AS pos, vec_id AS idx, CAST(label AS BIGINT) AS val FROM embeddings")
def array_shuffle(s: SparkSession, d: str) -> DataFrame:
    return params.shuffled(table(s, d, "embeddings").select(F.col("vec_id").alias("idx"), F.col("label").cast("long").alias("val")), 1234)


@query("WITH r AS (SELECT 99 + row_number() OVER (ORDER BY vec_id) AS idx, label FROM embeddings) SELECT idx, CASE WHEN idx % 10 = 0 THEN CAST(-label AS BIGINT) ELSE idx * 2 END AS val FROM r")
def array_init_set(s: SparkSession, d: str) -> DataFrame:
    """An array from index 100 on, filled by an expression; a tenth of its elements are set from the table."""
    rows = numbered(s, d).withColumn("idx", F.col("row") + 100)
    a = params.array(s, rows.count(), F.col("id") * 2, offset=100)
    return params.updated(a, rows.filter("idx % 10 = 0").select("idx", (-F.col("label")).cast("long").alias("val")))


def _some(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("name"), F.array(F.size("embedding").cast("long")).alias("shape"), F.lit("<f4").alias("dtype"), F.lit(False).alias("fortran"), F.transform("embedding", lambda x: x.cast("double")).alias("data"))


ARRAYS = "SELECT 'v' || vec_id AS name, CAST(64 AS BIGINT) AS n, '<f4' AS dtype, CAST(embedding[1] AS DOUBLE) AS first_value, CAST(embedding[64] AS DOUBLE) AS last_value FROM embeddings"


def _arrays(df: DataFrame) -> DataFrame:
    return df.select("name", F.size("data").cast("long").alias("n"), "dtype", F.col("data")[0].alias("first_value"), F.element_at("data", -1).alias("last_value"))


def _round(s: SparkSession, d: str, kind: str) -> DataFrame:
    arrays.register(s)
    where = params.scratch(s, kind)
    _some(s, d).write.format(kind).mode("overwrite").save(where)
    return _arrays(s.read.format(kind).load(where))


@query(ARRAYS)
def npy_roundtrip(s: SparkSession, d: str) -> DataFrame:
    return _round(s, d, "npy")


@query(ARRAYS)
def npz_roundtrip(s: SparkSession, d: str) -> DataFrame:
    return _round(s, d, "npz")


@query(ARRAYS)
def npz_append(s: SparkSession, d: str) -> DataFrame:
    """Archives of the even ids, to which those of the odd ones are added."""
    arrays.register(s)
    where, rows = params.scratch(s, "npz"), _some(s, d)
    odd = F.substring("name", 2, 20).cast("long") % 2 == 1
    rows.filter(~odd).write.format("npz").mode("overwrite").save(where)
    rows.filter(odd).write.format("npz").mode("append").save(where)
    return _arrays(s.read.format("npz").load(where))


def one_array(rows: DataFrame, name: str, shape: str, dtype: str) -> DataFrame:
    """One .npy file that all tasks write, scanned by rows in partitions of 16 KiB."""
    s = rows.sparkSession
    array_rows.register(s)
    where = f"{params.scratch(s, 'rows')}/{name}.npy"
    rows.write.format("npy_rows").option("shape", shape).option("dtype", dtype).mode("overwrite").save(where)
    return s.read.format("npy_rows").option("split", 16384).load(where)


@query("SELECT 'big' AS name, row_number() OVER (ORDER BY vec_id) - 1 AS place, '<i8' AS dtype, 9007199254740993 + vec_id AS value FROM embeddings")
def npy_exact(s: SparkSession, d: str) -> DataFrame:
    """Whole numbers beyond the exact doubles, through the raw bytes of an NPY file's rows."""
    rows = numbered(s, d)
    digits = "lpad(hex(9007199254740993L + vec_id), 16, '0')"
    swapped = "concat(" + ", ".join(f"substr({digits}, {15 - 2 * i}, 2)" for i in range(8)) + ")"
    back = one_array(rows.select("row", F.lit(None).cast("array<double>").alias("data"), F.unhex(F.expr(swapped)).alias("raw")), "big", str(rows.count()), "<i8")
    value = "cast(conv(concat(" + ", ".join(f"substr(hex(raw), {15 - 2 * i}, 2)" for i in range(8)) + "), 16, 10) as bigint)"
    return back.select("name", F.col("row").alias("place"), "dtype", F.expr(value).alias("value"))


ROWED = "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, CAST(embedding[1] AS DOUBLE) AS first_value, CAST(embedding[64] AS DOUBLE) AS last_value, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 9) AS total FROM embeddings"


def embedding_rows(s: SparkSession, d: str) -> DataFrame:
    rows = numbered(s, d)
    return one_array(rows.select("row", F.transform("embedding", lambda x: x.cast("double")).alias("data"), F.lit(None).cast("binary").alias("raw")), "vectors", f"{rows.count()},64", "<f4")


def _rowed(df: DataFrame) -> DataFrame:
    return df.select("row", F.col("data")[0].alias("first_value"), F.element_at("data", -1).alias("last_value"), F.round(F.aggregate("data", F.lit(0.0), lambda a, x: a + x), 9).alias("total"))


@query(f"{ROWED}")
def npy_rows_scan(s: SparkSession, d: str) -> DataFrame:
    """All embeddings as one array, written by all tasks and read by rows from many partitions."""
    return _rowed(embedding_rows(s, d))


@query(f"SELECT * FROM ({ROWED}) WHERE row >= (SELECT count(*) // 3 FROM embeddings) AND row < (SELECT count(*) // 2 FROM embeddings)")
def npy_rows_range(s: SparkSession, d: str) -> DataFrame:
    """A range of rows: the conditions reach the scan, which opens the file there."""
    n = table(s, d, "embeddings").count()
    return _rowed(embedding_rows(s, d).filter((F.col("row") >= n // 3) & (F.col("row") < n // 2) & (F.col("name") == "vectors")))


@query("SELECT 'v' || vec_id AS name, t.i AS row, CAST(embedding[t.i + 1] AS DOUBLE) AS value FROM embeddings, range(64) AS t(i) WHERE vec_id IN (1, 4)")
def npz_variable(s: SparkSession, d: str) -> DataFrame:
    """Some variables of archives of all embeddings: the names reach the scan, which reads no other member."""
    arrays.register(s)
    array_rows.register(s)
    where = params.scratch(s, "npz")
    _some(s, d).write.format("npz").mode("overwrite").save(where)
    return s.read.format("npz_rows").load(where).filter(F.col("name").isin("v1", "v4")).select("name", "row", F.col("data")[0].alias("value"))


@query("WITH o AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), r AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS row_idx FROM o), f AS (SELECT l_orderkey AS k, count(DISTINCT l_partkey % 500) AS n_features FROM lineitem GROUP BY ALL), l AS (SELECT l_orderkey AS k, CAST(count(DISTINCT l_suppkey % 50) AS BIGINT) AS n_labels FROM lineitem GROUP BY ALL) SELECT row_idx, n_labels, n_features, CASE WHEN r.k % 7 = 0 THEN 5 ELSE 0 END AS n_rejected FROM r JOIN f ON r.k = f.k JOIN l ON r.k = l.k")
def text_scan(s: SparkSession, d: str) -> DataFrame:
    """The orders' lines as text files, each with a header and a blank line, scanned again."""
    where = params.scratch(s, "text")
    top = table(s, d, "lineitem").agg(F.max("l_orderkey")).first()[0]
    body = lines(s, d).withColumn("part", F.floor(F.col("record_id") * 4 / (top + 1)).cast("int"))
    ends = body.groupBy("part").agg(F.min("record_id").alias("record_id"))
    heads = ends.select("part", "record_id", F.lit(0).alias("kind"), F.lit("records features labels").alias("value")).unionByName(ends.select("part", "record_id", F.lit(1).alias("kind"), F.lit("  ").alias("value")))
    whole = body.select("part", "record_id", F.lit(2).alias("kind"), "value").unionByName(heads)
    whole.repartition("part").sortWithinPartitions("part", "record_id", "kind").select("part", "value").write.partitionBy("part").text(where)
    r = sparse_text.read(s, f"{where}/part=*")
    return r.select("row_idx", F.size("labels").cast("long").alias("n_labels"), F.size("features").cast("long").alias("n_features"), "n_rejected")


# What ends a line in bytes, by document: nothing, a byte that never occurs, a good two-byte letter, half a letter, half a surrogate pair.
ENDS = ("", "20FF", "20C3A9", "20C3", "20EDA080")


@query("SELECT doc_id % 4 AS part, count(*) AS n_lines, count(*) FILTER (doc_id % 5 IN (1, 3, 4)) AS n_invalid, CAST(count(*) FILTER (doc_id % 5 IN (0, 2)) AS BIGINT) AS n_records, CAST(coalesce(sum(coalesce(n_chars, 0)) FILTER (doc_id % 5 IN (0, 2)), 0) AS DOUBLE) AS total FROM documents GROUP BY ALL")
def text_scan_bytes(s: SparkSession, d: str) -> DataFrame:
    """Text files of a line for each document, some of them not UTF-8: such lines are counted and make no records."""
    where = params.scratch(s, "bytes")
    ends = F.element_at(F.array(*[F.unhex(F.lit(x)) for x in ENDS]), (F.col("doc_id") % 5 + 1).cast("int"))
    line = F.concat(F.concat_ws("", (F.col("doc_id") % 50).cast("string"), F.lit(" 1:"), F.coalesce("n_chars", F.lit(0)).cast("string")).cast("binary"), ends).cast("string")
    table(s, d, "documents").select((F.col("doc_id") % 4).alias("part"), line.alias("value")).repartition("part").write.partitionBy("part").text(where)
    part = F.regexp_extract("file", "part=([0-9]+)", 1).cast("long").alias("part")
    records = sparse_text.read(s, f"{where}/part=*", header=False).groupBy(part).agg(F.count("*").alias("n_records"), F.sum(F.expr("aggregate(features, 0D, (a, x) -> a + x.v)")).alias("total"))
    seen = sparse_text.rejected(s, f"{where}/part=*").groupBy(part).agg(F.sum("n_lines").alias("n_lines"), F.sum("n_invalid").alias("n_invalid"))
    return seen.join(records, "part", "left").na.fill(0)


@query("SELECT vec_id AS idx, CASE WHEN vec_id // 64 = 1 THEN -vec_id ELSE vec_id * vec_id END AS val FROM embeddings")
def array_block_write_back(s: SparkSession, d: str) -> DataFrame:
    """An array in blocks of 64; block 1 is read by itself and written back changed."""
    store = params.Store(s, params.scratch(s, "store"))
    store.put_array("a", table(s, d, "embeddings").select(F.col("vec_id").alias("idx"), (F.col("vec_id") * F.col("vec_id")).alias("val")), 64)
    store.put_block("a", 1, store.block("a", 1).select("idx", (-F.col("idx")).alias("val")))
    return store.array("a")


PRESETS = (("default", config.Config()), ("large", config.LARGE))


def preset_row(name: str, c: config.Config) -> tuple:
    return (name, c.input_dim, c.tot_records, c.tot_records_test, c.batch_size, c.rehash, c.rebuild, c.epoch, c.step_size, c.lr, ",".join(map(str, c.sizes)), ",".join(map(str, c.k)), ",".join(map(str, c.l)), ",".join(map(str, c.range_pow)))


# The two workloads' shapes.
@query(
    "SELECT name, input_dim::BIGINT AS input_dim, records::BIGINT AS records, test_records::BIGINT AS test_records, 128::BIGINT AS batch, 6400::BIGINT AS rehash, 128000::BIGINT AS rebuild, 10::BIGINT AS epoch, 1000::BIGINT AS step_size, 1e-4::DOUBLE AS lr, sizes, '2,6' AS k, '20,50' AS l, '6,18' AS range_pow, b AS batches, b * 10 // 50 AS rehashes "
    "FROM (VALUES ('default', 5000, 15539, 3809, '128,3993'), ('large', 203882, 1186239, 153025, '128,13330')) AS t(name, input_dim, records, test_records, sizes), (SELECT count(DISTINCT l_orderkey) // 128 AS b FROM lineitem)"
)
def config_presets(s: SparkSession, d: str) -> DataFrame:
    """The presets, with the batches that they make of the orders and how often a training on these fills the tables anew."""
    rows = s.createDataFrame([preset_row(n, c) for n, c in PRESETS], "name string, input_dim long, records long, test_records long, batch long, rehash long, rebuild long, epoch long, step_size long, lr double, sizes string, k string, l string, range_pow string")
    n = table(s, d, "lineitem").agg(F.countDistinct("l_orderkey").alias("n"))
    each = rows.crossJoin(n).withColumn("batches", F.floor(F.col("n") / F.col("batch")))  # one row
    return each.withColumn("rehashes", F.floor(F.col("batches") * F.col("epoch") / F.floor(F.col("rehash") / F.col("batch")))).drop("n")


@query("SELECT vec_id, CASE WHEN label = 0 THEN 'x' ELSE 'w' END || (vec_id + 1) AS name, CASE WHEN label = 0 THEN NULL ELSE vec_id END AS worker FROM embeddings")
def command_line(s: SparkSession, d: str) -> DataFrame:
    """Worker numbers of process names; other names have none."""
    names = table(s, d, "embeddings").select("vec_id", F.concat(F.when(F.col("label") == 0, "x").otherwise("w"), (F.col("vec_id") + 1).cast("string")).alias("name"))
    return names.withColumn("worker", config.worker_of(F.col("name")))


@query(ARRAYS)
def npz_deflated(s: SparkSession, d: str) -> DataFrame:
    """A compressed archive is read like a stored one."""
    arrays.register(s)
    where = params.scratch(s, "npz")
    _some(s, d).write.format("npz").option("compressed", "true").mode("overwrite").save(where)
    return _arrays(s.read.format("npz").load(where))


@query("SELECT 'v' || vec_id AS name, '<f4' AS dtype, '64' AS shape, false AS fortran FROM embeddings")
def npy_header(s: SparkSession, d: str) -> DataFrame:
    """What the header of each array's file says."""
    arrays.register(s)
    where = params.scratch(s, "npy")
    _some(s, d).write.format("npy").mode("overwrite").save(where)
    return s.read.format("npy").load(where).select("name", "dtype", F.array_join("shape", ",").alias("shape"), "fortran")


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS place, vec_id AS idx, vec_id * 3 AS val FROM embeddings")
def array_iterator(s: SparkSession, d: str) -> DataFrame:
    """Elements in order of index, from a cached array that is dropped afterwards."""
    a = table(s, d, "embeddings").select(F.col("vec_id").alias("idx"), (F.col("vec_id") * 3).alias("val")).persist()
    ordered = model.kept(sparse_text.batches(a, BATCH, "idx").select(F.col("row_idx").alias("place"), "idx", "val"))
    a.unpersist()
    return ordered


@query(f"WITH {BATCHED} SELECT record_id, batch_id FROM bb WHERE batch_id < (SELECT count(*) FROM bb) // 128")
def batch_whole(s: SparkSession, d: str) -> DataFrame:
    """The batches that are trained on: what is left over makes none."""
    return sparse_text.batches(table(s, d, "lineitem").select(F.col("l_orderkey").alias("record_id")).distinct(), BATCH, drop_partial=True).select("record_id", "batch_id")


# --- hashes --------------------------------------------------------------------------------------------------------


@query(f"WITH mk AS (SELECT vec_id AS key FROM embeddings), {oracle.murmur_long('mk')} SELECT key AS vec_id, h FROM mur")
def murmur3_long(s: SparkSession, d: str) -> DataFrame:
    """Spark's own hash is this family's for long keys and seed 42."""
    return table(s, d, "embeddings").select("vec_id", (F.hash("vec_id").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("h"))


@query(f"WITH mk AS (SELECT source AS key FROM documents), {oracle.murmur_ascii('mk', 7)} SELECT doc_id, h FROM documents LEFT JOIN mur ON source = key")
def murmur3_text(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", hashing.murmur3_column(F.col("source").cast("binary"), 7).alias("h"))


DEN = f"WITH {oracle.EMB}, {oracle.layout(64, H)}, {oracle.winners('emb')}, sig AS (SELECT id, bin, pos AS h FROM win)"


@query(f"WITH {oracle.SPARSE}, {oracle.layout(500, 300)}, c AS (SELECT f, count(*) AS n FROM sp GROUP BY f) SELECT perm, lay.f, bin, pos, n FROM lay JOIN c ON lay.f = c.f")
def dwta_layout(s: SparkSession, d: str) -> DataFrame:
    """The places of features in bins, and how many records each place serves."""
    return hashing.layout(s, 500, 300).join(sparse(s, d).groupBy("f").agg(F.count("*").alias("n")), "f")


def dense_signature(s: SparkSession, d: str) -> DataFrame:
    return hashing.dwta(dense(s, d), hashing.layout(s, 64, H))


def sparse_signature(s: SparkSession, d: str) -> DataFrame:
    return hashing.dwta(sparse(s, d), hashing.layout(s, 500, H))


@query(f"{DEN} SELECT id, bin, h FROM sig")
def dwta_dense(s: SparkSession, d: str) -> DataFrame:
    return dense_signature(s, d)


SPW = f"WITH {oracle.SPARSE}, {oracle.layout(500, H)}, {oracle.winners('sp')}, sig AS (SELECT id, bin, pos AS h FROM win)"


@query(f"{SPW} SELECT id, bin, h FROM sig")
def dwta_sparse(s: SparkSession, d: str) -> DataFrame:
    return sparse_signature(s, d)


@query(f"{SPW}, {oracle.probes(H)}, {oracle.densified('sig', H)} SELECT id, bin, h FROM den")
def dwta_densified(s: SparkSession, d: str) -> DataFrame:
    return hashing.densified(sparse_signature(s, d), H)


@query(f"{SPW}, {oracle.probes(H)}, c AS (SELECT bin, count(*) AS n FROM sig GROUP BY bin) SELECT prb.bin, attempt, target, coalesce(n, 0) AS n FROM prb LEFT JOIN c ON c.bin = target")
def densify_probe(s: SparkSession, d: str) -> DataFrame:
    """Where an empty bin looks for a filled one, and in how many records it finds it there."""
    filled = sparse_signature(s, d).groupBy(F.col("bin").alias("target")).agg(F.count("*").alias("n"))
    return hashing.probes(s, H).join(filled, "target", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query(f"WITH {oracle.EMB}, {oracle.layout(64, H)}, {oracle.winners('emb')} SELECT id, bin, f AS h FROM win")
def wta_hash(s: SparkSession, d: str) -> DataFrame:
    return hashing.wta(dense(s, d), hashing.layout(s, 64, H))


@query(f"WITH {oracle.EMB}, t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC, f) AS r FROM emb), {oracle.bins(H, 9, 64)} SELECT id, bin, max(t.f) AS h FROM t JOIN mb ON t.f = mb.f WHERE r <= 30 GROUP BY ALL")
def minhash_topk(s: SparkSession, d: str) -> DataFrame:
    return hashing.minhash(dense(s, d), H, 9)


MHS = f"{oracle.bins(H, 9, 500)}, mh AS (SELECT id, bin, max(sp.f) AS h FROM sp JOIN mb ON sp.f = mb.f GROUP BY ALL)"


@query(f"WITH {oracle.SPARSE}, {MHS} SELECT id, bin, h FROM mh")
def minhash_sparse(s: SparkSession, d: str) -> DataFrame:
    return hashing.minhash(sparse(s, d), H, 9, None)


SRP = f"WITH {oracle.SPARSE}, {oracle.srp(500, H)}, ss AS (SELECT x.id, g.bin, sum(g.sign * x.v) AS s FROM sp x JOIN sg g ON x.f = g.f GROUP BY ALL), ff AS (SELECT i.id, b.b AS bin FROM (SELECT DISTINCT id FROM sp) i, range({H}) AS b(b)), sr AS (SELECT ff.id, ff.bin, CAST(CASE WHEN round(coalesce(s, 0), 12) >= 0 THEN 0 ELSE 1 END AS BIGINT) AS h FROM ff LEFT JOIN ss ON ff.id = ss.id AND ff.bin = ss.bin)"


def srp_signature(s: SparkSession, d: str) -> DataFrame:
    x = sparse(s, d)
    return hashing.srp(x, hashing.srp_layout(s, 500, H), x.select("id").distinct(), H)


@query(f"{SRP} SELECT id, bin, h FROM sr")
def srp_bits(s: SparkSession, d: str) -> DataFrame:
    return srp_signature(s, d)


@query(f"{SRP} SELECT id, bin, h FROM sr")
def srp_merged(s: SparkSession, d: str) -> DataFrame:
    """The same by a merge of sorted features inside each record."""
    x = sparse(s, d)
    return hashing.srp_merged(x, hashing.srp_layout(s, 500, H), x.select("id").distinct(), H)


@query(f"{DEN}, a AS (SELECT id, bin // 2 AS t, min(CASE WHEN h = (h * 3 + bin) % 8 THEN 1 ELSE 0 END) AS same FROM sig WHERE bin < 40 GROUP BY ALL) SELECT id, avg(same) AS rate FROM a GROUP BY id")
def signature_collision(s: SparkSession, d: str) -> DataFrame:
    sig = dense_signature(s, d)
    return hashing.collision(sig, sig.withColumn("h", (F.col("h") * 3 + F.col("bin")) % 8), K, L)


@query(f"{SPW}, {oracle.probes(H)}, {oracle.densified('sig', H)}, {oracle.address('den', K, L)} SELECT id, tbl, bucket FROM adr")
def lsh_address_wta(s: SparkSession, d: str) -> DataFrame:
    return hashing.address_wta(hashing.densified(sparse_signature(s, d), H), K, L)


@query(f"{SRP}, {oracle.address('sr', 4, 10, 1)} SELECT id, tbl, bucket FROM adr")
def lsh_address_srp(s: SparkSession, d: str) -> DataFrame:
    return hashing.address_srp(srp_signature(s, d), 4, 10)


@query(f"WITH {oracle.SPARSE}, {MHS}, {oracle.probes(H)}, {oracle.densified('mh', H)} SELECT id, bin // 2 AS tbl, CAST(sum(((((bin * 2654435761 + 33111) % 1073741823) * 2 + 1) * (h + 1)) % 4294967296) % 4294967296 % 512 AS BIGINT) AS bucket FROM den GROUP BY ALL")
def lsh_address_minhash(s: SparkSession, d: str) -> DataFrame:
    return hashing.address_minhash(hashing.densified(hashing.minhash(sparse(s, d), H, 9, None), H), K, L, 9)


@query(f"WITH {oracle.SPARSE}, {oracle.bins(H, 9, 500)} SELECT f, bin FROM mb WHERE f IN (SELECT f FROM sp)")
def minhash_map(s: SparkSession, d: str) -> DataFrame:
    """The bins of the features that records have."""
    return sparse(s, d).select("f").distinct().select("f", hashing.minhash_bins(F.col("f"), H, 9).alias("bin"))


TOPH = f"WITH {oracle.EMB}, t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC, f) AS r FROM emb), {oracle.bins(H, 9, 64)}, mh AS (SELECT id, bin, max(t.f) AS h FROM t JOIN mb ON t.f = mb.f WHERE r <= 30 GROUP BY ALL)"


@query(f"{TOPH}, {oracle.probes(H)}, {oracle.densified('mh', H)} SELECT id, bin, h FROM den")
def minhash_topk_densified(s: SparkSession, d: str) -> DataFrame:
    return hashing.densified(hashing.minhash(dense(s, d), H, 9), H)


#: a layer with a node for each vector
WEIGHTS = f"WITH {oracle.layer_of('n', 2, 64)}, emb AS (SELECT node AS id, f, w AS v FROM nw)"


def node_rows(s: SparkSession, d: str) -> DataFrame:
    """The weights of a layer with a node for each embedding, as vectors."""
    grid = dense(s, d, "node").select("node", "f")
    return grid.select(F.col("node").alias("id"), "f", model.weight(2, F.col("node"), F.col("f")).alias("v"))


@query(f"{WEIGHTS}, {TOPH[TOPH.index('t AS'):]}, {oracle.probes(H)}, {oracle.densified('mh', H)} SELECT id, bin, h FROM den")
def minhash_weights(s: SparkSession, d: str) -> DataFrame:
    return hashing.densified(hashing.minhash(node_rows(s, d), H, 9), H)


SRPD = f"{oracle.srp(64, H)}, ss AS (SELECT x.id, g.bin, sum(g.sign * x.v) AS s FROM emb x JOIN sg g ON x.f = g.f GROUP BY ALL), sr AS (SELECT id, bin, CAST(CASE WHEN round(s, 12) >= 0 THEN 0 ELSE 1 END AS BIGINT) AS h FROM ss)"


@query(f"WITH {oracle.EMB}, {SRPD} SELECT id, bin, h FROM sr")
def srp_dense(s: SparkSession, d: str) -> DataFrame:
    x = dense(s, d)
    return hashing.srp(x, hashing.srp_layout(s, 64, H), x.select("id").distinct(), H)


@query(f"{WEIGHTS}, {SRPD} SELECT id, bin, h FROM sr")
def srp_weights(s: SparkSession, d: str) -> DataFrame:
    return hashing.srp(node_rows(s, d), hashing.srp_layout(s, 64, H), table(s, d, "embeddings").select(F.col("vec_id").alias("id")), H)


@query(f"WITH {oracle.SPARSE}, {MHS} SELECT bin AS slot, ((bin * 2654435761 + 33111) % 1073741823) * 2 + 1 AS multiplier, count(*) AS n FROM mh GROUP BY bin")
def minhash_multipliers(s: SparkSession, d: str) -> DataFrame:
    """The multipliers of the slots that signatures fill, and by how many records."""
    used = hashing.minhash(sparse(s, d), H, 9, None).groupBy(F.col("bin").alias("slot")).agg(F.count("*").alias("n"))
    return used.withColumn("multiplier", hashing.multiplier(F.col("slot")))


@query(
    f"{DEN}, {oracle.probes(H)}, {oracle.densified('sig', H)}, {oracle.address('den', K, L)}, wsig AS (SELECT id, bin, f % 8 AS h FROM win), {oracle.densified('wsig', H, 'wden')}, {oracle.address('wden', K, L, name='wadr')}, {SRPD}, {oracle.address('sr', K, L, 1, 'sadr')}, {TOPH[TOPH.index('t AS'):]}, {oracle.densified('mh', H, 'mden')}, "
    f"madr AS (SELECT id, bin // 2 AS tbl, CAST(sum(((((bin * 2654435761 + 33111) % 1073741823) * 2 + 1) * (h + 1)) % 4294967296) % 4294967296 % 512 AS BIGINT) AS bucket FROM mden GROUP BY ALL) "
    "SELECT 'dwta' AS family, id, tbl, bucket FROM adr UNION ALL SELECT 'wta', id, tbl, bucket FROM wadr UNION ALL SELECT 'srp', id, tbl, bucket FROM sadr UNION ALL SELECT 'minhash', id, tbl, bucket FROM madr"
)
def family_addresses(s: SparkSession, d: str) -> DataFrame:
    """Where each hash family puts the same activations."""
    x = model.kept(dense(s, d))
    ids, out = x.select("id").distinct(), None
    for family in config.FAMILIES:
        a = hashing.addresses(family, x, ids, 64, K, L, 9).select(F.lit(family).alias("family"), "id", "tbl", "bucket")
        out = a if out is None else out.unionByName(a)
    return out


# --- tables --------------------------------------------------------------------------------------------------------

ADR = f"{DEN}, {oracle.probes(H)}, {oracle.densified('sig', H)}, {oracle.address('den', K, L)}"
SADR = f"{SPW}, {oracle.probes(H)}, {oracle.densified('sig', H)}, {oracle.address('den', K, L)}"


def dense_address(s: SparkSession, d: str) -> DataFrame:
    return hashing.address_wta(hashing.densified(dense_signature(s, d), H), K, L)


def sparse_rows(s: SparkSession, d: str) -> DataFrame:
    return lsh.rows(lsh_address_wta(s, d), F.col("id"))


@query(f"{SADR} SELECT tbl, bucket, node, node AS seq FROM (SELECT tbl, bucket, id AS node, row_number() OVER (PARTITION BY tbl, bucket ORDER BY id DESC) AS r FROM adr) WHERE r <= 128")
def bucket_fifo(s: SparkSession, d: str) -> DataFrame:
    return lsh.fifo(sparse_rows(s, d))


RING = "SELECT tbl, bucket, number % 128 AS slot, node, node AS seq, number FROM {src} WHERE number >= total - 128"


@query(f"{SADR}, nb AS (SELECT tbl, bucket, id AS node, row_number() OVER (PARTITION BY tbl, bucket ORDER BY id % 2, id) - 1 AS number, count(*) OVER (PARTITION BY tbl, bucket) AS total FROM adr) {RING.format(src='nb')}")
def bucket_ring_merge(s: SparkSession, d: str) -> DataFrame:
    """Rings of the orders with even keys, kept, and those with odd keys put into them."""
    rows = model.stored(sparse_rows(s, d))
    first = model.kept(lsh.ring(rows.filter("node % 2 = 0")))
    return lsh.ring(rows.filter("node % 2 = 1"), onto=first)


@query(f"{SADR}, rk AS (SELECT tbl, bucket, id AS node, row_number() OVER (PARTITION BY tbl, bucket ORDER BY id) AS c FROM adr), late AS (SELECT tbl, bucket, arg_max(node, c) AS node FROM rk WHERE c > 128 AND {lsh.DRAW} % c = 1 GROUP BY ALL) SELECT rk.tbl, rk.bucket, CASE WHEN late.node IS NOT NULL AND c - 1 = {lsh.SLOT} THEN late.node ELSE rk.node END AS node, CASE WHEN late.node IS NOT NULL AND c - 1 = {lsh.SLOT} THEN late.node ELSE rk.node END AS seq, CAST(c - 1 AS INT) AS place FROM rk LEFT JOIN late ON rk.tbl = late.tbl AND rk.bucket = late.bucket WHERE c <= 128")
def bucket_reservoir(s: SparkSession, d: str) -> DataFrame:
    return lsh.reservoir(model.stored(sparse_rows(s, d)))


@query(f"{SADR}, e AS (SELECT tbl, bucket, count(*) AS n FROM adr GROUP BY ALL) SELECT tbl, count(*) AS n_buckets, CAST(sum(n) AS BIGINT) AS n_nodes, max(n) AS largest FROM e GROUP BY tbl")
def bucket_stats(s: SparkSession, d: str) -> DataFrame:
    return lsh.stats(sparse_rows(s, d))


#: nodes of a wide layer over 64 inputs, hashed by their weights, and the probes of the embeddings
WIDE = f"WITH {oracle.EMB}, {oracle.LABELS}, {oracle.layout(64, H)}, {oracle.layer('n', 2, NODES, 64)}, nv AS (SELECT node AS id, f, w AS v FROM nw), {oracle.winners('emb', 'w1')}, {oracle.winners('nv', 'w2')}, s1 AS (SELECT id, bin, pos AS h FROM w1), s2 AS (SELECT id, bin, pos AS h FROM w2), {oracle.probes(H)}, {oracle.densified('s1', H, 'd1')}, {oracle.densified('s2', H, 'd2')}, {oracle.address('d1', K, L, 2, 'qa')}, {oracle.address('d2', K, L, 2, 'na')}, bk AS (SELECT tbl, bucket, id AS node FROM (SELECT *, row_number() OVER (PARTITION BY tbl, bucket ORDER BY id DESC) AS r FROM na) WHERE r <= 128), hits AS (SELECT q.id, b.node, count(*) AS n FROM qa q JOIN bk b ON q.tbl = b.tbl AND q.bucket = b.bucket GROUP BY ALL), cand AS (SELECT record_id, node, CAST(sum(n) AS BIGINT) AS n FROM (SELECT id AS record_id, node, n FROM hits UNION ALL SELECT record_id, label, {L} FROM tgt) GROUP BY ALL), pm AS (SELECT n.n AS node, row_number() OVER (ORDER BY (n.n * 2654435761 + 1234) % 2147483647, n.n) - 1 AS pos FROM range({NODES}) AS n(n))"


def wide(s: SparkSession) -> tuple[DataFrame, DataFrame]:
    return model.layer(s, 2, NODES, 64)


def wide_buckets(s: SparkSession) -> DataFrame:
    w, _ = wide(s)
    sig = hashing.dwta(w.select(F.col("node").alias("id"), "f", F.col("w").alias("v")), hashing.layout(s, 64, H))
    return lsh.fifo(lsh.rows(hashing.address_wta(hashing.densified(sig, H), K, L), F.col("id")))


def wide_hits(s: SparkSession, d: str) -> DataFrame:
    return lsh.probe(dense_address(s, d), wide_buckets(s))


def wide_candidates(s: SparkSession, d: str) -> DataFrame:
    return selection.candidates(wide_hits(s, d), labels(s, d), L)


def nodes(s: SparkSession) -> DataFrame:
    return s.range(NODES).withColumnRenamed("id", "node")


@query(f"{WEIGHTS}, {oracle.layout(64, H)}, {oracle.winners('emb')}, sig AS (SELECT id, bin, pos AS h FROM win), {oracle.probes(H)}, {oracle.densified('sig', H)}, {oracle.address('den', K, L)} SELECT tbl, bucket, id AS node, id AS seq FROM adr QUALIFY row_number() OVER (PARTITION BY tbl, bucket ORDER BY id DESC) <= 128")
def rehash_buckets(s: SparkSession, d: str) -> DataFrame:
    """The buckets of a layer with a node for each embedding."""
    sig = hashing.dwta(node_rows(s, d), hashing.layout(s, 64, H))
    return lsh.fifo(lsh.rows(hashing.address_wta(hashing.densified(sig, H), K, L), F.col("id")))


@query(f"{WIDE} SELECT id, node, n FROM hits")
def lsh_probe(s: SparkSession, d: str) -> DataFrame:
    return wide_hits(s, d)


@query(f"SELECT vec_id AS record_id, count(*) AS n, CAST(sum(n.n) AS BIGINT) AS node_sum FROM embeddings, range({NODES}) AS n(n) GROUP BY ALL")
def select_dense(s: SparkSession, d: str) -> DataFrame:
    return selection.dense(labels(s, d), nodes(s)).groupBy("record_id").agg(F.count("*").alias("n"), F.sum("node").alias("node_sum"))


@query(f"{WIDE} SELECT record_id, node FROM cand WHERE n > 2")
def select_threshold(s: SparkSession, d: str) -> DataFrame:
    return selection.threshold(wide_candidates(s, d))


@query(f"{WIDE}, hv AS (SELECT record_id, count(*) AS have FROM cand GROUP BY ALL), tn AS (SELECT node, CASE WHEN pos >= 66 THEN pos - 66 ELSE pos + {NODES} - 66 END AS turn FROM pm), sp AS (SELECT t.record_id, tn.node, row_number() OVER (PARTITION BY t.record_id ORDER BY tn.turn) AS r, h.have FROM tgt t CROSS JOIN tn JOIN hv h ON h.record_id = t.record_id WHERE h.have < 150 AND NOT EXISTS (SELECT 1 FROM cand c WHERE c.record_id = t.record_id AND c.node = tn.node)) SELECT record_id, node FROM cand UNION ALL SELECT record_id, node FROM sp WHERE r <= 100 - have")
def select_sampling(s: SparkSession, d: str) -> DataFrame:
    """The production bounds are 1500 and 1000; this layer of 200 nodes takes a tenth of them."""
    return selection.sampling(labels(s, d), wide_candidates(s, d), nodes(s), NODES, NODES // 3, enough=150, fill=100)


@query(f"{WIDE}, u AS (SELECT t.record_id, n.node, CASE WHEN n.node = t.label THEN 0 ELSE 1 END AS turn, n.pos FROM tgt t CROSS JOIN pm n), r AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY turn, pos) AS r FROM u) SELECT record_id, node FROM r WHERE r <= 20")
def select_random(s: SparkSession, d: str) -> DataFrame:
    return selection.random(labels(s, d), labels(s, d), nodes(s), NODES, 20)


@query(f"WITH {oracle.EMB}, {oracle.LABELS}, {oracle.layer('n', 2, NODES, 64)}, {oracle.forward('emb', 'n', 'zz', False)}, r AS (SELECT z.record_id, z.node, row_number() OVER (PARTITION BY z.record_id ORDER BY CASE WHEN z.node = t.label THEN 0 ELSE 1 END, round(z.z, 9) DESC, z.node) AS r FROM zz z JOIN tgt t ON z.record_id = t.record_id) SELECT record_id, node FROM r WHERE r <= 10")
def select_topk(s: SparkSession, d: str) -> DataFrame:
    w, b = wide(s)
    return selection.topk(network.preactivation(dense(s, d, "record_id"), w, b), labels(s, d), 10)


@query("SELECT g AS generation, vec_id AS node, row_number() OVER (PARTITION BY g ORDER BY (vec_id * (2654435761 * (g + 1) % 2147483647) + 1234) % 2147483647, vec_id) - 1 AS pos FROM range(2) AS t(g), embeddings")
def node_permutations(s: SparkSession, d: str) -> DataFrame:
    """The order of a layer with a node for each vector, before and after a reshuffle."""
    rows = table(s, d, "embeddings").select(F.col("vec_id").alias("node"))
    both = [selection.permutation(rows, g).select(F.lit(g).cast("long").alias("generation"), "node", "pos") for g in (0, 1)]
    return both[0].unionByName(both[1])


@query("SELECT count(*) FILTER (false) AS n FROM embeddings")
def select_nothing(s: SparkSession, d: str) -> DataFrame:
    """A mode that doesn't apply to a layer leaves it without active nodes."""
    return selection.nothing(selection.dense(labels(s, d), nodes(s))).agg(F.count("*").alias("n"))


# --- forward, loss, gradients, updates -----------------------------------------------------------------------------

TWO = f"WITH {oracle.two_layers()}"
ONE_BATCH = f"{TWO}, {oracle.delta('128')}, {oracle.BACK}"


def two_layers(s: SparkSession, d: str) -> dict[str, DataFrame]:
    (w1, b1), (w2, b2) = model.layer(s, 0, 16, 64), model.layer(s, 1, 10, 16)
    x = dense(s, d, "record_id")
    h = network.hidden(x, w1, b1)
    z = network.preactivation(h, w2, b2)
    return {"x": x, "h": h, "z": z, "w1": w1, "b1": b1, "w2": w2, "b2": b2, "y": labels(s, d)}


@query(f"{TWO} SELECT id AS record_id, f, round(v, 6) AS v FROM hid")
def forward_relu(s: SparkSession, d: str) -> DataFrame:
    return two_layers(s, d)["h"].select("record_id", "f", F.round("v", 6).alias("v"))


@query(f"{TWO} SELECT record_id, node, round(z, 6) AS z, round(p, 6) AS p FROM pp")
def softmax_full(s: SparkSession, d: str) -> DataFrame:
    return network.softmax(two_layers(s, d)["z"]).select("record_id", "node", F.round("z", 6).alias("z"), F.round("p", 6).alias("p"))


@query(f"{WIDE}, act AS (SELECT record_id, node FROM cand WHERE n > 2), zd AS (SELECT a.record_id, a.node, sum(w.w * x.v) AS s FROM act a JOIN emb x ON x.id = a.record_id JOIN nw w ON w.node = a.node AND w.f = x.f GROUP BY ALL), zz AS (SELECT z.record_id, z.node, z.s + b.b AS z FROM zd z JOIN nb b ON b.node = z.node), {oracle.SOFTMAX} SELECT record_id, node, round(p, 6) AS p FROM pp")
def softmax_active(s: SparkSession, d: str) -> DataFrame:
    w, b = wide(s)
    z = network.preactivation(dense(s, d, "record_id"), w, b, selection.threshold(wide_candidates(s, d)))
    return network.softmax(z).select("record_id", "node", F.round("p", 6).alias("p"))


@query(f"{TWO} SELECT count(*) AS n, round(avg(-ln(greatest(p.p, 1e-12))), 6) AS loss FROM pp p JOIN tgt t ON p.record_id = t.record_id AND p.node = t.label")
def log_loss(s: SparkSession, d: str) -> DataFrame:
    n = two_layers(s, d)
    return network.log_loss(network.softmax(n["z"]), n["y"]).select("n", F.round("loss", 6).alias("loss"))


def deltas(s: SparkSession, d: str) -> dict[str, DataFrame]:
    n = two_layers(s, d)
    n["delta"] = network.output_delta(network.softmax(n["z"]), n["y"], BATCH)
    n["back"] = network.hidden_delta(n["delta"], n["w2"], n["h"])
    return n


@query(f"{ONE_BATCH} SELECT record_id, node, round(delta, 8) AS delta FROM dd")
def delta_output(s: SparkSession, d: str) -> DataFrame:
    return deltas(s, d)["delta"].select("record_id", "node", F.round("delta", 8).alias("delta"))


@query(f"{ONE_BATCH} SELECT record_id, node, round(delta, 8) AS delta FROM hdd")
def delta_hidden(s: SparkSession, d: str) -> DataFrame:
    return deltas(s, d)["back"].select("record_id", "node", F.round("delta", 8).alias("delta"))


GRADS = "g2 AS (SELECT d.node, h.f, sum(d.delta * h.v) AS g FROM dd d JOIN hid h ON h.id = d.record_id WHERE h.v <> 0 AND d.delta <> 0 GROUP BY ALL), g1 AS (SELECT d.node, x.f, sum(d.delta * x.v) AS g FROM hdd d JOIN emb x ON x.id = d.record_id WHERE x.v <> 0 AND d.delta <> 0 GROUP BY ALL)"


@query(f"{ONE_BATCH}, {GRADS} SELECT node, f, round(g, 7) AS g FROM g2")
def grad_output(s: SparkSession, d: str) -> DataFrame:
    n = deltas(s, d)
    return network.gradient(n["delta"], n["h"]).select("node", "f", F.round("g", 7).alias("g"))


@query(f"{ONE_BATCH}, {GRADS} SELECT node, f, round(g, 7) AS g FROM g1")
def grad_first(s: SparkSession, d: str) -> DataFrame:
    n = deltas(s, d)
    return network.gradient(n["back"], n["x"]).select("node", "f", F.round("g", 7).alias("g"))


@query(f"{ONE_BATCH} SELECT node, round(sum(delta), 7) AS g FROM dd GROUP BY node")
def grad_bias(s: SparkSession, d: str) -> DataFrame:
    return network.bias_gradient(deltas(s, d)["delta"]).select("node", F.round("g", 7).alias("g"))


def adam_sql(lr: float, steps: int) -> str:
    """Steps with the same gradient, as columns m, v, w of one expression after another."""
    out = f"{ONE_BATCH}, {GRADS}, u0 AS (SELECT c.node, c.f, c.w, coalesce(g.g, 0) AS g, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v FROM cw c LEFT JOIN g2 g ON c.node = g.node AND c.f = g.f)"
    for t in range(1, steps + 1):
        out += f", a{t} AS (SELECT node, f, w, g, {network.BETA1}::DOUBLE * m + {1 - network.BETA1}::DOUBLE * g AS m, {network.BETA2}::DOUBLE * v + {1 - network.BETA2}::DOUBLE * g * g AS v FROM u{t - 1}), u{t} AS (SELECT node, f, w + {network.step_size(lr, t)!r}::DOUBLE * m / (sqrt(v) + 1e-8::DOUBLE) AS w, g, m, v FROM a{t})"
    return f"{out} SELECT node, f, round(w, 7) AS w, round(m, 7) AS m FROM u{steps}"


def adam_steps(s: SparkSession, d: str, steps: int) -> DataFrame:
    n = deltas(s, d)
    g, w = network.gradient(n["delta"], n["h"]), model.moments(n["w2"])
    for t in range(1, steps + 1):
        w = network.adam(w, g, ["node", "f"], 1e-2, t)
    return w.select("node", "f", F.round("w", 7).alias("w"), F.round("m", 7).alias("m"))


@query(adam_sql(1e-2, 1))
def adam_step1(s: SparkSession, d: str) -> DataFrame:
    return adam_steps(s, d, 1)


@query(adam_sql(1e-2, 2))
def adam_step2(s: SparkSession, d: str) -> DataFrame:
    return adam_steps(s, d, 2)


@query(f"{ONE_BATCH}, {GRADS} SELECT c.node, c.f, round(c.w + 0.1::DOUBLE * coalesce(g.g, 0), 7) AS w FROM cw c LEFT JOIN g2 g ON c.node = g.node AND c.f = g.f")
def sgd_step(s: SparkSession, d: str) -> DataFrame:
    n = deltas(s, d)
    return network.sgd(n["w2"], network.gradient(n["delta"], n["h"]), ["node", "f"], 0.1).select("node", "f", F.round("w", 7).alias("w"))


PRED = f"{TWO}, pr AS (SELECT record_id, node AS predicted FROM (SELECT record_id, node, row_number() OVER (PARTITION BY record_id ORDER BY round(z, 9) DESC, node) AS r FROM zz) WHERE r = 1), ht AS (SELECT p.record_id, p.predicted, p.predicted = t.label AS hit FROM pr p JOIN tgt t ON p.record_id = t.record_id)"


@query(f"{PRED} SELECT record_id, predicted FROM pr")
def predict_argmax(s: SparkSession, d: str) -> DataFrame:
    return network.predicted(two_layers(s, d)["z"])


@query(f"{PRED} SELECT count(*) AS n, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS correct, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS accuracy FROM ht")
def accuracy_p1(s: SparkSession, d: str) -> DataFrame:
    n = two_layers(s, d)
    return network.accuracy(network.hits(network.predicted(n["z"]), n["y"]))


@query(f"{PRED}, rw AS (SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1) // 128 AS batch_id FROM embeddings) SELECT batch_id, count(*) AS n, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS correct FROM ht JOIN rw ON rw.vec_id = ht.record_id GROUP BY batch_id")
def eval_batches(s: SparkSession, d: str) -> DataFrame:
    n = two_layers(s, d)
    hit = network.hits(network.predicted(n["z"]), n["y"])
    return hit.join(sparse_text.batches(n["y"].select("record_id"), BATCH), "record_id").groupBy("batch_id").agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("long")).alias("correct"))


@query(f"{PRED} SELECT record_id, predicted FROM pr")
def packed_predict(s: SparkSession, d: str) -> DataFrame:
    """The same predictions by blocks of matrix products: hidden activations are packed rows, the output layer one matrix."""
    n = two_layers(s, d)
    rows = n["h"].groupBy("record_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("f", "v"))), lambda x: x["v"]).alias("embedding"))
    i, j = np.arange(10)[:, None], np.arange(16)[None, :]
    w = ((i * 7919 + j * 104729 + 1299709) % 2003 - 1001) / 10010.0
    b = ((np.arange(10) * 31 + 17) % 101 - 50) / 1000.0
    return network.packed_forward(rows, w, b).select("record_id", "predicted")


# tiles of 24 nodes and 16 features: a wide layer of 200 nodes and 64 inputs makes nine by five, with records in four blocks
SIDE, ROWS = 24, 4


def wide_rows(s: SparkSession) -> DataFrame:
    w, b = wide(s)
    return w.unionByName(b.select("node", F.lit(model.BIAS).cast("long").alias("f"), F.col("b").alias("w")))


def row_blocks(records: DataFrame) -> int:
    """Blocks of records: ROWS of them, more where one would hold over 4,096 records, so that a tile's size doesn't follow the table's."""
    return max(ROWS, -(-records.count() // 4096))


def with_bias(s: SparkSession, d: str) -> DataFrame:
    return model.Network.input(dense(s, d, "record_id"), labels(s, d))


WIDE_Z = f"WITH {oracle.EMB}, {oracle.LABELS}, {oracle.layer('n', 2, NODES, 64)}, {oracle.forward('emb', 'n', 'zz', False)}"


@query(f"{WIDE_Z} SELECT record_id, node, round(z, 6) AS z FROM zz")
def tiled_dots(s: SparkSession, d: str) -> DataFrame:
    """A wide dense layer by tiles: no row for a product."""
    return tiles.dots(with_bias(s, d), wide_rows(s), 64, row_blocks(labels(s, d)), SIDE).select("record_id", "node", F.round("z", 6).alias("z"))


@query(f"{WIDE_Z} SELECT record_id, node AS predicted FROM (SELECT record_id, node, row_number() OVER (PARTITION BY record_id ORDER BY round(z, 9) DESC, node) AS r FROM zz) WHERE r = 1")
def tiled_predict(s: SparkSession, d: str) -> DataFrame:
    return tiles.predicted(with_bias(s, d), wide_rows(s), 64, row_blocks(labels(s, d)), SIDE)


#: output deltas of the wide layer, and what they pull on: its inputs above zero, and its weights
WIDE_D = f"{WIDE_Z}, {oracle.SOFTMAX}, {oracle.delta('128')}"


def wide_delta(s: SparkSession, d: str) -> DataFrame:
    z = tiles.dots(with_bias(s, d), wide_rows(s), 64, row_blocks(labels(s, d)), SIDE)
    return network.output_delta(network.softmax(z), labels(s, d), BATCH)


@query(f"{WIDE_D} SELECT d.record_id, w.f AS node, round(sum(d.delta * w.w), 8) AS delta FROM dd d JOIN nw w ON d.node = w.node JOIN emb e ON e.id = d.record_id AND e.f = w.f WHERE e.v > 0 GROUP BY ALL")
def tiled_backprop(s: SparkSession, d: str) -> DataFrame:
    back = tiles.hidden_delta(wide_delta(s, d), wide(s)[0], dense(s, d, "record_id"), NODES, row_blocks(labels(s, d)), SIDE)
    return back.select("record_id", "node", F.round("delta", 8).alias("delta"))


@query(f"{WIDE_D} SELECT d.node, e.f, round(sum(d.delta * e.v), 7) AS g FROM dd d JOIN emb e ON e.id = d.record_id GROUP BY ALL UNION ALL SELECT node, -1, round(sum(delta), 7) FROM dd GROUP BY ALL")
def tiled_gradient(s: SparkSession, d: str) -> DataFrame:
    """Gradients of a wide layer's weights, and of its biases at feature -1."""
    return tiles.gradient(wide_delta(s, d), with_bias(s, d), row_blocks(labels(s, d)), SIDE).select("node", "f", F.round("g", 7).alias("g"))


@query(f"WITH {oracle.SPARSE}, {oracle.layer('n', 2, NODES, 500)}, zz AS (SELECT x.id AS record_id, w.node, sum(w.w * x.v) AS z FROM sp x JOIN nw w ON x.f = w.f GROUP BY ALL) SELECT record_id, node AS predicted FROM (SELECT record_id, node, row_number() OVER (PARTITION BY record_id ORDER BY round(z, 9) DESC, node) AS r FROM zz) WHERE r = 1")
def tiled_sparse_predict(s: SparkSession, d: str) -> DataFrame:
    """Sparse records of 500 features, in tiles of 128 features and nodes, against a wide layer."""
    w, _ = model.layer(s, 2, NODES, 500)
    orders = table(s, d, "lineitem").agg(F.approx_count_distinct("l_orderkey")).first()[0]  # for the number of blocks, which no result depends on
    return tiles.predicted(sparse(s, d, "record_id"), w, 500, max(64, -(-orders // 32768)), 128)


# --- control -------------------------------------------------------------------------------------------------------


@query("WITH b AS (SELECT count(DISTINCT l_orderkey) // 128 AS n FROM lineitem) SELECT i AS iter, i // n AS epoch, i % 50 = 49 AS rehash, i % 1000 = 49 AS rebuild, i % 1000 = 0 AS evaluate, i % 6946 = 6945 AS reshuffle FROM b, unnest(range(0, n * 10)) AS t(i)")
def schedule_flags(s: SparkSession, d: str) -> DataFrame:
    """What happens in each iteration of ten epochs over the orders."""
    n = table(s, d, "lineitem").select("l_orderkey").distinct().count() // BATCH
    return config.schedule(s, 10 * n, n, config.Config())


LAYERS = ((0, 12, 64), (1, 8, 12), (2, 10, 8))


def deep_sql(middle: str = "l1") -> str:
    """The predictions of three layers, the middle one by name."""
    return f"{oracle.forward('emb', 'l0', 'h0', True)}, {oracle.forward('h0', middle, 'h1', True)}, {oracle.forward('h1', 'l2', 'zz', False)} SELECT record_id, node AS predicted FROM (SELECT record_id, node, row_number() OVER (PARTITION BY record_id ORDER BY round(z, 9) DESC, node) AS r FROM zz) WHERE r = 1"


DEEP = f"WITH {oracle.EMB}, {', '.join(oracle.layer(f'l{n}', n, a, b) for n, a, b in LAYERS)}"


def three_layers(s: SparkSession) -> model.Network:
    return model.Network(s, config.Config(num_layer=3, sizes=(12, 8, 10), input_dim=64, k=(2, 2, 2), l=(2, 2, 2), range_pow=(6, 6, 6), sparsity=(1.0,) * 6))


@query(f"{DEEP}, {deep_sql()}")
def network_init(s: SparkSession, d: str) -> DataFrame:
    """What three layers, each over the nodes of the one before it, predict as they begin."""
    return three_layers(s).predict(dense(s, d, "record_id"), labels(s, d).select("record_id"))


@query(f"{DEEP}, r1w AS (SELECT node, f, CASE WHEN node = 3 AND f = 5 THEN 1.0 ELSE w END AS w FROM l1w), r1b AS (SELECT node, b FROM l1b), {deep_sql('r1')}")
def network_save_load(s: SparkSession, d: str) -> DataFrame:
    """One weight put over, all saved as a version and loaded into another network, which predicts."""
    store, net = params.Store(s, params.scratch(s, "store")), three_layers(s)
    net.replace(1, s.createDataFrame([(3, 5, 1.0)], "node long, f long, w double"))
    net.save(store)
    other = three_layers(s)
    other.load(store)
    return other.predict(dense(s, d, "record_id"), labels(s, d).select("record_id"))


@query(f"WITH c AS (SELECT id, f FROM ({oracle.EMB[8:-1]})), {oracle.uniform('c', 5, 0, 'ua')}, {oracle.uniform('c', 5, 1, 'ub')} SELECT ua.id AS node, ua.f, round(0.01 * sqrt(-2 * ln(ua.u)) * cos(2 * pi() * ub.u), 9) AS w FROM ua JOIN ub ON ua.id = ub.id AND ua.f = ub.f")
def gaussian_init(s: SparkSession, d: str) -> DataFrame:
    """Normal weights of a node for each vector: a function of node, feature and seed, whatever the partitions."""
    cells = dense(s, d, "node").select("node", "f")
    return cells.select("node", "f", F.round(model.normal(F.col("node"), F.col("f"), 5) * 0.01, 9).alias("w"))


@query("WITH c AS (SELECT count(*) AS n, count(*) // 128 AS b FROM embeddings), t AS (SELECT i FROM range(1000) AS r(i), c WHERE i < b) SELECT i AS iter, 'train' AS kind, 128::BIGINT AS n FROM t UNION ALL SELECT i, 'eval', least(20 * 128, c.n) FROM t, c WHERE i % 2 = 0 UNION ALL SELECT b - 1, 'eval', n FROM c")
def evaluation_schedule(s: SparkSession, d: str) -> DataFrame:
    """When an epoch evaluates, on how many records: every second iteration here, and at its end on all."""
    net = model.Network(s, replace(TRAIN, step_size=2))
    x, y = model.kept(dense(s, d, "record_id")), labels(s, d)
    out = replicas.train(net, x, y, y, test=(x, y, y))
    return s.createDataFrame([(m["iter"], m["kind"], m["n"]) for m in out], "iter long, kind string, n long")


TRAIN = config.Config(lr=0.01, batch_size=BATCH, k=(2, 2), l=(4, 4), range_pow=(6, 6), sizes=(16, 10), input_dim=64, sparsity=(1.0, 1.0, 1.0, 1.0), epoch=1)
SAMPLED = replace(TRAIN, sizes=(16, 40), sparsity=(1.0, 0.5, 1.0, 1.0), rehash=2 * BATCH, rebuild=3 * BATCH, reshuffle=2, enough=14, fill=10)


def buckets_sql(src: str, tag: str, c: config.Config) -> str:
    """bk<tag>: what the ring buckets hold of the vectors (id, f, v) of nodes."""
    hashes = c.k[1] * c.l[1]
    return (
        f"{oracle.winners(src, f'wn{tag}')}, sn{tag} AS (SELECT id, bin, pos AS h FROM wn{tag}), {oracle.densified(f'sn{tag}', hashes, f'dn{tag}')}, {oracle.address(f'dn{tag}', c.k[1], c.l[1], c.bits, f'na{tag}')}, "
        f"bk{tag} AS (SELECT tbl, bucket, id AS node FROM (SELECT *, row_number() OVER (PARTITION BY tbl, bucket ORDER BY id DESC) AS r FROM na{tag}) WHERE r <= {lsh.SIZE})"
    )


def active_sql(c: config.Config) -> str:
    """act: the output nodes of each record, from the buckets bk and the permutation of the step's generation."""
    hashes, n, k, l = c.k[1] * c.l[1], c.sizes[1], c.k[1], c.l[1]  # noqa: E741
    return (
        f"{oracle.winners('hr', 'w1')}, s1 AS (SELECT id, bin, pos AS h FROM w1), {oracle.densified('s1', hashes, 'd1')}, {oracle.address('d1', k, l, c.bits, 'qa')}, "
        "hits AS (SELECT q.id, b.node, count(*) AS n FROM qa q JOIN bk b ON q.tbl = b.tbl AND q.bucket = b.bucket GROUP BY ALL), "
        f"cand AS MATERIALIZED (SELECT id, node, sum(n) AS n FROM (SELECT id, node, n FROM hits UNION ALL SELECT record_id, label, {l} FROM tgt JOIN mine ON mine.id = record_id) GROUP BY ALL), "
        f"pm AS (SELECT n.n AS node, row_number() OVER (ORDER BY (n.n * (2654435761 * ((i + 1) // {c.reshuffle} + 1) % 2147483647) + {selection.SEED}) % 2147483647, n.n) - 1 AS pos FROM range({n}) AS n(n), now), "
        f"tn AS (SELECT node, CASE WHEN pos >= {n // 3} THEN pos - {n // 3} ELSE pos + {n - n // 3} END AS turn FROM pm), hv AS (SELECT id, count(*) AS have FROM cand GROUP BY id), "
        f"sp AS (SELECT hv.id, tn.node, row_number() OVER (PARTITION BY hv.id ORDER BY tn.turn) AS r, have FROM hv CROSS JOIN tn WHERE have < {c.enough} AND NOT EXISTS (SELECT 1 FROM cand d WHERE d.id = hv.id AND d.node = tn.node)), "
        f"act AS MATERIALIZED (SELECT id, node FROM cand UNION ALL SELECT id, node FROM sp WHERE r <= {c.fill} - have)"
    )


def training_sql(c: config.Config) -> str:
    """An epoch as a recursion over its batches: the parameters, and the buckets of a sampled output layer, are the state that each batch's
    activations, softmax, deltas, gradients and Adam turn into the next one. kind 0 are parameters, 1 buckets, 2 a step's loss."""
    b1, b2, eps, hidden, nodes = network.BETA1, network.BETA2, network.EPS, *c.sizes
    sampled = c.sparsity[1] < 1
    hashes = c.k[1] * c.l[1]
    every, phase, rebuild = c.rehash // BATCH, c.rehash // BATCH - 1, c.rebuild // BATCH
    again = f"(i % {every} = {phase} OR i % {rebuild} = {phase})"
    tables = f", {oracle.layout(hidden, hashes)}, {oracle.probes(hashes)}, first AS (SELECT node AS id, f, w AS v FROM cw), {buckets_sql('first', '0', c)}" if sampled else ""
    start = " UNION ALL SELECT 0, 1, tbl, bucket, node, 0, 0, 0 FROM bk0" if sampled else ""
    act = f"bk AS (SELECT a AS tbl, b AS bucket, c AS node FROM cur WHERE kind = 1), {active_sql(c)}" if sampled else f"act AS (SELECT mine.id, n.n AS node FROM mine, range({nodes}) AS n(n))"
    fill = f", nw AS (SELECT node AS id, f, w AS v FROM new WHERE layer = 1 AND f >= 0), {buckets_sql('nw', '1', c)}" if sampled else ""
    kept = f" UNION ALL SELECT i + 1, 1, tbl, bucket, node, 0, 0, 0 FROM bk1, now WHERE {again} UNION ALL SELECT i + 1, 1, tbl, bucket, node, 0, 0, 0 FROM bk, now WHERE NOT {again}" if sampled else ""
    return (
        f"WITH RECURSIVE {oracle.EMB}, {oracle.LABELS}, {oracle.layer('a', 0, hidden, c.input_dim)}, {oracle.layer('c', 1, nodes, hidden)}, rw AS (SELECT vec_id AS id, (row_number() OVER (ORDER BY vec_id) - 1) // {BATCH} AS batch_id FROM embeddings), "
        f"bt AS MATERIALIZED (SELECT id, batch_id FROM rw WHERE batch_id < (SELECT count(*) // {BATCH} FROM embeddings)){tables}, "
        "st(iter, kind, a, b, c, w, m, v) AS (SELECT 0::BIGINT, 0, 0::BIGINT, node::BIGINT, f::BIGINT, w::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM aw UNION ALL SELECT 0, 0, 0, node, -1, b, 0, 0 FROM ab UNION ALL SELECT 0, 0, 1, node, f, w, 0, 0 FROM cw UNION ALL SELECT 0, 0, 1, node, -1, b, 0, 0 FROM cb"
        f"{start} UNION ALL (WITH cur AS MATERIALIZED (SELECT * FROM st), now AS MATERIALIZED (SELECT i FROM (SELECT max(iter) AS i FROM cur) WHERE i < (SELECT count(*) // {BATCH} FROM embeddings)), "
        "o AS MATERIALIZED (SELECT a AS layer, b AS node, c AS f, w, m, v FROM cur WHERE kind = 0), mine AS MATERIALIZED (SELECT bt.id FROM bt, now WHERE bt.batch_id = i), "
        "x AS MATERIALIZED (SELECT e.id, e.f, e.v FROM emb e JOIN mine ON mine.id = e.id UNION ALL SELECT id, -1, 1.0 FROM mine), "
        "hr AS MATERIALIZED (SELECT x.id, w.node AS f, greatest(sum(w.w * x.v), 0.0) AS v FROM x JOIN o w ON w.f = x.f AND w.layer = 0 GROUP BY ALL), "
        f"h AS MATERIALIZED (SELECT id, f, v FROM hr UNION ALL SELECT id, -1, 1.0 FROM mine), {act}, "
        "z AS MATERIALIZED (SELECT h.id, w.node, sum(w.w * h.v) AS z FROM act JOIN h ON h.id = act.id JOIN o w ON w.f = h.f AND w.node = act.node AND w.layer = 1 GROUP BY ALL), "
        "ez AS (SELECT *, exp(z - greatest(max(z) OVER (PARTITION BY id), 0.0)) AS e FROM z), "
        f"p AS MATERIALIZED (SELECT id, node, e / (sum(e) OVER (PARTITION BY id) + {network.NORM}::DOUBLE) AS p FROM ez), "
        f"d AS MATERIALIZED (SELECT p.id, p.node, (CASE WHEN g.label IS NOT NULL THEN 1.0 ELSE 0.0 END - p.p) / {BATCH} AS delta FROM p LEFT JOIN tgt g ON g.record_id = p.id AND g.label = p.node), "
        "back AS MATERIALIZED (SELECT d.id, w.f AS node, sum(d.delta * w.w) AS delta FROM d JOIN o w ON w.layer = 1 AND w.node = d.node JOIN hr ON hr.id = d.id AND hr.f = w.f WHERE hr.v > 0 GROUP BY ALL), "
        "g AS MATERIALIZED (SELECT 1 AS layer, d.node, h.f, sum(d.delta * h.v) AS g FROM d JOIN h ON h.id = d.id GROUP BY ALL UNION ALL SELECT 0, r.node, x.f, sum(r.delta * x.v) FROM back r JOIN x ON x.id = r.id GROUP BY ALL), "
        f"mo AS (SELECT o.layer, o.node, o.f, o.w, {b1}::DOUBLE * o.m + {1 - b1}::DOUBLE * coalesce(g.g, 0) AS m, {b2}::DOUBLE * o.v + {1 - b2}::DOUBLE * coalesce(g.g, 0) * coalesce(g.g, 0) AS v FROM o LEFT JOIN g ON g.layer = o.layer AND g.node = o.node AND g.f = o.f), "
        f"new AS MATERIALIZED (SELECT i + 1 AS iter, layer, node, f, w + {c.lr}::DOUBLE * sqrt(1 - pow({b2}::DOUBLE, i + 1)) / (1 - pow({b1}::DOUBLE, i + 1)) * m / (sqrt(v) + {eps}::DOUBLE) AS w, m, v FROM mo, now){fill} "
        f"SELECT iter, 0, layer, node, f, w, m, v FROM new{kept} UNION ALL SELECT (SELECT i + 1 FROM now), 2, count(*), 0, 0, avg(-ln(greatest(p.p, 1e-12))), 0, 0 FROM p JOIN tgt g ON g.record_id = p.id AND g.label = p.node HAVING count(*) > 0)) "
        "SELECT iter - 1 AS iter, a AS n, round(w, 5) AS loss FROM st WHERE kind = 2"
    )


def metrics(s: SparkSession, rows: list[dict]) -> DataFrame:
    return s.createDataFrame([(m["iter"], m["n"], round(m["loss"], 5)) for m in rows if m["kind"] == "train"], "iter long, n long, loss double")


@query(training_sql(TRAIN))
def train_epoch_metrics(s: SparkSession, d: str) -> DataFrame:
    """Loss of each step of a dense epoch over all whole batches; a step's loss is that before its update."""
    net = model.Network(s, TRAIN)
    return metrics(s, replicas.train(net, dense(s, d, "record_id"), labels(s, d), labels(s, d)))


@query(training_sql(SAMPLED))
def train_sampled_metrics(s: SparkSession, d: str) -> DataFrame:
    """The same with output nodes from hash tables, which are filled again from the new weights, and filled up by a permutation that changes: both
    after every second step."""
    net = model.Network(s, SAMPLED)
    return metrics(s, replicas.train(net, dense(s, d, "record_id"), labels(s, d), labels(s, d)))


@query(f"{TWO} SELECT 0::BIGINT AS version, 1::BIGINT AS steps, 0::BIGINT AS batch_id, count(*) AS n, round(avg(-ln(greatest(p.p, 1e-12))), 5) AS loss FROM pp p JOIN tgt t ON p.record_id = t.record_id AND p.node = t.label")
def train_stream_step(s: SparkSession, d: str) -> DataFrame:
    """Files as a stream: all of them are one micro-batch, which is one step and one committed version."""
    e = table(s, d, "embeddings")
    files, store = params.scratch(s, "stream"), params.Store(s, params.scratch(s, "store"))
    e.write.parquet(files)

    def prepare(rows: DataFrame) -> trainer.Prepared:
        f = rows.select(F.col("vec_id").alias("record_id"), F.posexplode("embedding").alias("f", "v"))
        y = rows.select(F.col("vec_id").alias("record_id"), F.col("label").cast("long").alias("label"))
        return f.select("record_id", F.col("f").cast("long").alias("f"), F.col("v").cast("double").alias("v")), y, y.select("record_id")

    trainer.train_stream(s.readStream.schema(e.schema).parquet(files), model.Network(s, TRAIN), prepare, store, params.scratch(s, "cp")).awaitTermination()
    about = store.about("network")
    return s.createDataFrame([(store.version("network"), about["steps"], about["batch_id"], about["n"], round(about["loss"], 5))], "version long, steps long, batch_id long, n long, loss double")


@query("SELECT 'k' || vec_id AS key, CASE WHEN vec_id % 7 = 0 THEN 'late' WHEN vec_id % 5 = 0 THEN 'new' ELSE 'old' END AS dtype, CAST(CASE WHEN vec_id % 7 = 0 THEN 2 WHEN vec_id % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS ts, 2::BIGINT AS version, 1::BIGINT AS refused FROM embeddings")
def param_version_swap(s: SparkSession, d: str) -> DataFrame:
    """Key-value rows; then two writers put others over version 0: the second to commit is refused and puts its rows over the first one's."""
    store = params.Store(s, params.scratch(s, "store"))
    e = table(s, d, "embeddings")

    def rows(every: int, dtype: str, ts: int) -> DataFrame:
        return e.filter(f"vec_id % {every} = 0").select(F.concat(F.lit("k"), F.col("vec_id").cast("string")).alias("key"), F.lit(dtype).alias("dtype"), F.lit(ts).cast("long").alias("ts"))

    base, refused = store.upsert("kv", rows(1, "old", 0)), 0
    store.upsert("kv", rows(5, "new", 1), based=base)
    try:
        store.upsert("kv", rows(7, "late", 2), based=base)
    except params.Conflict:
        refused += 1
        store.upsert("kv", rows(7, "late", 2))
    return store.read("kv").withColumns({"version": F.lit(store.version("kv")).cast("long"), "refused": F.lit(refused).cast("long")})
