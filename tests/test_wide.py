"""Tiles, stored batches, commits that refuse, kept rings, counter-based numbers, and arrays by rows."""

from __future__ import annotations

import contextlib
import io
import os
import threading
import zipfile
from dataclasses import replace

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import config, hashing
from lodestone.operators import lsh, network, tiles
from lodestone.plans import model
from lodestone.sources import array_rows, arrays, params, sparse_text
from lodestone.sources.batches import Batches


def entries(spark, m, row, col, value, shift=0):
    i, j = np.nonzero(m)
    return spark.createDataFrame([(int(a) * 10**12, int(b) - shift, float(m[a, b])) for a, b in zip(i, j, strict=True)] or [(0, 0, 0.0)], f"{row} long, {col} long, {value} double")


@pytest.mark.parametrize(("side", "records", "density"), [(7, 3, 1.0), (4, 2, 0.05), (1000, 1, 0.5)])
def test_tiles_multiply(spark, side, records, density):
    rng = np.random.default_rng(side)
    x, w = rng.normal(size=(23, 31)) * (rng.random((23, 31)) < density), rng.normal(size=(31, 19))
    a = entries(spark, x, "record_id", "f", "v", 1)  # features from -1 on
    b = spark.createDataFrame([(n, f - 1, float(w[f, n])) for f in range(31) for n in range(19)], "node long, f long, w double")
    got = {(r.record_id // 10**12, r.node): r.z for r in tiles.dots(a, b, 30, records, side).collect()}
    rows = [i for i in range(23) if x[i].any()]
    assert set(got) == {(i, n) for i in rows for n in range(19)} and all(got[i, n] == pytest.approx((x @ w)[i, n]) for i, n in got)
    best = {r.record_id // 10**12: r.predicted for r in tiles.predicted(a, b, 30, records, side).collect()}
    assert best == {i: int((x @ w)[i].argmax()) for i in rows}
    delta = rng.normal(size=(23, 19))
    d = entries(spark, delta, "record_id", "node", "delta")
    grad = {(r.node, r.f + 1): r.g for r in tiles.gradient(d, a, records, side).collect()}
    assert all(g == pytest.approx((delta.T @ x)[n, f], abs=1e-9) for (n, f), g in grad.items()) and {f for _, f in grad} == {f for f in range(31) if x[:, f].any()}
    back = {(r.record_id // 10**12, r.node): r.delta for r in tiles.hidden_delta(d, b.filter("f >= 0"), a, 19, records, side).collect()}
    assert set(back) == {(i, f - 1) for i in range(23) for f in range(1, 31) if x[i, f] > 0} and all(v == pytest.approx((delta @ w.T)[i, f + 1], abs=1e-9) for (i, f), v in back.items())


def test_tiles_of_nothing(spark):
    a = spark.createDataFrame([], "record_id long, f long, v double")
    b = spark.createDataFrame([(0, 0, 1.0)], "node long, f long, w double")
    assert tiles.dots(a, b, 4).collect() == [] and tiles.gradient(a.withColumnsRenamed({"f": "node", "v": "delta"}), a).collect() == []


def test_no_row_for_a_product(spark):
    """Between scan and result the plan has tiles and results, nothing that grows with records x nodes x features."""
    x = spark.range(64).select(F.explode(F.sequence(F.lit(0), F.lit(39))).alias("f"), F.col("id").alias("record_id")).select("record_id", F.col("f").cast("long").alias("f"), F.lit(1.0).alias("v"))
    w = model.layer(spark, 0, 50, 40)[0]
    done = tiles.dots(x, w, 40, 2, 16)
    assert done.count() == 64 * 50
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "sum(" not in plan


SMALL = config.Config(lr=0.05, sizes=(6, 40), input_dim=8, sparsity=(1.0,) * 4, batch_size=16, rehash=32, rebuild=32, k=(2, 2), l=(3, 3), range_pow=(4, 4), enough=14, fill=10)


def records(spark, n):
    df = spark.range(n).select(F.col("id").alias("record_id"), F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(i * F.col("id")))).alias("f", "v"))
    return df.withColumn("f", F.col("f").cast("long")), spark.range(n).select(F.col("id").alias("record_id"), (F.col("id") % 5).alias("label"))


def losses(spark, c, n=80, epochs=1):
    x, y = records(spark, n)
    return [m["loss"] for m in model.train(model.Network(spark, c), x, y, y, epochs=epochs)]


def test_tiles_and_rows_train_alike(spark):
    assert losses(spark, SMALL, 48) == pytest.approx(losses(spark, replace(SMALL, tile=0), 48), abs=1e-12)
    assert losses(spark, SMALL, 48) == pytest.approx(losses(spark, replace(SMALL, tile=5), 48), abs=1e-12)


def test_rehash_and_reshuffle_have_effect(spark):
    c = replace(SMALL, sparsity=(1.0, 0.5, 1.0, 1.0), lr=0.5, reshuffle=10**6)
    never = losses(spark, replace(c, rehash=10**6, rebuild=10**6), 64)
    assert losses(spark, c, 64)[:2] == pytest.approx(never[:2], abs=1e-12)
    assert abs(losses(spark, c, 64)[3] - never[3]) > 1e-9  # tables of the new weights, from the third step on
    again = losses(spark, replace(c, rehash=10**6, rebuild=10**6, reshuffle=2), 64)
    assert again[0] == pytest.approx(never[0], abs=1e-12) and abs(again[1] - never[1]) > 1e-9


def test_a_step_reads_its_batch_alone(spark, tmp_path):
    sizes = {}
    for n in (64, 640):
        x, y = records(spark, n)
        stored = Batches.write(x, y, y, 16, str(tmp_path / str(n)))
        assert stored.count == n // 16
        frames = stored.read(1)
        files = [f.removeprefix("file://") for df in frames for f in df.inputFiles()]
        assert len(files) == 3 and all("batch_id=1/" in f for f in files)
        sizes[n] = sum(os.path.getsize(f) for f in files)
        assert sorted(r.record_id for r in frames[2].collect()) == list(range(16, 32))
        got = {(r.record_id, r.f): r.v for r in frames[0].collect()}
        assert got == {(r.record_id, r.f): r.v for r in x.filter("record_id >= 16 and record_id < 32").collect()}
    assert sizes[640] < 1.2 * sizes[64]
    empty = Batches.write(x.filter("record_id >= 16"), y, y.filter("record_id < 32"), 16, str(tmp_path / "few"))
    assert empty.count == 2 and empty.read(0)[0].collect() == [] and empty.read(0)[2].count() == 16
    assert Batches.write(x, y, y.filter("record_id < 0"), 16, str(tmp_path / "none")).count == 0


def test_loss_costs_no_job(spark):
    """A dense step's jobs are those of its two writes; the metrics come from the first."""
    x, y = records(spark, 16)
    x, y = model.kept(x), model.kept(y)
    net = model.Network(spark, SMALL)
    net.step(x, y, y.select("record_id"), 16)
    spark.sparkContext.setJobGroup("step", "")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    writes, cut = [], net.cut
    net.cut = lambda df, role: (writes.append(role), cut(df, role))[1]
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else every shuffle is a job
    try:
        row = net.step(x, y, y.select("record_id"), 16)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("step")) == 2
        assert writes == ["p", "table"] and net.loss[0] == 16
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("step"))
        network.log_loss(net.spark.read.parquet(net.written["p"][-1]).filter("p is not null"), y).first()
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("step")) > jobs  # what the loss would cost by itself
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert row.first().loss == net.loss[1]


def test_observed_loss_is_log_loss(spark):
    p = spark.createDataFrame([(1, 0, 0.25), (1, 1, 0.75), (2, 0, 0.5), (3, 4, 0.0)], "record_id long, node long, p double")
    y = spark.createDataFrame([(1, 0), (1, 1), (2, 7), (3, 4)], "record_id long, label long")
    want = network.log_loss(p, y).first()
    sums = network.beside(p, y).agg(*network.observed()).first().asDict()
    assert network.mean_loss(sums) == (want.n, pytest.approx(want.loss))
    assert network.mean_loss({"n": None, "lost": None}) == (0, 0.0)
    a = {(r.record_id, r.node): r.delta for r in network.delta_of(network.beside(p, y), 3).collect()}
    assert a == pytest.approx({(r.record_id, r.node): r.delta for r in network.output_delta(p, y, 3).collect()})


def test_a_commit_on_an_old_version_is_refused(spark, tmp_path):
    store = params.Store(spark, str(tmp_path))
    assert store.commit("t", spark.range(3)) == 0 and store.commit("t", spark.range(4), based=0) == 1
    with pytest.raises(params.Conflict):
        store.commit("t", spark.range(5), based=0)
    assert store.version("t") == 1 and store.read("t").count() == 4 and store.read("t", 0).count() == 3
    assert len([d for d in os.listdir(tmp_path / "t") if d.startswith("data-")]) == 2 and not [d for d in os.listdir(tmp_path / "t") if "draft" in d]
    store.put_array("a", spark.range(8).select(F.col("id").alias("idx"), F.col("id").alias("val")), 4)
    one = spark.createDataFrame([(0, 9)], "idx long, val long")
    assert store.put_block("a", 0, one, based=0) == 1
    with pytest.raises(params.Conflict):
        store.put_block("a", 1, one, based=0)
    assert {r.idx for r in store.array("a").collect()} == {0, 4, 5, 6, 7}


def test_two_writers_lose_nothing(spark, tmp_path):
    """Writers that start together: each upsert is redone over what came first, and all rows are there."""
    store, failed = params.Store(spark, str(tmp_path)), []
    store.commit("t", spark.createDataFrame([(-1, 0)], "key long, ts long"))
    start = threading.Barrier(4)

    def write(n):
        try:
            start.wait()
            for k in range(3):
                store.upsert("t", spark.createDataFrame([(10 * n + k, 1)], "key long, ts long"), tries=30)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and store.version("t") == 12
    assert sorted(r.key for r in store.read("t").collect()) == [-1, *(10 * n + k for n in range(4) for k in range(3))]


def test_upsert_keeps_one_row_a_key(spark, tmp_path):
    store = params.Store(spark, str(tmp_path))
    rows = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "z", 1), ("b", "w", 1), (None, "n", 1), (None, "m", 0)], "key string, data string, ts long")
    store.upsert("t", rows)
    assert sorted(map(tuple, store.read("t").collect()), key=str) == [("a", "y", 2), ("b", "z", 1), (None, "n", 1)]


@given(st.lists(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 30)), max_size=25), min_size=1, max_size=3))
@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_rings_merge(spark, parts):
    kept, seq, whole = None, 0, {}
    for part in parts:
        rows = []
        for bucket, node in part:
            rows.append((0, bucket, node, seq))
            whole.setdefault(bucket, []).append(node)
            seq += 1
        df = spark.createDataFrame(rows, "tbl long, bucket long, node long, seq long")
        kept = model.kept(lsh.ring(df, 4, kept))
    got = {}
    for r in kept.collect():
        assert r.slot == r.number % 4 and whole[r.bucket][r.number] == r.node
        got.setdefault(r.bucket, set()).add(r.number)
    assert got == {b: set(range(max(0, len(v) - 4), len(v))) for b, v in whole.items()}


def test_normals_do_not_follow_partitions(spark):
    cells = spark.range(20000).select((F.col("id") % 200).alias("node"), F.floor(F.col("id") / 200).alias("f"))
    w = model.normal(F.col("node"), F.col("f"), 3)
    a, b = ({(r.node, r.f): r.w for r in cells.repartition(n).select("node", "f", w.alias("w")).collect()} for n in (1, 7))
    values = np.array(list(a.values()))
    assert a == b and len(set(a.values())) > 19990
    assert abs(values.mean()) < 0.03 and abs(values.std() - 1) < 0.03 and abs((values < 1).mean() - 0.8413) < 0.01
    grid = np.array([[a[i, j] for j in range(100)] for i in range(200)])
    assert abs(np.corrcoef(grid[:, :-1].ravel(), grid[:, 1:].ravel())[0, 1]) < 0.03 and abs(np.corrcoef(grid[:-1].ravel(), grid[1:].ravel())[0, 1]) < 0.03


def test_array_rows_of_every_kind(spark, tmp_path):
    array_rows.register(spark)
    made = {"c": np.array([1 + 2j, -3.5j]), "i": np.array([[2**53 + 1, -(2**62)]]), "e": np.empty((0, 3), "<f4"), "b": np.array([True, False]), "g": np.arange(6, dtype=">i2").reshape(3, 2), "f": np.asfortranarray(np.arange(60.0).reshape(20, 3)), "z": np.array(7.5), "w": np.empty((3, 0))}
    for k, a in made.items():
        np.save(tmp_path / f"{k}.npy", a)
    for packed, kind in (("stored.npz", zipfile.ZIP_STORED), ("small.npz", zipfile.ZIP_DEFLATED)):
        with zipfile.ZipFile(tmp_path / packed, "w", kind) as z:
            for k in made:
                z.write(tmp_path / f"{k}.npy", f"{k}.npy")
            z.writestr("note.txt", "x")
    for df in (spark.read.format("npy_rows").option("split", 64).load(str(tmp_path)), *(spark.read.format("npz_rows").option("split", 64).load(str(tmp_path / p)) for p in ("stored.npz", "small.npz"))):
        rows = {(r.name, r.row): (bytes(r.raw), r.data) for r in df.collect()}
        for k, a in made.items():
            whole = a.reshape(1, -1) if a.ndim == 0 else a
            assert [rows.pop((k, i))[0] for i in range(len(whole))] == [np.ascontiguousarray(x).tobytes() for x in whole]
        assert not rows
        some = df.filter((F.col("name") == "f") & (F.col("row") > 4) & (F.col("row") <= 9))
        assert sorted((r.row, *r.data) for r in some.collect()) == [(i, *made["f"][i]) for i in range(5, 10)]
        assert df.filter(F.col("name").isin("f", "b") & (F.col("row") == 1)).count() == 2 and df.filter("name = 'nothing'").count() == 0
        assert df.filter("row >= 2 and row < 2").count() == 0


def test_array_scan_is_split_and_pruned(spark, tmp_path):
    array_rows.register(spark)
    where = str(tmp_path / "x.npy")
    rows = spark.range(0, 1000, 1, 7).select(F.col("id").alias("row"), F.array(F.col("id") * 0.5, F.lit(1.0)).alias("data"), F.lit(None).cast("binary").alias("raw"))
    rows.write.format("npy_rows").option("shape", "1000,2").mode("overwrite").save(where)
    assert (np.load(where) == np.column_stack([np.arange(1000) * 0.5, np.ones(1000)])).all() and os.listdir(tmp_path) == ["x.npy"]
    df = spark.read.format("npy_rows").option("split", 1600).load(where)
    assert df.rdd.getNumPartitions() == 10
    part = df.filter("row >= 250 and row < 480")
    assert part.rdd.getNumPartitions() == 3 and part.count() == 230
    with contextlib.redirect_stdout(io.StringIO()) as said:
        part.explain("formatted")
    assert "GreaterThanOrEqual(row,250)" in said.getvalue() and "LessThan(row,480)" in said.getvalue(), said.getvalue()
    with pytest.raises(Exception, match="999 rows were written of 1000"):
        rows.filter("row > 0").write.format("npy_rows").option("shape", "1000,2").mode("overwrite").save(where)
    assert (np.load(where)[:, 1] == 1).all() and os.listdir(tmp_path) == ["x.npy"]  # the old file is as it was
    for wrong in (rows.withColumn("row", F.col("row") + 1), rows.withColumn("data", F.array(F.lit(1.0)))):
        with pytest.raises(Exception, match="does not fit the shape"):
            wrong.write.format("npy_rows").option("shape", "1000,2").mode("overwrite").save(where)
    assert os.listdir(tmp_path) == ["x.npy"]


def test_array_rows_need_a_file(spark, tmp_path):
    array_rows.register(spark)
    with pytest.raises(Exception, match="FileNotFoundError"):
        spark.read.format("npy_rows").load(str(tmp_path / "none.npy")).count()
    arrays.save_npy(str(tmp_path / "a.npy"), np.arange(3.0))
    assert spark.read.format("npy_rows").load(str(tmp_path / "a.npy")).count() == 3


def test_srp_by_merge(spark):
    x = spark.createDataFrame([(1, 3, 0.5), (1, 900, 9.0), (2, 0, -1.0), (2, 19, 2.0), (2, 7, 0.25)], "id long, f long, v double")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    signs = hashing.srp_layout(spark, 20, 6)
    rows = lambda df: sorted(map(tuple, df.select("id", "bin", "h").collect()))
    assert rows(hashing.srp_merged(x, signs, ids, 6)) == rows(hashing.srp(x, signs, ids, 6)) and len(rows(hashing.srp_merged(x, signs, ids, 6))) == 18
    assert "Generate" not in hashing.srp_merged(x, signs, ids, 6)._jdf.queryExecution().optimizedPlan().toString().split("Join")[-1]


def test_lines_that_are_not_utf8(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"head\n1 2:3\n2 \xff1:1\n3 1:1 \xc3\xa9\n\xed\xa0\x80\n4 5:1\xc3")
    (tmp_path / "b.txt").write_bytes(b"h\xc0\x80\n\n7 1:1\n")
    got = sparse_text.read(spark, str(tmp_path / "*.txt")).collect()
    assert sorted((r.row_idx, r.labels[0], r.n_rejected) for r in got) == [(0, 1, 0), (1, 3, 1), (2, 7, 0)]
    seen = {os.path.basename(r.file): (r.n_lines, r.n_invalid) for r in sparse_text.rejected(spark, str(tmp_path / "*.txt")).collect()}
    assert seen == {"a.txt": (6, 3), "b.txt": (3, 1)}


def test_gathered_products_and_blocks_that_grow(spark):
    """Tiles gathered before they are multiplied give the products' best entries; no partial product is shuffled for them."""
    from lodestone.plans import catalog

    r = np.random.default_rng(5)
    x = [(i, int(f), float(v)) for i in range(150) for f, v in zip(r.choice(40, 3, replace=False), r.normal(size=3), strict=True)]
    w = r.normal(size=(30, 40))
    dx = spark.createDataFrame(x, "record_id long, f long, v double")
    dw = spark.createDataFrame([(n, f, float(w[n, f])) for n in range(30) for f in range(40)], "node long, f long, w double")
    got = {a.record_id: a.predicted for a in tiles.predicted(dx, dw, 40, 3, 8).collect()}
    z = np.zeros((150, 30))
    for i, f, v in x:
        z[i] += v * w[:, f]
    assert got == dict(enumerate(np.round(z, 9).argmax(axis=1).tolist()))
    assert tiles.predicted(dx, dw, 40, 3, 8)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert catalog.row_blocks(spark.range(100)) == catalog.ROWS and catalog.row_blocks(spark.range(40_960)) == 10


def test_npy_exact_tells_the_type(spark):
    from lodestone.plans import catalog

    assert {r.dtype for r in catalog.npy_exact(spark, "/root/testdata/sf0.001").collect()} == {"<i8"} and "dtype" in catalog.ORACLES["npy_exact"]


def test_reservoir_and_ring_look_for_single_rows(spark):
    """Reservoirs with several turns, ranges of uneven seq, buckets that a turn doesn't reach; rings by counts; neither numbers every row."""
    rows = [(t, b, 1000 * i * i + b, i) for t in range(2) for b, n in enumerate((3, 40, 250, 777)) for i in range(n)]
    df = spark.createDataFrame(rows, "tbl long, bucket long, node long, seq long")
    draw, size, slot = 721, 8, 5
    want = set()
    for t in range(2):
        for b in range(4):
            held = []
            for c, (_, _, node, seq) in enumerate(sorted((r for r in rows if r[:2] == (t, b)), key=lambda r: (r[3], r[2])), 1):
                if c <= size:
                    held.append((node, seq))
                elif draw % c == 1:
                    held[slot] = (node, seq)
            want |= {(t, b, n, q, p) for p, (n, q) in enumerate(held)}
    got = lsh.reservoir(df, size, draw, slot)
    assert {tuple(r) for r in got.select("tbl", "bucket", "node", "seq", "place").collect()} == want
    first = lsh.ring(df.filter("seq % 3 = 0"), 8)
    both = lsh.ring(df.filter("seq % 3 > 0").withColumn("seq", F.col("seq") + 10_000), 8, first)
    whole = lsh.ring(df.withColumn("seq", F.when(F.col("seq") % 3 > 0, F.col("seq") + 10_000).otherwise(F.col("seq"))), 8)
    assert {tuple(r) for r in both.collect()} == {tuple(r) for r in whole.select(*both.columns).collect()}
    for made in (got, both):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("WindowGroupLimit") >= 2


def test_signatures_shuffle_no_products(spark):
    """Densified and projected signatures of ids with and without features; products of features and hashes are never shuffled."""
    from lodestone.functions import hashing

    hashes = 40
    met = {(r.target, r.bin): r.a for r in hashing.probes(spark, hashes).groupBy("bin", "target").agg(F.min("attempt").alias("a")).collect()}
    first = hashing.first_attempts(hashes)
    assert all(first[t, b] == (0 if t == b else met.get((t, b), hashing.PROBES + 1)) for t in range(hashes) for b in range(hashes))
    r = np.random.default_rng(3)
    own = {i: {int(b): int(h) for b, h in zip(r.choice(hashes, i % 7, replace=False), r.integers(0, 2**40, 7), strict=False)} for i in range(60)}
    sig = spark.createDataFrame([(i, b, h) for i, o in own.items() for b, h in o.items()], "id long, bin long, h long")
    got = {(x.id, x.bin): x.h for x in hashing.densified(sig, hashes, spark.range(60)).collect()}
    for i, o in own.items():
        for b in range(hashes):
            best = min((first[t, b], h) for t, h in o.items()) if o else (hashing.PROBES + 1, 0)
            assert got[i, b] == (best[1] if best[0] <= hashing.PROBES else 0)
    x = spark.createDataFrame([(i, int(f), float(r.normal())) for i in range(60) for f in r.choice(90, i % 5, replace=False)], "id long, f long, v double")
    signs = hashing.srp_layout(spark, 80, hashes)
    a, b = (how(x, signs, spark.range(60), hashes) for how in (hashing.srp, hashing.srp_merged))
    assert {tuple(y) for y in a.collect()} == {tuple(y) for y in b.collect()} and a.count() == 60 * hashes
    assert "hashpartitioning(id" in (plan := a._jdf.queryExecution().executedPlan().toString()) and ", bin#" not in "".join(p.split(")")[0] for p in plan.split("hashpartitioning(")[1:] if p.startswith("id"))


def test_evaluations_read_their_batches_only(spark, monkeypatch):
    """Evaluations within an epoch get a table of their own batches, not the whole test set."""
    from lodestone.plans import catalog

    monkeypatch.setattr(model, "EVALUATE", 1)
    monkeypatch.setattr(model, "AFTER_EPOCH", 2)
    seen = []
    real = model.Network.evaluate
    monkeypatch.setattr(model.Network, "evaluate", lambda net, x, y, b, *a, **k: seen.append((x.select("record_id").distinct().count(), b.count())) or real(net, x, y, b, *a, **k))
    rows = spark.range(24).select(F.col("id").alias("record_id"))
    x = rows.select("record_id", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("f"), F.lit(0.5).alias("v"))
    y = rows.select("record_id", (F.col("record_id") % 3).alias("label"))
    c = replace(catalog.TRAIN, batch_size=8, sizes=(4, 3), input_dim=2, step_size=1, rehash=8, rebuild=8)
    out = model.train(model.Network(spark, c), x, y, rows, test=(x, y, rows))
    assert seen == [(8, 8)] * 3 + [(24, 24)] and [m["n"] for m in out if m["kind"] == "eval"] == [8, 8, 8, 24]
