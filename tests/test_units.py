"""Hand-computed cases of the engine's own operators."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import config, hashing
from lodestone.operators import lsh, network, selection
from lodestone.plans import model
from lodestone.sources import arrays, params, sparse_text
from lodestone.streaming import trainer


def test_parse_cases(spark):
    lines = [" 3:0.5 7:1.0", "1,2 3:0.5 7:1.0", "4", "0,x 1:a 2:2 z 9:1e-1", "", "   "]
    got = sparse_text.parse(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string")).orderBy("i").collect()
    assert [(r.labels, [(x.f, x.v) for x in r.features]) for r in got] == [([], [(7, 1.0)]), ([1, 2], [(3, 0.5), (7, 1.0)]), ([4], []), ([0], [(2, 2.0), (9, 0.1)])]


def test_read_skips_each_header(spark, tmp_path):
    (tmp_path / "a.txt").write_text("2 9 3\n1 2:3\n0 1:1\n")
    got = sparse_text.read(spark, str(tmp_path / "a.txt"))
    assert sorted(r.labels[0] for r in got.collect()) == [0, 1]


def test_config():
    c = config.parse("# x\nK=1,,x,3\nEpoch=abc\nLr = 0.5\nnope=1\n")
    assert c.k == (1, 0, 3) and c.epoch == 10 and c.lr == 0.5 and c.warnings == ("nope=1",)
    assert config.Config().validated().batch_size == 128
    with pytest.raises(ValueError):
        config.parse("Rehash=1").validated()
    assert config.worker("w1") == 0
    with pytest.raises(ValueError):
        config.worker("x")


def test_ranges():
    assert config.ranges(10, 3, 1) == [(0, 4), (4, 8), (8, 10)]
    with pytest.raises(ValueError):
        config.ranges(5, 4, 1)


def test_schedule(spark):
    rows = config.schedule(spark, 1210, 121, config.Config()).collect()
    assert [r.iter for r in rows if r.rehash][:2] == [49, 99] and sum(r.rehash for r in rows) == 24
    assert [r.iter for r in rows if r.rebuild] == [49, 1049] and [r.iter for r in rows if r.evaluate] == [0, 1000]


def test_addresses(spark):
    sig = spark.createDataFrame([(1, 0, 3), (1, 1, 5), (2, 0, 7), (2, 1, 7), (3, 0, 0), (3, 1, 4), (4, 0, 1), (4, 1, 0)], "id long, bin long, h long")
    assert {r.id: r.bucket for r in hashing.address_wta(sig, 2, 1).collect()} == {1: 17, 2: 35, 3: 4, 4: 4}
    six = spark.createDataFrame([(1, b, 7) for b in range(6)], "id long, bin long, h long")
    assert hashing.address_wta(six, 6, 1).first().bucket == 9555


def test_fifo(spark):
    rows = spark.range(130).select(F.lit(0).alias("tbl"), F.lit(0).alias("bucket"), F.col("id").alias("node"), F.col("id").alias("seq"))
    assert sorted(r.node for r in lsh.fifo(rows).collect()) == list(range(2, 130))


def test_layout_sizes():
    assert hashing.permutations(5000, 40) == 1 and hashing.permutations(128, 300) == 19


def test_ties_and_empty_bins(spark):
    x = spark.range(64).select(F.lit(1).alias("id"), F.col("id").alias("f"), F.lit(1.0).alias("v"))
    lay = hashing.layout(spark, 64, 8)
    first = {r.bin: r.h for r in hashing.wta(x, lay).collect()}
    want = {r.bin: r.f for r in lay.groupBy("bin").agg(F.min("f").alias("f")).collect()}
    assert first == want
    few = spark.createDataFrame([(1, 0, 1.0)], "id int, f long, v double")
    assert hashing.densified(hashing.dwta(few, lay), 8).count() == 8


def test_srp_without_overlap(spark):
    ids = spark.createDataFrame([(1,)], "id long")
    x = spark.createDataFrame([], "id long, f long, v double")
    assert {r.h for r in hashing.srp(x, hashing.srp_layout(spark, 6, 4), ids, 4).collect()} == {0}


def test_softmax_and_delta(spark):
    z = spark.createDataFrame([(1, 0, -1.0), (1, 1, -2.0), (2, 0, 2.0), (2, 1, 1.0), (2, 2, -1.0)], "record_id long, node long, z double")
    p = network.softmax(z)
    got = {(r.record_id, r.node): r.p for r in p.collect()}
    assert got[1, 0] == pytest.approx(0.7310584333523734) and got[2, 2] == pytest.approx(0.03511902448209813)
    y = spark.createDataFrame([(2, 0), (2, 2)], "record_id long, label long")
    d = {r.node: r.delta for r in network.output_delta(p.filter("record_id = 2"), y, 4).collect()}
    assert d[0] == pytest.approx(-0.051346115735378395) and d[1] == pytest.approx(-0.0648741105094855) and d[2] == pytest.approx(0.11622024387947547)


def test_adam(spark):
    w = spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "node long, w double, m double, v double")
    one = network.adam(w, spark.createDataFrame([(0, 0.01)], "node long, g double"), ["node"], 1e-4, 1)
    assert one.first().w == pytest.approx(9.999683782233675e-05, rel=1e-9)
    two = network.adam(one, spark.createDataFrame([], "node long, g double"), ["node"], 1e-4, 2)
    assert two.first().w - one.first().w == pytest.approx(6.700370551022626e-05, rel=1e-6)


def test_predict_tie(spark):
    z = spark.createDataFrame([(1, 4, 0.5), (1, 2, 0.5)], "record_id long, node long, z double")
    assert network.predicted(z).first().predicted == 2


def test_topk(spark):
    z = spark.createDataFrame([(1, n, v) for n, v in ((7, -9.0), (3, 1.0), (1, 1.0), (2, 0.5))], "record_id long, node long, z double")
    got = selection.topk(z, spark.createDataFrame([(1, 7)], "record_id long, label long"), 3)
    assert sorted(r.node for r in got.collect()) == [1, 3, 7]


def test_sampling_sizes(spark):
    records = spark.createDataFrame([(1,), (2,)], "record_id long")
    nodes = spark.range(5000).withColumnRenamed("id", "node")
    found = nodes.filter("node < 1200").select(F.lit(1).cast("long").alias("record_id"), "node", F.lit(1).cast("long").alias("n")).unionByName(nodes.filter("node < 900").select(F.lit(2).cast("long").alias("record_id"), "node", F.lit(1).cast("long").alias("n")))
    n = {r.record_id: r["count"] for r in selection.sampling(records, found, nodes, 5000, 17).groupBy("record_id").count().collect()}
    assert n == {1: 1200, 2: 1000}


def test_murmur_goldens():
    assert hashing.murmur3(b"", 0) == 0 and hashing.murmur3(b"hello", 0) == 0x248BFA47 and hashing.murmur3(b"hello, world", 0) == 0x149BBB7F


def test_npy_header_and_append(tmp_path):
    f = str(tmp_path / "a.npy")
    arrays.save_npy(f, np.zeros(3, "<f4"))
    arrays.save_npy(f, np.ones(2, "<f4"), append=True)
    assert arrays.load(f)["a"].tolist() == [0, 0, 0, 1, 1]
    with pytest.raises(ValueError):
        arrays.save_npy(f, np.ones(2), append=True)
    with pytest.raises(FileNotFoundError):
        arrays.save_npz(str(tmp_path / "z.npz"), "x", np.ones(1))
        arrays.load(str(tmp_path / "z.npz"), "y")


def test_gradient_matches_finite_difference(spark):
    rng = np.random.default_rng(1)
    x = spark.createDataFrame([(i, f, float(v)) for i in range(6) for f, v in enumerate(rng.normal(size=4))], "record_id long, f long, v double")
    y = spark.createDataFrame([(i, i % 3) for i in range(6)], "record_id long, label long")
    w, b = model.layer(spark, 0, 3, 4)

    def loss(weights):
        return -network.log_loss(network.softmax(network.preactivation(x, weights, b)), y).first().loss

    p = network.softmax(network.preactivation(x, w, b))
    g = {(r.node, r.f): r.g for r in network.gradient(network.output_delta(p, y, 6), x).collect()}
    up = w.withColumn("w", F.when((F.col("node") == 1) & (F.col("f") == 2), F.col("w") + 1e-4).otherwise(F.col("w")))
    assert (loss(up) - loss(w)) / 1e-4 == pytest.approx(g[1, 2], rel=1e-3, abs=1e-6)


SMALL = config.Config(lr=0.05, sizes=(4, 2), input_dim=2, sparsity=(1.0, 1.0, 1.0, 1.0), batch_size=8, rehash=8, rebuild=16, k=(2, 2), l=(3, 3), range_pow=(4, 4))


def small(spark, n=32):
    i = F.col("id") % 2
    df = spark.range(n).select(F.col("id").alias("record_id"), F.array(i.cast("double"), (1 - i).cast("double")).alias("vec"), i.alias("label"))
    return df, (lambda d: (d.select("record_id", F.posexplode("vec").alias("f", "v")).withColumn("f", F.col("f").cast("long")), d.select("record_id", "label"), d.select("record_id")))


def values(net):
    return {(r.layer, r.node, r.f): (round(r.w, 12), round(r.m, 12), round(r.v, 14)) for r in net.table.collect()}


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    """Three micro-batches in one run, and with a new network after each: the same parameters. A replayed batch changes nothing."""
    df, prepare = small(spark)
    store = params.Store(spark, str(tmp_path / "store"))
    once = model.Network(spark, SMALL)
    for k in range(3):
        part = df.filter(F.col("record_id") % 3 == k)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        once.step(*prepare(part), part.count())
        net = model.Network(spark, SMALL)  # as after a restart: its own parameters are the initial ones
        trainer.train_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), net, prepare, store, str(tmp_path / "cp")).awaitTermination()
    assert values(net) == values(once) and store.version("network") == 2 and store.about("network")["batch_id"] == 2
    (tmp_path / "again").mkdir()
    df.filter("record_id < 3").write.mode("append").parquet(str(tmp_path / "again"))
    trainer.train_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "again")), net, prepare, store, str(tmp_path / "cp2")).awaitTermination()
    assert store.version("network") == 2  # micro-batch 0 has been applied
    df.filter("record_id < 0").write.parquet(str(tmp_path / "empty"))
    trainer.train_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "empty")), net, prepare, params.Store(spark, str(tmp_path / "store2")), str(tmp_path / "cp3")).awaitTermination()
    assert params.Store(spark, str(tmp_path / "store2")).version("network") == -1


def test_load_resumes(spark, tmp_path):
    df, prepare = small(spark, 8)
    store, net = params.Store(spark, str(tmp_path)), model.Network(spark, SMALL)
    first = net.step(*prepare(df), 8).first().loss
    net.save(store)
    assert net.step(*prepare(df), 8).first().loss < first
    other = model.Network(spark, SMALL)
    other.load(store)
    other.step(*prepare(df), 8)
    assert values(other) == values(net) and other.steps == 2
    net.replace(1, spark.createDataFrame([(0, 1, 9.0), (1, -1, 8.0)], "node long, f long, w double"))
    got = values(net)
    assert got[1, 0, 1] == (9.0, 0, 0) and got[1, 1, -1] == (8.0, 0, 0) and len(got) == len(values(other))


@pytest.mark.parametrize("family,mode,fifo", [("dwta", 1, True), ("wta", 4, False), ("minhash", 4, True), ("srp", 1, False), ("dwta", 2, True), ("dwta", 3, True)])
def test_configuration_decides(spark, family, mode, fifo):
    """Three layers with every hash family and mode; labels are among the active nodes, predictions only where asked for."""
    c = replace(SMALL, sizes=(6, 5, 8), num_layer=3, k=(2, 2, 2), l=(3, 3, 3), range_pow=(4, 4, 4), sparsity=(1.0, 1.0, 0.5, 1.0, 1.0, 0.5), family=family, mode=mode, fifo=fifo, adam=mode != 2)
    df, prepare = small(spark, 6)
    x, y, records = prepare(df.withColumn("label", F.col("label") + 5))
    net = model.Network(spark, c, seed=3)
    acts, z = net.forward(x, records, y, True)
    active = {(r.record_id, r.node) for r in z.collect()}
    assert {(r.record_id, r.label) for r in y.collect()} <= active and len(acts) == 3
    per = [sum(1 for i, _ in active if i == k) for k in range(6)]
    assert per == [4] * 6 if mode in (2, 3) else per == [8] * 6 if mode == 4 else max(per) <= 8
    before = values(net)
    assert net.step(x, y, records, 6).first().n == 6 and values(net) != before
    assert net.predict(x, records).count() == net.predict(x, records, y).count() == 6


def test_a_layer_without_a_mode_has_no_active_node(spark):
    df, prepare = small(spark, 4)
    net = model.Network(spark, replace(SMALL, mode=2, sparsity=(0.5, 1.0, 1.0, 1.0)))
    x, y, records = prepare(df)
    assert net.active(0, x, records, y, True).count() == 0 and net.active(1, x, records, y, True) is None


def test_training_follows_the_schedule(spark):
    df, prepare = small(spark, 20)
    net = model.Network(spark, replace(SMALL, sparsity=(1.0, 0.5, 1.0, 1.0), rehash=16, rebuild=24, step_size=3))
    calls, rehash = [], net.rehash
    net.rehash = lambda: (calls.append(net.steps), rehash())
    x, y, records = prepare(df)
    out = model.train(net, x, y, records, epochs=2, test=(x, y, records))
    # 20 records make two whole batches of 8; hashed at first need, then after iterations 1 and 3 (every second, phase 1) and 1 (every third, phase 1)
    assert [(m["iter"], m["kind"], m["n"]) for m in out] == [(0, "eval", 20), (0, "train", 8), (1, "train", 8), (1, "eval", 20), (2, "train", 8), (3, "eval", 20), (3, "train", 8), (3, "eval", 20)]
    assert calls == [0, 2, 4]


def test_a_record_without_features_has_the_bias(spark):
    w, b = model.layer(spark, 0, 3, 4)
    x = spark.createDataFrame([(1, 0, 1.0), (2, 77, 1.0)], "record_id long, f long, v double")
    records = spark.createDataFrame([(1,), (2,), (3,)], "record_id long")
    got = {(r.record_id, r.node): r.z for r in network.preactivation(x, w, b, records=records).collect()}
    bias = {r.node: r.b for r in b.collect()}
    assert len(got) == 9 and all(got[i, n] == pytest.approx(bias[n]) for i in (2, 3) for n in range(3))


def test_gaussian(spark):
    r = model.gaussian(spark, 100, 100, seed=1).agg(F.avg("w").alias("m"), F.stddev("w").alias("s"), F.countDistinct("node", "f").alias("n")).first()
    assert abs(r.m) < 1e-3 and abs(r.s - 0.01) < 1e-3 and r.n == 10_000


def test_murmur_column(spark):
    data = [b"", b"a", b"ab", b"abc", b"abcd", b"hello, world", b"The quick brown fox!", bytes(range(256)), None]
    df = spark.createDataFrame(list(enumerate(data)), "i int, v binary")
    for seed in (0, 42, 0x9747B28C):
        got = [r.h for r in df.select("i", hashing.murmur3_column(F.col("v"), seed).alias("h")).orderBy("i").collect()]
        assert got == [None if v is None else hashing.murmur3(v, seed) for v in data]


def test_arrays_keep_every_type(spark, tmp_path):
    arrays.register(spark)
    made = {"c": np.array([1 + 2j, -3.5j]), "i": np.array([[2**53 + 1, -(2**62)]]), "u": np.array([2**64 - 1], np.uint64), "e": np.empty((0, 3), "<f4"), "b": np.array([True, False]), "g": np.arange(6, dtype=">i2").reshape(2, 3), "f": np.asfortranarray(np.arange(6.0).reshape(2, 3))}
    for k, a in made.items():
        arrays.save_npz(str(tmp_path / "x.npz"), k, a, append=k != "c")
    df = spark.read.format("npz").load(str(tmp_path / "x.npz"))
    for kind in ("npy", "npz"):
        df.coalesce(1).write.format(kind).mode("overwrite").save(str(tmp_path / kind))
        df.coalesce(1).write.format(kind).mode("overwrite").save(str(tmp_path / kind))
        back = {r.name: arrays.array_of(r.asDict()) for r in spark.read.format(kind).load(str(tmp_path / kind)).collect()}
        assert set(back) == set(made) and all(back[k].dtype == a.dtype and back[k].shape == a.shape and (back[k] == a).all() for k, a in made.items())
        assert not list((tmp_path / kind).glob(".*.draft"))
    assert len(list((tmp_path / "npz").glob("*.npz"))) == 1
    head = arrays.header(np.zeros(3, "<f4"))
    assert head[:8] == b"\x93NUMPY\x01\x00" and len(head) % 16 == 0 and b"'shape': (3,)" in head


def test_store_versions(spark, tmp_path):
    store = params.Store(spark, str(tmp_path))
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "CLAIM-0").touch()  # another writer is at version 0
    assert store.version("t") == -1 and store.commit("t", spark.range(3), about={"x": 1}) == 1
    assert store.about("t") == {"x": 1} and store.read("t").count() == 3 and store.version("t") == 1
    assert store.put_array("a", spark.range(10).select(F.col("id").alias("idx"), F.col("id").alias("val")), 4) == 0
    assert store.put_block("a", 2, spark.createDataFrame([(8, 80), (9, 90)], "idx long, val long")) == 1
    assert {r.idx: r.val for r in store.array("a").collect()} == {i: i if i < 8 else 10 * i for i in range(10)}
    assert [r.val for r in store.block("a", 2).orderBy("idx").collect()] == [80, 90] and store.about("a", 0)["of"]["2"] == 0


def test_batches_of_sparse_ids(spark):
    ids = [i * 10**12 - 5 * 10**15 for i in range(1000)]
    got = sparse_text.batches(spark.createDataFrame([(i,) for i in ids], "record_id long"), 128, drop_partial=True).collect()
    assert sorted((r.record_id, r.row_idx, r.batch_id) for r in got) == [(v, i, i // 128) for i, v in enumerate(ids[:896])]
    assert sparse_text.batches(spark.createDataFrame([], "record_id long"), 128).count() == 0


def test_text_rows(spark, tmp_path):
    (tmp_path / "a.txt").write_text("2 9 3\n1 2:3\n\n0 1:1\n")
    (tmp_path / "b.txt").write_text("\n5 1:1\n")  # a blank header is one too
    got = sparse_text.read(spark, str(tmp_path / "*.txt")).collect()
    assert sorted((r.row_idx, r.labels[0]) for r in got) == [(0, 1), (1, 0), (2, 5)]
    odd = spark.createDataFrame([("1 2:3", 7, "x")], "value string, head int, tail string")
    r = sparse_text.parse(odd).first()
    assert (r.head, r.tail, r.labels) == (7, "x", [1])


def test_command_line():
    n, c = config.command_line(["w3", "test.txt", "train.txt"])
    assert (n, c.test_data, c.train_data) == (2, "test.txt", "train.txt") and config.command_line(["w1"])[1] == config.Config()
    assert config.LARGE.validated().sizes[-1] == 13330


def test_step_size():
    assert network.step_size(1e-4, 1) == pytest.approx(3.1622776601683816e-05) and math.isfinite(network.step_size(1e-4, 10**6))


def test_arrays_share_partitions(spark, tmp_path):
    """Many small files are few partitions, and a large archive is several; each array is read once."""
    arrays.register(spark)
    rows = spark.range(300).select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("name"), F.expr("array(2L)").alias("shape"), F.lit("<f8").alias("dtype"), F.lit(False).alias("fortran"), F.expr("array(double(id), double(-id))").alias("data"))
    for kind in ("npy", "npz"):
        where = str(tmp_path / kind)
        rows.coalesce(2).write.format(kind).mode("overwrite").save(where)
        df = spark.read.format(kind).load(where)
        assert df.rdd.getNumPartitions() <= 2 and sorted((r.name, list(r.data)) for r in df.collect()) == sorted((f"a{i}", [float(i), float(-i)]) for i in range(300))
    big = arrays._Reader({"path": str(tmp_path / "npz")}, ".npz")
    whole = [n for p in big.partitions() for n, _ in big.arrays(p)]
    arrays.SPLIT, old = 5000, arrays.SPLIT
    try:
        parts = big.partitions()
        assert len(parts) > 4 and sorted(n for p in parts for n, _ in big.arrays(p)) == sorted(whole)
    finally:
        arrays.SPLIT = old


def test_archive_stays_open_while_rows_come(tmp_path, monkeypatch):
    """A task opens its archive once: its work doesn't grow with the square of its rows."""
    from pyspark.sql import Row

    import pyspark

    opened = []
    real = arrays.zipfile.ZipFile
    monkeypatch.setattr(arrays.zipfile, "ZipFile", lambda *a, **k: opened.append(a[0]) or real(*a, **k))
    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: type("Task", (), {"partitionId": lambda self: 0})()))
    w = arrays._Writer({"path": str(tmp_path)}, ".npz", True)
    w.commit([w.write(iter([Row(name=f"x{i}", shape=[1], dtype="<f8", data=[float(i)]) for i in range(50)])), None])
    assert len(opened) == 1
    back = arrays.load(str(next(tmp_path.glob("*.npz"))))
    assert len(back) == 50 and back["x7"].tolist() == [7.0] and not list(tmp_path.glob(".*"))
