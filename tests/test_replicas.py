"""Training by replicas in barrier tasks: what it shares with training step by step, and how many jobs it takes."""

from __future__ import annotations

import threading
from dataclasses import replace
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import config
from lodestone.plans import catalog, model, replicas

SMALL = config.Config(lr=0.05, sizes=(6, 40), input_dim=8, sparsity=(1.0,) * 4, batch_size=16, rehash=32, rebuild=48, k=(2, 2), l=(3, 3), range_pow=(4, 4), enough=14, fill=10, step_size=2, reshuffle=2)
DEEP = replace(SMALL, num_layer=3, sizes=(6, 5, 40), k=(2, 2, 2), l=(3, 3, 3), range_pow=(4, 4, 4), sparsity=(1.0,) * 6)
# name: configuration, epochs, whether it is tested
CASES = {
    "dense": (SMALL, 2, True),
    "deep": (DEEP, 1, False),
    "sgd": (replace(SMALL, adam=False, lr=1.0), 1, False),
    "sampling": (replace(SMALL, sparsity=(1.0, 0.5, 1.0, 1.0)), 2, False),
    "threshold": (replace(DEEP, sparsity=(1.0, 1.0, 0.5, 1.0, 1.0, 0.5), mode=1, family="wta"), 1, True),
    "predicted": (replace(SMALL, sparsity=(1.0, 1.0, 1.0, 0.5), step_size=1), 1, True),
}


def uneven(spark, n):
    """Features with gaps, an unknown one and a repeated one; records without features, with two labels, without, with one that no node has."""
    x = spark.range(n).filter("id % 11 <> 3").select(F.col("id").alias("record_id"), F.explode(F.array(*[F.lit(f).cast("long") for f in (0, 1, 2, 3, 4, 5, 6, 7, 7, 99)])).alias("f"))
    x = x.filter("(f + record_id) % 4 > 0").withColumn("v", F.sin((F.col("f") + 1) * F.col("record_id")))
    y = spark.range(n).filter("id % 7 > 0").select(F.col("id").alias("record_id"), F.explode(F.array(F.col("id") % 5, F.when(F.col("id") % 3 == 0, 20 + F.col("id") % 9), F.when(F.col("id") % 10 == 9, F.lit(777)))).alias("label"))
    return x, y.filter("label is not null"), spark.range(n).withColumnRenamed("id", "record_id")


def values(net):
    return {(r.layer, r.node, r.f): (r.w, r.m, r.v) for r in net.table.collect()}


@pytest.mark.parametrize("case", CASES)
def test_replicas_train_as_steps_do(spark, monkeypatch, case):
    c, epochs, tested = CASES[case]
    monkeypatch.setattr(model, "EVALUATE", 1)
    monkeypatch.setattr(model, "AFTER_EPOCH", 2)
    x, y, records = (model.kept(t) for t in uneven(spark, 40))
    nets = [model.Network(spark, c, seed=3 if case == "threshold" else None) for _ in range(2)]
    assert replicas.fits(nets[0])
    a, b = (how(net, x, y, records, epochs, (x, y, records) if tested else None) for how, net in zip((replicas.train, model.train), nets, strict=True))
    assert [(m["iter"], m["kind"], m["n"], m.get("correct")) for m in a] == [(m["iter"], m["kind"], m["n"], m.get("correct")) for m in b]
    assert [m.get("loss", m.get("accuracy")) for m in a] == pytest.approx([m.get("loss", m.get("accuracy")) for m in b], abs=1e-11)
    one, two = (values(net) for net in nets)
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k], abs=1e-11) for k in one)
    assert (nets[0].steps, nets[0].generation) == (nets[1].steps, nets[1].generation) and nets[0].loss == pytest.approx(nets[1].loss, abs=1e-11)
    held = [{(j, r.tbl, r.bucket, r.node) for j, t in net.buckets.items() for r in t.collect()} for net in nets]
    assert held[0] == held[1] and bool(held[0]) == (min(c.sparsity) < 1)
    if case == "sampling":  # both go on from the buckets and moments that they hold
        more = [how(net, x, y, records, 1) for how, net in zip((replicas.train, model.train), nets, strict=True)]
        assert [m["loss"] for m in more[0]] == pytest.approx([m["loss"] for m in more[1]], abs=1e-11)


def test_full_rings_keep_their_last_nodes(spark):
    """More nodes than a bucket holds: replicas keep the ones that the ring tables keep."""
    net = model.Network(spark, replace(SMALL, sizes=(6, 900), sparsity=(1.0, 0.5, 1.0, 1.0), k=(1, 1), l=(2, 2)))
    replica = replicas.Replica(net)
    replica.rehash()
    net.rehash()
    want = {(r.tbl, r.bucket, r.node) for r in net.buckets[1].collect()}
    assert {(t, int(b), n) for n, of in enumerate(replica.kept) for t, b in enumerate(of) if b >= 0} == want and len(want) < 1800


def test_what_does_not_fit_is_trained_by_steps(spark, monkeypatch):
    x, y, records = uneven(spark, 32)
    called = []
    monkeypatch.setattr(model, "train", lambda *a: called.append(a[0].config) or [])
    for c in (replace(SMALL, sizes=(6, 20_000)), replace(SMALL, sparsity=(0.5, 1.0, 1.0, 1.0)), replace(SMALL, sparsity=(1.0, 0.5, 1.0, 1.0), family="srp"), replace(SMALL, sparsity=(1.0, 1.0, 1.0, 0.5), mode=3)):
        assert replicas.train(model.Network(spark, c), x, y, records) == [] and called.pop() == c
    assert replicas.train(model.Network(spark, SMALL), x, y, records.filter("record_id < 10")) == [] and not called


@pytest.mark.parametrize("reached", [True, False])
def test_sums_meet_at_one_task(reached):
    """By sockets, or by the barrier's messages where a task can't be reached."""
    n, told, turn = 3, {}, threading.Barrier(3)

    def gather(me):
        def all_gather(message):
            told[me] = message
            turn.wait(30)
            out = [told[k] for k in range(n)]
            turn.wait(30)
            return out

        return all_gather

    host = "127.0.0.1" if reached else "no-such-host.invalid"
    out = {}

    def task(me):
        ctx = SimpleNamespace(partitionId=lambda: me, getTaskInfos=lambda: [SimpleNamespace(address=f"{host}:1")] * n, allGather=gather(me))
        sums = replicas.Sums(ctx)
        out[me] = sums.direct, [sums.total(np.arange(4.0) + me + k).tolist() for k in range(3)]
        sums.close()

    replicas.MEET, before = 2, replicas.MEET
    threads = [threading.Thread(target=task, args=(k,)) for k in range(n)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(60)
    replicas.MEET = before
    assert out == {me: (reached, [[3.0 * f + 3 + 3 * k for f in range(4)] for k in range(3)]) for me in range(n)}


def jobs_of(spark, tmp_path, name):
    """Jobs that a query takes over 3 and over 9 batches, and its rows."""
    out = []
    for batches in (3, 9):
        where = f"{tmp_path}/{batches}"
        rows = spark.range(batches * 128 + 5).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sin(i * F.col("id")).cast("float")).alias("embedding"), (F.col("id") % 10).cast("int").alias("label"))
        rows.coalesce(1).write.parquet(f"{where}/embeddings.parquet")
        spark.sparkContext.setJobGroup(where, "")
        got = catalog.QUERIES[name](spark, where).collect()
        out.append((len(spark.sparkContext.statusTracker().getJobIdsForGroup(where)), [tuple(r) for r in got]))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out


@pytest.mark.parametrize("name", ["evaluation_schedule", "train_sampled_metrics", "train_epoch_metrics"])
def test_jobs_do_not_grow_with_the_batches(spark, tmp_path, name):
    (few, a), (more, b) = jobs_of(spark, tmp_path, name)
    trained = [r for r in b if r[1] == "train" or name != "evaluation_schedule"]
    assert [r[0] for r in trained] == list(range(9)) and len(a) < len(b)
    assert more <= few + 4  # adaptive planning may differ by a job or two; a step was two at least
