"""Training as one job an epoch, of networks small enough that every task holds them.

A step needs the parameters that the step before it left, so an epoch is a chain of steps, however many machines there are; with a job or more
for each, their starting costs are the time. Here the tasks of one barrier stage hold replicas of the parameters and share each batch's
records: a task computes its records' sums (gradients, loss, hits), the sums are added up in the order of the tasks, and each task makes the same
update. Records are dealt over the tasks by a hash of their id and stream past, sorted by batch; no task holds more of them than its
share of a batch and of the evaluations' first batches. What is added up follows the parameters, so WIDEST bounds them; wider networks,
and layers whose active nodes are not found here, are trained by `model.train`, a few jobs a step."""

from __future__ import annotations

import base64
import copy
import json
import pickle
import secrets
import socket
import time
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import hashing
from lodestone.operators import lsh, network, selection
from lodestone.plans import model
from lodestone.sources import params, sparse_text

#: parameters of the widest network that is trained here; most tasks that share a batch; seconds that tasks take to find each other
WIDEST, TASKS, MEET = 1 << 16, 16, 20
TEST, TRAIN = 0, 1
_OUT = "iter long, kind string, n long, loss double, correct long, state binary"


class Rows:
    """Records: entries (r, f, v) of their features and (of, label) of their labels, r and of being places 0..n-1."""

    def __init__(self, parts: list[pa.RecordBatch]) -> None:
        self.n = sum(p.num_rows for p in parts)

        def flat(name: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
            lists = [p.column(name) for p in parts]
            sizes = np.concatenate([x.value_lengths().to_numpy(zero_copy_only=False) for x in lists] or [np.empty(0, np.int64)]).astype(np.int64)
            return np.repeat(np.arange(self.n), sizes), np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in lists] or [np.empty(0)]).astype(kind)

        (self.r, self.f), (_, self.v), (self.of, self.label) = flat("f", np.int64), flat("v", np.float64), flat("labels", np.int64)

    def matrix(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """The features that occur, in columns, with the bias as the last one; and the columns' numbers, the bias's being dim."""
        known = (self.f >= 0) & (self.f < dim)
        cols, at = np.unique(self.f[known], return_inverse=True)
        out = np.zeros((self.n, len(cols) + 1))
        np.add.at(out, (self.r[known], at), self.v[known])
        out[:, -1] = 1.0
        return out, np.r_[cols, dim].astype(np.int64)

    def targets(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(of, label, y) of the distinct labels: y is a label's share of its record's."""
        if not len(self.of):
            return self.of, self.label, np.empty(0)
        pairs, times = np.unique(np.stack([self.of, self.label]), axis=1, return_counts=True)
        return pairs[0], pairs[1], times / np.bincount(self.of, minlength=self.n)[pairs[0]]


class Sums:
    """Adds up vectors of the tasks of a barrier stage. They meet at task 0 by sockets, whose address and key the barrier tells them; where one
    can't reach it, all use the barrier's own messages, which take a second each (Spark 4.1 looks for an answer once a second)."""

    def __init__(self, ctx: BarrierTaskContext) -> None:
        infos = ctx.getTaskInfos()
        self.ctx, self.me, self.peers, others = ctx, ctx.partitionId(), [], len(infos) - 1
        server = socket.create_server(("", 0), backlog=len(infos)) if others and not self.me else None
        mine = [infos[self.me].address.rpartition(":")[0], server.getsockname()[1], secrets.token_hex(16)] if server else None
        told = json.loads(ctx.allGather(json.dumps(mine))[0])
        if told:
            met = self.meet(server, others, *told)
            if server:
                server.close()
            self.direct = all(t == "yes" for t in ctx.allGather("yes" if met else "no"))
        else:
            self.direct = True  # one task has no one to meet

    def meet(self, server: socket.socket | None, others: int, host: str, port: int, key: str) -> bool:
        until, found = time.monotonic() + MEET, {}
        try:
            if server is None:
                peer = socket.create_connection((host, port), MEET)
                peer.sendall(key.encode() + self.me.to_bytes(4, "big"))
                found[0] = peer
            while server and len(found) < others:
                server.settimeout(max(0.01, until - time.monotonic()))
                peer = server.accept()[0]
                peer.settimeout(1)
                try:
                    hello = self.take(peer, len(key) + 4)
                except OSError:
                    hello = b""
                if secrets.compare_digest(hello[:-4], key.encode()):
                    found[int.from_bytes(hello[-4:], "big")] = peer
                else:
                    peer.close()
        except OSError:
            return False
        for _, peer in sorted(found.items()):
            peer.settimeout(None)
            peer.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
            self.peers.append(peer)
        return True

    @staticmethod
    def take(peer: socket.socket, size: int) -> bytes:
        out = bytearray()
        while len(out) < size:
            part = peer.recv(size - len(out))
            if not part:
                raise ConnectionError("a task that shares the batch has gone")
            out += part
        return bytes(out)

    def total(self, own: np.ndarray) -> np.ndarray:
        """The sum of all tasks' vectors, which are of one length."""
        own = np.ascontiguousarray(own, np.float64)
        if not self.direct:
            told = self.ctx.allGather(base64.b64encode(own.tobytes()).decode())
            return np.sum([np.frombuffer(base64.b64decode(t)) for t in told], axis=0)
        if self.me:
            self.peers[0].sendall(own.tobytes())
            return np.frombuffer(self.take(self.peers[0], own.nbytes))
        for peer in self.peers:
            own = own + np.frombuffer(self.take(peer, own.nbytes))
        for peer in self.peers:
            peer.sendall(own.tobytes())
        return own

    def close(self) -> None:
        for peer in self.peers:
            peer.close()


class Replica:
    """The parameters of a network as matrices (features and the bias, nodes), its Adam moments, and the buckets of a hashed softmax layer."""

    def __init__(self, net: model.Network) -> None:
        c = self.config = net.config
        self.last, self.dims, self.steps, self.generation = net.last, [net.dim(j) for j in range(net.last + 1)], net.steps, net.generation
        self.w, self.m, self.v = ([np.zeros((d + 1, n)) for d, n in zip(self.dims, c.sizes, strict=True)] for _ in range(3))
        t = net.table.toArrow()
        of, node, f = (t.column(k).to_numpy() for k in ("layer", "node", "f"))
        for j, dim in enumerate(self.dims):
            mine = of == j
            for name in ("w", "m", "v"):
                getattr(self, name)[j][np.where(f[mine] < 0, dim, f[mine]), node[mine]] = t.column(name).to_numpy()[mine]
        self.kept: np.ndarray | None = None
        self.slots = None
        if any(net.hashed(self.last, training) for training in (True, False)):
            found = hashing.layout(net.spark, self.dims[-1], c.k[-1] * c.l[-1]).orderBy("bin", "perm", "f").collect()
            shape = (c.k[-1] * c.l[-1], hashing.SLOTS)  # of equal values the first permutation's and then the lowest feature wins
            self.slots = np.array([r.f for r in found]).reshape(shape), np.array([r.pos if c.family == "dwta" else r.f % hashing.SLOTS for r in found]).reshape(shape)
            if self.last in net.buckets:
                self.kept = np.full((c.sizes[-1], c.l[-1]), -1)
                for r in net.buckets[self.last].collect():
                    self.kept[r.node, r.tbl] = r.bucket

    def into(self, net: model.Network) -> None:
        """Puts what was trained into the network it was made from."""
        parts = []
        for j, dim in enumerate(self.dims):
            f, node = (a.ravel() for a in np.indices(self.w[j].shape))
            parts.append(pa.table({"layer": np.full(len(f), j, np.int32), "node": node, "f": np.where(f == dim, model.BIAS, f), **{k: getattr(self, k)[j].ravel() for k in ("w", "m", "v")}}))
        net.table = net.cut(net.spark.createDataFrame(pa.concat_tables(parts), net.table.schema), "table")
        net.steps, net.generation = self.steps, self.generation
        if self.kept is not None:
            rows = [(t, int(b), n, n) for n, of in enumerate(self.kept) for t, b in enumerate(of) if b >= 0]
            net.buckets[self.last] = net.cut(net.spark.createDataFrame(rows, "tbl long, bucket long, node long, seq long"), f"buckets{self.last}")

    # --- active nodes

    def address(self, vectors: np.ndarray) -> np.ndarray:
        """[vector, table]: the bucket of vectors that have all features, so that no bin is empty."""
        features, digits = self.slots
        k, bits = self.config.k[-1], self.config.bits
        won = vectors[:, features].argmax(axis=2)
        h = digits[np.arange(len(digits)), won]
        return (h.reshape(len(vectors), len(digits) // k, k) << (bits * np.arange(k - 1, -1, -1))).sum(axis=2)

    def rehash(self) -> None:
        """Buckets hold their last lsh.SIZE nodes."""
        kept = self.address(self.w[-1][:-1].T)
        for column in kept.T:
            by = np.lexsort((-np.arange(len(column)), column))
            begins = np.flatnonzero(np.r_[True, np.diff(column[by]) != 0])
            rank = np.arange(len(by)) - np.repeat(begins, np.diff(np.r_[begins, len(by)]))
            column[by[rank >= lsh.SIZE]] = -1
        self.kept = kept

    def active(self, h: np.ndarray, targets: tuple[np.ndarray, np.ndarray] | None, training: bool) -> np.ndarray | None:
        """[record, node] of the softmax layer, or None where all are active."""
        c, n = self.config, self.config.sizes[-1]
        if c.sparsity[self.last + (0 if training else self.last + 1)] >= 1:
            return None
        if self.kept is None:
            self.rehash()
        mine, met, foreign = self.address(h), np.zeros((len(h), n), np.int64), np.zeros(len(h), np.int64)
        for t in range(c.l[-1]):
            met += mine[:, t, None] == self.kept[None, :, t]
        if targets is not None:
            of, label = targets
            own = (label >= 0) & (label < n)
            np.add.at(met, (of[own], label[own]), c.l[-1])
            foreign += np.bincount(of[~own], minlength=len(h))  # labels without a node count as candidates
        if c.mode == 1:
            return met > selection.MORE_THAN
        found = met > 0
        have = found.sum(axis=1) + foreign
        factor = 2654435761 * (self.generation + 1) % 2147483647
        place = np.lexsort((np.arange(n), (np.arange(n) * factor + selection.SEED) % 2147483647))
        turn = np.roll(place, -(n // 3))[: c.fill]
        spare = ~found[:, turn] & ((have < c.enough) & (have < c.fill))[:, None]
        spare &= spare.cumsum(axis=1) <= (c.fill - have)[:, None]
        found[:, turn] |= spare
        return found

    # --- passes

    def forward(self, rows: Rows, targets: tuple[np.ndarray, np.ndarray] | None, training: bool) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """What enters each layer, the columns of the first, the output and which of it is active."""
        a, cols = rows.matrix(self.dims[0])
        acts, z = [a], a @ self.w[0][cols]
        for j in range(1, self.last + 1):
            acts.append(np.c_[np.maximum(z, 0.0), np.ones(rows.n)])
            z = acts[j] @ self.w[j]
        active = self.active(acts[-1][:, :-1], targets, training)
        return acts, cols, z, np.ones(z.shape, bool) if active is None else active

    def sums(self, rows: Rows, batch: int) -> np.ndarray:
        """Records with a label, their loss, and the gradients of all layers, one after the other."""
        of, label, y = rows.targets()
        acts, cols, z, active = self.forward(rows, (of, label), True)
        e = np.where(active, z, -np.inf)
        e = np.where(active, np.exp(e - np.maximum(e.max(axis=1, initial=-np.inf), 0.0)[:, None]), 0.0)
        p = e / (e.sum(axis=1) + network.NORM)[:, None]
        own = np.flatnonzero((label >= 0) & (label < z.shape[1]))
        wanted, share = np.zeros(z.shape), np.zeros(len(y))
        wanted[of[own], label[own]] = y[own]
        share[own] = p[of[own], label[own]]
        lost = (y * -np.log(np.maximum(share, 1e-12))).sum()
        delta, grads = np.where(active, (wanted - p) / batch, 0.0), []
        for j in range(self.last, -1, -1):
            g = acts[j].T @ delta
            if j:
                delta = (delta @ self.w[j][:-1].T) * (acts[j][:, :-1] > 0)
            else:
                g, some = np.zeros_like(self.w[0]), g
                g[cols] = some
            grads.append(g)
        return np.concatenate([[len(np.unique(of)), lost], *(g.ravel() for g in reversed(grads))])

    def update(self, flat: np.ndarray) -> None:
        c, at = self.config, 0
        self.steps += 1
        for j, w in enumerate(self.w):
            g = flat[at : at + w.size].reshape(w.shape)
            at += w.size
            if c.adam:
                self.m[j] = network.BETA1 * self.m[j] + (1 - network.BETA1) * g
                self.v[j] = network.BETA2 * self.v[j] + (1 - network.BETA2) * g * g
                w += network.step_size(c.lr, self.steps) * self.m[j] / (np.sqrt(self.v[j]) + network.EPS)
            else:
                w += c.lr * g

    def right(self, rows: Rows) -> tuple[int, int]:
        """(n, correct) of records whose best active node, of equal ones the lowest, may be one of their labels."""
        _, _, z, active = self.forward(rows, None, False)
        best = np.where(active.any(axis=1), np.where(active, np.round(z, 9), -np.inf).argmax(axis=1), -1)
        of, label, _ = rows.targets()
        return rows.n, int(((best[of] == label) & (best[of] >= 0)).sum())


def fits(net: model.Network) -> bool:
    """Whether the network may be trained here: bounded parameters, all layers dense but a softmax layer hashed by winners into rings."""
    c = net.config
    below = [s for part in (c.sparsity[: net.last], c.sparsity[net.last + 1 : -1]) for s in part]
    dense = min(c.sparsity[net.last], c.sparsity[-1]) >= 1
    hashed = net.last > 0 and c.mode in (1, 4) and c.family in ("dwta", "wta") and c.fifo
    narrow = sum((net.dim(j) + 1) * n for j, n in enumerate(c.sizes)) <= WIDEST
    return narrow and min(below, default=1) >= 1 and (dense or hashed) and net.spark.conf.get("spark.dynamicAllocation.enabled", "false") != "true"


def slots(spark: SparkSession) -> int:
    """How many tasks run at once, which a barrier stage may not exceed; spark.default.parallelism need not say so."""
    sc = spark.sparkContext._jsc.sc()
    return max(1, min(TASKS, sc.maxNumConcurrentTasks(sc.resourceProfileManager().defaultResourceProfile())))


def gathered(x: DataFrame, targets: DataFrame, records: DataFrame) -> DataFrame:
    """The records' rows with their features (f, v) and labels as arrays; a null label, -1, is no node's."""
    entries = x.filter("f is not null and v is not null").groupBy("record_id").agg(F.collect_list(F.struct("f", "v")).alias("e"))
    own = targets.groupBy("record_id").agg(F.collect_list(F.coalesce("label", F.lit(-1)).cast("long")).alias("labels"))
    none = F.array().cast("array<long>")
    both = records.join(entries, "record_id", "left").join(own, "record_id", "left")
    return both.select(*records.columns, F.coalesce("e.f", none).alias("f"), F.coalesce("e.v", none.cast("array<double>")).alias("v"), F.coalesce("labels", none).alias("labels"))


def by_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[pa.RecordBatch]]]:
    """((role, batch_id), parts) of rows sorted by them."""

    def runs() -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
        for b in batches:
            key = np.stack([b.column("role").to_numpy(), b.column("batch_id").to_numpy()])
            ends = np.r_[np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, b.num_rows]
            for low, high in zip(np.r_[0, ends[:-1]], ends, strict=True):
                if high > low:
                    yield tuple(key[:, low].tolist()), b.slice(low, high - low)

    for key, some in groupby(runs(), lambda run: run[0]):
        yield key, [part for _, part in some]


def epoch(net: model.Network, replica: Replica, rows: DataFrame, first: int, count: int, tested: bool, final: bool) -> tuple[Replica, list[dict]]:
    """The `count` steps from iteration `first` on, and their evaluations but one of the whole test set; rows are (role, batch_id, record_id, f, v, labels)."""
    c, shared = net.config, net.spark.sparkContext.broadcast(replica)
    every, phase, rebuild = max(1, c.rehash // c.batch_size), c.rehash // c.batch_size - 1, max(1, c.rebuild // c.batch_size)
    few, more = model.EVALUATE, model.AFTER_EPOCH

    def line(at: int, kind: str | None, n: int = 0, loss: float = 0.0, correct: int = 0, state: bytes | None = None) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((at, kind, n, loss, correct, state), kinds, strict=True)], names=["iter", "kind", "n", "loss", "correct", "state"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, sums_of = copy.deepcopy(shared.value), Sums(BarrierTaskContext.get())  # a worker that is used again has the first values
        speaks = not sums_of.me

        def evaluated(test: Rows) -> np.ndarray:
            return np.array(mine.right(test), np.float64)

        parts, tests = by_batch(batches), []
        now = next(parts, None)
        while now is not None and now[0][0] == TEST:
            tests.append(now)
            now = next(parts, None)
        within = {n: Rows([p for (_, b), some in tests for p in some if b < n]) for n in (few, more)} if tested else {}
        for b in range(count):
            i = first + b
            if now is not None and now[0][1] == b:
                own, now = Rows(now[1]), next(parts, None)
            else:
                own = Rows([])
            looks = tested and i % c.step_size == 0
            hits = evaluated(within[few]) if looks else np.zeros(2)
            mine.generation += i % c.reshuffle == c.reshuffle - 1
            sums = sums_of.total(np.r_[hits, mine.sums(own, c.batch_size)])
            mine.update(sums[4:])
            if c.mode in (1, 4) and (i % every == phase or i % rebuild == phase) and mine.slots is not None:
                mine.rehash()
            if speaks and looks:
                yield line(i, "eval", int(sums[0]), 0.0, int(sums[1]))
            if speaks:
                yield line(i, "train", int(sums[2]), sums[3] / sums[2] if sums[2] else 0.0)
        if tested and not final:
            hits = sums_of.total(evaluated(within[more]))
            if speaks:
                yield line(first + count - 1, "eval", int(hits[0]), 0.0, int(hits[1]))
        sums_of.close()
        if speaks:
            yield line(first + count, None, state=pickle.dumps(mine))

    n = slots(net.spark)
    dealt = rows.repartitionById(n, F.pmod(F.xxhash64("record_id"), F.lit(n)).cast("int")).sortWithinPartitions("role", "batch_id", "record_id")
    lines = dealt.select("role", "batch_id", "f", "v", "labels").mapInArrow(run, _OUT, barrier=True).collect()
    shared.destroy()
    out = [metric(r.iter, r.n, r.correct) if r.kind == "eval" else {"iter": r.iter, "kind": "train", "n": r.n, "loss": r.loss} for r in lines if r.kind]
    return pickle.loads(next(r.state for r in lines if not r.kind)), out  # noqa: S301  what run() made


def metric(at: int, n: int, correct: int | None) -> dict:
    return {"iter": at, "kind": "eval", "n": n, "correct": correct if n else None, "accuracy": correct / n if n else None}


def evaluate(net: model.Network, replica: Replica, rows: DataFrame) -> tuple[int, int]:
    """(n, correct) over all rows (f, v, labels), by tasks that need not wait for one another."""
    shared = net.spark.sparkContext.broadcast(replica)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, 1024):
                n, correct = shared.value.right(Rows([b.slice(low, 1024)]))
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([correct])], names=["n", "correct"])

    got = rows.select("f", "v", "labels").mapInArrow(run, "n long, correct long").agg(F.sum("n").alias("n"), F.sum("correct").alias("correct")).first()
    shared.destroy()
    return got.n or 0, got.correct or 0


def train(net: model.Network, x: DataFrame, targets: DataFrame, records: DataFrame, epochs: int | None = None, test: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> list[dict]:
    """What model.train does and returns, a job an epoch where the network fits: the same batches, schedule, updates, evaluations and state afterwards."""
    if not fits(net):
        return model.train(net, x, targets, records, epochs, test)
    c = net.config
    epochs = c.epoch if epochs is None else epochs
    count = records.count() // c.batch_size
    if not count or not epochs:
        return []
    rows = gathered(x, targets, sparse_text.batches(records.select("record_id"), c.batch_size, drop_partial=True).select("record_id", "batch_id")).withColumn("role", F.lit(TRAIN))
    if test:
        some = sparse_text.batches(test[2].select("record_id"), c.batch_size).filter(F.col("batch_id") < max(model.EVALUATE, model.AFTER_EPOCH)).select("record_id", "batch_id")
        near = (t.join(some.select("record_id"), "record_id", "left_semi") for t in test[:2])
        rows = rows.unionByName(gathered(*near, some).withColumn("role", F.lit(TEST)))
    where = params.scratch(net.spark, "dealt")
    if epochs > 1:
        rows.write.parquet(where)
        rows = net.spark.read.schema(rows.schema).parquet(where)
    replica, out = Replica(net), []
    for e in range(epochs):
        replica, lines = epoch(net, replica, rows, e * count, count, bool(test), e + 1 == epochs)
        out += lines
    if test:
        out.append(metric(epochs * count - 1, *evaluate(net, replica, gathered(test[0], test[1], test[2].select("record_id")))))
    replica.into(net)
    net.loss = next((m["n"], m["loss"]) for m in reversed(out) if m["kind"] == "train")
    if epochs > 1:
        params.remove(net.spark, where)
    return out
