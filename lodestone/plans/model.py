"""Layers, initial parameters, the training loop and its schedule.

All parameters are one table (layer, node, f, w, m, v): weights by input feature, biases at feature BIAS, with Adam moments. A record
carries feature BIAS with value 1, so dot products include the bias, records without any feature have it alone, and the
bias's gradient is a weight's. A step is one plan for the output probabilities and one for the new table."""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import hashing
from lodestone.functions.config import Config
from lodestone.operators import lsh, network, selection, tiles
from lodestone.sources import params, sparse_text
from lodestone.sources.batches import Batches

BIAS = -1
#: Batches of the evaluations within an epoch and after one
EVALUATE, AFTER_EPOCH = 20, 50


def weight(layer: int, node: Column, f: Column) -> Column:
    """An initial weight from an integer formula, within 0.1 of zero; the same in every engine."""
    return ((node * 7919 + f * 104729 + F.lit(layer * 1299709)) % 2003 - 1001).cast("double") / F.lit(10010.0)


def bias(layer: int, node: Column) -> Column:
    return ((node * 31 + F.lit(layer * 17)) % 101 - 50).cast("double") / F.lit(1000.0)


def uniform(a: Column, b: Column, seed: int, turn: int) -> Column:
    """A number within 0 and 1, both left out, from two counters, a seed and a turn: a 32-bit mixer of integer columns, so that it's the
    same under any partitioning and in every engine."""
    word = F.lit(1 << 32)
    x = (F.pmod(a, F.lit(1 << 31)) * F.lit(2654435761) % word + F.pmod(b, F.lit(1 << 31)) * F.lit(2246822519) % word + F.lit((seed * 3266489917 + turn * 668265263) % (1 << 32))) % word
    for _ in range(2):
        x = x.bitwiseXOR(F.shiftright(x, 16)) * F.lit(73244475) % word
    return (x.bitwiseXOR(F.shiftright(x, 16)) + F.lit(0.5)) / F.lit(float(1 << 32))


def normal(a: Column, b: Column, seed: int) -> Column:
    """A number from N(0, 1) for two counters, by Box and Muller."""
    return F.sqrt(F.lit(-2.0) * F.ln(uniform(a, b, seed, 0))) * F.cos(F.lit(2 * math.pi) * uniform(a, b, seed, 1))


def gaussian(spark: SparkSession, nodes: int, dim: int, seed: int = 0, sd: float = 0.01) -> DataFrame:
    """(node, f, w) drawn from N(0, sd), each weight by its own counters."""
    grid = spark.range(nodes * dim).select(F.floor(F.col("id") / dim).alias("node"), (F.col("id") % dim).alias("f"))
    return grid.withColumn("w", normal(F.col("node"), F.col("f"), seed) * sd)


def layer(spark: SparkSession, number: int, nodes: int, dim: int) -> tuple[DataFrame, DataFrame]:
    """Weights (node, f, w) and biases (node, b) of one layer."""
    grid = spark.range(nodes * dim).select(F.floor(F.col("id") / dim).alias("node"), (F.col("id") % dim).alias("f"))
    return grid.withColumn("w", weight(number, F.col("node"), F.col("f"))), spark.range(nodes).select(F.col("id").alias("node"), bias(number, F.col("id")).alias("b"))


def moments(df: DataFrame) -> DataFrame:
    return df.withColumns({"m": F.lit(0.0), "v": F.lit(0.0)})


def kept(df: DataFrame) -> DataFrame:
    """The table cut from its lineage, in spark.checkpoint.dir."""
    ctx = df.sparkSession.sparkContext
    if ctx.getCheckpointDir() is None:
        ctx.setCheckpointDir(params.scratch(df.sparkSession, "checkpoint"))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same by columns in the shared folder: compressed, for tables of many rows with few values."""
    where = params.scratch(df.sparkSession, "stored")
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


@dataclass
class Network:
    """Layers of config.sizes over config.input_dim features: ReLU layers and a softmax layer at the end.

    config.sparsity says of each layer, for training and for prediction, whether all nodes are active (1) or those config.mode chooses:
    nodes met in the hash tables of config.family (modes 1 and 4), or, in the softmax layer, random or best ones (2, 3; such a mode
    leaves other layers that aren't dense without active nodes)."""

    spark: SparkSession
    config: Config
    seed: int | None = None  # draw initial weights from N(0, 0.01) in place of the formula
    steps: int = 0
    generation: int = 0
    #: (n, loss) of the last step, from before its update
    loss: tuple[int, float] = (0, 0.0)
    table: DataFrame = None
    buckets: dict[int, DataFrame] = field(default_factory=dict)
    written: dict[str, list[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.config.validated()
        self.folder = params.scratch(self.spark, "network")
        parts = []
        for j, nodes in enumerate(self.config.sizes):
            w, b = layer(self.spark, j, nodes, self.dim(j))
            w = w if self.seed is None else gaussian(self.spark, nodes, self.dim(j), self.seed + j)
            parts += [w.withColumn("layer", F.lit(j)), b.select("node", F.lit(BIAS).cast("long").alias("f"), F.col("b").alias("w"), F.lit(j).alias("layer"))]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        if self.table is None:
            self.table = self.cut(moments(whole).select("layer", "node", "f", "w", "m", "v"), "table")

    @property
    def last(self) -> int:
        return len(self.config.sizes) - 1

    def dim(self, j: int) -> int:
        return self.config.sizes[j - 1] if j else self.config.input_dim

    def cut(self, df: DataFrame, role: str) -> DataFrame:
        """The table written to the shared folder and read back; of each role the last two are kept, older ones removed."""
        path = f"{self.folder}/{role}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        mine = self.written.setdefault(role, [])
        mine.append(path)
        if len(mine) > 2:
            params.remove(self.spark, mine.pop(0))
        return self.spark.read.schema(df.schema).parquet(path)

    def weights(self, j: int) -> DataFrame:
        return self.table.filter(F.col("layer") == j).select("node", "f", "w")

    def replace(self, j: int, rows: DataFrame) -> None:
        """Puts weights (node, f, w), biases at feature BIAS, over those of layer j; moments start anew."""
        new = moments(rows.select(F.lit(j).alias("layer"), "node", "f", "w"))
        self.table = self.cut(self.table.join(new.select("layer", "node", "f"), ["layer", "node", "f"], "left_anti").unionByName(new), "table")

    # --- active nodes

    def address(self, j: int, rows: DataFrame, ids: DataFrame) -> DataFrame:
        """(id, tbl, bucket) of vectors (id, f, v) over the inputs of layer j, by the hash family."""
        c = self.config
        k, l, dim = c.k[j], c.l[j], self.dim(j)  # noqa: E741
        return hashing.addresses(c.family, rows, ids, dim, k, l, c.range_pow[j], c.bits)

    def hashed(self, j: int, training: bool) -> bool:
        return self.config.mode in (1, 4) and self.config.sparsity[j + (0 if training else self.last + 1)] < 1

    def rehash(self) -> None:
        """Hashes the weights of the layers that need it and fills their tables; after an update, so that they follow the new weights."""
        for j in range(self.last + 1):
            if self.hashed(j, True) or self.hashed(j, False):
                rows = self.weights(j).filter(F.col("f") >= 0).select(F.col("node").alias("id"), "f", F.col("w").alias("v"))
                found = lsh.rows(self.address(j, rows, self.spark.range(self.config.sizes[j])), F.col("id"))
                self.buckets[j] = self.cut(lsh.fifo(found) if self.config.fifo else lsh.reservoir(found), f"buckets{j}")

    def active(self, j: int, x: DataFrame, records: DataFrame, targets: DataFrame | None, training: bool) -> DataFrame | None:
        """(record_id, node), or None where all nodes are active. Labels (of the softmax layer only) are always active if given."""
        c, n = self.config, self.config.sizes[j]
        share = c.sparsity[j + (0 if training else self.last + 1)]
        if share >= 1:
            return None
        targets = targets if j == self.last else None
        labels = targets if targets is not None else self.spark.createDataFrame([], "record_id long, label long")
        nodes = self.spark.range(n).withColumnRenamed("id", "node")
        if self.hashed(j, training):
            if j not in self.buckets:
                self.rehash()
            rows = x.select(F.col("record_id").alias("id"), "f", "v")
            hits = lsh.probe(self.address(j, rows, records.select(F.col("record_id").alias("id"))), self.buckets[j])
            found = selection.candidates(hits, targets, c.l[j])
            return selection.threshold(found) if c.mode == 1 else selection.sampling(records, found, nodes, n, n // 3, c.enough, c.fill, self.generation)
        size = int(n * share)
        if j == self.last and c.mode == 2:
            return selection.random(records, labels, nodes, n, size, self.generation)
        if j == self.last and c.mode == 3:
            return selection.topk(network.dots(self.input(x, records), self.weights(j)), labels, size)
        return selection.nothing(selection.dense(records, nodes))

    # --- passes

    @staticmethod
    def input(x: DataFrame, records: DataFrame) -> DataFrame:
        """Activations with the bias's feature."""
        return x.select("record_id", "f", "v").unionByName(records.select("record_id", F.lit(BIAS).cast("long").alias("f"), F.lit(1.0).alias("v")))

    def blocks(self, records: int) -> int:
        """How many blocks of rows so many records make in tiles."""
        return max(1, -(-records // self.config.tile)) if self.config.tile else 0

    def forward(self, x: DataFrame, records: DataFrame, targets: DataFrame | None, training: bool, count: int | None = None) -> tuple[list[DataFrame], DataFrame]:
        """The activations that enter each layer, and the output layer's (record_id, node, z). Dense layers are multiplied by tiles;
        `count` is the number of records, found out here where it isn't given."""
        acts, actives = self.until(x, records, targets, training, count)
        return acts, self.dots(self.last, acts[-1], records, actives[-1], count or records.count())

    def until(self, x: DataFrame, records: DataFrame, targets: DataFrame | None, training: bool, count: int | None = None) -> tuple[list[DataFrame], list[DataFrame | None]]:
        """The activations that enter each layer, and each layer's active nodes."""
        acts, actives = [x], []
        for j in range(self.last + 1):
            actives.append(self.active(j, acts[j], records, targets, training))
            if j < self.last:
                count = count or records.count()
                z = self.dots(j, acts[j], records, actives[j], count)
                acts.append(z.select("record_id", F.col("node").alias("f"), network.relu(F.col("z")).alias("v")))
        return acts, actives

    def dots(self, j: int, x: DataFrame, records: DataFrame, active: DataFrame | None, count: int) -> DataFrame:
        x, w = self.input(x, records), self.weights(j)
        if active is None and self.config.tile:
            return tiles.dots(x, w, self.dim(j), self.blocks(count), self.config.tile)
        return network.dots(x, w, active)

    def step(self, x: DataFrame, targets: DataFrame, records: DataFrame, batch: int, rehash: bool = False, reshuffle: bool = False) -> DataFrame:
        """One batch against frozen weights, then one update; returns (n, loss) from before it, which `loss` holds too.

        Two jobs write: the output's probabilities beside their targets, whose loss is observed as they pass, and the new table."""
        self.generation += reshuffle
        c, n = self.config, self.blocks(batch)
        acts, actives = self.until(x, records, targets, True, batch)
        z = self.dots(self.last, acts[-1], records, actives[-1], batch)
        seen = Observation()
        marked = network.beside(network.softmax(z), targets).observe(seen, *network.observed())
        marked = self.cut(marked, "p")
        self.loss = network.mean_loss(seen.get)
        delta, grads = network.delta_of(marked, batch), None
        for j in range(self.last, -1, -1):
            act, dense = self.input(acts[j], records), actives[j] is None and n
            g = tiles.gradient(delta, act, n, c.tile) if dense else network.gradient(delta, act)
            g = g.withColumn("layer", F.lit(j))
            grads = g if grads is None else grads.unionByName(g)
            if j:
                w = self.weights(j).filter(F.col("f") >= 0)
                delta = tiles.hidden_delta(delta, w, acts[j], c.sizes[j], n, c.tile) if dense else network.hidden_delta(delta, w, acts[j])
        self.steps += 1
        keys = ["layer", "node", "f"]
        new = network.adam(self.table, grads, keys, self.config.lr, self.steps) if self.config.adam else network.sgd(self.table, grads, keys, self.config.lr)
        self.table = self.cut(new.select("layer", "node", "f", "w", "m", "v"), "table")
        if rehash:
            self.rehash()
        return self.spark.range(1).select(F.lit(self.loss[0]).cast("long").alias("n"), F.lit(self.loss[1]).alias("loss"))

    def predict(self, x: DataFrame, records: DataFrame, targets: DataFrame | None = None) -> DataFrame:
        """(record_id, predicted) of all records; with targets given, their labels are active in the softmax layer."""
        count = records.count()
        acts, actives = self.until(x, records, targets, False, count)
        if actives[-1] is None and self.config.tile:
            found = tiles.predicted(self.input(acts[-1], records), self.weights(self.last), self.dim(self.last), self.blocks(count), self.config.tile)
            return records.select("record_id").join(found, "record_id", "left")
        return network.predicted(self.dots(self.last, acts[-1], records, actives[-1], count), records)

    def evaluate(self, x: DataFrame, targets: DataFrame, batches: DataFrame, count: int | None = None, inject: bool = False) -> DataFrame:
        """(n, correct, accuracy) over the first `count` batches of (record_id, batch_id), or over all."""
        mine = batches if count is None else batches.filter(F.col("batch_id") < count)
        records = mine.select("record_id")
        xs, ys = x.join(records, "record_id", "left_semi"), targets.join(records, "record_id", "left_semi")
        return network.accuracy(network.hits(self.predict(xs, records, ys if inject else None), ys))

    # --- saving

    def save(self, store: params.Store, name: str = "network", **about: int) -> int:
        """Commits all parameters as one version, with the step count and what the caller adds."""
        return store.commit(name, self.table, about={"steps": self.steps, "generation": self.generation, **about})

    def load(self, store: params.Store, name: str = "network", version: int | None = None) -> dict:
        """Takes a version's parameters and step count, and returns what was saved with it; hash tables are filled when next needed."""
        self.table, about = store.read(name, version), store.about(name, version)
        self.steps, self.generation, self.buckets = about["steps"], about["generation"], {}
        return about


def train(net: Network, x: DataFrame, targets: DataFrame, records: DataFrame, epochs: int | None = None, test: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> list[dict]:
    """Epochs over the whole batches of the records (record_id), in order of id; what is left over is not trained on. The batches are
    written once, each in files of its own, which its steps read, and so are the first batches that evaluations read again and again.

    Rehash, rebuild and reshuffle follow the schedule. test (x, targets, records) is evaluated by it too: EVALUATE batches whenever the
    iteration is a multiple of step_size, before its step, AFTER_EPOCH after each epoch, all after the last. Returns the metrics in order."""
    c = net.config
    epochs = c.epoch if epochs is None else epochs
    dealt = Batches.write(x, targets, records, c.batch_size)
    count = dealt.count
    tests = kept(sparse_text.batches(test[2].select("record_id"), c.batch_size)) if test else None
    out: list[dict] = []
    parts: dict[int, tuple[DataFrame, DataFrame, DataFrame]] = {}

    def part(n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Features, targets and records of the first n batches, written when first asked for: an evaluation reads no more of the table."""
        if n not in parts:
            mine = tests.filter(F.col("batch_id") < n)
            parts[n] = (*(stored(t.join(mine.select("record_id"), "record_id", "left_semi")) for t in test[:2]), stored(mine))
        return parts[n]

    def evaluate(at: int, n: int | None) -> None:
        if test:
            of = (test[0], test[1], tests) if n is None else part(n)
            out.append({"iter": at, "kind": "eval", **net.evaluate(*of).first().asDict()})

    every, phase = max(1, c.rehash // c.batch_size), c.rehash // c.batch_size - 1
    for i in range(epochs * count):
        if i % c.step_size == 0:
            evaluate(i, EVALUATE)
        again = c.mode in (1, 4) and (i % every == phase or i % max(1, c.rebuild // c.batch_size) == phase)
        net.step(*dealt.read(i % count), c.batch_size, again, i % c.reshuffle == c.reshuffle - 1)
        out.append({"iter": i, "kind": "train", "n": net.loss[0], "loss": net.loss[1]})
        if (i + 1) % count == 0:
            evaluate(i, None if i + 1 == epochs * count else AFTER_EPOCH)
    params.remove(net.spark, dealt.where)
    return out
