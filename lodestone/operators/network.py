"""Forward pass, loss, gradients and updates as joins and sums.

Activations are rows (record_id, f, v), weights (node, f, w), biases (node, b), targets (record_id, label). Inner joins on the
feature and sums by (record, node) combine on the map side; weights are broadcast by Spark only below its size limit."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BETA1, BETA2, EPS, NORM = 0.9, 0.999, 1e-8, 1e-7
PACKED = 256 << 20


def dots(x: DataFrame, w: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """(record_id, node, z): dot products of activations and weights that carry the bias as a feature of value 1."""
    met = x.join(w, "f") if active is None else active.join(x, "record_id").join(w, ["node", "f"])
    return met.groupBy("record_id", "node").agg(F.sum(F.col("w") * F.col("v")).alias("z"))


def preactivation(x: DataFrame, w: DataFrame, b: DataFrame, active: DataFrame | None = None, records: DataFrame | None = None) -> DataFrame:
    """(record_id, node, z): dot products with the weights plus the bias, of the active nodes or of all.

    A record without a common feature has the bias alone when its active nodes, or the records, are given; else it is not known here."""
    if active is None and records is not None:
        one = records.select("record_id", F.lit(-1).cast("long").alias("f"), F.lit(1.0).alias("v"))
        return dots(x.select("record_id", "f", "v").unionByName(one), w.select("node", "f", "w").unionByName(b.select("node", F.lit(-1).cast("long").alias("f"), F.col("b").alias("w"))))
    if active is None:
        met = x.join(w, "f").groupBy("record_id", "node").agg(F.sum(F.col("w") * F.col("v")).alias("s"))
        return met.join(b, "node").select("record_id", "node", (F.col("s") + F.col("b")).alias("z"))
    met = active.join(x, "record_id").join(w, ["node", "f"]).groupBy("record_id", "node").agg(F.sum(F.col("w") * F.col("v")).alias("s"))
    return active.join(met, ["record_id", "node"], "left").join(b, "node").select("record_id", "node", (F.coalesce("s", F.lit(0.0)) + F.col("b")).alias("z"))


def relu(z: Column) -> Column:
    return F.greatest(z, F.lit(0.0))


def hidden(x: DataFrame, w: DataFrame, b: DataFrame) -> DataFrame:
    """The next layer's activations (record_id, f, v)."""
    return preactivation(x, w, b).select("record_id", F.col("node").alias("f"), relu(F.col("z")).alias("v"))


def softmax(z: DataFrame) -> DataFrame:
    """(record_id, node, z, p) over each record's active nodes; the shift is max(0, max z)."""
    one = Window.partitionBy("record_id")
    shifted = z.withColumn("__e", F.exp(F.col("z") - F.greatest(F.max("z").over(one), F.lit(0.0))))
    return shifted.withColumn("p", F.col("__e") / (F.sum("__e").over(one) + F.lit(NORM))).drop("__e")


def output_delta(p: DataFrame, targets: DataFrame, batch: int) -> DataFrame:
    """(record_id, node, delta): (1 / labels - p) / batch at a label, -p / batch elsewhere."""
    share = targets.groupBy("record_id").agg((F.lit(1.0) / F.count("*")).alias("y"))
    marked = p.join(targets.select("record_id", F.col("label").alias("node"), F.lit(1.0).alias("own")), ["record_id", "node"], "left").join(share, "record_id", "left")
    return marked.select("record_id", "node", ((F.coalesce(F.col("own") * F.col("y"), F.lit(0.0)) - F.col("p")) / batch).alias("delta"))


def beside(p: DataFrame, targets: DataFrame) -> DataFrame:
    """(record_id, node, p, y): every probability with its target, 1 / labels at a label and 0 elsewhere; a label that was not active has a null p."""
    share = targets.groupBy("record_id").agg((F.lit(1.0) / F.count("*")).alias("y"))
    own = targets.groupBy("record_id", F.col("label").alias("node")).agg(F.count("*").alias("times")).join(share, "record_id")
    own = own.select("record_id", "node", (F.col("times") * F.col("y")).alias("y"))
    return p.select("record_id", "node", "p").join(own, ["record_id", "node"], "full").select("record_id", "node", "p", F.coalesce("y", F.lit(0.0)).alias("y"))


def observed() -> tuple[Column, Column]:
    """What observe() sums over rows of beside(): records with a label, and their loss."""
    lost = F.col("y") * -F.log(F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(1e-12)))
    return F.sum("y").alias("n"), F.sum(F.when(F.col("y") > 0, lost)).alias("lost")


def mean_loss(sums: dict) -> tuple[int, float]:
    """(n, loss) as log_loss() has them."""
    n = round(sums["n"] or 0.0)
    return n, (sums["lost"] or 0.0) / n if n else 0.0


def delta_of(marked: DataFrame, batch: int) -> DataFrame:
    """(record_id, node, delta) of the active nodes, from rows of beside()."""
    return marked.filter("p is not null").select("record_id", "node", ((F.col("y") - F.col("p")) / batch).alias("delta"))


def hidden_delta(delta: DataFrame, w: DataFrame, act: DataFrame) -> DataFrame:
    """(record_id, node, delta) of the layer before, where its activation is above 0."""
    back = delta.join(w, "node").groupBy("record_id", "f").agg(F.sum(F.col("delta") * F.col("w")).alias("delta"))
    return back.join(act.filter("v > 0").select("record_id", "f"), ["record_id", "f"], "left_semi").select("record_id", F.col("f").alias("node"), "delta")


def gradient(delta: DataFrame, act: DataFrame) -> DataFrame:
    """(node, f, g): sums of delta times activation over the batch; zero terms are left out, which changes no sum."""
    return delta.filter("delta <> 0").join(act.filter("v <> 0"), "record_id").groupBy("node", "f").agg(F.sum(F.col("delta") * F.col("v")).alias("g"))


def bias_gradient(delta: DataFrame) -> DataFrame:
    return delta.groupBy("node").agg(F.sum("delta").alias("g"))


def step_size(lr: float, t: int) -> float:
    """The bias-corrected rate of step t, counted from 1."""
    return lr * math.sqrt(1 - BETA2**t) / (1 - BETA1**t)


def adam(params: DataFrame, grads: DataFrame, keys: list[str], lr: float, t: int, name: str = "w") -> DataFrame:
    """Parameters (keys, name, m, v) after a step up the gradient; those without one move by their moments."""
    g = F.coalesce("g", F.lit(0.0))
    moved = params.join(grads.select(*keys, "g"), keys, "left").withColumns({"m": F.lit(BETA1) * F.col("m") + F.lit(1 - BETA1) * g, "v": F.lit(BETA2) * F.col("v") + F.lit(1 - BETA2) * g * g})
    return moved.withColumn(name, F.col(name) + F.lit(step_size(lr, t)) * F.col("m") / (F.sqrt("v") + F.lit(EPS))).drop("g")


def sgd(params: DataFrame, grads: DataFrame, keys: list[str], lr: float, name: str = "w") -> DataFrame:
    return params.join(grads.select(*keys, "g"), keys, "left").withColumn(name, F.col(name) + F.lit(lr) * F.coalesce("g", F.lit(0.0))).drop("g")


def predicted(z: DataFrame, records: DataFrame | None = None, decimals: int = 9) -> DataFrame:
    """(record_id, predicted): the node of the largest activation, of equal ones the lowest; null for records without active nodes."""
    best = z.groupBy("record_id").agg(F.max_by("node", F.struct(F.round("z", decimals).alias("z"), (-F.col("node")).alias("n"))).alias("predicted"))
    return best if records is None else records.select("record_id").join(best, "record_id", "left")


def hits(pred: DataFrame, targets: DataFrame) -> DataFrame:
    """(record_id, predicted, hit): whether the predicted node is a label."""
    own = targets.select("record_id", F.col("label").alias("predicted"), F.lit(True).alias("own")).distinct()
    return pred.join(own, ["record_id", "predicted"], "left").select("record_id", "predicted", F.coalesce("own", F.lit(False)).alias("hit"))


def accuracy(hit: DataFrame) -> DataFrame:
    return hit.agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("long")).alias("correct"), F.avg(F.col("hit").cast("double")).alias("accuracy"))


def log_loss(p: DataFrame, targets: DataFrame) -> DataFrame:
    """(n, loss): mean over records of the mean -log p of their labels; a label that was not active counts with p = 1e-12."""
    own = targets.join(p.select("record_id", F.col("node").alias("label"), "p"), ["record_id", "label"], "left")
    each = own.groupBy("record_id").agg(F.avg(-F.log(F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(1e-12)))).alias("loss"))
    return each.agg(F.count("*").alias("n"), F.avg("loss").alias("loss"))


def packed_forward(x: DataFrame, weights: object, bias: object, vector_col: str = "embedding", id_col: str = "record_id") -> DataFrame:
    """(record_id, predicted, z) of dense rows by blocks of matrix products; the layer's matrix goes out as one broadcast, of at most PACKED
    bytes. This is the fast path for dense layers up to that size; preactivation() is the way beyond it."""
    import numpy as np
    import pyarrow as pa

    if 8 * np.size(weights) > PACKED:
        raise ValueError("the matrix is too large to broadcast; use preactivation()")

    shared = x.sparkSession.sparkContext.broadcast((np.asarray(weights, np.float64), np.asarray(bias, np.float64)))

    def run(batches):  # noqa: ANN001, ANN202
        w, b = shared.value
        for part in batches:
            flat = part.column(1)
            m = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
            for s in range(0, part.num_rows, 1024):
                z = np.round(m[s : s + 1024] @ w.T + b, 9)
                best = z.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0)[s : s + 1024], pa.array(best.astype(np.int64)), pa.array(z[np.arange(len(z)), best])], names=[id_col, "predicted", "z"])

    return x.select(id_col, vector_col).mapInArrow(run, f"{id_col} long, predicted long, z double")
