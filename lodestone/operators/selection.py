"""Active nodes of each record: dense, threshold, sampling, random, exact top-k. All return (record_id, node)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MORE_THAN, ENOUGH, FILL, SEED = 2, 1500, 1000, 1234


def dense(records: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every node for every record: the whole layer, which is what dense means."""
    return records.select("record_id").crossJoin(nodes.select("node"))


def candidates(hits: DataFrame, targets: DataFrame | None, tables: int) -> DataFrame:
    """(record_id, node, n): collisions over the tables; a true label starts with `tables` of them."""
    own = hits.select(F.col("id").alias("record_id"), "node", "n")
    if targets is not None:
        own = own.unionByName(targets.select("record_id", F.col("label").alias("node"), F.lit(tables).cast("long").alias("n")))
    return own.groupBy("record_id", "node").agg(F.sum("n").alias("n"))


def threshold(found: DataFrame, more_than: int = MORE_THAN) -> DataFrame:
    return found.filter(F.col("n") > more_than).select("record_id", "node")


def place(node: Column, generation: int = 0, seed: int = SEED) -> Column:
    """The sort key of a node in the layer's permutation, which each reshuffle begins anew: a generation has a factor of its own, since another
    summand alone would only turn the order round."""
    factor = 2654435761 * (generation + 1) % 2147483647
    return (node * F.lit(factor) + F.lit(seed)) % F.lit(2147483647)


def permutation(nodes: DataFrame, generation: int = 0, seed: int = SEED) -> DataFrame:
    """(node, pos) of a layer's nodes; as many rows as the layer has nodes."""
    return nodes.select("node", (F.row_number().over(Window.orderBy(place(F.col("node"), generation, seed), "node")) - 1).cast("long").alias("pos"))


def sampling(records: DataFrame, found: DataFrame, nodes: DataFrame, n: int, start: int, enough: int = ENOUGH, fill: int = FILL, generation: int = 0) -> DataFrame:
    """All candidates; a record with fewer than `enough` gets nodes of the permutation, from place `start` on, around, until it has `fill`.

    A record misses at most fill - count nodes, and at most count of the first fill places of the rotation are candidates: so the
    first `fill` places are enough, and the join is records x fill, never records x nodes."""
    counts = records.select("record_id").join(found.groupBy("record_id").agg(F.count("*").alias("have")), "record_id", "left").select("record_id", F.coalesce("have", F.lit(0)).alias("have"))
    turn = permutation(nodes, generation).select("node", F.when(F.col("pos") >= start, F.col("pos") - start).otherwise(F.col("pos") + n - start).alias("turn")).filter(F.col("turn") < fill)
    short = counts.filter((F.col("have") < enough) & (F.col("have") < fill))
    spare = short.crossJoin(F.broadcast(turn)).join(found.select("record_id", "node"), ["record_id", "node"], "left_anti")  # at most `fill` rows broadcast, a setting
    rank = F.row_number().over(Window.partitionBy("record_id").orderBy("turn"))
    more = spare.withColumn("__rank", rank).filter(F.col("__rank") <= fill - F.col("have"))
    return found.select("record_id", "node").unionByName(more.select("record_id", "node"))


def random(records: DataFrame, targets: DataFrame, nodes: DataFrame, n: int, size: int, generation: int = 0) -> DataFrame:
    """Labels, then nodes in a seeded order, `size` in all; more labels than that are cut in order of label."""
    first = targets.select("record_id", F.col("label").alias("node")).distinct()
    ordered = permutation(nodes, generation).filter(F.col("pos") < 2 * size)
    rest = records.select("record_id").crossJoin(F.broadcast(ordered)).join(first, ["record_id", "node"], "left_anti")  # at most 2 * size rows broadcast, a setting
    both = first.select("record_id", "node", F.lit(0).alias("turn"), F.col("node").alias("key")).unionByName(rest.select("record_id", "node", F.lit(1).alias("turn"), F.col("pos").alias("key")))
    rank = F.row_number().over(Window.partitionBy("record_id").orderBy("turn", "key"))
    return both.withColumn("__rank", rank).filter(F.col("__rank") <= size).select("record_id", "node")


def topk(scores: DataFrame, targets: DataFrame, size: int) -> DataFrame:
    """Labels first, then the best scores (record_id, node, z), ties by node; `size` in all."""
    marked = scores.join(targets.select("record_id", F.col("label").alias("node"), F.lit(1).alias("own")).distinct(), ["record_id", "node"], "left")
    rank = F.row_number().over(Window.partitionBy("record_id").orderBy(F.coalesce("own", F.lit(0)).desc(), F.round("z", 9).desc(), "node"))
    return marked.withColumn("__rank", rank).filter(F.col("__rank") <= size).select("record_id", "node")


def nothing(found: DataFrame) -> DataFrame:
    """Modes that do not apply to a layer select no node."""
    return found.filter(F.lit(False)).select("record_id", "node")
