"""Hash tables as rows: buckets (tbl, bucket, node, seq) and their probes. Only buckets that hold something exist."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SIZE = 128
#: the reservoir's constant draw and the slot that it replaces
DRAW, SLOT = 1804289383, 83
#: ranges of seq in which a reservoir counts
RANGES = 1024


def rows(address: DataFrame, seq: Column, node: str = "id") -> DataFrame:
    return address.select("tbl", "bucket", F.col(node).alias("node"), seq.alias("seq"))


def fifo(inserted: DataFrame, size: int = SIZE) -> DataFrame:
    """What ring buckets hold: the last `size` insertions of each. Planned as a partial and a final group limit."""
    rank = F.row_number().over(Window.partitionBy("tbl", "bucket").orderBy(F.desc("seq"), F.desc("node")))
    return inserted.withColumn("__rank", rank).filter(F.col("__rank") <= size).drop("__rank")


def ring(inserted: DataFrame, size: int = SIZE, onto: DataFrame | None = None) -> DataFrame:
    """Kept ring buckets (tbl, bucket, slot, node, seq, number) after insertions (tbl, bucket, node, seq) into those of `onto`, or into empty ones.

    An insertion's number is how many came before it into its bucket, its slot that number modulo `size`, so it takes the place of the
    node that came `size` insertions earlier. Insertions are numbered in order of seq, then node, after those in `onto`. Only rows of buckets
    that get an insertion meet anything; the others pass. Two rings made one after the other equal one made of both."""
    back = F.row_number().over(Window.partitionBy("tbl", "bucket").orderBy(F.desc("seq"), F.desc("node")))
    names = ["tbl", "bucket", "slot", "node", "seq", "number"]
    new = inserted.withColumn("back", back).filter(F.col("back") <= size)  # a partial limit, before the rows meet
    total = inserted.groupBy("tbl", "bucket").agg(F.count("*").alias("total"))
    if onto is not None:
        had = onto.groupBy("tbl", "bucket").agg((F.max("number") + 1).alias("had"))
        total = total.join(had, ["tbl", "bucket"], "left").select("tbl", "bucket", (F.col("total") + F.coalesce("had", F.lit(0))).alias("total"))
    last = new.join(total, ["tbl", "bucket"]).withColumn("number", F.col("total") - F.col("back")).withColumn("slot", F.col("number") % size).select(*names)
    if onto is None:
        return last
    kept = onto.join(total, ["tbl", "bucket"], "left").filter(F.col("total").isNull() | (F.col("number") >= F.col("total") - size)).select(*names)
    return kept.unionByName(last)


def turns(draw: int, size: int) -> list[int]:
    """The counts above `size` at which an insertion replaces the slot's node: draw % count is 1 where count divides draw - 1. At most a few dozen."""
    low = [c for c in range(1, math.isqrt(draw - 1) + 1) if (draw - 1) % c == 0]
    return sorted({c for x in low for c in (x, (draw - 1) // x) if c > max(size, 1)})


def reservoir(inserted: DataFrame, size: int = SIZE, draw: int = DRAW, slot: int = SLOT) -> DataFrame:
    """What reservoir buckets hold: the first `size` insertions; a later one takes the one slot when draw % count is 1. (.., place)

    Only the last such count that a bucket reaches matters, so one insertion of each bucket is looked for by its rank: insertions are counted
    by ranges of seq, and those of the range in which that rank lies are ranked. No other row but the first `size` is sorted or sent. `inserted` is
    read four times."""
    one = Window.partitionBy("tbl", "bucket")
    slot, names = slot % size, ["tbl", "bucket", "node", "seq", "place"]
    rank = F.row_number().over(one.orderBy("seq", "node"))
    first = inserted.withColumn("count", rank).filter(F.col("count") <= size).withColumn("place", F.col("count") - 1)  # a partial limit, before the rows meet
    ends = inserted.agg(F.min("seq").alias("low"), F.max("seq").alias("high"), F.count("*").alias("n"))
    span = ends.select("low", F.greatest(F.lit(1), F.ceil((F.col("high") - F.col("low") + 1) / RANGES)).cast("long").alias("width"))  # one row
    ranged = inserted.crossJoin(F.broadcast(span)).withColumn("range", F.floor((F.col("seq") - F.col("low")) / F.col("width"))).drop("low", "width")
    counts = ranged.groupBy("tbl", "bucket", "range").agg(F.count("*").alias("n"))  # RANGES rows a bucket at most
    turn = F.array_max(F.filter(F.array(*[F.lit(c).cast("long") for c in turns(draw, size)]), lambda c: c <= F.col("total")))
    reach = counts.withColumn("total", F.sum("n").over(one)).withColumn("upto", F.sum("n").over(one.orderBy("range").rowsBetween(Window.unboundedPreceding, 0))).withColumn("turn", turn)
    where = reach.filter((F.col("upto") >= F.col("turn")) & (F.col("upto") - F.col("n") < F.col("turn"))).select("tbl", "bucket", "range", (F.col("turn") - F.col("upto") + F.col("n")).alias("nth"))
    late = ranged.join(F.broadcast(where), ["tbl", "bucket", "range"]).withColumn("count", rank).filter(F.col("count") == F.col("nth"))  # a row a bucket
    last = late.select("tbl", "bucket", "node", "seq", F.lit(slot).alias("place"))
    kept = first.join(last.select("tbl", "bucket", "place"), ["tbl", "bucket", "place"], "left_anti")
    return kept.select(*names).unionByName(last.select(*names))


def probe(queries: DataFrame, buckets: DataFrame) -> DataFrame:
    """(id, node, n): how many tables put a node in the bucket of a query. A bucket holds at most SIZE nodes, so a probe meets at most SIZE per table."""
    return queries.join(buckets, ["tbl", "bucket"]).groupBy("id", "node").agg(F.count("*").alias("n"))


def stats(buckets: DataFrame) -> DataFrame:
    """(tbl, n_buckets, n_nodes, largest) of each table."""
    each = buckets.groupBy("tbl", "bucket").agg(F.count("*").alias("n"))
    return each.groupBy("tbl").agg(F.count("*").alias("n_buckets"), F.sum("n").alias("n_nodes"), F.max("n").alias("largest"))
