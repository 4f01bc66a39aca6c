"""Sparse multi-label text: `label,label feature:value feature:value`, one record a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: a record, or the tokens that were dropped
PARSED = """
  transform(filter(transform(split(head, ','), x -> try_cast(x as int)), x -> x is not null and x >= 0), x -> x) as labels,
  filter(transform(filter(split(tail, '\\\\s+'), t -> t <> ''), t -> struct(try_cast(try_element_at(split(t, ':', 2), 1) as int) as f, try_cast(try_element_at(split(t, ':', 2), 2) as double) as v)), x -> x.f is not null and x.f >= 0 and x.v is not null) as features,
  size(filter(split(head, ','), x -> x <> '')) + size(filter(split(tail, '\\\\s+'), t -> t <> '')) as n_tokens
"""


def parse(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """The table with labels, features (array<struct<f, v>>) and n_rejected added; blank lines go.

    A line is trimmed, then split at its first space, so a line without labels loses its first feature. Columns of the table
    with the three names are replaced; all others pass, whatever their names."""
    passed = [c for c in lines.columns if c not in ("labels", "features", "n_rejected")]
    clean = F.trim(F.regexp_replace(f"`{line_col}`", "[\\x00\\r]", ""))
    cut = lines.select(F.struct(*[F.col(f"`{c}`") for c in passed]).alias("row"), clean.alias("line")).filter(F.col("line") != "")
    halves = cut.select("row", F.split("line", " ", 2).alias("halves")).select("row", F.col("halves")[0].alias("head"), F.coalesce(F.get("halves", F.lit(1)), F.lit("")).alias("tail"))
    out = halves.selectExpr("row", *[x.strip() for x in PARSED.strip().split(",\n")])
    return out.select(*[F.col("row")[c].alias(c) for c in passed], "labels", "features", (F.col("n_tokens") - F.size("labels") - F.size("features")).alias("n_rejected"))


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, value, valid) of every line's bytes; `at` grows along a file's block, valid says whether the bytes are UTF-8."""
    raw = spark.read.text(path).select(F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    return raw.withColumn("valid", F.is_valid_utf8("value"))


def rejected(spark: SparkSession, path: str) -> DataFrame:
    """(file, n_lines, n_invalid): how many lines each file has, and how many of them are not UTF-8 and thus no records."""
    return scan(spark, path).groupBy("file").agg(F.count("*").alias("n_lines"), F.count_if(~F.col("valid")).alias("n_invalid"))


def read(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """(file, row_idx, labels, features, n_rejected) of the files; the first line of each file is a header, and lines that aren't UTF-8 are left
    out (rejected() counts them).

    row_idx is a record's place among those of all files, in order of file name. Lines are numbered within the blocks that Spark reads files
    in (a window over one block each); only the number of records of each block is global, so one small table is joined."""
    inner = Window.partitionBy("file", "block").orderBy("at")
    numbered = scan(spark, path).withColumn("line", F.row_number().over(inner))
    record = F.col("valid") & (F.trim(F.regexp_replace("value", "[\\x00\\r]", "")) != "") & ~(F.lit(header) & (F.col("block") == 0) & (F.col("line") == 1))
    kept = numbered.filter(record).withColumn("place", F.row_number().over(inner) - 1)
    sizes = kept.groupBy("file", "block").agg(F.count("*").alias("n"))
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")  # a row for each block
    placed = kept.join(starts, ["file", "block"]).select("file", (F.col("start") + F.col("place")).cast("long").alias("row_idx"), "value")
    return parse(placed).drop("value")


def to_features(records: DataFrame, id_col: str = "record_id") -> DataFrame:
    return records.select(F.col(id_col), F.explode("features").alias("x")).select(id_col, "x.f", "x.v")


def to_targets(records: DataFrame, id_col: str = "record_id") -> DataFrame:
    return records.select(F.col(id_col), F.explode("labels").alias("label"))


def batches(rows: DataFrame, size: int, id_col: str = "record_id", drop_partial: bool = False) -> DataFrame:
    """row_idx and batch_id in order of id, without a sort of all rows in one place.

    Rows are dealt to ranges of the id (bounds from a sample, so sparse ids make no more ranges than dense ones), numbered within each range,
    and the ranges' counts, as many as there are partitions, are added up."""
    spark = rows.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = ",".join(f"{i / n:.9f}" for i in range(n))
    bounds = sorted(set(rows.selectExpr(f"percentile_approx(`{id_col}`, array({shares})) as b").first().b or []))
    place = F.size(F.filter(F.array(*[F.lit(b) for b in bounds[1:]]), lambda b: b <= F.col(id_col))) if len(bounds) > 1 else F.lit(0)
    ranged = rows.withColumn("__r", place)
    sums = ranged.groupBy("__r").agg(F.count("*").alias("__n"))
    before = sums.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")  # a row for each range
    inner = F.row_number().over(Window.partitionBy("__r").orderBy(id_col)) - 1
    out = ranged.withColumn("__in", inner).join(before, "__r").withColumn("row_idx", (F.col("__before") + F.col("__in")).cast("long"))
    out = out.withColumn("batch_id", F.floor(F.col("row_idx") / size)).drop("__r", "__in", "__before")
    if not drop_partial:
        return out
    total = rows.agg(F.floor(F.count("*") / size).alias("__whole"))
    return out.crossJoin(F.broadcast(total)).filter("batch_id < __whole").drop("__whole")  # one row broadcast
