"""A training table written once by batch: a step reads its batch's files and no others."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources import params, sparse_text


@dataclass
class Batches:
    """Features (record_id, f, v), targets (record_id, label) and records (record_id), each in a folder with a folder a batch."""

    spark: SparkSession
    where: str
    count: int

    @classmethod
    def write(cls, x: DataFrame, targets: DataFrame, records: DataFrame, size: int, where: str | None = None) -> Batches:
        """Deals the records out in order of id, `size` a batch (what is left over makes none), and writes every table by batch, a file each.

        Features are shuffled once, by their record and then by its batch; a batch without features or targets has no folder for them."""
        spark = x.sparkSession
        where = where or params.scratch(spark, "batches")
        dealt = sparse_text.batches(records.select("record_id"), size, drop_partial=True).select("record_id", "batch_id")
        dealt.repartition("batch_id").write.partitionBy("batch_id").parquet(f"{where}/records")
        kept = spark.read.schema("record_id long, batch_id long").parquet(f"{where}/records")
        for name, rows in (("features", x.select("record_id", "f", "v")), ("targets", targets.select("record_id", "label"))):
            rows.join(kept, "record_id").repartition("batch_id").write.partitionBy("batch_id").parquet(f"{where}/{name}")
        count = kept.agg(F.max("batch_id")).first()[0]
        return cls(spark, where, 0 if count is None else count + 1)

    def table(self, name: str, batch: int, schema: str) -> DataFrame:
        fs, path = params.filesystem(self.spark, self.where)
        at = f"{self.where}/{name}/batch_id={batch}"
        return self.spark.read.schema(schema).parquet(at) if fs.exists(path(at)) else self.spark.createDataFrame([], schema)

    def read(self, batch: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(features, targets, records) of one batch."""
        return (
            self.table("features", batch, "record_id long, f long, v double"),
            self.table("targets", batch, "record_id long, label long"),
            self.table("records", batch, "record_id long"),
        )
