"""Parameter tables: versions that are swapped in whole, key-value upserts, arrays in blocks."""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def block_of(idx: Column, block: int) -> Column:
    """The block of an array element."""
    return F.floor(idx / block)


def block_key(name: Column, block: Column, size: int, width: int) -> Column:
    """name_start_end of a block."""
    return F.concat_ws("_", name, (block * width).cast("string"), F.least((block + 1) * width, F.lit(size)).cast("string"))


def array(spark: SparkSession, size: int, value: Column, offset: int = 0) -> DataFrame:
    """(idx, val) of an array filled by an expression over idx."""
    return spark.range(offset, offset + size).select(F.col("id").alias("idx"), value.alias("val"))


def updated(a: DataFrame, changes: DataFrame) -> DataFrame:
    """The array with changed elements (idx, val) put in place."""
    new = changes.select("idx", F.col("val").alias("__new"))
    return a.join(new, "idx", "left").select("idx", F.coalesce("__new", "val").alias("val"))


def shuffled(a: DataFrame, seed: int) -> DataFrame:
    """(pos, idx, val): the elements in a seeded order. Positions come from ranges of the sort key, so no task sorts the whole array."""
    key = (F.col("idx") * F.lit(2654435761) + F.lit(seed)) % F.lit(2147483647)
    n = 256
    keyed = a.withColumn("__k", key).withColumn("__r", F.floor(F.col("__k") / F.lit(2147483647 // n + 1)))
    from pyspark.sql.window import Window

    sums = keyed.groupBy("__r").agg(F.count("*").alias("__n"))
    start = sums.withColumn("__start", F.coalesce(F.sum("__n").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")  # 256 rows
    inner = F.row_number().over(Window.partitionBy("__r").orderBy("__k", "idx")) - 1
    return keyed.withColumn("__in", inner).join(F.broadcast(start), "__r").select((F.col("__start") + F.col("__in")).cast("long").alias("pos"), "idx", "val")


def filesystem(spark: SparkSession, where: str) -> tuple:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder that spark.checkpoint.dir names; where none is set, a local session has one of its own."""
    ctx = spark.sparkContext
    top = ctx.getConf().get("spark.checkpoint.dir") or ctx.getCheckpointDir()
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", ctx.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.mkdtemp(prefix="lodestone-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, where: str) -> None:
    fs, path = filesystem(spark, where)
    fs.delete(path(where), True)


class Conflict(RuntimeError):
    """Another writer's version came into force after the one that a commit was based on."""


class Store:
    """Versioned tables in a folder: a version is written whole, then the pointer is moved to it; readers see one version.

    A version's data lie in a folder of their own, and its pointer is a file whose name is its number: putting it there fails if it exists,
    so of two writers that put the same number one is refused. A commit that says which version it is `based` on takes the number after it, and
    raises Conflict if that is taken: nothing that came into force meanwhile is lost. One that doesn't say takes the next free number. The
    pointer holds what the writer says about the version, as JSON. Folders that were refused are removed.

    The pointer is put by a hard link on local disks and by a rename that doesn't overwrite elsewhere; on stores whose rename is a copy
    that isn't atomic there."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _numbers(self, name: str, kind: str) -> list[int]:
        fs, path = filesystem(self.spark, self.root)
        return [int(f.getPath().getName().rpartition("-")[2]) for f in fs.globStatus(path(f"{self.root}/{name}/{kind}-*")) or []]

    def version(self, name: str) -> int:
        return max(self._numbers(name, "CURRENT"), default=-1)

    def _free(self, name: str) -> int:
        return max([*self._numbers(name, "CLAIM"), *self._numbers(name, "CURRENT")], default=-1) + 1

    def _put(self, name: str, v: int, text: str) -> bool:
        """Whether the pointer to version v was put by this call."""
        fs, path = filesystem(self.spark, self.root)
        to, draft = path(f"{self.root}/{name}/CURRENT-{v}"), path(f"{self.root}/{name}/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(text.encode())
        out.close()
        try:
            if fs.getUri().getScheme() != "file":
                return not fs.exists(to) and fs.rename(draft, to)
            try:
                os.link(*(fs.makeQualified(x).toUri().getPath() for x in (draft, to)))
            except FileExistsError:
                return False
            return True
        finally:
            if fs.exists(draft):
                fs.delete(draft, False)

    def _point(self, name: str, at: str, about: dict, based: int | None) -> int:
        v = self._free(name) if based is None else based + 1
        if based is not None and self.version(name) > based:
            raise Conflict(f"{name}: version {self.version(name)} came after {based}")
        while not self._put(name, v, json.dumps({"at": at, "about": about})):
            if based is not None:
                raise Conflict(f"{name}: version {v} came after {based}")
            v = max(v, self.version(name)) + 1
        return v

    def commit(self, name: str, df: DataFrame, by: tuple[str, ...] = (), about: dict | None = None, based: int | None = None) -> int:
        """Writes the next version and points to it; a failure before the last step leaves the old version in force."""
        at = f"data-{uuid.uuid4().hex}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.root}/{name}/{at}")
        try:
            return self._point(name, at, about or {}, based)
        except Conflict:
            remove(self.spark, f"{self.root}/{name}/{at}")
            raise

    def _pointer(self, name: str, version: int | None) -> dict:
        v = self.version(name) if version is None else version
        if v < 0:
            raise FileNotFoundError(f"{self.root}/{name}")
        fs, path = filesystem(self.spark, self.root)
        held = fs.open(path(f"{self.root}/{name}/CURRENT-{v}"))
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(held, "UTF-8")
        held.close()
        return json.loads(text)

    def about(self, name: str, version: int | None = None) -> dict:
        return self._pointer(name, version)["about"]

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/{self._pointer(name, version)['at']}")

    def upsert(self, name: str, rows: DataFrame, key: str = "key", based: int | None = None, tries: int = 10) -> int:
        """Puts rows over those of equal key; of rows with one key the last by ts, where there is such a column, then by their other columns.

        With `based`, the rows were made from that version and are refused if another one is in force. Without, they are put over whichever is: a
        commit that comes second is made again from the version that came first."""
        order = [F.col(c) for c in (["ts"] if "ts" in rows.columns else []) + sorted(c for c in rows.columns if c not in (key, "ts"))]
        new = rows.groupBy(key).agg(F.max(F.struct(*order, *[F.col(c).alias(f"__{i}") for i, c in enumerate(rows.columns)])).alias("__row")).select(*[F.col("__row")[f"__{i}"].alias(c) for i, c in enumerate(rows.columns)])
        for left in range(tries, 0, -1):
            now = self.version(name) if based is None else based
            whole = new if now < 0 else self.read(name, now).join(new.select(key), key, "left_anti").unionByName(new)
            try:
                return self.commit(name, whole, based=now)
            except Conflict:
                if based is not None or left == 1:
                    raise
        raise ValueError("tries must be at least 1")

    # --- arrays in blocks: a version's pointer says which version holds each block

    def put_array(self, name: str, a: DataFrame, block: int) -> int:
        """Commits an array (idx, val) in blocks of `block` elements."""
        at = f"data-{uuid.uuid4().hex}"
        a.withColumn("block", block_of(F.col("idx"), block)).repartition("block").write.mode("overwrite").partitionBy("block").parquet(f"{self.root}/{name}/{at}")
        fs, path = filesystem(self.spark, self.root)
        found = [int(f.getPath().getName().rpartition("=")[2]) for f in fs.globStatus(path(f"{self.root}/{name}/{at}/block=*"))]
        v = self._free(name)
        while not self._put(name, v, json.dumps({"at": at, "about": {"block": block, "of": {b: v for b in found}}, "in": {b: at for b in found}})):
            v += 1
        return v

    def block(self, name: str, number: int, version: int | None = None) -> DataFrame:
        """One block's (idx, val); no other block's file is read."""
        return self.spark.read.parquet(f"{self.root}/{name}/{self._pointer(name, version)['in'][str(number)]}/block={number}")

    def put_block(self, name: str, number: int, rows: DataFrame, based: int | None = None, tries: int = 10) -> int:
        """Writes one block back as a new version; the others stay where they are. With `based`, it is refused if that version is no longer
        in force; without, another writer's block of the meantime is kept beside it."""
        at = f"data-{uuid.uuid4().hex}"
        rows.select("idx", "val").write.mode("overwrite").parquet(f"{self.root}/{name}/{at}/block={number}")
        for _ in range(tries):
            now = self.version(name)
            if based is not None and now != based:
                break
            old, v = self._pointer(name, now), now + 1
            old["about"]["of"][str(number)], old["in"][str(number)] = v, at
            if self._put(name, v, json.dumps(old)):
                return v
        remove(self.spark, f"{self.root}/{name}/{at}")
        raise Conflict(f"{name}: block {number} was not put, version {self.version(name)} is in force")

    def array(self, name: str, version: int | None = None) -> DataFrame:
        """All blocks' (idx, val)."""
        return self.spark.read.parquet(*[f"{self.root}/{name}/{at}/block={b}" for b, at in self._pointer(name, version)["in"].items()]).select("idx", "val")
