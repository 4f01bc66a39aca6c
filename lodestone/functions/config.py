"""Configuration: typed settings, key=value text, presets, schedules."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FAMILIES = ("dwta", "wta", "minhash", "srp")
MODES = {1: "threshold", 2: "random", 3: "topk", 4: "sampling"}


@dataclass(frozen=True)
class Config:
    """Settings of one network; list entries are by layer, sparsity has all training values, then all prediction values."""

    # The default workload.
    range_pow: tuple[int, ...] = (6, 18)
    k: tuple[int, ...] = (2, 6)
    l: tuple[int, ...] = (20, 50)  # noqa: E741
    sparsity: tuple[float, ...] = (1.0, 0.005, 1.0, 1.0)
    batch_size: int = 128
    rehash: int = 6400
    rebuild: int = 128000
    input_dim: int = 5000
    tot_records: int = 15539
    tot_records_test: int = 3809
    lr: float = 1e-4
    epoch: int = 10
    step_size: int = 1000
    sizes: tuple[int, ...] = (128, 3993)
    num_layer: int = 2
    train_data: str = ""
    test_data: str = ""
    weight: str = ""
    saved_weight: str = ""
    log_file: str = ""
    # engine choices
    family: str = "dwta"
    mode: int = 4
    fifo: bool = True
    adam: bool = True
    bits: int = 2
    # Iterations between two node permutations; below how many candidates sampling fills up, and to how many
    reshuffle: int = 6946
    enough: int = 1500
    fill: int = 1000
    # nodes or features along a tile of dense products; 0 makes them of rows
    tile: int = 1024
    warnings: tuple[str, ...] = field(default=(), compare=False)

    def validated(self) -> Config:
        if self.rehash < self.batch_size or self.rebuild < self.batch_size:
            raise ValueError("rehash and rebuild must be at least one batch")
        if len(self.sparsity) != 2 * self.num_layer:
            raise ValueError("sparsity needs a training and a prediction value for each layer")
        if not (len(self.sizes) == len(self.k) == len(self.l) == len(self.range_pow) == self.num_layer):
            raise ValueError("lists by layer must have num_layer entries")
        if self.family not in FAMILIES or self.mode not in MODES:
            raise ValueError("unknown hash family or mode")
        return self


#: The large preset's shape.
LARGE = Config(input_dim=203882, tot_records=1186239, tot_records_test=153025, sizes=(128, 13330))

# Names in configuration text and the fields they set.
KEYS = {
    "RangePow": "range_pow", "K": "k", "L": "l", "Sparsity": "sparsity", "Batchsize": "batch_size", "Rehash": "rehash", "Rebuild": "rebuild", "InputDim": "input_dim",
    "totRecords": "tot_records", "totRecordsTest": "tot_records_test", "Lr": "lr", "Epoch": "epoch", "Stepsize": "step_size", "sizesOfLayers": "sizes", "numLayer": "num_layer",
    "trainData": "train_data", "testData": "test_data", "weight": "weight", "savedweight": "saved_weight", "logFile": "log_file",
}


def parse(text: str, base: Config | None = None) -> Config:
    """key=value lines over a base: comments, blanks and lines under three characters are skipped, unknown keys warn, a scalar
    that does not parse keeps its old value, a list item that does not becomes 0, empty items are dropped."""
    now, warnings = base or Config(), []
    for line in text.splitlines():
        line = line.strip()
        if len(line) < 3 or line.startswith("#"):
            continue
        key, eq, value = line.partition("=")
        name = KEYS.get(key.strip())
        if not eq or name is None:
            warnings.append(line)
            continue
        old = getattr(now, name)
        value = value.strip()
        if isinstance(old, tuple):
            kind = float if name == "sparsity" else int
            now = replace(now, **{name: tuple(_number(kind, x.strip(), kind(0)) for x in value.split(",") if x.strip())})
        elif isinstance(old, str):
            now = replace(now, **{name: value})
        else:
            now = replace(now, **{name: _number(type(old), value, old)})
    return replace(now, warnings=tuple(warnings))


def _number(kind: type, text: str, otherwise: float) -> float:
    try:
        return kind(text)
    except ValueError:
        return otherwise


def rows(lines: DataFrame) -> DataFrame:
    """(key, value) of a text table of configuration lines (column value); the last of a key's lines wins by line_no."""
    line = F.trim("value")
    kept = lines.select("line_no", line.alias("line")).filter((F.length("line") >= 3) & ~F.startswith("line", F.lit("#")) & F.contains("line", F.lit("=")))
    pair = kept.select("line_no", F.trim(F.regexp_extract("line", "^([^=]*)=", 1)).alias("key"), F.trim(F.regexp_extract("line", "^[^=]*=(.*)$", 1)).alias("value"))
    return pair.filter(F.col("key").isin(*KEYS)).groupBy("key").agg(F.max_by("value", "line_no").alias("value"))


def schedule(spark: SparkSession, iterations: int, per_epoch: int, c: Config) -> DataFrame:
    """(iter, epoch, rehash, rebuild, evaluate, reshuffle) of each iteration."""
    every, phase = c.rehash // c.batch_size, c.rehash // c.batch_size - 1
    i = F.col("id")
    return spark.range(iterations).select(
        i.alias("iter"),
        F.floor(i / per_epoch).alias("epoch"),
        (i % every == phase).alias("rehash"),
        (i % (c.rebuild // c.batch_size) == phase).alias("rebuild"),
        (i % c.step_size == 0).alias("evaluate"),
        (i % c.reshuffle == c.reshuffle - 1).alias("reshuffle"),
    )


def worker(argv0: str) -> int:
    """The worker number of a process name w<N>; other names are refused."""
    m = re.fullmatch(r"w(\d+)", argv0)
    if not m:
        raise ValueError(f"not a worker name: {argv0}")
    return int(m[1]) - 1


def worker_of(name: Column) -> Column:
    """The same of a column of names; null for others."""
    return (F.nullif(F.regexp_extract(name, "^w([0-9]+)$", 1), F.lit("")).cast("long") - 1).alias("worker")


def command_line(argv: list[str], base: Config | None = None) -> tuple[int, Config]:
    """The worker number and the configuration of `w<N> test_path train_path`; paths given override those of the configuration."""
    c = base or Config()
    given = {name: path for name, path in zip(("test_data", "train_data"), argv[1:3], strict=False)}
    return worker(argv[0]), replace(c, **given)


def ranges(size: int, workers: int, div: int) -> list[tuple[int, int]]:
    """Contiguous equal ranges of an array, the last one with what is left; blocks are multiples of div."""
    block = math.ceil(math.ceil(size / div) / workers) * div
    out = [(w * block, min(size, (w + 1) * block)) for w in range(workers)]
    if any(b <= a for a, b in out):
        raise ValueError("a worker would have no elements")
    return out

