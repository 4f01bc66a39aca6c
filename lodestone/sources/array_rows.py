"""Rows of NPY and NPZ arrays: spark.read.format("npy_rows" | "npz_rows"), and a writer of one large array.

A row is an entry of an array's first dimension. The scan plans partitions of at most `split` bytes (an option) of consecutive rows, from the
headers alone, and each task reads its rows' bytes; conditions on `name` and `row` are pushed down, so files and ranges they leave out are not
read. Members of compressed archives can't be entered in the middle, so each is one partition, which decompresses up to its last row.

The writer makes one .npy file of rows (row, data, raw) from all tasks: the driver writes the header and the file's full size under a draft
name, each task puts its rows at their places, and the commit, which checks that there are as many as the shape says, gives the file
its name. A task run again puts the same bytes in the same places. Like the readers, it needs a folder that all executors mount."""

from __future__ import annotations

import glob
import math
import os
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from lodestone.sources.arrays import local

#: dtype is the array's, as its header has it; data are a row's values as doubles (real and imaginary parts of complex ones in turn), raw their exact bytes in C order
SCHEMA = "name string, row long, data array<double>, raw binary, dtype string"
SPLIT, BATCH = 32 << 20, 4 << 20


@dataclass
class Range(InputPartition):
    """Rows start to stop of an array; offset is where its data begin in the file, None in a compressed member."""

    path: str
    member: str | None
    name: str
    dtype: str
    shape: tuple[int, ...]
    fortran: bool
    offset: int | None
    start: int
    stop: int

    def __repr__(self) -> str:
        return f"{self.name}[{self.start}:{self.stop}]"


def head(f: object) -> tuple[tuple[int, ...], bool, np.dtype]:
    """Shape, order and type from an NPY header; the file then stands where the data begin."""
    version = np.lib.format.read_magic(f)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, dtype = read(f)
    if dtype.hasobject:
        raise ValueError("arrays of objects are not read")
    return shape, fortran, dtype


def data_start(path: str, info: zipfile.ZipInfo) -> int:
    """Where a stored member's bytes begin: after its own header, whose name and extra field may differ from the directory's."""
    with open(path, "rb") as f:
        f.seek(info.header_offset)
        fixed = f.read(30)
    return info.header_offset + 30 + int.from_bytes(fixed[26:28], "little") + int.from_bytes(fixed[28:30], "little")


class _Reader(DataSourceReader):
    def __init__(self, options: dict, suffix: str) -> None:
        self.path, self.suffix, self.split = local(options["path"]), suffix, int(options.get("split", SPLIT))
        self.names: set[str] | None = None
        self.low, self.high = 0, 1 << 62

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            of = getattr(f, "attribute", None)
            value = getattr(f, "value", None)
            if of == ("name",) and isinstance(f, EqualTo | In):
                names = {value} if isinstance(f, EqualTo) else set(value)
                self.names = names if self.names is None else self.names & names
            elif of == ("row",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.low = max(self.low, value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    self.high = min(self.high, value + (not isinstance(f, LessThan)))
            else:
                yield f

    def arrays(self, path: str) -> Iterator[tuple]:
        """(member, name, shape, order, type, offset) of the arrays of a file that are asked for."""
        if self.suffix == ".npy":
            name = os.path.basename(path)[:-4]
            if self.names is None or name in self.names:
                with open(path, "rb") as f:
                    yield None, name, *head(f), f.tell()
            return
        with zipfile.ZipFile(path) as z:
            for info in z.infolist():
                name = info.filename[:-4]
                if info.filename.endswith(".npy") and (self.names is None or name in self.names):
                    with z.open(info) as f:
                        about = head(f)
                        begins = f.tell()
                    stored = info.compress_type == zipfile.ZIP_STORED
                    yield info.filename, name, *about, data_start(path, info) + begins if stored else None

    def partitions(self) -> list[InputPartition]:
        files = sorted(glob.glob(os.path.join(glob.escape(self.path), f"*{self.suffix}"))) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        if not files:
            raise FileNotFoundError(self.path)
        out: list[InputPartition] = []
        for path in files:
            for member, name, shape, fortran, dtype, offset in self.arrays(path):
                rows = shape[0] if shape else 1
                a, b = max(0, self.low), min(rows, self.high)
                size = max(1, dtype.itemsize * math.prod(shape[1:]))
                step = max(1, self.split // size) if offset is not None else max(1, rows)
                out += [Range(path, member, name, dtype.str, tuple(shape), fortran, offset, s, min(s + step, b)) for s in range(a, b, step)]
        return out or [Range("", None, "", "<f8", (0,), False, None, 0, 0)]

    def blocks(self, part: Range) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, rows) in blocks of bounded size."""
        dtype, rest = np.dtype(part.dtype), part.shape[1:]
        size = dtype.itemsize * math.prod(rest)
        step = max(1, BATCH // max(1, size))
        if part.offset is not None:
            if size and part.stop > part.start:
                whole = np.memmap(part.path, dtype, "r", part.offset, part.shape or (1,), "F" if part.fortran else "C")
            else:
                whole = np.empty(part.shape or (1,), dtype)
            for s in range(part.start, part.stop, step):
                yield s, np.ascontiguousarray(whole[s : min(s + step, part.stop)])
            return
        with zipfile.ZipFile(part.path) as z, z.open(part.member) as f:
            head(f)
            if part.fortran and len(part.shape) > 1:  # its rows lie all over the member
                whole = np.frombuffer(f.read(), dtype).reshape(part.shape, order="F")
                yield part.start, np.ascontiguousarray(whole[part.start : part.stop])
                return
            for s in range(0, part.stop, step):
                n = min(s + step, part.stop) - s
                block = np.frombuffer(f.read(n * size), dtype).reshape(n, *rest)
                if s + n > part.start:
                    yield max(s, part.start), block[max(0, part.start - s) :]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        for first, block in self.blocks(part) if part.stop > part.start else ():
            n = len(block)
            flat = block.reshape(n, -1)
            raw = [r.tobytes() for r in flat]
            if np.iscomplexobj(flat):
                flat = np.stack([flat.real, flat.imag], axis=2).reshape(n, -1)
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * flat.shape[1], pa.int32())
            data = pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.float64).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([part.name] * n), pa.array(np.arange(first, first + n)), data, pa.array(raw, pa.binary()), pa.array([part.dtype] * n)], names=["name", "row", "data", "raw", "dtype"])


@dataclass
class _Put(WriterCommitMessage):
    rows: int


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite = local(options["path"]), overwrite
        self.shape, self.dtype = tuple(int(x) for x in options["shape"].split(",")), np.dtype(options.get("dtype", "<f8"))
        if not self.path.endswith(".npy"):
            raise ValueError("the path must be that of an .npy file")
        if os.path.exists(self.path) and not overwrite:
            raise FileExistsError(self.path)
        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        self.draft = f"{self.path}.{uuid.uuid4().hex}.draft"
        with open(self.draft, "wb") as f:
            np.lib.format.write_array_header_1_0(f, {"descr": self.dtype.str, "fortran_order": False, "shape": self.shape})
            self.begins = f.tell()
            f.truncate(self.begins + self.dtype.itemsize * math.prod(self.shape))

    def write(self, rows: Iterator) -> WriterCommitMessage:
        size, n = self.dtype.itemsize * math.prod(self.shape[1:]), 0
        with open(self.draft, "r+b", buffering=1 << 20) as f:
            for r in rows:
                r = r.asDict()
                raw = bytes(r["raw"]) if r.get("raw") is not None else np.array(r["data"], np.float64).astype(self.dtype).tobytes()
                if len(raw) != size or not 0 <= r["row"] < self.shape[0]:
                    raise ValueError(f"row {r['row']} does not fit the shape")
                f.seek(self.begins + r["row"] * size)
                f.write(raw)
                n += 1
        return _Put(n)

    def commit(self, messages: list) -> None:
        n = sum(m.rows for m in messages if m)
        if n != self.shape[0]:
            os.remove(self.draft)
            raise ValueError(f"{n} rows were written of {self.shape[0]}")
        os.replace(self.draft, self.path)

    def abort(self, messages: list) -> None:
        if os.path.exists(self.draft):
            os.remove(self.draft)


class NpyRows(DataSource):
    suffix = ".npy"

    @classmethod
    def name(cls) -> str:
        return "npy_rows"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options, self.suffix)

    def writer(self, schema: object, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite)


class NpzRows(NpyRows):
    suffix = ".npz"

    @classmethod
    def name(cls) -> str:
        return "npz_rows"

    def writer(self, schema: object, overwrite: bool) -> DataSourceWriter:
        raise ValueError("archives are written by the npz source")


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NpyRows)
    spark.dataSource.register(NpzRows)
