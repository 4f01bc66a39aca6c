"""NPY and NPZ files as data sources: spark.read.format("npy" | "npz"), and writers."""

from __future__ import annotations

import glob
import io
import os
import re
import shutil
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: data are the values as doubles (real and imaginary parts of complex ones in turn), raw their exact bytes in C order
SCHEMA = "name string, shape array<long>, dtype string, fortran boolean, data array<double>, raw binary"


def view(raw: bytes, dtype: str, shape: list[int]) -> np.ndarray:
    """The array of exact bytes."""
    return np.frombuffer(raw, np.dtype(dtype)).reshape(shape)


def array_of(row: object) -> np.ndarray:
    """The array of a row: of its raw bytes where it has them, else of its doubles."""
    dtype = np.dtype(row["dtype"])
    if "raw" in row and row["raw"] is not None:
        return view(bytes(row["raw"]), row["dtype"], row["shape"])
    flat = np.array(row["data"], np.float64)
    if dtype.kind == "c":
        flat = flat[0::2] + 1j * flat[1::2]
    return flat.reshape(row["shape"]).astype(dtype)


def load(path: str, variable: str | None = None) -> dict[str, np.ndarray]:
    """The arrays of an NPY file (under its file's name) or an NPZ archive; members that are not .npy are skipped."""
    if path.endswith(".npy"):
        return {os.path.basename(path)[:-4]: np.load(path, allow_pickle=False)}
    with zipfile.ZipFile(path) as z:
        names = [n for n in z.namelist() if n.endswith(".npy")]
        if variable is not None:
            if f"{variable}.npy" not in names:
                raise FileNotFoundError(f"{path}: no variable {variable}")
            names = [f"{variable}.npy"]
        return {n[:-4]: np.load(io.BytesIO(z.read(n)), allow_pickle=False) for n in names}


def save_npy(path: str, a: np.ndarray, append: bool = False) -> None:
    """Writes an array; append adds to the first dimension of a C-ordered file of the same type and other dimensions."""
    if append and os.path.exists(path):
        old = np.load(path, allow_pickle=False)
        if np.isfortran(old) and old.ndim > 1 or old.dtype != a.dtype or old.ndim != a.ndim or old.shape[1:] != a.shape[1:]:
            raise ValueError("append needs the same order, type, rank and trailing dimensions")
        a = np.concatenate([old, a])
    np.save(path, np.ascontiguousarray(a), allow_pickle=False)


def put_member(z: zipfile.ZipFile, name: str, a: np.ndarray) -> None:
    """Writes an array as a member of an open archive."""
    raw = io.BytesIO()
    np.save(raw, np.ascontiguousarray(a), allow_pickle=False)
    z.writestr(f"{name}.npy", raw.getvalue())


def save_npz(path: str, name: str, a: np.ndarray, append: bool = False, compressed: bool = False) -> None:
    """Writes an array as a member of an archive, which append keeps. Each call reads the directory of the archive and writes it anew, so
    many members are put by put_member() into one that stays open."""
    with zipfile.ZipFile(path, "a" if append else "w", zipfile.ZIP_DEFLATED if compressed else zipfile.ZIP_STORED) as z:
        put_member(z, name, a)


def header(a: np.ndarray) -> bytes:
    """The version 1.0 header of an array."""
    out = io.BytesIO()
    np.lib.format.write_array_header_1_0(out, np.lib.format.header_data_from_array_1_0(a))
    return out.getvalue()


def local(path: str) -> str:
    """The path of a mounted folder, without a scheme."""
    return re.sub(r"^file:(//)?(?=/)", "", path)


#: bytes and files of a partition, at most, but for one array that is larger; bytes and arrays of a batch
SPLIT, FILES, BATCH, ROWS = 32 << 20, 4096, 4 << 20, 1024


@dataclass
class _Files(InputPartition):
    """Files of a folder, or members `start` to `stop` of one archive."""

    folder: str
    names: list[str]
    variable: str | None
    start: int = 0
    stop: int | None = None


def packed(sizes: list[int], items: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items, of SPLIT bytes and so many items at most."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and (total + size > SPLIT or i - start >= items):
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def members(z: zipfile.ZipFile, path: str, variable: str | None) -> list[zipfile.ZipInfo]:
    """The arrays of an archive, or the one asked for; other members are skipped. Of members with one name the last counts, as in load()."""
    found = {i.filename: i for i in z.infolist() if i.filename.endswith(".npy")}
    if variable is None:
        return list(found.values())
    if f"{variable}.npy" not in found:
        raise FileNotFoundError(f"{path}: no variable {variable}")
    return [found[f"{variable}.npy"]]


class _Reader(DataSourceReader):
    """Small files share a partition, and a large archive has several, so neither tasks nor their memory follow the number of files."""

    def __init__(self, options: dict, suffix: str) -> None:
        self.path, self.variable, self.suffix = local(options["path"]), options.get("variable"), suffix

    def partitions(self) -> list[InputPartition]:
        if os.path.isdir(self.path):
            with os.scandir(self.path) as there:
                sizes = sorted((f.path, f.stat().st_size) for f in there if f.name.endswith(self.suffix) and not f.name.startswith("."))
        else:
            sizes = sorted((f, os.path.getsize(f)) for f in glob.glob(self.path))
        if not sizes:
            raise FileNotFoundError(self.path)
        out: list[InputPartition] = []
        folders: dict[str, list[tuple[str, int]]] = {}
        for path, size in sizes:
            folder, name = os.path.split(path)
            if path.endswith(".npy"):
                folders.setdefault(folder, []).append((name, size))
                continue
            with zipfile.ZipFile(path) as z:
                found = [i.file_size for i in members(z, path, self.variable)]
            out += [_Files(folder, [name], self.variable, a, b) for a, b in packed(found, len(found))]  # by bytes alone: each range reads the archive's directory again
        for folder, files in folders.items():
            out += [_Files(folder, [n for n, _ in files[a:b]], self.variable) for a, b in packed([size for _, size in files], FILES)]
        return out or [_Files("", [], None)]  # archives without an array

    def arrays(self, part: _Files) -> Iterator[tuple[str, np.ndarray]]:
        for file in part.names:
            path = os.path.join(part.folder, file)
            if path.endswith(".npy"):
                yield file[:-4], np.load(path, allow_pickle=False)
                continue
            with zipfile.ZipFile(path) as z:
                for info in members(z, path, part.variable)[part.start : part.stop]:
                    yield info.filename[:-4], np.load(io.BytesIO(z.read(info)), allow_pickle=False)

    def read(self, part: _Files) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, np.ndarray]] = []
        size = 0
        for name, a in self.arrays(part):
            held.append((name, a))
            size += a.nbytes
            if size >= BATCH or len(held) >= ROWS:
                yield rows_of(held)
                held, size = [], 0
        if held:
            yield rows_of(held)


def rows_of(held: list[tuple[str, np.ndarray]]) -> pa.RecordBatch:
    """A row of SCHEMA for each named array."""
    flats = [np.asarray(a.ravel(order="C")) for _, a in held]
    raw = pa.array([f.tobytes() for f in flats], pa.binary())
    numbers = [(np.column_stack([f.real, f.imag]).ravel() if np.iscomplexobj(f) else f).astype(np.float64) for f in flats]
    offsets = pa.array(np.cumsum([0, *map(len, numbers)]), pa.int32())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([n for n, _ in held], pa.string()),
            pa.array([list(a.shape) for _, a in held], pa.list_(pa.int64())),
            pa.array([a.dtype.str for _, a in held], pa.string()),
            pa.array([bool(np.isfortran(a)) for _, a in held], pa.bool_()),
            pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(numbers), pa.float64())),
            raw,
        ],
        names=["name", "shape", "dtype", "fortran", "data", "raw"],
    )


@dataclass
class _Written(WriterCommitMessage):
    """The folder of one task's drafts, whose names are those of the files after the commit."""

    folder: str


class _Writer(DataSourceWriter):
    """One file a row, named by it; an archive per task for npz, which stays open while its rows come. Tasks write in hidden folders of their
    own, out of which the commit moves the files, so neither a task run again nor one that failed leaves a trace."""

    def __init__(self, options: dict, suffix: str, overwrite: bool) -> None:
        self.path, self.suffix, self.overwrite = local(options["path"]), suffix, overwrite
        self.compressed = str(options.get("compressed", "false")).lower() == "true"
        os.makedirs(self.path, exist_ok=True)

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        task, mine = TaskContext.get().partitionId(), uuid.uuid4().hex
        folder = os.path.join(self.path, f".{mine}.draft")
        os.makedirs(folder)
        archive = None
        try:
            for r in rows:
                r = r.asDict()
                if self.suffix == ".npy":
                    with open(os.path.join(folder, f"{r['name']}.npy"), "wb") as f:
                        np.save(f, array_of(r), allow_pickle=False)
                else:
                    if archive is None:
                        archive = zipfile.ZipFile(os.path.join(folder, f"part-{task:05d}-{mine}.npz"), "w", zipfile.ZIP_DEFLATED if self.compressed else zipfile.ZIP_STORED)
                    put_member(archive, r["name"], array_of(r))
        except BaseException:
            if archive is not None:
                archive.close()
            shutil.rmtree(folder, ignore_errors=True)
            raise
        if archive is not None:
            archive.close()
        return _Written(folder)

    def commit(self, messages: list) -> None:
        if self.overwrite:
            for f in glob.glob(os.path.join(glob.escape(self.path), f"*{self.suffix}")):
                os.remove(f)
        for m in messages:
            for name in os.listdir(m.folder) if m else ():
                os.replace(os.path.join(m.folder, name), os.path.join(self.path, name))
            if m:
                os.rmdir(m.folder)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m:
                shutil.rmtree(m.folder, ignore_errors=True)


class NpyDataSource(DataSource):
    suffix = ".npy"

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options, self.suffix)

    def writer(self, schema: object, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, self.suffix, overwrite)


class NpzDataSource(NpyDataSource):
    suffix = ".npz"

    @classmethod
    def name(cls) -> str:
        return "npz"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpyDataSource)
    spark.dataSource.register(NpzDataSource)
