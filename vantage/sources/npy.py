"""A3: array containers (``.npy``) as a Spark data source.

``spark.read.format("npy").load(path)`` (after ``register``) gives one row per
row of every array: ``file, row_id, embedding``.  The header alone is read to
plan: it says how many rows there are and where they lie, so a file becomes
several partitions of ``rowsPerPartition`` rows, each read on its own.  Arrays
in C order are read as one run of bytes per partition, those in Fortran order
as one run per column.  Files are opened through Arrow's file systems, so a
path may be local, shared or a URL they know.
"""

from __future__ import annotations

import ast
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vantage.session import ship_package

#: Numbers of one batch of rows.
BATCH_NUMBERS = 1 << 20


def store(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def files(path: str) -> list[str]:
    """The ``.npy`` files that a path names: itself, or those of a folder, in order of name."""
    fs, inner = store(path)
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [path]
    held = fs.get_file_info(pafs.FileSelector(inner))
    head = path.rstrip("/")
    return sorted(f"{head}/{f.base_name}" for f in held if f.type == pafs.FileType.File and f.base_name.endswith(".npy"))


@dataclass(frozen=True)
class Header:
    dtype: str
    fortran: bool
    shape: tuple[int, ...]
    offset: int

    @property
    def rows(self) -> int:
        return self.shape[0] if self.shape else 1

    @property
    def width(self) -> int:
        return int(np.prod(self.shape[1:])) if len(self.shape) > 1 else 1


def header(path: str) -> Header:
    """Type, order, shape and start of the data of an array file; only arrays of floating-point numbers or integers."""
    fs, inner = store(path)
    with fs.open_input_file(inner) as f:
        start = f.read(12)
        if start[:6] != b"\x93NUMPY":
            raise ValueError(f"{path} is no array file")
        size, at = (struct.unpack("<H", start[8:10])[0], 10) if start[6] == 1 else (struct.unpack("<I", start[8:12])[0], 12)
        f.seek(at)
        said = ast.literal_eval(f.read(size).decode("utf-8" if start[6] >= 3 else "latin1"))
    if np.dtype(said["descr"]).kind not in "fiu":
        raise ValueError(f"{path} holds {said['descr']}, not numbers")
    return Header(np.dtype(said["descr"]).str, bool(said["fortran_order"]) and len(said["shape"]) > 1, tuple(said["shape"]), at + size)


def rows(path: str, head: Header, first: int, last: int) -> np.ndarray:
    """Rows ``first .. last`` as a matrix of doubles; further dimensions are laid out one after the other."""
    fs, inner = store(path)
    kind = np.dtype(head.dtype)
    n, width = last - first, head.width
    with fs.open_input_file(inner) as f:
        if not head.fortran:
            f.seek(head.offset + first * width * kind.itemsize)
            return np.frombuffer(f.read(n * width * kind.itemsize), kind).reshape(n, width).astype(np.float64)
        out = np.empty((n, *head.shape[1:]))
        for at in np.ndindex(*head.shape[1:]):  # the first index runs fastest: a column of rows is one run
            column = int(np.ravel_multi_index(at, head.shape[1:], order="F"))
            f.seek(head.offset + (column * head.rows + first) * kind.itemsize)
            out[(slice(None), *at)] = np.frombuffer(f.read(n * kind.itemsize), kind)
    return out.reshape(n, width)


@dataclass
class Rows(InputPartition):
    path: str
    head: Header
    first: int
    last: int


class NpyReader(DataSourceReader):
    def __init__(self, path: str, step: int) -> None:
        self.path, self.step = path, step

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in files(self.path):
            head = header(path)
            out += [Rows(path, head, a, min(a + self.step, head.rows)) for a in range(0, head.rows, self.step)]
        return out

    def read(self, partition: Rows | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        p, width = partition, partition.head.width
        step = max(1, BATCH_NUMBERS // max(width, 1))
        for a in range(p.first, p.last, step):
            b = min(a + step, p.last)
            x = rows(p.path, p.head, a, b)
            values = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * width, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([p.path.rsplit("/", 1)[-1]] * (b - a)), pa.array(np.arange(a, b), pa.int64()), values], names=["file", "row_id", "embedding"])


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "file string, row_id bigint, embedding array<double>"

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options["path"], int(self.options.get("rowsPerPartition", 100_000)))


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(NpySource)
