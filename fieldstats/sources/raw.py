"""Headerless row-major binary files of numbers, read and written by byte ranges.

A data source cuts files into ranges of whole rows, one task each, whatever the
size of a file.  Row ids count through the files in the order of their paths, so
they are global and need no shuffle.  A second path names files with one more column, read
in step with the first.  The writer leaves one file a partition; names keep the partitions' order,
so that files read back give the order they were written in.

Paths go through pyarrow's file systems (local and shared folders, and stores
given as a URI), as executors read them themselves.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

NAME = "raw_array"
BATCH_ROWS = 65_536


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files(path: str) -> list[tuple[str, int]]:
    """Path and bytes of a file, or of the files of a folder by name; names with a leading _ or . are left out."""
    system, at = opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [(path, info.size)]
    prefix = path[: len(path) - len(at)] if path.endswith(at) else path.split("://")[0] + "://"
    held = [i for i in system.get_file_info(fs.FileSelector(at)) if i.is_file and i.base_name[0] not in "_."]
    return [(prefix + i.path, i.size) for i in sorted(held, key=lambda i: i.path)]


def rows_of(path: str, width: int) -> list[tuple[str, int]]:
    """Files and their numbers of rows of `width` bytes."""
    out = []
    for name, size in files(path):
        if size % width:
            raise ValueError(f"{name} does not hold rows of {width} bytes")
        out.append((name, size // width))
    return out


@dataclass
class Range(InputPartition):
    """Rows [start, end) over all files, ids from `start`."""

    start: int
    end: int


class RawReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.columns, self.dtype = int(options["columns"]), np.dtype(options.get("dtype", "<f8"))
        self.step = int(options.get("slice", 500_000))
        if self.columns < 1 or self.step < 1:
            raise ValueError("columns and slice must be positive")
        self.tables = [(rows_of(options["path"], self.columns * self.dtype.itemsize), self.columns)]
        if "beside" in options:
            self.tables.append((rows_of(options["beside"], self.dtype.itemsize), 1))
        totals = {sum(n for _, n in table) for table, _ in self.tables}
        if len(totals) > 1:
            raise ValueError("both paths must hold the same number of rows")
        self.total = totals.pop()

    def partitions(self) -> Sequence[InputPartition]:
        return [Range(start, min(start + self.step, self.total)) for start in range(0, self.total, self.step)] or [Range(0, 0)]

    def _read(self, table: list[tuple[str, int]], width: int, start: int, end: int) -> np.ndarray:
        """Rows [start, end) of a list of files as an array."""
        parts, at = [np.zeros((0, width), self.dtype)], 0
        for name, n in table:
            a, b = max(start, at), min(end, at + n)
            if a < b:
                system, path = opened(name)
                with system.open_input_file(path) as source:
                    size = width * self.dtype.itemsize
                    parts.append(np.frombuffer(source.read_at((b - a) * size, (a - at) * size), self.dtype).reshape(-1, width))
            at += n
        return np.concatenate(parts)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        for start in range(partition.start, partition.end, BATCH_ROWS):
            end = min(start + BATCH_ROWS, partition.end)
            columns = [c for table, width in self.tables for c in self._read(table, width, start, end).astype(float).T]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, end)), *map(pa.array, columns)], ["id", *(f"c{i}" for i in range(len(columns)))])


@dataclass
class Written(WriterCommitMessage):
    partition: int
    name: str
    rows: int


class RawWriter(DataSourceArrowWriter):
    """Each task writes a hidden file of its own; commit gives the files their final names, abort removes them."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.dtype, self.overwrite = options["path"], np.dtype(options.get("dtype", "<f8")), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, path = opened(self.path)
        system.create_dir(path)
        name, rows = f"{path}/_{uuid.uuid4().hex}", 0
        with system.open_output_stream(name) as out:
            for batch in iterator:
                out.write(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(self.dtype).tobytes())
                rows += batch.num_rows
        return Written(TaskContext.get().partitionId(), name, rows)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = opened(self.path)
        if self.overwrite:
            for name, _ in files(self.path):
                system.delete_file(opened(name)[1])
        for m in messages:
            if m is not None:
                system.move(m.name, f"{path}/part-{m.partition:06d}.bin")

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = opened(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(m.name)


class RawArrays(DataSource):
    """Options: path, columns, dtype ('<f8'), slice (rows of a task), beside (path of files with one more column)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        n = int(self.options["columns"]) + ("beside" in self.options)
        return ", ".join(["id long", *(f"c{i} double" for i in range(n))])

    def reader(self, schema) -> DataSourceReader:
        return RawReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return RawWriter(self.options, overwrite)


def read_raw_array(spark: SparkSession, path: str, n_columns: int, dtype: str = "<f8", rows_per_slice: int = 500_000, beside: str | None = None) -> DataFrame:
    """id, c0, c1, ... of a file or a folder of files; with `beside`, a last column from files of as many rows with one number each."""
    spark.dataSource.register(RawArrays)
    reader = spark.read.format(NAME).option("path", path).option("columns", n_columns).option("dtype", dtype).option("slice", rows_per_slice)
    return (reader.option("beside", beside) if beside else reader).load()


def write_raw_array(frame: DataFrame, columns: Sequence[str], path: str, order: str = "id", dtype: str = "<f8") -> int:
    """Write columns into a folder of raw files in the order of a column; returns the number of rows."""
    spark = frame.sparkSession
    spark.dataSource.register(RawArrays)
    parts = spark.sparkContext.defaultParallelism
    laid = frame.repartitionByRange(parts, order).sortWithinPartitions(order).select(*columns)
    laid.write.format(NAME).mode("overwrite").option("path", path).option("dtype", dtype).save()
    width = len(columns) * np.dtype(dtype).itemsize
    return sum(n for _, n in rows_of(path, width))


def read_raw_points(spark: SparkSession, coords_path: str, values_path: str, dims: int = 2, dtype: str = "<f8", rows_per_slice: int = 500_000) -> DataFrame:
    """Point set of two raw files, coordinates and values, read in step."""
    names = ["x", "y", "z"][:dims]
    if dims < 1 or dims > 3:
        raise ValueError("raw coordinates have one to three columns")
    return read_raw_array(spark, coords_path, dims, dtype, rows_per_slice, values_path).toDF("id", *names, "value")
