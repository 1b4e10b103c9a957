"""Row-major float64 matrices with a one-line description, as a Spark data source that reads and writes in parallel.

``<prefix>.meta`` holds ``col,...,col,rows``; ``<prefix>.npy`` holds the rows as
native doubles without a header. Rows have a fixed length, so ranges of rows are
planned from the description alone, and each is read by a task of its own.

    spark.dataSource.register(MatrixSource)
    spark.read.format("matrix").load(prefix)
    df.write.format("matrix").mode("overwrite").save(prefix)     # or "append"

A write leaves a folder ``<prefix>.npy`` of parts named by their first row. Tasks
write parts under names of their own; when all are done the numbers of rows are
added up in order of the partitions, the parts get their place by a rename, and the
description comes last. No row passes the driver, and a repeated or lost task leaves
only a part that nobody counts. ``single_file`` joins the parts for tools that want
one file: every task copies its part to its own offset.

Paths are those of any file system that pyarrow opens. New tables are better
kept as Parquet; this format is for exchange.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import DoubleType, StructField, StructType

MAX_ROWS = 250_000
COPY_BYTES = 8 << 20
BATCH_BYTES = 8 << 20


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:"))


def _kind(path: str) -> pafs.FileType:
    fs, at = _open(path)
    return fs.get_file_info(at).type


def _described(line: str) -> tuple[list[str], int]:
    *cols, rows = line.strip().split(",")
    return cols, int(rows)


def read_meta(prefix: str) -> tuple[list[str], int]:
    fs, at = _open(prefix + ".meta")
    with fs.open_input_stream(at) as f:
        return _described(f.read().decode())


def _write_meta(prefix: str, columns: list[str], rows: int) -> None:
    fs, at = _open(prefix + ".meta")
    with fs.open_output_stream(at) as f:
        f.write((",".join([*columns, str(rows)]) + "\n").encode())


def _parts(prefix: str) -> list[tuple[str, int]]:
    """Paths of the files that hold the matrix, with their first rows."""
    fs, at = _open(prefix + ".npy")
    if fs.get_file_info(at).type == pafs.FileType.Directory:
        found = fs.get_file_info(pafs.FileSelector(at))
        return sorted(((f.path, int(f.base_name.removeprefix("rows-"))) for f in found if f.base_name.startswith("rows-")), key=lambda p: p[1])
    return [(at, 0)]


@dataclass
class Rows(InputPartition):
    path: str
    first: int  # of the file
    rows: int


class MatrixReader(DataSourceReader):
    def __init__(self, prefix: str, max_rows: int):
        self.prefix, self.max_rows = prefix, max_rows
        self.columns, self.rows = read_meta(prefix)

    def partitions(self) -> list[Rows]:
        parts = _parts(self.prefix) if self.rows else []
        ends = [first for _, first in parts[1:]] + [self.rows] * bool(parts)
        out = []
        for (path, first), end in zip(parts, ends, strict=True):
            step = self.max_rows or end - first
            out += [Rows(path, at - first, min(step, end - at)) for at in range(first, end, step or 1)]
        return out or [Rows("", 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if not partition.rows:
            return
        width = len(self.columns)
        fs = _open(self.prefix)[0]
        batch = max(1, BATCH_BYTES // (8 * width))
        with fs.open_input_file(partition.path) as f:
            f.seek(8 * width * partition.first)
            left = partition.rows
            while left:
                data = f.read(8 * width * min(batch, left))
                if len(data) != 8 * width * min(batch, left):
                    raise ValueError(f"{partition.path} ends before the {self.rows} rows of its description")
                m = np.frombuffer(data, np.float64).reshape(-1, width)
                left -= len(m)
                yield pa.RecordBatch.from_arrays([pa.array(m[:, i], from_pandas=True) for i in range(width)], self.columns)


@dataclass
class Written(WriterCommitMessage):
    path: str
    rows: int


class MatrixWriter(DataSourceArrowWriter):
    """Parts under names of their own; commit gives them their rows. Nulls become NaN."""

    def __init__(self, prefix: str, columns: list[str], overwrite: bool):
        self.prefix, self.columns, self.overwrite = prefix, columns, overwrite
        self.where = f"{prefix}.npy.writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = _open(self.where)
        fs.create_dir(folder, recursive=True)
        path, rows = f"{folder}/{uuid.uuid4().hex}", 0
        with fs.open_output_stream(path) as f:
            for b in iterator:
                m = np.empty((b.num_rows, b.num_columns))
                for i, c in enumerate(b.columns):
                    m[:, i] = c.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null: NaN
                f.write(m.tobytes())
                rows += len(m)
        return Written(path, rows)

    def commit(self, messages: list[Written | None]) -> None:
        fs, to = _open(self.prefix + ".npy")
        at, there = 0, fs.get_file_info(to).type
        if not self.overwrite and there != pafs.FileType.NotFound:
            known, at = read_meta(self.prefix)
            if known != self.columns:
                raise ValueError(f"columns {self.columns} cannot follow {known}")
        elif there == pafs.FileType.Directory:
            fs.delete_dir(to)
        elif there == pafs.FileType.File:
            fs.delete_file(to)
        if fs.get_file_info(to).type == pafs.FileType.File:  # one file becomes the first part
            fs.move(to, to + ".first")
            fs.create_dir(to)
            fs.move(to + ".first", f"{to}/rows-{0:015d}")
        fs.create_dir(to, recursive=True)
        for m in messages:
            if m is not None and m.rows:
                fs.move(m.path, f"{to}/rows-{at:015d}")
                at += m.rows
        _write_meta(self.prefix, self.columns, at)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, folder = _open(self.where)
        if fs.get_file_info(folder).type == pafs.FileType.Directory:
            fs.delete_dir(folder)


class MatrixSource(DataSource):
    """Options: ``path``, the prefix; ``max_rows`` of a partition (0: a part)."""

    @classmethod
    def name(cls) -> str:
        return "matrix"

    def schema(self) -> StructType:
        return StructType([StructField(c, DoubleType()) for c in read_meta(self.options["path"])[0]])

    def reader(self, schema: StructType) -> MatrixReader:
        return MatrixReader(self.options["path"], int(self.options.get("max_rows", MAX_ROWS)))

    def writer(self, schema: StructType, overwrite: bool) -> MatrixWriter:
        return MatrixWriter(self.options["path"], schema.names, overwrite)


def read_matrix(spark: SparkSession, prefix: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """The matrix as columns of doubles, NaN as null, at most ``max_rows`` rows a partition (0: a whole part)."""
    spark.dataSource.register(MatrixSource)
    return spark.read.format("matrix").option("max_rows", str(max_rows)).load(prefix)


def save_matrix(df: DataFrame, prefix: str, append: bool = False) -> None:
    """All columns of ``df`` as doubles, rows in order of its partitions."""
    df.sparkSession.dataSource.register(MatrixSource)
    doubles = df.select(*(F.col(f"`{c}`").cast("double").alias(c) for c in df.columns))
    doubles.write.format("matrix").mode("append" if append else "overwrite").save(prefix)


def single_file(spark: SparkSession, prefix: str) -> None:
    """Join the parts of a matrix on a file system with places inside files: each part is copied to its offset by a task."""
    fs, to = _open(prefix + ".npy")
    if not isinstance(fs, pafs.LocalFileSystem) or fs.get_file_info(to).type != pafs.FileType.Directory:
        return
    cols, rows = read_meta(prefix)
    whole, width = f"{to}.whole-{uuid.uuid4().hex}", 8 * len(cols)
    with open(whole, "wb") as f:
        f.truncate(rows * width)

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with open(path, "rb") as src, open(whole, "r+b") as dst:
                    dst.seek(first * width)
                    while data := src.read(COPY_BYTES):
                        dst.write(data)
            yield b

    parts = spark.createDataFrame(_parts(prefix), "path string, first long")
    if rows:
        parts.repartition(max(1, spark.sparkContext.defaultParallelism), "path").mapInArrow(copy, "path string, first long").write.format("noop").mode("overwrite").save()
    fs.move(to, whole + ".parts")
    fs.move(whole, to)
    fs.delete_dir(whole + ".parts")


def write_matrix(prefix: str, columns: list[str], rows: np.ndarray, append: bool = False) -> None:
    """Write or append rows of an array, as one file."""
    before = read_meta(prefix)[1] if append and _kind(prefix + ".meta") == pafs.FileType.File else 0
    fs, at = _open(prefix + ".npy")
    with fs.open_append_stream(at) if before else fs.open_output_stream(at) as f:
        f.write(np.ascontiguousarray(rows, dtype=np.float64).tobytes())
    _write_meta(prefix, columns, before + len(rows))


def read_tables(spark: SparkSession, prefix: str, max_rows: int = MAX_ROWS) -> dict[str, DataFrame]:
    """The feature tables ``<prefix>_rec_{u,d,c,b}`` that exist and have rows; an error if none has."""
    out = {}
    for c in "udcb":
        p = f"{prefix}_rec_{c}"
        if _kind(p + ".meta") == pafs.FileType.File and read_meta(p)[1]:
            out[c] = read_matrix(spark, p, max_rows)
    if not out:
        raise ValueError(f"no rows in any feature table under {prefix}")
    return out


def save_tables(features: DataFrame, prefix: str, columns: dict[str, list[str]]) -> None:
    """The tables that ``read_tables`` reads: ``columns`` of each category that has rows."""
    for c, cols in columns.items():
        save_matrix(features.filter(F.col("category") == c).select(*cols), f"{prefix}_rec_{c}")
