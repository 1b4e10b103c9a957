"""Shared pieces of the training-data operators: scratch tables and input shaping."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session leaves it unset, a folder in the warehouse stands in,
    which a cluster shares as well.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    return where.rstrip("/") if where else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts lineage so that a lost executor costs one table read, not a recompute
    of everything before it, and an expensive step used twice runs once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/phredloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, most_rows: int) -> DataFrame:
    """Broadcast ``df`` only if its counted ``rows`` are within ``most_rows``; else let it shuffle."""
    return F.broadcast(df) if rows <= most_rows else df


def documents(df: DataFrame, *extra: str) -> DataFrame:
    """``doc_id``, ``text`` (null becomes '') and the named extra columns, nothing else."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *extra)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the value's decimal text, modulo ``n``."""
    return F.pmod(F.crc32(col.cast("string")), F.lit(n))


def tidy(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``f`` over batches; when a task ends, freed memory goes back to the system, since Python workers live on from stage to stage."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return run


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of at most ``rows`` rows, so that only a part's texts are Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
