"""Registered queries and their SQL, and what the modules of queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phredloom.session import Scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


TASK_ROWS = 250_000  # rows of text that one task sorts and writes


def text_files(df: DataFrame, rows: int, files: int = 8) -> list[str]:
    """``df`` (f, k, value; about so many rows) written as one text file for each ``f`` from 0, its lines in order of ``k``; the paths.

    A file is a folder of parts whose names sort in line order, which the sources
    read as one file: tasks take ranges of (f, k), more where tables grow.
    """
    to = Scratch(df.sparkSession).path("text")
    df.repartitionByRange(max(files, -(-rows // TASK_ROWS)), "f", "k").sortWithinPartitions("f", "k").select("f", "value").write.partitionBy("f").text(to)
    return [f"{to}/f={i}" for i in range(files)]


def file_number(file: str = "file"):
    """The ``f`` of a path that ``text_files`` has made."""
    return F.regexp_extract(file, "/f=([0-9]+)(/|$)", 1).cast("int")
