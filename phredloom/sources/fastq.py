"""FASTQ records of four lines (plain, gzip or bzip2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phredloom.session import partitions
from phredloom.sources.sam import numbered_lines, text_size

TASK_BYTES = 4_000_000  # of text that one task puts together: rows of short lines take thirty times their text


def read_fastq(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file``, ``ordinal`` (from 0), ``name`` (without @), ``seq``, ``qual``."""
    n = partitions(spark, -(-text_size(spark, paths) // TASK_BYTES))
    lines = numbered_lines(spark, paths).withColumn("ordinal", F.floor((F.col("line") - 1) / 4)).withColumn("k", (F.col("line") - 1) % 4)

    def pick(i: int, name: str):
        return F.max(F.when(F.col("k") == i, F.col("raw"))).alias(name)

    dealt = lines.repartition(*n, "file", "ordinal")  # before the lines of a read meet, so that no task sorts a whole file block
    r = dealt.groupBy("file", "ordinal").agg(pick(0, "name"), pick(1, "seq"), pick(3, "qual")).filter("qual is not null")
    return r.withColumn("name", F.regexp_replace("name", "^@", ""))


def to_lines(df: DataFrame) -> DataFrame:
    """One text of four lines per read, from ``name``, ``seq``, ``qual``."""
    return df.withColumn("value", F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), "qual"))
