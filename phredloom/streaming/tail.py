"""Running counts over SAM files that arrive in a folder (Structured Streaming)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phredloom.functions import flags


def record_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Flag and quality of the primary aligned records of new files."""
    f = F.split("value", "\t")
    raw = spark.readStream.text(folder).filter(~F.col("value").startswith("@"))
    r = raw.select(F.get(f, F.lit(0)).alias("qname"), F.get(f, F.lit(1)).try_cast("int").alias("flag"), F.get(f, F.lit(4)).try_cast("int").alias("mapq"))
    return r.filter(flags.is_primary(F.col("flag")) & flags.is_aligned(F.col("flag")))


def quality_counts(records: DataFrame) -> DataFrame:
    """Records by quality; use with output mode ``complete`` or ``update`` (one row of state a quality)."""
    return records.groupBy("mapq").agg(F.count(F.lit(1)).alias("n"))
