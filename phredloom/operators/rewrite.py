"""Predictions merged, joined back to SAM lines, and written in line order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phredloom.functions import tags
from phredloom.operators.pairing import template_rows
from phredloom.session import partitions

TASK_ROWS = 250_000  # lines that one task orders


def merge_runs(runs: list[DataFrame]) -> DataFrame:
    """Prediction runs ((file,) line, mapq) as one; a line of a file twice, or a quality outside [0, 100], is an error."""
    on = ["file", "line"] if "file" in runs[0].columns else ["line"]
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    out = out.groupBy(*on).agg(F.max("mapq").alias("mapq"), F.count(F.lit(1)).alias("_n"))
    bad = (F.col("_n") > 1) | ~F.col("mapq").between(0, 100)
    return out.select(*on, F.when(bad, F.raise_error(F.lit("a line twice, or a quality out of range")).cast("double")).otherwise(F.col("mapq")).alias("mapq"))


def rewritten(raw: Column, mapq: Column, keep_features: bool = False, orig_flag: str | None = None, precise_flag: str | None = None) -> Column:
    """A SAM line with its quality replaced (half up), features removed, original and precise values appended on demand."""
    f = F.split(raw, "\t")
    extra = F.slice(f, F.lit(12), F.greatest(F.lit(0), F.size(f) - 11))
    if not keep_features:
        extra = tags.drop(extra, tags.FEATURES)
    added = []
    if orig_flag:
        added.append(F.concat(F.lit(orig_flag + ":"), F.get(f, F.lit(4))))
    if precise_flag:
        added.append(F.concat(F.lit(precise_flag + ":"), F.format_string("%.3f", mapq)))
    quality = F.floor(mapq + 0.5).cast("int").cast("string")
    return F.array_join(F.concat(F.slice(f, 1, 4), F.array(quality), F.slice(f, 6, 6), extra, F.array(*added) if added else F.expr("cast(array() as array<string>)")), "\t")


def rewrite(lines: DataFrame, predictions: DataFrame, **options) -> DataFrame:
    """``file``, ``line``, ``raw``: lines without a prediction pass unchanged. Joins on (file, line), or line where predictions have no file."""
    on = ["file", "line"] if "file" in predictions.columns else ["line"]
    p = predictions.select(*on, F.col("mapq").alias("_mapq"))
    j = lines.join(p, on, "left")
    return j.select("file", "line", F.when(F.col("_mapq").isNull(), F.col("raw")).otherwise(rewritten(F.col("raw"), F.col("_mapq"), **options)).alias("raw"))


def rewritten_in_order(lines: DataFrame, runs: list[DataFrame], ranges: int | None = None, **options) -> DataFrame:
    """``file``, ``line``, ``raw`` as ``rewrite(lines, merge_runs(runs))`` gives them, in line order within range partitions that follow one another.

    Lines and the predictions (file, line, mapq) of all runs are dealt together
    by ranges of (file, line). A line's rows then lie side by side in one task,
    so merging, joining and ordering share the one exchange of the text. A
    prediction without a line is left out; a line twice among the predictions,
    or a quality outside [0, 100], is an error.
    """
    both = lines.select("file", "line", "raw", F.lit(None).cast("double").alias("_mapq"))
    for r in runs:
        both = both.unionByName(r.select("file", "line", F.lit(None).cast("string").alias("raw"), F.col("mapq").cast("double").alias("_mapq")))
    order = ["file", "line"]
    n = [ranges] if ranges else partitions(lines.sparkSession, -(-lines.count() // TASK_ROWS))
    dealt = both.repartitionByRange(*n, *order)
    one = dealt.groupBy(*order).agg(F.max("raw").alias("_raw"), F.max("_mapq").alias("_mapq"), F.count(F.when(F.col("raw").isNull(), 1)).alias("_n"))
    bad = (F.col("_n") > 1) | ((F.col("_n") == 1) & ~F.coalesce(F.col("_mapq").between(0, 100), F.lit(False)))
    raw = F.when(bad, F.raise_error(F.lit("a line twice, or a quality out of range")).cast("string"))
    raw = raw.when(F.col("_mapq").isNull(), F.col("_raw")).otherwise(F.when(F.col("_raw").isNotNull(), rewritten(F.col("_raw"), F.col("_mapq"), **options)))
    return one.select(*order, raw.alias("raw")).filter("raw is not null").sortWithinPartitions(*order)


def write_rewritten(lines: DataFrame, runs: list[DataFrame], path: str, **options) -> None:
    """Text parts whose names sort in line order: merged, joined and ordered in one exchange."""
    rewritten_in_order(lines, runs, **options).select(F.col("raw").alias("value")).write.mode("overwrite").text(path)


def write_sam(lines: DataFrame, path: str) -> None:
    """Text parts whose names sort in line order (a range-partitioned sort, no single writer)."""
    lines.orderBy("file", "line").select(F.col("raw").alias("value")).write.mode("overwrite").text(path)


def write_features(features: DataFrame, path: str, append: bool = False) -> None:
    features.write.mode("append" if append else "overwrite").partitionBy("category").parquet(path)


def interleave(one: DataFrame, two: DataFrame) -> DataFrame:
    """Mates of two read tables in turn, with /1 and /2 on their names: ``ordinal``, ``mate``, ``name``, ``seq``, ``qual``."""

    def marked(df: DataFrame, mate: int) -> DataFrame:
        name = F.when(F.col("name").endswith(f"/{mate}"), F.col("name")).otherwise(F.concat("name", F.lit(f"/{mate}")))
        return df.select("ordinal", F.lit(mate).alias("mate"), name.alias("name"), "seq", "qual")

    return marked(one, 1).unionByName(marked(two, 2)).orderBy("ordinal", "mate")


def write_templates(templates: DataFrame, path: str) -> None:
    """Templates as CSV text, one folder."""
    template_rows(templates).write.mode("overwrite").csv(path, header=True)
