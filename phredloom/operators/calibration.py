"""Tallies, calibration (ROC) tables, areas, curves, summaries, worst errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phredloom.functions.confidence import mapq_to_pcor, pcor_to_mapq
from phredloom.operators.running import totals

RANKS = 100_000  # ranks that one row expands to


def half_even(x: Column, decimals: int) -> Column:
    """A double rounded half to even in doubles, as SQL engines and numpy do: what is a half is told by the scaled double, not by the digits that it prints as."""
    unit = float(10**decimals)
    return F.rint(x.cast("double") * unit) / unit


def tally(df: DataFrame, mapq: Column, correct: Column, decimals: int | None = None) -> DataFrame:
    """``stratum``, ``cor``, ``incor``; values are rounded half to even first. Partial sums: one row a value and task."""
    stratum = mapq if decimals is None else half_even(mapq, decimals)
    return df.select((stratum + 0.0).alias("stratum"), correct.cast("int").alias("c")).groupBy("stratum").agg(
        F.sum("c").cast("long").alias("cor"), F.sum(1 - F.col("c")).cast("long").alias("incor")
    )


def roc(counts: DataFrame, pcor_strata: bool = False, many: bool = False) -> DataFrame:
    """Running totals from the highest stratum down.

    Rounded qualities have at most 60,001 strata at three decimals, and a window
    over them is one small task. ``many`` is for values that are not rounded: as
    many strata as rows, so totals are kept by ranges of the order.
    """
    mapq = pcor_to_mapq(F.col("stratum")) if pcor_strata else F.col("stratum")
    pcor = F.col("stratum") if pcor_strata else mapq_to_pcor(F.col("stratum"))
    t = counts.select(mapq.cast("double").alias("mapq"), pcor.cast("double").alias("pcor"), "cor", "incor", "stratum")
    t = t.withColumn("n", F.col("cor") + F.col("incor")).withColumn("se", F.col("incor") * F.col("pcor") * F.col("pcor") + F.col("cor") * (1 - F.col("pcor")) * (1 - F.col("pcor")))
    sums = {"cum_cor": "cor", "cum_incor": "incor", "cum": "n", "cum_se": "se"}
    if many:
        t = totals(t, [F.desc("stratum")], {k: F.col(v) for k, v in sums.items()})
    else:
        w = Window.orderBy(F.desc("stratum")).rowsBetween(Window.unboundedPreceding, 0)
        t = t.select("*", *(F.sum(v).over(w).alias(k) for k, v in sums.items()))
    return t.select("mapq", "pcor", "cor", "incor", "cum_cor", "cum_incor", "n", "cum", "se", "cum_se")


def auc_and_sse(table: DataFrame) -> DataFrame:
    """One row: area under the cumulative incorrect curve, sum of squared errors."""
    return table.agg(F.sum((F.col("cum_incor") - F.col("incor") / 2) * F.col("n")).alias("auc"), F.sum("se").alias("sse"))


def curves(table: DataFrame) -> DataFrame:
    """``rank`` (from 0), ``ci``, ``ce``: cumulative incorrect and squared error for each alignment, averaged inside a stratum.

    A stratum's ranks are made in blocks of ``RANKS``, dealt over all tasks.
    """
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = table.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RANKS)))).repartition(parts, "cum", "block")
    t = blocks.withColumn("i", F.explode(F.sequence(F.col("block") * RANKS + 1, F.least(F.col("n"), (F.col("block") + 1) * RANKS))))
    step = F.col("i") / F.col("n")
    rows = t.select(
        (F.col("cum") - F.col("n") + F.col("i")).alias("rank"), (F.col("cum_incor") - F.col("incor") + step * F.col("incor")).alias("ci"), (F.col("cum_se") - F.col("se") + step * F.col("se")).alias("ce"),
    )
    zero = table.sparkSession.range(1).select(F.col("id").alias("rank"), F.lit(0.0).alias("ci"), F.lit(0.0).alias("ce"))
    return zero.unionByName(rows)


def curve_difference(one: DataFrame, two: DataFrame) -> DataFrame:
    """``rank`` with the differences of both curves, as far as the shorter goes."""
    b = curves(two).select("rank", F.col("ci").alias("ci2"), F.col("ce").alias("ce2"))
    return curves(one).join(b, "rank").select("rank", (F.col("ci") - F.col("ci2")).alias("ci_diff"), (F.col("ce") - F.col("ce2")).alias("ce_diff"))


def percent_change(new: Column, old: Column) -> Column:
    """In percent of ``old``; from zero: infinite if it grew, else 0."""
    return F.when(old == 0, F.when(new > old, F.lit(float("inf"))).otherwise(F.lit(0.0))).otherwise(100.0 * (new - old) / old)


def summary(predictions: DataFrame) -> DataFrame:
    """One row of the changes of AUC and MSE against the original quality, raw and rounded."""
    one = None
    for name, mapq, decimals in (("raw", F.col("mapq"), 3), ("round", F.col("mapq"), 0), ("orig", F.col("mapq_orig").cast("double"), None)):
        a = auc_and_sse(roc(tally(predictions, mapq, F.col("correct"), decimals))).toDF(f"auc_{name}", f"sse_{name}")
        one = a if one is None else one.join(F.broadcast(a))  # one row each
    c = F.col
    return one.select(
        percent_change(c("auc_raw"), c("auc_orig")).alias("auc_diff_pct"), percent_change(c("auc_round"), c("auc_orig")).alias("auc_diff_pct_round"),
        percent_change(c("sse_raw"), c("sse_orig")).alias("mse_diff_pct"), percent_change(c("sse_round"), c("sse_orig")).alias("mse_diff_pct_round"),
    )


def top_incorrect(predictions: DataFrame, n: int = 100, lowest_first: bool = False) -> DataFrame:
    """The n incorrect rows of the highest quality (or the lowest), ties by id."""
    order = F.asc("mapq") if lowest_first else F.desc("mapq")
    return predictions.filter("correct = 0").orderBy(order, "id").limit(n).select("category", "id", "mapq", "mapq_orig", "correct")


def label_range() -> list[Column]:
    """Aggregates that tell whether labels are known: for ``assessable``, or for ``observe`` of predictions while they are written."""
    return [F.count(F.lit(1)).alias("n"), F.min("correct").alias("lo"), F.max("correct").alias("hi")]


def labels_known(r: dict, limit: int = 100_000_000) -> bool:
    """Of the values of ``label_range``: whether there are rows and labels; an error if there are more rows than ``limit``, or known and unknown labels mix."""
    if r["n"] > limit:
        raise ValueError(f"{r['n']} rows are more than the limit {limit}")
    if r["n"] and r["lo"] == -1 and r["hi"] > -1:
        raise ValueError("known and unknown labels are mixed")
    return bool(r["n"]) and r["lo"] > -1


def assessable(predictions: DataFrame, limit: int = 100_000_000) -> bool:
    """``labels_known`` of a table."""
    return labels_known(predictions.agg(*label_range()).first().asDict(), limit)


def write_tables(predictions: DataFrame, folder: str, n_top: int = 100) -> None:
    """roc, roc_round, roc_orig, top_incorrect and summary as CSV folders; all are small tables."""
    tables = {
        "roc": roc(tally(predictions, F.col("mapq"), F.col("correct"), 3)), "roc_round": roc(tally(predictions, F.col("mapq"), F.col("correct"), 0)),
        "roc_orig": roc(tally(predictions, F.col("mapq_orig").cast("double"), F.col("correct"))), "top_incorrect": top_incorrect(predictions, n_top), "summary": summary(predictions),
    }
    for name, t in tables.items():
        t.coalesce(1).write.mode("overwrite").csv(f"{folder}/{name}.csv", header=True)
