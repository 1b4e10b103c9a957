"""Conversion of simulated reads between naming schemes, with the pair filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phredloom.functions.readnames import mason, wgsim


def discard_reason(a: Column, b: Column) -> Column:
    """Why a pair of decoded names is discarded; null for a good pair."""
    clash = ((a["left"] < b["left"]) & b["forward"]) | ((b["right"] < a["right"]) & a["forward"])
    return F.when(a["refid"] != b["refid"], "refid").when(a["forward"] == b["forward"], "strands").when(clash, "not compatible")


def decoded_pairs(one: DataFrame, two: DataFrame) -> DataFrame:
    """Pairs by ordinal: ``ordinal``, both decoded names ``t1`` ``t2``, both reads ``r1`` ``r2``, ``reason``."""
    a = one.select("ordinal", mason(F.col("name")).alias("t1"), F.struct("name", "seq", "qual").alias("r1"))
    b = two.select("ordinal", mason(F.col("name")).alias("t2"), F.struct("name", "seq", "qual").alias("r2"))
    return a.join(b, "ordinal").withColumn("reason", discard_reason(F.col("t1"), F.col("t2")))


def reason_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def numbered(df: DataFrame, order: str, shards: int = 1024) -> DataFrame:
    """``idx`` from 1 in ``order`` (a dense bigint): numbered in ranges, shifted by the ranges before."""
    span = df.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    width = max(1, ((span["hi"] or 0) - (span["lo"] or 0)) // shards + 1)
    d = df.withColumn("_s", F.floor((F.col(order) - (span["lo"] or 0)) / width))
    before = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)  # at most ``shards`` rows
    off = d.groupBy("_s").agg(F.count(F.lit(1)).alias("_n")).select("_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    return d.join(F.broadcast(off), "_s").withColumn("idx", F.row_number().over(Window.partitionBy("_s").orderBy(order)) + F.col("_o")).drop("_s", "_o")


def convert_pairs(one: DataFrame, two: DataFrame) -> DataFrame:
    """Good pairs under wgsim-like names: ``idx``, ``mate``, ``name``, ``seq``, ``qual``."""
    good = numbered(decoded_pairs(one, two).filter("reason is null"), "ordinal")
    lo, hi = F.least("t1.left", "t2.left"), F.greatest("t1.right", "t2.right")

    def name(mate: int) -> Column:
        return wgsim(F.col("t1.refid"), lo, hi, F.length("r1.seq"), F.length("r2.seq"), F.col("t2.forward"), F.col("idx"), F.lit(mate))

    rows = [F.struct(F.lit(m).alias("mate"), name(m).alias("name"), F.col(f"r{m}.seq").alias("seq"), F.col(f"r{m}.qual").alias("qual")) for m in (1, 2)]
    return good.select("idx", F.explode(F.array(*rows)).alias("r")).select("idx", "r.*")


def convert_unpaired(reads: DataFrame) -> DataFrame:
    r = numbered(reads.withColumn("t", mason(F.col("name"))), "ordinal")
    n = F.length("seq")
    return r.select("idx", wgsim(F.col("t.refid"), F.col("t.left"), F.col("t.right"), n, n, ~F.col("t.forward"), F.col("idx"), F.lit(1)).alias("name"), "seq", "qual")
