"""Places and running totals over a whole table, without a window in one task.

Rows are cut into ranges of the order, sorted inside their range and written
once; a row's place in its range is then known, and every range starts where
the totals of the ranges before it end. Only one row a range meets anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phredloom.session import Scratch

_RANGE = 33  # bits that monotonically_increasing_id leaves for the row inside its partition


def _sorted(df: DataFrame, order: list[Column], ranges: int | None) -> DataFrame:
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return Scratch(df.sparkSession).keep(dealt.withColumn("_at", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_at", _RANGE))


def _shifted(df: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """``df`` with what the earlier ranges add up to; the side that is broadcast has a row a range."""
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = df.groupBy("_range").agg(*(F.sum(c).alias(f"_{k}") for k, c in sums.items()))
    starts = ranges.select("_range", *(F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in sums))
    return df.join(F.broadcast(starts), "_range")


def numbered(df: DataFrame, order: list[Column], name: str = "rank", ranges: int | None = None) -> DataFrame:
    """``df`` with each row's place (from 1) in ``order``.

    Rows that are equal in every order column are in one range: end the order
    with a column that tells rows apart. An empty table stays empty.
    """
    s = _sorted(df, order, ranges)
    place = F.col("_at").bitwiseAND(F.lit((1 << _RANGE) - 1))
    return _shifted(s, {"rows": F.lit(1).cast("long")}).select(*df.columns, (place + F.col("_rows") + 1).alias(name))


def totals(df: DataFrame, order: list[Column], sums: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """``df`` with running totals, the row's own value included; nulls add nothing.

    Totals of doubles are added range by range, so their last digits depend on
    the number of ranges. Rows equal in the order count one after another.
    """
    cols = {f"_v{i}": F.coalesce(c, F.lit(0)) for i, c in enumerate(sums.values())}
    s = _sorted(df.withColumns(cols), order, ranges)
    inside = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    s = s.select("*", *(F.sum(v).over(inside).alias(f"_run{v}") for v in cols))
    out = _shifted(s, {v: F.col(v) for v in cols})
    return out.select(*df.columns, *((F.col(f"_run{v}") + F.col(f"_{v}")).alias(k) for k, v in zip(sums, cols, strict=True)))

