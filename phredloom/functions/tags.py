"""Optional SAM tags: lookup, and the comma list of aligner features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FEATURES = "ZT:Z:"
MISMATCHES = "MD:Z:"


def tag(tags: Column, prefix: str) -> Column:
    """Value of the first tag with this prefix, null if absent."""
    return F.substring(F.get(F.filter(tags, lambda t: t.startswith(prefix)), F.lit(0)), F.lit(len(prefix) + 1), F.lit(2147483647))


def numbers(value: Column) -> Column:
    """Comma list to array<double>; NA (and anything that is no finite number) is null."""

    def one(t: Column) -> Column:
        v = t.try_cast("double")
        return F.when(F.isnan(v), None).otherwise(v)

    return F.transform(F.split(value, ","), one)


def arity(values: Column) -> Column:
    return F.size(values)


def drop(tags: Column, prefix: str) -> Column:
    return F.filter(tags, lambda t: ~t.startswith(prefix))
