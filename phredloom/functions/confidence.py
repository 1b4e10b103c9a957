"""Mapping quality and probability of being correct."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST = 0.999999


def pcor_to_mapq(p: Column) -> Column:
    return F.when(p >= 1, F.lit(float("inf"))).otherwise(F.abs(-10.0 * F.log10(1.0 - p)))


def mapq_to_pcor(q: Column) -> Column:
    return 1.0 - F.pow(F.lit(10.0), -0.1 * q)


def round_pcor(p: Column) -> Column:
    """p through the nearest integer quality (half to even)."""
    return F.when(p >= 1, F.lit(1.0)).otherwise(mapq_to_pcor(F.bround(F.abs(-10.0 * F.log10(1.0 - F.least(p, F.lit(1 - 1e-16)))), 0)))


def clamp(p: Column, least: float = 0.0, most: float = MOST) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(least), p))
