"""Predicates on the SAM FLAG bit set (Column in, Column out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# SAM FLAG bits.
PAIRED, PROPER, UNMAPPED, REVERSE, FIRST, LAST, SECONDARY, SUPPLEMENTARY = 1, 2, 4, 16, 64, 128, 256, 2048


def has(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(F.lit(bit)) != 0


def is_aligned(flag: Column) -> Column:
    return ~has(flag, UNMAPPED)


def is_forward(flag: Column) -> Column:
    return ~has(flag, REVERSE)


def is_concordant(flag: Column) -> Column:
    return has(flag, PROPER)


def is_paired(flag: Column) -> Column:
    return has(flag, PAIRED)


def mate_flag(flag: Column) -> Column:
    """'1', '2', or '0' for neither end."""
    return F.when(has(flag, FIRST), "1").when(has(flag, LAST), "2").otherwise("0")


def is_primary(flag: Column) -> Column:
    return ~has(flag, SECONDARY) & ~has(flag, SUPPLEMENTARY)
