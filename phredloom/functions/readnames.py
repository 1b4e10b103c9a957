"""Read names that carry the truth: the simulator's own, and wgsim-like ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from phredloom.functions.flags import is_forward, mate_flag

# Separator and types of simulated names. Names written with another prefix: pass it.
PREFIX = "sim!"
TYPES = ["u", "b1", "b2", "c", "d"]


def simulated_type(qname: Column, prefix: str = PREFIX) -> Column:
    """What follows the last colon of a simulated name; null for other names."""
    return F.when(qname.startswith(prefix), F.substring_index(qname, ":", -1))


def _quoted(rname: Column) -> Column:
    return F.concat(F.lit(r"\Q"), rname, F.lit(r"\E"))


def _simulated_correct(qname: Column, flag: Column, rname: Column, pos: Column, wiggle: int, prefix: str) -> Column:
    second = mate_flag(flag) == "2"
    quad = r":(.+?):([+-]):([0-9]+):(-?[0-9]+)"
    body = rf"^\Q{prefix}\E{quad}(?:{quad})?:[ubcd][12]?$"

    def part(i: int) -> Column:
        return F.when(second, F.regexp_extract(qname, body, i + 4)).otherwise(F.regexp_extract(qname, body, i))

    near = F.abs(part(3).try_cast("long") - (pos - 1)) < wiggle
    strand = part(2) == F.when(is_forward(flag), "+").otherwise("-")
    return F.coalesce((part(1) == rname) & strand & near, F.lit(False))


def _wgsim_correct(qname: Column, flag: Column, rname: Column, pos: Column, wiggle: int) -> Column:
    tail = r"_([0-9]+)_([0-9]+)_[0-9]+:[0-9]+:[0-9]+_[0-9]+:[0-9]+:[0-9]+_([0-9]+)_([0-9]+)_([01])_"
    shape = F.concat(F.lit("^"), _quoted(rname), F.lit(tail))

    def part(i: int) -> Column:
        return F.call_function("regexp_extract", qname, shape, F.lit(i)).try_cast("long")

    first = mate_flag(flag) != "2"
    length = F.when(first, part(3)).otherwise(part(4))
    left_end = (part(5) == 0) == first
    expected = F.when(left_end, part(1)).otherwise(part(2) - length + 1)
    return F.coalesce(F.abs(pos - expected) < wiggle, F.lit(False))


def is_wgsim_like(qname: Column) -> Column:
    """At least 8 underscores, and exactly 4 colons after the third."""
    rest = F.regexp_extract(qname, "^[^_]*_[^_]*_[^_]*_(.*)$", 1)
    return (F.length(qname) - F.length(F.replace(qname, F.lit("_"), F.lit(""))) >= 8) & (F.length(rest) - F.length(F.replace(rest, F.lit(":"), F.lit(""))) == 4)


def correctness(qname: Column, flag: Column, rname: Column, pos: Column, wiggle: int = 30, prefix: str = PREFIX) -> Column:
    """1 or 0 where the name tells the read's origin, -1 elsewhere."""
    return (
        F.when(qname.startswith(prefix), _simulated_correct(qname, flag, rname, pos, wiggle, prefix).cast("int"))
        .when(is_wgsim_like(qname), _wgsim_correct(qname, flag, rname, pos, wiggle).cast("int"))
        .otherwise(F.lit(-1))
    )


def mason(name: Column) -> Column:
    """struct<left, right, refid, forward> of a Mason read name; left is 1-based."""

    def field(key: str) -> Column:
        return F.regexp_extract(name, rf"{key}=(\S*)", 1)

    return F.struct(
        (field("orig_begin").cast("long") + 1).alias("left"), field("orig_end").cast("long").alias("right"),
        field("contig").alias("refid"), (field("strand") == "forward").alias("forward"),
    )


def wgsim(refid: Column, left: Column, right: Column, len1: Column, len2: Column, flipped: Column, idx: Column, mate: Column) -> Column:
    return F.format_string("%s_%d_%d_0:0:0_0:0:0_%d_%d_%d_%d/%d", refid, left.cast("long"), right.cast("long"), len1.cast("long"), len2.cast("long"), flipped.cast("int"), idx.cast("long"), mate.cast("int"))
