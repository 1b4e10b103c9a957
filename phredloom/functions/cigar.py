"""CIGAR and MD:Z kernels: runs, clips, edit transcripts, stacked alignments, positions, fragments.

All are expressions over columns; runs are arrays of structs folded with
higher-order functions, so no row leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` worked out once; folds of arrays that an expression names twice are else worked out twice."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def runs(cigar: Column) -> Column:
    """array<struct<n int, op string>> of a CIGAR string."""
    return F.transform(
        F.regexp_extract_all(cigar, F.lit("[0-9]+[A-Za-z=]"), 0),
        lambda x: F.struct(F.substring(x, F.lit(1), F.length(x) - 1).cast("int").alias("n"), F.right(x, F.lit(1)).alias("op")),
    )


def left_clip(ops: Column) -> Column:
    first = F.get(ops, F.lit(0))
    return F.coalesce(F.when(first["op"] == "S", first["n"]), F.lit(0))


def right_clip(ops: Column) -> Column:
    """Run of a final S; a single S run counts as left clip only."""
    last = F.get(ops, F.size(ops) - 1)
    return F.coalesce(F.when((F.size(ops) > 1) & (last["op"] == "S"), last["n"]), F.lit(0))


def is_extended(cigar: Column) -> Column:
    return F.coalesce(cigar.rlike("[=X]"), F.lit(False))


def md_tokens(md: Column) -> Column:
    """Match runs, ``^`` deletions and mismatch runs, in order; zero match runs dropped."""
    return F.filter(F.regexp_extract_all(md, F.lit(r"[0-9]+|\^[A-Za-z]+|[A-Za-z]+"), 0), lambda t: ~t.rlike("^0+$"))


def _md_chars(md: Column, reference: bool = False) -> Column:
    """One character for each reference base that MD describes: =, X, D, or with ``reference`` the base itself (= where equal)."""

    def one(t: Column) -> Column:
        deletion, bases = t.startswith("^"), F.length(t)
        if reference:
            return F.when(t.rlike("^[0-9]"), F.repeat(F.lit("="), t.try_cast("int"))).when(deletion, F.substring(t, F.lit(2), bases)).otherwise(t)
        return F.when(t.rlike("^[0-9]"), F.repeat(F.lit("="), t.try_cast("int"))).when(deletion, F.repeat(F.lit("D"), bases - 1)).otherwise(F.repeat(F.lit("X"), bases))

    return F.array_join(F.transform(md_tokens(md), one), "")


def transcript_extended(ops: Column) -> Column:
    """Each op repeated; M and P are errors."""
    return F.array_join(
        F.transform(ops, lambda r: F.when(r["op"].isin("M", "P"), F.raise_error(F.concat(F.lit("CIGAR op not allowed: "), r["op"])).cast("string")).otherwise(F.repeat(r["op"], r["n"]))), ""
    )


def transcript(ops: Column, md: Column) -> Column:
    """Edit transcript of a plain CIGAR with MD:Z: M takes = or X from MD, D uses up MD, I/N/S are copied, H goes, P is an error."""
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))
    bases = _md_chars(md)

    def step(s: Column, r: Column) -> Column:
        taken = F.substring(s["md"], s["at"], r["n"])
        out = (
            F.when(r["op"].isin("M", "D"), F.concat(s["out"], taken))
            .when(r["op"].isin("I", "N", "S"), F.concat(s["out"], F.repeat(r["op"], r["n"])))
            .when(r["op"] == "H", s["out"])
            .otherwise(F.raise_error(F.concat(F.lit("CIGAR op not allowed: "), r["op"])).cast("string"))
        )
        return F.struct((s["at"] + F.when(r["op"].isin("M", "D"), r["n"]).otherwise(0)).alias("at"), out.alias("out"), s["md"].alias("md"))

    return F.aggregate(ops, F.struct(start["at"].alias("at"), start["out"].alias("out"), bases.alias("md")), step, lambda s: s["out"])


def edit_transcript(cigar: Column, md: Column, ops: Column | None = None) -> Column:
    """``ops``: the runs of ``cigar``, if they are known."""
    ops = runs(cigar) if ops is None else ops
    return F.when(is_extended(cigar), transcript_extended(ops)).otherwise(transcript(ops, md))


def stacked(ops: Column, md: Column, seq: Column) -> Column:
    """struct<read, ref>: gapped strings of read and reference (clips left out)."""
    init = F.struct(F.lit(1).alias("at"), F.lit(1).alias("pos"), F.lit("").alias("read"), F.lit("").alias("ref"), _md_chars(md, True).alias("md"), seq.alias("seq"))

    def step(s: Column, r: Column) -> Column:
        n, op = r["n"], r["op"]
        bases, told = F.substring(s["seq"], s["pos"], n), F.substring(s["md"], s["at"], n)
        filled = F.array_join(F.zip_with(F.split(bases, ""), F.split(told, ""), lambda b, m: F.when(m == "=", b).otherwise(m)), "")
        read = F.when(op.isin("M", "I"), bases).when(op.isin("D", "N"), F.repeat(F.lit("-"), n)).otherwise("")
        ref = F.when(op == "M", filled).when(op == "I", F.repeat(F.lit("-"), n)).when(op == "D", told).when(op == "N", F.repeat(F.lit("N"), n)).otherwise("")
        return F.struct(
            (s["at"] + F.when(op.isin("M", "D"), n).otherwise(0)).alias("at"), (s["pos"] + F.when(op.isin("M", "I", "S"), n).otherwise(0)).alias("pos"),
            F.concat(s["read"], read).alias("read"), F.concat(s["ref"], ref).alias("ref"), s["md"].alias("md"), s["seq"].alias("seq"),
        )

    return F.aggregate(ops, init, step, lambda s: F.struct(s["read"].alias("read"), s["ref"].alias("ref")))


def ref_length(xscript: Column) -> Column:
    """Reference bases under a transcript: S, =, X and D."""
    return F.length(F.regexp_replace(xscript, "[^S=XD]", ""))


def lpos(pos: Column, clip: Column) -> Column:
    return pos - clip


def rpos(pos: Column, xscript: Column, exact: bool = False) -> Column:
    """Rightmost reference position. The first op after leading clips is not counted, unless ``exact``."""
    return pos + ref_length(F.regexp_replace(xscript, "^S*" if exact else "^S*.", "")) - 1


def fragment_length(pos1: Column, lpos1: Column, rpos1: Column, pos2: Column, lpos2: Column, rpos2: Column, most: int = 100_000) -> Column:
    """Right end of the downstream mate minus left end of the upstream one, plus 1, within [0, most]; at equal positions mate 2 is upstream."""
    length = F.when(pos1 < pos2, rpos2 - lpos1).otherwise(rpos1 - lpos2) + 1
    return F.least(F.lit(most), F.greatest(F.lit(0), length)).cast("long")


def quality_totals(qual: Column, left: Column, right: Column, exact: bool = False) -> Column:
    """struct<aligned, clipped, avg_aligned, avg_clipped, left, right> of phred sums.

    The last aligned base counts as clipped unless ``exact``. With at most one
    clipped base there is no clipping: total 0, average 100, both clips 0.
    """
    n = F.length(qual)
    phred = F.transform(F.split(qual, ""), lambda x: F.ascii(x) - 33)
    end = n - right - (0 if exact else 1)
    clips = left + right
    clipped = clips > 1
    none = F.lit(0)

    def sums(p: Column) -> Column:
        inside = F.aggregate(F.slice(p, left + 1, F.greatest(F.lit(0), end - left)), F.lit(0).cast("long"), lambda a, x: a + x)
        return F.struct(inside.alias("inside"), F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))

    def totals(t: Column) -> Column:
        inside, rest = t["inside"], t["total"] - t["inside"]
        return F.struct(
            inside.alias("aligned"), F.when(clipped, rest).otherwise(F.lit(0).cast("long")).alias("clipped"),
            (inside / (n - clips)).alias("avg_aligned"), F.when(clipped, rest / clips).otherwise(100.0).alias("avg_clipped"),
            F.when(clipped, left).otherwise(none).alias("left"), F.when(clipped, right).otherwise(none).alias("right"),
        )

    return _bound(phred, lambda p: _bound(sums(p), totals))
