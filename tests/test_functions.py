"""Column kernels against plain restatements of their rules."""

import math
import random

import pytest
from pyspark.sql import functions as F

from phredloom.functions import bases, cigar, confidence, flags, readnames, tags


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())] if values else [(1,)], list(values) or ["x"])
    return df.select(expr.alias("v")).first()["v"]


def restated_transcript(ops, md):
    """Edit transcript by walking CIGAR and MD together."""
    tokens, i = [], 0
    while i < len(md):
        j = i
        if md[i].isdigit():
            while j < len(md) and md[j].isdigit():
                j += 1
            tokens += ["="] * int(md[i:j])
        elif md[i] == "^":
            j += 1
            while j < len(md) and md[j].isalpha():
                j += 1
                tokens.append("D")
        else:
            while j < len(md) and md[j].isalpha():
                j += 1
                tokens.append("X")
        i = j
    out, at = "", 0
    for n, op in ops:
        if op in "MD":
            out += "".join(tokens[at : at + n])
            at += n
        elif op in "INS":
            out += op * n
    return out


def random_alignment(rng):
    ops, md, run = [], "", 0
    if rng.random() < 0.3:
        ops.append((rng.randint(1, 5), "S"))
    for k in range(rng.randint(1, 4)):
        n = rng.randint(1, 8)
        ops.append((n, "M"))
        for _ in range(n):
            if rng.random() < 0.25:
                md += f"{run}{rng.choice('ACGT')}"
                run = 0
            else:
                run += 1
        kind = rng.choice("ID-N")
        if kind == "D":
            m = rng.randint(1, 3)
            ops.append((m, "D"))
            md += f"{run}^{''.join(rng.choices('ACGT', k=m))}"
            run = 0
            md += "0" if rng.random() < 0.5 else ""
        elif kind in "IN":
            ops.append((rng.randint(1, 3), kind))
    if ops[-1][1] in "DIN":
        ops.append((1, "M"))
        run += 1
    md += str(run)
    if rng.random() < 0.3:
        ops.append((rng.randint(1, 5), "S"))
    if rng.random() < 0.2:
        ops.append((2, "H"))
    return ops, md


def test_transcripts_of_random_alignments(spark):
    rng = random.Random(1)
    cases = [random_alignment(rng) for _ in range(500)]
    rows = [(i, "".join(f"{n}{o}" for n, o in ops), md) for i, (ops, md) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, c string, md string")
    got = {r["i"]: r for r in df.select("i", cigar.edit_transcript(F.col("c"), F.col("md")).alias("t"), cigar.left_clip(cigar.runs(F.col("c"))).alias("l"), cigar.right_clip(cigar.runs(F.col("c"))).alias("r")).collect()}
    for i, (ops, md) in enumerate(cases):
        assert got[i]["t"] == restated_transcript(ops, md)
        assert got[i]["l"] == (ops[0][0] if ops[0][1] == "S" else 0)
        assert got[i]["r"] == (ops[-1][0] if len(ops) > 1 and ops[-1][1] == "S" else 0)


def test_extended_cigar(spark):
    assert one(spark, cigar.edit_transcript(F.lit("2S3=1X2I1D2="), F.lit(None).cast("string"))) == "SS===XIID=="
    with pytest.raises(Exception, match="not allowed"):
        one(spark, cigar.edit_transcript(F.lit("3=2M"), F.lit("5")))
    with pytest.raises(Exception, match="not allowed"):
        one(spark, cigar.edit_transcript(F.lit("3M2P"), F.lit("5")))


def test_positions_keep_the_known_shortfall(spark):
    x = F.lit("SS==XID=")
    assert one(spark, cigar.ref_length(x)) == 7
    assert one(spark, cigar.rpos(F.lit(100), x)) == 100 + 4 - 1
    assert one(spark, cigar.rpos(F.lit(100), x, exact=True)) == 100 + 5 - 1


def test_fragment_is_clamped_and_ties_put_mate_2_upstream(spark):
    f = lambda *a, **k: one(spark, cigar.fragment_length(*map(F.lit, a), **k))
    assert f(10, 8, 20, 50, 50, 60) == 53
    assert f(50, 50, 60, 10, 8, 20) == 53
    assert f(10, 9, 30, 10, 7, 40) == 30 - 7 + 1
    assert f(10, 8, 20, 5000, 5000, 6000, most=500) == 500
    assert f(10, 100, 20, 50, 50, 60) == 0


def test_quality_totals(spark):
    qual = "".join(chr(33 + q) for q in [10, 20, 30, 40, 50, 60, 70])
    v = one(spark, cigar.quality_totals(F.lit(qual), F.lit(2), F.lit(1)))
    assert (v["aligned"], v["clipped"]) == (30 + 40 + 50, 10 + 20 + 60 + 70)
    assert v["avg_aligned"] == 120 / 4 and v["avg_clipped"] == 160 / 3
    v = one(spark, cigar.quality_totals(F.lit(qual), F.lit(1), F.lit(0)))
    assert (v["clipped"], v["avg_clipped"], v["left"], v["right"]) == (0, 100.0, 0, 0)
    assert one(spark, cigar.quality_totals(F.lit(qual), F.lit(2), F.lit(1), exact=True))["aligned"] == 30 + 40 + 50 + 60


def test_tags(spark):
    t = F.array(F.lit("NM:i:1"), F.lit("ZT:Z:-3,NA,1.5,NaN"), F.lit("XA:Z:1,2"))
    assert one(spark, tags.numbers(tags.tag(t, tags.FEATURES))) == [-3.0, None, 1.5, None]
    assert one(spark, tags.tag(t, "QQ:Z:")) is None
    assert one(spark, tags.drop(t, tags.FEATURES)) == ["NM:i:1", "XA:Z:1,2"]


NAMES = [
    ("sim!:chr1:+:100:-5:u", 0, "chr1", 101, 1), ("sim!:chr1:+:100:-5:u", 16, "chr1", 101, 0), ("sim!:chr1:+:100:-5:u", 0, "chr2", 101, 0),
    ("sim!:chr1:+:100:-5:u", 0, "chr1", 101 + 29, 1), ("sim!:chr1:+:100:-5:u", 0, "chr1", 101 + 30, 0),
    ("sim!:c:+:100:1:longname:-:300:2:c", 1 + 64, "c", 101, 1), ("sim!:c:+:100:1:longname:-:300:2:c", 1 + 128 + 16, "longname", 301, 1), ("sim!:c:+:100:1:longname:-:300:2:c", 1 + 128, "longname", 301, 0),
    ("11_25006153_25006410_0:0:0_0:0:0_100_100_1_1/1", 64, "11", 25006311, 1), ("11_25006153_25006410_0:0:0_0:0:0_100_100_0_1/1", 64, "11", 25006153, 1),
    ("11_25006153_25006410_0:0:0_0:0:0_100_100_0_1/2", 128, "11", 25006311, 1), ("a_b_10_400_0:0:0_0:0:0_100_90_0_7/1", 64, "a_b", 12, 1), ("a_b_10_400_0:0:0_0:0:0_100_90_0_7/1", 64, "a", 12, 0),
    ("plain", 0, "c", 1, -1),
]


def test_correctness_by_names(spark):
    df = spark.createDataFrame([(i, *n) for i, n in enumerate(NAMES)], "i int, q string, f int, r string, p long, want int")
    got = df.select("i", "want", readnames.correctness(F.col("q"), F.col("f"), F.col("r"), F.col("p")).alias("got")).collect()
    assert [r["i"] for r in got if r["got"] != r["want"]] == []


def test_confidence(spark):
    assert one(spark, confidence.pcor_to_mapq(F.lit(0.999))) == pytest.approx(30)
    assert one(spark, confidence.pcor_to_mapq(F.lit(1.0))) == math.inf
    assert one(spark, confidence.mapq_to_pcor(F.lit(20.0))) == pytest.approx(0.99)
    assert one(spark, confidence.round_pcor(F.lit(0.9))) == pytest.approx(0.9)
    assert one(spark, confidence.clamp(F.lit(1.5))) == 0.999999


def test_bases(spark):
    assert one(spark, bases.normalise(F.lit("acgtRyN-x"))) == "ACGTNNNNN"
    assert one(spark, bases.reverse_complement(F.lit("ACGTRYKMBDHVSWN-"))) == "-NWSBDHVKMRYACGT"


def test_flags(spark):
    f = F.lit(1 + 2 + 16 + 128)
    assert [one(spark, x(f)) for x in (flags.is_aligned, flags.is_forward, flags.is_concordant, flags.is_paired, flags.mate_flag, flags.is_primary)] == [True, False, True, True, "2", True]


def test_stacked(spark):
    v = one(spark, cigar.stacked(cigar.runs(F.lit("2S3M1I2M2D1M")), F.lit("1A3^GT1"), F.lit("NNACGTTTA")))
    assert (v["read"], v["ref"]) == ("ACGTTT--A", "AAG-TTGTA")
