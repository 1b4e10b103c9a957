"""Mates, categories, simulated-type filter, features, templates, counters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phredloom.functions import cigar as C
from phredloom.functions import flags
from phredloom.session import partitions

TASK_ROWS = 250_000  # records whose mates one task looks up: a row takes about a kilobyte there


def pair_mates(records: DataFrame, key: list[str] | None = None, order: str = "line", mate: str = "mate_flag", strict_adjacent: bool = False) -> DataFrame:
    """``a1``, ``a2``: first and second ends with the same key, joined by their ordinal in it.

    ``key`` defaults to (file, qname). With ``strict_adjacent`` a pair whose
    records are not next to each other in ``order`` is an error.
    """
    key = key or ["file", "qname"]
    nth = F.row_number().over(Window.partitionBy(*key, mate).orderBy(order))
    n = partitions(records.sparkSession, -(-records.count() // TASK_ROWS))
    r = records.filter(F.col(mate).isin("1", "2")).repartition(*n, *key).withColumn("_nth", nth)  # one shuffle, for the ordinals and for the pairs
    whole = F.struct(*records.columns)
    ends = (F.first(F.when(F.col(mate) == m, whole), ignorenulls=True).alias(f"a{m}") for m in ("1", "2"))
    out = r.groupBy(*key, "_nth").agg(*ends).filter("a1 is not null and a2 is not null").select("a1", "a2")
    if strict_adjacent:
        gap = F.abs(F.col(f"a1.{order}") - F.col(f"a2.{order}"))
        out = out.withColumn("a1", F.when(gap == 1, F.col("a1")).otherwise(F.raise_error(F.lit("mates are not adjacent")).cast(out.schema["a1"].dataType)))
    return out


def category_of_pair(flag1: Column, flag2: Column) -> Column:
    """b: one end aligned; c: both and proper; d: both, not proper; null: neither."""
    x, y = flags.is_aligned(flag1), flags.is_aligned(flag2)
    return F.when(x & y, F.when(flags.is_concordant(flag1), "c").otherwise("d")).when(x | y, "b")


def classify(records: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df, **pairing) -> tuple[DataFrame, DataFrame]:
    """(unpaired and bad-end alignments, pairs): each with ``category``; unaligned records go.

    A bad-end row is the aligned mate with ``opp_len``, the length of the other.
    ``keep`` may write the pairs as a table, since both results read them.
    """
    r = records.filter(~flags.is_paired(F.col("flag")) & flags.is_aligned(F.col("flag"))).withColumn("category", F.lit("u")).withColumn("opp_len", F.lit(0))
    pairs = pair_mates(records.filter(flags.is_paired(F.col("flag"))), **pairing)
    pairs = pairs.withColumn("category", category_of_pair(F.col("a1.flag"), F.col("a2.flag"))).filter("category is not null")
    pairs = keep(pairs)
    first = flags.is_aligned(F.col("a1.flag"))
    bad = pairs.filter("category = 'b'").select(F.when(first, F.col("a1")).otherwise(F.col("a2")).alias("a"), F.when(first, F.col("a2.len")).otherwise(F.col("a1.len")).alias("opp_len"))
    bad = bad.select("a.*", F.lit("b").alias("category"), "opp_len")
    return r.unionByName(bad), pairs.filter("category <> 'b'")


def type_matches(typ: Column, category: Column, mate: Column) -> Column:
    """A simulated record counts only in its own category; ``b`` also names the mate."""
    return typ.isNull() | F.when(category == "b", typ == F.concat(F.lit("b"), mate)).otherwise(typ == category)


def split_by_type(single: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(single, pairs, one row of mismatch counts) after the simulated-type filter."""
    s_ok = type_matches(F.col("typ"), F.col("category"), F.col("mate_flag"))
    p_ok = F.col("a1.typ").isNull() | (F.col("a1.typ") == F.col("category"))
    counts = single.select(F.col("category"), s_ok.alias("ok")).unionByName(pairs.select("category", p_ok.alias("ok")))
    counts = counts.groupBy("category").agg(F.count_if("ok").alias("n"), F.count_if(~F.col("ok")).alias("n_mismatch"))
    return single.filter(s_ok), pairs.filter(p_ok), counts


def unpaired_features(single: DataFrame, width: int) -> DataFrame:
    """category, file (if known), id, len, clip, alqual, clipqual, olen, ztz0.., mapq, correct."""
    file = ["file"] if "file" in single.columns else []
    z = [F.get("ztz", F.lit(i)).alias(f"ztz{i}") for i in range(width)]
    return single.select(
        "category", *file, F.col("line").alias("id"), F.col("len").cast("double").alias("len"), (F.col("left_clip") + F.col("right_clip")).cast("double").alias("clip"),
        F.col("avg_aligned_qual").alias("alqual"), F.col("avg_clipped_qual").alias("clipqual"), F.col("opp_len").cast("double").alias("olen"), *z, "mapq", "correct",
    )


def pair_fragment(most: int = 100_000) -> Column:
    """Fragment length of (a1, a2)."""

    def right(a: str) -> Column:
        return C.rpos(F.col(f"{a}.pos"), F.col(f"{a}.edit_xscript"))

    def left(a: str) -> Column:
        return C.lpos(F.col(f"{a}.pos"), F.col(f"{a}.left_clip"))

    return C.fragment_length(F.col("a1.pos"), left("a1"), right("a1"), F.col("a2.pos"), left("a2"), right("a2"), most)


def unpivot_pairs(pairs: DataFrame) -> DataFrame:
    """Two rows for each pair: own end ``a`` and opposite end ``o``."""
    both = F.array(F.struct(F.col("a1").alias("a"), F.col("a2").alias("o")), F.struct(F.col("a2").alias("a"), F.col("a1").alias("o")))
    rest = [c for c in pairs.columns if c not in ("a1", "a2")]
    return pairs.select(*rest, F.explode(both).alias("_e")).select(*rest, "_e.a", "_e.o")


def paired_features(pairs: DataFrame, width: int, most: int = 100_000) -> DataFrame:
    """category, file (if known), id, own fields, opposite fields, fraglen, mapq, correct; two rows a pair."""
    rows = unpivot_pairs(pairs.withColumn("fraglen", pair_fragment(most)))
    file = ["a.file"] if "file" in rows.schema["a"].dataType.names else []

    def side(a: str, p: str) -> list[Column]:
        clip = F.col(f"{a}.left_clip") + F.col(f"{a}.right_clip")
        return [
            F.col(f"{a}.len").cast("double").alias(f"{p}len"), clip.cast("double").alias(f"{p}clip"), F.col(f"{a}.avg_aligned_qual").alias(f"{p}alqual"), F.col(f"{a}.avg_clipped_qual").alias(f"{p}clipqual"),
        ]

    def z(a: str, p: str) -> list[Column]:
        return [F.get(f"{a}.ztz", F.lit(i)).alias(f"{p}ztz_{i}") for i in range(width)]

    return rows.select(
        "category", *file, F.col("a.line").alias("id"), *side("a", ""), *z("a", ""), *side("o", "o"), F.col("fraglen").cast("double").alias("fraglen"), *z("o", "o"), F.col("a.mapq").alias("mapq"), F.col("a.correct").alias("correct"),
    )


def feature_width(single: DataFrame, pairs: DataFrame) -> int:
    """Number of aligner features: the largest over all records."""
    a = single.select(F.size("ztz").alias("n")).unionByName(pairs.select(F.greatest(F.size("a1.ztz"), F.size("a2.ztz")).alias("n"))).agg(F.max("n")).first()[0]
    return max(0, a or 0)


def unpaired_templates(single: DataFrame) -> DataFrame:
    return single.select("category", "file", "line", "best_score", flags.is_forward(F.col("flag")).alias("fw"), "len", "mate_flag", "opp_len", "qual", "edit_xscript")


def paired_templates(pairs: DataFrame, most: int = 100_000) -> DataFrame:
    def mate(a: str) -> Column:
        return F.struct(F.col(f"{a}.best_score").alias("score"), F.col(f"{a}.len").alias("len"), flags.is_forward(F.col(f"{a}.flag")).alias("fw"), F.col(f"{a}.qual").alias("qual"), F.col(f"{a}.edit_xscript").alias("edit_xscript"))

    upstream = F.col("a1.pos") < F.col("a2.pos")
    return pairs.select(
        "category", F.col("a1.file").alias("file"), F.col("a1.line").alias("line"), (F.col("a1.best_score") + F.col("a2.best_score")).alias("score_12"), mate("a1").alias("m1"), mate("a2").alias("m2"), upstream.alias("upstream1"), pair_fragment(most).alias("fraglen"),
    )


def template_rows(templates: DataFrame) -> DataFrame:
    """Templates with the two mates' fields side by side, for a CSV sink."""
    flat = []
    for name, kind in templates.dtypes:
        if kind.startswith("struct"):
            flat += [F.col(f"{name}.{f.name}").alias(f"{name}_{f.name}") for f in templates.schema[name].dataType.fields]
        else:
            flat.append(F.col(name))
    return templates.select(*flat)
