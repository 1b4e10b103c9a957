"""Feature-table preparation: imputation, useless columns, collapse, subsampling."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phredloom.operators.running import numbered

NOT_FEATURES = ["id", "file", "correct", "rname", "category"]
BROADCAST_CHUNKS = 20_000  # rows of imputation constants that are broadcast: some MB


def impute(df: DataFrame, cols: list[str], by: str = "category", chunk_rows: int = 0) -> DataFrame:
    """Null becomes the column's maximum + 1 (0 if all are null), per ``by``.

    One partial aggregate gives the constants, a row per category, which are
    broadcast. With ``chunk_rows`` there is a row per chunk of so many rows in
    order of id; places come from ranges, not from a window over a category, and
    the constants are broadcast only if there are at most ``BROADCAST_CHUNKS``.
    """
    keys, rest, near = [by], df.columns, True
    if chunk_rows:
        df = numbered(df, [F.asc(by), F.asc("id")], "_place")
        start = df.groupBy(by).agg(F.min("_place").alias("_start"), F.max("_place").alias("_end")).collect()  # a row a category
        near = sum((r["_end"] - r["_start"]) // chunk_rows + 1 for r in start) <= BROADCAST_CHUNKS
        first = F.lit(0).cast("long")
        for r in start:
            first = F.when(F.col(by).eqNullSafe(F.lit(r[by])), F.lit(r["_start"])).otherwise(first)
        df = df.withColumn("_chunk", F.floor((F.col("_place") - first) / chunk_rows))
        keys.append("_chunk")
    fill = df.groupBy(*keys).agg(*(F.coalesce(F.max(c) + 1, F.lit(0.0)).alias(f"_f_{c}") for c in cols))
    return df.join(F.broadcast(fill) if near else fill, keys).select(*(F.coalesce(c, f"_f_{c}").alias(c) if c in cols else F.col(c) for c in rest))


def varying_columns(df: DataFrame, cols: list[str]) -> list[str]:
    """Columns with more than one value: one aggregate of minima and maxima."""
    if not cols:
        return []
    row = df.agg(*(F.min(c).alias(f"a{i}") for i, c in enumerate(cols)), *(F.max(c).alias(f"b{i}") for i, c in enumerate(cols))).first()
    return [c for i, c in enumerate(cols) if row[f"a{i}"] is not None and row[f"a{i}"] != row[f"b{i}"]]


def duplicate_columns(df: DataFrame, cols: list[str]) -> set[str]:
    """Columns equal to an earlier one in every row. Only columns of equal signature are compared in full."""
    if len(cols) < 2:
        return set()
    sig = df.agg(*(F.struct(F.min(c), F.max(c), F.count(c), F.bit_xor(F.xxhash64(F.col(c)))).alias(c) for c in cols)).first()
    alike = [(x, y) for x, y in itertools.combinations(cols, 2) if sig[x] == sig[y]]
    if not alike:
        return set()
    row = df.agg(*(F.every(F.col(x).eqNullSafe(F.col(y))).alias(f"p{i}") for i, (x, y) in enumerate(alike))).first()
    return {y for i, (_, y) in enumerate(alike) if row[f"p{i}"]}


def feature_columns(df: DataFrame, include_mapq: bool = False) -> list[str]:
    """Columns to train on; an error if nothing varies."""
    skip = [*NOT_FEATURES, *([] if include_mapq else ["mapq"])]
    cols = varying_columns(df, [c for c in df.columns if c not in skip])
    gone = duplicate_columns(df, cols)
    out = [c for c in cols if c not in gone]
    if not out:
        raise ValueError("all training records are identical")
    return out


def check_columns(df: DataFrame, cols: list[str], rows: Column | None = None) -> DataFrame:
    """``df`` with an error on a missing column, or at run time on a null, NaN or infinite feature (of ``rows``, by default all)."""
    if missing := [c for c in cols if c not in df.columns]:
        raise ValueError(f"columns in training data, but not here: {missing}")
    bad = F.lit(False)
    for c in cols:
        bad = bad | F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))
    bad = bad if rows is None else rows & bad
    return df.filter(F.when(bad, F.raise_error(F.lit("a feature is missing or not finite")).cast("boolean")).otherwise(F.lit(True)))


def collapse(df: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct feature rows with ``n_rows``."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n_rows"))


def expand(df: DataFrame, collapsed: DataFrame, cols: list[str]) -> DataFrame:
    """Rows of ``df`` with what ``collapsed`` says of their feature row (null-safe)."""
    c = collapsed.select(*(F.col(x).alias(f"_c_{x}") for x in cols), *(x for x in collapsed.columns if x not in cols))
    on = F.lit(True)
    for x in cols:
        on = on & F.col(x).eqNullSafe(F.col(f"_c_{x}"))
    return df.join(c, on).drop(*(f"_c_{x}" for x in cols))


def sample_order(seed: int, *ids: str):
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(i).cast("string") for i in ids)))


def subsample(df: DataFrame, fraction: float, seed: int, ids: tuple[str, ...] = ("id",)) -> DataFrame:
    """Exactly round(n * fraction) rows, those of the smallest seeded hash.

    Counts by the first four digits of the hash (65,536 at most) tell which
    rows are in for certain; only the digits at the limit are sorted.
    """
    if fraction >= 1:
        return df
    d = df.withColumn("_h", sample_order(seed, *ids)).withColumn("_p", F.substring("_h", 1, 4))
    counts = sorted((r["_p"], r["count"]) for r in d.groupBy("_p").count().collect())
    left = round(sum(n for _, n in counts) * fraction)
    edge = ""
    for edge, n in counts:
        if n > left:
            break
        left -= n
    else:
        return df
    return d.filter(F.col("_p") < edge).unionByName(d.filter(F.col("_p") == edge).orderBy("_h", *ids).limit(left)).select(*df.columns)


PREFIX_DIGITS = 3  # of the hash: 4,096 counts a group; what is sorted is the rows of the few prefixes where a sample ends


def _smallest(d: DataFrame, groups: list[str], ids: tuple[str, ...], wanted: Callable[[int], list[tuple[float, int]]]) -> DataFrame:
    """Rows of ``d`` (with ``_h``, their hash) that are among the smallest of their group, with ``_tag`` of the first sample that holds them.

    ``wanted`` gives a group's samples, smallest first, as (tag, rows) for its
    number of rows. Counts by hash prefix say in which prefix a sample ends; the
    rows of those prefixes alone are ranked, and give the last hash that is in. All
    else is a comparison with it: rows are neither shuffled nor sorted.
    """
    spark, cols = d.sparkSession, d.columns
    d = d.withColumn("_p", F.substring("_h", 1, PREFIX_DIGITS)).withColumn("_g", F.to_json(F.struct(*groups)))  # text: null groups join too
    d = d.withColumn("_k", F.struct("_h", *ids))
    counts: dict[str, list[tuple[str, int]]] = {}
    for g, p, n in d.groupBy("_g", "_p").count().collect():
        counts.setdefault(g, []).append((p, n))
    ends, limits = [], []
    for g, parts in counts.items():
        total = sum(n for _, n in parts)
        for tag, rows in wanted(total):
            left = rows
            for p, n in sorted(parts):
                if left <= n:
                    break
                left -= n
            if rows >= total:
                limits.append((g, float(tag), None))
            elif left > 0:
                ends.append((g, p, left, float(tag)))
    at = spark.createDataFrame(ends, "_g string, _p string, _rank long, _tag double")
    ranked = d.select("_g", "_p", "_k").join(F.broadcast(at.select("_g", "_p").distinct()), ["_g", "_p"])
    ranked = ranked.withColumn("_rank", F.row_number().over(Window.partitionBy("_g", "_p").orderBy("_k")).cast("long"))
    limits += [tuple(r) for r in ranked.join(F.broadcast(at), ["_g", "_p", "_rank"]).select("_g", "_tag", "_k").collect()]  # a row a sample and group
    kind = T.StructType([T.StructField("_g", T.StringType()), T.StructField("_tag", T.DoubleType()), T.StructField("_last", d.schema["_k"].dataType)])
    table = spark.createDataFrame(limits, kind).groupBy("_g").agg(F.array_sort(F.collect_list(F.struct("_tag", "_last"))).alias("_limits"))
    first = F.get(F.filter("_limits", lambda x: x["_last"].isNull() | (F.col("_k") <= x["_last"])), F.lit(0))["_tag"]
    return d.join(F.broadcast(table), "_g").select(*cols, first.alias("_tag")).filter("_tag is not null")


def nested_samples(df: DataFrame, fractions: list[float], seeds: list[int], ids: tuple[str, ...] = ("id",), by: str | None = None) -> DataFrame:
    """Rows of ``df`` for each seed with ``seed`` and ``fraction``, the smallest of ``fractions`` whose sample holds the row.

    The sample of a fraction is exactly that of ``subsample`` (with ``by``: of each
    group), so samples of one seed are nested: rows with ``fraction <= f`` are that of
    f. One table serves a whole series of trials.
    """
    some = sorted(set(fractions))
    d = df.withColumn("seed", F.explode(F.array(*(F.lit(s).cast("long") for s in seeds))))
    d = d.withColumn("_h", F.md5(F.concat_ws(":", F.col("seed").cast("string"), *(F.col(i).cast("string") for i in ids))))
    out = _smallest(d, [*([by] if by else []), "seed"], ids, lambda n: [(f, round(n * f) if f < 1 else n) for f in some])
    return out.select(*df.columns, "seed", F.col("_tag").alias("fraction"))


def reservoir(df: DataFrame, k: int, seed: int, by: str = "category", ids: tuple[str, ...] = ("id",)) -> DataFrame:
    """A uniform sample of at most ``k`` rows for each ``by`` (the k smallest seeded hashes), whatever ``k`` and the number of rows."""
    d = df.withColumn("_h", sample_order(seed, *ids))
    return _smallest(d, [by], ids, lambda n: [(1.0, k)]).select(*df.columns)


def union_chunks(chunks: list[DataFrame]) -> DataFrame:
    out = chunks[0]
    for c in chunks[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out
