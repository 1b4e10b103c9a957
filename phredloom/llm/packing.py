"""Length buckets of least padding, and token-budget batches inside them.

The global length histogram (a partial-aggregated count per length) has one row
a different length, at most the square root of twice all tokens. Dynamic
programming over it picks the bucket boundaries that minimise the total
padding, in exact integers; its cost is Monge, so each layer is solved by divide
and conquer.

Batches: rows stand in order of (length, id). A bucket is a run of that order, and
the histogram says where it begins, so a row's place in its bucket is its place in
the whole order less that number. Places come from ranges of the order, so no
bucket is gathered anywhere, and they do not depend on how files are laid out or
how many ranges there are.

Defined results: a null or negative length counts as 0, and a very long one is
exact; a row longer than the budget is a batch of its own; a null id is kept as
null, before the others of its length; repeated rows are packed each for itself;
rows with equal ids and lengths are interchangeable; other columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phredloom.llm.common import materialize
from phredloom.operators.running import numbered


def boundaries(lengths: np.ndarray, counts: np.ndarray, tokens: np.ndarray, n_buckets: int) -> list[int]:
    """Upper bounds of at most ``n_buckets`` buckets with the least total padding.

    ``lengths`` ascending; ``tokens`` the sum of lengths at each of them.
    """
    n = len(lengths)
    if n == 0:
        return []
    k = min(n_buckets, n)
    # exact integers: of 64 bits, or unbounded where a cost could be too large for them
    kind = np.int64 if int(lengths[-1]) * int(counts.sum(dtype=object)) < 1 << 62 else object
    c, s = (np.concatenate([np.zeros(1, kind), np.cumsum(x.astype(kind))]) for x in (counts, tokens))
    ln = lengths.astype(kind)
    best = np.zeros(n + 1, kind)
    choice = np.zeros((k + 1, n + 1), dtype=np.int64)
    for layer in range(1, k + 1):
        new = np.zeros(n + 1, kind)
        todo = [(layer, n, layer - 1, n - 1 if layer > 1 else 0)]  # the first bucket begins at the shortest
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(a, min(b, mid - 1) + 1)
            cost = best[i] + ln[mid - 1] * (c[mid] - c[i]) - (s[mid] - s[i])
            at = int(np.argmin(cost))
            new[mid], choice[layer, mid] = cost[at], i[at]
            todo += [(lo, mid - 1, a, int(i[at])), (mid + 1, hi, int(i[at]), b)]
        best = new
    out, j = [], n
    for layer in range(k, 0, -1):
        out.append(int(lengths[j - 1]))
        j = int(choice[layer, j])
    return out[::-1]


def pack(df: DataFrame, id_col: str, length_col: str, n_buckets: int = 16, token_budget: int = 16384, ranges: int | None = None) -> DataFrame:
    """Per row: id, n_tokens, bucket (from 0), bucket_len, capacity, batch_no (in its bucket), slot, padding."""
    length = F.greatest(F.coalesce(F.col(length_col), F.lit(0)), F.lit(0)).cast("long")
    rows = materialize(df.select(F.col(id_col).alias("id"), length.alias("n_tokens"), F.monotonically_increasing_id().alias("row")))
    hist = rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n"), (F.col("n_tokens") * F.count(F.lit(1))).alias("t")).orderBy("n_tokens").collect()
    bounds = boundaries(*(np.array([r[i] for r in hist], dtype=np.int64) for i in range(3)), n_buckets)
    before = [0] + [sum(r["n"] for r in hist if r["n_tokens"] <= b) for b in bounds[:-1]]
    bucket = F.lit(0)
    for b in bounds[:-1]:
        bucket = bucket + (F.col("n_tokens") > b).cast("int")

    def of_bucket(values: list[int]) -> Column:
        return F.element_at(F.array(*(F.lit(v).cast("long") for v in values or [0])), F.col("bucket") + 1)

    placed = numbered(rows, [F.asc("n_tokens"), F.asc_nulls_first("id"), F.asc("row")], "place", ranges)  # the last keeps equal rows in ranges of even size
    at = F.col("place") - 1 - of_bucket(before)
    return (
        placed.withColumn("bucket", bucket)
        .withColumn("bucket_len", of_bucket(bounds))
        .withColumn("capacity", F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(F.lit(1), F.col("bucket_len")))).cast("long"))
        .select(
            F.col("id").alias(id_col), "n_tokens", "bucket", "bucket_len", "capacity",
            ((at - F.pmod(at, F.col("capacity"))) / F.col("capacity")).cast("long").alias("batch_no"),
            F.pmod(at, F.col("capacity")).cast("long").alias("slot"),
            (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
        )
    )


def word_tokens(text: Column) -> Column:
    """Number of runs of non-space characters: the packer's default length of a text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long")
