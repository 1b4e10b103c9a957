"""Target-distribution importance resampling over hashed word runs.

One scan of each text lower-cases A-Z, takes words (digits, letters, every
character from 0x80 on) and keeps a ring of running zlib states, one for each
of the last ``n`` word starts: a word extends every open state by a space and
itself and opens one more. Each state after each word is a feature's CRC, so
runs of 1 to ``n`` words are hashed without being built. The scan gives a
document's buckets, a narrow table from which everything else is read.

A bucket's gain is the log ratio of its smoothed shares in the target and in
the documents; a document's weight is the sum of its features' gains. Adding
seeded Gumbel noise to the weights and keeping the highest scores draws
without replacement in proportion to exp(weight / 1000).

Counts of buckets are added up inside a task before they are shuffled; what
the driver sees is one count a bucket (``buckets``, a parameter) and one row a
range. Places come from ranges of the order, not from one window.

Defined results: a null or wordless text has no features, weight 0, and is
never drawn unless ``least_words`` is 0; texts are read whole; repeated rows
are scored alike and drawn each for itself; a null doc_id is hashed as an empty
one and stands before the others of its score; rows equal in score and doc_id
are interchangeable; an empty target gives every feature the gain that its
smoothed shares imply; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phredloom.llm.common import materialize, slices, tidy
from phredloom.operators.running import numbered

#: A-Z lower-cased, other ASCII than digits and letters a space; bytes of longer characters stay.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORDS).split()


def run_hashes(ws: list[bytes], n: int) -> list[int]:
    """CRC of every run of 1 to ``n`` consecutive words joined by a space, in order of the run's last word."""
    ring: list[int] = []  # running states of the last n starts, oldest first
    out: list[int] = []
    for w in ws:
        more = b" " + w
        ring = [crc32(more, state) for state in ring]
        ring.append(crc32(w))
        out += ring
        if len(ring) == n:
            del ring[0]
    return out


def features(texts: DataFrame, keep: list[str], n: int = 1, buckets: int = 10_000) -> DataFrame:
    """``keep`` columns, ``n_words`` and ``buckets``: one bucket a feature, repeats included."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            counts, hashes, ends = [], [], [0]
            for t in part.column(len(keep)).cast(pa.binary()).to_pylist():
                ws = words(t)
                counts.append(len(ws))
                hashes.append((np.array(run_hashes(ws, n), dtype=np.uint32) % np.uint32(buckets)).astype(np.int32))
                ends.append(ends[-1] + len(hashes[-1]))
            flat = np.concatenate(hashes) if hashes else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(counts, pa.int64()), lists], names=[*keep, "n_words", "buckets"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.select(*keep).schema)
    return texts.select(*keep, "text").mapInArrow(tidy(scan), f"{kinds + ', ' if kinds else ''}n_words long, buckets array<int>")


def bucket_counts(table: DataFrame, buckets: int) -> DataFrame:
    """``bucket``, ``n``: a task adds up its own rows first and gives at most one row a bucket."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            total += np.bincount(b.column(0).flatten().to_numpy(), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])

    return table.select("buckets").mapInArrow(add, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down, for every bucket."""
    all_s, all_t = sum(corpus.values()) + buckets, sum(target.values()) + buckets
    ratio = (((target.get(b, 0) + 1) * all_s) / ((corpus.get(b, 0) + 1) * all_t) for b in range(buckets))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], dtype=np.int64)


def weighed(table: DataFrame, gain: np.ndarray) -> DataFrame:
    """Rows of ``features`` with ``n_features`` and ``weight`` in place of the buckets."""
    keep = [c for c in table.columns if c != "buckets"]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(len(keep))
            n = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
            sums = np.concatenate([[0], np.cumsum(gain[lists.flatten().to_numpy()])])
            end = np.cumsum(n)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(n), pa.array(sums[end] - sums[end - n])], names=[*keep, "n_features", "weight"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.select(*keep).schema)
    return table.select(*keep, "buckets").mapInArrow(weigh, f"{kinds}, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from the first 32 bits of the id's seeded hash."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """``doc_id``, ``n_features``, ``weight``, ``score``, ``rank`` (null: not drawn) for every row of ``docs``.

    ``percent`` of the rows with at least ``least_words`` words are drawn, rounded down.
    """
    text = F.coalesce("text", F.lit("")).alias("text")
    table = materialize(features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text), ["doc_id"], n, buckets))
    corpus = dict(map(tuple, bucket_counts(table, buckets).collect()))  # at most a row a bucket
    wanted = dict(map(tuple, bucket_counts(features(target.select(text), [], n, buckets), buckets).collect()))
    rows = weighed(table, gains(corpus, wanted, buckets))
    rows = materialize(rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("row", F.monotonically_increasing_id()))
    out = ["doc_id", "n_features", "weight", "score"]
    may = F.col("n_words") >= least_words
    placed = numbered(rows.filter(may).select(*out, "row"), [F.desc("score"), F.asc("doc_id"), F.asc("row")])
    drawn = rows.filter(may).count() * percent // 100
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")
    return placed.select(*out, rank).unionByName(rows.filter(~may).select(*out, F.lit(None).cast("long").alias("rank")))
