"""FASTA records as overlapping chunks, without building a whole record."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phredloom.functions.bases import normalise
from phredloom.sources.sam import before, text_blocks, with_file

CHUNK = 131_072


def chunk_starts(length: Column, chunk: int, overlap: int) -> Column:
    """Offsets of the chunks of a sequence: every ``chunk - overlap`` bases, until one reaches the end."""
    step = chunk - overlap
    return F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil((length - chunk) / step) * step).cast("long"), F.lit(step).cast("long"))


def chunks_of(records: DataFrame, chunk: int = CHUNK, overlap: int = 0) -> DataFrame:
    """Chunks of a table (refid, refid_full, seq) of whole sequences."""
    chunk = max(chunk, 2 * overlap)
    starts = chunk_starts(F.length("seq"), chunk, overlap)
    pieces = F.transform(starts, lambda at: F.struct(at.alias("refoff"), F.substring("seq", (at + 1).cast("int"), F.lit(chunk)).alias("piece")))
    rows = records.filter(F.length("seq") > 0).select("refid", "refid_full", F.inline(pieces))  # the pieces leave, the sequence does not
    return rows.select("refid", "refid_full", "refoff", F.length("piece").alias("retsz"), normalise(F.col("piece")).alias("seq"))


_ALONG = "path string, block long, m long, raw string, header boolean, end long, record long, refid_full string, at long"


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running sums of line lengths along a file block (``end``), and the record that is open: its id, name and place (``at``)."""
    here, total, opened = None, 0, (None, None, None)
    for b in batches:
        names, blocks = b.column(0).to_pylist(), b.column(1).to_pylist()
        cuts = [0, *(i for i in range(1, b.num_rows) if blocks[i] != blocks[i - 1] or names[i] != names[i - 1]), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo == hi:
                continue
            if (names[lo], blocks[lo]) != here:
                here, total, opened = (names[lo], blocks[lo]), 0, (None, None, None)
            part = b.slice(lo, hi - lo)
            m, raw = part.column(2).to_numpy(), part.column(3)
            header = pc.starts_with(raw, ">").to_numpy(zero_copy_only=False)
            end = total + np.cumsum(np.where(header, 0, pc.utf8_length(raw).to_numpy(zero_copy_only=False))).astype(np.int64)
            last = np.maximum.accumulate(np.where(header, np.arange(1, hi - lo + 1), 0))  # 0: the one open before this part
            heads = np.flatnonzero(header)
            of = np.searchsorted(heads, last - 1)
            names_of = [t[1:] for t in raw.take(pa.array(heads)).to_pylist()]
            cols = zip(opened, (m[heads].tolist(), names_of, end[heads].tolist()), (pa.int64(), pa.string(), pa.int64()), strict=True)
            found = [pa.array([first, *rest], kind).take(pa.array(np.where(last > 0, of + 1, 0))) for first, rest, kind in cols]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(header), pa.array(end), *found], names=[x.split()[0] for x in _ALONG.split(", ")])
            total, opened = int(end[-1]), tuple(f[-1].as_py() for f in found)


def lines_with_offsets(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Sequence lines with their record (the row id of its header) and offset in it.

    Running sums of line lengths are kept per file block, inside the task that
    reads it; the totals of earlier blocks, and the record that is open where a
    block starts, come from one summary row a block. No text is moved, and no
    task holds a file.
    """
    raw, near = text_blocks(spark, paths)
    inside = raw.withColumn("raw", F.trim("raw")).filter("raw <> ''").mapInArrow(_along, _ALONG)
    opened = F.when(F.col("record").isNotNull(), F.struct("record", "refid_full", "at"))
    last = with_file(inside.groupBy("path", "block").agg(F.max("end").alias("total"), F.max_by(opened, "m").alias("open")))
    last = last.withColumn("start", F.coalesce(F.sum("total").over(before()), F.lit(0)))
    placed = F.when(F.col("open").isNotNull(), F.struct("open.record", "open.refid_full", (F.col("start") + F.col("open.at")).alias("at")))
    carried = last.withColumn("placed", placed).select("path", "block", "file", "start", F.last("placed", ignorenulls=True).over(before()).alias("carry"))
    out = inside.filter(~F.col("header")).join(F.broadcast(carried) if near else carried, ["path", "block"])
    own = F.when(F.col("record").isNotNull(), F.struct("record", "refid_full", (F.col("start") + F.col("at")).alias("at"))).otherwise(F.col("carry"))
    out = out.withColumn("r", own).filter("r is not null")
    return out.select(
        "file", "r.record", "r.refid_full", F.regexp_extract("r.refid_full", r"^(\S*)", 1).alias("refid"), (F.col("start") + F.col("end") - F.length("raw") - F.col("r.at")).alias("off"), "raw"
    )


def read_fasta(spark: SparkSession, paths: str | list[str], chunk: int = CHUNK, overlap: int = 0) -> DataFrame:
    """``refid``, ``refid_full``, ``refoff``, ``retsz``, ``seq``: each line goes to the chunks that it touches, and chunks are put together there.

    A chunk after the first holds more than the overlap, or the one before would
    have reached the end: what is put together tells it, and no record's size is needed.
    """
    chunk = max(chunk, 2 * overlap)
    step = chunk - overlap
    lines = lines_with_offsets(spark, paths)
    low = F.greatest(F.lit(0), F.floor((F.col("off") - chunk) / step) + 1).cast("long")
    high = F.floor((F.col("off") + F.length("raw") - 1) / step).cast("long")
    touched = lines.withColumn("k", F.explode(F.sequence(low, high))).withColumn("refoff", F.col("k") * step)
    a = F.greatest(F.lit(0), F.col("refoff") - F.col("off"))
    b = F.least(F.length("raw"), F.col("refoff") + chunk - F.col("off"))
    parts = touched.filter(b > a).select("file", "record", "refid", "refid_full", "refoff", "off", F.substring("raw", (a + 1).cast("int"), (b - a).cast("int")).alias("part"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("off", "part"))), lambda x: x["part"]), "")
    out = parts.groupBy("file", "record", "refid", "refid_full", "refoff").agg(normalise(whole).alias("seq"))
    out = out.filter((F.col("refoff") == 0) | (F.length("seq") > overlap))
    return out.select("refid", "refid_full", "refoff", F.length("seq").alias("retsz"), "seq")


def size_estimate(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row: total bytes of the files."""
    files = spark.read.format("binaryFile").load(paths).select("path", "length").distinct()
    return files.agg(F.sum("length").alias("bytes"))
