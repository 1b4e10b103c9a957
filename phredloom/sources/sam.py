"""SAM text: line-numbered scan, record fields, parsed alignments, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from phredloom.functions import cigar as C
from phredloom.functions import flags, readnames, tags
from phredloom.session import size


BROADCAST_BLOCKS = 500_000  # rows of file blocks that are broadcast: a path, two numbers


def text_size(spark: SparkSession, paths: str | list[str]) -> int:
    """Bytes of the files, or of what is in the folders, as they are stored."""
    conf, total = spark.sparkContext._jsc.hadoopConfiguration(), 0
    for name in [paths] if isinstance(paths, str) else paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(name)
        total += sum(f.getLen() for f in at.getFileSystem(conf).globStatus(at) or [] if f.isFile()) or size(spark, name)
    return total


def text_blocks(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, bool]:
    """``path``, ``block`` (where the file block starts), ``m`` (a row id that grows along a block), ``raw``; and whether a row a block may be broadcast.

    Rows of a block are consecutive in one task. The number of blocks follows
    from the sizes of the files and how Spark splits them.
    """
    text, total = spark.read.text(paths), text_size(spark, paths)
    split = min(_bytes(spark, "spark.sql.files.maxPartitionBytes"), max(_bytes(spark, "spark.sql.files.openCostInBytes"), total // spark.sparkContext.defaultParallelism))
    blocks = len(text.inputFiles()) + total // max(1, split)
    cols = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"), F.regexp_replace("value", "\r$", "").alias("raw")]
    return text.select(*cols), blocks <= BROADCAST_BLOCKS


def _bytes(spark: SparkSession, key: str) -> int:
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))


PART = "/part-([0-9]+)[^/]*$"


def before() -> WindowSpec:
    """The blocks of the file that come before one."""
    return Window.partitionBy("file").orderBy("part", "path", "block").rowsBetween(Window.unboundedPreceding, -1)


def with_file(blocks: DataFrame) -> DataFrame:
    """Blocks with ``file`` and ``part``: the parts that Spark wrote to one folder (part-00000 and so on) are one file, in order of their numbers; any other path is a file by itself."""
    return blocks.withColumn("file", F.regexp_replace("path", PART, "")).withColumn("part", F.regexp_extract("path", PART, 1).try_cast("long"))


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file``, ``line`` (from 1 in each file), ``raw``: without gathering a file anywhere, and without moving text.

    Lines are counted per file block; a block's offset is the running sum of the
    counts before it, and comes back by a broadcast of one row a block. The row id
    minus the block's smallest row id is the place within the block.
    """
    raw, near = text_blocks(spark, paths)
    blocks = with_file(raw.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("first")))
    offsets = blocks.select("path", "block", "file", "first", F.coalesce(F.sum("n").over(before()), F.lit(0)).alias("offset"))
    return raw.join(F.broadcast(offsets) if near else offsets, ["path", "block"]).select("file", (F.col("m") - F.col("first") + F.col("offset") + 1).alias("line"), "raw")


def read_sam(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Every line of one or several SAM files with ``is_header``."""
    return numbered_lines(spark, paths).withColumn("is_header", F.col("raw").startswith("@"))


def fields(lines: DataFrame) -> DataFrame:
    """Record fields of the lines that are no headers (tlen is not used)."""
    f = F.split("raw", "\t")
    t = lines.filter(~F.col("is_header")).withColumn("_f", f)
    col = lambda i: F.get("_f", F.lit(i))
    return t.select(
        "file", "line", col(0).alias("qname"), col(1).try_cast("int").alias("flag"), col(2).alias("rname"), col(3).try_cast("long").alias("pos"), col(4).try_cast("int").alias("mapq"),
        col(5).alias("cigar"), col(6).alias("rnext"), col(7).try_cast("int").alias("pnext"), col(9).alias("seq"), F.length(col(9)).alias("len"), col(10).alias("qual"),
        F.slice("_f", F.lit(12), F.greatest(F.lit(0), F.size("_f") - 11)).alias("tags"),
    )


def primary(records: DataFrame) -> DataFrame:
    return records.filter(flags.is_primary(F.col("flag")))


def alignments(records: DataFrame, wiggle: int = 30, prefix: str = readnames.PREFIX, strict: bool = True) -> DataFrame:
    """Parsed primary records. With ``strict``, an aligned record without features, or without MD:Z and extended CIGAR, is an error."""
    r = primary(records).withColumn("mdz", tags.tag(F.col("tags"), tags.MISMATCHES)).withColumn("zt", tags.tag(F.col("tags"), tags.FEATURES))
    aligned = flags.is_aligned(F.col("flag"))
    if strict:
        r = r.withColumn("zt", F.when(aligned & F.col("zt").isNull(), F.raise_error(F.lit("aligned record without ZT:Z")).cast("string")).otherwise(F.col("zt")))
    ops = C.runs(F.col("cigar"))
    r = r.withColumn("ops", F.when(aligned, ops))
    described = F.col("mdz").isNotNull() | C.is_extended(F.col("cigar"))
    lost = F.raise_error(F.lit("aligned record with neither MD:Z nor = and X")).cast("string") if strict else F.lit(None).cast("string")
    xscript = F.when(aligned, F.when(described, C.edit_transcript(F.col("cigar"), F.col("mdz"), F.col("ops"))).otherwise(lost))
    r = r.select(
        "*", xscript.alias("edit_xscript"), tags.numbers(F.col("zt")).alias("ztz"), flags.mate_flag(F.col("flag")).alias("mate_flag"), readnames.simulated_type(F.col("qname"), prefix).alias("typ"),
        C.left_clip(F.col("ops")).alias("lclip0"), C.right_clip(F.col("ops")).alias("rclip0"),
    )
    q = C.quality_totals(F.col("qual"), F.col("lclip0"), F.col("rclip0"))
    r = r.withColumn("q", F.when(aligned, q))
    return r.select(
        "file", "line", "qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "seq", "len", "qual", "mdz", "ztz", F.get("ztz", F.lit(0)).cast("int").alias("best_score"),
        F.coalesce("q.left", F.lit(0)).alias("left_clip"), F.coalesce("q.right", F.lit(0)).alias("right_clip"), F.col("q.aligned").alias("tot_aligned_qual"), F.col("q.clipped").alias("tot_clipped_qual"),
        F.col("q.avg_aligned").alias("avg_aligned_qual"), F.col("q.avg_clipped").alias("avg_clipped_qual"), "edit_xscript", "typ", "mate_flag",
        F.when(aligned, readnames.correctness(F.col("qname"), F.col("flag"), F.col("rname"), F.col("pos"), wiggle, prefix)).otherwise(-1).alias("correct"),
    )


def any_record(lines: DataFrame) -> bool:
    """Whether there is a line other than headers."""
    return not lines.filter(~F.col("is_header")).isEmpty()


def counts() -> list[Column]:
    """Aggregates over lines: all, headers, secondary, supplementary, unaligned. For an aggregate, or for ``observe`` of lines that are read anyway."""
    flag: Column = F.get(F.split("raw", "\t"), F.lit(1)).try_cast("int")
    record = ~F.col("is_header")
    return [
        F.count(F.lit(1)).alias("n_lines"), F.count_if("is_header").alias("n_headers"), F.count_if(record & flags.has(flag, flags.SECONDARY)).alias("n_secondary"),
        F.count_if(record & flags.has(flag, flags.SUPPLEMENTARY)).alias("n_supplementary"), F.count_if(record & flags.has(flag, flags.UNMAPPED)).alias("n_unaligned"),
    ]


def counters(lines: DataFrame) -> DataFrame:
    """One row: ``counts`` of the lines."""
    return lines.agg(*counts())
