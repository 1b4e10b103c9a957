"""Registered queries that go through files: tables are written as SAM, FASTA or FASTQ text and read by the sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phredloom.functions import bases
from phredloom.operators import calibration, pairing, prep, rewrite, simulate, truth
from phredloom.plans import run
from phredloom.plans.registry import file_number, query, read, rounded, text_files
from phredloom.session import Scratch
from phredloom.sources import fasta, fastq, matrix, sam

c = F.col


# ---------------------------------------------------------------- SAM of the orders table
# Read k (an order) stands in file k % 8, after one header line. By k % 4: unpaired,
# bad end, concordant, discordant; unpaired ones are secondary where k % 7 is 0.
def _mates(k: Column) -> Column:
    kind, pos = k % 4, k % 1000 + 100
    second = pos + 40 + k % 60

    def one(mate: int, flag: Column, at: Column, mapq: Column, aligned: Column) -> Column:
        seq = F.substring(F.lit("ACGTACGTACGTAC"), (k % 4 + 1).cast("int"), F.lit(10))
        cig = F.when(aligned, F.when(k % 3 == 0, "10M").when(k % 3 == 1, "3S7M").otherwise("4=1X5=")).otherwise("*")
        md = F.when(k % 3 == 0, "MD:Z:4A5").when(k % 3 == 1, "MD:Z:7")
        zt = F.concat(F.lit("ZT:Z:"), (-(k % 5)).cast("string"), F.lit(",NA,"), k % 11)
        rname = F.when(aligned, "chr1").otherwise("*")
        text = F.concat_ws("\t", F.concat(F.lit("r"), k), flag, rname, F.when(aligned, at).otherwise(0), F.when(aligned, mapq).otherwise(0), cig, F.lit("*"), F.lit(0), F.lit(0), seq, F.lit("IIIIIIII5+"), F.when(aligned, zt), F.when(aligned, md))
        return F.struct((k * 2 + mate - 1).alias("k"), text.alias("value"))

    yes, no = F.lit(True), F.lit(False)
    unpaired = one(1, F.when(k % 7 == 0, 256).otherwise(0) + F.when(k % 5 == 0, 16).otherwise(0), pos, k % 43, yes)
    bad1, bad2 = one(1, F.lit(1 + 8 + 64), pos, k % 43, yes), one(2, F.lit(1 + 4 + 128), pos, k % 43, no)
    proper = F.when(kind == 2, 2).otherwise(0)
    p1, p2 = one(1, 1 + proper + 64, pos, k % 43, yes), one(2, 1 + proper + 128 + 16, second, k % 37, yes)
    return F.when(kind == 0, F.array(unpaired)).when(kind == 1, F.array(bad1, bad2)).otherwise(F.array(p1, p2))


def _sam(spark: SparkSession, d: str) -> list[str]:
    k = c("o_orderkey")
    orders = read(spark, d, "orders")
    rows = orders.select((k % 8).alias("f"), F.inline(_mates(k)))
    head = spark.range(8).select(c("id").alias("f"), F.lit(-1).cast("long").alias("k"), F.lit("@SQ\tSN:chr1\tLN:2000").alias("value"))
    return text_files(head.unionByName(rows), 2 * orders.count())


# r: every record with its line; a: those that are parsed
_SAM = """r0 AS (SELECT o_orderkey AS k, 1 AS mate FROM orders UNION ALL SELECT o_orderkey, 2 FROM orders WHERE o_orderkey % 4 <> 0),
r AS (SELECT k, mate, CAST(k % 8 AS INTEGER) AS f, row_number() OVER (PARTITION BY k % 8 ORDER BY k, mate) + 1 AS line,
  CAST(CASE WHEN k % 4 = 0 THEN (CASE WHEN k % 7 = 0 THEN 256 ELSE 0 END) + (CASE WHEN k % 5 = 0 THEN 16 ELSE 0 END)
    WHEN k % 4 = 1 THEN (CASE mate WHEN 1 THEN 73 ELSE 133 END) ELSE (CASE WHEN k % 4 = 2 THEN 2 ELSE 0 END) + (CASE mate WHEN 1 THEN 65 ELSE 145 END) END AS INTEGER) AS flag,
  NOT (k % 4 = 1 AND mate = 2) AS aligned, CASE mate WHEN 1 THEN k % 1000 + 100 ELSE k % 1000 + 140 + k % 60 END AS pos, CAST(CASE WHEN mate = 2 AND k % 4 > 1 THEN k % 37 ELSE k % 43 END AS INTEGER) AS mapq FROM r0),
a AS (SELECT *, CASE WHEN k % 3 = 1 THEN 3 ELSE 0 END AS clip, CASE k % 3 WHEN 0 THEN '====X=====' WHEN 1 THEN 'SSS=======' ELSE '====X=====' END AS xs,
  CASE k % 4 WHEN 0 THEN 'u' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE 'd' END AS category,
  -- phred sums of IIIIIIII5+ : eight of 40, one of 20, one of 10; the last aligned base counts as clipped
  CASE WHEN k % 3 = 1 THEN (5 * 40 + 20) / 7.0::DOUBLE ELSE (8 * 40 + 20) / 10.0::DOUBLE END AS alqual, CASE WHEN k % 3 = 1 THEN (3 * 40 + 10) / 3.0::DOUBLE ELSE 100.0::DOUBLE END AS clipqual,
  CAST(-(k % 5) AS DOUBLE) AS z0, CAST(k % 11 AS DOUBLE) AS z2 FROM r WHERE aligned AND flag & 256 = 0)"""


@query(f"""WITH {_SAM} SELECT f, line, 'r' || k AS qname, flag, CASE WHEN aligned THEN pos ELSE 0 END AS pos, CASE WHEN aligned THEN mapq ELSE 0 END AS mapq, 10 AS len,
  CASE WHEN NOT aligned THEN 0 WHEN k % 3 = 2 THEN 1 ELSE 2 END AS n_tags FROM r""")
def q_sam_fields(spark: SparkSession, d: str) -> DataFrame:
    t = sam.fields(sam.read_sam(spark, _sam(spark, d)))
    return t.select(file_number().alias("f"), "line", "qname", "flag", "pos", "mapq", "len", F.size("tags").alias("n_tags"))


@query("""SELECT count(*) + 8 + count(*) FILTER (o_orderkey % 4 <> 0) AS n_lines, 8::BIGINT AS n_headers, count(*) FILTER (o_orderkey % 28 = 0) AS n_secondary, 0::BIGINT AS n_supplementary,
  count(*) FILTER (o_orderkey % 4 = 1) AS n_unaligned, true AS any_record FROM orders""")
def q_sam_counters(spark: SparkSession, d: str) -> DataFrame:
    lines = sam.read_sam(spark, _sam(spark, d))
    return sam.counters(lines).withColumn("any_record", F.lit(sam.any_record(lines)))


@query(f"""WITH {_SAM} SELECT f, line, xs AS edit_xscript, clip AS left_clip, 0 AS right_clip, CAST(z0 AS INTEGER) AS best_score, round(alqual, 6) AS avg_aligned_qual, round(clipqual, 6) AS avg_clipped_qual,
  CASE WHEN flag & 64 <> 0 THEN '1' WHEN flag & 128 <> 0 THEN '2' ELSE '0' END AS mate_flag, -1 AS correct FROM a""")
def q_sam_alignments(spark: SparkSession, d: str) -> DataFrame:
    a = sam.alignments(sam.fields(sam.read_sam(spark, _sam(spark, d)))).filter("edit_xscript is not null")
    return rounded(a.select(file_number().alias("f"), "line", "edit_xscript", "left_clip", "right_clip", "best_score", "avg_aligned_qual", "avg_clipped_qual", "mate_flag", "correct"))


def _classified(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return run.parsed(spark, _sam(spark, d), run.Options())


@query(f"""WITH {_SAM} SELECT category, f, line AS line1, CAST(NULL AS BIGINT) AS line2, CASE category WHEN 'b' THEN 10 ELSE 0 END AS opp_len FROM a WHERE category IN ('u', 'b')
UNION ALL SELECT x.category, x.f, x.line, y.line, NULL FROM a x JOIN a y ON x.k = y.k WHERE x.mate = 1 AND y.mate = 2""")
def q_classify(spark: SparkSession, d: str) -> DataFrame:
    single, pairs = _classified(spark, d)
    one = single.select("category", file_number().alias("f"), c("line").alias("line1"), F.lit(None).cast("long").alias("line2"), "opp_len")
    two = pairs.select("category", file_number("a1.file").alias("f"), c("a1.line").alias("line1"), c("a2.line").alias("line2"), F.lit(None).cast("int").alias("opp_len"))
    return one.unionByName(two)


_FRAGLEN = "greatest(0, y.pos + length(y.xs) - 1 - y.clip - 1 - (x.pos - x.clip) + 1)"
_FEATURES = f"""fl AS (SELECT x.k, CAST({_FRAGLEN} AS DOUBLE) AS fraglen FROM a x JOIN a y ON x.k = y.k AND x.mate = 1 AND y.mate = 2),
ft AS (SELECT category, f, line AS id, 10.0::DOUBLE AS len, CAST(clip AS DOUBLE) AS clip, alqual, clipqual, CASE category WHEN 'b' THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END AS olen,
    z0 AS ztz0, z2 AS ztz2, CAST(NULL AS DOUBLE) AS ztz_0, CAST(NULL AS DOUBLE) AS oztz_2, CAST(NULL AS DOUBLE) AS oalqual, CAST(NULL AS DOUBLE) AS fraglen, mapq, k FROM a WHERE category IN ('u', 'b')
  UNION ALL SELECT x.category, x.f, x.line, 10.0, x.clip, x.alqual, x.clipqual, 10.0, NULL, NULL, x.z0, y.z2, y.alqual, fl.fraglen, x.mapq, x.k FROM a x JOIN a y ON x.k = y.k AND x.mate <> y.mate JOIN fl ON fl.k = x.k)"""


@query(f"""WITH {_SAM}, {_FEATURES} SELECT category, f, id, len, clip, round(alqual, 6) AS alqual, round(clipqual, 6) AS clipqual, olen, ztz0, ztz2, ztz_0, oztz_2, round(oalqual, 6) AS oalqual, fraglen, mapq, -1 AS correct FROM ft""")
def q_features_files(spark: SparkSession, d: str) -> DataFrame:
    """Features of eight files through the sink and back."""
    to = Scratch(spark).path("features")
    rewrite.write_features(run.features(*_classified(spark, d), run.Options()), to)
    t = spark.read.parquet(to).withColumn("f", file_number())
    return rounded(t.select("category", "f", "id", "len", "clip", "alqual", "clipqual", "olen", "ztz0", "ztz2", "ztz_0", "oztz_2", "oalqual", "fraglen", "mapq", "correct"))


@query(f"""WITH {_SAM} SELECT category, f, line, CAST(z0 AS INTEGER) AS score, 10 AS len, CASE WHEN flag & 16 = 0 THEN 'true' ELSE 'false' END AS fw, xs FROM a WHERE category IN ('u', 'b')
UNION ALL SELECT x.category, x.f, x.line, CAST(x.z0 + y.z0 AS INTEGER), CAST({_FRAGLEN} AS INTEGER), 'true', y.xs FROM a x JOIN a y ON x.k = y.k WHERE x.mate = 1 AND y.mate = 2""")
def q_templates(spark: SparkSession, d: str) -> DataFrame:
    """Templates of unpaired reads and pairs through the text sink."""
    single, pairs = _classified(spark, d)
    scratch = Scratch(spark)
    rewrite.write_templates(pairing.unpaired_templates(single), scratch.path("u"))
    rewrite.write_templates(pairing.paired_templates(pairs), scratch.path("p"))
    u, p = (spark.read.csv(scratch.path(x), header=True) for x in ("u", "p"))
    u = u.select("category", file_number().alias("f"), c("line").cast("long").alias("line"), c("best_score").cast("int").alias("score"), c("len").cast("int").alias("len"), "fw", c("edit_xscript").alias("xs"))
    p = p.select("category", file_number().alias("f"), c("line").cast("long").alias("line"), c("score_12").cast("int").alias("score"), c("fraglen").cast("int").alias("len"), c("m1_fw").alias("fw"), c("m2_edit_xscript").alias("xs"))
    return u.unionByName(p)


@query(f"""WITH {_SAM}, p AS (SELECT f, line, CAST((k + 13 * f) % 600 AS DOUBLE) / 10 AS m FROM a)
SELECT r.f, CASE WHEN r.aligned THEN CASE WHEN p.m IS NULL THEN r.mapq ELSE CAST(floor(p.m + 0.5) AS INTEGER) END ELSE 0 END AS mapq, 'r' || k AS qname, r.flag,
  CASE WHEN p.m IS NULL THEN NULL ELSE printf('Zp:Z:%.3f', p.m) END AS precise FROM r LEFT JOIN p ON r.f = p.f AND r.line = p.line""")
def q_rewrite_files(spark: SparkSession, d: str) -> DataFrame:
    """Eight files with as many equal line numbers: predictions of two runs merged, joined by file and line and ordered in one exchange, written and read back."""
    paths = _sam(spark, d)
    lines = sam.read_sam(spark, paths)
    single, pairs = run.parsed(spark, paths, run.Options())
    every = single.select("file", "line", "qname").unionByName(pairing.unpivot_pairs(pairs.select("a1", "a2")).select("a.file", "a.line", "a.qname"))
    key = F.substring("qname", 2, 30).cast("long")
    p = every.select("file", "line", (((key + 13 * file_number()) % 600) / 10).alias("mapq"))
    to = Scratch(spark).path("sam")
    rewrite.write_rewritten(lines, [p.filter(c("line") % 2 == i) for i in (0, 1)], to, precise_flag="Zp:Z")
    back = sam.fields(sam.read_sam(spark, to))
    number = F.substring("qname", 2, 30).cast("long") % 8
    return back.select(number.cast("int").alias("f"), "mapq", "qname", "flag", F.get(F.filter("tags", lambda t: t.startswith("Zp:Z:")), F.lit(0)).alias("precise"))


# ---------------------------------------------------------------- FASTA and FASTQ of the part table
def _bases(name: Column) -> Column:
    """Letters of a name as A, C, G, T by their place in the alphabet; other characters as N."""
    return F.translate(F.lower(name), "abcdefghijklmnopqrstuvwxyz", "acgtacgtacgtacgtacgtacgtac")


_BASES = "regexp_replace(translate(lower({x}), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC'), '[^ACGT]', 'N', 'g')"


def _fasta(spark: SparkSession, d: str) -> list[str]:
    k = c("p_partkey")
    seq = F.repeat(_bases(F.regexp_replace("p_name", " ", "")), (k % 5 + 1).cast("int"))
    wrapped = F.array_join(F.regexp_extract_all(seq, F.lit(".{1,17}"), 0), "\n")
    part = read(spark, d, "part")
    return text_files(part.select((k % 8).alias("f"), k.alias("k"), F.concat(F.lit(">p"), k, F.lit(" part "), k, F.lit("\n"), wrapped).alias("value")), part.count())


_SEQUENCES = f"sq AS (SELECT p_partkey AS k, {_BASES.format(x="repeat(replace(p_name, ' ', ''), CAST(p_partkey % 5 + 1 AS INTEGER))")} AS s FROM part)"
_PIECES = "pc AS (SELECT k, s, unnest(generate_series(0, greatest(0, CAST(ceil((length(s) - 32) / 24.0) AS BIGINT) * 24), 24)) AS refoff FROM sq WHERE s <> '')"


@query(f"WITH {_SEQUENCES}, {_PIECES} SELECT 'p' || k AS refid, 'p' || k || ' part ' || k AS refid_full, refoff, CAST(length(substr(s, refoff + 1, 32)) AS INTEGER) AS retsz, substr(s, refoff + 1, 32) AS seq FROM pc")
def q_fasta(spark: SparkSession, d: str) -> DataFrame:
    return fasta.read_fasta(spark, _fasta(spark, d), chunk=32, overlap=8)


@query(f"WITH {_SEQUENCES} SELECT CAST(sum(1 + length('p' || k || ' part ' || k) + length(s) + CAST(ceil(length(s) / 17.0) AS BIGINT) + 1) AS BIGINT) AS bytes FROM sq")
def q_fasta_size(spark: SparkSession, d: str) -> DataFrame:
    return fasta.size_estimate(spark, _fasta(spark, d))


@query(f"""SELECT CAST(p_partkey % 8 AS INTEGER) AS f, row_number() OVER (PARTITION BY p_partkey % 8 ORDER BY p_partkey) - 1 AS ordinal, 'p' || p_partkey AS name, {_BASES.format(x='p_name')} AS seq, repeat('I', length(p_name)) AS qual FROM part""")
def q_fastq_file(spark: SparkSession, d: str) -> DataFrame:
    k = c("p_partkey")
    part = read(spark, d, "part")
    reads = part.select((k % 8).alias("f"), k.alias("k"), F.concat(F.lit("p"), k).alias("name"), bases.normalise(_bases(c("p_name"))).alias("seq"), F.repeat(F.lit("I"), F.length("p_name")).alias("qual"))
    return fastq.read_fastq(spark, text_files(fastq.to_lines(reads), part.count())).select(file_number().alias("f"), "ordinal", "name", "seq", "qual")


# ---------------------------------------------------------------- simulation
def _templates(spark: SparkSession, span: int = 20) -> DataFrame:
    """Ten templates a category, without edits; the twelfth base of the first ones is a mismatch."""
    xs = F.concat(F.repeat(F.lit("="), 11), F.when(c("id") < 5, "X").otherwise("="), F.repeat(F.lit("="), span - 12))
    t = spark.range(10).select(c("id").alias("slot"), xs.alias("xscript1"), F.lit("=" * 8).alias("xscript2"), F.repeat(F.lit("I"), span).alias("qual1"), F.lit("J" * 8).alias("qual2"), (c("id") % 2 == 0).alias("fw1"), (c("id") % 2 == 1).alias("fw2"),
        (-c("id")).cast("int").alias("score1"), F.lit(0).alias("score2"), F.lit(True).alias("upstream1"), (c("id") + span).alias("fraglen"), F.when(c("id") % 3 == 0, "1").otherwise("2").alias("mate_flag"), F.lit(12).alias("opp_len"))
    return t.withColumn("category", F.explode(F.array(F.lit("u"), F.lit("c"), F.lit("b"))))


def _drawn(spark: SparkSession, d: str) -> DataFrame:
    chunks = simulate.usable_chunks(fasta.read_fasta(spark, _fasta(spark, d), overlap=32), 32)
    targets = spark.createDataFrame([("u", 3000), ("c", 1500), ("b", 700)], "category string, target long")
    return Scratch(spark).keep(simulate.draw(simulate.allocate(chunks, targets, 32), _templates(spark), 32, 99099))


def _whole(spark: SparkSession, d: str) -> DataFrame:
    k = c("p_partkey")
    seq = F.repeat(_bases(F.regexp_replace("p_name", " ", "")), (k % 5 + 1).cast("int"))
    return read(spark, d, "part").select(F.concat(F.lit("p"), k).alias("refid"), bases.normalise(seq).alias("whole"))


@query("SELECT * FROM (VALUES ('u', 3000::BIGINT, 3000::BIGINT, 0::BIGINT, 0::BIGINT), ('c', 1500, 1500, 0, 0), ('b', 700, 700, 0, 0)) AS t(category, n_reads, n_different, n_misplaced, n_ambiguous)")
def q_draw(spark: SparkSession, d: str) -> DataFrame:
    """Draws are random, their properties are not: as many as asked for, each window the reference at its place and without N."""
    r = _drawn(spark, d).join(_whole(spark, d), "refid")
    there = F.substring("whole", (c("off") + 1).cast("int"), F.length("window"))
    return r.groupBy("category").agg(
        F.count(F.lit(1)).alias("n_reads"), F.count_distinct("read").alias("n_different"), F.count_if(there != c("window")).alias("n_misplaced"), F.count_if(c("window").rlike("[^ACGT]")).alias("n_ambiguous"),
    )


@query("""SELECT * FROM (VALUES ('u', '0', 3000::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT), ('c', '1', 1500, 0, 0, 0, 0), ('c', '2', 1500, 0, 0, 0, 0), ('b', 'real', 700, 0, 0, 0, 0), ('b', 'other', 700, 0, 0, 0, 0)) AS t(category, mate, n_reads, n_length, n_far, n_quality, n_name)""")
def q_simulated_reads(spark: SparkSession, d: str) -> DataFrame:
    """Reads against the place that their own name gives: at most the one edited base differs, and a bad end's other mate is random."""
    drawn = _drawn(spark, d)
    one = simulate.unpaired_reads(drawn.filter("category = 'u'"), 99099).withColumn("mate", F.lit("0"))
    two = simulate.paired_reads(drawn.filter("category = 'c'"), 99099).withColumn("mate", c("mate").cast("string"))
    bad = simulate.bad_end_reads(drawn.filter("category = 'b'"), 99099).withColumn("mate", F.when(c("mate").cast("string") == F.substring(F.substring_index("name", ":", -1), 2, 1), "real").otherwise("other"))
    r = one.unionByName(two).unionByName(bad)
    part = F.split("name", ":")
    at = F.when(c("mate") == "2", 5).otherwise(1)
    r = r.withColumn("refid", F.get(part, at)).withColumn("fw", F.get(part, at + 1) == "+").withColumn("off", F.get(part, at + 2).cast("int"))
    r = r.join(_whole(spark, d), "refid")
    there = F.substring("whole", c("off") + 1, F.length("seq"))
    read_ = F.when(c("fw"), c("seq")).otherwise(bases.reverse_complement(c("seq")))
    far = F.size(F.filter(F.zip_with(F.split(there, ""), F.split(read_, ""), lambda x, y: x != y), lambda x: x)) > F.when(c("mate").isin("0", "1", "real"), 1).otherwise(0)
    asked = F.when(c("mate").isin("0", "1", "real"), 20).when(c("mate") == "2", 8).otherwise(12)
    return r.groupBy("category", "mate").agg(
        F.count(F.lit(1)).alias("n_reads"), F.count_if((F.length("seq") != asked) | (F.length("qual") != asked)).alias("n_length"), F.count_if((c("mate") != "other") & far).alias("n_far"),
        F.count_if(c("qual") != F.repeat(F.when(c("mate") == "2", "J").otherwise("I"), asked)).alias("n_quality"), F.count_if(~c("name").rlike("^sim!:p[0-9]+:[+-]:[0-9]+:-?[0-9]+:(u|p[0-9]+:[+-]:[0-9]+:-?[0-9]+:(c|b[12]))$")).alias("n_name"),
    )


@query("SELECT o_orderkey AS k, o_custkey % 500 + greatest(o_orderkey % 300, 50) - 50 AS off FROM orders")
def q_mate_offset(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(c("o_orderkey").alias("k"), simulate.mate_offset(c("o_custkey") % 500, c("o_orderkey") % 300, F.lit(50)).alias("off"))


@query("""WITH r AS (SELECT 'u' AS category, o_orderkey AS k FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'c', o_orderkey FROM orders WHERE o_orderkey % 2 = 1)
SELECT k, 'r' || k AS name, category || '_' || k AS seq FROM r""")
def q_concat_reads(spark: SparkSession, d: str) -> DataFrame:
    """Reads of several categories as one FASTQ text, read back."""
    k = c("o_orderkey")
    o = read(spark, d, "orders")

    def reads(rest: int, category: str) -> DataFrame:
        return o.filter(k % 2 == rest).select((k % 8).alias("f"), k.alias("k"), F.concat(F.lit("r"), k).alias("name"), F.concat(F.lit(category + "_"), k).alias("seq"), F.lit("I").alias("qual"))

    both = prep.union_chunks([reads(0, "u"), reads(1, "c")])
    back = fastq.read_fastq(spark, text_files(fastq.to_lines(both), o.count()))
    return back.select(F.substring("name", 2, 30).cast("long").alias("k"), "name", "seq")


# ---------------------------------------------------------------- calibration, preparation, conversion
@query("""WITH v AS (SELECT (o_orderkey % 97) / 100.0::DOUBLE AS p, o_orderkey % 3 <> 0 AS ok FROM orders),
t AS (SELECT p, count(*) FILTER (ok) AS cor, count(*) FILTER (NOT ok) AS incor FROM v GROUP BY p),
e AS (SELECT *, cor + incor AS n, incor * p * p + cor * (1 - p) * (1 - p) AS se FROM t)
SELECT round(abs(-10 * log10(1 - p)), 6) AS mapq, round(p, 6) AS pcor, cor, incor, CAST(sum(cor) OVER w AS BIGINT) AS cum_cor, CAST(sum(incor) OVER w AS BIGINT) AS cum_incor, n, CAST(sum(n) OVER w AS BIGINT) AS cum, round(se, 6) AS se, round(sum(se) OVER w, 6) AS cum_se
FROM e WINDOW w AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)""")
def q_roc_pcor(spark: SparkSession, d: str) -> DataFrame:
    k = c("o_orderkey")
    return rounded(calibration.roc(calibration.tally(read(spark, d, "orders"), k % 97 / 100.0, k % 3 != 0), pcor_strata=True, many=True))


@query("SELECT count(*) AS n, true AS known, false AS unknown, true AS over, true AS mixed FROM orders")
def q_guard(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select((c("o_orderkey") % 2).cast("int").alias("correct"))

    def refused(df: DataFrame, **limit: int) -> bool:
        try:
            calibration.assessable(df, **limit)
        except ValueError:
            return True
        return False

    known, unknown = calibration.assessable(o), calibration.assessable(o.withColumn("correct", F.lit(-1)))
    return o.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(known).alias("known"), F.lit(unknown).alias("unknown"), F.lit(refused(o, limit=3)).alias("over"), F.lit(refused(o.withColumn("correct", c("correct") - 1))).alias("mixed"))


@query("""WITH s AS (SELECT l_quantity AS q, count(*) FILTER (l_returnflag <> 'R') AS cor, count(*) FILTER (l_returnflag = 'R') AS incor FROM lineitem GROUP BY 1)
SELECT 'roc' AS name, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(cor) AS BIGINT) AS cor, CAST(sum(incor) AS BIGINT) AS incor FROM s""")
def q_roc_sink(spark: SparkSession, d: str) -> DataFrame:
    """The calibration tables as CSV folders, read back."""
    p = read(spark, d, "lineitem").select(F.lit("u").alias("category"), c("l_orderkey").alias("id"), (c("l_quantity") + 0.0).alias("mapq"), c("l_linenumber").cast("int").alias("mapq_orig"), (c("l_returnflag") != "R").cast("int").alias("correct"))
    to = Scratch(spark).path("tables")
    calibration.write_tables(p, to)
    t = spark.read.csv(f"{to}/roc.csv", header=True, inferSchema=True)
    return t.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("cor").cast("long").alias("cor"), F.sum("incor").cast("long").alias("incor")).select(F.lit("roc").alias("name"), "*")


@query("""SELECT event_id AS id, value AS x, user_id AS y, NULL AS z FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, NULL, user_id, event_id % 5 FROM events WHERE event_id % 2 = 1""")
def q_union_chunks(spark: SparkSession, d: str) -> DataFrame:
    e, k = read(spark, d, "events"), c("event_id")
    one = e.filter(k % 2 == 0).select(k.alias("id"), c("value").alias("x"), c("user_id").alias("y"))
    two = e.filter(k % 2 == 1).select(k.alias("id"), c("user_id").alias("y"), (k % 5).alias("z"))
    return prep.union_chunks([one, two])


@query("SELECT event_id AS id, value FROM events")
def q_check_columns(spark: SparkSession, d: str) -> DataFrame:
    return prep.check_columns(read(spark, d, "events").select(c("event_id").alias("id"), "value"), ["value"])


@query("""WITH v AS (SELECT p_partkey AS k, row_number() OVER (ORDER BY p_partkey) AS idx, p_partkey % 100 AS b, substr(p_name, 1, 5) AS seq FROM part)
SELECT idx, 'c' || (k % 3) || '_' || (b + 1) || '_' || (b + 50) || '_0:0:0_0:0:0_' || length(seq) || '_' || length(seq) || '_' || CASE WHEN k % 2 = 1 THEN 0 ELSE 1 END || '_' || idx || '/1' AS name, seq FROM v""")
def q_convert_unpaired(spark: SparkSession, d: str) -> DataFrame:
    k = c("p_partkey")
    name = F.concat(F.lit("m contig=c"), k % 3, F.lit(" orig_begin="), k % 100, F.lit(" orig_end="), k % 100 + 50, F.lit(" strand="), F.when(k % 2 == 1, "forward").otherwise("reverse"))
    reads = read(spark, d, "part").select(k.alias("ordinal"), name.alias("name"), F.substring("p_name", 1, 5).alias("seq"), F.lit("IIIII").alias("qual"))
    return truth.convert_unpaired(reads).select("idx", "name", "seq")


# ---------------------------------------------------------------- matrices of the lineitem table
@query("""SELECT CAST(l_orderkey AS DOUBLE) AS k, CAST(l_linenumber AS DOUBLE) AS n, l_quantity AS q, CASE WHEN l_returnflag <> 'R' THEN l_tax END AS tax FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_returnflag <> 'R' THEN l_tax END FROM lineitem WHERE l_linenumber = 1""")
def q_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Columns through the matrix sink, some rows appended, and back; nulls included."""
    t = read(spark, d, "lineitem").select(c("l_orderkey").alias("k"), c("l_linenumber").alias("n"), c("l_quantity").alias("q"), F.when(c("l_returnflag") != "R", c("l_tax")).alias("tax"))
    to = Scratch(spark).path("matrix")
    matrix.save_matrix(t, to)
    matrix.save_matrix(t.filter("n = 1"), to, append=True)
    return matrix.read_matrix(spark, to, 10_000)
