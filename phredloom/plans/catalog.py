"""Registered queries over the driver's tables, each with its SQL.

The tables hold no alignments, so queries feed the operators deterministic
views of them. Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phredloom.functions import bases, cigar, confidence, flags, readnames, tags
from phredloom.operators import calibration, pairing, prep, rewrite, simulate, truth
from phredloom.plans import registry
from phredloom.plans.registry import Query, query, read, rounded
from phredloom.sources import fasta, sam


def queries() -> dict[str, Query]:
    """Every registered query, those over files and of fitted models included."""
    from phredloom.plans import catalog_files, catalog_models  # noqa: F401  they register themselves

    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(registry.SQL)


c = F.col


# ---------------------------------------------------------------- calibration
def _strata(spark: SparkSession, d: str) -> DataFrame:
    return calibration.tally(read(spark, d, "lineitem"), c("l_quantity"), c("l_returnflag") != "R")


_TALLY = "SELECT l_quantity + 0.0 AS mapq, CAST(sum(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS BIGINT) AS cor, CAST(sum(CASE WHEN l_returnflag <> 'R' THEN 0 ELSE 1 END) AS BIGINT) AS incor FROM lineitem GROUP BY 1"


def _roc_sql(tally: str) -> str:
    return f"""
t AS ({tally}),
p AS (SELECT mapq, 1.0 - pow(10.0::DOUBLE, -0.1::DOUBLE * mapq) AS pcor, cor, incor FROM t),
e AS (SELECT *, cor + incor AS n, incor * pcor * pcor + cor * (1 - pcor) * (1 - pcor) AS se FROM p),
r AS (SELECT mapq, pcor, cor, incor, CAST(sum(cor) OVER w AS BIGINT) AS cum_cor, CAST(sum(incor) OVER w AS BIGINT) AS cum_incor, n,
        CAST(sum(n) OVER w AS BIGINT) AS cum, se, sum(se) OVER w AS cum_se
      FROM e WINDOW w AS (ORDER BY mapq DESC ROWS UNBOUNDED PRECEDING))"""


@query(f"WITH {_roc_sql(_TALLY)} SELECT mapq, round(pcor, 6) AS pcor, cor, incor, cum_cor, cum_incor, n, cum, round(se, 6) AS se, round(cum_se, 6) AS cum_se FROM r")
def q_roc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(calibration.roc(_strata(spark, d)))


@query(f"WITH {_roc_sql(_TALLY)} SELECT sum((cum_incor - incor / 2.0::DOUBLE) * n) AS auc, round(sum(se), 6) AS sse FROM r")
def q_auc_sse(spark: SparkSession, d: str) -> DataFrame:
    return rounded(calibration.auc_and_sse(calibration.roc(_strata(spark, d))))


@query("""
WITH v AS (SELECT o_totalprice / 7000 AS m, o_orderkey % 3 <> 0 AS ok FROM orders)
SELECT 3 AS places, round_even(m, 3) + 0.0 AS stratum, CAST(count(*) FILTER (ok) AS BIGINT) AS cor, CAST(count(*) FILTER (NOT ok) AS BIGINT) AS incor FROM v GROUP BY 2
UNION ALL SELECT 0, round_even(m, 0) + 0.0, CAST(count(*) FILTER (ok) AS BIGINT), CAST(count(*) FILTER (NOT ok) AS BIGINT) FROM v GROUP BY 2""")
def q_tally_round(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    m, ok = c("o_totalprice") / 7000, c("o_orderkey") % 3 != 0
    return calibration.tally(o, m, ok, 3).select(F.lit(3).alias("places"), "*").unionByName(calibration.tally(o, m, ok, 0).select(F.lit(0).alias("places"), "*"))


def _nation_roc(spark: SparkSession, d: str, modulus: int) -> DataFrame:
    return calibration.roc(calibration.tally(read(spark, d, "nation"), c("n_regionkey").cast("double"), c("n_nationkey") % modulus != 0))


def _nation_sql(modulus: int) -> str:
    return f"SELECT CAST(n_regionkey AS DOUBLE) AS mapq, CAST(count(*) FILTER (n_nationkey % {modulus} <> 0) AS BIGINT) AS cor, CAST(count(*) FILTER (n_nationkey % {modulus} = 0) AS BIGINT) AS incor FROM nation GROUP BY 1"


_CURVE = """SELECT cum - n + i AS rank, cum_incor - incor + i::DOUBLE / n * incor AS ci, cum_se - se + i::DOUBLE / n * se AS ce FROM {r}, LATERAL (SELECT unnest(generate_series(1, n)) AS i)
UNION ALL SELECT 0, 0.0, 0.0"""


@query(f"WITH {_roc_sql(_nation_sql(3))}, k AS ({_CURVE.format(r='r')}) SELECT CAST(rank AS BIGINT) AS rank, round(ci, 6) AS ci, round(ce, 6) AS ce FROM k")
def q_cid_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(calibration.curves(_nation_roc(spark, d, 3)))


@query(f"""WITH a AS (WITH {_roc_sql(_nation_sql(3))} {_CURVE.format(r='r')}), b AS (WITH {_roc_sql(_nation_sql(4))} {_CURVE.format(r='r')})
SELECT CAST(a.rank AS BIGINT) AS rank, round(a.ci - b.ci, 6) + 0.0 AS ci_diff, round(a.ce - b.ce, 6) + 0.0 AS ce_diff FROM a JOIN b ON a.rank = b.rank""")
def q_curve_difference(spark: SparkSession, d: str) -> DataFrame:
    out = calibration.curve_difference(_nation_roc(spark, d, 3), _nation_roc(spark, d, 4))
    return out.select("rank", (F.round("ci_diff", 6) + 0.0).alias("ci_diff"), (F.round("ce_diff", 6) + 0.0).alias("ce_diff"))


@query("""
WITH v AS (SELECT CAST(o_orderkey % 601 AS DOUBLE) / 10 AS mapq, CAST(o_orderkey % 43 AS DOUBLE) AS mapq_orig, o_orderkey % 7 <> 0 AS ok FROM orders),
t AS (SELECT 'raw' AS k, round_even(mapq, 3) AS q, ok FROM v UNION ALL SELECT 'round', round_even(mapq, 0), ok FROM v UNION ALL SELECT 'orig', mapq_orig, ok FROM v),
g AS (SELECT k, q, count(*) FILTER (ok) AS cor, count(*) FILTER (NOT ok) AS incor, 1 - pow(10.0::DOUBLE, -0.1::DOUBLE * q) AS p FROM t GROUP BY k, q),
s AS (SELECT k, incor, cor + incor AS n, incor * p * p + cor * (1 - p) * (1 - p) AS se, sum(incor) OVER (PARTITION BY k ORDER BY q DESC ROWS UNBOUNDED PRECEDING) AS cum FROM g),
a AS (SELECT k, CAST(sum((cum - incor / 2.0::DOUBLE) * n) AS DOUBLE) AS auc, CAST(sum(se) AS DOUBLE) AS sse FROM s GROUP BY k),
x AS (SELECT max(auc) FILTER (k = 'raw') AS a1, max(auc) FILTER (k = 'round') AS a2, max(auc) FILTER (k = 'orig') AS a0, max(sse) FILTER (k = 'raw') AS s1, max(sse) FILTER (k = 'round') AS s2, max(sse) FILTER (k = 'orig') AS s0 FROM a)
SELECT round(100 * (a1 - a0) / a0, 6) AS auc_diff_pct, round(100 * (a2 - a0) / a0, 6) AS auc_diff_pct_round, round(100 * (s1 - s0) / s0, 6) AS mse_diff_pct, round(100 * (s2 - s0) / s0, 6) AS mse_diff_pct_round FROM x""")
def q_summary(spark: SparkSession, d: str) -> DataFrame:
    k = c("o_orderkey")
    p = read(spark, d, "orders").select((k % 601 / 10).alias("mapq"), (k % 43).cast("double").alias("mapq_orig"), (k % 7 != 0).cast("int").alias("correct"))
    return rounded(calibration.summary(p))


@query("SELECT event_type AS category, event_id AS id, value AS mapq, CAST(user_id % 60 AS INTEGER) AS mapq_orig, CAST(event_id % 2 AS INTEGER) AS correct FROM events WHERE event_id % 2 = 0 ORDER BY value DESC, event_id LIMIT 100")
def q_top_incorrect(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "events").select(c("event_type").alias("category"), c("event_id").alias("id"), c("value").alias("mapq"), (c("user_id") % 60).cast("int").alias("mapq_orig"), (c("event_id") % 2).cast("int").alias("correct"))
    return calibration.top_incorrect(p, 100)


@query("""SELECT p_partkey, round(1 - pow(10.0::DOUBLE, -0.1::DOUBLE * p_size), 6) AS pcor, round(abs(-10 * log10(1 - p_size / 101.0::DOUBLE)), 6) AS mapq,
round(1 - pow(10.0::DOUBLE, -0.1::DOUBLE * round_even(abs(-10 * log10(1 - p_size / 101.0::DOUBLE)), 0)), 6) AS rounded FROM part""")
def q_mapq_math(spark: SparkSession, d: str) -> DataFrame:
    p = c("p_size") / 101.0
    return rounded(read(spark, d, "part").select("p_partkey", confidence.mapq_to_pcor(c("p_size")).alias("pcor"), confidence.pcor_to_mapq(p).alias("mapq"), confidence.round_pcor(p).alias("rounded")))


# ---------------------------------------------------------------- record kernels
@query("""WITH v AS (SELECT o_orderkey AS k, CAST(o_orderkey % 4096 AS INTEGER) AS f FROM orders)
SELECT k, f & 4 = 0 AS aligned, f & 16 = 0 AS fw, f & 2 <> 0 AS concordant, f & 1 <> 0 AS paired, CASE WHEN f & 64 <> 0 THEN '1' WHEN f & 128 <> 0 THEN '2' ELSE '0' END AS mate FROM v WHERE f & 256 = 0 AND f & 2048 = 0""")
def q_flags(spark: SparkSession, d: str) -> DataFrame:
    f = c("f")
    v = read(spark, d, "orders").select(c("o_orderkey").alias("k"), (c("o_orderkey") % 4096).cast("int").alias("f"))
    return sam.primary(v.withColumn("flag", f)).select("k", flags.is_aligned(f).alias("aligned"), flags.is_forward(f).alias("fw"), flags.is_concordant(f).alias("concordant"), flags.is_paired(f).alias("paired"), flags.mate_flag(f).alias("mate"))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    """A CIGAR aS bM cI dM and its MD with one mismatch, from part columns."""
    k, s = c("p_partkey"), c("p_size")
    p = read(spark, d, "part").select(k.alias("k"), (k % 4 + 1).cast("int").alias("a"), (s % 9 + 1).cast("int").alias("b"), (s % 3 + 1).cast("int").alias("i"), (k % 6 + 1).cast("int").alias("e"))
    p = p.withColumn("x", F.pmod("k", c("b") + c("e")).cast("int"))
    p = p.withColumn("cig", F.concat("a", F.lit("S"), "b", F.lit("M"), "i", F.lit("I"), "e", F.lit("M")))
    return p.withColumn("md", F.concat("x", F.lit("G"), c("b") + c("e") - 1 - c("x")))


_PARTS = """v0 AS (SELECT p_partkey AS k, CAST(p_partkey % 4 + 1 AS INTEGER) AS a, CAST(p_size % 9 + 1 AS INTEGER) AS b, CAST(p_size % 3 + 1 AS INTEGER) AS i, CAST(p_partkey % 6 + 1 AS INTEGER) AS e FROM part),
v AS (SELECT *, CAST(k % (b + e) AS INTEGER) AS x FROM v0),
m AS (SELECT *, repeat('=', x) || 'X' || repeat('=', b + e - 1 - x) AS mdx FROM v),
t AS (SELECT *, repeat('S', a) || substr(mdx, 1, b) || repeat('I', i) || substr(mdx, b + 1, e) AS xs FROM m)"""


@query(f"WITH {_PARTS} SELECT k, a AS left_clip, 0 AS right_clip, 4 AS n_ops, CAST(a + b + i + e AS BIGINT) AS run_sum FROM t")
def q_cigar(spark: SparkSession, d: str) -> DataFrame:
    ops = cigar.runs(c("cig"))
    return _parts(spark, d).withColumn("ops", ops).select(
        "k", cigar.left_clip(c("ops")).alias("left_clip"), cigar.right_clip(c("ops")).alias("right_clip"), F.size("ops").alias("n_ops"), F.aggregate("ops", F.lit(0).cast("long"), lambda s, r: s + r["n"]).alias("run_sum")
    )


@query(f"""WITH {_PARTS} SELECT k, xs, CAST(a + b + e AS INTEGER) AS ref_length, 1000 - a AS lpos, CAST(1000 + length(replace(regexp_replace(xs, '^S*.', ''), 'I', '')) - 1 AS INTEGER) AS rpos FROM t""")
def q_edit_xscript(spark: SparkSession, d: str) -> DataFrame:
    p = _parts(spark, d).withColumn("xs", cigar.edit_transcript(c("cig"), c("md")))
    return p.select("k", "xs", cigar.ref_length(c("xs")).alias("ref_length"), cigar.lpos(F.lit(1000), c("a")).alias("lpos"), cigar.rpos(F.lit(1000), c("xs")).alias("rpos"))


@query(f"""WITH {_PARTS}, s AS (SELECT *, substr(repeat('ACGT', 10), 1, a + b + i + e) AS seq FROM t),
u AS (SELECT *, substr(seq, a + 1, b) || substr(seq, a + b + i + 1, e) AS al FROM s),
w AS (SELECT *, substr(al, 1, x) || 'G' || substr(al, x + 2) AS rf FROM u)
SELECT k, substr(al, 1, b) || substr(seq, a + b + 1, i) || substr(al, b + 1) AS read, substr(rf, 1, b) || repeat('-', i) || substr(rf, b + 1) AS ref FROM w""")
def q_stacked(spark: SparkSession, d: str) -> DataFrame:
    p = _parts(spark, d)
    seq = F.substring(F.repeat(F.lit("ACGT"), 10), F.lit(1), c("a") + c("b") + c("i") + c("e"))
    return p.select("k", cigar.stacked(cigar.runs(c("cig")), c("md"), seq).alias("s")).select("k", "s.*")


@query("""WITH v AS (SELECT p_partkey AS k, replace(p_name, ' ', '!') AS q FROM part),
t AS (SELECT k, length(q) AS n, list_sum(list_transform(range(1, length(q) + 1), lambda i: ascii(substr(q, i, 1)) - 33)) AS total,
  list_sum(list_transform(range(3, length(q) - 1), lambda i: ascii(substr(q, i, 1)) - 33)) AS inside FROM v)
SELECT k, CAST(inside AS BIGINT) AS aligned, CAST(total - inside AS BIGINT) AS clipped, round(inside / (n - 3)::DOUBLE, 6) AS avg_aligned, round((total - inside) / 3.0::DOUBLE, 6) AS avg_clipped FROM t""")
def q_qual(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "part").select(c("p_partkey").alias("k"), cigar.quality_totals(F.replace("p_name", F.lit(" "), F.lit("!")), F.lit(2), F.lit(1)).alias("q"))
    return rounded(v.select("k", "q.aligned", "q.clipped", "q.avg_aligned", "q.avg_clipped"))


@query("""SELECT event_id AS id, 4 AS n, CAST(user_id AS DOUBLE) AS z0, CAST(NULL AS DOUBLE) AS z1, CAST(-(event_id % 7 + 1) AS DOUBLE) AS z2, CAST(event_id % 100 AS DOUBLE) + 0.5 AS z3 FROM events""")
def q_ztz(spark: SparkSession, d: str) -> DataFrame:
    e = c("event_id")
    text = F.concat(F.lit("ZT:Z:"), "user_id", F.lit(",NA,-"), e % 7 + 1, F.lit(","), e % 100, F.lit(".5"))
    v = read(spark, d, "events").select(e.alias("id"), tags.numbers(tags.tag(F.array(F.lit("NM:i:0,1"), text), tags.FEATURES)).alias("z"))
    return v.select("id", tags.arity(c("z")).alias("n"), *(F.get("z", F.lit(i)).alias(f"z{i}") for i in range(4)))


def _named(spark: SparkSession, d: str) -> DataFrame:
    k = c("o_orderkey")
    o = read(spark, d, "orders").select(
        k.alias("k"), F.concat(F.lit("chr_"), c("o_custkey") % 3).alias("rname"), (k % 1000 + 100).alias("pos"), ((k % 2) * 16 + F.when(k % 3 == 0, 128).otherwise(64) + 1).cast("int").alias("flag"),
        F.concat(F.lit("chr_"), k % 3).alias("origin"), (k % 1000 + 99 + k % 50).alias("off"),
    )
    sim = simulate.name(c("origin"), c("k") % 2 == 0, c("off"), F.lit(-5), F.lit("c"), (F.lit("chr_1"), F.lit(True), c("off") + 7, F.lit(3)))
    wg = readnames.wgsim(c("origin"), c("off"), c("off") + 300, F.lit(100), F.lit(90), c("k") % 4 == 1, c("k"), F.lit(1))
    return o.withColumn("qname", F.when(c("k") % 5 < 2, sim).when(c("k") % 5 < 4, wg).otherwise(F.concat(F.lit("read"), "k")))


@query("""WITH v AS (SELECT o_orderkey AS k, 'chr_' || (o_custkey % 3) AS rname, o_orderkey % 1000 + 100 AS pos, o_orderkey % 2 = 0 AS fw, o_orderkey % 3 = 0 AS second,
  'chr_' || (o_orderkey % 3) AS origin, o_orderkey % 1000 + 99 + o_orderkey % 50 AS off FROM orders)
SELECT k, CASE WHEN k % 5 < 2 THEN 'c' END AS typ, coalesce(CAST(CASE
  WHEN k % 5 < 2 AND NOT second THEN origin = rname AND abs(off - (pos - 1)) < 30
  WHEN k % 5 < 2 THEN rname = 'chr_1' AND fw AND abs(off + 7 - (pos - 1)) < 30
  WHEN k % 5 < 4 THEN origin = rname AND abs(pos - CASE WHEN (k % 4 <> 1) = (NOT second) THEN off ELSE off + 300 - (CASE WHEN second THEN 90 ELSE 100 END) + 1 END) < 30
  END AS INTEGER), -1) AS correct FROM v""")
def q_correct_name(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d).select("k", readnames.simulated_type(c("qname")).alias("typ"), readnames.correctness(c("qname"), c("flag"), c("rname"), c("pos")).alias("correct"))


@query("""SELECT p_partkey AS k, regexp_replace(translate(p_name, 'acgt', 'ACGT'), '[^ACGT]', 'N', 'g') AS seq, reverse(translate(regexp_replace(translate(p_name, 'acgt', 'ACGT'), '[^ACGT]', 'N', 'g'), 'ACGTN', 'TGCAN')) AS rc FROM part""")
def q_revcomp(spark: SparkSession, d: str) -> DataFrame:
    s = bases.normalise(c("p_name"))
    return read(spark, d, "part").select(c("p_partkey").alias("k"), s.alias("seq"), bases.reverse_complement(s).alias("rc"))


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'forward' ELSE 'reverse' END = 'forward' AS forward, o_orderkey % 5000 + 1 AS "left", o_orderkey % 5000 + 100 AS "right", 'c' || (o_custkey % 9) AS refid,
'c' || (o_custkey % 9) || '_' || (o_orderkey % 5000 + 1) || '_' || (o_orderkey % 5000 + 100) || '_0:0:0_0:0:0_100_100_' || (o_orderkey % 2) || '_' || o_orderkey || '/1' AS renamed FROM orders""")
def q_mason(spark: SparkSession, d: str) -> DataFrame:
    k = c("o_orderkey")
    name = F.concat(F.lit("sim.1 contig=c"), c("o_custkey") % 9, F.lit(" haplotype=0 orig_begin="), k % 5000, F.lit(" orig_end="), k % 5000 + 100, F.lit(" strand="), F.when(k % 2 == 0, "forward").otherwise("reverse"))
    v = read(spark, d, "orders").select(k.alias("k"), readnames.mason(name).alias("m"))
    return v.select("k", "m.forward", "m.left", "m.right", "m.refid", readnames.wgsim(c("m.refid"), c("m.left"), c("m.right"), F.lit(100), F.lit(100), ~c("m.forward"), c("k"), F.lit(1)).alias("renamed"))


# ---------------------------------------------------------------- mates and categories
def _turns(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    flag = F.lit(1) + F.when(n % 4 == 0, 4).otherwise(0) + F.when(n % 3 == 0, 2).otherwise(0) + F.when(c("turn") % 2 == 0, 64).otherwise(128)
    return read(spark, d, "conversations").select("conv_id", c("turn").alias("line"), flag.cast("int").alias("flag"), flags.mate_flag(flag.cast("int")).alias("mate_flag"), n.cast("int").alias("len"))


_PAIRS = """r AS (SELECT conv_id, turn AS line, length(text) AS len, turn % 2 = 0 AS first, length(text) % 4 <> 0 AS aligned, length(text) % 3 = 0 AS proper,
  row_number() OVER (PARTITION BY conv_id, turn % 2 = 0 ORDER BY turn) AS nth FROM conversations),
p AS (SELECT a.conv_id, a.line AS line1, b.line AS line2, a.len AS len1, b.len AS len2,
  CASE WHEN a.aligned AND b.aligned THEN CASE WHEN a.proper THEN 'c' ELSE 'd' END WHEN a.aligned OR b.aligned THEN 'b' END AS category
  FROM r a JOIN r b ON a.conv_id = b.conv_id AND a.nth = b.nth AND a.first AND NOT b.first)"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairing.pair_mates(_turns(spark, d), ["conv_id"]).withColumn("category", pairing.category_of_pair(c("a1.flag"), c("a2.flag")))


@query(f"WITH {_PAIRS} SELECT conv_id, line1, line2 FROM p")
def q_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("a1.conv_id", c("a1.line").alias("line1"), c("a2.line").alias("line2"))


@query(f"WITH {_PAIRS} SELECT coalesce(category, 'none') AS category, count(*) AS n FROM p GROUP BY 1")
def q_category(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).groupBy(F.coalesce("category", F.lit("none")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_PAIRS} SELECT category, conv_id, line1 AS line, CAST(len1 AS INTEGER) AS len, CAST(len2 AS INTEGER) AS olen FROM p WHERE category IS NOT NULL UNION ALL SELECT category, conv_id, line2, CAST(len2 AS INTEGER), CAST(len1 AS INTEGER) FROM p WHERE category IS NOT NULL")
def q_pair_unpivot(spark: SparkSession, d: str) -> DataFrame:
    rows = pairing.unpivot_pairs(_pairs(spark, d).filter("category is not null"))
    return rows.select("category", "a.conv_id", "a.line", c("a.len").alias("len"), c("o.len").alias("olen"))


@query("""WITH v AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN NULL WHEN 1 THEN 'b1' WHEN 2 THEN 'c' ELSE 'b2' END AS typ, CASE length(text) % 3 WHEN 0 THEN 'u' WHEN 1 THEN 'b' ELSE 'c' END AS category, CASE WHEN turn % 2 = 0 THEN '1' ELSE '2' END AS mate FROM conversations),
o AS (SELECT category, typ IS NULL OR typ = CASE WHEN category = 'b' THEN 'b' || mate ELSE category END AS ok FROM v)
SELECT category, count(*) FILTER (ok) AS n, count(*) FILTER (NOT ok) AS n_mismatch FROM o GROUP BY 1""")
def q_type_filter(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text") % 3
    v = read(spark, d, "conversations").select(
        F.when(c("turn") % 4 == 1, "b1").when(c("turn") % 4 == 2, "c").when(c("turn") % 4 == 3, "b2").alias("typ"), F.when(n == 0, "u").when(n == 1, "b").otherwise("c").alias("category"), F.when(c("turn") % 2 == 0, "1").otherwise("2").alias("mate_flag")
    )
    none = v.limit(0).select("category", F.struct(c("typ")).alias("a1"))
    return pairing.split_by_type(v, none)[2]


@query("""SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, CAST(least(500, greatest(0, CASE WHEN l_partkey < l_suppkey THEN l_suppkey + 99 - (l_partkey - 3) ELSE l_partkey + 79 - (l_suppkey - 5) END + 1)) AS BIGINT) AS fraglen FROM lineitem""")
def q_fragment(spark: SparkSession, d: str) -> DataFrame:
    p, s = c("l_partkey"), c("l_suppkey")
    return read(spark, d, "lineitem").select(c("l_orderkey").alias("k"), c("l_linenumber").alias("n"), p.alias("p"), cigar.fragment_length(p, p - 3, p + 79, s, s - 5, s + 99, 500).alias("fraglen"))


@query("""SELECT 'u' AS category, event_id AS id, CAST(user_id AS DOUBLE) AS len, CAST(event_id % 5 AS DOUBLE) AS clip, value AS alqual, 100.0::DOUBLE AS clipqual, 0.0::DOUBLE AS olen, CAST(event_id % 9 AS DOUBLE) AS ztz0, CAST(NULL AS DOUBLE) AS ztz1, CAST(event_id % 61 AS INTEGER) AS mapq, CAST(event_id % 2 AS INTEGER) AS correct FROM events""")
def q_features_u(spark: SparkSession, d: str) -> DataFrame:
    e = c("event_id")
    v = read(spark, d, "events").select(
        F.lit("u").alias("category"), e.alias("line"), c("user_id").alias("len"), (e % 5).alias("left_clip"), F.lit(0).alias("right_clip"), c("value").alias("avg_aligned_qual"), F.lit(100.0).alias("avg_clipped_qual"), F.lit(0).alias("opp_len"),
        tags.numbers(F.concat((e % 9).cast("string"), F.lit(",NA"))).alias("ztz"), (e % 61).cast("int").alias("mapq"), (e % 2).cast("int").alias("correct"),
    )
    return pairing.unpaired_features(v, 2)


@query("""WITH v AS (SELECT event_id % 10 = 0 AS h, CAST(event_id % 4096 AS INTEGER) AS f FROM events)
SELECT count(*) AS n_lines, count(*) FILTER (h) AS n_headers, count(*) FILTER (NOT h AND f & 256 <> 0) AS n_secondary, count(*) FILTER (NOT h AND f & 2048 <> 0) AS n_supplementary, count(*) FILTER (NOT h AND f & 4 <> 0) AS n_unaligned FROM v""")
def q_counters(spark: SparkSession, d: str) -> DataFrame:
    e = c("event_id")
    raw = F.when(e % 10 == 0, F.lit("@CO\tx")).otherwise(F.concat(F.lit("r"), e, F.lit("\t"), e % 4096))
    return sam.counters(read(spark, d, "events").select(raw.alias("raw")).withColumn("is_header", c("raw").startswith("@")))


# ---------------------------------------------------------------- preparation
@query("""WITH j AS (SELECT d.lang, d.doc_id, CAST(l.quality AS DOUBLE) AS quality, CAST(l.toxic AS DOUBLE) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT lang AS category, doc_id AS id, coalesce(quality, max(quality) OVER (PARTITION BY lang) + 1, 0) AS quality, coalesce(toxic, max(toxic) OVER (PARTITION BY lang) + 1, 0) AS toxic FROM j""")
def q_impute(spark: SparkSession, d: str) -> DataFrame:
    labels = read(spark, d, "labels").select("doc_id", c("quality").cast("double"), c("toxic").cast("double"))
    j = read(spark, d, "documents").select("doc_id", c("lang").alias("category")).join(labels, "doc_id", "left").withColumnRenamed("doc_id", "id")
    return prep.impute(j, ["quality", "toxic"])


@query("""WITH v AS (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT j, CASE j WHEN 5 THEN 7.0 WHEN 6 THEN e[3] ELSE e[j] END AS x, row_number() OVER () AS r FROM v, (SELECT unnest([1, 2, 3, 4, 5, 6]) AS j)),
s AS (SELECT j, count(DISTINCT x) AS n FROM u GROUP BY j),
d AS (SELECT DISTINCT b.j FROM (SELECT unnest([1, 2, 3, 4, 5, 6]) AS j) a, (SELECT unnest([1, 2, 3, 4, 5, 6]) AS j) b
  WHERE a.j < b.j AND (SELECT count(*) FROM v WHERE (CASE a.j WHEN 5 THEN 7.0 WHEN 6 THEN e[3] ELSE e[a.j] END) IS DISTINCT FROM (CASE b.j WHEN 5 THEN 7.0 WHEN 6 THEN e[3] ELSE e[b.j] END)) = 0)
SELECT CASE j WHEN 5 THEN 'k' WHEN 6 THEN 'again' ELSE 'x' || (j - 1) END AS feature FROM s WHERE n > 1 AND j NOT IN (SELECT j FROM d)""")
def q_const_dup_cols(spark: SparkSession, d: str) -> DataFrame:
    e = c("embedding")
    v = read(spark, d, "embeddings").select(c("vec_id").alias("id"), *(F.get(e, F.lit(i)).cast("double").alias(f"x{i}") for i in range(4)), F.lit(7.0).alias("k"), F.get(e, F.lit(2)).cast("double").alias("again"))
    return spark.createDataFrame([(x,) for x in prep.feature_columns(v)], "feature string")


@query("SELECT l_quantity, l_discount + 0.0 AS l_discount, count(*) AS n_rows FROM lineitem GROUP BY ALL")
def q_collapse(spark: SparkSession, d: str) -> DataFrame:
    return prep.collapse(read(spark, d, "lineitem").select("l_quantity", (c("l_discount") + 0.0).alias("l_discount")), ["l_quantity", "l_discount"])


@query("""WITH u AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity, l_tax FROM lineitem), g AS (SELECT l_quantity, l_tax, count(*) AS n_rows FROM u GROUP BY ALL)
SELECT k, n, n_rows, count(*) AS times FROM u JOIN g USING (l_quantity, l_tax) GROUP BY k, n, n_rows""")
def q_expand(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "lineitem").select(c("l_orderkey").alias("k"), c("l_linenumber").alias("n"), "l_quantity", "l_tax")
    cols = ["l_quantity", "l_tax"]
    return prep.expand(v, prep.collapse(v, cols), cols).groupBy("k", "n", "n_rows").agg(F.count(F.lit(1)).alias("times"))


@query("""SELECT event_id, event_type FROM events ORDER BY md5('7:' || event_id), event_id LIMIT (SELECT CAST(round_even(count(*) * 0.1, 0) AS BIGINT) FROM events)""")
def q_subsample(spark: SparkSession, d: str) -> DataFrame:
    return prep.subsample(read(spark, d, "events").select("event_id", "event_type"), 0.1, 7, ("event_id",))


@query("""SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5('99099:' || event_id), event_id) AS r FROM events) WHERE r <= 100""")
def q_reservoir(spark: SparkSession, d: str) -> DataFrame:
    return prep.reservoir(read(spark, d, "events").select("event_id", "event_type"), 100, 99099, "event_type", ("event_id",))


@query("""WITH r AS (SELECT event_id, event_type, seed, row_number() OVER (PARTITION BY event_type, seed ORDER BY md5(seed || ':' || event_id), event_id) AS r, count(*) OVER (PARTITION BY event_type, seed) AS n
  FROM events, (SELECT unnest([7, 11]::BIGINT[]) AS seed)),
t AS (SELECT event_id, event_type, seed, CASE WHEN r <= round_even(n * 0.05::DOUBLE, 0) THEN 0.05::DOUBLE WHEN r <= round_even(n * 0.2::DOUBLE, 0) THEN 0.2::DOUBLE WHEN r <= round_even(n * 0.5::DOUBLE, 0) THEN 0.5::DOUBLE END AS fraction FROM r)
SELECT * FROM t WHERE fraction IS NOT NULL""")
def q_sample_series(spark: SparkSession, d: str) -> DataFrame:
    """Three nested samples of each event type for two trials."""
    return prep.nested_samples(read(spark, d, "events").select("event_id", "event_type"), [0.5, 0.05, 0.2], [7, 11], ("event_id",), "event_type")


# ---------------------------------------------------------------- simulation
@query("""SELECT o_orderpriority AS category, count(*) AS n, round(avg(o_orderkey % 500), 6) AS avg_len, max(o_orderkey % 500) AS max_len,
CAST(greatest(floor(45.0::DOUBLE * sqrt(count(*))), 3000) AS BIGINT) AS target FROM orders GROUP BY 1""")
def q_model_stats(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "orders").select(c("o_orderpriority").alias("category"), (c("o_orderkey") % 500).alias("len"))
    return rounded(simulate.model_stats(v, "len").withColumn("target", simulate.target(c("n"), least=3000)))


_CHUNKS = """k AS (SELECT doc_id, text, unnest(generate_series(0, greatest(0, CAST(ceil((length(text) - 512) / 448.0) AS BIGINT) * 448), 448)) AS refoff FROM documents WHERE length(text) > 0),
ch AS (SELECT CAST(doc_id AS VARCHAR) AS refid, refoff, substr(text, refoff + 1, 512) AS piece FROM k)"""


@query(f"WITH {_CHUNKS} SELECT refid, refoff, CAST(length(piece) AS INTEGER) AS retsz, regexp_replace(translate(piece, 'acgt', 'ACGT'), '[^ACGT]', 'N', 'g') AS seq FROM ch")
def q_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _doc_chunks(spark, d).select("refid", "refoff", "retsz", "seq")


def _doc_chunks(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "documents").select(c("doc_id").cast("string").alias("refid"), F.lit("").alias("refid_full"), c("text").alias("seq"))
    return fasta.chunks_of(v, 512, 64)


@query(f"""WITH {_CHUNKS},
pl AS (SELECT refid, refoff, greatest(length(piece) - 64 + 1, 0) AS places FROM ch),
b AS (SELECT *, coalesce(sum(places) OVER (ORDER BY substr(md5(refid), 1, 3), refid, refoff ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bf, sum(places) OVER () AS total FROM pl),
t AS (SELECT 'u' AS category, 5000 AS target UNION ALL SELECT 'c', 777)
SELECT category, refid, refoff, CAST(floor(CAST(target * bf AS DOUBLE) / CAST(total AS DOUBLE)) AS BIGINT) AS "first", CAST(floor(CAST(target * (bf + places) AS DOUBLE) / CAST(total AS DOUBLE)) - floor(CAST(target * bf AS DOUBLE) / CAST(total AS DOUBLE)) AS BIGINT) AS n_reads
FROM b, t WHERE floor(CAST(target * (bf + places) AS DOUBLE) / CAST(total AS DOUBLE)) > floor(CAST(target * bf AS DOUBLE) / CAST(total AS DOUBLE))""")
def q_alloc(spark: SparkSession, d: str) -> DataFrame:
    targets = spark.createDataFrame([("u", 5000), ("c", 777)], "category string, target long")
    return simulate.allocate(_doc_chunks(spark, d), targets, 64).select("category", "refid", "refoff", "first", "n_reads")


@query("""WITH v AS (SELECT p_partkey AS k, regexp_replace(translate(p_name, 'acgt', 'ACGT'), '[^ACGT]', 'N', 'g') AS s, p_partkey % 2 = 0 AS fw FROM part),
m AS (SELECT k, fw, substr(s, 1, 2) || substr(s, 4, 3) AS seq FROM v)
SELECT k, 'sim!:chr:' || CASE WHEN fw THEN '+' ELSE '-' END || ':' || k || ':-7:u' AS name, CASE WHEN fw THEN seq ELSE reverse(translate(seq, 'ACGTN', 'TGCAN')) END AS seq, CASE WHEN fw THEN 'ABCDE' ELSE 'EDCBA' END AS qual FROM m""")
def q_fastq(spark: SparkSession, d: str) -> DataFrame:
    fw = c("k") % 2 == 0
    v = read(spark, d, "part").select(c("p_partkey").alias("k"), simulate.mutate(bases.normalise(c("p_name")), F.lit("==D==="), 1, c("p_partkey")).alias("s"))
    named = v.select("k", simulate.name(F.lit("chr"), fw, c("k"), F.lit(-7), F.lit("u")).alias("name"), simulate.oriented(c("s"), F.lit("ABCDE"), fw).alias("o"))
    return named.select("k", "name", "o.*")


@query()
def q_mutate_random(spark: SparkSession, d: str) -> DataFrame:
    """Random edits: tested by their properties."""
    ref = bases.normalise(c("p_name"))
    return read(spark, d, "part").select(c("p_partkey").alias("k"), ref.alias("ref"), simulate.mutate(ref, F.lit("=X=ISD=="), 99099, c("p_partkey")).alias("seq"))


# ---------------------------------------------------------------- rewriting and scripts
def _lines(spark: SparkSession, d: str) -> DataFrame:
    k = c("o_orderkey")
    raw = F.concat_ws("\t", F.concat(F.lit("r"), k), k % 4096, F.lit("chr1"), k % 1000 + 1, k % 43, F.lit("10M"), F.lit("*"), F.lit(0), F.lit(0), F.lit("ACGTACGTAC"), F.lit("IIIIIIIIII"), F.lit("ZT:Z:1,NA,3"), F.lit("MD:Z:10"))
    return read(spark, d, "orders").select(F.lit("f").alias("file"), k.alias("line"), raw.alias("raw"))


@query("""WITH v AS (SELECT o_orderkey AS k, o_orderkey % 2 = 0 AS hit, CAST(o_orderkey % 600 AS DOUBLE) / 10 AS m FROM orders)
SELECT k AS line, concat_ws(chr(9), 'r' || k, k % 4096, 'chr1', k % 1000 + 1, CASE WHEN hit THEN CAST(floor(m + 0.5) AS INTEGER) ELSE k % 43 END, '10M', '*', 0, 0, 'ACGTACGTAC', 'IIIIIIIIII')
 || CASE WHEN hit THEN '' ELSE chr(9) || 'ZT:Z:1,NA,3' END || chr(9) || 'MD:Z:10' || CASE WHEN hit THEN chr(9) || 'Zm:Z:' || (k % 43) || chr(9) || 'Zp:Z:' || printf('%.3f', m) ELSE '' END AS raw FROM v""")
def q_rewrite(spark: SparkSession, d: str) -> DataFrame:
    k = c("o_orderkey")
    p = read(spark, d, "orders").filter(k % 2 == 0).select(k.alias("line"), (k % 600 / 10).alias("mapq"))
    return rewrite.rewrite(_lines(spark, d), p, orig_flag="Zm:Z", precise_flag="Zp:Z").select("line", "raw")


@query("SELECT o_orderkey AS line, CAST(o_orderkey % 1001 AS DOUBLE) / 10 AS mapq FROM orders")
def q_merge_runs(spark: SparkSession, d: str) -> DataFrame:
    k = c("o_orderkey")
    o = read(spark, d, "orders").select(k.alias("line"), (k % 1001 / 10).alias("mapq"))
    return rewrite.merge_runs([o.filter(c("line") % 3 == i) for i in range(3)])


def _reads(spark: SparkSession, d: str, mate: int) -> DataFrame:
    k = c("p_partkey") if mate == 1 else c("p_partkey") * 7
    name = F.concat(F.lit("m contig=c"), k % 3, F.lit(" orig_begin="), k % 100, F.lit(" orig_end="), k % 100 + 50, F.lit(" strand="), F.when(k % 2 == mate % 2, "forward").otherwise("reverse"))
    return read(spark, d, "part").select(c("p_partkey").alias("ordinal"), name.alias("name"), F.substring("p_name", 1, 5).alias("seq"), F.lit("IIIII").alias("qual"))


_MASON = """v AS (SELECT p_partkey AS o, p_partkey % 100 + 1 AS l1, p_partkey % 100 + 50 AS r1, p_partkey % 3 AS c1, p_partkey % 2 = 1 AS f1,
  p_partkey * 7 % 100 + 1 AS l2, p_partkey * 7 % 100 + 50 AS r2, p_partkey * 7 % 3 AS c2, p_partkey * 7 % 2 = 0 AS f2, length(substr(p_name, 1, 5)) AS n, substr(p_name, 1, 5) AS seq FROM part),
x AS (SELECT *, CASE WHEN c1 <> c2 THEN 'refid' WHEN f1 = f2 THEN 'strands' WHEN (l1 < l2 AND f2) OR (r2 < r1 AND f1) THEN 'not compatible' ELSE 'kept' END AS reason FROM v)"""


@query(f"WITH {_MASON} SELECT reason, count(*) AS n FROM x GROUP BY 1")
def q_pair_filter(spark: SparkSession, d: str) -> DataFrame:
    return truth.reason_counts(truth.decoded_pairs(_reads(spark, d, 1), _reads(spark, d, 2)))


@query(f"""WITH {_MASON}, g AS (SELECT *, row_number() OVER (ORDER BY o) AS idx FROM x WHERE reason = 'kept'), m AS (SELECT 1 AS mate UNION ALL SELECT 2)
SELECT idx, mate, 'c' || c1 || '_' || least(l1, l2) || '_' || greatest(r1, r2) || '_0:0:0_0:0:0_' || n || '_' || n || '_' || CAST(f2 AS INTEGER) || '_' || idx || '/' || mate AS name, seq FROM g, m""")
def q_convert_pairs(spark: SparkSession, d: str) -> DataFrame:
    return truth.convert_pairs(_reads(spark, d, 1), _reads(spark, d, 2)).select("idx", "mate", "name", "seq")


@query("""WITH m AS (SELECT 1 AS mate UNION ALL SELECT 2) SELECT p_partkey AS ordinal, mate, 'r' || p_partkey || '/' || mate AS name, substr(p_name, mate, 5) AS seq FROM part, m""")
def q_interleave(spark: SparkSession, d: str) -> DataFrame:
    def reads(mate: int) -> DataFrame:
        name = F.concat(F.lit("r"), "p_partkey", F.lit("/1" if mate == 1 else ""))
        return read(spark, d, "part").select(c("p_partkey").alias("ordinal"), name.alias("name"), F.substring("p_name", mate, 5).alias("seq"), F.lit("I").alias("qual"))

    return rewrite.interleave(reads(1), reads(2)).drop("qual")
