"""Simulated reads of known origin: model statistics, targets, draws, mutation, names.

Random choices are hashes of (seed, read, place), so a recomputed task makes
the same reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phredloom.functions.bases import reverse_complement
from phredloom.functions.cigar import ref_length
from phredloom.functions.readnames import PREFIX

DRAWS = 10
BROADCAST_SLOTS = 1_000_000


def model_stats(templates: DataFrame, length: str) -> DataFrame:
    """``category``, ``n``, ``avg_len``, ``max_len``."""
    return templates.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.avg(length).alias("avg_len"), F.max(length).alias("max_len"))


def target(n: Column, function: str = "sqrt", factor: float = 45.0, least: int = 30_000) -> Column:
    """Reads to simulate: 0 for no input, else at least ``least``."""
    size = {"sqrt": factor * F.sqrt(n), "linear": factor * n, "const": F.lit(factor)}[function]
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(F.greatest(F.floor(size).cast("long"), F.lit(least).cast("long")))


def uniform(seed: int, *cols: Column) -> Column:
    """A double in [0, 1) from a hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) / F.lit(float(1 << 53))


def usable_chunks(chunks: DataFrame, overlap: int, most_n: float = 0.9) -> DataFrame:
    """Chunks at least ``overlap`` long with at most this share of N."""
    n = F.length("seq") - F.length(F.replace("seq", F.lit("N"), F.lit("")))
    return chunks.filter((F.col("retsz") >= overlap) & (n <= most_n * F.col("retsz")))


def allocate(chunks: DataFrame, targets: DataFrame, overlap: int) -> DataFrame:
    """``category``, chunk columns, ``first``, ``n_reads``: each category's target shared by length.

    Chunks stand in a fixed order (three hash digits of the sequence's name,
    name, offset). A chunk gets the target times the share of start places up
    to its end, floored, less the same up to its start: the shares add up to
    the target exactly. Running totals are kept inside the 4,096 values of the
    hash digits, and shifted by the totals of earlier values.
    """
    c = chunks.withColumn("_g", F.substring(F.md5("refid"), 1, 3)).withColumn("places", F.greatest(F.col("retsz") - overlap + 1, F.lit(0)).cast("long"))
    within = Window.partitionBy("_g").orderBy("refid", "refoff").rowsBetween(Window.unboundedPreceding, -1)
    groups = c.groupBy("_g").agg(F.sum("places").alias("_sum"))
    before = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)  # at most 4,096 rows
    groups = groups.select("_g", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    total = c.agg(F.sum("places").alias("_total"))
    asked = targets.agg(F.collect_list(F.struct("category", "target")).alias("_asked"))  # one row a category
    dealt = c.withColumn("_in", F.coalesce(F.sum("places").over(within), F.lit(0))).join(F.broadcast(groups), "_g")
    dealt = dealt.join(F.broadcast(total)).join(F.broadcast(asked)).withColumn("_t", F.explode("_asked"))  # one row each
    start = F.col("_start") + F.col("_in")
    lo = F.floor(F.col("_t.target") * start / F.col("_total"))
    hi = F.floor(F.col("_t.target") * (start + F.col("places")) / F.col("_total"))
    return dealt.select(F.col("_t.category").alias("category"), *chunks.columns, lo.alias("first"), (hi - lo).alias("n_reads")).filter("n_reads > 0")


def draw(allocated: DataFrame, templates: DataFrame, overlap: int, seed: int) -> DataFrame:
    """One row a read: category, read (number), chunk start, template, window of the reference.

    A template is drawn with replacement by its number (``slot`` from 0,
    ``n_slots`` of its category). Of ``DRAWS`` places the first whose window
    has only A, C, G, T is taken; a read without one is left out. A read takes
    its window out of the chunk before it meets its template: only the
    templates' spans (two numbers each) are broadcast, while they are within
    ``BROADCAST_SLOTS``, and no chunk is shuffled.
    """
    reads = allocated.withColumn("read", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n_reads") - 1)))
    sizes = templates.groupBy("category").agg(F.count(F.lit(1)).alias("n_slots"))
    reads = reads.join(F.broadcast(sizes), "category")
    reads = reads.withColumn("slot", F.floor(uniform(seed, F.col("category"), F.col("read"), F.lit("slot")) * F.col("n_slots")).cast("long"))
    span = F.greatest(F.coalesce("fraglen", F.lit(0)), ref_length(F.col("xscript1")), F.coalesce(ref_length(F.col("xscript2")), F.lit(0)))
    spans = templates.select("category", "slot", span.alias("span"))
    r = reads.join(F.broadcast(spans) if templates.count() <= BROADCAST_SLOTS else spans, ["category", "slot"])
    room = F.greatest(F.col("retsz") - overlap + 1, F.lit(1))
    places = F.transform(F.sequence(F.lit(0), F.lit(DRAWS - 1)), lambda i: F.floor(uniform(seed, F.col("category"), F.col("read"), i) * room).cast("int"))
    good = F.filter(places, lambda o: ~F.substring(F.col("seq"), o + 1, F.col("span").cast("int")).rlike("[^ACGT]") & (o + F.col("span") <= F.col("retsz")))
    r = r.withColumn("_o", F.get(good, F.lit(0))).filter("_o is not null")
    r = r.withColumn("window", F.substring("seq", F.col("_o") + 1, F.col("span").cast("int"))).withColumn("off", F.col("refoff") + F.col("_o")).drop("_o", "seq")
    return r.join(templates, ["category", "slot"])


def mutate(ref: Column, xscript: Column, seed: int, *key: Column) -> Column:
    """The read that an edit transcript makes of a reference string: = copies, X changes, I and S insert random bases (S also skips one), D skips."""
    bases = F.lit("ACGT")

    def roll(i: Column, n: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), *key, i), F.lit(n)).cast("int")

    def step(s: Column, op: Column) -> Column:
        here = F.substring(s["ref"], s["at"], F.lit(1))
        random = F.substring(bases, roll(s["i"], 4) + 1, F.lit(1))
        other = F.substring(F.replace(bases, here, F.lit("")), roll(s["i"], 3) + 1, F.lit(1))
        out = F.when(op == "=", here).when(op == "X", other).when(op.isin("I", "S"), random).when(op == "D", "").otherwise(F.raise_error(F.concat(F.lit("unknown edit: "), op)).cast("string"))
        return F.struct((s["at"] + F.when(op == "I", 0).otherwise(1)).alias("at"), (s["i"] + 1).alias("i"), F.concat(s["out"], out).alias("out"), s["ref"].alias("ref"))

    ops = F.regexp_extract_all(xscript, F.lit("."), 0)
    return F.aggregate(ops, F.struct(F.lit(1).alias("at"), F.lit(0).alias("i"), F.lit("").alias("out"), ref.alias("ref")), step, lambda s: s["out"])


def random_bases(n: Column, seed: int, *key: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(F.lit("ACGT"), F.pmod(F.xxhash64(F.lit(seed), *key, i), F.lit(4)).cast("int") + 1, F.lit(1))), "")


def oriented(seq: Column, qual: Column, fw: Column) -> Column:
    """struct<seq, qual> as a FASTQ record shows them."""
    return F.struct(F.when(fw, seq).otherwise(reverse_complement(seq)).alias("seq"), F.when(fw, qual).otherwise(F.reverse(qual)).alias("qual"))


def name(refid: Column, fw: Column, off: Column, score: Column, typ: Column, mate2: tuple[Column, Column, Column, Column] | None = None, prefix: str = PREFIX) -> Column:
    """Read name with one quadruple, or two for a pair, and the type."""

    def quad(a: Column, b: Column, c: Column, d: Column) -> list[Column]:
        return [a, F.when(b, "+").otherwise("-"), c.cast("string"), d.cast("string")]

    return F.concat_ws(":", F.lit(prefix), *quad(refid, fw, off, score), *(quad(*mate2) if mate2 else []), typ)


def mate_offset(off: Column, fraglen: Column, ref_len: Column) -> Column:
    """Where the downstream mate starts."""
    return off + F.greatest(fraglen, ref_len) - ref_len


def unpaired_reads(drawn: DataFrame, seed: int, prefix: str = PREFIX) -> DataFrame:
    """``read``, ``name``, ``seq``, ``qual`` from drawn unpaired templates (qual1, xscript1, fw1, score1)."""
    s = mutate(F.substring("window", F.lit(1), ref_length(F.col("xscript1"))), F.col("xscript1"), seed, F.col("category"), F.col("read"))
    d = drawn.withColumn("_s", s)
    return d.select("category", "read", name(F.col("refid"), F.col("fw1"), F.col("off"), F.col("score1"), F.lit("u"), prefix=prefix).alias("name"), oriented(F.col("_s"), F.col("qual1"), F.col("fw1")).alias("r")).select("category", "read", "name", "r.*")


def paired_reads(drawn: DataFrame, seed: int, prefix: str = PREFIX) -> DataFrame:
    """Both mates of concordant and discordant templates: ``read``, ``mate``, ``name``, ``seq``, ``qual``."""
    n1, n2 = ref_length(F.col("xscript1")), ref_length(F.col("xscript2"))
    up = F.col("upstream1")
    d = drawn.withColumn("off1", F.when(up, F.col("off")).otherwise(mate_offset(F.col("off"), F.col("fraglen"), n1)))
    d = d.withColumn("off2", F.when(up, mate_offset(F.col("off"), F.col("fraglen"), n2)).otherwise(F.col("off")))

    def seq(m: int, n: Column) -> Column:
        ref = F.substring("window", (F.col(f"off{m}") - F.col("off") + 1).cast("int"), n)
        return mutate(ref, F.col(f"xscript{m}"), seed, F.col("category"), F.col("read"), F.lit(m))

    d = d.withColumn("s1", seq(1, n1)).withColumn("s2", seq(2, n2))
    full = name(F.col("refid"), F.col("fw1"), F.col("off1"), F.col("score1"), F.col("category"), (F.col("refid"), F.col("fw2"), F.col("off2"), F.col("score2")), prefix)
    rows = [F.struct(F.lit(m).alias("mate"), full.alias("name"), oriented(F.col(f"s{m}"), F.col(f"qual{m}"), F.col(f"fw{m}")).alias("o")) for m in (1, 2)]
    return d.select("category", "read", F.explode(F.array(*rows)).alias("r")).select("category", "read", "r.mate", "r.name", "r.o.*")


def bad_end_reads(drawn: DataFrame, seed: int, prefix: str = PREFIX) -> DataFrame:
    """Pairs of which the template's mate (``mate_flag``) is real and the other random bases of length ``opp_len``."""
    s = mutate(F.substring("window", F.lit(1), ref_length(F.col("xscript1"))), F.col("xscript1"), seed, F.col("category"), F.col("read"))
    d = drawn.withColumn("_s", s).withColumn("_x", random_bases(F.col("opp_len"), seed, F.col("read"), F.lit("other"))).withColumn("_m", F.col("mate_flag").cast("int"))
    typ = F.concat(F.lit("b"), "mate_flag")
    q = (F.col("refid"), F.col("fw1"), F.col("off"), F.col("score1"))
    full = name(*q, typ, q, prefix)
    real = F.struct(F.col("_m").alias("mate"), full.alias("name"), oriented(F.col("_s"), F.col("qual1"), F.col("fw1")).alias("o"))
    other = F.struct((3 - F.col("_m")).alias("mate"), full.alias("name"), F.struct(F.col("_x").alias("seq"), F.repeat(F.lit("I"), F.col("opp_len")).alias("qual")).alias("o"))
    return d.select("category", "read", F.explode(F.array(real, other)).alias("r")).select("category", "read", "r.mate", "r.name", "r.o.*")
