"""Source divergence audit: how far each source of a language strays from each other and from the whole.

Every kept term of a language is one wide row, an array indexed by the
language's sources (places without the term are left out), each value a smoothed
share in thousand-millionths (p). Higher-order functions turn the row into
contributions of source pairs, which are added up inside tasks first.

With p0 the share of a count of 0, a pair's contribution f(p, q) is taken apart:

    f(p, q) = f(p0, q0) + [f(p, q0) - f(p0, q0)] + [f(p0, q) - f(p0, q0)]
            + [f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)]

The first is a constant, the second and third depend on one source's count alone
(so on a small table of how many terms have which count in which source), and the
last is 0 unless both sources have the term: only those pairs are emitted. The
result is the sum over all kept terms, exactly.

All arithmetic is on integers. A share is worked out as 32,000 * 31,250 parts in
two divisions, exact for languages of up to 2.9e14 counted terms; beyond, Spark
raises an overflow error and gives no wrong figure.

What grows: a wide row's pairs and the result have the sources of one language
squared; a language's row (its sources, their totals) is broadcast only up to
``BROADCAST_SOURCES`` sources. A hot source or language is counted inside tasks
and spread by term.

Defined results: null text, lang and source count as ''; a group without terms is
kept, with p of counts of 0; a language without kept terms gives pairs of value 0
and no terms; a language of one source gives no pairs; ties go to the item that
is smaller as UTF-8; repeated rows count each for itself, as documents too; other
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phredloom.llm.common import materialize, slices, small, tidy

UNIT = 1_000_000_000  # = 32,000 * 31,250
BROADCAST_SOURCES = 100_000  # about 5 MB of names and totals
HELD_TERMS = 500_000  # counts that a task holds: some 120 MB
#: A-Z lower-cased, other ASCII than letters a space; bytes of longer characters stay.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def share(count: str, total: str) -> str:
    """1 + floor(UNIT * (count + 1) / total), as SQL on longs, without the product."""
    x, d = f"(({count}) + 1) * 32000", f"({total})"
    return f"(1 + 31250 * (({x}) div {d}) + (31250 * (({x}) % {d})) div {d})"


def terms(text: bytes | None) -> list[bytes]:
    """Runs of letters A-Z, lower-cased, and characters from 0x80 on."""
    return (text or b"").translate(_TERMS).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` occurrences, ``docs`` that hold it; all rows of a term in one partition.

    A task adds up its own documents first and gives its counts away whenever it
    holds ``HELD_TERMS`` of them.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0

        def give() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, seen) in held.items():
                words = list(n)
                for i in range(0, len(words), 50_000):
                    part = words[i : i + 50_000]
                    texts = pa.array(part, pa.binary()).cast(pa.string())
                    numbers = (pa.array([c[w] for w in part], pa.int64()) for c in (n, seen))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), texts, *numbers], names=names)
            held.clear()

        for part in slices(batches):
            for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist(), strict=True):
                n, seen = held.setdefault((lang, source), (Counter(), Counter()))
                words, before = terms(text), len(n)
                n.update(words)
                seen.update(set(words))
                size += len(n) - before
                if size > HELD_TERMS:
                    yield from give()
                    size = 0
        yield from give()

    names = ["lang", "source", "term", "n", "docs"]
    flat = docs.select("lang", "source", "text").mapInArrow(tidy(count), "lang string, source string, term string, n long, docs long")
    return flat.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def audit(docs: DataFrame, least_docs: int = 3, top_terms: int = 200) -> DataFrame:
    """``lang``, ``source``, ``part`` ('pair' or 'term'), ``item``, ``value``, ``rank`` for every (lang, source) of ``docs``."""
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")))
    per_term = term_counts(docs).groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("s"), F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = materialize(per_term.filter(F.col("docs") >= least_docs).drop("docs"))

    groups = docs.select("lang", "source").distinct()
    used = kept.select("lang", F.inline("s")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    size = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    known = materialize(
        groups.join(used, ["lang", "source"], "left").join(size, "lang", "left")
        .select("lang", "source", F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.coalesce("v", F.lit(0)).cast("long").alias("v"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("source", "total")))
    langs = known.groupBy("lang").agg(ordered.alias("s"), F.sum("total").alias("total"), F.first("v").alias("v"))
    nothing = share("0", "total + v")
    langs = langs.select(
        "lang", "v", (F.col("total") + F.col("v")).alias("all_d"), F.col("s.source").alias("names"), F.expr("transform(s, x -> x.total + v)").alias("d"),
        F.when(F.col("v") > 0, F.expr(f"transform(s, x -> {nothing.replace('total', 'x.total')})")).alias("p0"),
    )
    near = known.count()
    at = "cast(array_position(names, e.source) - 1 as int)"
    wide = kept.withColumnRenamed("n", "all_n").join(small(langs, near, BROADCAST_SOURCES), "lang")
    wide = wide.withColumn("x", F.expr(f"array_sort(transform(s, e -> struct({at} as i, e.n as n)))"))
    wide = wide.withColumn("x", F.expr(f"transform(x, e -> struct(e.i as i, {share('e.n', 'd[e.i]')} as p, p0[e.i] as z))"))

    def gap(p: str, q: str) -> str:
        return f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})"

    def beyond(p: str, q: str, p_none: str, q_none: str) -> str:
        return f"{gap(p, q)} - {gap(p, q_none)} - {gap(p_none, q)} + {gap(p_none, q_none)}"

    pair = "struct(a.i as i, b.i as j, a.p as p, b.p as q, a.z as y, b.z as z)"
    met = wide.filter("size(x) > 1").select("lang", F.expr(f"inline(flatten(transform(x, (a, u) -> transform(slice(x, u + 2, size(x)), b -> {pair}))))"))
    met = met.selectExpr("lang", "i", "j", f"{beyond('p', 'q', 'y', 'z')} as f", f"{beyond('q', 'p', 'z', 'y')} as g")
    summed = met.groupBy("lang", "i", "j").agg(F.sum("f").alias("f"), F.sum("g").alias("g"))
    ways = (F.struct(F.col(a).alias("i"), F.col(b).alias("j"), F.col(f).alias("f")) for a, b, f in (("i", "j", "f"), ("j", "i", "g")))
    parts = summed.select("lang", F.inline(F.array(*ways)))
    held = wide.select("lang", F.inline("x")).groupBy("lang", "i", "p").agg(F.count(F.lit(1)).alias("terms"))
    held = held.join(small(langs.select("lang", "p0"), near, BROADCAST_SOURCES), "lang").withColumn("o", F.explode(F.expr("sequence(0, size(p0) - 1)"))).filter("o != i")
    ours = held.select("lang", "i", F.col("o").alias("j"), F.expr(f"terms * ({gap('p', 'p0[o]')} - {gap('p0[i]', 'p0[o]')})").alias("f"))
    theirs = held.select("lang", F.col("o").alias("i"), F.col("i").alias("j"), F.expr(f"terms * ({gap('p0[o]', 'p')} - {gap('p0[o]', 'p0[i]')})").alias("f"))
    summed = parts.unionByName(ours).unionByName(theirs).groupBy("lang", "i", "j").agg(F.sum("f").alias("f"))

    pairs = langs.select("lang", "v", "names", "p0", F.posexplode("names").alias("i", "source")).select("lang", "v", "p0", "i", "source", F.posexplode("names").alias("j", "item")).filter("i != j")
    none = F.expr(f"v * coalesce({gap('p0[i]', 'p0[j]')}, 0)")
    pairs = pairs.join(summed, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", (F.coalesce("f", F.lit(0)) + none).cast("long").alias("value"))

    q = wide.withColumn("q", F.expr(share("all_n", "all_d")))
    strays = q.select("lang", "term", "q", F.expr("inline(transform(filter(x, e -> e.p > q), e -> struct(names[e.i] as source, e.p as p)))"))
    strays = strays.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(gap("p", "q")).alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(strays.withColumn("rank", rank).filter(F.col("rank") <= top_terms))
