"""Benchmark decontamination by template canonicalisation (built-in functions only).

Numbers, names and units of a text become typed placeholders, punctuation and
case go, and what is left is a token template that stays aligned with the words
themselves. Windows of ``WINDOW`` tokens of documents are hash-joined to those
of benchmark items:

* a window of an item that holds placeholders is joined as a template, and its
  slots are checked: along one alignment (document position minus item
  position), a benchmark slot value must always stand for the same document
  value; where one stands for several, windows that hold a changed one of these
  do not count, and the others do. So a question asked again with other numbers
  or names is found, and a chance meeting of placeholders is not;
* whether a word counts as a name depends on what stands before it and on its
  case, so windows with names are also joined with their names as plain words:
  a copy is found whatever precedes it and in any case;
* a window without placeholders is joined by its words. So is one that consists
  of placeholders only, or whose template the item repeats: such a template says
  nothing about where it belongs, and any list of numbers would meet it at every
  place. These need no alignment, so a document sends each of them once, and the
  number of matches is linear in the document and in the item.

A document is contaminated by an item if its counted windows cover at least
``LEAST`` different windows of the item (13 tokens), or all of an item with
fewer. Items shorter than a window are one window of their own length.

Only the benchmark's window hashes and the keys of documents whose slots must
be read are broadcast, each only while its counted number of rows is within
``BROADCAST_ROWS`` (rows of under 50 bytes); else the join shuffles.

Defined results: null and empty texts and items match nothing; rows with equal
doc_id and different texts are compared each for itself and reported once per
(doc_id, item_id) by the larger match; a null doc_id is kept as null; very long
texts are read in whole; an item of placeholders only is found by its own
values; an item without an id takes no part; the empty benchmark gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phredloom.llm.common import documents, materialize, small

WINDOW = 8
LEAST = 6
BROADCAST_ROWS = 1_000_000
NUMBER, NAME, UNIT = chr(0xE000), chr(0xE001), chr(0xE002)
# Units of measurement and currency that may follow a number.
UNITS = "mm cm dm m km in ft yd mi mg g kg t lb oz ml cl l s sec min h hr hrs ms kb mb gb tb hz khz mhz ghz w kw v a k c f usd eur gbp percent degrees degree dollars dollar cents cent euros euro pounds pound meters meter metres metre kilometers kilometer kilometres kilometre miles mile feet foot inches inch grams gram kilograms kilogram liters liter litres litre seconds second minutes minute hours hour days day weeks week months month years year".split()
_STRIP = r"[^\p{L}\p{N}\s\x{E000}-\x{E002}]+"


def _tokens(s: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.regexp_replace(s, _STRIP, ""), r"\s+", " ")), " ")


def _clean(text: Column) -> Column:
    return F.translate(text, NUMBER + NAME + UNIT, "")


def _fold(s: Column) -> Column:
    """Lower case by way of upper case, so that letters with two lower-case forms, or none in upper case, meet."""
    return F.lower(F.upper(s))


def raw_tokens(text: Column) -> Column:
    """The lower-case words that a template describes, position by position."""
    return _tokens(_fold(_clean(text)))


def _marked(text: Column) -> Column:
    """The text with numbers, units and names (capitalised words inside a sentence) replaced by placeholders."""
    named = F.regexp_replace(_clean(text), r"(?<=[\p{Ll},;]\s)\p{Lu}\p{Ll}+(?![\p{L}\p{N}])", NAME)
    numbered = F.regexp_replace(named, r"[+-]?\p{Nd}[\p{Nd}.,:/]*", NUMBER)
    unit = F.regexp_replace(numbered, rf"({NUMBER}\s?)(?i:{'|'.join(UNITS)})(?!\p{{L}})", f"$1{UNIT}")
    return F.when(text.rlike(r"\p{Nd}"), unit).otherwise(named)


def _hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda x: F.xxhash64(x))


def _with_hashes(df: DataFrame, *keys: str) -> DataFrame:
    """``keys``, tokens ``t`` (template), ``r`` (words), ``u`` (template with names as words), and their hashes th, rh, uh."""
    df = df.select(*keys, _marked(F.col("text")).alias("marked"), _clean(F.col("text")).alias("clean"))
    df = df.select(*keys, "marked", "clean", _tokens(_fold(F.col("marked"))).alias("t"))
    df = df.select(*keys, "t", F.when(F.col("marked") == F.col("clean"), F.col("t")).otherwise(_tokens(_fold(F.col("clean")))).alias("r"))
    df = df.withColumn("th", _hashes(F.col("t"))).withColumn("rh", F.when(F.col("t") == F.col("r"), F.col("th")).otherwise(_hashes(F.col("r"))))
    named, numbered = F.array_contains("t", NAME), F.array_contains("t", NUMBER)
    u = F.when(~named, F.col("t")).when(~numbered, F.col("r")).otherwise(F.zip_with("t", "r", lambda t, r: F.when(t == NAME, r).otherwise(t)))
    df = df.withColumn("u", u)
    return df.withColumn("uh", F.when(~named, F.col("th")).when(~numbered, F.col("rh")).otherwise(_hashes(F.col("u"))))


def _window(hashes: str, i: Column, n: int, placed: bool) -> Column:
    """Hash of the window of ``n`` tokens from ``i`` (from 1); windows with and without a place do not meet."""
    return F.xxhash64(F.lit(-n if placed else n), F.slice(hashes, i, n))


_NO_PLACES = "cast(array() as array<struct<pos:int,h:bigint>>)"


def _places(n: int) -> Column:
    """(pos, h) of the windows of a document: by words once each with null pos; by template with pos where it differs."""
    starts = F.sequence(F.lit(1), F.size("th") - n + 1)
    words = F.array_distinct(F.transform(starts, lambda i: _window("rh", i, n, False)))
    words = F.transform(words, lambda h: F.struct(F.lit(None).cast("int").alias("pos"), h.alias("h")))

    def at(hashes: str, which: Column) -> Column:
        return F.transform(which, lambda i: F.struct((i - 1).alias("pos"), _window(hashes, i, n, True).alias("h")))

    slotted = F.filter(starts, lambda i: F.slice("th", i, n) != F.slice("rh", i, n))
    named = F.filter(starts, lambda i: (F.slice("th", i, n) != F.slice("uh", i, n)) & (F.slice("uh", i, n) != F.slice("rh", i, n)))
    placed = F.when(F.col("th") == F.col("rh"), F.expr(_NO_PLACES)).when((F.col("th") == F.col("uh")) | (F.col("uh") == F.col("rh")), at("th", slotted))
    return F.when(F.size("th") >= n, F.concat(words, placed.otherwise(F.concat(at("th", slotted), at("uh", named))))).otherwise(F.expr(_NO_PLACES))


def _item_windows(items: DataFrame, n: int) -> DataFrame:
    """item_id, at, kind (0 words, 1 template, 2 template with names as words), h, item_windows, slots; for items of window size ``n``."""
    own = items.filter(F.least(F.size("t"), F.lit(WINDOW)) == n)
    w = own.select("*", F.explode(F.sequence(F.lit(0), F.size("t") - n)).alias("at"))
    i = F.col("at") + 1
    w = w.select(
        "item_id", "at", F.xxhash64("rh").alias("item"), (F.size("t") - n + 1).alias("item_windows"),
        *(F.slice(x, i, n).alias(x) for x in "tru"), _window("rh", i, n, False).alias("words"), _window("th", i, n, True).alias("templated"), _window("uh", i, n, True).alias("plain"),
    )
    w = w.withColumn("times", F.count(F.lit(1)).over(Window.partitionBy("item_id", "item", "templated")))

    def slots(of: str) -> Column:
        here = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda j: F.struct(j.alias("j"), F.element_at("r", j).alias("value"), F.element_at(of, j).alias("kind")))
        return F.filter(here, lambda s: s["kind"].rlike(f"[{NUMBER}-{UNIT}]"))

    n_slots = F.size(slots("t"))
    none = F.filter(slots("t"), lambda s: F.lit(False))
    words = F.struct(F.lit(0).alias("kind"), F.col("words").alias("h"), none.alias("slots"))
    templated = F.struct(F.lit(1).alias("kind"), F.col("templated").alias("h"), slots("t").alias("slots"))
    plain = F.struct(F.lit(2).alias("kind"), F.col("plain").alias("h"), slots("u").alias("slots"))
    kinds = (
        F.when((n_slots == 0) | (n_slots == n) | (F.col("times") > 1), F.array(words))
        .when(F.col("u") == F.col("t"), F.array(templated))
        .when(F.col("u") == F.col("r"), F.array(templated, words))
        .otherwise(F.array(templated, plain))
    )
    return w.select("item_id", "at", "item_windows", F.inline(kinds))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id``, ``item_id``, ``matched``, ``item_windows``, ``n_slots``, ``reparameterised`` of every contaminated pair."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    items = _with_hashes(items.filter("item_id is not null"), "item_id").filter("size(t) > 1 or t[0] <> ''")
    sizes = sorted(r[0] for r in items.select(F.least(F.size("t"), F.lit(WINDOW)).alias("n")).distinct().collect())  # at most WINDOW values
    if not sizes:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, matched int, item_windows int, n_slots long, reparameterised boolean")
    bench = _item_windows(items, sizes[0])
    for n in sizes[1:]:
        bench = bench.unionByName(_item_windows(items, n))
    bench = materialize(bench)
    n_windows = bench.count()

    rows = documents(docs).withColumn("row", F.xxhash64("text"))
    keys = small(bench.select("h", "item_id", "at", "kind", "item_windows"), n_windows, BROADCAST_ROWS)
    exploded = _with_hashes(rows, "doc_id", "row").select("doc_id", "row", F.inline(F.concat(*map(_places, sizes))))
    hits = materialize(exploded.join(keys, "h").select("doc_id", "row", "pos", "item_id", "at", "kind", "item_windows").distinct())

    # slot values only for the documents that have a window with placeholders
    slotted = hits.filter("kind > 0")
    owners = materialize(slotted.select(F.col("doc_id").alias("d"), F.col("row").alias("r")).distinct())
    owners = small(owners, owners.count(), BROADCAST_ROWS)
    texts = rows.join(owners, (F.col("row") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
    raw = texts.distinct().select(F.col("doc_id").alias("d"), F.col("row").alias("r"), raw_tokens(F.col("text")).alias("raw"))
    alignment = ["doc_id", "row", "item_id", "shift"]
    values = F.transform("slots", lambda s: F.struct(s["value"].alias("asked"), F.element_at("raw", F.col("pos") + s["j"]).alias("given")))
    slots = materialize(
        slotted.join(bench.filter("kind > 0").select("item_id", "at", "kind", "slots"), ["item_id", "at", "kind"])
        .join(raw, (F.col("row") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d")))
        .select("doc_id", "row", "item_id", (F.col("pos") - F.col("at")).alias("shift"), "at", "item_windows", values.alias("values"))
    )
    torn = (
        slots.select(*alignment, F.explode("values").alias("v"))
        .groupBy(*alignment, F.col("v.asked").alias("asked"))
        .agg(F.min("v.given").alias("lo"), F.max("v.given").alias("hi"))
        .filter("lo <> hi")
        .groupBy(*alignment)
        .agg(F.collect_set("asked").alias("torn"))
        .select(*(F.col(c).alias(f"_{c}") for c in alignment), "torn")
    )
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) if c == "doc_id" else F.col(c) == F.col(f"_{c}") for c in alignment]
    broken = F.exists("values", lambda v: (v["given"] != v["asked"]) & F.array_contains("torn", v["asked"]))
    held = slots.join(torn, same, "left").filter(F.col("torn").isNull() | ~broken).select(*slots.columns)
    bare = hits.filter("kind = 0").select("doc_id", "row", "item_id", F.lit(None).cast("int").alias("shift"), "at", "item_windows").withColumn("values", F.array().cast(slots.schema["values"].dataType))
    aligned = held.unionByName(bare).groupBy(*alignment).agg(
        F.collect_set("at").alias("at"), F.first("item_windows").alias("item_windows"),
        F.size(F.array_distinct(F.flatten(F.collect_list("values.asked")))).alias("n_slots"), F.bool_or(F.exists("values", lambda v: v["given"] != v["asked"])).alias("changed"),
    )
    per_row = (
        aligned
        .groupBy("doc_id", "row", "item_id")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("matched"), F.first("item_windows").alias("item_windows"),
            F.max("n_slots").cast("long").alias("n_slots"), F.bool_or("changed").alias("reparameterised"),
        )
        .filter(F.col("matched") >= F.least(F.col("item_windows"), F.lit(LEAST)))
    )
    best = per_row.groupBy("doc_id", "item_id").agg(F.max(F.struct("matched", "item_windows", "n_slots", "reparameterised")).alias("b"))
    return best.select("doc_id", "item_id", "b.matched", "b.item_windows", "b.n_slots", "b.reparameterised")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in no contaminated pair; rows without a doc_id go by themselves (kept)."""
    bad = materialize(contaminated(docs, benchmark).select("doc_id").filter("doc_id is not null").distinct())
    return docs.join(small(bad, bad.count(), BROADCAST_ROWS), "doc_id", "left_anti").select(*docs.columns)
