"""Personal data: base patterns, and identifiers found by bootstrapped contexts (built-in functions only).

Base spans are regular-expression matches that pass their kind's test. They
seed the bootstrap: the words around a span make its lexical patterns (``a b _``,
``a _ c``, ``a _``, ``_ c``; lower case, digits as 0, of any length). Other
identifier-like tokens (long, with many digits, not overlapping a base span) are
candidate instances. Two tests come before any scoring: a pattern needs
``LEAST_SEEDS`` different seeds (base spans; what the bootstrap finds does not
count) and a candidate, and identifiers must be in at least ``LEAST_SHARE`` of all
places of the corpus where its words stand so, whether it has one word or two:
``the _`` and ``the _ the`` prove nothing. On the graph of the patterns that are
left and their instances, a pattern's confidence is the scored share of its
instances, an instance's score grows with its patterns' confidences, and both are
worked out in turn ``ROUNDS`` times. Candidates in the context of a trusted pattern
become spans of the kind ``id``.

Matching once gives the matches and the gaps between them; running sums of
their lengths give the positions, so no text is searched twice for a position.
Expressions are possessive or anchored so that long texts cost linear time.

Offsets are code points, end exclusive. Defined results: a null or empty text
has no spans; repeated rows get the same result each; a null doc_id is kept;
other columns are not read (``redact`` returns them as they are, whatever their
names); the empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phredloom.llm.common import documents, materialize, small

# The kinds in order, and the base expressions (in linear-time form).
KINDS = ["email", "ip", "card", "phone", "id"]
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CANDIDATE = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"
ROUNDS = 3
LEAST_CONFIDENCE = 0.7
LEAST_SEEDS = 3
LEAST_SHARE = 0.5
BROADCAST_PATTERNS = 100_000
BROADCAST_SPANS = 500_000


def _plain(words: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(words), "[0-9]", "0"), r"\s+", " "))


def _contexts(before: Column, after: Column) -> Column:
    """The lexical patterns of a match between two gaps; read from the near end of each gap, so a long gap costs one pass."""
    left = _plain(F.reverse(F.regexp_extract(F.reverse(before), r"^\s*+(\S++(?:\s++\S++)?)", 1)))
    right = _plain(F.regexp_extract(after, r"^\s*+(\S++)", 1))
    near = F.substring_index(left, " ", -1)
    here = F.lit(" _")
    return F.array(
        F.when(left != near, F.concat(left, here)), F.when((near != "") & (right != ""), F.concat(near, here, F.lit(" "), right)),
        F.when(near != "", F.concat(near, here)), F.when(right != "", F.concat(F.lit("_ "), right)),
    )


def _found(kind: int, only_if: Column) -> Column:
    """The matches of one kind (columns ``g<kind>``, the gaps, and ``m<kind>``, the matches) with their contexts."""
    gaps, matches = f"g{kind}", f"m{kind}"
    zipped = F.arrays_zip(F.col(gaps).alias("gap"), F.col(matches).alias("match"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("after"))
    parts = F.transform(
        F.filter(zipped, lambda x: x["match"].isNotNull()),
        lambda x: F.struct(F.lit(kind).alias("kind"), F.length(x["gap"]).alias("gap"), x["match"].alias("match"), F.array_compact(_contexts(x["gap"], x["after"])).alias("contexts")),
    )
    return F.when(only_if, parts).otherwise(F.expr("cast(array() as array<struct<kind:int,gap:int,match:string,contexts:array<string>>>)"))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _valid(kind: Column, match: Column) -> Column:
    digits = _digits(match)
    n = F.length(digits)
    octets = F.forall(F.split(match, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(F.split(match, r"\."), lambda p: F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(0)) <= 255)
    return (
        F.when(kind == 1, True)
        .when(kind == 2, octets)
        .when(kind == 3, n.between(13, 19) & F.call_function("luhn_check", digits))
        .when(kind == 4, n.between(9, 15))
        .otherwise((F.length(match) >= 6) & (n >= 4))
    )


def marks(docs: DataFrame) -> DataFrame:
    """All base spans and candidates with their positions, and one row without a match for every text.

    Columns: doc_id, row (hash of the text), copies, kind, start, end, match, contexts.
    """
    text = F.col("text")
    digit = text.rlike("[0-9]")
    kinds = [(EMAIL, F.contains(text, F.lit("@"))), (IP, text.rlike(r"[0-9]\.[0-9]")), (CARD, digit), (PHONE, text.rlike(r"\+[0-9]")), (CANDIDATE, digit)]
    d = documents(docs).select("doc_id", F.xxhash64("text").alias("row"), "text", *(may.alias(f"may{k}") for k, (_, may) in enumerate(kinds, 1)))
    cut = [x for k, (p, _) in enumerate(kinds, 1) for x in (F.when(F.col(f"may{k}"), F.split(text, p, -1)).alias(f"g{k}"), F.when(F.col(f"may{k}"), F.regexp_extract_all(text, F.lit(p), 0)).alias(f"m{k}"))]
    d = d.select("*", *cut)
    found = F.concat(*(_found(k, F.col(f"may{k}")) for k in range(1, 6)))
    rows = d.select("doc_id", "row", F.posexplode_outer(found).alias("pos", "m"))
    rows = rows.groupBy("doc_id", "row", "pos").agg(F.first("m").alias("m"), F.count(F.lit(1)).alias("copies"))
    along = Window.partitionBy("doc_id", "row", "m.kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.coalesce(F.length("m.match"), F.lit(0))).over(along)
    rows = rows.select("doc_id", "row", "copies", "pos", "m.kind", "m.match", "m.contexts", end.alias("end"))
    # a candidate is the token without punctuation at its ends
    core = F.regexp_replace(F.regexp_replace("match", r"^[^\p{L}\p{N}]++", ""), r"(?<=[\p{L}\p{N}])[^\p{L}\p{N}]++$", "")
    lead = F.length(F.regexp_extract("match", r"^[^\p{L}\p{N}]*+", 0))
    start = F.col("end") - F.length("match")
    is_candidate = F.col("kind") == 5
    rows = rows.select(
        "doc_id", "row", "copies", "pos", "kind", "contexts",
        F.when(is_candidate, start + lead).otherwise(start).alias("start"),
        F.when(is_candidate, core).otherwise(F.col("match")).alias("match"),
    )
    rows = rows.select("doc_id", "row", "copies", "pos", "kind", "contexts", "start", (F.col("start") + F.length("match")).alias("end"), "match", _valid(F.col("kind"), F.col("match")).alias("valid"))
    # candidates must not overlap a base span
    base = F.col("valid") & F.col("match").isNotNull() & (F.col("kind") < 5)
    up = Window.partitionBy("doc_id", "row").orderBy("start", "kind", "pos").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("doc_id", "row").orderBy(F.desc("start"), F.desc("kind"), F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    clear = (F.coalesce(F.max(F.when(base, F.col("end"))).over(up), F.lit(0)) <= F.col("start")) & (
        F.coalesce(F.min(F.when(base, F.col("start"))).over(down), F.col("end")) >= F.col("end")
    )
    rows = rows.withColumn("use", F.coalesce(F.col("valid") & F.col("match").isNotNull() & ((F.col("kind") < 5) | clear), F.lit(False)))
    return rows.filter(F.col("use") | (F.col("pos").isNull()) | (F.col("pos") == 0)).select(
        "doc_id", "row", "copies", *(F.when(F.col("use"), F.col(c)).alias(c) for c in ("kind", "start", "end", "match", "contexts"))
    )


def _occurrences(docs: DataFrame, contexts: DataFrame, n: int) -> DataFrame:
    """``context``, ``seen``: the places of the corpus where the words of each pattern stand as it says, whatever stands between them."""
    head = F.regexp_extract("context", r"^(?:_ )?+(\S++)", 1)
    heads = contexts.select(head.alias("w")).distinct()
    words = documents(docs).select(F.split(_plain(F.col("text")), " ").alias("words"))
    places = words.select(F.inline(F.expr("transform(words, (w, i) -> struct(w as w, get(words, i + 1) as next, get(words, i + 2) as last))"))).join(small(heads, n, BROADCAST_PATTERNS), "w", "left_semi")
    here = F.lit(" _")
    forms = F.array(
        F.concat(F.lit("_ "), "w"), F.concat("w", here), F.when(F.col("next").isNotNull(), F.concat("w", F.lit(" "), "next", here)), F.when(F.col("last").isNotNull(), F.concat("w", here, F.lit(" "), "last"))
    )
    return places.select(F.explode(forms).alias("context")).join(small(contexts, n, BROADCAST_PATTERNS), "context", "left_semi").groupBy("context").agg(F.count(F.lit(1)).alias("seen"))


def confident_patterns(found: DataFrame, docs: DataFrame) -> DataFrame:
    """``context``, ``seeds`` and ``confidence`` of the patterns that the bootstrap trusts."""
    edge = found.filter("match is not null").select(F.explode("contexts").alias("context"), F.xxhash64(F.lower("match")).alias("instance"), (F.col("kind") < 5).alias("seed"))
    members = materialize(edge.groupBy("context", "instance").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("times")))
    useful = members.groupBy("context").agg(F.count_if(~F.col("seed")).alias("open"), F.count_if("seed").alias("seeds"), F.sum("times").alias("times"))
    useful = materialize(useful.filter((F.col("open") > 0) & (F.col("seeds") >= LEAST_SEEDS)).select("context", "seeds", "times"))
    if n_useful := useful.count():
        seen = _occurrences(docs, useful.select("context"), n_useful)
        useful = materialize(useful.join(seen, "context", "left").filter(F.col("times") >= LEAST_SHARE * F.coalesce("seen", F.lit(0))).select("context", "seeds"))
        n_useful = useful.count()
    if not n_useful:  # nothing is left to score
        return useful.select("context", "seeds", F.lit(0.0).alias("confidence")).limit(0)
    edges = materialize(members.drop("times").join(small(useful.select("context"), n_useful, BROADCAST_PATTERNS), "context", "left_semi"))
    scored = edges.withColumn("score", F.col("seed").cast("double"))
    patterns = None
    for _ in range(ROUNDS):
        patterns = scored.groupBy("context").agg((F.sum("score") / (F.count(F.lit(1)) + 1)).alias("confidence"))
        lifted = edges.filter(~F.col("seed")).join(small(patterns, n_useful, BROADCAST_PATTERNS), "context").groupBy("instance").agg((1 - F.exp(F.sum(F.log(1 - 0.95 * F.col("confidence"))))).alias("lift"))
        scored = edges.join(lifted, "instance", "left").select("context", "instance", F.when(F.col("seed"), F.lit(1.0)).otherwise(F.coalesce("lift", F.lit(0.0))).alias("score"))
    return patterns.filter(F.col("confidence") >= LEAST_CONFIDENCE).join(useful, "context").select("context", "seeds", "confidence")


def spans(docs: DataFrame) -> DataFrame:
    """One row per text: doc_id, row, copies, ``spans`` array<struct<kind, start, end>> by kind and start; kind 5 is discovered."""
    found = materialize(marks(docs))
    trusted = materialize(confident_patterns(found, docs).select("context"))
    open_ = found.filter("kind = 5").select("doc_id", "row", "start", F.explode("contexts").alias("context"))
    ids = open_.join(small(trusted, trusted.count(), BROADCAST_PATTERNS), "context", "left_semi").groupBy("doc_id", "row", "start").agg(F.lit(True).alias("trusted"))
    span = F.struct("kind", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    same = [F.col("doc_id").eqNullSafe(F.col("d")), F.col("row") == F.col("r"), F.col("start") == F.col("s")]
    ids = ids.toDF("d", "r", "s", "trusted")
    tested = found.filter("kind = 5").join(ids, same).select(*found.columns)
    kept = found.filter("kind is null or kind < 5").unionByName(tested)
    kept = kept.unionByName(found.filter("kind = 5").select("doc_id", "row", "copies").withColumns({c: F.lit(None).cast(found.schema[c].dataType) for c in ("kind", "start", "end", "match", "contexts")}))
    span = F.when(F.col("kind").isNotNull(), span)
    return kept.groupBy("doc_id", "row").agg(F.max("copies").alias("copies"), F.array_sort(F.collect_set(span)).alias("spans"))


def written(spans_col: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans_col, lambda s: F.concat_ws(":", F.element_at(names, s["kind"]), s["start"], s["end"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """Counts and digests per row of ``docs``, as the query returns them."""
    s = spans(docs)
    s = s.select("doc_id", "spans", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    base = F.filter("spans", lambda x: x["kind"] < 5)

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")

    return s.select(
        "doc_id", *(count(i + 1).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])),
        F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), count(5).alias("n_id"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in square brackets, and ``n_chars`` made to fit. Overlapping spans become one."""
    s = spans(docs).filter(F.size("spans") > 0).select(F.col("doc_id").alias("__pii_d"), F.col("row").alias("__pii_r"), "spans")
    by_start = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    s = materialize(s.select("__pii_d", "__pii_r", by_start.alias("__pii_s")))
    s = small(s, s.agg(F.coalesce(F.sum(F.size("__pii_s")), F.lit(0))).first()[0], BROADCAST_SPANS)
    row = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    joined = docs.withColumn("__pii_row", row).join(s, (F.col("__pii_row") == F.col("__pii_r")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__pii_d")), "left")
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.greatest(F.lit(0), x["start"] - acc["at"]).cast("int"))
        return F.when(x["start"] >= acc["at"], F.struct(F.concat(acc["out"], gap, F.element_at(names, x["kind"])).alias("out"), x["end"].alias("at"))).otherwise(
            F.struct(acc["out"].alias("out"), F.greatest(acc["at"], x["end"]).alias("at"))
        )

    text = F.aggregate("__pii_s", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.lit(2147483647))))
    out = joined.withColumn("__pii_t", F.when(F.col("__pii_s").isNull(), F.col("text")).otherwise(text))
    cols = [F.col("__pii_t").alias("text") if c == "text" else F.when(F.col("__pii_s").isNull(), F.col(c)).otherwise(F.length("__pii_t").cast("long")).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.select(*cols)
