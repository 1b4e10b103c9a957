"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. *Streams.* The documents of a source, in the order of a seeded hash, make one
   stream of words, which repeats for each epoch. A place in it comes from totals
   of hash cells and a window inside a cell.
2. *Quotas.* A source's target is its weight's share of the mix, held under
   ``epochs`` times its size, the excess shared anew. Its quota is the number of
   blocks of ``block_words`` words that hold the target; the last block is cut at it.
3. *Tree.* The root holds every source's quota and all output shards. A node deals
   its quotas to its two halves: source after source draws from a hypergeometric
   law given what is left, so that both halves are exactly full and together a
   uniform division of the blocks. The place where each source's part begins goes
   down with it, and a leaf is a shard with its exact quotas and disjoint parts.
4. *Draw.* The parts are places in a permutation of the source's blocks; each place
   is one block of one shard. Joining blocks with the words in them gives the
   mix, whose order inside a shard is a seeded hash.

So no source, shard or block sequence is ever in one task: the tree has a row a
node, with an array over the sources. Everything is an expression; the same rows,
seed and parameters give the same mix, however the files are laid out.

Documents are cut where blocks end, and the last block of a source where its target
ends, so words taken equal the target rounded to a word.

Defined results: a null text has size 0 and nothing is taken of it; texts are
counted whole; a null source is a source of its own, the last; a null doc_id is an
id; repeated rows are taken each for itself, in parts of at most ``COPIES`` equal
rows; a source of size 0 has target 0; other columns are not read; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phredloom.llm.common import materialize, small
from phredloom.operators.running import numbered, totals

COPIES = 1000  # equal rows that stand together in a stream
CELL_ROWS = 10_000  # rows of a hash cell
BROADCAST_CELLS = 50_000
_PRIMES = (1_000_003, 2_000_003, 4_000_037)  # a number of blocks that all three divide is over 8e18


def words_in(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long")


# ------------------------------------------------------------ targets
def targets(sizes: DataFrame, weights: list[float], percent: int, epochs: int) -> DataFrame:
    """``sizes`` (source, source_size) with ``place`` (from 0, code point order, null last) and ``target``.

    Sharing the excess anew until no source is above its limit ends where every
    target is the smaller of its limit and its weight times one factor: with
    sources in order of limit per weight, all before the first that the factor
    leaves below its limit are full.
    """
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    s = numbered(sizes, [F.asc_nulls_last("source")], "place").withColumn("place", F.col("place") - 1)
    s = s.withColumn("weight", F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * epochs)
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    s = totals(s, [F.asc("ratio"), F.asc("place")], {"caps": F.col("cap"), "weights": F.col("weight")})
    whole = s.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    s = s.join(F.broadcast(whole))  # one row
    wanted = F.col("all_size") * percent / 100.0
    s = s.withColumn("factor", (wanted - F.col("caps") + F.col("cap")) / (F.col("all_weight") - F.col("weights") + F.col("weight")))
    level = s.filter(F.col("factor") <= F.col("ratio")).agg(F.max("factor").alias("level"))
    target = F.when(F.col("level").isNull() | (F.col("ratio") <= F.col("level")), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("level"))
    return s.join(F.broadcast(level)).select("source", "place", "source_size", target.alias("target"))


# ------------------------------------------------------------ tree
def _ln_factorial(n: str) -> str:
    """ln(n!): Stirling's series from 16 on (error under 1e-12), the product below."""
    series = f"({n} + 0.5D) * ln({n} + 1D) - ({n} + 1D) + 0.9189385332046727D + 1D / (12D * ({n} + 1D)) - 1D / (360D * power({n} + 1D, 3)) + 1D / (1260D * power({n} + 1D, 5))"
    return f"if({n} < 16, ln(cast(factorial(cast(least({n}, 15) as int)) as double)), {series})"


def hypergeometric(whole: str, marked: str, drawn: str, u: str) -> str:
    """SQL of the number of marked ones among ``drawn`` of ``whole``, for a uniform ``u``.

    The distribution function is walked from nine deviations under the mean to nine
    above (what lies outside has less chance than a step of ``u``), so a draw takes
    time in proportion to its deviation.
    """
    mean = f"(cast({drawn} as double) * {marked} / {whole})"
    spread = f"ceil(9 * sqrt({mean} * (1 - {marked} / cast({whole} as double)) * ({whole} - {drawn}) / greatest(1, {whole} - 1)) + 9)"
    least, most = f"greatest(0L, {drawn} + {marked} - {whole})", f"least({drawn}, {marked})"
    choose = lambda n, k: f"({_ln_factorial(n)} - {_ln_factorial(k)} - {_ln_factorial(f'({n} - {k})')})"
    at = "x.lo"
    first = f"exp({choose('x.m', at)} + {choose('(x.w - x.m)', f'(x.d - {at})')} - {choose('x.w', 'x.d')})"
    # p(k + 1) / p(k) = (m - k)(d - k) / ((k + 1)(w - m - d + k + 1))
    step = (
        "struct(a.p * (x.m - k) * (x.d - k) / (cast(k + 1 as double) * (x.w - x.m - x.d + k + 1)) as p, a.c + a.p as c, if(a.c + a.p < x.u, k + 1, a.k) as k)"
    )
    walk = f"aggregate(sequence(x.lo, x.hi), struct({first} as p, 0D as c, x.lo as k), (a, k) -> {step}, a -> least(a.k, x.hi))"
    given = (
        f"struct(cast({whole} as bigint) as w, cast({marked} as bigint) as m, cast({drawn} as bigint) as d, {u} as u, "
        f"cast(greatest({least}, floor({mean}) - {spread}) as bigint) as lo, cast(least({most}, ceil({mean}) + {spread}) as bigint) as hi)"
    )
    return f"if({whole} = 0 or {drawn} = 0 or {marked} = 0, 0L, element_at(transform(array({given}), x -> {walk}), 1))"


def split(nodes: DataFrame, seed: int) -> DataFrame:
    """Every node of more than one shard gives its two halves; the others stay.

    A node: ``first`` and ``shards`` (its range of shards), ``room`` (blocks of the
    smallest shard) and ``longer`` (shards before this number have one block more),
    ``quota`` and ``start`` by source.
    """
    left_n = "(shards div 2)"
    left_room = f"({left_n} * room + greatest(0L, least(longer - first, {left_n})))"
    u = f"(conv(substring(md5(concat_ws(':', {seed}, first, shards, i)), 1, 12), 16, 10) + 0.5D) / 281474976710656D"
    draw = hypergeometric("s.whole", "quota[i]", "s.need", u)
    deal = (
        f"aggregate(sequence(0, size(quota) - 1), struct(aggregate(quota, 0L, (t, x) -> t + x) as whole, {left_room} as need, cast(array() as array<bigint>) as got), "
        f"(s, i) -> element_at(transform(array({draw}), x -> struct(s.whole - quota[i] as whole, s.need - x as need, concat(s.got, array(x)) as got)), 1), s -> s.got)"
    )
    dealt = nodes.withColumn("left", F.expr(f"if(shards > 1, {deal}, quota)"))
    halves = (
        "if(shards = 1, array(struct(first, shards, room, longer, quota, start)), array("
        f"struct(first, {left_n} as shards, room, longer, `left` as quota, start), "
        f"struct(first + {left_n} as first, shards - {left_n} as shards, room, longer, zip_with(quota, `left`, (q, l) -> q - l) as quota, zip_with(start, `left`, (b, l) -> b + l) as start)))"
    )
    return dealt.select(F.expr(f"inline({halves})"))


def shards(quotas: DataFrame, shard_blocks: int, seed: int) -> DataFrame:
    """``shard``, ``quota`` and ``start`` by source, from a table of ``place`` and ``blocks``.

    A row a shard; levels from the eighth on are dealt over all tasks.
    """
    root = quotas.agg(F.array_sort(F.collect_list(F.struct("place", "blocks"))).alias("q"), F.sum("blocks").alias("n"))
    n = root.first()["n"] or 0
    count = max(1, -(-n // shard_blocks))
    nodes = root.filter("n > 0").select(
        F.lit(0).cast("long").alias("first"), F.lit(count).cast("long").alias("shards"), F.lit(n // count).cast("long").alias("room"), F.lit(n % count).cast("long").alias("longer"),
        F.expr("transform(q, x -> x.blocks)").alias("quota"), F.expr("transform(q, x -> 0L)").alias("start"),
    )
    for level in range((count - 1).bit_length()):
        nodes = split(nodes, seed)
        if level % 8 == 7:
            nodes = nodes.repartition("first")
    return nodes.select(F.col("first").alias("shard"), "quota", "start")


# ------------------------------------------------------------ streams and draw
def streams(docs: DataFrame, weights: list[float], percent: int, epochs: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` with ``key``, ``size``, their source's figures and ``at``, where they begin in its stream; and the sources.

    Equal rows are counted first and stand in parts of at most ``COPIES``, so that
    one text that fills a third of the table is spread over cells like other rows.
    """
    rows = docs.select("source", F.col("doc_id").cast("long").alias("doc_id"), words_in(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    units = rows.groupBy("source", "doc_id", "size", "digest").agg(F.count(F.lit(1)).alias("n"))
    units = units.withColumn("part", F.explode(F.expr(f"sequence(0L, (n - 1) div {COPIES})"))).withColumn("n", F.expr(f"least({COPIES}L, n - part * {COPIES})"))
    name = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("digest"), F.col("part").cast("string")]
    units = materialize(units.withColumn("key", F.md5(F.concat_ws(":", F.lit(str(seed)), *name))).withColumn("words", F.col("n") * F.col("size")))

    sizes = units.groupBy("source").agg(F.sum("words").alias("source_size"))
    known = materialize(targets(sizes, weights, percent, epochs).withColumn("want", F.round("target").cast("long")))
    n_cells = max(1, -(-units.count() // CELL_ROWS))
    cell = F.expr(f"cast(conv(substring(key, 1, 8), 16, 10) as bigint) * {n_cells} div 4294967296")
    named = [F.col("source").isNotNull().alias("named"), F.coalesce("source", F.lit("")).alias("source")]  # a null source joins too
    celled = units.select(*named, "doc_id", "size", "digest", "part", "n", "key", "words", cell.alias("cell"))
    per_cell = celled.groupBy("named", "source", "cell").agg(F.sum("words").alias("words"))
    before = Window.partitionBy("named", "source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    per_cell = per_cell.withColumn("begin", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words")
    cells = materialize(per_cell.join(known.select(*named, "place", "source_size", "target", "want"), ["named", "source"]))
    inside = Window.partitionBy("named", "source", "cell").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    placed = celled.withColumn("at", F.sum("words").over(inside) - F.col("words")).join(small(cells, cells.count(), BROADCAST_CELLS), ["named", "source", "cell"])
    figures = ["doc_id", "size", "place", "source_size", "target", "want"]
    copies = placed.select(*figures, "begin", "at", "key", F.explode(F.expr("sequence(0L, n - 1)")).alias("copy"))
    at = F.col("begin") + F.col("at") + F.col("copy") * F.col("size")
    return materialize(copies.select(*figures, at.alias("at"), F.concat_ws(":", "place", "key", "copy").alias("key"))), known


def permuted(i: str, n: str) -> str:
    """SQL of a permutation of 0 to n - 1: steps of a prime that does not divide ``n``."""
    step = f"case {' '.join(f'when {n} % {p} != 0 then {p} % {n}' for p in _PRIMES)} end"
    return f"((({i}) * ({step}) + {n} div 3) % {n})"


def pieces(rows: DataFrame, block_words: int, epochs: int) -> DataFrame:
    """Runs of words of ``rows`` in the blocks that hold the target: ``key``, ``place``, ``block``, ``epoch``, ``from_word``, ``n_words``."""
    spans = rows.withColumn("epoch", F.explode(F.expr(f"sequence(0, {epochs - 1})"))).withColumn("a", F.expr("epoch * source_size + at"))
    spans = spans.withColumn("b", F.least(F.col("a") + F.col("size"), F.col("want"))).filter("b > a")
    cut = spans.withColumn("block", F.explode(F.expr(f"sequence(a div {block_words}, (b - 1) div {block_words})")))
    low, high = F.greatest("a", F.col("block") * block_words), F.least("b", (F.col("block") + 1) * block_words)
    return cut.select("key", "doc_id", "place", "block", "epoch", (low - F.col("a")).alias("from_word"), (high - low).alias("n_words"))


def draws(known: DataFrame, block_words: int, shard_blocks: int, seed: int) -> DataFrame:
    """``place``, ``block``, ``shard``: every block of every source's quota, once."""
    quotas = known.select("place", F.expr(f"(want + {block_words - 1}) div {block_words}").alias("blocks"))
    leaves = shards(quotas, shard_blocks, seed).select("shard", F.posexplode(F.arrays_zip("quota", "start")).alias("place", "x")).filter("x.quota > 0")
    turns = leaves.select("shard", F.col("place").cast("long").alias("place"), F.explode(F.expr("sequence(x.start, x.start + x.quota - 1)")).alias("turn"))
    return turns.join(F.broadcast(quotas), "place").select("place", "shard", F.expr(permuted("turn", "blocks")).alias("block"))


def mix(docs: DataFrame, weights: list[float], percent: int = 150, epochs: int = 2, block_words: int = 4096, shard_blocks: int = 256, seed: int = 2024) -> tuple[DataFrame, DataFrame]:
    """The mix, and the rows of ``docs`` it is drawn from (see ``streams``).

    A row of the mix is a run of a document's words: ``shard``, ``turn`` (from 1, the
    order in the shard: blocks shuffled, a block's runs in their order), ``key`` (of
    the document's row), ``doc_id``, ``epoch``, ``from_word``, ``n_words``.
    """
    rows, known = streams(docs, weights, percent, epochs, seed)
    out = pieces(rows, block_words, epochs).join(draws(known, block_words, shard_blocks, seed), ["place", "block"])
    shuffled = Window.partitionBy("shard").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "place", "block")), "place", "block", "epoch", "key", "from_word")
    return out.select("shard", F.row_number().over(shuffled).alias("turn"), "key", "doc_id", "epoch", "from_word", "n_words"), rows


def taken(mixed: DataFrame, rows: DataFrame) -> DataFrame:
    """Every row with ``doc_id``, ``size``, ``source_size``, ``target`` and ``taken``, the words that the mix takes of it."""
    per_row = mixed.groupBy("key").agg(F.sum("n_words").alias("taken"))
    return rows.join(per_row, "key", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
