"""MinHash near-duplicate linking with sequential Bayesian verification.

A text's set is its distinct word shingles, each a 64-bit hash. Texts with
equal sets form a class first, so thousands of copies cost one representative.
Representatives get a MinHash signature and are banded; texts that meet in a
band bucket are candidates:

1. each member of a bucket is compared with the bucket's smallest member (a
   number of pairs linear in the bucket);
2. once the links found so far are joined to components, buckets that still
   hold several components are compared inside blocks of bounded size, whatever
   the bucket's size. Signatures alone go first and name the members that have
   an unpruned partner in another component; only their full sets follow. Of
   these, first the member nearest to the block's commonest hashes is compared
   with all, then what is still apart. A task returns members or the links that
   join components, not pairs.

A comparison goes through the signatures batch by batch. With a uniform prior,
the posterior chance that the similarity reaches the threshold is a binomial
tail; a pair is dropped as soon as that chance is under ``MISS``. Survivors are
verified exactly on their full sets. Pairs inside a component are not needed
for its identity and are not enumerated.

A pair at the threshold itself meets in no band with chance
(1 - 0.8**ROWS)**BANDS, 4e-7; a pair above it less often.

Defined results: texts without words have an empty set and link to nothing;
fewer words than a shingle make one shingle of all; null texts count as empty;
a null doc_id is linked with nothing and has component null, kept true; rows
with equal doc_id and different texts are linked each for itself, except that
texts whose classes have the same smallest doc_id share its links; repeated
rows are one class; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phredloom.llm.bytescan import chunks, mix, runs
from phredloom.llm.common import documents, materialize, slices, small, tidy
from phredloom.llm.components import components

BANDS = 28
ROWS = 4
BATCH = 16
MISS = 1e-7
BLOCK = 1024
BROADCAST_IDS = 1_000_000
_N = BANDS * ROWS
_RNG = np.random.default_rng(20240229)
_XOR = _RNG.integers(0, 2**64, _N, dtype=np.uint64)
_MUL = _RNG.integers(0, 2**64, _N, dtype=np.uint64) | np.uint64(1)
_PLACE = _RNG.integers(0, 2**64, 16, dtype=np.uint64) | np.uint64(1)
_FOLD = _RNG.integers(0, 2**64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


# White space by the contract, and A-Z in lower case.
_SPACE = [0x20, *range(0x09, 0x0E)]
_IN_WORD = np.ones(256, dtype=np.uint8)
_IN_WORD[_SPACE] = 0
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def shingle_sets(texts: list[str], words: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text, in order."""
    for chunk in chunks(texts):
        data = _LOWER[chunk.data]
        start, end = runs(_IN_WORD[data])
        total, down = chunk.sums(data)
        h = mix((total[end] - total[start]) * down[start])
        whole = h[: max(0, len(h) - words + 1)] * _PLACE[0]
        for j in range(1, words):
            whole = whole + h[j : len(h) - words + 1 + j] * _PLACE[j]
        whole = mix(whole)
        first = chunk.owners(start).tolist()
        for a, b in zip(first[:-1], first[1:], strict=True):
            n = b - a
            if n >= words:
                yield np.unique(whole[a : b - words + 1])
            elif n:
                yield mix(np.array([(h[a:b] * _PLACE[:n]).sum(dtype=np.uint64) + np.uint64(n)], dtype=np.uint64))
            else:
                yield np.empty(0, np.uint64)


def signature(s: np.ndarray) -> np.ndarray:
    """The smallest value of the set under each of BANDS * ROWS hash functions."""
    out = np.full(_N, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(s), 2048):
        part = s[None, at : at + 2048] ^ _XOR[:, None]
        part *= _MUL[:, None]
        np.minimum(out, part.min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    return mix((sig.reshape(BANDS, ROWS) * _FOLD).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).astype(np.int64)


def least_matches(threshold: float, miss: float = MISS) -> list[tuple[int, int]]:
    """(hashes compared, matches needed to go on): P(J >= t | m of n) = P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in range(BATCH, _N + 1, BATCH):
        tail = 0.0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                out.append((n, m))
                break
    return out


def _survive(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Indices of the rows of two signature matrices that no batch prunes."""
    alive, seen, matches = np.arange(len(a)), 0, np.zeros(len(a), np.int64)
    for n, least in least_matches(threshold):
        matches = matches + (a[alive, seen:n] == b[alive, seen:n]).sum(axis=1)
        ok = matches >= least
        alive, matches, seen = alive[ok], matches[ok], n
    return alive


def signed(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id``, ``n`` (set size), ``key`` (digest of the set), ``bands``, ``sig`` (16 bits a hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n, keys, bands, sigs = [], [], [], []
            for s in shingle_sets(b.column("text").to_pylist(), words):
                n.append(len(s))
                if not len(s):
                    keys.append(None), bands.append(None), sigs.append(None)
                    continue
                sig = signature(s)
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                bands.append(band_keys(sig))
                sigs.append((sig >> np.uint64(40)).astype(np.uint16).tobytes())
            columns = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "key", "bands", "sig"])

    rows = documents(docs).selectExpr("cast(doc_id as string) doc_id", "text")
    out = rows.mapInArrow(tidy(run), "doc_id string, n long, key binary, bands array<long>, sig binary")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def _matrix(col: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.uint16).reshape(len(col), _N)


def _prune(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) that neither set sizes nor signature batches rule out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if len(p):
                yield p.iloc[_survive(_matrix(p["sig_a"]), _matrix(p["sig_b"]), threshold)][["a", "b"]]

    a = reps.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    b = reps.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
    near = F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-6
    return pairs.join(b, "b").join(a, "a").filter(near).select("a", "b", "sig_a", "sig_b").mapInPandas(tidy(run), "a long, b long")


def _full_sets(ids: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """``id``, ``s``: the whole set of each of the ids. Their keys are broadcast while few, so that other texts do not move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [s.tobytes() for s in shingle_sets(b.column("text").to_pylist(), words)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sets, pa.binary())], ["id", "s"])

    ids = materialize(ids.distinct())
    texts = documents(docs).join(small(ids, ids.count(), BROADCAST_IDS), "doc_id", "left_semi")
    return materialize(texts.mapInArrow(tidy(run), "id long, s binary").dropDuplicates(["id", "s"]))


def _linked(x: bytes, y: bytes, percent: int) -> bool:
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    n = int((both[1:] == both[:-1]).sum())
    return 100 * n >= percent * (len(x) + len(y) - n)


def _verify(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield p.loc[[_linked(x, y, percent) for x, y in zip(p["sa"], p["sb"], strict=True)], ["a", "b"]]

    full = _full_sets(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")), docs, words)
    joined = pairs.join(full.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b").join(full.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    return joined.mapInPandas(tidy(compare), "a long, b long").distinct()


class _Block:
    """Members of one bucket block: links across components, each found once, without listing pairs."""

    def __init__(self, g: pd.DataFrame, threshold: float, percent: int):
        self.key, self.threshold, self.percent = g["k"].iloc[0], threshold, percent
        self.sig, self.rep, self.n, self.sets = _matrix(g["sig"]), g["rep"].to_numpy(), g["n"].to_numpy(), g["s"].tolist() if "s" in g else []
        self.bands = np.frombuffer(b"".join(g["bands"]), np.int64).reshape(len(g), BANDS)
        self.root = g["c"].to_numpy().copy()
        self.left, self.right = ((g["own"] == g[x]).to_numpy() for x in ("i", "j"))
        self.same = bool((self.left == self.right).all())
        self.links: list[tuple[int, int]] = []

    def unpruned(self, x: int, ys: np.ndarray) -> np.ndarray:
        """Members of ys in another component than x that neither set sizes nor signature batches rule out."""
        ys = ys[(self.root[ys] != self.root[x]) & (np.minimum(self.n[ys], self.n[x]) >= self.threshold * np.maximum(self.n[ys], self.n[x]) - 1e-6)]
        return ys[_survive(np.broadcast_to(self.sig[x], (len(ys), _N)), self.sig[ys], self.threshold)] if len(ys) else ys

    def partners(self, x: int) -> np.ndarray:
        """Members to compare x with: a pair that shares an earlier bucket is dealt with there."""
        ys = np.flatnonzero(self.right & (self.root != self.root[x]))
        ys = ys[ys > x] if self.same else ys
        return ys[self.bands[x, (self.bands[ys] == self.bands[x]).argmax(axis=1)] == self.key] if len(ys) else ys

    def compare(self, x: int, ys: np.ndarray) -> None:
        """Verify x against ys, the most similar first; members that a link has joined to x are passed over."""
        ys = self.unpruned(x, ys)
        for y in ys[np.argsort(-(self.sig[ys] == self.sig[x]).sum(axis=1), kind="stable")].tolist():
            if self.root[x] != self.root[y] and _linked(self.sets[x], self.sets[y], self.percent):
                self.links.append((min(int(self.rep[x]), int(self.rep[y])), max(int(self.rep[x]), int(self.rep[y]))))
                self.root[self.root == self.root[y]] = self.root[x]

    def run(self) -> list[tuple[int, int]]:
        members = np.flatnonzero(self.left | self.right)
        # the member nearest to the commonest value of each hash joins most of a group at once
        ordered = np.sort(self.sig[members], axis=0)
        runs_ = np.zeros(ordered.shape, dtype=np.int64)
        for i in range(1, len(ordered)):
            runs_[i] = np.where(ordered[i] == ordered[i - 1], runs_[i - 1] + 1, 0)
        common = ordered[runs_.argmax(axis=0), np.arange(_N)]
        self.compare(int(members[(self.sig[members] == common).sum(axis=1).argmax()]), members)
        for x in np.flatnonzero(self.left).tolist():
            self.compare(x, self.partners(x))
        return self.links

    def hopeful(self) -> np.ndarray:
        """Which members have an unpruned partner in another component."""
        out = np.zeros(len(self.rep), dtype=bool)
        for x in np.flatnonzero(self.left).tolist():
            ys = self.partners(x)
            ys = self.unpruned(x, ys[~out[ys]] if out[x] else ys)  # what is known to have a partner needs no other
            out[ys] = True
            out[x] |= len(ys) > 0
        return out


_PLACE_OF = ["k", "i", "j"]


def _blockwise(members: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``work`` on the members of each block; a block is held whole, a bucket is not."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # rows of the block that has not ended yet

        def ended(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            for _, g in rows.groupby(_PLACE_OF, sort=False):
                yield work(g)

        for b in batches:
            if not len(b):
                continue
            held.append(b)
            last = b[_PLACE_OF].iloc[-1]
            if held[0][_PLACE_OF].iloc[0].equals(last):
                continue
            rows = pd.concat(held)
            open_ = (rows[_PLACE_OF] == last).all(axis=1)
            yield from ended(rows[~open_])
            held = [rows[open_]]
        if held:
            yield from ended(pd.concat(held))

    return members.repartition(*_PLACE_OF).sortWithinPartitions(*_PLACE_OF).mapInPandas(tidy(run), schema)


def _hopeful(members: DataFrame, threshold: float, percent: int) -> DataFrame:
    """The members (k, i, j, own, rep, n, c) that signatures leave an open partner; members also carry sig and bands."""
    kept = ["k", "i", "j", "own", "rep", "n", "c"]
    schema = "k long, i int, j int, own int, rep long, n long, c long"
    return _blockwise(members, lambda g: g.loc[_Block(g, threshold, percent).hopeful(), kept], schema)


def _cross_component(members: DataFrame, threshold: float, percent: int) -> DataFrame:
    """Links between different components inside each bucket block; members: k, i, j, own, rep, n, c, sig, bands, s."""

    def links(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(sorted(set(_Block(g, threshold, percent).run())), columns=["a", "b"], dtype="int64")

    return _blockwise(members, links, "a long, b long").distinct()


def _band_bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        yield p.assign(bands=[np.asarray(b, np.int64).tobytes() for b in p["bands"]])


def _same_key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keeps, of rows that share a doc_id, the set that the representative stands for."""
    for p in batches:
        ok = [xxhash.xxh3_128_digest(s) == key for s, key in zip(p["s"], p["key"], strict=True)]
        yield p.loc[ok, ["rep", "sig", "bands", "s"]]


def link(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` of every row."""
    threshold = percent / 100
    rows = materialize(signed(docs, words))
    linkable = rows.filter("n > 0 and doc_id is not null")
    reps = materialize(
        linkable.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    )
    bands = reps.select(F.explode("bands").alias("k"), "rep", "n")
    # tables of their own: a join of two plain tables can split a hot key, one that follows an aggregate of the key cannot
    buckets = materialize(bands.groupBy("k").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("m")).filter("m > 1"))
    shared = materialize(bands.join(buckets, "k"))
    star = shared.filter("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    links = materialize(_verify(materialize(_prune(star, reps, threshold)), docs, words, percent))
    found = components(links)

    # buckets of more than two members that still hold several components
    of = found.select(F.col("node").alias("rep"), F.col("component").alias("c"))
    labelled = shared.filter("m > 2").join(of, "rep", "left").select("k", "rep", "n", "m", F.coalesce("c", "rep").alias("c"))
    labelled = materialize(labelled)
    open_ = materialize(labelled.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("k"))
    open_ = small(open_, open_.count(), BROADCAST_IDS)
    blocks = F.ceil(F.col("m") / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    members = labelled.join(open_, "k", "left_semi").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    members = members.select("k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "n", "c")
    signs = reps.select("rep", "key", "sig", "bands")
    as_bytes = signs.join(members.select("rep").distinct(), "rep", "left_semi").mapInPandas(tidy(_band_bytes), "rep long, key binary, sig binary, bands binary")
    members = materialize(_hopeful(members.join(as_bytes.drop("key"), "rep"), threshold, percent))
    full = _full_sets(members.select(F.col("rep").alias("doc_id")), docs, words)
    own_sets = as_bytes.join(full.withColumnRenamed("id", "rep"), "rep")
    packed = own_sets.mapInPandas(tidy(_same_key), "rep long, sig binary, bands binary, s binary")
    more = materialize(_cross_component(members.join(packed, "rep"), threshold, percent))
    if more.limit(1).count():
        found = components(links.union(more))

    classes = reps.select("key", "rep").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    classes = materialize(classes.select(F.col("key").alias("_k"), F.coalesce("component", "rep").alias("component")))
    out = rows.join(classes, rows["key"] == classes["_k"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` for each component (that of the smallest doc_id), with all columns; rows without a doc_id stay.

    Rows that share a doc_id and differ in text are documents of their own: each
    is numbered by a negative hash of both, so that a clean text is not lost to
    another of its id. Rows with equal id and text are one.
    """
    many = materialize(docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("doc_id"))
    n_many = many.count()
    rows = docs.withColumn("__uid", F.col("doc_id").cast("long"))
    if n_many:
        own = -1 - F.shiftrightunsigned(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), 1)
        marked = docs.join(small(many.withColumn("__many", F.lit(True)), n_many, BROADCAST_IDS), "doc_id", "left")
        rows = marked.withColumn("__uid", F.when(F.col("__many"), own).otherwise(F.col("doc_id").cast("long"))).select(*docs.columns, "__uid")
    linked = materialize(link(rows.select(F.col("__uid").alias("doc_id"), "text"), words, percent))
    ids = materialize(linked.filter("kept and doc_id is not null").select(F.col("doc_id").alias("__uid")).distinct())
    out = rows.join(small(ids, ids.count(), BROADCAST_IDS), "__uid", "left_semi")
    if n_many:
        out = out.dropDuplicates(["__uid"])
    return out.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def exact_components(texts: dict[int, str], words: int, percent: int) -> dict[int, int]:
    """The defining rule by brute force, for tests."""

    def shingles(t: str) -> frozenset:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t).translate(dict.fromkeys([*range(9, 14)], " ")).split(" ")
        w = [x for x in w if x]
        return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()

    sets = {i: shingles(t) for i, t in texts.items()}
    where: dict = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    root = {i: i for i in texts}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        common: dict[int, int] = {}
        for x in s:
            for j in where[x]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, both in common.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in texts}


