"""Removal of repeated 400-byte strings, decided by suffix arrays.

A byte goes if some string of ``LENGTH`` bytes over it also starts anywhere
else. Every window of LENGTH bytes is owned by an anchor: the position of its
smallest 16-byte hash, which depends on the window's content alone. So equal
windows have equal anchors at equal offsets, and the search falls apart into
buckets without losing a match:

1. windows of one anchor are cut into two ranges of offsets; those of a range
   share a core of over 200 bytes, whose hash names the bucket;
2. occurrences with the same whole segment (all windows of the range) collapse
   to one weighted segment before anything is gathered. A weight of two or
   more means that each suffix of the segment is there twice: its windows go;
3. the different segments of a bucket are joined to one string and its suffix
   array is built; a window goes if the common prefix of its suffix and a
   neighbour reaches LENGTH.

The suffix array is built by linear grouping: suffixes are grouped by their
Lyndon prefixes, groups handled in descending order with previous-smaller
pointers, and then each group's order is emitted in one ascending pass, without
renaming or recursion. Bytes between places where no two segments of a bucket
part count as one symbol, so the string stays short.

Buckets of more than ``MOST`` segments are halved by offset (each half shares a
longer core) until none is left, so no bucket is ever held whole; in the end a
core is a single window. Hashes of cores and segments are 64 bits each, and
used together.

Defined results: null texts are empty; texts under LENGTH bytes lose nothing;
repeated rows count as repeats of each other; a null doc_id is kept; rows are
otherwise independent of order; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phredloom.llm.bytescan import _power_tables, _BYTE, mix
from phredloom.llm.common import documents, materialize, small

LENGTH = 400
GRAM = 16
MOST = 512
PIECE = 1 << 20
BROADCAST_KEYS = 500_000
_SPAN = LENGTH - GRAM + 1  # number of grams in a window
_HALF = (_SPAN + 1) // 2
_POS_BITS = 22


# ---------------------------------------------------------------- suffix array
def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of integers whose last one is smaller than all others."""
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    slot, group, size = [0] * n, [0] * n, [0] * n
    start = 0
    for at, i in enumerate(order):
        if at and text[i] != text[order[at - 1]]:
            start = at
        slot[i], group[i] = at, start
        size[start] += 1
    # groups in descending order: previous-smaller pointers, then split the groups they point to
    prev = [-2] * n
    end = n
    while end > 0:
        g = group[order[end - 1]]
        pointed: dict[int, int] = {}
        for i in order[g:end]:
            if prev[i] == -2:
                path, j = [i], i - 1
                while j >= 0 and group[j] >= g:
                    if prev[j] != -2:
                        j = prev[j]
                    else:
                        path.append(j)
                        j -= 1
                for x in path:
                    prev[x] = j
            if prev[i] >= 0:
                pointed[prev[i]] = pointed.get(prev[i], 0) + 1
        by_count: dict[int, dict[int, list[int]]] = {}
        for p, times in pointed.items():
            by_count.setdefault(times, {}).setdefault(group[p], []).append(p)
        for times in sorted(by_count, reverse=True):
            for old, members in by_count[times].items():
                if len(members) == size[old]:
                    continue
                edge = old + size[old]
                for p in members:
                    edge -= 1
                    other, at = order[edge], slot[p]
                    order[at], order[edge] = other, p
                    slot[other], slot[p] = at, edge
                for p in members:
                    group[p] = edge
                size[old] -= len(members)
                size[edge] = len(members)
        end = g
    # ascending: each placed suffix places its predecessor and that one's chain of previous-smaller suffixes
    out, free, placed = [-1] * n, list(range(n)), [False] * n
    out[0] = n - 1
    placed[n - 1] = True
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = prev[j]
    return out


def common_prefixes(text: list[int], order: list[int]) -> list[int]:
    """For each rank, symbols shared with the suffix one rank before."""
    n = len(text)
    rank, out, h = [0] * n, [0] * n, 0
    for r, i in enumerate(order):
        rank[i] = r
    for i in range(n):
        if rank[i]:
            j = order[rank[i] - 1]
            while i + h < n and j + h < n and text[i + h] == text[j + h]:
                h += 1
            out[rank[i]] = h
            h = max(0, h - 1)
        else:
            h = 0
    return out


def _cuts(parts: list[bytes]) -> list[int]:
    """Ends of the parts and the places where two of them part, ascending, from 0."""
    cuts = {0, *map(len, parts)}
    ordered = sorted(set(parts))
    for x, y in zip(ordered, ordered[1:], strict=False):
        m = min(len(x), len(y))
        if x[:m] != y[:m]:
            a, b = np.frombuffer(x, np.uint8, m), np.frombuffer(y, np.uint8, m)
            cuts.add(int(np.argmax(a != b)))
    return sorted(cuts)


def repeated_windows(segments: list[tuple[bytes, int]], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each distinct segment (bytes, anchor in it): ranges of window starts (inclusive) that another segment also has."""
    left = [s[a - 1 :: -1] if a else b"" for s, a in segments]
    right = [s[a:] for s, a in segments]
    lcut, rcut = _cuts(left), _cuts(right)
    symbols: dict[tuple[int, bytes], int] = {}
    text: list[int] = []
    place: list[tuple[int, int, int]] = []  # segment, start of the symbol in it, its length
    base = len(segments)
    for i, (s, a) in enumerate(segments):
        pieces = [(a - y, a - x, -1 - k) for k, (x, y) in enumerate(zip(lcut, lcut[1:], strict=False)) if y <= a][::-1]
        pieces += [(a + x, a + y, k) for k, (x, y) in enumerate(zip(rcut, rcut[1:], strict=False)) if a + y <= len(s)]
        for x, y, k in pieces:
            text.append(base + symbols.setdefault((k, s[x:y]), len(symbols)))
            place.append((i, x, y - x))
        text.append(base - 1 - i)
        place.append((i, len(s), 0))
    order = suffix_array(text)
    shared = common_prefixes(text, order)
    out: list[list[tuple[int, int]]] = [[] for _ in segments]
    for r, at in enumerate(order):
        i, x, size = place[at]
        a = segments[i][1]
        if not size or x > a:
            continue
        k = max(shared[r], shared[r + 1] if r + 1 < len(order) else 0)
        if not k:
            continue
        last = place[at + k - 1]
        spare = last[1] + last[2] - x - length
        if spare >= 0:
            out[i].append((x, x if x == a else min(x + size - 1, x + spare)))
    return out


# ---------------------------------------------------------------- windows and anchors
def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    m, have = v, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    rest = width - have
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def owned(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Window ranges of ``data``: first start, last start, anchor, hash of core, hash of segment."""
    n = len(data)
    up, down = _power_tables(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    grams = mix((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
    low = np.uint64((1 << _POS_BITS) - 1)
    v = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_sliding_min(v, _SPAN) & low).astype(np.int64)
    s0 = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1])
    s1 = np.concatenate([s0[1:] - 1, [len(anchor) - 1]])
    p = anchor[s0]
    parts = []
    for c in (0, 1):
        a, b = np.maximum(s0, p - (c + 1) * _HALF + 1), np.minimum(s1, p - c * _HALF)
        ok = a <= b
        a, b, q = a[ok], b[ok], p[ok]
        core = q - c * _HALF, q - (c + 1) * _HALF + 1 + LENGTH
        hashes = [mix((total[y] - total[x]) * down[x]) + np.uint64(c) for x, y in (core, (a, b + LENGTH))]
        seg = mix(hashes[1] + ((q - a) * 1024 + (b - a)).astype(np.uint64))
        parts.append((a, b, q, hashes[0].view(np.int64), seg.view(np.int64)))
    return tuple(np.concatenate([x[i] for x in parts]) for i in range(5))


def _pieces(data: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Overlapping parts of bounded size that hold every window once."""
    a = np.frombuffer(data, dtype=np.uint8)
    at = 0
    while len(a) - at >= LENGTH:
        yield at, a[at : at + PIECE + LENGTH - 1]
        at += PIECE


_ROW = "doc_id string, row long, a int, b int, p int, core long, seg long"


def _occurrences(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, held = [], 0
            for doc_id, row, text in batch.itertuples(index=False):
                for at, part in _pieces(text.encode("utf-8", "surrogatepass")):
                    a, b, p, core, seg = owned(part)
                    out.append(pd.DataFrame({"doc_id": doc_id, "row": row, "a": a + at, "b": b + at, "p": p + at, "core": core, "seg": seg}))
                    held += len(a)
                if held > 50_000:
                    yield pd.concat(out)
                    out, held = [], 0
            if out:
                yield pd.concat(out)

    return docs.selectExpr("cast(doc_id as string) doc_id", "row", "text").mapInPandas(run, _ROW)


def _with_bytes(need: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds the segment's bytes to rows (doc_id, row, a, b, p, core, w)."""
    per_doc = need.groupBy(F.col("doc_id").alias("d"), F.col("row").alias("r")).agg(F.collect_list(F.struct("a", "b", "p", "core", "w")).alias("need"))
    per_doc = materialize(per_doc)
    if per_doc.count() <= BROADCAST_KEYS:  # lets only the texts that are needed shuffle
        docs = docs.join(F.broadcast(per_doc.select(F.col("r").alias("row")).distinct()), "row", "left_semi")
    texts = docs.dropDuplicates(["doc_id", "row"])
    joined = texts.join(per_doc, (F.col("row") == F.col("r")) & F.col("doc_id").cast("string").eqNullSafe(F.col("d")))
    joined = joined.select("d", "r", "text", "need")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, row, text, need in batch.itertuples(index=False):
                data = text.encode("utf-8", "surrogatepass")
                out += [(doc_id, row, x["a"], x["b"], x["p"], x["core"], x["w"], data[x["a"] : x["b"] + LENGTH]) for x in need]
            yield pd.DataFrame(out, columns=["doc_id", "row", "a", "b", "p", "core", "w", "bytes"])

    return joined.mapInPandas(run, "doc_id string, row long, a int, b int, p int, core long, w long, bytes binary")


def _halved(rows: DataFrame) -> DataFrame:
    """Rows of too large buckets, each cut at the middle of its offset range, with new cores and segments."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, row, a, b, p, core, w, data, lo, hi in batch.itertuples(index=False):
                mid = (lo + hi) // 2
                for x, y in ((lo, mid), (mid + 1, hi)):
                    na, nb = max(a, p - y), min(b, p - x)
                    if x > y or na > nb:
                        continue
                    part = data[na - a : nb - a + LENGTH]
                    inner = data[p - x - a : p - y - a + LENGTH]
                    new = xxhash.xxh3_64_intdigest(inner, seed=(core + y) & (2**64 - 1))
                    seg = xxhash.xxh3_64_intdigest(part, seed=(p - na) * 1024 + nb - na)
                    out.append((doc_id, row, na, nb, p, int(np.int64(np.uint64(new))), w, part, x, y, int(np.int64(np.uint64(seg)))))
            yield pd.DataFrame(out, columns=["doc_id", "row", "a", "b", "p", "core", "w", "bytes", "lo", "hi", "seg"])

    return rows.mapInPandas(run, "doc_id string, row long, a int, b int, p int, core long, w long, bytes binary, lo int, hi int, seg long")


def _resolve(rows: DataFrame) -> DataFrame:
    """Repeated window ranges of the rows of buckets of bounded size, by their suffix arrays."""

    def bucket(g: list) -> list[tuple]:
        segments = [(r.bytes, r.p - r.a) for r in g]
        out = []
        for r, found in zip(g, repeated_windows(segments), strict=True):
            if r.w == 1:
                out += [(r.doc_id, r.row, r.a + x, r.a + y) for x, y in found]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []  # rows of the bucket that has not ended
        out: list[tuple] = []

        def table() -> pd.DataFrame:
            return pd.DataFrame(out, columns=["doc_id", "row", "a", "b"])

        for batch in batches:
            for r in batch.itertuples(index=False):
                if held and held[0].core != r.core:
                    out += bucket(held)
                    held = []
                held.append(r)
            yield table()
            out = []
        if held:
            out += bucket(held)
        yield table()

    cols = rows.select("doc_id", "row", "a", "b", "p", "core", "w", "bytes")
    return cols.repartition("core").sortWithinPartitions("core").mapInPandas(run, "doc_id string, row long, a int, b int")


def repeated(docs: DataFrame) -> DataFrame:
    """``doc_id`` (as string), ``row``, ``a``, ``b``: ranges of window starts that occur elsewhere too."""
    found = materialize(_occurrences(docs))
    # a table of its own: a join of two plain tables can split a hot core, one that follows its aggregate cannot
    often = materialize(found.groupBy("core").count().filter("count > 1").select("core"))
    shared = materialize(found.join(often, "core", "left_semi"))
    first = F.min(F.struct("doc_id", "row", "a", "b", "p")).alias("one")
    segments = materialize(shared.groupBy("core", "seg").agg(F.count(F.lit(1)).alias("w"), first))
    twice = segments.filter("w > 1").select("core", "seg")
    marks = shared.join(small(twice, twice.count(), BROADCAST_KEYS), ["core", "seg"], "left_semi").select("doc_id", "row", "a", "b")
    mixed = segments.groupBy("core").agg(F.count(F.lit(1)).alias("d"), F.min("w").alias("least")).filter("d > 1 and least = 1")
    mixed = materialize(mixed.select("core"))  # plain on both sides again
    need = segments.join(small(mixed, mixed.count(), BROADCAST_KEYS), "core", "left_semi").select("one.*", "core", "w")
    rows = materialize(_with_bytes(need, docs))
    lo = F.when(F.col("p") - F.col("b") >= _HALF, F.lit(_HALF)).otherwise(F.lit(0))
    rows = rows.withColumn("lo", lo).withColumn("hi", lo + _HALF - 1)
    while True:
        large = rows.groupBy("core").count().filter(F.col("count") > MOST).select("core")
        large = materialize(large)
        if not large.limit(1).count():
            return marks.union(_resolve(rows))
        marks = marks.union(_resolve(rows.join(large, "core", "left_anti")))
        cut = materialize(_halved(rows.join(large, "core", "left_semi").select("doc_id", "row", "a", "b", "p", "core", "w", "bytes", "lo", "hi")))
        weights = cut.groupBy("core", "seg").agg(F.sum("w").alias("weight"), F.min(F.struct("doc_id", "row", "a")).alias("one"))
        buckets = weights.groupBy("core").agg(F.count(F.lit(1)).alias("d"), F.min("weight").alias("least"), F.sum("weight").alias("n"))
        judged = materialize(cut.join(weights, ["core", "seg"]).join(buckets.filter("n > 1"), "core"))
        marks = marks.union(judged.filter("weight > 1 and w = 1").select("doc_id", "row", "a", "b"))
        is_one = F.struct("doc_id", "row", "a").eqNullSafe(F.col("one"))
        rows = judged.filter((F.col("d") > 1) & (F.col("least") == 1) & ((F.col("weight") == 1) | is_one))
        rows = rows.select("doc_id", "row", "a", "b", "p", "core", F.col("weight").alias("w"), "bytes", "lo", "hi")


def remove(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` of every row.

    With ``with_text`` also ``text``: the stretches left, read as UTF-8, without
    characters that a cut runs through.
    """
    rows = documents(docs).withColumn("row", F.xxhash64("text"))
    # a set: repeated rows of one id mark the same ranges, however many there are
    ranges = repeated(rows).groupBy("doc_id", "row").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))
    ranges = materialize(ranges).withColumnRenamed("doc_id", "d").withColumnRenamed("row", "r")
    joined = rows.join(ranges, (F.col("row") == F.col("r")) & F.col("doc_id").cast("string").eqNullSafe(F.col("d")), "left")
    schema = "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * with_text

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, found in batch.itertuples(index=False):
                data = text.encode("utf-8", "surrogatepass")
                spans: list[list[int]] = []
                for a, b in sorted((x["a"], x["b"] + LENGTH) for x in ([] if found is None else found)):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                edges = [0, *(x for s in spans for x in s), len(data)]
                pieces = [data[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)]
                kept = b"".join(pieces)
                row = (doc_id, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
                out.append((*row, "".join(x.decode("utf-8", "ignore") for x in pieces)) if with_text else row)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    out = joined.selectExpr("cast(doc_id as string) doc_id", "text", "ranges").mapInPandas(run, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def brute_force(texts: list[bytes], length: int = LENGTH) -> list[list[bool]]:
    """The defining rule, for tests: which bytes of each text go."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out
