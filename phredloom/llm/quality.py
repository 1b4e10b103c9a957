"""Quality classifier: naive-Bayes support vectors (NB-SVM).

A text becomes a set of hashed n-gram indicators: words, word pairs, n-grams of
token shapes with punctuation kept literally, n-grams of a "seen shortly
before" flag (for texts that repeat themselves), and coarse shares of each
shape. Indicators are scaled by the log ratio of their class counts, and a
linear hinge-loss model is fitted to them by dual coordinate descent. A
logistic curve fitted on a part of the sample left out of the descent turns
margins into scores.

The model is fitted on at most ``SAMPLE`` labelled rows with at most
``SAMPLE_BYTES`` of indicators in all (a bounded sample: the rows with the
smallest hash of their id and text); only these reach the driver, however many
texts a labelled id has. Every row is scored.

Defined results: a null or empty text gets the score of a text without any
indicator; labels that are null take no part; without any label every score is
0.5, with one class only every score is that class; rows of one doc_id with
different texts all carry its label, and equal ones teach once; repeated rows
are scored each for itself; a very long text has at most 2**BITS indicators and
is read in whole; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phredloom.llm.bytescan import chunks, mix, runs
from phredloom.llm.common import crc_mod, documents, materialize, slices, tidy

BITS = 16
SAMPLE = 8000
SAMPLE_BYTES = 64 << 20
EPOCHS = 12
COST = 0.1
ALPHA = 1.0
ACCEPT = 0.3
_BACK = 8
# Byte kinds: 0 white space, 1 word, 2 punctuation; and flags of letters and digits.
_KIND = np.full(256, 2, dtype=np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_FLAG = np.zeros(256, dtype=np.uint8)
for _b in range(256):
    _c = chr(_b)
    if _b >= 0x80 or _c.isalnum() or _c == "_":
        _KIND[_b] = 1
        _FLAG[_b] = 1 if _b < 0x80 and _c.isupper() else 4 if _b < 0x80 and _c.isdigit() else 0 if _b >= 0x80 else 2
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def _code(s: str) -> int:
    return zlib.crc32(s.encode()) >> (32 - BITS)


def _shapes(data: np.ndarray, start: np.ndarray, end: np.ndarray, is_word: np.ndarray, total: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Words: 1 digits, 2 with digits, 3 capitals, 4 capitalised, 5 other. Punctuation: its first four bytes as a number from 16."""
    bounds = np.stack([start, end], axis=1).ravel()
    flags = np.bitwise_or.reduceat(_FLAG[data], bounds)[::2]
    capital = (flags == 1) & (end - start > 1)
    word = np.select([flags == 4, (flags & 4) > 0, capital, (_FLAG[data[start]] == 1)], [1, 2, 3, 4], 5)
    head = np.minimum(end, start + 4)
    mark = ((total[head] - total[start]) * down[start] >> np.uint64(48)).astype(np.int64) + 16
    return np.where(is_word, word, mark)


def features(texts: list[str]) -> Iterator[np.ndarray]:
    """Indicator numbers of each text, in order."""
    flags = np.zeros(1 << BITS, dtype=bool)
    for chunk in chunks(texts):
        data = _LOWER[chunk.data]
        kind = _KIND[data]
        start, end = runs(kind)
        if not len(start):
            yield from (np.empty(0, np.int64) for _ in range(chunk.n))
            continue
        is_word = kind[start] == 1
        total, down = chunk.sums(data)
        word = ((total[end] - total[start]) * down[start]).view(np.int64)
        shape = _shapes(chunk.data, start, end, is_word, total, down)
        grams = [word, word[:-1] * 3 + word[1:] * 5 + 1]
        gram = shape
        for n in (2, 3, 4):
            gram = gram[:-1] * 0x2C1B3C6D + shape[n - 1 :] * 0x297A2D39 + n if len(shape) >= n else shape[:0]
            grams.append(gram)
        grams = [(mix(g.view(np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64) for g in grams]
        first = chunk.owners(start)
        w, w_first = word[is_word], np.concatenate([[0], np.cumsum(is_word)])[first]
        owner = np.repeat(np.arange(chunk.n), np.diff(w_first))
        again = np.zeros(len(w), dtype=bool)
        for lag in range(1, _BACK + 1):
            again[lag:] |= (w[lag:] == w[:-lag]) & (owner[lag:] == owner[:-lag])
        sums = np.concatenate([[0], np.cumsum(again)])
        for i in range(chunk.n):
            a, b, wa, wb = int(first[i]), int(first[i + 1]), int(w_first[i]), int(w_first[i + 1])
            if a == b:
                yield np.empty(0, np.int64)
                continue
            few, n_words = [], wb - wa
            for n in (4, 8, 16):
                if n_words >= n:
                    run = int((sums[wa + n : wb + 1] - sums[wa : wb + 1 - n]).max())
                    few.append(_code(f"again {n} {(run * 4) // n}"))
            own = shape[a:b]
            for s, c in enumerate(np.bincount(np.minimum(own, 6), minlength=7).tolist()):
                if c:
                    few.append(_code(f"share {s} {int(math.log2(c / (b - a)) * 1.5)}"))
            if n_words:
                few.append(_code(f"again share {int(10 * (sums[wb] - sums[wa]) / n_words)}"))
                few.append(_code(f"distinct {int(10 * len(np.unique(w[wa:wb])) / n_words)} {n_words.bit_length()}"))
            for n, g in zip((1, 2, 2, 3, 4), grams, strict=True):
                flags[g[a : max(a, b - n + 1)]] = True
            flags[few] = True
            out = np.flatnonzero(flags)
            flags[out] = False
            yield out


def dual_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """L1-loss linear SVM over indicators scaled by ``scale``; rows are scaled to unit length. Classes weigh alike."""
    w, b = np.zeros(len(scale)), 0.0
    values = []
    for r in rows:
        v = scale[r]
        values.append(v / max(1e-9, float(np.sqrt(v @ v))))
    upper = np.where(y > 0, cost * len(y) / max(1, 2 * (y > 0).sum()), cost * len(y) / max(1, 2 * (y < 0).sum()))
    alpha, rng = np.zeros(len(y)), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(y)).tolist():
            r, v = rows[i], values[i]
            gradient = y[i] * (float(w[r] @ v) + b) - 1.0
            new = min(max(alpha[i] - gradient / 2.0, 0.0), upper[i])  # unit rows and a constant of 1: the diagonal is 2
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[r] += step * v
                b += step
                alpha[i] = new
    return w, b


class Model:
    def __init__(self, scale: np.ndarray, w: np.ndarray, b: float, slope: float, shift: float):
        self.scale, self.w, self.b, self.slope, self.shift = scale.astype(np.float32), w.astype(np.float32), b, slope, shift

    def margin(self, r: np.ndarray) -> float:
        v = self.scale[r].astype(np.float64)
        return float(self.w[r].astype(np.float64) @ v) / max(1e-9, float(np.sqrt(v @ v))) + self.b

    def score(self, r: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margin(r) + self.shift, -40, 40))))


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """Model of class 1 against class 0; every fifth row only calibrates."""
    n_dims = 1 << BITS
    zero = np.zeros(n_dims)
    if len(labels) == 0 or labels.min() == labels.max():
        return Model(zero, zero, 0.0, 0.0, 0.0 if len(labels) == 0 else (40.0 if labels[0] else -40.0))
    y = np.where(labels > 0, 1.0, -1.0)
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[~held].tolist())) < 2 or len(set(y[held].tolist())) < 2:
        held[:] = False
    train = np.flatnonzero(~held)
    count = {s: np.full(n_dims, ALPHA) for s in (1.0, -1.0)}
    for i in train.tolist():
        count[y[i]][rows[i]] += 1
    total = {s: (y[train] == s).sum() + 2 * ALPHA for s in count}
    scale = np.log(count[1.0] / total[1.0]) - np.log(count[-1.0] / total[-1.0])
    scale[(count[1.0] + count[-1.0]) <= 2 * ALPHA] = 0.0
    w, b = dual_descent([rows[i] for i in train.tolist()], y[train], scale)
    model = Model(scale, w, b, 1.0, 0.0)
    part = np.flatnonzero(held) if held.any() else train
    m = np.array([model.margin(rows[i]) for i in part.tolist()])
    t = np.where(y[part] > 0, ((y[part] > 0).sum() + 1) / ((y[part] > 0).sum() + 2), 1 / ((y[part] < 0).sum() + 2))
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Newton steps of the logistic fit
        p = 1 / (1 + np.exp(-np.clip(slope * m + shift, -40, 40)))
        g = np.array([((p - t) * m).sum() + 1e-3 * slope, (p - t).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * m * m).sum() + 1e-3, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-9:
            break
    model.slope, model.shift = float(slope), float(shift)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_mod(doc_id, 5) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on at most ``sample`` labelled rows outside the held-out fifth, of at most ``most_bytes`` (one row at least)."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).filter("doc_id is not null and y is not null")
    picked = known.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id", "y"), "doc_id", "y").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            r = [r.astype(np.int32).tobytes() for r in features(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), b.column("k"), pa.array(r, pa.binary())], ["doc_id", "y", "k", "r"])

    # a bounded side: at most ``sample`` rows of two numbers
    joined = documents(docs).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "y", F.xxhash64("doc_id", "y", "text").alias("k"))
    rows = materialize(joined.mapInArrow(tidy(run), "doc_id long, y int, k long, r binary"))
    rows = rows.groupBy("k").agg(F.first("doc_id").alias("doc_id"), F.first("y").alias("y"), F.first("r").alias("r"))
    sizes = rows.select("k", F.length("r").alias("size")).orderBy("k").limit(sample).collect()
    fits = np.cumsum([r["size"] for r in sizes]) <= most_bytes
    if not sizes:
        return fit([], np.empty(0, np.int64))
    got = rows.filter(F.col("k") <= sizes[max(0, int(fits.sum()) - 1)]["k"]).collect()
    got.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["y"], bytes(r["r"])))
    return fit([np.frombuffer(r["r"], np.int32).astype(np.int64) for r in got], np.array([r["y"] for r in got], dtype=np.int64))


def score(docs: DataFrame, model: Model, accept: float = ACCEPT) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches):
            score = [m.score(r) for r in features(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    rows = documents(docs).selectExpr("cast(doc_id as string) doc_id", "text")
    got = rows.mapInArrow(tidy(run), "doc_id string, score double").select(F.col("doc_id").cast("long").alias("doc_id"), "score")
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, accept: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` with all their columns whose score reaches ``accept``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches):
            keep = [m.score(r) >= accept for r in features([t or "" for t in b.column("text").to_pylist()])]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
