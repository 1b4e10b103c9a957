"""Exact top-k inner-product search over an impact-ordered index.

Vectors are quantised to integers, dealt to blocks of bounded size, and each
block is indexed: for every dimension, its rows form posting segments by level
of their value. A few queries at a time add up segments score-at-a-time, those
of the highest impact on any of them first. From a tenth of the segments on, at
set shares of them, each row still possible is bounded from both sides: what it has in segments
already added lies between their edges, and what it has elsewhere lies between
the edges of the segments left, and by Cauchy and Schwarz within the product of
both rests' lengths. The likeliest rows are scored exactly, which gives a score
that the k-th best is not below; rows whose upper bound is under it are out for
good. A query stops when at most one row in a hundred is possible, or one in
twenty and their exact scores take less than the postings left (copies closer
than a level are not told apart by any segment), or no segment is left; just
these rows are rescored exactly.

A row with a component a thousand times larger than is usual in its block is
kept beside the index and scored exactly for every query, so that it does not
widen the levels of the others. Bounds are doubles with a margin for rounding;
scores are integers, in wider arithmetic only for rows that could leave a long.

Each block is packed to one row, of the narrowest integers that hold it, and both
sets of blocks are tables. Query blocks meet index blocks in a Cartesian product
of their partitions: a task reads its own partition of either side, nothing is
copied or broadcast, and what the driver holds does not grow with the vectors. A
pair of blocks is a task until that makes more than TASKS of them; from there on
a task has several pairs, one after the other. The k best of each pair of blocks
go to a final ranking.

Defined results: a vector that is null, empty, or holds a null or non-finite
component takes no part; rows with equal vec_id and vector count once; a null
vec_id takes no part; vectors of unequal length are compared as if the shorter
ended in zeros; components and scores saturate at the range of a long; ties go
to the smaller vec_id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phredloom.llm.common import materialize

LEVELS = 64
CHECKS = (0.1, 0.3, 0.5, 0.7, 0.85, 0.95, 1.0)  # shares of the segments after which bounds are worked out
BATCH = 64  # queries that share an order of segments
FEW, SOME = 100, 20  # a query stops when one row in FEW is possible, or in SOME and rescoring them is less work than going on
LIKELY = 32  # rows that a check scores exactly for its threshold
OUTLIER = 1024.0  # a row with a component so many times the block's median largest one is not indexed
BLOCK_ROWS = 8192
QUERY_ROWS = 8192
TASKS, ACROSS = 4096, 64  # pairs of blocks are dealt to at most so many tasks, query blocks to at most so many partitions
_MAX = np.iinfo(np.int64).max


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def _quantise(vectors: list, scale: float) -> np.ndarray:
    width = max(map(len, vectors))
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    with np.errstate(over="ignore"):
        q = np.floor(scale * out)
    big = 2.0**62
    return np.clip(q, -big, big).astype(np.int64)


def _narrow(m: np.ndarray) -> np.ndarray:
    """``m`` in the narrowest integers that hold it."""
    fits = (t for t in (np.int16, np.int32) if m.min() >= np.iinfo(t).min and m.max() <= np.iinfo(t).max)
    return m.astype(next(fits, np.int64))


class Block:
    """The impact index of one block: per dimension, rows grouped by level of their value."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], np.ascontiguousarray(rows[order])
        peak = np.abs(self.rows.astype(np.float64)).max(axis=1)
        inside = peak <= OUTLIER * max(1.0, float(np.median(peak)))
        self.beside, self.indexed = np.flatnonzero(~inside), np.flatnonzero(inside)
        x = self.rows[self.indexed].astype(np.float64)
        d = x.shape[1]
        self.low, self.width = x.min(axis=0), np.maximum((x.max(axis=0) - x.min(axis=0)) / LEVELS, 1.0)
        level = np.minimum(((x - self.low) / self.width).astype(np.int16), LEVELS - 1)
        self.docs = np.argsort(level, axis=0, kind="stable").T.astype(np.int32)
        self.start = np.stack([np.searchsorted(np.sort(level[:, j]), np.arange(LEVELS + 1)) for j in range(d)])
        self.most, self.squares = np.abs(x).max(axis=0), np.ascontiguousarray((x * x).T)
        self.added: list[float] = []  # of each query: the share of segments added when it stopped
        self.rescored: list[int] = []  # and the rows that were possible then

    def search(self, queries: np.ndarray, k: int | np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (row numbers, exact scores) of a superset of the block's k best rows; k may differ by query."""
        q = np.zeros((len(queries), self.rows.shape[1]), dtype=np.int64)
        width = min(q.shape[1], queries.shape[1])
        q[:, :width] = queries[:, :width]
        wanted, out = np.broadcast_to(k, len(q)), []
        for i in range(0, len(q), BATCH):
            part = q[i : i + BATCH]
            for x, rows in zip(part, self._possible(part, wanted[i : i + BATCH]), strict=True):
                at = np.sort(np.concatenate([self.beside, self.indexed[rows]]))
                out.append((at, _scores(self.rows[at], x)))
        return out
    def _possible(self, exact: np.ndarray, wanted: np.ndarray) -> list[np.ndarray]:
        """For each query the indexed rows that may be among its best ones.

        The queries share the order of segments; bounds, thresholds and stops are each query's own.
        """
        n, x = len(self.indexed), exact.astype(np.float64)
        d = x.shape[1]
        edge = self.low[:, None] + np.arange(LEVELS)[None, :] * self.width[:, None]
        least = np.minimum(x[:, :, None] * edge, x[:, :, None] * (edge + self.width[:, None]))
        impact = (least - least.min(axis=2)[:, :, None]).max(axis=0).ravel()
        least = np.ascontiguousarray(least.transpose(1, 2, 0))
        done = self.start[:, :-1] == self.start[:, 1:]  # nothing to add
        order = np.argsort(-impact, kind="stable")
        order = order[~done.ravel()[order]]
        gap, x2 = np.abs(x).T * self.width[:, None], (x * x).T
        margin = 1e-12 * (d * (np.abs(x) @ self.most + gap.sum(axis=0)) + 1.0)
        acc, unseen, threshold = np.zeros((n, len(x))), np.ones((d, n)), np.full(len(x), -np.inf)
        alive, out, few = np.arange(len(x)), [np.arange(n)] * len(x), np.maximum(4 * wanted, n // FEW)
        at = 0
        for share in CHECKS if n > few.min() else ():
            part = order[at : int(np.ceil(share * len(order)))]
            at += len(part)
            for j, level in zip(*(v.tolist() for v in np.divmod(part, LEVELS)), strict=True):
                docs = self.docs[j, self.start[j, level] : self.start[j, level + 1]]
                acc[docs] += least[j, level]
                unseen[j][docs] = 0.0
            done.ravel()[part] = True
            bottom, top = np.where(done[:, :, None], np.inf, least).min(axis=1), np.where(done[:, :, None], -np.inf, least).max(axis=1) + gap
            closed = done.all(axis=1)
            bottom[closed] = top[closed] = 0.0
            reach = x2.T @ unseen
            reach *= np.einsum("ij,ij->j", unseen, self.squares)
            np.sqrt(reach, out=reach)
            seen = np.ascontiguousarray(acc.T)
            middle = np.maximum(bottom.T @ unseen, -reach) + seen
            upper = np.minimum(top.T @ unseen, reach)
            upper += seen
            middle += upper
            upper += gap.sum(axis=0)[:, None]
            np.maximum(upper, float(-_MAX - 1), out=upper)  # no score is lower
            left = (np.diff(self.start, axis=1)[~done]).sum() // d  # in rows
            stays = np.ones(len(alive), dtype=bool)
            for i, query in enumerate(alive.tolist()):
                m = min(n, max(LIKELY, int(wanted[query])))
                likely = np.argpartition(middle[i], n - m)[n - m :]
                if m >= wanted[query]:
                    scores = _scores(self.rows[self.indexed[likely]], exact[query])
                    threshold[i] = max(threshold[i], float(np.partition(scores, m - wanted[query])[m - wanted[query]]))
                possible = np.flatnonzero(upper[i] + margin[i] >= threshold[i])
                if len(possible) <= max(few[query], min(left, n // SOME)) or at == len(order):
                    out[query], stays[i] = possible, False
                    self.added.append(at / len(order))
                    self.rescored.append(len(possible))
            if not stays.all():
                alive, x2, gap, margin, threshold = alive[stays], x2[:, stays], gap[:, stays], margin[stays], threshold[stays]
                acc, least = np.ascontiguousarray(acc[:, stays]), np.ascontiguousarray(least[:, :, stays])
            if not len(alive):
                break
        return out


def _scores(rows: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products, saturated; rows whose products may leave a long are worked out one by one."""
    out = rows @ x
    for i in np.flatnonzero(np.abs(rows.astype(np.float64)) @ np.abs(x.astype(np.float64)) >= 2.0**62).tolist():
        out[i] = _saturated(rows[i], x)
    return out


def _saturated(a: np.ndarray, b: np.ndarray) -> int:
    return max(-_MAX - 1, min(_MAX, sum(int(x) * int(y) for x, y in zip(a, b, strict=True))))


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the k best rows, its own left out, of every query row."""
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")
    ).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    rows = rows.distinct()
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("m")).first()
    blocks, asks = (max(1, -(-int(x) // size)) for x, size in ((counts["n"], BLOCK_ROWS), (counts["m"], QUERY_ROWS)))

    def packed(df: DataFrame, n: int, name: str) -> DataFrame:
        def one(g: pd.DataFrame) -> pd.DataFrame:
            m = _narrow(_quantise(g["v"].tolist(), scale))
            return pd.DataFrame({name: [int(g["b"].iloc[0])], f"{name}_dim": [m.shape[1]], f"{name}_type": [m.dtype.str], f"{name}_ids": [g["vec_id"].to_numpy(np.int64).tobytes()], f"{name}_rows": [m.tobytes()]})

        dealt = df.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int").alias("b"))
        return materialize(dealt.groupBy("b").applyInPandas(one, f"{name} int, {name}_dim int, {name}_type string, {name}_ids binary, {name}_rows binary"))

    def unpacked(rows: bytes, kind: str, dim: int) -> np.ndarray:
        return np.frombuffer(rows, kind).reshape(-1, dim).astype(np.int64)

    def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index: dict[int, Block] = {}
        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.x not in index:
                    index = {r.x: Block(np.frombuffer(r.x_ids, np.int64), unpacked(r.x_rows, r.x_type, r.x_dim))}
                block, out = index[r.x], []
                queries = unpacked(r.y_rows, r.y_type, r.y_dim)
                qids = np.frombuffer(r.y_ids, np.int64)
                own = np.searchsorted(block.ids, qids, "right") - np.searchsorted(block.ids, qids, "left")
                for qid, (at, scores) in zip(qids.tolist(), block.search(queries, k + own), strict=True):
                    ids = block.ids[at]
                    best = [i for i in np.lexsort((ids, ~scores)).tolist() if ids[i] != qid][:k]
                    out += [(qid, int(ids[i]), int(scores[i])) for i in best]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype="int64")

    across = min(asks, ACROSS)
    x = packed(rows, blocks, "x").repartitionByRange(min(blocks, TASKS // across), "x")
    y = packed(rows.filter("q"), asks, "y").repartition(across)
    pairs = x.crossJoin(y.hint("shuffle_replicate_nl"))
    best = pairs.mapInPandas(pair, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
