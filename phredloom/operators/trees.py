"""Extremely randomised regression trees with a leaf cap, and their out-of-bag score.

MLlib has neither random thresholds nor a cap on leaves. Each tree has its own
seed and bootstrap, so trees are fitted in tasks of their own over one bounded
table of training rows, and a lost tree is grown again as it was.
"""

from __future__ import annotations

import heapq

import numpy as np


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, rng: np.random.Generator, n_features: int, max_leaves: int | None, random_cut: bool) -> list[tuple]:
    """Nodes (feature, cut, left, right, value), the best split first until the cap. random_cut: one random threshold a feature; else the best one."""
    nodes: list[list] = []
    heap: list[tuple] = []

    def add(rows: np.ndarray) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, -1, -1, float(np.average(y[rows], weights=w[rows]))])
        if len(rows) > 1 and np.ptp(y[rows]) > 0:
            best = None
            base = w[rows].sum() * nodes[at][4] ** 2
            for f in rng.permutation(x.shape[1])[:n_features].tolist():
                v = x[rows, f]
                lo, hi = v.min(), v.max()
                if lo == hi:
                    continue
                if random_cut:
                    cuts = [rng.uniform(lo, hi)]
                else:
                    values = np.unique(v)
                    cuts = ((values[:-1] + values[1:]) / 2)[:: max(1, len(values) // 32)].tolist()
                for cut in cuts:
                    left = v <= cut
                    wl, wr = w[rows][left], w[rows][~left]
                    if not len(wl) or not len(wr):
                        continue
                    gain = (wl @ y[rows][left]) ** 2 / wl.sum() + (wr @ y[rows][~left]) ** 2 / wr.sum() - base
                    if best is None or gain > best[0]:
                        best = (gain, f, cut, rows[left], rows[~left])
            if best and best[0] > 1e-12:
                heapq.heappush(heap, (-best[0], at, best[1:]))
        return at

    add(np.arange(len(y)))
    leaves = 1
    while heap and (max_leaves is None or leaves < max_leaves):
        _, at, (f, cut, left, right) = heapq.heappop(heap)
        nodes[at][0], nodes[at][1] = f, float(cut)
        nodes[at][2] = add(left)
        nodes[at][3] = add(right)
        leaves += 1
    return [tuple(n) for n in nodes]


def predict_tree(nodes: list[tuple], x: np.ndarray) -> np.ndarray:
    f, cut, left, right, value = (np.array(c) for c in zip(*nodes, strict=True))
    at = np.zeros(len(x), dtype=np.int64)
    while True:
        inner = np.flatnonzero(f[at] >= 0)
        if not len(inner):
            return value[at]
        here = at[inner]
        at[inner] = np.where(x[inner, f[here]] <= cut[here], left[here], right[here])


def fit_tree(x: np.ndarray, y: np.ndarray, w: np.ndarray | None, number: int, max_features: float, max_leaves: int | None, seed: int, extra: bool) -> tuple[list[tuple], np.ndarray]:
    """Tree ``number`` over its bootstrap (random cuts if ``extra``), and its predictions of the rows left out (else NaN)."""
    rng = np.random.default_rng([seed, number])
    rows = rng.integers(0, len(y), len(y))
    nodes = grow(x[rows], y[rows], (np.ones(len(y)) if w is None else w)[rows], rng, max(1, int(max_features * x.shape[1])), max_leaves, extra)
    out = np.full(len(y), np.nan)
    left_out = np.setdiff1d(np.arange(len(y)), rows)
    if len(left_out):
        out[left_out] = predict_tree(nodes, x[left_out])
    return nodes, out


def out_of_bag(y: np.ndarray, left_out: list[np.ndarray]) -> float:
    """R squared of each row's mean prediction by the trees that did not see it."""
    seen = sum((~np.isnan(p)).astype(int) for p in left_out)
    total = sum(np.nan_to_num(p) for p in left_out)
    ok = seen > 0
    spread = ((y[ok] - y[ok].mean()) ** 2).sum() if ok.any() else 0.0
    return float(1 - ((y[ok] - total[ok] / seen[ok]) ** 2).sum() / spread) if spread > 0 else 0.0


def predict_forest(trees: list, x: np.ndarray) -> np.ndarray:
    return np.mean([predict_tree(t, x) for t in trees], axis=0)
