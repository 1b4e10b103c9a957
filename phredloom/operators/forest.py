"""Leaf-capped regression trees grown best split first over a table of any size.

Values are binned once. A round adds up, for every node whose best split is
not known yet and every tree at once, the weights and label sums of each
(feature, bin): a task adds its own rows first, partial sums meet by (tree,
node), and what reaches the driver is one best split a node. The driver keeps a
heap of splits by gain. It pops as many as the cap allows among those it knows,
asks for the children of what it popped, and repeats until every popped node's
children are known, so the result is that of growing one split at a time; there
are about as many rounds as the deepest tree has levels.

Sums are of integers (weights and labels in steps of 2**-bits, and what is left
of them in steps FINE times as small), so they do not depend on the order of
tasks, and what a step cannot hold is not lost once for each row of a cell. A
row's bootstrap weight in a tree is a Poisson(1) count drawn from the md5 of
(seed, tree, row): any plan can say which trees have not seen a row.

Splits need a gain above 0. A node looks at the first ``k`` features, in an order
of its own, that are not constant in it.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phredloom.session import Scratch

BINS = 64
FINE = 1 << 22
MOST_DRAWN = 12  # Poisson(1) is above 12 once in 6e10 draws


def boots(trees: int, seed: int, key: list[str]) -> Column:
    """Array of a row's weight in each tree: how many steps of the Poisson(1) distribution function its hash has passed."""
    steps, total = [], 0.0
    for k in range(MOST_DRAWN):
        total += math.exp(-1) / math.factorial(k)
        steps.append(f"{total!r}D")
    name = f"concat_ws(':', '{seed}', t, {', '.join(f'`{c}`' for c in key)})"
    u = f"conv(substring(md5({name}), 1, 12), 16, 10) / 281474976710656D"
    uniform = f"transform(sequence(0, {trees - 1}), t -> {u})"  # first of all, so that a hash is made once
    return F.expr(f"transform({uniform}, u -> cast(size(filter(array({', '.join(steps)}), x -> x <= u)) as tinyint))")


def edges(df: DataFrame, cols: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Cuts between the bins of each column: halfway between all values if there are at most ``bins``, else between quantiles."""
    about = df.agg(*(F.approx_count_distinct(c, 0.02).alias(c) for c in cols)).first()
    few = [c for c in cols if about[c] <= bins * 1.2]
    shares = F.array(*(F.lit((i + 0.5) / bins) for i in range(bins)))
    asked = [F.collect_set(F.col(c).cast("double")).alias(c) if c in few else F.percentile_approx(F.col(c).cast("double"), shares, F.lit(100 * bins)).alias(c) for c in cols]
    got = df.agg(*asked).first()
    out = []
    for c in cols:
        v = np.unique(np.array(got[c] or [], dtype=float))
        if len(v) > bins:
            v = v[np.linspace(0, len(v) - 1, bins).round().astype(int)]
        out.append((v[:-1] + v[1:]) / 2)
    return out


@dataclass
class Data:
    """A binned table: ``y``, ``w``, ``boot`` (array, one weight a tree) and ``bins`` (a byte a feature)."""

    table: DataFrame
    cuts: list[np.ndarray]
    bits: int  # of the fixed point of sums
    firsts: dict[tuple, Tree] = field(default_factory=dict)  # first trees of boosting, which no learning rate changes


def binned(df: DataFrame, cols: list[str], label: Column, weight: Column, boot: Column, scratch: Scratch | None = None) -> Data:
    cuts = edges(df, cols)
    n = len(cols)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.empty((b.num_rows, n), dtype=np.uint8)
            for i, c in enumerate(cuts):
                x[:, i] = np.searchsorted(c, b.column(3 + i).to_numpy(zero_copy_only=False))
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(n), b.num_rows, [None, pa.py_buffer(x.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), packed.cast(pa.binary())], names=["y", "w", "boot", "bins"])

    rows = df.select(label.cast("double").alias("y"), weight.cast("double").alias("w"), boot.alias("boot"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)))
    table = (scratch or Scratch(df.sparkSession)).keep(rows.mapInArrow(cut, "y double, w double, boot array<tinyint>, bins binary"))
    most = table.agg(F.count(F.lit(1)).alias("n"), F.max(F.col("w") * (1 + F.abs("y"))).alias("m")).first()
    largest = max(1.0, most["n"] * MOST_DRAWN * 4 * (most["m"] or 1.0))
    return Data(table, cuts, min(40, 62 - math.ceil(math.log2(largest))))


@dataclass
class Node:
    path: int  # 1: the root; 2p and 2p + 1: the children of p
    w: float
    g: float
    gain: float = 0.0
    feature: int = -1
    bin: int = 0
    known: bool = False  # its best split is known
    kids: list[Node] = field(default_factory=list)


@dataclass
class Tree:
    """Nodes as (feature, cut, left, right, value); ``gains``: what each feature's splits gained."""

    nodes: list[tuple]
    gains: list[float]


def _routes(asked: dict[int, list[Node]], roots: dict[int, Node]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each tree: feature, bin, left, right and number in ``asked`` (or -1) of its nodes, the root first."""
    out = {}
    for t, nodes in asked.items():
        number, rows, todo = {n.path: i for i, n in enumerate(nodes)}, [], [roots[t]]
        for n in todo:  # grows while read
            at = len(todo)
            todo += n.kids
            rows.append((n.feature, n.bin, at, at + 1, number.get(n.path, -1)) if n.kids else (-1, 0, -1, -1, number.get(n.path, -1)))
        out[t] = tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True))
    return out


def _land(route: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    feature, cut, left, right, number = route
    at = np.zeros(len(x), dtype=np.int64)
    inner = np.arange(len(x)) if feature[0] >= 0 else np.empty(0, np.int64)
    while len(inner):
        here = at[inner]
        at[inner] = np.where(x[inner, feature[here]] <= cut[here], left[here], right[here])
        inner = inner[feature[at[inner]] >= 0]
    return number[at]


def _value(route: tuple[np.ndarray, ...], values: np.ndarray, x: np.ndarray) -> np.ndarray:
    return values[_land((*route[:4], np.arange(len(values))), x)]


def _best(data: Data, asked: dict[int, list[Node]], roots: dict[int, Node], k: int, seed: int, first: int, shown: list[tuple]) -> list:
    """One row a node asked for: sums, and its best split. ``shown``: (route, values, factor) of trees whose predictions the labels are less by."""
    routes, n, scale = _routes(asked, roots), len(data.cuts), float(1 << data.bits)
    names = {t: [nd.path for nd in nodes] for t, nodes in asked.items()}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {t: np.zeros((4, len(nodes) * n * BINS), dtype=np.int64) for t, nodes in names.items()}
        for b in batches:
            if not b.num_rows:
                continue
            x = np.frombuffer(b"".join(b.column(3).to_pylist()), dtype=np.uint8).reshape(-1, n)
            y, w = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for route, values, factor in shown:
                y = y - factor * _value(route, values, x)
            boot = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            for t, route in routes.items():
                at = _land(route, x)
                times = boot[:, t - first] if boot.shape[1] else np.ones(len(x))
                used = np.flatnonzero((at >= 0) & (times > 0))
                cell = (at[used, None] * n + np.arange(n)) * BINS + x[used]
                for i, v in enumerate((w[used] * scale, w[used] * y[used] * scale)):
                    whole = np.rint(v)
                    fine = times[used] * np.rint((v - whole) * FINE)
                    whole = times[used] * whole
                    # doubles hold a batch's integers exactly up to 2**53; beyond, halves are added apart
                    high = np.floor(whole / 1048576.0)
                    for row, part, unit in ((i, high, 1048576), (i, whole - high * 1048576.0, 1), (i + 2, fine, 1)):
                        if part.any():
                            sums[t][row] += np.bincount(cell.ravel(), np.repeat(part, n), sums[t].shape[1]).astype(np.int64) * unit
        for t, s in sums.items():
            full = np.flatnonzero(s[0])
            node, feature, bin_ = full // (n * BINS), full // BINS % n, full % BINS
            order = np.array([np.argsort(np.random.default_rng([seed, t, p]).permutation(n)) for p in names[t]]).reshape(-1, n)
            cols = [np.full(len(full), t), node, feature, order[node, feature], bin_]
            yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in cols), *(pa.array(row[full]) for row in s)], names=["tree", "node", "feature", "turn", "bin", "w", "g", "wf", "gf"])

    cells = data.table.mapInArrow(add, "tree int, node int, feature int, turn int, bin int, w long, g long, wf long, gf long").repartition("tree", "node")
    return data.table.sparkSession.sql(_BEST_SQL, {"k": k}, cells=cells).collect()  # a row a node asked for


# The cells of a node are in one partition, so there is one shuffle. The gain of a cut is what it takes off the sum of squares.
_BEST_SQL = f"""
SELECT tree, node, first(w) AS w, first(g) AS g,
  array_max(transform(slice(array_sort(collect_list(if(cut IS NULL, NULL, struct(turn, feature, cut)))), 1, :k), s -> struct(s.cut.gain AS gain, -s.turn AS turn, s.feature AS feature, s.cut AS cut))) AS best
FROM (
  SELECT tree, node, feature, turn, first(w) AS w, first(g) AS g,
    max(if(parts, struct(gl * gl / wl + gr * gr / wr - g * g / w AS gain, -bin AS bin, wl, gl, wr, gr), NULL)) AS cut
  FROM (
    SELECT tree, node, feature, turn, bin, w1 > w0 AS parts, w0 + wf0 / {FINE} AS wl, g0 + gf0 / {FINE} AS gl,
      w1 - w0 + (wf1 - wf0) / {FINE} AS wr, g1 - g0 + (gf1 - gf0) / {FINE} AS gr, w1 + wf1 / {FINE} AS w, g1 + gf1 / {FINE} AS g
    FROM (
      SELECT tree, node, feature, turn, bin, sum(w) OVER below AS w0, sum(g) OVER below AS g0, sum(wf) OVER below AS wf0, sum(gf) OVER below AS gf0,
        sum(w) OVER whole AS w1, sum(g) OVER whole AS g1, sum(wf) OVER whole AS wf1, sum(gf) OVER whole AS gf1
      FROM (SELECT tree, node, feature, turn, bin, sum(w) AS w, sum(g) AS g, sum(wf) AS wf, sum(gf) AS gf FROM {{cells}} GROUP BY tree, node, feature, turn, bin)
      WINDOW whole AS (PARTITION BY tree, node, feature), below AS (PARTITION BY tree, node, feature ORDER BY bin ROWS UNBOUNDED PRECEDING)))
  GROUP BY tree, node, feature, turn)
GROUP BY tree, node"""


def _pops(root: Node, cap: int | None, least: float) -> tuple[list[Node], list[Node]]:
    """Nodes split by the heap as far as is known, and the new children whose best splits must be asked for.

    If any must, those of the best splits left on the heap are asked for as well,
    up to the cap: they are likely next, and a round costs a job whatever is asked.
    """
    heap, split, new = [], [], []

    def push(n: Node) -> None:
        if n.known and n.gain > least:
            heapq.heappush(heap, (-n.gain, n.path, n))

    push(root)
    while heap and (cap is None or len(split) < cap - 1):
        n = heapq.heappop(heap)[2]
        split.append(n)
        last = cap is not None and len(split) == cap - 1  # its children are leaves in any case
        if not last:
            new += [k for k in n.kids if not k.known]
        for kid in n.kids:
            push(kid)
    if new:
        for _, _, n in heapq.nsmallest(cap or len(heap), heap):
            new += [k for k in n.kids if not k.known]
    return split, new


def grow(data: Data, trees: int, k: int, max_leaves: int | None, seed: int, first: int = 0, shown: list[tuple] = ()) -> list[Tree]:
    """``trees`` trees, numbered from ``first``, of at most ``max_leaves`` leaves."""
    numbers, scale = range(first, first + trees), float(1 << data.bits)
    roots = {t: Node(1, 0.0, 0.0) for t in numbers}
    asked = {t: [r] for t, r in roots.items()}
    while asked:
        for r in _best(data, asked, roots, k, seed, first, list(shown)):
            n = asked[r["tree"]][r["node"]]
            if n.path == 1:
                n.w, n.g = r["w"], r["g"]
            if r["best"]:
                b = r["best"]
                n.gain, n.feature, n.bin = b["gain"], b["feature"], -b["cut"]["bin"]
                n.kids = [Node(2 * n.path, b["cut"]["wl"], b["cut"]["gl"]), Node(2 * n.path + 1, b["cut"]["wr"], b["cut"]["gr"])]
        for nodes in asked.values():
            for n in nodes:
                n.known = True
        asked = {t: new for t, r in roots.items() if (new := _pops(r, max_leaves, 1e-12 * r.w)[1])}
    return [_tree(roots[t], _pops(roots[t], max_leaves, 1e-12 * roots[t].w)[0], data, scale) for t in numbers]


def _tree(root: Node, split: list[Node], data: Data, scale: float) -> Tree:
    inner, todo, nodes, gains = {n.path for n in split}, [root], [], [0.0] * len(data.cuts)
    for n in todo:  # grows while read
        value, at = (n.g / n.w if n.w else 0.0), len(todo)
        if n.path in inner:
            todo += n.kids
            gains[n.feature] += n.gain / scale
            nodes.append((n.feature, float(data.cuts[n.feature][n.bin]), at, at + 1, value))
        else:
            nodes.append((-1, 0.0, -1, -1, value))
    return Tree(nodes, gains)


def boosted(data: Data, trees: int, k: int, max_leaves: int | None, rate: float, seed: int) -> tuple[float, list[Tree], list[tuple]]:
    """Least-squares boosting: the weighted mean, trees over what the ones before leave, each counted ``rate`` times, and the nodes of the first with means of the labels.

    The first tree is grown over the labels themselves: the mean, taken off all of
    them, changes no gain, and sums of labels are exact where those of differences
    are rounded. What trees leave has mean 0, so a later one without a split is 0.
    """
    r = data.table.agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("mean")).first()
    start, out, whole = float(r["mean"] or 0.0), [], []
    leaf = (np.array([-1]), np.array([0]), np.array([-1]), np.array([-1]))
    shown: list[tuple] = []
    for t in range(trees):
        tree = data.firsts.get((k, max_leaves, seed)) if not t else None
        tree = tree or grow(data, 1, k, max_leaves, seed, t, shown)[0]
        if not t:
            data.firsts[k, max_leaves, seed] = tree
            whole = tree.nodes
            shown.append((leaf, np.array([(1 - rate) * start]), 1.0))
            tree = Tree([(*n[:4], n[4] - start) for n in whole], tree.gains)
        elif len(tree.nodes) == 1:
            tree = Tree([(*tree.nodes[0][:4], 0.0)], tree.gains)
        out.append(tree)
        shown.append((_route_of(tree, data), np.array([n[4] for n in (tree.nodes if t else whole)]), rate))
    return start, out, whole


def _route_of(tree: Tree, data: Data) -> tuple[np.ndarray, ...]:
    rows = [(f, int(np.searchsorted(data.cuts[f], cut)) if f >= 0 else 0, left, right) for f, cut, left, right, _ in tree.nodes]
    return tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True))


def tree_sql(nodes: list[tuple], cols: list[str], at: int = 0) -> str:
    """A tree as nested SQL conditions over columns: no Python where rows are predicted."""
    f, cut, left, right, value = nodes[at]
    if f < 0:
        return f"{float(value)!r}D"
    return f"if(`{cols[f]}` <= {cut!r}D, {tree_sql(nodes, cols, left)}, {tree_sql(nodes, cols, right)})"


def mean_unseen(trees: list[list[tuple]], cols: list[str], boot: str) -> Column:
    """Mean prediction of the trees in which a row has weight 0; null if it is in all."""
    preds = ", ".join(tree_sql(t, cols) for t in trees)
    total = f"aggregate(zip_with({boot}, array({preds}), (b, p) -> if(b = 0, p, 0D)), 0D, (s, x) -> s + x)"
    return F.expr(f"{total} / nullif(size(filter({boot}, b -> b = 0)), 0)")


def r_squared(df: DataFrame, label: Column, predicted: Column) -> float:
    """Of the rows that have a prediction; 0 if labels do not vary."""
    d = df.select(label.cast("double").alias("y"), predicted.alias("p")).filter(F.col("p").isNotNull())
    r = d.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"), F.sum((F.col("y") - F.col("p")) ** 2).alias("e")).first()
    spread = (r["q"] or 0.0) - (r["s"] or 0.0) ** 2 / r["n"] if r["n"] else 0.0
    return float(1 - r["e"] / spread) if spread > 1e-12 else 0.0
