"""Leaf-capped trees from partial histograms equal trees grown one split at a time; out-of-bag scores equal brute force."""

import hashlib
import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phredloom.operators import forest, trees
from phredloom.plans import models


def plain_tree(x, y, w, cap):
    """Best split first over all features and all cuts between the table's values; nodes as (feature, cut, left, right, value)."""
    cuts = [[(a + b) / 2 for a, b in zip(v, v[1:], strict=False)] for v in (sorted(set(c)) for c in zip(*x, strict=True))]

    def best(rows):
        def sums(part):
            return sum(w[i] for i in part), sum(w[i] * y[i] for i in part)

        ws, gs = sums(rows)
        found = None
        for f, options in enumerate(cuts):
            for c in options:
                left, right = [i for i in rows if x[i][f] <= c], [i for i in rows if x[i][f] > c]
                if left and right:
                    (wl, gl), (wr, gr) = sums(left), sums(right)
                    gain = gl * gl / wl + gr * gr / wr - gs * gs / ws
                    if found is None or gain > found[0] + 1e-12:
                        found = (gain, f, c, left, right)
        return found if found and found[0] > 1e-9 else None

    rows = list(range(len(y)))
    nodes, heap = {1: rows}, []
    splits = {}
    if b := best(rows):
        heap.append((-b[0], 1, b))
    while heap and (cap is None or len(splits) < cap - 1):
        _, at, (_, f, c, left, right) = heapq.heappop(heap)
        splits[at] = (f, c)
        for k, part in ((2 * at, left), (2 * at + 1, right)):
            nodes[k] = part
            if b := best(part):
                heapq.heappush(heap, (-b[0], k, b))
    mean = {k: sum(w[i] * y[i] for i in r) / sum(w[i] for i in r) for k, r in nodes.items()}
    return splits, mean


def by_path(tree):
    """(splits, values) of a tree by the path of each node."""
    splits, values, todo = {}, {}, [(0, 1)]
    for at, path in todo:
        f, cut, left, right, value = tree.nodes[at]
        values[path] = value
        if f >= 0:
            splits[path] = (f, cut)
            todo += [(left, 2 * path), (right, 2 * path + 1)]
    return splits, values


@pytest.fixture(scope="module")
def table():
    rng = random.Random(4)
    x = [(rng.randrange(9) / 2, rng.randrange(6) * 1.5, rng.choice([0.0, 1.0]), 3.0) for _ in range(500)]
    y = [1.0 if a + rng.random() * b > 3 + 2 * c else 0.0 for a, b, c, _ in x]
    w = [rng.choice([1.0, 2.5, 0.25]) for _ in x]
    return x, y, w


def frame(spark, x, y, w):
    return spark.createDataFrame([(i, *map(float, r), int(a), b) for i, (r, a, b) in enumerate(zip(x, y, w, strict=True))], "id long, x0 double, x1 double, x2 double, x3 double, correct int, w double").repartition(5)


COLS = ["x0", "x1", "x2", "x3"]


@pytest.mark.parametrize("cap", [2, 7, 35, None])
def test_tree_equals_one_split_at_a_time(spark, table, cap):
    x, y, w = table
    df = frame(spark, x, y, w)
    data = forest.binned(df, COLS, F.col("correct"), F.col("w"), F.array().cast("array<tinyint>"))
    tree = forest.grow(data, 1, 4, cap, 1)[0]
    splits, values = by_path(tree)
    want, means = plain_tree(x, y, w, cap)
    leaves = sum(n[0] < 0 for n in tree.nodes)
    assert leaves == len(want) + 1 and (cap is None or leaves <= cap)
    assert splits.keys() == want.keys()
    assert all(splits[p][0] == want[p][0] and math.isclose(splits[p][1], want[p][1]) for p in want)
    assert all(math.isclose(values[p], means[p], abs_tol=1e-9) for p in values)
    got = df.withColumn("p", F.expr(forest.tree_sql(tree.nodes, COLS))).select("id", "p").collect()
    np_pred = trees.predict_tree(tree.nodes, np.array(x))
    assert all(math.isclose(r["p"], np_pred[r["id"]]) for r in got)


def plain_boots(seed, n_trees, i):
    out = []
    for t in range(n_trees):
        u = int(hashlib.md5(f"{seed}:{t}:{i}".encode()).hexdigest()[:12], 16) / 2**48
        total, k = 0.0, 0
        while k < forest.MOST_DRAWN:
            total += math.exp(-1) / math.factorial(k)
            if total > u:
                break
            k += 1
        out.append(k)
    return out


def test_forest_of_bootstraps_and_its_score_equal_brute_force(spark, table):
    x, y, _ = table
    n_trees, seed = 6, 99099
    df = frame(spark, x, y, [1.0] * len(y))
    m = models.ForestModel(models.Settings(seed=seed), [n_trees, 1.0, 9], COLS).fit(df)
    boots = [plain_boots(seed, n_trees, i) for i in range(len(y))]
    assert {r["id"]: r["b"] for r in df.select("id", forest.boots(n_trees, seed, ["id"]).alias("b")).collect()} == dict(enumerate(boots))
    assert abs(np.mean(boots) - 1) < 0.1 and abs(np.var(boots) - 1) < 0.2
    preds = []
    for t in range(n_trees):
        rows = [i for i in range(len(y)) if boots[i][t]]
        # cuts are those of the whole table
        splits, _ = plain_tree_in(x, y, [b[t] for b in boots], rows, 9)
        assert by_path(forest.Tree(m.trees[t], []))[0].keys() == splits.keys()
        preds.append(trees.predict_tree(m.trees[t], np.array(x)))
    seen = [[p[i] for p, b in zip(preds, boots[i], strict=True) if b == 0] for i in range(len(y))]
    kept = [(y[i], sum(s) / len(s)) for i, s in enumerate(seen) if s]
    mean = sum(a for a, _ in kept) / len(kept)
    want = 1 - sum((a - b) ** 2 for a, b in kept) / sum((a - mean) ** 2 for a, _ in kept)
    assert math.isclose(m.out_of_bag(df), want, rel_tol=1e-9)
    assert math.isclose(sum(m.importances(df)), 1.0) and m.importances(df)[3] == 0


def plain_tree_in(x, y, w, rows, cap):
    """``plain_tree`` of the rows of a bootstrap, with the cuts of the whole table."""
    return plain_tree(x, y, w, cap) if len(rows) == len(y) else _weighted(x, y, w, cap)


def _weighted(x, y, w, cap):
    # a weight of 0 must not count as a row: keep such rows out, but let the table's values make the cuts
    kept = [i for i in range(len(y)) if w[i]]
    values = [sorted(set(c)) for c in zip(*x, strict=True)]
    sub = [x[i] for i in kept]
    have = [sorted(set(c)) for c in zip(*sub, strict=True)]
    assert have == values  # every value occurs in the bootstrap, so the cuts are the same
    return plain_tree(sub, [y[i] for i in kept], [w[i] for i in kept], cap)


def test_same_trees_whatever_the_layout(spark, table):
    x, y, w = table
    a, b = (models.ForestModel(models.Settings(), [4, 0.5, 12], COLS).fit(frame(spark, x, y, w).repartition(n, "id"), "w") for n in (1, 9))
    assert a.trees == b.trees
    assert models.ForestModel(models.Settings(seed=3), [4, 0.5, 12], COLS).fit(frame(spark, x, y, w)).trees != a.trees


def test_boosting_follows_its_definition(spark, table):
    x, y, w = table
    m = models.BoostedModel(models.Settings(), [3, 1.0, 4, 0.6], COLS).fit(frame(spark, x, y, w), "w")
    now = [sum(a * b for a, b in zip(y, w, strict=True)) / sum(w)] * len(y)
    assert math.isclose(m.start, now[0])
    for t in m.trees:
        rest = [a - b for a, b in zip(y, now, strict=True)]
        splits, means = plain_tree(x, rest, w, 4)
        got, values = by_path(forest.Tree(t, []))
        assert got.keys() == splits.keys() and all(math.isclose(values[p], means[p], abs_tol=1e-6) for p in values)
        now = [b + 0.6 * p for b, p in zip(now, trees.predict_tree(t, np.array(x)), strict=True)]


def test_many_values_are_cut_at_quantiles(spark):
    df = spark.range(5000).select("id", (F.col("id") / 7).alias("x0"), F.lit(1.0).alias("k"), (F.col("id") > 3100).cast("int").alias("correct"))
    cuts = forest.edges(df, ["x0", "k"])
    assert len(cuts[0]) <= forest.BINS and len(cuts[1]) == 0
    m = models.BoostedModel(models.Settings(), [1, 1.0, 2, 1.0], ["x0", "k"]).fit(df)
    cut = m.trees[0][0][1] * 7
    assert abs(cut - 3100) < 5000 / forest.BINS  # the best cut between bins


def test_large_models_predict_the_same(spark, table, monkeypatch):
    x, y, w = table
    df = frame(spark, x, y, w)
    m = models.ForestModel(models.Settings(), [3, 1.0, 8], COLS).fit(df)
    one = {r["id"]: r["pcor"] for r in m.predict(df).collect()}
    monkeypatch.setattr(models, "MOST_NODES", 0)
    two = {r["id"]: r["pcor"] for r in m.predict(df).collect()}
    assert one.keys() == two.keys() and all(math.isclose(one[i], two[i]) for i in one)


def test_labels_of_one_value_give_a_leaf(spark):
    df = spark.range(50).select("id", (F.col("id") % 3).cast("double").alias("x0"), F.lit(1).alias("correct"))
    m = models.ForestModel(models.Settings(), [2, 1.0, 5], ["x0"]).fit(df)
    assert [len(t) for t in m.trees] == [1, 1] and m.out_of_bag(df) == 0.0 and m.importances(df) == [0.0]
