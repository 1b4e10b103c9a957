"""Per-category models of the probability of being correct: search, fit, reweight, predict, report."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phredloom.functions.confidence import MOST, clamp, pcor_to_mapq
from phredloom.operators import forest, prep, trees
from phredloom.schemas import FIT_ORDER
from phredloom.session import Scratch


def climb(axes: list[list], score: Callable[[list], float], tolerance: float = 0.01, from_middle: bool = True) -> tuple[list, float]:
    """The best parameters of a lattice, and their score, by hill climbing from its middle.

    ``scored`` holds every point tried, ``open_`` the frontier: the start and
    the lattice neighbours of every point that was a new height, that is beat
    the last height by the relative tolerance. The frontier is tried in sorted
    order, so a search repeats.
    """

    def around(at: tuple[int, ...]) -> set[tuple[int, ...]]:
        moved = ((i, at[i] + step) for i in range(len(axes)) for step in (-1, 1))
        return {(*at[:i], to, *at[i + 1 :]) for i, to in moved if 0 <= to < len(axes[i])}

    def values(at: tuple[int, ...]) -> list:
        return [axis[i] for axis, i in zip(axes, at, strict=True)]

    start = tuple(min(len(axis) - 1, round(len(axis) / 2)) if from_middle else 0 for axis in axes)
    scored: dict[tuple[int, ...], float] = {}
    open_, height = {start} | around(start), None
    while left := open_ - scored.keys():
        at = min(left)
        scored[at] = score(values(at))
        if height is None or scored[at] > height * (1 + tolerance):
            height = scored[at]
            open_ |= around(at)
    best = max(scored, key=scored.__getitem__)
    return values(best), scored[best]


@dataclass
class Settings:
    """Model options, named as on the command line."""

    model_family: str = "RandomForest"
    num_trees: list[int] = field(default_factory=lambda: [30])
    max_features: list[float] = field(default_factory=lambda: [0.1, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45])
    max_leaf_nodes: list[int | None] = field(default_factory=lambda: [35])
    learning_rate: list[float] = field(default_factory=lambda: [0.75, 0.8, 0.85, 0.9, 0.95, 1.0])
    optimization_tolerance: float = 0.01
    reweight_ratio: float = 1.0
    reweight_mapq: bool = False
    reweight_mapq_offset: float = 10.0
    no_oob: bool = False
    try_include_mapq: bool = False
    subsample: float = 1.0
    most_rows: int = 200_000  # training rows of one category that extra trees see
    seed: int = 99099

    def axes(self) -> list[list]:
        out = [self.num_trees, self.max_features, self.max_leaf_nodes]
        return [*out, self.learning_rate] if self.model_family == "GradientBoosting" else out


MOST_NODES = 4000  # of a model that is predicted as an expression; larger ones are predicted batch by batch


class TreesModel:
    """Trees as nodes (feature, cut, left, right, value): ``start`` plus ``factor`` times the sum of their values."""

    def __init__(self, s: Settings, params: list, cols: list[str]):
        self.s, self.params, self.cols = s, params, cols
        self.trees: list[list[tuple]] = []
        self.gains: list[list[float]] = []
        self.start, self.factor = 0.0, 1.0

    @property
    def native(self) -> bool:
        return sum(len(t) for t in self.trees) <= MOST_NODES

    def terms(self) -> tuple[float, list[list[tuple]], float]:
        """What a prediction adds up: a start, and trees by a factor."""
        return self.start, self.trees, self.factor

    def predicted(self) -> Column:
        """The prediction as an expression over the feature columns, or by a function of whole batches if it is too large for one."""
        start, grown, factor = self.terms()
        if self.native:
            total = " + ".join(forest.tree_sql(t, self.cols) for t in grown)
            return F.expr(f"{start!r}D + {factor!r}D * ({total or '0D'})")

        @F.pandas_udf("double")
        def run(*x: pd.Series) -> pd.Series:
            return pd.Series(start + factor * len(grown) * trees.predict_forest(grown, np.column_stack([c.to_numpy(dtype=float) for c in x])))

        return run(*(F.col(c).cast("double") for c in self.cols))

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("pcor", self.predicted())

    def importances(self, df: DataFrame) -> list[float]:
        """Each tree's gains by feature as shares, averaged over the trees that split."""
        shares = [np.array(g) / sum(g) for g in self.gains if sum(g) > 0]
        return np.mean(shares, axis=0).tolist() if shares else [0.0] * len(self.cols)

    def features_at_once(self, share: float) -> int:
        return max(1, int(share * len(self.cols)))


def row_key(df: DataFrame) -> list[str]:
    return [x for x in ("file", "id") if x in df.columns]


def binned(s: Settings, df: DataFrame, cols: list[str], n_trees: int, weight: str | None = None) -> forest.Data:
    """The table that trees grow on; boosting (``n_trees`` 0) takes no bootstrap."""
    boot = forest.boots(n_trees, s.seed, row_key(df)) if n_trees else F.array().cast("array<tinyint>")
    return forest.binned(df, cols, F.col("correct"), F.col(weight) if weight else F.lit(1.0), boot)


class ForestModel(TreesModel):
    """A random forest with a leaf cap; scores itself out of bag."""

    def fit(self, df: DataFrame, weight: str | None = None, data: forest.Data | None = None) -> ForestModel:
        n, share, leaves = self.params
        data = data or binned(self.s, df, self.cols, n, weight)
        grown = forest.grow(data, n, self.features_at_once(share), leaves, self.s.seed)
        self.trees, self.gains, self.factor = [t.nodes for t in grown], [t.gains for t in grown], 1.0 / n
        return self

    def out_of_bag(self, df: DataFrame) -> float:
        """R squared of each training row's mean prediction by the trees that have not seen it."""
        with_boot = df.withColumn("_boot", forest.boots(len(self.trees), self.s.seed, row_key(df)))
        return forest.r_squared(with_boot, F.col("correct"), forest.mean_unseen(self.trees, self.cols, "_boot"))


class BoostedModel(TreesModel):
    """Least-squares boosting. Predictions take the first tree with the means of the labels: at rate 1 they are not the sum of two rounded numbers."""

    def fit(self, df: DataFrame, weight: str | None = None, data: forest.Data | None = None) -> BoostedModel:
        n, share, leaves, self.factor = self.params
        data = data or binned(self.s, df, self.cols, 0, weight)
        self.start, grown, self.whole = forest.boosted(data, n, self.features_at_once(share), leaves, self.factor, self.s.seed)
        self.trees, self.gains = [t.nodes for t in grown], [t.gains for t in grown]
        return self

    def terms(self) -> tuple[float, list[list[tuple]], float]:
        return (1 - self.factor) * self.start, [self.whole, *self.trees[1:]] if self.trees else [], self.factor


class ExtraTreesModel(TreesModel):
    """Randomised trees, each fitted in a task of its own; scores itself out of bag.

    All see one table of at most ``most_rows`` rows of the category (those of
    the smallest hash, if it has more), which every executor holds once.
    """

    def fit(self, df: DataFrame, weight: str | None = None, data: forest.Data | None = None) -> ExtraTreesModel:
        cols, (n, features, leaves), seed = self.cols, self.params, self.s.seed
        key = row_key(df)
        rows = df.select(*key, *cols, "correct", (F.col(weight) if weight else F.lit(1.0)).alias("w"))
        g = rows.orderBy(prep.sample_order(seed, *key), *key).limit(self.s.most_rows).toPandas()
        table = df.sparkSession.sparkContext.broadcast((g[cols].to_numpy(dtype=float), g["correct"].to_numpy(dtype=float), g["w"].to_numpy(dtype=float)))

        def grown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for i in b["id"].tolist():
                    nodes, left_out = trees.fit_tree(*table.value, i, features, leaves, seed, True)
                    yield pd.DataFrame({"id": [i], "nodes": [pickle.dumps(nodes)], "left_out": [left_out.tobytes()]})

        got = df.sparkSession.range(0, n, 1, n).mapInPandas(grown, "id long, nodes binary, left_out binary").orderBy("id").collect()  # a row a tree
        self.trees, self.factor = [pickle.loads(bytes(r["nodes"])) for r in got], 1.0 / n
        self.oob = trees.out_of_bag(table.value[1], [np.frombuffer(r["left_out"]) for r in got])
        table.unpersist()
        return self

    def out_of_bag(self, df: DataFrame) -> float:
        return self.oob

    def importances(self, df: DataFrame) -> list[float]:
        used = np.zeros(len(self.cols))
        for t in self.trees:
            for f, *_ in t:
                if f >= 0:
                    used[f] += 1
        return (used / max(1.0, used.sum())).tolist()


FAMILIES = {"RandomForest": ForestModel, "ExtraTrees": ExtraTreesModel, "GradientBoosting": BoostedModel}


def new_model(s: Settings, params: list, cols: list[str]):
    return FAMILIES[s.model_family](s, params, cols)


def fold(n: int = 3) -> Column:
    """The fold of a row: the md5 of its id, modulo ``n``."""
    return F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("long") % n


def cross_validated(s: Settings, params: list, cols: list[str], df: DataFrame, folds: int = 3, shared: dict | None = None) -> float:
    """Mean R squared over folds fixed by a hash of the id.

    The folds are fitted at the same time, since a round of a tree is a short job
    at most sizes. ``shared`` keeps the binned table of each fold's training rows
    for the other points of a search: they depend on no parameter but a forest's
    number of trees.
    """
    shared = {} if shared is None else shared
    kept = s.model_family != "ExtraTrees"

    def one(k: int) -> float:
        rows, at = df.filter(fold(folds) != k), (k, params[0] if s.model_family == "RandomForest" else 0)
        if kept and at not in shared:
            shared[at] = binned(s, rows, cols, at[1])
        m = new_model(s, params, cols).fit(rows, data=shared.get(at))
        return forest.r_squared(df.filter(fold(folds) == k), F.col("correct"), m.predicted())

    with ThreadPoolExecutor(folds) as pool:
        return float(np.mean([f.result() for f in [pool.submit(inheritable_thread_target(df.sparkSession)(one), k) for k in range(folds)]]))


def fit_reweighted(s: Settings, params: list, cols: list[str], df: DataFrame):
    """Fit, then once more with weights from the first predictions, if asked for."""
    m = new_model(s, params, cols).fit(df)
    if s.reweight_ratio > 1:
        low = 1.0 / s.reweight_ratio
        return new_model(s, params, cols).fit(m.predict(df).withColumn("_w", low + F.col("pcor") * (1 - low)).drop("pcor"), "_w")
    if s.reweight_mapq:
        return new_model(s, params, cols).fit(m.predict(df).withColumn("_w", pcor_to_mapq(clamp(F.col("pcor"))) + s.reweight_mapq_offset).drop("pcor"), "_w")
    return m


@dataclass
class Fitted:
    category: str
    model: object
    cols: list[str]
    params: list
    score: float
    rows: int


def fit_category(features: DataFrame, c: str, s: Settings, chunk_rows: int = 0) -> Fitted | None:
    """The model of one category, or None if it has no rows."""
    df = prep.subsample(features.filter(F.col("category") == c), s.subsample, s.seed, tuple(row_key(features)))
    if df.isEmpty():
        return None
    present = [x for x in df.columns if x not in (*prep.NOT_FEATURES, "mapq")]
    df = prep.impute(df, present, chunk_rows=chunk_rows)
    cols = prep.feature_columns(df, s.try_include_mapq)
    df = prep.check_columns(df, cols).cache()
    shared: dict[int, forest.Data] = {}  # one binned table for all points of a search with as many trees
    of_folds: dict[tuple[int, int], forest.Data] = {}  # and one for each fold

    def score(params: list) -> float:
        if s.model_family == "GradientBoosting" or s.no_oob:
            return cross_validated(s, params, cols, df, shared=of_folds)
        if s.model_family == "RandomForest" and params[0] not in shared:
            shared[params[0]] = binned(s, df, cols, params[0])
        return new_model(s, params, cols).fit(df, data=shared.get(params[0])).out_of_bag(df)

    lattice = s.axes()
    if all(len(a) == 1 for a in lattice):
        params, best = [a[0] for a in lattice], float("nan")
    else:
        params, best = climb(lattice, score, s.optimization_tolerance)
    out = Fitted(c, fit_reweighted(s, params, cols, df), cols, params, best, df.count())
    df.unpersist()
    return out


def fit(features: DataFrame, s: Settings, chunk_rows: int = 0) -> dict[str, Fitted]:
    """A model for each category that has rows; ``features`` holds category, id, features, mapq, correct (and file).

    The categories are fitted at the same time, each in a scheduler pool of its
    own, so that the small jobs of one fill the cores that the others leave.
    """
    sc = features.sparkSession.sparkContext

    def one(c: str) -> Fitted | None:
        sc.setLocalProperty("spark.scheduler.pool", f"fit-{c}")
        return fit_category(features, c, s, chunk_rows)

    with ThreadPoolExecutor(len(FIT_ORDER)) as pool:
        done = [pool.submit(inheritable_thread_target(features.sparkSession)(one), c) for c in FIT_ORDER]
        return {c: f.result() for c, f in zip(FIT_ORDER, done, strict=True) if f.result() is not None}


def postprocess(df: DataFrame) -> DataFrame:
    """By category: certain predictions drop to just above the largest uncertain one (all certain: the cap), then all are clamped."""
    by = ["category"] if "category" in df.columns else []
    top = df.groupBy(*by).agg(F.max(F.when(F.col("pcor") < 1, F.col("pcor"))).alias("_top"))
    below = F.when(F.col("pcor") >= 1, F.coalesce(F.col("_top") + 1e-6, F.lit(MOST))).otherwise(F.col("pcor"))
    return df.join(F.broadcast(top), by or None).withColumn("pcor", clamp(below)).drop("_top")  # a row a category


def raw_predictions(features: DataFrame, models: dict[str, Fitted], collapse: bool = False, chunk_rows: int = 0) -> DataFrame:
    """``category``, ``file`` (if known), ``id``, ``pcor`` as the models give it, ``mapq``, ``correct``.

    One scan predicts every category: each row by the expression of its own model.
    With ``collapse`` each category's distinct feature rows are predicted once.
    """
    out = [*(x for x in ("category", "file") if x in features.columns), "id", "pcor", "mapq", "correct"]
    df = features.filter(F.col("category").isin(list(models)))
    present = [x for x in df.columns if x not in (*prep.NOT_FEATURES, "mapq")]
    if not collapse:
        df = prep.impute(df, present, chunk_rows=chunk_rows)
        pcor = F.lit(None).cast("double")
        for c, m in models.items():
            df = prep.check_columns(df, m.cols, F.col("category") == c)
            pcor = F.when(F.col("category") == c, m.model.predicted()).otherwise(pcor)
        return df.withColumn("pcor", pcor).select(*out)
    parts = None
    for c, m in models.items():
        one = prep.check_columns(prep.impute(df.filter(F.col("category") == c), present, chunk_rows=chunk_rows), m.cols)
        p = prep.expand(one, m.model.predict(prep.collapse(one, m.cols)), m.cols).select(*out)
        parts = p if parts is None else parts.unionByName(p)
    return df.withColumn("pcor", F.lit(None).cast("double")).select(*out) if parts is None else parts


def predict(features: DataFrame, models: dict[str, Fitted], collapse: bool = False, chunk_rows: int = 0, scratch: Scratch | None = None) -> DataFrame:
    """``category``, ``file`` (if known), ``id``, ``pcor``, ``mapq``, ``mapq_orig``, ``correct``; categories without a model give no rows.

    The models run once: their predictions are a table before the largest uncertain one is looked up.
    """
    raw = (scratch or Scratch(features.sparkSession)).keep(raw_predictions(features, models, collapse, chunk_rows))
    file = [x for x in ("file",) if x in raw.columns]
    return postprocess(raw).select("category", *file, "id", "pcor", pcor_to_mapq(F.col("pcor")).alias("mapq"), F.col("mapq").alias("mapq_orig"), "correct")


def importances(f: Fitted, df: DataFrame) -> DataFrame:
    """``feature``, ``importance``, ``rank`` (1: the most important)."""
    pairs = sorted(zip(f.cols, f.model.importances(df), strict=True), key=lambda p: (-p[1], p[0]))
    return df.sparkSession.createDataFrame([(a, float(b), i + 1) for i, (a, b) in enumerate(pairs)], "feature string, importance double, rank int")


def parameters(models: dict[str, Fitted], spark) -> DataFrame:
    """One row a category: parameters, rows, columns, score."""
    rows = [(c, str(m.params), m.rows, len(m.cols), None if m.score != m.score else m.score) for c, m in models.items()]
    return spark.createDataFrame(rows, "category string, params string, n_rows long, n_cols int, score double")
