"""Registered queries of fitted models: on features whose best prediction is known, so that SQL can say what it is.

Rows are events; the two features that matter are cells of their ids, and labels
are made so that a fitted model must predict each cell's share of correct rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phredloom.operators import forest
from phredloom.plans import models
from phredloom.plans.registry import query, read, rounded

c = F.col


def _training(spark: SparkSession, d: str) -> DataFrame:
    e = c("embedding")
    cols = [F.get(e, F.lit(i)).cast("double").alias(f"x{i}") for i in range(8)]
    return read(spark, d, "embeddings").select(F.lit("u").alias("category"), c("vec_id").alias("id"), *cols, (c("label") * 5).cast("int").alias("mapq"), (c("label") >= 5).cast("int").alias("correct"))


def _predicted(spark: SparkSession, d: str, **settings) -> DataFrame:
    t = _training(spark, d)
    s = models.Settings(max_features=[0.5], max_leaf_nodes=[16], learning_rate=[0.3], **settings)
    return models.predict(t, models.fit(t, s))


@query()
def q_random_forest(spark: SparkSession, d: str) -> DataFrame:
    return _predicted(spark, d, num_trees=[10])


@query()
def q_gradient_boosting(spark: SparkSession, d: str) -> DataFrame:
    return _predicted(spark, d, model_family="GradientBoosting", num_trees=[5], reweight_ratio=2.0)


@query()
def q_extra_trees(spark: SparkSession, d: str) -> DataFrame:
    return _predicted(spark, d, model_family="ExtraTrees", num_trees=[10])


@query()
def q_importance(spark: SparkSession, d: str) -> DataFrame:
    t = _training(spark, d)
    m = models.fit(t, models.Settings(num_trees=[10], max_features=[0.5], max_leaf_nodes=[16]))
    return models.importances(m["u"], t)


@query()
def q_search(spark: SparkSession, d: str) -> DataFrame:
    t = _training(spark, d)
    return models.parameters(models.fit(t, models.Settings(model_family="ExtraTrees", num_trees=[5], max_features=[0.2, 0.4, 0.6], max_leaf_nodes=[8])), spark)


# ---------------------------------------------------------------- known cells
# Categories u and c by the id's parity. ``a`` is 0, 1 or, by missing value, imputed as 2; ``same`` repeats it and ``k`` is constant.
def _cells(spark: SparkSession, d: str, pure: bool) -> DataFrame:
    e = c("event_id")
    cell = (e / 2).cast("long") % 3
    correct = cell == 1 if pure else (e / 6).cast("long") % 4 < cell + 1
    a = F.when(cell < 2, cell.cast("double"))
    return read(spark, d, "events").select(
        F.when(e % 2 == 0, "u").otherwise("c").alias("category"), e.alias("id"), a.alias("a"), a.alias("same"), F.lit(4.0).alias("k"), (e % 40).cast("int").alias("mapq"), correct.cast("int").alias("correct")
    )


_CELLS = """v AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'u' ELSE 'c' END AS category, event_id AS id, event_id // 2 % 3 AS cell, CAST(event_id % 40 AS INTEGER) AS mapq_orig,
  CASE WHEN {pure} THEN event_id // 2 % 3 = 1 ELSE event_id // 6 % 4 < event_id // 2 % 3 + 1 END AS ok FROM events),
p AS (SELECT category, cell, avg(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p FROM v GROUP BY ALL),
q AS (SELECT *, least(0.999999::DOUBLE, CASE WHEN p < 1 THEN p ELSE coalesce(max(CASE WHEN p < 1 THEN p END) OVER (PARTITION BY category) + 1e-6, 0.999999) END) AS pcor FROM p)
SELECT v.category, v.id, round(q.pcor, 6) AS pcor, round(abs(-10 * log10(1 - q.pcor)), 3) AS mapq, v.mapq_orig, CAST(v.ok AS INTEGER) AS correct FROM v JOIN q ON v.category = q.category AND v.cell = q.cell"""


def _fitted(spark: SparkSession, d: str, pure: bool, collapse: bool = False, **settings) -> DataFrame:
    t = _cells(spark, d, pure)
    p = models.predict(t, models.fit(t, models.Settings(max_features=[1.0], max_leaf_nodes=[8], **settings)), collapse)
    return p.select("category", "id", F.round("pcor", 6).alias("pcor"), F.round(F.abs(-10 * F.log10(1 - c("pcor"))), 3).alias("mapq"), "mapq_orig", "correct")


@query("WITH " + _CELLS.format(pure="true"))
def q_forest_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of one class each: every bootstrap of a forest predicts them exactly, and certain ones drop to just above the others."""
    return _fitted(spark, d, True, num_trees=[5])


@query("WITH " + _CELLS.format(pure="true"))
def q_extra_trees_cells(spark: SparkSession, d: str) -> DataFrame:
    return _fitted(spark, d, True, model_family="ExtraTrees", num_trees=[5])


@query("WITH " + _CELLS.format(pure="false"))
def q_boosting_cells(spark: SparkSession, d: str) -> DataFrame:
    """Mixed cells: boosting takes no bootstrap, so it predicts each cell's share; reweighting by cell does not change it."""
    return _fitted(spark, d, False, model_family="GradientBoosting", num_trees=[4], learning_rate=[1.0], reweight_ratio=2.0)


@query("WITH " + _CELLS.format(pure="false"))
def q_boosting_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """As before, reweighted by quality, and each distinct feature row predicted once."""
    return _fitted(spark, d, False, True, model_family="GradientBoosting", num_trees=[4], learning_rate=[1.0], reweight_mapq=True)


@query("""WITH v AS (SELECT event_id % 2 AS g, event_id // 2 % 3 AS cell FROM events)
SELECT CASE WHEN g = 0 THEN 'u' ELSE 'c' END AS category, '[5, 1.0, 8]' AS params, count(*) AS n_rows, 1 AS n_cols, 'a' AS feature, 1.0::DOUBLE AS importance, 1 AS rank FROM v GROUP BY g HAVING count(DISTINCT cell) > 1""")
def q_parameters(spark: SparkSession, d: str) -> DataFrame:
    """What was fitted: constant and repeated columns are gone, and all importance is the cell's."""
    t = _cells(spark, d, True)
    fitted = models.fit(t, models.Settings(max_features=[1.0], max_leaf_nodes=[8], num_trees=[5]))
    out = None
    for k, m in fitted.items():
        one = models.importances(m, t).withColumn("category", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return models.parameters(fitted, spark).drop("score").join(F.broadcast(out), "category").select("category", "params", "n_rows", "n_cols", "feature", F.round("importance", 6).alias("importance"), "rank")


# Out-of-bag, cross-validated and searched scores of the mixed cells of category u. A full tree predicts a cell's
# (weighted) share, so SQL knows every prediction; folds and bootstraps are by md5, which both sides have.
_MIXED = """v AS (SELECT event_id AS id, event_id // 2 % 3 AS cell, CASE WHEN event_id // 6 % 4 < event_id // 2 % 3 + 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y,
  CAST(('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8)) AS BIGINT) % 3 AS fold FROM events WHERE event_id % 2 = 0)"""


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d, False).filter("category = 'u'").withColumn("a", F.coalesce("a", F.lit(2.0)))


def _cv_sql(trees: int, rate: float) -> str:
    """Mean R squared over three folds of boosting by full trees: shares of the other folds, as far as so many steps get from their mean."""
    return f"""k AS (SELECT unnest([0, 1, 2]) AS k),
t AS (SELECT k, cell, avg(y) AS p FROM v JOIN k ON v.fold <> k.k GROUP BY ALL),
m AS (SELECT k, avg(y) AS mean FROM v JOIN k ON v.fold <> k.k GROUP BY k),
q AS (SELECT k.k, v.y, m.mean + (1 - pow(1 - {rate}::DOUBLE, {trees})) * (t.p - m.mean) AS p FROM v JOIN k ON v.fold = k.k JOIN t ON t.k = k.k AND t.cell = v.cell JOIN m ON m.k = k.k),
r AS (SELECT k, 1 - sum((y - p) * (y - p)) / (sum(y * y) - sum(y) * sum(y) / count(*)) AS r2 FROM q GROUP BY k)"""


@query(f"WITH {_MIXED}, {_cv_sql(2, 1.0)} SELECT 'u' AS category, round(avg(r2), 6) AS score FROM r")
def q_cross_validation(spark: SparkSession, d: str) -> DataFrame:
    got = models.cross_validated(models.Settings(model_family="GradientBoosting"), [2, 1.0, 8, 1.0], ["a"], _mixed(spark, d))
    return spark.range(1).select(F.lit("u").alias("category"), F.round(F.lit(got), 6).alias("score"))


@query(f"WITH {_MIXED}, {_cv_sql(2, 1.0)} SELECT 'u' AS category, '[2, 1.0, 8, 1.0]' AS params, (SELECT count(*) FROM v) AS n_rows, 1 AS n_cols, round(avg(r2), 6) AS score FROM r")
def q_search_cells(spark: SparkSession, d: str) -> DataFrame:
    """The climb over learning rates ends at the one that reaches the cells' shares."""
    s = models.Settings(model_family="GradientBoosting", num_trees=[2], max_features=[1.0], max_leaf_nodes=[8], learning_rate=[0.2, 0.6, 1.0])
    return models.parameters(models.fit(_cells(spark, d, False).filter("category = 'u'"), s), spark).withColumn("score", F.round("score", 6))


_STEPS = "[" + ", ".join(f"{sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))!r}::DOUBLE" for k in range(forest.MOST_DRAWN)) + "]"


@query(f"""WITH {_MIXED}, b AS (SELECT id, cell, y, t, len(list_filter({_STEPS}, lambda x: x <= CAST(('0x' || substr(md5('99099:' || t || ':' || id), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE)) AS n
  FROM v, (SELECT unnest(range(5)) AS t)),
p AS (SELECT t, cell, sum(n * y) / sum(n) AS p FROM b GROUP BY t, cell),
o AS (SELECT b.id, any_value(b.y) AS y, avg(p.p) AS p FROM b JOIN p ON b.t = p.t AND b.cell = p.cell WHERE b.n = 0 GROUP BY b.id)
SELECT count(*) AS n_scored, round(1 - sum((y - p) * (y - p)) / (sum(y * y) - sum(y) * sum(y) / count(*)), 6) AS oob FROM o""")
def q_out_of_bag(spark: SparkSession, d: str) -> DataFrame:
    """The forest's own score: each row by the trees whose bootstrap left it out."""
    t = _mixed(spark, d)
    s = models.Settings()
    m = models.ForestModel(s, [5, 1.0, 8], ["a"]).fit(t)
    n = t.filter(F.array_contains(forest.boots(5, s.seed, ["id"]), F.lit(0).cast("tinyint"))).count()
    return spark.range(1).select(F.lit(n).cast("long").alias("n_scored"), F.round(F.lit(m.out_of_bag(t)), 6).alias("oob"))


# One feature of six values and at most three leaves: of the cuts of all value ranges, SQL takes the root's best one
# and then the better of its two sides' best ones.
@query("""WITH v AS (SELECT event_id AS id, event_id % 6 AS a, CASE WHEN event_id // 6 % 7 < [1, 2, 5, 6, 3, 2][CAST(event_id % 6 + 1 AS BIGINT)] THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM events),
s AS (SELECT a, count(*) AS w, sum(y) AS g FROM v GROUP BY a),
i AS (SELECT x.a AS lo, y.a AS hi, sum(s.w) AS w, sum(s.g) AS g FROM s x JOIN s y ON x.a <= y.a JOIN s ON s.a BETWEEN x.a AND y.a GROUP BY ALL),
k AS (SELECT n.lo, n.hi, l.hi AS cut, l.g * l.g / l.w + r.g * r.g / r.w - n.g * n.g / n.w AS gain FROM i n JOIN i l ON l.lo = n.lo AND l.hi < n.hi JOIN i r ON r.hi = n.hi AND r.lo = l.hi + 1),
b AS (SELECT lo, hi, arg_max(cut, gain) AS cut, max(gain) AS gain FROM k GROUP BY lo, hi),
root AS (SELECT cut FROM b WHERE lo = 0 AND hi = 5),
kid AS (SELECT b.lo, b.hi, b.cut FROM b, root WHERE (b.lo = 0 AND b.hi = root.cut) OR (b.lo = root.cut + 1 AND b.hi = 5) ORDER BY b.gain DESC LIMIT 1),
leaf AS (SELECT s.a, CASE WHEN s.a <= root.cut THEN 0 ELSE 2 END + CASE WHEN s.a BETWEEN kid.lo AND kid.hi AND s.a > kid.cut THEN 1 ELSE 0 END AS leaf FROM s, root, kid),
m AS (SELECT leaf, sum(g) / sum(w) AS p FROM s JOIN leaf USING (a) GROUP BY leaf)
SELECT v.id, round(m.p, 6) AS pcor FROM v JOIN leaf USING (a) JOIN m USING (leaf)""")
def q_leaf_cap(spark: SparkSession, d: str) -> DataFrame:
    """A tree of three leaves, grown best split first."""
    e = c("event_id")
    share = F.get(F.array(*(F.lit(x) for x in (1, 2, 5, 6, 3, 2))), (e % 6).cast("int"))
    t = read(spark, d, "events").select(e.alias("id"), (e % 6).cast("double").alias("a"), ((e / 6).cast("long") % 7 < share).cast("int").alias("correct"))
    m = models.BoostedModel(models.Settings(), [1, 1.0, 3, 1.0], ["a"]).fit(t)
    return m.predict(t).select("id", F.round("pcor", 6).alias("pcor"))


# Two trees of two leaves over three cells: a leaf that holds two cells has their weighted mean, and the weights come from
# the first fit, so a second fit that ignored them would predict other values.
def _stump_sql(name: str, sums: str) -> str:
    """The tree of two leaves over ``sums`` (cell, w, g): cut after cell 0 or 1, whichever gains more; its value by cell."""
    return f"""{name}_c AS (SELECT cut, sum(CASE WHEN cell <= cut THEN w END) AS wl, sum(CASE WHEN cell <= cut THEN g END) AS gl, sum(CASE WHEN cell > cut THEN w END) AS wr, sum(CASE WHEN cell > cut THEN g END) AS gr
  FROM {sums}, (SELECT unnest([0, 1]) AS cut) GROUP BY cut),
{name}_b AS (SELECT arg_max(struct_pack(cut := cut, l := gl / wl, r := gr / wr), gl * gl / wl + gr * gr / wr) AS t FROM {name}_c),
{name} AS (SELECT cell, CASE WHEN cell <= t.cut THEN t.l ELSE t.r END AS v FROM {sums}, {name}_b)"""


def _two_stumps_sql(name: str, sums: str) -> str:
    return f"""{name}_m AS (SELECT sum(g) / sum(w) AS v FROM {sums}),
{name}_s1 AS (SELECT cell, w, g - w * v AS g FROM {sums}, {name}_m), {_stump_sql(f'{name}_t1', f'{name}_s1')},
{name}_s2 AS (SELECT cell, w, g - w * v AS g FROM {name}_s1 JOIN {name}_t1 USING (cell)), {_stump_sql(f'{name}_t2', f'{name}_s2')},
{name} AS (SELECT cell, {name}_m.v + {name}_t1.v + {name}_t2.v AS p FROM {name}_m, {name}_t1 JOIN {name}_t2 USING (cell))"""


def _reweighted_sql(weight: str) -> str:
    return f"""WITH {_MIXED}, s AS (SELECT cell, CAST(count(*) AS DOUBLE) AS w, sum(y) AS g FROM v GROUP BY cell), {_two_stumps_sql('x', 's')},
s2 AS (SELECT cell, w * ({weight}) AS w, g * ({weight}) AS g FROM s JOIN x USING (cell)), {_two_stumps_sql('z', 's2')}
SELECT v.id, round(z.p, 6) AS pcor, round(x.p, 6) AS first_pcor FROM v JOIN x USING (cell) JOIN z USING (cell)"""


def _reweighted(spark: SparkSession, d: str, **how) -> DataFrame:
    t = _mixed(spark, d)
    s, params = models.Settings(model_family="GradientBoosting", **how), [2, 1.0, 2, 1.0]
    first = models.BoostedModel(s, params, ["a"]).fit(t).predicted()
    second = models.fit_reweighted(s, params, ["a"], t).predicted()
    return t.select("id", *((F.round(p * 1e6, 0) / 1e6).alias(name) for name, p in (("pcor", second), ("first_pcor", first))))  # halves as the SQL judges them, in doubles


@query(_reweighted_sql("0.1::DOUBLE + p * 0.9::DOUBLE"))
def q_reweight_ratio(spark: SparkSession, d: str) -> DataFrame:
    return _reweighted(spark, d, reweight_ratio=10.0)


@query(_reweighted_sql("abs(-10 * log10(1 - least(0.999999::DOUBLE, greatest(0.0::DOUBLE, p)))) + 0.5::DOUBLE"))
def q_reweight_mapq(spark: SparkSession, d: str) -> DataFrame:
    return _reweighted(spark, d, reweight_mapq=True, reweight_mapq_offset=0.5)


def calibrated(spark: SparkSession, d: str) -> DataFrame:
    """Held-out rows of the embeddings, for tests: predictions of a model fitted on the others."""
    t = _training(spark, d)
    m = models.fit(t.filter(c("id") % 5 != 0), models.Settings(num_trees=[10], max_features=[0.5], max_leaf_nodes=[16]))
    return rounded(models.predict(t.filter(c("id") % 5 == 0), m))
