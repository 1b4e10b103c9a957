"""What shows only on larger or odd tables: halves, ties, folders of parts, memory of a task."""

from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from phredloom.operators import calibration
from phredloom.plans import models

SHARES = (1, 2, 5, 6, 3, 2)


def test_halves_are_judged_as_sql_judges_them(spark):
    # prices whose 7,000th ends in half a thousandth (and its neighbours): 64.1595 is a half as printed, and less as a double
    values = [(700 * i + 350 + j) / 100 for i in range(0, 66_000, 7) for j in (-1, 0, 1)] + [-449116.5, 3500.0, 10500.0, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double").select((F.col("v") / 7000).alias("m"))
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT unnest(?::DOUBLE[]) / 7000 AS m", [values])
    for places in (3, 0):
        got = {r["stratum"]: r["cor"] for r in calibration.tally(df, F.col("m"), F.lit(True), places).collect()}
        assert got == dict(con.execute(f"SELECT round_even(m, {places}) + 0.0, count(*) FROM t GROUP BY 1").fetchall())


@pytest.mark.parametrize("params", [[1, 1.0, 3, 1.0], [3, 1.0, 8, 1.0]])
def test_boosting_at_rate_one_gives_the_share_itself(spark, params):
    # 1,000,000 rows a value, so that (142,858 + 285,715) / 2,000,000 = 0.2142865 is a half at six places
    n = 6_000_000
    t = spark.range(n).select("id", (F.col("id") % 6).cast("double").alias("a"), ((F.col("id") / 6).cast("long") % 7 < F.get(F.array(*map(F.lit, SHARES)), (F.col("id") % 6).cast("int"))).cast("int").alias("correct"))
    m = models.BoostedModel(models.Settings(), params, ["a"]).fit(t)
    cells = spark.range(6).select(F.col("id").cast("double").alias("a")).select("a", m.predicted().alias("p"))
    got = {int(r["a"]): r["p"] for r in cells.collect()}
    share = {a: sum(i % 7 < s for i in range(n // 6)) for a, s in enumerate(SHARES)}
    groups = [(0, 1), (2, 3), (4, 5)] if params[2] == 3 else [(a,) for a in range(6)]
    assert got == {a: sum(share[x] for x in g) / (len(g) * (n // 6)) for g in groups for a in g}


@pytest.mark.parametrize("counts", [(25000, 50001, 75000), (24998, 49999, 75002), (25002, 50002, 74999)])
def test_later_trees_are_as_exact_as_doubles(spark, counts):
    # 100,000 rows a cell: the stumps' sum is a half at six places, and stood 1e-12 beside it while each row's residual was cut to a step
    i = F.col("id")
    t = spark.range(300_000).select("id", (i % 3).cast("double").alias("a"), ((i / 3).cast("long") < F.get(F.array(*map(F.lit, counts)), (i % 3).cast("int"))).cast("int").alias("correct"))
    got = {}
    for name, how in (("first", {}), ("second", {"reweight_ratio": 10.0})):
        m = models.fit_reweighted(models.Settings(model_family="GradientBoosting", **how), [2, 1.0, 2, 1.0], ["a"], t)
        got[name] = {int(r["a"]): r["p"] for r in spark.range(3).select(i.cast("double").alias("a")).select("a", m.predicted().alias("p")).collect()}

    def stumps(cells):  # (weight, label sum) of each cell, exactly
        p = [Fraction(0)] * 3
        for _ in range(2):
            left = [g - w * x for (w, g), x in zip(cells, p, strict=True)]
            sides = [[(sum(left[a:b]) / sum(w for w, _ in cells[a:b]), a, b) for a, b in ((0, cut), (cut, 3))] for cut in (1, 2)]
            best = max(sides, key=lambda s: sum(v * v * sum(w for w, _ in cells[a:b]) for v, a, b in s))
            for v, a, b in best:
                p[a:b] = [x + v for x in p[a:b]]
        return p

    cells = [(Fraction(100_000), Fraction(c)) for c in counts]
    first = stumps(cells)
    second = stumps([(w * (Fraction(1, 10) + x * Fraction(9, 10)), g * (Fraction(1, 10) + x * Fraction(9, 10))) for (w, g), x in zip(cells, first, strict=True)])
    for name, want in (("first", first), ("second", second)):
        assert all(abs(Fraction(got[name][a]) - want[a]) < Fraction(1, 10**15) for a in range(3)), (name, got[name])


@pytest.mark.parametrize("name", ["q_reweight_ratio", "q_reweight_mapq"])
@pytest.mark.parametrize("shift", [100_022, 100_030])
def test_reweighted_halves_equal_the_sql(spark, tmp_path, name, shift):
    from phredloom.plans import catalog_models, registry

    spark.range(600_000, numPartitions=4).select((F.col("id") % 100_000 + (F.col("id") / 100_000).cast("long") * shift).alias("event_id")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = {tuple(r) for r in getattr(catalog_models, name)(spark, str(tmp_path)).groupBy("pcor", "first_pcor").count().collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == set(con.execute(f"SELECT pcor, first_pcor, count(*) FROM ({registry.SQL[name]}) GROUP BY ALL").fetchall())


def test_parts_of_a_folder_are_one_file(spark, tmp_path):
    from phredloom.sources import fasta, fastq, sam

    lines = [f"r{i}" for i in range(5000)]
    for name, n in (("a", 13), ("b", 3)):
        spark.range(0, 5000, 1, n).select(F.concat(F.lit("r"), "id")).write.text(str(tmp_path / name))
    (tmp_path / "c.sam").write_text("".join(f"{x}\n" for x in lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        got = sam.numbered_lines(spark, [str(tmp_path / x) for x in ("a", "b", "c.sam")]).collect()
        reads = fastq.read_fastq(spark, str(tmp_path / "a")).collect()
        text = [">one x", *(["ACGTA"] * 700), ">two", *(["CC"] * 301)]
        spark.createDataFrame([(i, x) for i, x in enumerate(text)], "i int, x string").repartitionByRange(9, "i").sortWithinPartitions("i").select("x").write.text(str(tmp_path / "fa"))
        whole = {r["refid"]: r["seq"] for r in fasta.read_fasta(spark, str(tmp_path / "fa"), chunk=10_000).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 15_000 and all(r["raw"] == lines[r["line"] - 1] for r in got)
    assert sorted(r["file"].rpartition("/")[2] for r in got)[::5000] == ["a", "b", "c.sam"]
    assert len(reads) == 1250 and all((r["name"], r["qual"]) == (f"r{4 * r['ordinal']}", f"r{4 * r['ordinal'] + 3}") for r in reads)
    assert whole == {"one": "ACGTA" * 700, "two": "CC" * 301}


def test_text_and_mates_are_dealt_to_more_tasks_where_there_are_more(spark, monkeypatch):
    from phredloom.operators import pairing, rewrite
    from phredloom.plans import registry
    from phredloom.sources import sam

    monkeypatch.setattr(registry, "TASK_ROWS", 1000)
    df = spark.range(40_000).select((F.col("id") % 8).alias("f"), F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("value"))
    paths = registry.text_files(df, 40_000)
    got = sam.numbered_lines(spark, paths).select(registry.file_number().alias("f"), "line", "raw").collect()
    assert len(got) == 40_000 and all(r["raw"] == f"v{8 * (r['line'] - 1) + r['f']}" for r in got)
    sizes = [r[0] for r in spark.read.text(paths).groupBy(F.input_file_name()).count().select("count").collect()]
    assert len(sizes) >= 40 and max(sizes) < 3000  # one task wrote a whole file before
    monkeypatch.setattr(pairing, "TASK_ROWS", 1000)
    records = df.select(F.concat(F.lit("x"), (F.col("k") / 2).cast("long") % 3).alias("file"), (F.col("k") / 2).cast("long").alias("qname"), F.col("k").alias("line"), (F.col("k") % 2 + 1).cast("string").alias("mate_flag"))
    pairs = pairing.pair_mates(records)
    assert pairs.rdd.getNumPartitions() == 40 and pairs.filter("a1.qname = a2.qname and a1.line + 1 = a2.line").count() == 20_000
    monkeypatch.setattr(rewrite, "TASK_ROWS", 1000)
    lines = sam.numbered_lines(spark, paths)
    back = rewrite.rewritten_in_order(lines, [lines.limit(0).select("file", "line", F.lit(1.0).alias("mapq"))])
    assert back.rdd.getNumPartitions() == 40 and back.count() == 40_000


def test_a_search_bins_each_fold_once_and_grows_its_first_tree_once(spark, monkeypatch):
    from phredloom.operators import forest

    t = spark.range(600).select(F.lit("u").alias("category"), "id", (F.col("id") % 3).cast("double").alias("a"), F.lit(0).alias("mapq"), ((F.col("id") / 3).cast("long") % 4 < F.col("id") % 3 + 1).cast("int").alias("correct"))
    calls, grown = [], []
    bin_, grow = forest.binned, forest.grow
    monkeypatch.setattr(forest, "binned", lambda *a, **b: calls.append(1) or bin_(*a, **b))
    monkeypatch.setattr(forest, "grow", lambda *a, **b: grown.append(a[5]) or grow(*a, **b))
    s = models.Settings(model_family="GradientBoosting", num_trees=[2], max_features=[1.0], max_leaf_nodes=[8], learning_rate=[0.2, 0.6, 1.0])
    got = models.fit_category(t, "u", s)
    assert got.params == [2, 1.0, 8, 1.0] and len(calls) == 4 and grown.count(0) == 4  # three folds, and the last fit
    for rate in (0.2, 1.0):
        alone = models.cross_validated(s, [2, 1.0, 8, rate], ["a"], t)
        shared: dict = {}
        assert {models.cross_validated(s, [2, 1.0, 8, r], ["a"], t, shared=shared) for r in (0.6, rate, rate)} >= {alone}
