"""Places and running totals in ranges equal sequential ones."""

import itertools
import random

from pyspark.sql import functions as F

from phredloom.operators import running


def test_places_and_totals(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(40), None if i % 7 == 0 else rng.randrange(100)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, k int, v long")
    order = [F.desc("k"), F.asc("id")]
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    got = {r["id"]: r["rank"] for r in running.numbered(df, order, ranges=13).collect()}
    assert [got[r[0]] for r in want] == list(range(1, 3001))
    runs = {r["id"]: (r["a"], r["b"]) for r in running.totals(df, order, {"a": F.col("v"), "b": F.lit(1)}, ranges=13).collect()}
    sums = itertools.accumulate(r[2] or 0 for r in want)
    assert [runs[r[0]] for r in want] == [(s, i) for i, s in enumerate(sums, 1)]


def test_empty_and_single(spark):
    df = spark.createDataFrame([], "id long, v long")
    assert running.numbered(df, [F.col("id")]).count() == 0
    assert running.totals(df, [F.col("id")], {"t": F.col("v")}).count() == 0
    one = spark.createDataFrame([(5, None)], "id long, v long")
    assert running.totals(one, [F.col("id")], {"t": F.col("v")}).collect()[0]["t"] == 0


def test_no_window_holds_the_table(spark, capsys):
    df = spark.range(1000)
    running.numbered(df, [F.col("id")]).explain()
    plan = capsys.readouterr().out
    assert "Exchange SinglePartition" in plan  # of one row a range
    assert plan.index("BroadcastExchange") < plan.index("Exchange SinglePartition")
