"""Connected components of an edge table, by neighbour minima and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phredloom.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (its smallest reachable node) for every node of ``edges`` (a, b).

    Every round takes the smallest label among neighbours, then the label of
    that label; tables stay on the executors, and only a count of changed rows
    reaches the driver. Ends when nothing changed; no edges give no rows.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other").filter("node <> other").distinct())
    labels = materialize(both.groupBy("node").agg(F.least("node", F.min("other")).alias("c")))
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("c").alias("oc")), "other").groupBy("node").agg(F.min("oc").alias("oc"))
        stepped = labels.join(near, "node", "left").select("node", F.col("c").alias("old"), F.least("c", F.coalesce("oc", "c")).alias("c"))
        jump = labels.select(F.col("node").alias("c"), F.col("c").alias("cc"))
        new = materialize(stepped.join(jump, "c", "left").select("node", "old", F.least("c", F.coalesce("cc", "c")).alias("c")))
        changed = new.filter("c <> old").limit(1).count()
        labels = new.select("node", "c")
        if not changed:
            return labels.withColumnRenamed("c", "component")
