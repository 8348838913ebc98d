"""Connected components by minimum labels with pointer jumping; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.session import cut


def connected(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (the least node of its component). `nodes`: node; `edges`: a, b, in any direction, repeats allowed.

    Only nodes with edges take part in the search; the others are components of their own. Labels start as the least
    neighbour. Each round takes the least label among the neighbours' and, if any changed, the label of that label, so chains
    shrink by half or more. Labels only ever travel as grouped minima: a node with very many edges costs one partially
    aggregated row per task.
    """
    real = edges.select("a", "b").filter("a <> b")
    both = cut(real.unionByName(real.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("component"))
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        low = cut(labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("low")))
        if low.filter("low <> old").isEmpty():
            found = nodes.select("node").distinct().join(low, "node", "left")
            return found.select("node", F.coalesce("low", "node").alias("component"))
        labels = low.join(low.select(F.col("node").alias("low"), F.col("low").alias("component")), "low").select("node", F.least("low", "component").alias("component"))
    raise RuntimeError(f"no fixed point after {rounds} rounds")
