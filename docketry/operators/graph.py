"""Layout of the connection graph of every case at once: case, groups by kind, items; by window arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.operators.tree import kind_rank

# Sizes of the drawing.
CASE_W, GROUP_W, ITEM_W, H, ROW_GAP, GROUP_GAP, COL_GAP, MOST = 170, 130, 190, 28, 8, 20, 56, 24
GROUP_X = CASE_W + COL_GAP
ITEM_X = GROUP_X + GROUP_W + COL_GAP
ROW = H + ROW_GAP


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def groups(nodes: DataFrame) -> DataFrame:
    """case_id, kind, n, top, y: where each group of a case starts and sits; groups follow one another in fixed order."""
    n = nodes.filter("kind <> 'case' AND case_id IS NOT NULL").groupBy("case_id", "kind").agg(F.count("*").alias("n"))
    w = W.partitionBy("case_id").orderBy(kind_rank()).rowsBetween(W.unboundedPreceding, -1)
    placed = n.withColumn("top", F.coalesce(F.sum(F.col("n") * ROW + GROUP_GAP).over(w), F.lit(0)))
    return placed.withColumn("y", (F.col("top") + F.col("top") + F.col("n") * ROW - ROW_GAP) / 2.0 - H / 2.0)


def items(nodes: DataFrame) -> DataFrame:
    """case_id, id, label, x, y of each item, in the tree's order under its group.

    The place under a group is counted in buckets of the ordinal, so a case with very many items is spread over tasks.
    """
    own = nodes.filter("kind <> 'case' AND case_id IS NOT NULL").withColumn("bucket", F.floor(F.col("ordinal") / 4096))
    n = own.groupBy("case_id", "kind", "bucket").agg(F.count("*").alias("m"))
    before = n.withColumn("before", F.coalesce(F.sum("m").over(W.partitionBy("case_id", "kind").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("m")
    local = own.withColumn("i", F.row_number().over(W.partitionBy("case_id", "kind", "bucket").orderBy("ordinal")) - 1)
    at = local.join(before, ["case_id", "kind", "bucket"]).join(groups(nodes).select("case_id", "kind", "top"), ["case_id", "kind"])
    return at.select("case_id", "id", "kind", shortened(F.col("label"), MOST).alias("label"), F.lit(ITEM_X).alias("x"), (F.col("top") + (F.col("before") + F.col("i")) * ROW).cast("double").alias("y"))


def roots(nodes: DataFrame) -> DataFrame:
    """case_id, label, y, height of every case with something connected: between its first and its last group."""
    g = groups(nodes).withColumn("rank", kind_rank())
    y = g.groupBy("case_id").agg(((F.min_by("y", "rank") + F.max_by("y", "rank")) / 2.0).alias("y"), (F.max(F.col("top") + F.col("n") * ROW) - ROW_GAP).cast("double").alias("height"), F.sum("n").alias("connections"))
    label = nodes.filter("kind = 'case'").select("case_id", shortened(F.coalesce("detail", "label"), MOST - 4).alias("label"))
    return label.join(y, "case_id").select("case_id", "label", "y", "height", "connections")


def curve(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """SVG path between two points."""
    mx = (x1 + x2) / 2
    return F.format_string("M%s,%s C%s,%s %s,%s %s,%s", x1, y1, mx, y1, mx, y2, x2, y2)


def edges(nodes: DataFrame) -> DataFrame:
    """case_id, source, target, path from cases to groups and from groups to items."""
    d = lambda v: F.lit(v).cast("double")
    g = groups(nodes).select("case_id", "kind", F.col("y").alias("gy"))
    to_group = g.join(roots(nodes).select("case_id", F.col("y").alias("cy")), "case_id").select(
        "case_id", F.concat(F.lit("case:"), "case_id").alias("source"), F.concat(F.lit("group:"), "kind").alias("target"), curve(d(CASE_W), F.col("cy") + H / 2, d(GROUP_X), F.col("gy") + H / 2).alias("path")
    )
    to_item = items(nodes).join(g, ["case_id", "kind"]).select(
        "case_id", F.concat(F.lit("group:"), "kind").alias("source"), F.col("id").alias("target"), curve(d(GROUP_X + GROUP_W), F.col("gy") + H / 2, d(ITEM_X), F.col("y") + H / 2).alias("path")
    )
    return to_group.unionByName(to_item)


def bounds(nodes: DataFrame) -> DataFrame:
    """case_id, width, top, bottom: the box around the drawing of every case with something connected."""
    y = items(nodes).groupBy("case_id").agg(F.min("y").alias("least"), F.max("y").alias("most"))
    own = roots(nodes).select("case_id", F.col("y").alias("own"))
    return y.join(own, "case_id").select("case_id", F.lit(ITEM_X + ITEM_W).alias("width"), F.least("least", "own").alias("top"), (F.greatest("most", "own") + H).alias("bottom"))
