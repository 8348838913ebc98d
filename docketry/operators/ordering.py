"""A dense number over a whole table without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.session import cut


class Desc:
    """A column to be ordered from large to small, NULL last."""

    def __init__(self, column: Column):
        self.column = column


def numbered(df: DataFrame, order: list[Column | Desc], name: str = "ordinal", start: int = 0) -> DataFrame:
    """`df` with its place in `order` (which must be total), dense from `start`.

    Rows are range-partitioned by the order and written once; each partition is numbered on its own and shifted by the rows of
    the partitions before it. Only one small row per partition is brought together.
    """
    keyed = df.withColumns({f"__k{i}": c.column if isinstance(c, Desc) else c for i, c in enumerate(order)})
    keys = [f"__k{i}" for i in range(len(order))]
    flags = [_descending(c) for c in order]
    ranged = cut(keyed.repartitionByRange(*[_as(k, d) for k, d in zip(keys, flags)]).withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    local = ranged.withColumn("__i", F.row_number().over(W.partitionBy("__part").orderBy(*[_as(k, d) for k, d in zip(keys, flags)])))
    return local.join(F.broadcast(before), "__part").withColumn(name, (F.col("__before") + F.col("__i") - 1 + start).cast("long")).drop(*keys, "__part", "__before", "__i")


def _descending(c) -> bool:
    return isinstance(c, Desc)


def _as(name: str, down: bool) -> Column:
    return F.col(name).desc_nulls_last() if down else F.col(name).asc_nulls_first()
