"""A running number over a whole table without gathering its rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.scratch import materialize


def global_rank(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with ``name``: its place from 0 in the given total order.

    The rows are dealt by ranges of the order and written, so that the ranges
    are the same for all that follows; each range is numbered by itself and
    shifted by the rows before it. Only the ranges' counts meet in one task.
    """
    dealt = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = (
        dealt.groupBy("_range")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_range", (F.sum("_rows").over(Window.orderBy("_range")) - F.col("_rows")).alias("_before"))
    )
    placed = dealt.withColumn("_place", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    # one row a range: as many as there are shuffle partitions, at any size of the input
    return placed.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_place") - 1).drop("_range", "_before", "_place")
