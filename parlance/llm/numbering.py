"""Exact places in an order, slice by slice, and joins that hold hot keys apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.session import saved


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], place: str = "pos", total: str = "n") -> DataFrame:
    """Add ``place`` (0, 1, 2, ... by ``order`` within ``group``) and ``total`` (rows of the group).

    Spark range-partitions the rows by group and order and sorts every slice; a slice's place in its group is the number of rows in the
    slices before it. A group of any size is spread over as many slices as it needs. The group columns must not be null. Rows that agree
    in group and order are numbered in any order.
    """
    keys = [*group, *order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df
    rows = saved(ranged.withColumn("__row_id", F.monotonically_increasing_id()), "slices")
    rows = rows.withColumn("__slice", F.shiftright("__row_id", 33))
    sizes = rows.groupBy(*group, "__slice").agg(F.count(F.lit(1)).alias("__rows"), F.min("__row_id").alias("__first"))
    every = Window.partitionBy(*group)
    before = every.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = saved(
        sizes.select(
            *group, "__slice",
            (F.coalesce(F.sum("__rows").over(before), F.lit(0)) - F.col("__first")).alias("__shift"),
            F.sum("__rows").over(every).alias(total),
        ),
        "slice-starts",
    )
    placed = rows.join(starts, [*group, "__slice"])
    return placed.withColumn(place, F.col("__row_id") + F.col("__shift")).drop("__slice", "__row_id", "__shift")


def join_counted(rows: DataFrame, classes: DataFrame, key: str, count: str, n_rows: int, parts: int = 1000) -> DataFrame:
    """Inner join of stored ``rows`` with stored ``classes`` (one row per ``key``, ``count`` of its rows among ``n_rows``).

    Keys that hold at least ``1 / parts`` of all rows, of which there can be no more than ``parts``, are broadcast, so their rows stay
    where they are; the rows of all other keys are shuffled, and no such key is large.
    """
    hot = F.broadcast(classes.filter(F.col(count) * parts >= n_rows))
    cold = classes.filter(F.col(count) * parts < n_rows)
    apart = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(apart.join(cold.hint("merge"), key))
