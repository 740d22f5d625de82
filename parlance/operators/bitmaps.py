"""Exact distinct counts that can be added up: one bitmap per period and group instead of the rows.

A count of distinct messages or users per month cannot be added to one per year, since the same user writes in several months. A bitmap of the
numbers seen can: months are united bit by bit, and only the bits of new months are computed. Spark's bitmap functions cut numbers into buckets of
32 768, so a bitmap is rows of at most 4 KB and no group's numbers ever come together in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators.ranking import join_null_safe
from parlance.session import saved
from parlance.sources import sinks


def distinct_bitmaps(df: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """``keys``, ``bucket`` and ``bits``: the values of ``number`` that occur with each key.

    ``number`` is a whole number, best one of a dense numbering such as message or user ids: a bucket takes 4 KB however few of its numbers
    occur. Rows without a number count nothing; null keys are keys.
    """
    value = F.col(number).cast("long")
    rows = df.filter(value.isNotNull()).select(*keys, F.bitmap_bucket_number(value).alias("bucket"), F.bitmap_bit_position(value).alias("place"))
    return rows.groupBy(*keys, "bucket").agg(F.bitmap_construct_agg("place").alias("bits"))


def united(bitmaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bitmaps of fewer ``keys``: what occurs in any of those that fall together."""
    return bitmaps.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def counted(bitmaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys`` and the number ``n`` of distinct values, bitmaps of the same keys united first."""
    return united(bitmaps, keys).groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias("n"))


def add_to_bitmaps(df: DataFrame, period: Sequence[str], keys: Sequence[str], number: str, path: str) -> None:
    """Add rows to the bitmaps stored at ``path``, partitioned by the ``period`` columns.

    Only the partitions of periods that occur in ``df`` are read and replaced. Adding the same rows again changes nothing, so a run
    that died is simply repeated.
    """
    spark, every = df.sparkSession, [*period, *keys]
    new = saved(distinct_bitmaps(df, every, number), "new-bitmaps")
    if sinks.table_exists(spark, path):
        periods = saved(new.select(*period).distinct(), "new-periods")
        stored = spark.read.parquet(path).select(*new.columns)
        new = saved(united(new.unionByName(join_null_safe(stored, periods, list(period))), every), "bitmaps")
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*period).parquet(path)
