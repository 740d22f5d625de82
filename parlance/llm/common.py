"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def crc_remainder(key: str, divisor: int) -> Column:
    """crc32 of a key written as text, modulo ``divisor``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % divisor


def computed(df: DataFrame, **values: Column) -> DataFrame:
    """Add columns that are computed once, however often later expressions use them.

    The optimizer copies the expressions of a plain projection into whatever stands above; a one-row generator stops that.
    """
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))))


def keyed_rows(df: DataFrame, prefix: str, **columns: str) -> DataFrame:
    """The named columns only, under names of our own, so that other columns of ``df`` cannot clash."""
    return df.select(*[F.col(f"`{source}`").alias(prefix + name) for name, source in columns.items()])
