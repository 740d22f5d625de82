"""Row filters and small column changes of the cleaning stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.schemas import REACTIONS


def with_computed(df: DataFrame, out: str, value: Column) -> DataFrame:
    """Add an expensive column that later filters and projections reuse.

    The optimizer copies a plain column's expression into every filter and projection above it. A
    one-row generator keeps it computed once.
    """
    return df.drop(out).select("*", F.inline(F.array(F.struct(value.alias(out)))))


def clean_and_keep_long(df: DataFrame, text: str = "text", out: str = "text_clean", min_length: int = 20) -> DataFrame:
    """Strip URLs and mentions into ``out`` and keep rows of at least ``min_length`` characters."""
    cleaned = with_computed(df, out, tx.strip_urls_and_mentions(F.col(text)))
    return cleaned.filter(F.length(out) >= min_length)


def keep_longer_than(df: DataFrame, column: str, length: int = 20) -> DataFrame:
    """Keep text strictly longer than ``length`` (missing and empty text never is)."""
    return df.filter(F.length(F.coalesce(column, F.lit(""))) > length)


def add_period(df: DataFrame, epoch: str = "timestamp") -> DataFrame:
    """Add ``datetime`` text, ``year`` and ``month`` from epoch seconds."""
    moment = F.timestamp_seconds(epoch)
    return df.withColumns(
        {"datetime": tx.epoch_seconds_text(F.col(epoch)), "year": F.year(moment), "month": F.month(moment)}
    )


def keep_equal(df: DataFrame, column: str | None, value=None) -> DataFrame:
    """Equality filter that a configuration may leave out (``column=None``)."""
    return df if column is None else df.filter(F.col(column) == F.lit(value))


def keep_valid_period(df: DataFrame, year: int | None = None) -> DataFrame:
    """Rows with a known year and month, optionally of one year."""
    valid = df.filter(F.col("year").isNotNull() & F.col("month").isNotNull())
    return valid if year is None else valid.filter(F.col("year") == year)


def add_stratum(df: DataFrame, parts: Sequence[str], out: str = "strat_key") -> DataFrame:
    return df.withColumn(out, F.concat_ws("_", *[F.col(p).cast("string") for p in parts]))


def coerce_timestamp(df: DataFrame, column: str, required: Sequence[str] = ()) -> DataFrame:
    """Parse to timestamp with bad values as null, then drop rows null in any required column."""
    parsed = df.withColumn(column, F.try_to_timestamp(F.col(column).cast("string")))
    return parsed.dropna(subset=list(required)) if required else parsed


def keep_labels(df: DataFrame, column: str, labels: Sequence[str]) -> DataFrame:
    return df.filter(F.col(column).isin(list(labels)))


def rename_if_present(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename the columns that exist; the others are ignored."""
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def row_type(topic: Column, is_political: Column) -> Column:
    """Outlier for topic -1, otherwise by the political flag; unknown flag gives null."""
    return (
        F.when(topic == -1, "Outlier").when(is_political, "Political").when(~is_political, "Non-political")
    )


def merge_key(value: Column) -> Column:
    """A join key as trimmed text in which ``30``, ``+30``, ``30.0``, ``030`` and ``' 30 '`` are the same.

    Numbers are compared by their digits, never as floating point, so long ids stay apart, as do ``30`` and ``30d``.
    """
    plain = F.trim(value.cast("string"))
    digits = F.regexp_replace(plain, r"^([+-]?)0*(\d)", "$1$2")
    digits = F.regexp_replace(F.regexp_replace(digits, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    number = F.regexp_replace(F.regexp_replace(digits, r"^\+", ""), "^-0$", "0")
    return F.when(plain.rlike(r"^[+-]?\d+(\.\d*)?$"), number).otherwise(plain)


def explode_reactions(df: DataFrame, column: str = "reaction_json") -> DataFrame:
    """One row per reaction of the JSON object column: ``reaction``, ``reaction_count``."""
    parsed = F.from_json(column, REACTIONS)
    return df.select("*", F.explode(parsed).alias("reaction", "reaction_count"))
