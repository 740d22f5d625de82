"""Counts, distributions and time series for the reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.numbers import fixed_text
from parlance.functions.text import week_ending_sunday
from parlance.operators.ranking import exact_quantiles, first_per_key, join_null_safe
from parlance.session import saved


def monthly_unique(df: DataFrame, source: str, month: str, key: str = "id") -> DataFrame:
    """Distinct ids per source and month, summed per month."""
    return df.select(source, month, key).distinct().groupBy(month).agg(F.count(F.lit(1)).alias("messages"))


def first_day_of_ids(df: DataFrame, source: str, moment: str, key: str = "id") -> DataFrame:
    """The day on which each id of a source is first seen."""
    return df.groupBy(source, key).agg(F.min(moment).alias("__first")).select(
        source, key, F.col("__first").cast("date").alias("day")
    )


def daily_unique(df: DataFrame, source: str, moment: str, key: str = "id") -> DataFrame:
    """Unique messages per day; a repeated id counts on its first day only."""
    return first_day_of_ids(df, source, moment, key).groupBy("day").agg(F.count(F.lit(1)).alias("messages"))


def total_and_kept(df: DataFrame, period: str, kept: Column) -> DataFrame:
    """Rows per period and how many of them are kept, in one pass."""
    return df.groupBy(period).agg(F.count(F.lit(1)).alias("total"), F.count_if(kept).alias("kept"))


def rows_per_month(df: DataFrame) -> DataFrame:
    """Rows per ``year`` and ``month`` with a ``YYYY-MM`` label, in order."""
    label = F.format_string("%04d-%02d", "year", "month")
    counts = df.groupBy("year", "month").agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn("period", label).orderBy("year", "month")


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct().agg(F.count(F.lit(1)).alias("distinct_keys"))


def validate_key(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Rows, null key parts, rows beyond the first of their key, and whether the key is valid.

    Counted from rows per key, so one hot key costs one row per map task.
    """
    nulls = sum((F.when(F.col(k).isNull(), 1).otherwise(0) for k in keys), F.lit(0))
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    summary = per_key.agg(
        F.sum("n").alias("rows"), F.sum(nulls * F.col("n")).alias("null_parts"), F.sum(F.col("n") - 1).alias("duplicates")
    )
    valid = (F.col("null_parts") == 0) & (F.col("duplicates") == 0)
    return summary.select(F.lit(name).alias("name"), "rows", "null_parts", "duplicates", valid.alias("valid"))


def rows_and_distinct(df: DataFrame, label: str, member: str) -> DataFrame:
    """Rows and distinct members per label, largest first."""
    return (
        df.groupBy(label)
        .agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(member).alias("distinct_members"))
        .orderBy(F.desc("rows"), label)
    )


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Count and percent share of every value, nulls left out."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = df.select(F.count(column)).scalar()
    return counts.withColumn("percent", F.col("n") * 100.0 / total).orderBy(F.desc("n"), column)


def counts_in_order(df: DataFrame, column: str, order: DataFrame) -> DataFrame:
    """Counts for the values of an ordered label table; a value that does not occur has a null count."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return order.join(counts, column, "left")


def user_activity(df: DataFrame, user: str = "user_id", group: str = "group_name") -> DataFrame:
    """Messages, groups, messages without author, and messages per known author."""
    per_user = df.groupBy(user).agg(F.count(F.lit(1)).alias("n"))
    groups = df.select(group).distinct().select(F.count(group)).scalar()
    known, unknown = F.col(user).isNotNull(), F.col(user).isNull()
    return per_user.agg(
        F.sum("n").alias("messages"),
        F.coalesce(F.sum(F.when(unknown, F.col("n"))), F.lit(0)).alias("without_user"),
        F.count(user).alias("users"),
        F.avg(F.when(known, F.col("n"))).alias("mean_per_user"),
        F.max(F.when(known, F.col("n"))).alias("max_per_user"),
    ).select(
        "*", (F.col("without_user") * 100.0 / F.col("messages")).alias("percent_without_user"), groups.alias("groups")
    )


def bridge_users(df: DataFrame, user: str = "user_id", group: str = "group_name") -> DataFrame:
    """Users seen in one group, in several, their share, and the most groups of one user."""
    groups = _groups_per_user(df, user, group)
    multi = F.count_if(F.col("groups") > 1)
    return groups.agg(
        F.count_if(F.col("groups") == 1).alias("one_group"),
        multi.alias("several_groups"),
        (multi * 100.0 / F.count(F.lit(1))).alias("percent_several"),
        F.max("groups").alias("max_groups"),
    )


def _groups_per_user(df: DataFrame, user: str, group: str) -> DataFrame:
    pairs = df.filter(F.col(user).isNotNull()).select(user, group).distinct()
    return pairs.groupBy(user).agg(F.count(group).alias("groups"))


def bridge_users_per_group(df: DataFrame, user: str = "user_id", group: str = "group_name") -> DataFrame:
    """Per group: its known users and how many of them also write elsewhere."""
    pairs = df.filter(F.col(user).isNotNull()).select(user, group).distinct()
    counted = pairs.join(_groups_per_user(df, user, group), user)
    return counted.groupBy(group).agg(
        F.count(F.lit(1)).alias("users"), F.count_if(F.col("groups") > 1).alias("shared_users")
    )


def series_statistics(df: DataFrame, day: str, since: str, series: Sequence[str]) -> DataFrame:
    """Sum, mean, sample variance and deviation of each series from a date on, one row per series."""
    long = df.filter(F.col(day) >= F.lit(since).cast("date")).unpivot([day], list(series), "series", "value")
    return long.groupBy("series").agg(
        F.sum("value").alias("total"),
        F.avg("value").alias("mean"),
        F.var_samp("value").alias("variance"),
        F.stddev_samp("value").alias("deviation"),
    )


def monthly_resample(df: DataFrame, day: str, series: Sequence[str]) -> DataFrame:
    """Sums per calendar month, labelled by its first day; months without rows are 0."""
    month = F.date_trunc("month", F.col(day)).cast("date")
    sums = df.groupBy(month.alias("month")).agg(*[F.sum(s).alias(s) for s in series])
    span = sums.agg(F.min("month").alias("a"), F.max("month").alias("b"))
    spine = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    return spine.join(sums, "month", "left").fillna(0, list(series))


def weekly_counts(df: DataFrame, moment: str, label: str) -> DataFrame:
    """Rows per week (labelled by its Sunday) and label."""
    return df.groupBy(week_ending_sunday(F.col(moment)).alias("week"), label).agg(F.count(F.lit(1)).alias("rows"))


def weekly_pivot(df: DataFrame, moment: str, label: str, values: Sequence[str]) -> DataFrame:
    """Weekly counts with one column per listed label, gaps 0."""
    weeks = df.select(week_ending_sunday(F.col(moment)).alias("week"), label)
    return weeks.groupBy("week").pivot(label, list(values)).count().fillna(0)


def weekly_mean(df: DataFrame, moment: str, label: str, score: str, keys: Sequence[str]) -> DataFrame:
    """Weekly mean score per label over rows unique on time, label and key; incomplete rows drop out."""
    complete = df.dropna(subset=[moment, score, label]).select(*dict.fromkeys([moment, label, *keys]), score)
    unique = first_per_key(complete, list(dict.fromkeys([moment, label, *keys])), [score])  # of copies the lowest score counts
    return unique.groupBy(week_ending_sunday(F.col(moment)).alias("week"), label).agg(F.avg(score).alias("mean_score"))


def mean_deviation_table(df: DataFrame, label: str, scores: Sequence[str]) -> DataFrame:
    """Per label one ``mean ± deviation`` text per score."""
    stats = df.groupBy(label).agg(
        *[F.avg(s).alias(f"__m_{s}") for s in scores], *[F.stddev_samp(s).alias(f"__d_{s}") for s in scores]
    )
    return stats.select(
        label,
        *[F.concat(fixed_text(F.col(f"__m_{s}")), F.lit(" ± "), fixed_text(F.col(f"__d_{s}"))).alias(s) for s in scores],
    )


def mean_matrix(df: DataFrame, label: str, scores: Sequence[str], order_by: str) -> DataFrame:
    """Mean of every score per label, highest mean of ``order_by`` first."""
    return df.groupBy(label).agg(*[F.avg(s).alias(s) for s in scores]).orderBy(F.desc(order_by), label)


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def box_statistics(df: DataFrame, label: str, value: str) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers and the number of outliers per label.

    The quartiles come to one row per label and are stored, so joining them back to the rows is a
    broadcast whenever the labels are few.
    """
    quartiles = saved(exact_quantiles(df, [label], value, QUARTILES), "quartiles")
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    marked = join_null_safe(df.select(label, value), quartiles, [label])
    return marked.groupBy(label, "n", *QUARTILES).agg(
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )


def median_of(df: DataFrame, value: str) -> DataFrame:
    return exact_quantiles(df, [], value, {"median": 0.5})


def histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """Rows per equal-width bin between the minimum and the maximum; the last bin is closed."""
    bounds = df.agg(F.min(value).alias("low"), F.max(value).alias("high"))
    low, high = bounds.select("low").scalar(), bounds.select("high").scalar()
    share = (F.col(value) - low) / (high - low)
    number = F.when(high == low, F.lit(1)).otherwise(F.least(F.floor(share * bins) + 1, F.lit(bins)))
    return df.filter(F.col(value).isNotNull()).groupBy(number.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("rows"))


def describe(df: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """Count, mean, deviation, minimum, quartiles and maximum, overall or per group."""
    group = list(group)
    keys = group or ["__all"]
    source = df if group else df.withColumn("__all", F.lit(0))
    moments = source.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")
    )
    joined = join_null_safe(moments, exact_quantiles(source, keys, value, QUARTILES), keys)
    return joined.select(*group, F.col("n").alias("count"), "mean", "std", "min", "q1", "median", "q3", "max")


def melt_metrics(df: DataFrame, keys: Sequence[str], names: dict[str, str]) -> DataFrame:
    """Wide to long, with the metric columns given readable names."""
    renamed = df.select(*keys, *[F.col(c).alias(n) for c, n in names.items()])
    return renamed.unpivot(list(keys), list(names.values()), "metric", "value")


def topic_model_summary(df: DataFrame, model: str, topic: str = "topic") -> DataFrame:
    """Per model: valid topics, share of outliers, share of the largest valid topic, messages."""
    sizes = df.groupBy(model, topic).agg(F.count(F.lit(1)).alias("n"))
    valid = F.col(topic) != -1
    return sizes.groupBy(model).agg(
        F.count_if(valid).alias("valid_topics"),
        (F.coalesce(F.sum(F.when(~valid, F.col("n"))), F.lit(0)) * 100.0 / F.sum("n")).alias("percent_outliers"),
        (F.max(F.when(valid, F.col("n"))) * 100.0 / F.sum("n")).alias("percent_largest"),
        F.sum("n").alias("messages"),
    )


def scaled_group_mean(df: DataFrame, label: str, value: str) -> DataFrame:
    """Group means scaled to 0..1 between the smallest and the largest group mean."""
    means = df.groupBy(label).agg(F.avg(value).alias("mean"))
    low, high = means.select(F.min("mean")).scalar(), means.select(F.max("mean")).scalar()
    scaled = F.when(high > low, (F.col("mean") - low) / (high - low)).otherwise(F.lit(0.0))
    return means.withColumn("scaled", scaled)


def rows_and_groups(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).agg(
        F.sum("n").alias("rows"), F.count(group).alias("groups")
    )
