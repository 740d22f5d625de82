"""Reproducible samples, duplicates and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.numbers import skip_null_mean
from parlance.operators.ranking import first_per_key, hash_order, join_null_safe, top_k
from parlance.session import saved


def _take_by_hash(
    df: DataFrame, group: Sequence[str], quotas: DataFrame | None, quota: Column, keys: Sequence[str], seed: int,
    digits: int,
) -> DataFrame:
    """The first ``quota`` rows per group in hash order, ranking only rows near the cut.

    Rows are counted per group and hash slice; slices wholly past the quota drop out before the
    rows are shuffled, and the remaining ones are ranked slice by slice.
    """
    group = list(group)
    sliced = df.withColumn("__hash", hash_order(seed, *keys)).withColumn("__slice", F.substring("__hash", 1, digits))
    counts = sliced.groupBy(*group, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    counts = counts.join(quotas, group) if quotas is not None else counts
    cut = saved(
        counts.withColumn("__quota", quota)
        .filter(F.col("__before") < F.col("__quota"))
        .select(*group, "__slice", "__before", "__quota"),
        "slices",
    )
    inside = Window.partitionBy(*group, "__slice").orderBy("__hash", *keys)
    near = sliced.join(cut, [*group, "__slice"])
    ranked = near.withColumn("__rank", F.col("__before") + F.row_number().over(inside))
    return ranked.filter(F.col("__rank") <= F.col("__quota")).select(*df.columns)


def stratified_sample(
    df: DataFrame, stratum: str, size: int, keys: Sequence[str], seed: int = 42, digits: int = 3
) -> DataFrame:
    """A proportional sample: each stratum gives its share of ``size``, rounded half up.

    Which rows are taken depends only on the seed and the keys. Strata that round to 0 vanish.
    """
    known = df.filter(F.col(stratum).isNotNull())
    sizes = saved(known.groupBy(stratum).agg(F.count(F.lit(1)).alias("__size")), "strata")
    total = sizes.select(F.sum("__size")).scalar()
    quota = F.floor(F.col("__size").cast("double") / total * F.lit(float(size)) + 0.5)
    return _take_by_hash(known, [stratum], sizes, quota, keys, seed, digits)


def exact_fraction(df: DataFrame, fraction: float, keys: Sequence[str], seed: int = 42, digits: int = 3) -> DataFrame:
    """A sample of exactly ``fraction`` of the rows, rounded half up."""
    quota = F.floor(df.select(F.count(F.lit(1))).scalar() * F.lit(float(fraction)) + 0.5)
    return _take_by_hash(df, [], None, quota, keys, seed, digits)


def approximate_fraction(df: DataFrame, fraction: float, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """The rows whose hash of seed and keys lies below ``fraction``: one pass, no shuffle, not of exact size.

    The same rows whatever the partitioning.
    """
    if fraction >= 1:
        return df
    return df.filter(F.substring(hash_order(seed, *keys), 1, 8) < f"{int(max(fraction, 0.0) * 2**32):08x}")


def random_rows(df: DataFrame, k: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """``k`` rows in hash order; a distributed top-k, since k is small."""
    return df.orderBy(hash_order(seed, *keys), *keys).limit(k)


def drop_duplicate_texts(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """One row per text, the one with the smallest key."""
    hashed = df.withColumn("__sha", F.sha2(F.col(text).cast("binary"), 256))  # sorted by digest, not by text
    return first_per_key(hashed, ["__sha"], keys).drop("__sha")


def drop_duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.dropDuplicates(list(keys))


def extremes(df: DataFrame, label: str, score: str, keys: Sequence[str], k: int = 10) -> DataFrame:
    """The k highest and k lowest rows per label; ties go to the smaller key."""
    high = top_k(df, [label], [F.desc(score), *[F.asc(c) for c in keys]], k).withColumn("side", F.lit("highest"))
    low = top_k(df, [label], [F.asc(score), *[F.asc(c) for c in keys]], k).withColumn("side", F.lit("lowest"))
    return high.unionByName(low)


def nest_extremes(rows: DataFrame, label: str, fields: Sequence[str]) -> DataFrame:
    """One record per label with the two lists (bounded by k each)."""

    def listed(side: str) -> Column:
        row = F.when(F.col("side") == side, F.struct("rank", *fields))
        return F.array_sort(F.collect_list(row)).alias(side)

    return rows.groupBy(label).agg(listed("highest"), listed("lowest"))


def best_per_group(df: DataFrame, group: Sequence[str], score: str, ties: Sequence[str]) -> DataFrame:
    """The row with the highest score per group; ties go to the smaller tie columns."""
    return top_k(df, group, [F.desc_nulls_last(score), *[F.asc(t) for t in ties]], 1).drop("rank")


def top_n(df: DataFrame, score: str, n: int, ties: Sequence[str]) -> DataFrame:
    return df.orderBy(F.desc(score), *ties).limit(n)


def sample_per_group(
    df: DataFrame, group: str, text: str, k: int, exclude: DataFrame | None = None, seed: int = 42
) -> DataFrame:
    """Up to k distinct texts per group in hash order, without the excluded (group, text) pairs."""
    distinct = df.filter(F.col(text).isNotNull() & F.col(group).isNotNull()).select(group, text).distinct()
    if exclude is not None:
        distinct = distinct.join(exclude.select(group, text).distinct(), [group, text], "left_anti")
    return top_k(distinct, [group], [hash_order(seed, text), F.col(text)], k)


GRID_METRICS = ["silhouette", "diversity", "coherence_cv"]


def add_normalised_scores(
    df: DataFrame, metrics: Sequence[str] = GRID_METRICS, group: Sequence[str] = (), suffix: str = ""
) -> DataFrame:
    """Min-max scaled metrics and their means ``score_sdc`` and ``score_sc``.

    Scaled over all rows, or per group; a constant metric scales to 0.
    """
    group = list(group)
    keys = group or ["__all"]
    source = df if group else df.withColumn("__all", F.lit(0))
    bounds = source.groupBy(*keys).agg(
        *[F.min(m).alias(f"__lo_{m}") for m in metrics], *[F.max(m).alias(f"__hi_{m}") for m in metrics]
    )
    joined = join_null_safe(source, saved(bounds, "bounds"), keys)

    def scaled(metric: str) -> Column:
        low, high = F.col(f"__lo_{metric}"), F.col(f"__hi_{metric}")
        return F.when(high > low, (F.col(metric) - low) / (high - low)).otherwise(F.lit(0.0))

    normed = joined.withColumns({f"{m}_norm{suffix}": scaled(m) for m in metrics})
    columns = [F.col(f"{m}_norm{suffix}") for m in metrics]
    scored = normed.withColumns(
        {
            f"score_sdc{suffix}": skip_null_mean(*columns),
            f"score_sc{suffix}": skip_null_mean(columns[0], columns[-1]),
        }
    )
    return scored.drop(*([] if group else ["__all"]), *[f"__{s}_{m}" for s in ("lo", "hi") for m in metrics])


def best_configurations(df: DataFrame, metrics: dict[str, str], n: int, ties: Sequence[str]) -> DataFrame:
    """The n best rows of every metric, keyed ``best_<metric>_rank<k>``."""
    named = df.select(*ties, *[F.col(c).alias(m) for m, c in metrics.items()])
    long = named.unpivot(list(ties), list(metrics), "metric", "value").filter(F.col("value").isNotNull())
    ranked = top_k(long, ["metric"], [F.desc("value"), *[F.asc(t) for t in ties]], n)
    name = F.concat(F.lit("best_"), F.col("metric"), F.lit("_rank"), F.col("rank").cast("string"))
    return ranked.withColumn("config", name)


def best_config(
    df: DataFrame, metrics: Sequence[str], ties: Sequence[str], integers: Sequence[str], scale_by: int = 10
) -> DataFrame:
    """One configuration per metric: its best row, whole-number parameters restored from text, and
    ``min_cluster_size`` scaled up for the full corpus."""
    best = best_configurations(df, {m: m for m in metrics}, 1, ties)
    restored = best.withColumns({c: F.col(c).cast("double").cast("int") for c in integers})
    return restored.withColumn("min_cluster_size", F.col("min_cluster_size") * scale_by).drop("rank", "config")
