"""Order-dependent operators that never put a whole group into one task.

A plain ``row_number() over (partition by key order by x)`` sends each group to one task. When one
group holds a third of a huge table that task never ends, so the operators here cut each group
into order-preserving slices, count the slices, and add the count of all earlier slices to the
position inside the slice. The result is exact. Slice counts and group totals are stored before they
are joined back: their size is then known, and the join need not shuffle the rows by a hot group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.session import saved


def hash_order(seed: int | str, *keys: str | Column) -> Column:
    """A reproducible shuffle key: the hex MD5 of the seed and the key columns."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("_", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], suffix: str) -> Column:
    """Null-safe equality of ``keys`` with ``keys + suffix`` on the right."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key + suffix])
    return condition


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` with nulls equal to nulls, keeping the left key columns."""
    if not keys:
        raise ValueError("a join needs at least one key")
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(renamed[f"__r_{key}"])
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"__r_{k}" for k in keys])


def hash_row_number(
    df: DataFrame, group: Sequence[str], order_hash: str, tie: Sequence[str], out: str = "rn", digits: int = 3
) -> DataFrame:
    """Exact ``row_number`` by a hex hash column within ``group``, slice by slice.

    The first ``digits`` hex digits name the slice, so a group is spread evenly over
    ``16 ** digits`` tasks whatever its size.
    """
    group = list(group)
    sliced = df.withColumn("__slice", F.substring(order_hash, 1, digits))
    counts = sliced.groupBy(*group, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*group, "__slice").orderBy(order_hash, *tie)
    return (
        join_null_safe(sliced, saved(offsets, "offsets"), [*group, "__slice"])
        .withColumn(out, (F.col("__before") + F.row_number().over(inside)).cast("long"))
        .drop("__slice", "__before")
    )


def cumulative(
    df: DataFrame, group: Sequence[str], order: str, values: Sequence[str], prefix: str = "cum_"
) -> DataFrame:
    """Inclusive running sums of ``values`` by ascending ``order`` within ``group``.

    ``(group, order)`` must be unique (aggregate first). The rows are range-partitioned by Spark,
    and stored with their partition number as slice, so every later step sees the same slices.
    """
    group = list(group)
    ranged = df.repartitionByRange(*group, order).withColumn("__slice", F.spark_partition_id())
    sliced = saved(ranged, "slices")
    partial = sliced.groupBy(*group, "__slice").agg(*[F.sum(v).alias(f"__s_{v}") for v in values])
    before = Window.partitionBy(*group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = partial.select(
        *group, "__slice", *[F.coalesce(F.sum(f"__s_{v}").over(before), F.lit(0)).alias(f"__b_{v}") for v in values]
    )
    inside = Window.partitionBy(*group, "__slice").orderBy(order)
    return (
        join_null_safe(sliced, saved(offsets, "offsets"), [*group, "__slice"])
        .withColumns({prefix + v: F.col(f"__b_{v}") + F.sum(v).over(inside) for v in values})
        .drop("__slice", *[f"__b_{v}" for v in values])
    )


def exact_quantiles(
    df: DataFrame, group: Sequence[str], value: str, probabilities: dict[str, float]
) -> DataFrame:
    """Linear-interpolated quantiles per group, one row per group.

    Rows are reduced to (group, value, count) before anything is ordered, and the order statistics
    are picked from running counts, so no task holds a group's values.
    """
    group = list(group)
    keys = group or ["__all"]
    source = df if group else df.withColumn("__all", F.lit(0))
    counts = source.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    counts = saved(counts, "value-counts")
    totals = saved(counts.groupBy(*keys).agg(F.sum("n").alias("__total")), "totals")
    running = join_null_safe(cumulative(counts, keys, value, ["n"]), totals, keys)
    picks, results = [], []
    for name, p in probabilities.items():
        position = (F.col("__total") - 1) * F.lit(float(p))
        picks += [
            F.min(F.when(F.col("cum_n") > F.floor(position), F.col(value))).alias(f"__lo_{name}"),
            F.min(F.when(F.col("cum_n") > F.ceil(position), F.col(value))).alias(f"__hi_{name}"),
        ]
        fraction = position - F.floor(position)
        low, high = F.col(f"__lo_{name}").cast("double"), F.col(f"__hi_{name}").cast("double")
        results.append((low + (high - low) * fraction).alias(name))
    picked = running.groupBy(*keys, "__total").agg(*picks).select(*keys, F.col("__total").alias("__found"), *results)
    # Groups without a value are reported with n = 0 and null quantiles.
    every = source.groupBy(*keys).agg(F.count(value).alias("n"))
    return join_null_safe(every, saved(picked, "quantiles"), keys, "left").select(*group, "n", *probabilities)


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group with their rank.

    Spark applies the limit inside every input partition before the shuffle (window group limit),
    so a hot group reaches its task already reduced to ``k`` rows per partition.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).filter(F.col(out) <= k)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the row with the smallest ``order`` per key, by partial aggregation instead of a sort."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(best).select(*keys, "__row.*").select(*df.columns)
