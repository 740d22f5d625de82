"""Joins between the stages: labels, lookups, alignment checks and parameter tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.session import saved


def with_stratum_size(df: DataFrame, stratum: str, out: str = "stratum_size") -> DataFrame:
    """Add the row count of each row's stratum; rows with a null stratum drop out.

    The sizes are stored first: their file size decides between broadcast and shuffle, and in a
    shuffled join adaptive execution can split a hot stratum.
    """
    sizes = df.filter(F.col(stratum).isNotNull()).groupBy(stratum).agg(F.count(F.lit(1)).alias(out))
    return df.join(saved(sizes, "stratum-sizes"), stratum)


def keep_keys(df: DataFrame, keys_table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs in ``keys_table``."""
    return df.join(keys_table.select(*keys), list(keys), "left_semi")


def drop_keys(df: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key does not occur in ``done``."""
    return df.join(done.select(*keys), list(keys), "left_anti")


def join_labels(text: DataFrame, labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join of texts and labels; repeated keys multiply."""
    return text.join(labels, list(keys), "inner")


def join_on_shared(left: DataFrame, right: DataFrame, candidates: Sequence[str], how: str = "left") -> DataFrame:
    """Join on those of the candidate columns that both frames have, compared as merge keys; the left columns stay as they are."""
    from parlance.operators.filters import merge_key

    shared = [c for c in candidates if c in left.columns and c in right.columns]
    if not shared:
        raise ValueError(f"no shared column among {list(candidates)}")

    def key(df: DataFrame, column: str) -> Column:
        value = F.col(column)
        if df.schema[column].dataType.typeName() in ("double", "float"):  # written out without an exponent
            whole = (value == F.floor(value)) & (F.abs(value) < 1e18)
            value = F.when(whole, value.cast("decimal(19,0)").cast("string")).otherwise(value.cast("string"))
        return merge_key(value)

    keys = {c: f"__key_{c}" for c in shared}
    keyed = right.withColumns({k: key(right, c) for c, k in keys.items()}).drop(*shared)
    return left.withColumns({k: key(left, c) for c, k in keys.items()}).join(keyed, list(keys.values()), how).drop(*keys.values())


def outer_counts(total: DataFrame, kept: DataFrame, period: str) -> DataFrame:
    """Full outer join of two count tables on the period with missing counts as 0."""
    return total.join(kept, period, "full_outer").fillna(0)


def map_macro_topics(posts: DataFrame, topic_macro: DataFrame, macro_political: DataFrame) -> DataFrame:
    """Topic to macro topic to political category; -1 stays an outlier at both levels.

    Both lookups are stored first, so their size decides the join and a crowded topic stays spread.
    """
    mapped = posts.join(saved(topic_macro, "macro-topics"), "topic", "left").withColumn(
        "macro_topic", F.when(F.col("topic") == -1, "OUTLIERS").otherwise(F.col("macro_topic"))
    )
    flagged = mapped.join(saved(macro_political, "macro-flags"), "macro_topic", "left")
    category = (
        F.when(F.col("macro_topic") == "OUTLIERS", "Outliers")
        .when(F.col("is_political"), "Politic")
        .when(~F.col("is_political"), "Non Politic")
    )
    return flagged.withColumn("political_category", category).drop("is_political")


def lookup_by_text(df: DataFrame, unique: DataFrame, text: str, value: str) -> DataFrame:
    """Give every row the value its text has in ``unique`` (one row per text).

    The join is on a 64-bit hash and the text. ``unique`` is stored first so that a much repeated
    text can be split across tasks.
    """
    keyed = saved(unique.select(F.xxhash64(text).alias("__h"), text, value), "texts")
    return df.withColumn("__h", F.xxhash64(text)).join(keyed, ["__h", text], "left").drop("__h")


def count_differences(
    left: DataFrame, right: DataFrame, keys: Sequence[str], null_safe: bool = False
) -> DataFrame:
    """Rows in both frames by key, and per shared column how many of them differ.

    Two nulls count as different unless ``null_safe``.
    """
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    renamed = right.withColumnsRenamed({c: f"__r_{c}" for c in shared})
    joined = left.join(renamed, list(keys))

    def differs(column: str) -> Column:
        a, b = F.col(column), F.col(f"__r_{column}")
        return ~a.eqNullSafe(b) if null_safe else ~F.coalesce(a == b, F.lit(False))

    counts = joined.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(differs(c)).alias(c) for c in shared]
    )
    return counts.unpivot(["rows"], shared, "column", "differences")


def key_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many keys are only left, only right, and in both."""
    a = left.select(*keys, F.lit(True).alias("__l"))
    b = right.select(*keys, F.lit(True).alias("__r"))
    side = F.when(F.col("__r").isNull(), "only_left").when(F.col("__l").isNull(), "only_right").otherwise("both")
    return a.join(b, list(keys), "full_outer").groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("rows"))


def parameter_grid(lists: DataFrame) -> DataFrame:
    """Every combination of the array columns of a one-row frame, numbered from 1.

    The arrays are exploded one after the other, so no join is involved.
    """
    grid = lists
    for name in lists.columns:
        grid = grid.withColumn(name, F.explode(name))
    return grid


def spread_grid(values: DataFrame, lists: DataFrame, max_values: int = 10_000) -> DataFrame:
    """Every row of ``values`` with every combination of the array columns of the one-row frame ``lists``.

    The rows stay where they are; only the lists, of at most ``max_values`` elements together, travel to them.
    """
    short = saved(lists, "grid-lists")
    n = short.select(F.expr(" + ".join(f"size(`{c}`)" for c in lists.columns))).first()[0]
    if n > max_values:
        raise ValueError(f"more than {max_values} values to combine with every row")
    grid = values.join(F.broadcast(short))
    for name in lists.columns:
        grid = grid.withColumn(name, F.explode(name))
    return grid


def model_pairs(scores: DataFrame, model: str = "model", keys: Sequence[str] = ("fold",)) -> DataFrame:
    """Pair the scores of every two models per fold, each pair once in name order.

    There is one row per model and fold, so the result is as small as the model registry.
    """
    metrics = [c for c in scores.columns if c not in (model, *keys)]
    left = scores.select(*keys, F.col(model).alias("model_a"), *[F.col(m).alias(f"{m}_a") for m in metrics])
    right = scores.select(*keys, F.col(model).alias("model_b"), *[F.col(m).alias(f"{m}_b") for m in metrics])
    return left.join(right, list(keys)).filter(F.col("model_a") < F.col("model_b"))


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """Concatenate frames by column name; columns a frame lacks are null."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result
