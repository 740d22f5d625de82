"""Ranking features by how well a threshold on them separates the labels."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.operators.ranking import cumulative, top_k
from parlance.session import broadcast_if_small, saved

MAX_LABELS = 1000


def _impurity(counts: Sequence[Column], total: Column) -> Column:
    squares = sum((c * c for c in counts), F.lit(0.0))
    return F.when(total > 0, 1.0 - squares / (total * total)).otherwise(F.lit(0.0))


def label_counts(df: DataFrame, features: Sequence[str], label: str) -> tuple[DataFrame, list[str]]:
    """Per feature and value, how many rows of each label have it (columns ``c0``, ``c1``, …)."""
    found = df.select(label).filter(F.col(label).isNotNull()).distinct().orderBy(label).take(MAX_LABELS + 1)
    if len(found) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    labels = [r[label] for r in found]
    doubles = df.select(label, *[F.col(c).cast("double").alias(c) for c in features])
    long = doubles.unpivot([label], list(features), "feature", "value").filter(F.col("value").isNotNull())
    columns = [f"c{i}" for i in range(len(labels))]
    counts = long.groupBy("feature", "value").agg(
        *[F.count_if(F.col(label) == l).cast("double").alias(c) for c, l in zip(columns, labels)]
    )
    return counts.withColumn("one", F.lit(1.0)), columns


def gini_ranking(
    df: DataFrame, features: Sequence[str], label: str, n_thresholds: int | None = None
) -> DataFrame:
    """Gini gain of every (feature, threshold), rows at or below the threshold on the left.

    Thresholds are the distinct values or, where there are more than ``n_thresholds`` of them, that
    many percentiles of the distinct values. The rows are counted once per feature, value and
    label; running sums over the values then give the left side of every split.
    """
    counts, columns = label_counts(df, features, label)
    counts = saved(counts, "value-counts")
    running = cumulative(counts, ["feature"], "value", ["one", *columns], prefix="left_")
    totals = counts.groupBy("feature").agg(F.sum("one").alias("m"), *[F.sum(c).alias(f"all_{c}") for c in columns])
    totals = saved(totals, "feature-totals")
    splits = running.select("feature", "value", *[f"left_{c}" for c in ("one", *columns)]).join(totals, "feature")
    if n_thresholds:
        splits = _at_percentiles(saved(splits, "splits"), n_thresholds)
    left = [F.col(f"left_{c}") for c in columns]
    right = [F.col(f"all_{c}") - F.col(f"left_{c}") for c in columns]
    everything = [F.col(f"all_{c}") for c in columns]
    n_left, n_right, n = (sum(part, F.lit(0.0)) for part in (left, right, everything))
    after = n_left / n * _impurity(left, n_left) + n_right / n * _impurity(right, n_right)
    return splits.select(
        F.col("feature").alias("attribute"), F.col("value").alias("split"), (_impurity(everything, n) - after).alias("gini_gain")
    )


def _at_percentiles(splits: DataFrame, n: int) -> DataFrame:
    """Replace the distinct values of rich features by n interpolated percentiles of them."""
    few = splits.filter(F.col("m") <= n)
    rich = splits.filter(F.col("m") > n).withColumn("rank", F.col("left_one") - 1)
    position = lambda j: (F.col("m") - 1) * j / (n - 1)
    chosen = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.floor(position(j)) == F.col("rank"))
    at = rich.withColumn("j", F.explode(chosen))
    following = rich.select("feature", (F.col("rank") - 1).alias("rank"), F.col("value").alias("__next"))
    joined = at.join(following, ["feature", "rank"], "left")
    fraction = position(F.col("j")) - F.col("rank")
    value = F.col("value") + F.coalesce(F.col("__next") - F.col("value"), F.lit(0.0)) * fraction
    return few.unionByName(joined.withColumn("value", value).select(*few.columns))


def best_splits(ranking: DataFrame) -> DataFrame:
    """The best threshold of every feature; ties go to the smaller threshold."""
    ordered = ranking.withColumn("__g", F.floor(F.col("gini_gain") * 1e12 + 0.5))
    return top_k(ordered, ["attribute"], [F.desc("__g"), F.asc("split")], 1).drop("rank", "__g")


def spearman_matrix(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rank correlation of every two features (ties share their average rank), as a long table.

    Nulls are left out pair by pair: a row counts for every pair of which it has both values. Features that are null in
    the same rows form a class, and one pass ranks the features of two classes together.
    """
    features = list(features)
    numeric = saved(
        df.select(F.monotonically_increasing_id().alias("__row"), *[F.col(c).cast("double").alias(c) for c in features]), "features"
    )
    marks = numeric.agg(
        *[
            F.struct(F.count_if(F.col(c).isNull()), F.expr(f"bit_xor(CASE WHEN `{c}` IS NULL THEN xxhash64(__row) ELSE 0 END)")).alias(c)
            for c in features
        ]
    ).first()
    classes: dict[tuple, list[str]] = {}
    for c in features:
        classes.setdefault(tuple(marks[c]), []).append(c)
    rows = []
    for one, other in combinations_with_replacement(list(classes.values()), 2):
        both = one if one is other else [*one, *other]
        ranked = centred_ranks(numeric.select(*both).dropna(), both)
        vectors = VectorAssembler(inputCols=both, outputCol="v").transform(ranked).select("v")
        matrix = Correlation.corr(vectors, "v", "pearson").first()[0].toArray()
        for i, a in enumerate(both):
            for j, b in enumerate(both):
                if (a in one and b in other) or (a in other and b in one):
                    rows.append((a, b, float(matrix[i][j])))
    return df.sparkSession.createDataFrame(rows, "feature_a string, feature_b string, correlation double")


def centred_ranks(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Every value replaced by its rank less the mean rank; ties share their average rank. No nulls.

    Rows are counted per feature and value first. Ranks come from running sums of these counts and go back to the rows by value, in a broadcast
    where a feature has few values, so that no row is ordered.
    """
    counts = df.unpivot([], list(features), "feature", "value").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    counts = saved(counts, "value-counts")
    running = cumulative(counts, ["feature"], "value", ["n"])
    totals = saved(counts.groupBy("feature").agg(F.sum("n").alias("all_n")), "feature-totals")
    ranks = running.join(F.broadcast(totals), "feature").select(
        "feature", "value", (F.col("cum_n") - (F.col("n") - 1) / 2 - (F.col("all_n") + 1) / 2).alias("rank")
    )
    ranks = saved(ranks, "value-ranks")
    for c in features:
        of_one = ranks.filter(F.col("feature") == c).select(F.col("value").alias("__value"), F.col("rank").alias("__rank"))
        df = df.join(broadcast_if_small(of_one), F.col(f"`{c}`") == F.col("__value")).drop("__value").withColumn(c, F.col("__rank")).drop("__rank")
    return df


def select_top(df: DataFrame, features: Sequence[str], ranking: DataFrame, n: int = 10, limit: float = 0.7) -> DataFrame:
    """The n best features, skipping those whose absolute rank correlation with a chosen one exceeds ``limit``.

    Only the feature names, a few hundred, are walked on the driver.
    """
    best = best_splits(ranking).orderBy(F.desc("gini_gain"), "attribute").take(len(features))
    correlated: dict[str, set[str]] = {}
    for row in spearman_matrix(df, features).filter(F.abs("correlation") > limit).take(len(features) ** 2):
        correlated.setdefault(row["feature_a"], set()).add(row["feature_b"])
    chosen, removed = [], set()
    for row in best:
        if row["attribute"] in removed:
            continue
        chosen.append((len(chosen) + 1, row["attribute"], row["split"], row["gini_gain"]))
        removed |= correlated.get(row["attribute"], set()) - {row["attribute"]}
        if len(chosen) == n:
            break
    return df.sparkSession.createDataFrame(chosen, "position int, attribute string, split double, gini_gain double")
