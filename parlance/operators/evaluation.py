"""Folds, class weights, quality measures and model comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.numbers import fixed_text, safe_ratio, student_t_two_sided
from parlance.operators.joins import model_pairs
from parlance.operators.ranking import cumulative, hash_order, hash_row_number
from parlance.session import saved


def encode_labels(df: DataFrame, label: str, out: str = "label_index") -> DataFrame:
    """Number the labels alphabetically from 0. The distinct labels are numbered slice by slice, however many there are."""
    distinct = df.filter(F.col(label).isNotNull()).select(label).distinct().withColumn("one", F.lit(1))
    codes = cumulative(distinct, [], label, ["one"]).select(label, (F.col("cum_one") - 1).cast("int").alias(out))
    return df.join(saved(codes, "labels"), label, "left")


def stratified_folds(df: DataFrame, label: str, k: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Fold number 0..k-1, each label dealt out evenly in hash order."""
    hashed = df.withColumn("__hash", hash_order(seed, *keys))
    numbered = hash_row_number(hashed, [label], "__hash", keys, "__rn")
    return numbered.withColumn("fold", ((F.col("__rn") - 1) % k).cast("int")).drop("__hash", "__rn")


def plain_folds(df: DataFrame, k: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Fold number 0..k-1 over all rows in hash order."""
    hashed = df.withColumns({"__hash": hash_order(seed, *keys), "__all": F.lit(0)})
    numbered = hash_row_number(hashed, ["__all"], "__hash", keys, "__rn")
    return numbered.withColumn("fold", ((F.col("__rn") - 1) % k).cast("int")).drop("__hash", "__rn", "__all")


def hold_out(df: DataFrame, test_share: float, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Mark an exact share of the rows, in hash order, as ``is_test``."""
    hashed = df.withColumns({"__hash": hash_order(seed, *keys), "__all": F.lit(0)})
    numbered = hash_row_number(hashed, ["__all"], "__hash", keys, "__rn")
    limit = F.floor(df.select(F.count(F.lit(1))).scalar() * F.lit(float(test_share)) + 0.5)
    return numbered.withColumn("is_test", F.col("__rn") <= limit).drop("__hash", "__rn", "__all")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight per class: rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total, classes = counts.select(F.sum("n")).scalar(), counts.select(F.count(F.lit(1))).scalar()
    return counts.withColumn("weight", total / (classes * F.col("n")))


def add_class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    weights = class_weights(df, label).select(label, F.col("weight").alias(out))
    return df.join(saved(weights, "class-weights"), label)


def confusion_counts(df: DataFrame, true: str, predicted: str) -> DataFrame:
    return df.groupBy(true, predicted).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """Every (true, predicted) cell over the classes in use, zero cells included.

    The spine is exploded from the set of classes, which is as small as the label set.
    """
    counts = confusion_counts(df, true, predicted)
    classes = counts.select(F.col(true).alias("c")).union(counts.select(predicted))
    spine = classes.agg(F.collect_set("c").alias("c"))
    cells = spine.select("c", F.explode("c").alias(true)).select(true, F.explode("c").alias(predicted))
    return cells.join(counts, [true, predicted], "left").fillna(0, ["n"])


def class_report(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support of every true or predicted class; undefined values are 0."""
    counts = confusion_counts(df, true, predicted)
    hit = F.when(F.col(true) == F.col(predicted), F.col("n")).otherwise(F.lit(0))
    sides = F.array(
        F.struct(F.col(true).alias("class"), hit.alias("tp"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called")),
        F.struct(F.col(predicted).alias("class"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called")),
    )
    per_class = counts.select(F.inline(sides)).groupBy("class").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("called").alias("called")
    )
    return per_class.select(
        "class",
        safe_ratio(F.col("tp"), F.col("called")).alias("precision"),
        safe_ratio(F.col("tp"), F.col("support")).alias("recall"),
        safe_ratio(2 * F.col("tp"), F.col("called") + F.col("support")).alias("f1"),
        "support",
        "tp",
    )


def quality(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """Accuracy, macro F1 and support-weighted F1."""
    return class_report(df, true, predicted).agg(
        safe_ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("f1_macro"),
        safe_ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1_weighted"),
    )


def full_report(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """The class report followed by its macro and weighted averages."""
    report = class_report(df, true, predicted)
    measures = ["precision", "recall", "f1"]
    total = F.sum("support")
    macro = report.agg(*[F.avg(m).alias(m) for m in measures], total.alias("support"))
    weighted = report.agg(
        *[safe_ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m) for m in measures], total.alias("support")
    )
    columns = ["class", *measures, "support"]
    return (
        report.withColumn("class", F.col("class").cast("string")).select(columns)
        .unionByName(macro.select(F.lit("macro avg").alias("class"), *columns[1:]))
        .unionByName(weighted.select(F.lit("weighted avg").alias("class"), *columns[1:]))
    )


def pending_runs(wanted: DataFrame, log: DataFrame, keys: Sequence[str] = ("embedding", "model")) -> DataFrame:
    """The (embedding, model) runs that are not in the experiment log yet."""
    return wanted.join(log.select(*keys).distinct(), list(keys), "left_anti")


def fold_metrics(log: DataFrame, model: str, embedding: str | None = None) -> DataFrame:
    """The metrics of one model ordered by fold; a missing F1 reads as 0."""
    rows = log.filter(F.col("model") == model)
    rows = rows if embedding is None else rows.filter(F.col("embedding") == embedding)
    return rows.select("model", "fold", "accuracy", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("f1_macro", "f1_weighted")]).orderBy("fold")


def _pairs_of_models(per_model: DataFrame) -> DataFrame:
    """Every two models once. The list of models is as small as the registry, so it travels as one array."""
    listed = per_model.agg(F.array_sort(F.collect_list(F.struct("model", "n", "mean"))).alias("m"))
    pairs = listed.select("m", F.explode("m").alias("a")).select("a", F.explode("m").alias("b"))
    return pairs.filter(F.col("a.model") < F.col("b.model")).select(
        *[F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in ("a", "b") for c in ("model", "n", "mean")]
    )


def paired_tests(scores: DataFrame, metric: str, folds: int, alpha: float = 0.05) -> DataFrame:
    """Two-sided paired t-test of every two models over their folds, Bonferroni corrected.

    ``scores`` has ``model``, ``fold`` and the metric; it has one row per model and fold. Pairs of
    models whose folds do not match carry an error instead of a test.
    """
    per_model = scores.groupBy("model").agg(F.count(metric).alias("n"), F.avg(metric).alias("mean"))
    pairs = _pairs_of_models(per_model)
    difference = F.col(f"{metric}_a") - F.col(f"{metric}_b")
    matched = model_pairs(scores.select("model", "fold", metric)).groupBy("model_a", "model_b").agg(
        F.count(difference).alias("matched"), F.avg(difference).alias("mean_difference"), F.stddev_samp(difference).alias("sd")
    )
    statistic = F.when(F.col("sd") > 0, F.col("mean_difference") / (F.col("sd") / F.lit(float(folds) ** 0.5)))
    p = F.when(F.col("sd") > 0, student_t_two_sided(statistic, folds - 1)).when(F.col("mean_difference") != 0, F.lit(0.0))
    comparisons = pairs.select(F.count(F.lit(1))).scalar()
    usable = (F.col("n_a") == folds) & (F.col("n_b") == folds) & (F.col("matched") == folds)
    tested = pairs.join(matched, ["model_a", "model_b"], "left").withColumn("usable", F.coalesce(usable, F.lit(False)))
    return tested.select(
        "model_a", "model_b", F.col("mean_a"), F.col("mean_b"),
        F.when(F.col("usable"), F.col("mean_difference")).alias("mean_difference"),
        F.when(F.col("usable"), statistic).alias("t"),
        F.when(F.col("usable"), p).alias("p_value"),
        (F.lit(alpha) / comparisons).alias("alpha"),
        F.when(F.col("usable"), F.coalesce(p < F.lit(alpha) / comparisons, F.lit(False))).alias("significant"),
        F.when(~F.col("usable"), F.lit("unequal number of folds")).alias("error"),
    )


def model_table(scores: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Per model ``mean (population deviation)`` of each metric in percent."""
    stats = scores.groupBy("model").agg(
        *[F.avg(m).alias(f"__m_{m}") for m in metrics], *[F.stddev_pop(m).alias(f"__d_{m}") for m in metrics]
    )
    return stats.select(
        "model",
        *[F.concat(fixed_text(F.col(f"__m_{m}") * 100), F.lit(" ("), fixed_text(F.col(f"__d_{m}") * 100), F.lit(")")).alias(m) for m in metrics],
    )
