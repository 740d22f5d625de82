"""Fitted models over the given tables. Results depend on numeric solvers, so there is no SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions.numbers import rounded
from parlance.operators import classify, evaluation, filters, reports
from parlance.plans.inputs import DATED, MESSAGES, messages, table, with_ctes
from parlance.plans.registry import query
from parlance.session import saved, scratch_path


def vectors(spark, sf):
    """Labelled vectors: id, array column as ML features, numeric label."""
    rows = classify.with_vector(table(spark, sf, "embeddings"))
    return rows.select(F.col("vec_id").alias("id"), "features", F.col("label").cast("double").alias("label"))


def labelled_texts(spark, sf):
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").cast("double").alias("label"))
    return messages(spark, sf).join(labels, "id").withColumn("text", F.coalesce("text", F.lit("")))


def _scored(df, model):
    measured = evaluation.quality(model.transform(df), "label", "prediction")
    return measured.select(*[rounded(F.col(c)).alias(c) for c in measured.columns])


@query("h05_logistic_regression")
def _(spark, sf):
    rows = vectors(spark, sf)
    return _scored(rows, classify.logistic_regression(rows.count(), C=1.0, max_iter=50).fit(rows))


@query("h05_logistic_regression_balanced")
def _(spark, sf):
    rows = evaluation.add_class_weights(vectors(spark, sf), "label")
    return _scored(rows, classify.logistic_regression(rows.count(), C=10.0, max_iter=50, balanced=True).fit(rows))


@query("h06_decision_tree")
def _(spark, sf):
    rows = vectors(spark, sf)
    return _scored(rows, classify.decision_tree(rows.count(), "entropy", 5, 10).fit(rows))


@query("h07_random_forest")
def _(spark, sf):
    rows = vectors(spark, sf)
    return _scored(rows, classify.random_forest(rows.count(), trees=5, max_depth=4).fit(rows))


@query("h10_search")
def _(spark, sf):
    rows = evaluation.stratified_folds(vectors(spark, sf), "label", 3, ["id"])
    model, settings, accuracy = classify.search(rows, "lr", {"C": [0.1, 10.0], "max_iter": [15]}, ["id"], 3, "fold")
    return _scored(rows, model).select(
        F.lit(str(settings)).alias("settings"), F.lit(round(accuracy, 6)).alias("cv_accuracy"), "accuracy"
    )


@query("h11_nested_cross_validation")
def _(spark, sf):
    folds = classify.nested_cross_validation(vectors(spark, sf), "dt", {"max_depth": [3], "criterion": ["gini"]}, ["id"], 3, 2)
    return classify.summarise_folds(folds)


@query("h19_final_model")
def _(spark, sf):
    rows = vectors(spark, sf)
    model = classify.fit_final(rows, "lr", {"C": [1.0], "max_iter": [15]}, scratch_path(spark, "model"), ["id"], 2)
    return _scored(rows, model)


@query(
    "h20_batch_inference",
    with_ctes(MESSAGES, DATED, select="SELECT year, month, count(*) AS n, count(*) AS predicted FROM dated GROUP BY 1, 2"),
)
def _(spark, sf):
    """Train on the labelled texts, predict every message, write by period, then resume."""
    model = classify.fit_pipeline(
        labelled_texts(spark, sf),
        [*classify.text_features("text", 1 << 12), classify.logistic_regression(table(spark, sf, "labels").count(), max_iter=15)],
    )
    path = scratch_path(spark, "predicted")
    corpus = filters.add_period(messages(spark, sf))
    classify.predict_by_period(corpus.filter("month <= 6"), model, ["clean", "toxic"], "predicted", path)
    classify.predict_by_period(corpus, model, ["clean", "toxic"], "predicted", path)
    return spark.read.parquet(path).groupBy("year", "month").agg(
        F.count("*").alias("n"), F.count_if(F.col("predicted").isin("clean", "toxic")).alias("predicted")
    )


@query("h21_cascade")
def _(spark, sf):
    texts = labelled_texts(spark, sf)
    quality = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("q"))
    features = classify.fit_pipeline(texts, classify.text_features("text", 1 << 12))
    featured = saved(features.transform(texts).select("id", "features", "label"), "featured")
    n = featured.count()
    first = classify.logistic_regression(n, max_iter=15).fit(featured)
    second_rows = featured.drop("label").join(quality, "id").withColumnRenamed("q", "label")
    second = classify.decision_tree(n, max_depth=3).fit(second_rows)
    corpus = features.transform(messages(spark, sf).fillna("", ["text"])).select("id", "group_name", "features")
    both = classify.cascade(corpus, first, second, ["clean", "toxic"], "toxic", ["poor", "good"], ("category", "grade"))
    return both.groupBy("category", F.coalesce("grade", F.lit("none")).alias("grade")).agg(F.count("*").alias("n"))


@query(
    "h20_external_model",
    """SELECT count(*) AS "rows", count(DISTINCT source) AS groups FROM documents WHERE length(text) > 0""",
)
def _(spark, sf):
    """The extension point with a stand-in model that counts characters."""
    from pyspark.sql import types as T

    def factory():
        return lambda batch: {"n_chars": batch["text"].fillna("").str.len()}

    rows = classify.score_batches(
        messages(spark, sf).select("id", "group_name", "text"), factory, [T.StructField("n_chars", T.LongType())]
    )
    return reports.rows_and_groups(rows.filter("n_chars > 0"), "group_name")
