"""Training, searching and applying classifiers with Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import HashingTF, IDF, Tokenizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.operators import evaluation
from parlance.session import saved
from parlance.sources import sinks

FEATURES, LABEL, PREDICTION, WEIGHT = "features", "label", "prediction", "weight"
#: Spark's own limit.
MAX_TREE_DEPTH = 30


def _depth(max_depth: int) -> int:
    if max_depth > MAX_TREE_DEPTH:
        raise ValueError(f"Spark trees are at most {MAX_TREE_DEPTH} deep, not {max_depth}")
    return max_depth


def logistic_regression(rows: int, C: float = 1.0, max_iter: int = 1000, balanced: bool = False) -> Estimator:
    """Multinomial logistic regression with an L2 penalty of strength ``1 / C`` over the summed loss.

    Spark averages the loss over the rows, hence ``regParam = 1 / (C * rows)``. Features keep
    their scale.
    """
    model = LogisticRegression(
        featuresCol=FEATURES, labelCol=LABEL, predictionCol=PREDICTION, family="multinomial", maxIter=max_iter,
        regParam=1.0 / (C * max(rows, 1)), elasticNetParam=0.0, standardization=False,
    )
    return model.setWeightCol(WEIGHT) if balanced else model


def decision_tree(
    rows: int, criterion: str = "gini", max_depth: int = 10, min_instances_per_node: int = 10, balanced: bool = False
) -> Estimator:
    """A decision tree that splits a node only where each child keeps ``min_instances_per_node`` rows."""
    model = DecisionTreeClassifier(
        featuresCol=FEATURES, labelCol=LABEL, predictionCol=PREDICTION, impurity=criterion,
        maxDepth=_depth(max_depth), minInstancesPerNode=min_instances_per_node, seed=42,
    )
    return model.setWeightCol(WEIGHT) if balanced else model


def random_forest(rows: int, trees: int = 100, max_depth: int = 10, balanced: bool = False) -> Estimator:
    model = RandomForestClassifier(
        featuresCol=FEATURES, labelCol=LABEL, predictionCol=PREDICTION, numTrees=trees,
        maxDepth=_depth(max_depth), seed=42,
    )
    return model.setWeightCol(WEIGHT) if balanced else model


REGISTRY: dict[str, Callable[..., Estimator]] = {"dt": decision_tree, "lr": logistic_regression, "rf": random_forest}


def get_classifier(name: str) -> Callable[..., Estimator]:
    if name not in REGISTRY:
        raise ValueError(f"unknown classifier '{name}', choose one of {sorted(REGISTRY)}")
    return REGISTRY[name]


def with_vector(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    """The array column as an ML vector in ``features``."""
    return df.withColumn(FEATURES, array_to_vector(F.col(embedding)))


def text_features(text: str, dimensions: int = 1 << 16) -> list[Transformer | Estimator]:
    """Stages that turn a text column into TF-IDF ``features``."""
    return [
        Tokenizer(inputCol=text, outputCol="__words"),
        HashingTF(inputCol="__words", outputCol="__tf", numFeatures=dimensions),
        IDF(inputCol="__tf", outputCol=FEATURES),
    ]


def expand_grid(grid: dict[str, Sequence]) -> list[dict]:
    """All combinations of the listed settings; an empty grid gives one of defaults."""
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def _fit(rows: DataFrame, name: str, setting: dict) -> Transformer:
    """Fit one setting; the penalty and the class weights come from exactly the rows it is fitted on."""
    weighted = evaluation.add_class_weights(rows, LABEL, WEIGHT) if setting.get("balanced") else rows
    return get_classifier(name)(rows.count(), **setting).fit(weighted)


def search(
    df: DataFrame, name: str, grid: dict[str, Sequence], keys: Sequence[str], folds: int = 3, fold_col: str | None = None,
    parallelism: int = 4,
):
    """Best settings by cross-validated accuracy: ``(fitted best model, settings, accuracy)``.

    Folds are stratified by label in the order of a hash of ``keys``, or those of ``fold_col``; either way they do not
    depend on partitioning. ``parallelism`` fits run at a time, over rows stored in the shared folder. Of equally good
    settings the first is taken, and only the best is fitted again on all rows.
    """
    settings = expand_grid(grid)
    folded = df if fold_col else evaluation.stratified_folds(df, LABEL, folds, keys)
    rows, column = saved(folded, "search-rows"), fold_col or "fold"
    evaluator = MulticlassClassificationEvaluator(labelCol=LABEL, predictionCol=PREDICTION, metricName="accuracy")

    def accuracy(task: tuple[int, int]) -> float:
        setting, fold = settings[task[0]], task[1]
        model = _fit(rows.filter(F.col(column) != fold), name, setting)
        return evaluator.evaluate(model.transform(rows.filter(F.col(column) == fold)))

    tasks = list(product(range(len(settings)), range(folds)))
    with ThreadPool(parallelism) as pool:
        found = pool.map(accuracy, tasks)
    means = [sum(found[i * folds : (i + 1) * folds]) / folds for i in range(len(settings))]
    best = max(range(len(settings)), key=lambda i: means[i])
    return _fit(rows, name, settings[best]), settings[best], means[best]


def nested_cross_validation(
    df: DataFrame, name: str, grid: dict[str, Sequence], keys: Sequence[str], outer: int = 5, inner: int = 3
) -> DataFrame:
    """Per outer fold: search on the other folds, score on this one. One row per fold."""
    folded = saved(evaluation.stratified_folds(df, LABEL, outer, keys), "folds")
    results = None
    for fold in range(outer):
        train, test = folded.filter(F.col("fold") != fold).drop("fold"), folded.filter(F.col("fold") == fold)
        model, setting, _ = search(train, name, grid, keys, inner)
        measured = evaluation.quality(model.transform(test), LABEL, PREDICTION).select(
            F.lit(name).alias("model"), F.lit(fold + 1).alias("fold"), F.lit(str(setting)).alias("best_params"),
            "accuracy", "f1_macro", "f1_weighted",
        )
        results = measured if results is None else results.unionByName(measured)
    return results


def summarise_folds(folds: DataFrame) -> DataFrame:
    """Mean and population deviation of the accuracy per model."""
    return folds.groupBy("model").agg(F.avg("accuracy").alias("mean"), F.stddev_pop("accuracy").alias("deviation"))


def fit_final(
    df: DataFrame, name: str, grid: dict[str, Sequence], path: str, keys: Sequence[str], folds: int = 5
) -> PipelineModel:
    """Search on all rows, save the refitted best model and return it."""
    model, _, _ = search(df, name, grid, keys, folds)
    fitted = PipelineModel([model])
    fitted.write().overwrite().save(path)
    return fitted


def predict(df: DataFrame, model: Transformer, labels: Sequence[str] | None, out: str) -> DataFrame:
    """All columns of ``df`` and the predicted label; nothing leaves the JVM."""
    scored = model.transform(df)
    if labels is None:
        value = F.col(PREDICTION).cast("int")
    else:
        value = F.array(*[F.lit(l) for l in labels])[F.col(PREDICTION).cast("int")]
    return scored.withColumn(out, value).select(*df.columns, out)


def predict_by_period(df: DataFrame, model: Transformer, labels: Sequence[str] | None, out: str, path: str) -> None:
    """Predict the periods the sink lacks and write them by year and month."""
    sinks.resume_by_period(df, path, lambda rows: predict(rows, model, labels, out))


def cascade(
    df: DataFrame, first: Transformer, second: Transformer, first_labels: Sequence[str], gate: str,
    second_labels: Sequence[str], outs: tuple[str, str],
) -> DataFrame:
    """Level one for every row, level two only for the rows level one puts into ``gate``."""
    level_one = saved(predict(df, first, first_labels, outs[0]), "level-one")  # scored once, read twice
    inside = predict(level_one.filter(F.col(outs[0]) == gate), second, second_labels, outs[1])
    outside = level_one.filter(F.col(outs[0]) != gate).withColumn(outs[1], F.lit(None).cast("string"))
    return inside.unionByName(outside)


def score_batches(
    df: DataFrame, factory: Callable[[], Callable], outputs: Sequence[T.StructField], batch_size: int = 256
) -> DataFrame:
    """Extension point for an external model: ``factory()`` is called once per task and its result maps a
    pandas frame of at most ``batch_size`` rows to the output columns."""
    schema = T.StructType([*df.schema.fields, *outputs])
    names = [f.name for f in outputs]

    def run(frames: Iterator) -> Iterator:
        model = factory()
        for frame in frames:
            for start in range(0, len(frame), batch_size):
                batch = frame.iloc[start : start + batch_size].reset_index(drop=True)
                scores = model(batch)
                yield batch.assign(**{n: scores[n] for n in names})

    return df.mapInPandas(run, schema)


def fit_pipeline(df: DataFrame, stages: Sequence, path: str | None = None) -> PipelineModel:
    fitted = Pipeline(stages=list(stages)).fit(df)
    if path:
        fitted.write().overwrite().save(path)
    return fitted
