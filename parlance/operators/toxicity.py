"""Six-score toxicity scoring."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.functions.batches import by_slices, list_lengths
from parlance.functions.numbers import safe_ratio
from parlance.operators.classify import fit_pipeline, text_features
from parlance.schemas import TOXICITY_SCORES
from parlance.session import saved


def is_blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def fit_scorer(df: DataFrame, text: str, labels: Sequence[str] = TOXICITY_SCORES, dimensions: int = 1 << 16, max_iter: int = 100):
    """One logistic regression per label over shared TF-IDF features: ``(features, {label: model})``."""
    features = fit_pipeline(df, text_features(text, dimensions))
    rows = saved(features.transform(df).select("features", *labels), "scorer-rows")
    models = {
        label: LogisticRegression(
            featuresCol="features", labelCol=label, probabilityCol="__p", predictionCol="__y", rawPredictionCol="__r",
            maxIter=max_iter, regParam=0.01,
        ).fit(rows)
        for label in labels
    }
    return features, models


def score(df: DataFrame, text: str, features: PipelineModel, models: dict) -> DataFrame:
    """Probability of every label per row; a missing or blank text scores 0."""
    columns = df.columns
    kept = df.withColumn("__original", F.col(text)).withColumn(text, F.coalesce(text, F.lit("")))
    scored = features.transform(kept)
    for label, model in models.items():
        scored = model.transform(scored)
        value = F.when(is_blank(F.col("__original")), F.lit(0.0)).otherwise(vector_to_array("__p")[1])
        scored = scored.withColumn(label, value.cast("float")).drop("__p", "__y", "__r")
    return scored.select(*[F.col("__original").alias(text) if c == text else F.col(c) for c in columns], *models)


def lexicon_scores(
    df: DataFrame, keys: Sequence[str], text: str, lexicon: DataFrame, scores: Sequence[str] = TOXICITY_SCORES,
    max_lexicon_bytes: int = 64 << 20,
) -> DataFrame:
    """Sum of the weights of a text's words over its number of words, per score; 0 without words.

    ``lexicon`` has ``token`` (unique) and one weight column per score. A lexicon of at most ``max_lexicon_bytes`` is shipped to
    the tasks and texts are scored where they are read; a larger one is joined to the words, with the same result.
    """
    stored = saved(lexicon.select("token", *[F.col(s).cast("double").alias(s) for s in scores]), "lexicon")
    size = stored.agg(F.sum(F.octet_length("token") + 8 * len(scores))).first()[0] or 0
    if size <= max_lexicon_bytes:
        found = _lexicon_scorer(stored, scores)(tx.terms(F.col(text)))
        return df.select("*", F.inline(F.array(found)))
    words = df.select(*keys, F.explode(tx.terms(F.col(text))).alias("token"))
    sums = words.join(stored, "token", "left").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), *[F.coalesce(F.sum(s), F.lit(0.0)).alias(f"__{s}") for s in scores]
    )
    scored = sums.select(*keys, *[safe_ratio(F.col(f"__{s}"), F.col("__n")).alias(s) for s in scores])
    return df.join(scored, list(keys), "left").fillna(0.0, list(scores))


def _lexicon_scorer(stored: DataFrame, scores: Sequence[str]):
    weights = {r["token"]: tuple(r[s] or 0.0 for s in scores) for r in stored.toLocalIterator()}
    shared = stored.sparkSession.sparkContext.broadcast(weights)

    names = list(scores)

    def scored(lists: pa.Array) -> pa.Array:
        known, lengths = shared.value, list_lengths(lists)
        distinct = lists.flatten().dictionary_encode()
        hits = [known.get(w) for w in distinct.dictionary.to_pylist()]
        table = np.array([h or (0.0,) * len(names) for h in hits]).reshape(-1, len(names))
        code = distinct.indices.to_numpy(zero_copy_only=False)
        hit = np.array([h is not None for h in hits], bool)[code]
        rows, code = np.repeat(np.arange(len(lists)), lengths)[hit], code[hit]
        sums = [np.bincount(rows, table[code, i], len(lists)) / np.maximum(lengths, 1) for i in range(len(names))]
        return pa.StructArray.from_arrays([pa.array(x) for x in sums], names)

    @F.arrow_udf(", ".join(f"{s} double" for s in names))
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield by_slices(column, scored)

    return score
