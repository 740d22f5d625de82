"""Language identification with character trigrams, learned and applied as Spark jobs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.numbers import safe_ratio
from parlance.operators.ranking import hash_order, top_k
from parlance.session import saved

UNKNOWN = "unknown"


def trigram_text(text: Column) -> Column:
    """The lower-cased text with white space as one blank."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def trigrams(text: Column) -> Column:
    """Overlapping character trigrams of the lower-cased text with white space as one blank."""
    return F.regexp_extract_all(trigram_text(text), F.lit("(?s)(?=(.{3}))"), F.lit(1))


def fit_profiles(df: DataFrame, text: str, language: str) -> DataFrame:
    """Naive Bayes trigram profiles from labelled rows, one row per trigram.

    ``weights`` holds, in alphabetical order of ``languages``, the gain of the trigram's smoothed
    log probability over that of an unseen trigram; ``unseen`` is the latter. Counting combines on
    the map side, so a trigram that makes up much of the corpus costs one row per task.
    """
    counts = (
        df.filter(F.col(language).isNotNull())
        .select(F.col(language).alias("language"), F.explode(trigrams(F.col(text))).alias("gram"))
        .groupBy("language", "gram")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    counts = saved(counts, "trigrams")
    totals = counts.groupBy("language").agg(F.sum("n").alias("total")).orderBy("language").collect()
    vocabulary = counts.select("gram").distinct().count()
    names = [r["language"] for r in totals]
    sizes = {r["language"]: r["total"] + vocabulary for r in totals}
    seen = [F.coalesce(F.sum(F.when(F.col("language") == l, F.col("n"))), F.lit(0)) for l in names]
    return counts.groupBy("gram").agg(
        F.array(*[F.log(s.cast("double") + 1.0) for s in seen]).alias("weights")
    ).withColumns(
        {
            "languages": F.array(*[F.lit(l) for l in names]),
            "unseen": F.array(*[-F.log(F.lit(float(sizes[l]))) for l in names]),
        }
    )


def detect_language(
    df: DataFrame, profiles: DataFrame, text: str, keys: Sequence[str], out: str = "language",
    max_profile_bytes: int = 128 << 20,
) -> DataFrame:
    """The most likely language per row with its mean log likelihood per trigram.

    Ties go to the alphabetically first language; a text without trigrams is ``unknown``. Profiles of at most
    ``max_profile_bytes`` are shipped to the tasks and every text is scored where it is read: no shuffle and no join. Larger
    ones are joined to the trigrams, with the same result.
    """
    stored = saved(profiles, "profiles")
    head = stored.select("languages", "unseen").first()
    names, unseen = (head["languages"], head["unseen"]) if head else ([], [])
    if names and stored.count() * 8 * (len(names) + 1) > max_profile_bytes:
        return _detect_by_join(df, stored, names, unseen, text, keys, out)
    found = _scorer(stored, names, unseen)(trigram_text(F.col(text)))
    # Arrow batches are made once per row; the one-row generator keeps later filters from calling the scorer again.
    scored = df.select("*", F.inline(F.array(found)))
    return scored.select(*df.columns, F.coalesce("language__", F.lit(UNKNOWN)).alias(out), F.col("score__").alias("log_likelihood"))


def _scorer(stored: DataFrame, names: Sequence[str], unseen: Sequence[float]):
    """A function of the prepared text: binary search of its trigram codes among those of the profiles."""
    table = stored.select("gram", "weights").toArrow()
    codes = _codes("".join(table["gram"].to_pylist()))[::3]
    order = np.argsort(codes)
    weights = np.array(table["weights"].to_pylist(), float).reshape(len(codes), len(names))[order]
    shared = stored.sparkSession.sparkContext.broadcast((codes[order], np.vstack([weights, np.zeros((1, len(names)))])))

    @F.pandas_udf("struct<language__: string, score__: double>")
    def score(texts: pd.Series) -> pd.DataFrame:
        known, gains = shared.value
        languages, scores = [], []
        for plain in texts:
            grams = _codes(plain)
            if not len(grams) or not len(known):
                languages.append(None)
                scores.append(None)
                continue
            distinct, n = np.unique(grams, return_counts=True)
            place = np.minimum(np.searchsorted(known, distinct), len(known) - 1)
            place[known[place] != distinct] = len(known)
            mean = n @ gains[place] / len(grams) + np.array(unseen)
            languages.append(names[int(mean.argmax())])
            scores.append(float(mean.max()))
        return pd.DataFrame({"language__": languages, "score__": scores})

    return score


def _codes(text: str) -> np.ndarray:
    """Every three neighbouring characters as one number."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    return c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:] if len(c) > 2 else np.zeros(0, np.uint64)


def _detect_by_join(
    df: DataFrame, stored: DataFrame, names: Sequence[str], unseen: Sequence[float], text: str, keys: Sequence[str], out: str
) -> DataFrame:
    """The same scores for profiles of any size: one row per trigram, joined, summed where the text was read."""
    grams = df.select(*keys, F.explode(trigrams(F.col(text))).alias("gram"))
    sums = grams.join(stored.select("gram", "weights"), "gram", "left").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.coalesce(F.sum(F.col("weights")[i]), F.lit(0.0)).alias(f"__s{i}") for i in range(len(names))],
    )
    scores = F.array(*[F.col(f"__s{i}") / F.col("__n") + F.lit(unseen[i]) for i in range(len(names))])
    best = F.array_max("__scores")
    labels = F.array(*[F.lit(n) for n in names])
    found = sums.withColumn("__scores", scores).select(
        *keys,
        F.element_at(labels, F.array_position("__scores", best).cast("int")).alias(out),
        best.alias("log_likelihood"),
    )
    return df.join(found, list(keys), "left").withColumn(out, F.coalesce(out, F.lit(UNKNOWN)))


def language_distribution(df: DataFrame, language: str) -> DataFrame:
    return df.groupBy(language).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), language)


def language_share(df: DataFrame, language: str, value: str) -> DataFrame:
    """Rows, rows in one language, and their percent share."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(language) == value).alias("matching")
    ).withColumn("percent", safe_ratio(F.col("matching") * 100, F.col("rows")))


def sample_in_and_outside(df: DataFrame, language: str, value: str, keys: Sequence[str], k: int = 5, seed: int = 42) -> DataFrame:
    """``k`` rows in the language and ``k`` others, in hash order, to look at how well the filter works.

    A missing language is outside. ``inside`` tells the two apart.
    """
    marked = df.withColumn("inside", F.coalesce(F.col(language) == value, F.lit(False)))
    ordered = marked.withColumn("__hash", hash_order(seed, *keys))
    return top_k(ordered, ["inside"], [F.col("__hash"), *[F.col(c) for c in keys]], k).drop("__hash", "rank")
