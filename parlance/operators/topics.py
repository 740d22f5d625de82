"""Topic words, topic quality, outlier reduction and topic dictionaries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.functions.numbers import rounded, safe_ratio
from parlance.functions.vectors import best_product, collect_matrix, dot_products, group_vectors, mean_distances, unit
from parlance.operators.ranking import cumulative, top_k
from parlance.operators.sampling import drop_duplicate_texts, sample_per_group
from parlance.schemas import GRID_RESULT_METRICS
from parlance.session import broadcast_if_small, saved
from parlance.sources import sinks

OUTLIER = -1


def term_counts(df: DataFrame, keys: Sequence[str], text: str, stopwords: Sequence[str] = ()) -> DataFrame:
    """Occurrences of every term per key (topic, or document and topic)."""
    words = tx.drop_stopwords(tx.terms(F.col(text)), stopwords)
    exploded = df.select(*keys, F.explode(words).alias("term"))
    return exploded.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n"))


def class_tfidf(counts: DataFrame, topic: str = "topic") -> DataFrame:
    """Class TF-IDF of (topic, term, n) counts: share of the topic's words times
    ``ln(1 + mean words per topic / occurrences of the term)``."""
    per_topic = saved(counts.groupBy(topic).agg(F.sum("n").alias("__words")), "topic-words")
    per_term = counts.groupBy("term").agg(F.sum("n").alias("__freq"))
    mean_words = per_topic.select(F.avg("__words")).scalar()
    joined = counts.join(per_term, "term").join(per_topic, topic)
    idf = F.log(1.0 + mean_words / F.col("__freq"))
    return joined.select(topic, "term", "n", idf.alias("idf"), (F.col("n") / F.col("__words") * idf).alias("weight"))


def topic_weights(df: DataFrame, topic: str, text: str, stopwords: Sequence[str] = ()) -> DataFrame:
    """Count the corpus once, store the counts, weigh them."""
    return class_tfidf(saved(term_counts(df, [topic], text, stopwords), "term-counts"), topic)


def top_words(weights: DataFrame, k: int = 10, topic: str = "topic") -> DataFrame:
    """The k heaviest words per topic; weights equal to nine digits tie, then the alphabet decides."""
    ordered = weights.withColumn("__w", rounded(F.col("weight"), 9))
    return top_k(ordered, [topic], [F.desc("__w"), F.asc("term")], k).drop("__w")


def diversity(words: DataFrame, topic: str = "topic") -> DataFrame:
    """Distinct top words over all top words, outlier topic left out; 0 when there are none."""
    valid = words.filter(F.col(topic) != OUTLIER)
    return valid.agg(safe_ratio(F.count_distinct("term"), F.count("term")).alias("diversity"))


def topic_counts(df: DataFrame, topic: str = "topic") -> DataFrame:
    """Documents, outliers, their percent share, and the number of valid topics."""
    sizes = df.groupBy(topic).agg(F.count(F.lit(1)).alias("n"))
    outlier = F.col(topic) == OUTLIER
    return sizes.agg(
        F.sum("n").alias("documents"),
        F.coalesce(F.sum(F.when(outlier, F.col("n"))), F.lit(0)).alias("outliers"),
        F.count_if(~outlier).alias("n_topics"),
    ).withColumn("outliers_pct", safe_ratio(F.col("outliers") * 100, F.col("documents")))


def silhouette(df: DataFrame, vector: str, topic: str = "topic") -> float | None:
    """Spark's cosine silhouette (squared, against centroids); None without two topics."""
    rows = df.filter(F.col(topic) != OUTLIER).select(array_to_vector(F.col(vector)).alias("features"), F.col(topic).alias("prediction"))
    if len(rows.select("prediction").distinct().take(2)) < 2:
        return None
    return ClusteringEvaluator(distanceMeasure="cosine").evaluate(rows)


def silhouette_exact(df: DataFrame, vector: str, topic: str = "topic") -> DataFrame:
    """Mean cosine silhouette without forming pairs; null when there are fewer than two topics.

    For unit vectors the mean distance of a row to a cluster needs only the cluster's vector sum:
    ``1 - x . S / n`` for another cluster, ``(n - x . S) / (n - 1)`` for its own. A single-row cluster scores 0.
    """
    rows = df.filter(F.col(topic) != OUTLIER).select(F.col(topic).alias("topic"), F.col(vector).alias("__v"))
    units = rows.select("topic", unit(F.col("__v")).alias("__u"))
    topics, sums, sizes = collect_matrix(group_vectors(units, "topic", "__u", "sum"), "topic")
    if len(topics) < 2:
        return df.sparkSession.range(1).select(F.lit(None).cast("double").alias("silhouette"))
    own = F.array_position(F.array(*[F.lit(t) for t in topics]), F.col("topic")).cast("int") - 1
    measured = rows.select(F.inline(F.array(mean_distances(F.col("__v"), own, sums, sizes, df.sparkSession))))
    score = (F.col("nearest") - F.col("own")) / F.greatest("nearest", "own")
    return measured.agg(F.avg(F.when(F.col("own").isNull(), 0.0).otherwise(score)).alias("silhouette"))


def reduce_outliers(df: DataFrame, vector: str, threshold: float = 0.0, topic: str = "topic") -> DataFrame:
    """Move each outlier to the topic whose mean vector is most similar, if that is at least
    ``threshold``; ``similarity`` is kept for outliers."""
    members = df.filter(F.col(topic) != OUTLIER)
    topics, means, _ = collect_matrix(group_vectors(members, topic, vector), topic)
    if not topics:
        return df.withColumn("similarity", F.lit(None).cast("double"))
    lengths = [sum(x * x for x in m) ** 0.5 or 1.0 for m in means]
    units = [[x / length for x in m] for m, length in zip(means, lengths)]
    best = best_product(F.col(vector), units, df.sparkSession)
    outliers = df.filter(F.col(topic) == OUTLIER).select("*", F.inline(F.array(best)).alias("__place", "similarity"))
    nearest = F.array(*[F.lit(t) for t in topics])[F.col("__place")]
    moved = outliers.withColumn(
        topic, F.when(F.col("similarity") >= threshold, nearest).otherwise(F.lit(OUTLIER)).cast(df.schema[topic].dataType)
    )
    return members.withColumn("similarity", F.lit(None).cast("double")).unionByName(moved.drop("__place"))


def representative_documents(
    df: DataFrame, keys: Sequence[str], text: str, weights: DataFrame, k: int = 3, topic: str = "topic"
) -> DataFrame:
    """The k documents per topic closest (cosine of term weights) to the topic's word weights.

    ``weights`` is the output of ``class_tfidf``; similarities equal to nine digits tie, then the
    key decides.
    """
    counts = term_counts(df, [*keys, topic], text).withColumnRenamed("n", "__n")
    stored = saved(weights.select(topic, "term", "idf", "weight"), "topic-weights")
    norms = saved(stored.groupBy(topic).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("__norm")), "norms")
    joined = counts.join(broadcast_if_small(stored, 500_000), [topic, "term"])
    value = F.col("__n") * F.col("idf")
    scored = joined.groupBy(*keys, topic).agg(
        F.sum(value * F.col("weight")).alias("__dot"), F.sqrt(F.sum(value * value)).alias("__len")
    ).join(norms, topic)
    similarity = rounded(safe_ratio(F.col("__dot"), F.col("__len") * F.col("__norm")), 9)
    ranked = top_k(scored.withColumn("similarity", similarity), [topic], [F.desc("similarity"), *[F.asc(c) for c in keys]], k)
    return ranked.select(topic, "rank", *keys, "similarity")


def with_original_text(rows: DataFrame, df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    return rows.join(df.select(*keys, text), list(keys))


def topic_dictionary(
    df: DataFrame, keys: Sequence[str], clean: str, text: str, stopwords: Sequence[str] = (), seed: int = 42
) -> DataFrame:
    """One record per topic, outliers included: size, name, ten words, three representative and up to seven
    other original texts."""
    rows = saved(df.select(*keys, clean, text, "topic"), "topic-rows")
    weights = saved(topic_weights(rows, "topic", clean, stopwords), "weights")
    words = saved(top_words(weights), "top-words")
    listed = words.groupBy("topic").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda w: w["term"]).alias("Representation")
    )
    unique = drop_duplicate_texts(rows.filter(F.col(clean).isNotNull()), clean, keys)
    chosen = representative_documents(unique, keys, clean, weights)
    reps = saved(with_original_text(chosen.filter(F.col("topic") != OUTLIER), rows, keys, text), "representatives")
    rep_lists = reps.groupBy("topic").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", text))), lambda w: w[text]).alias("Representative_Docs")
    )
    samples = sample_per_group(rows, "topic", text, 7, reps, seed).groupBy("topic").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", text))), lambda w: w[text]).alias("Sample_Docs")
    )
    sizes = rows.groupBy("topic").agg(F.count(F.lit(1)).alias("Count"))
    joined = sizes.join(listed, "topic", "left").join(rep_lists, "topic", "left").join(samples, "topic", "left")
    empty = F.array().cast("array<string>")
    filled = joined.withColumns({c: F.coalesce(c, empty) for c in ("Representation", "Representative_Docs", "Sample_Docs")})
    name = F.concat_ws("_", F.col("topic").cast("string"), F.slice("Representation", 1, 4))
    return filled.select(
        F.col("topic").alias("Topic"), "Count", name.alias("Name"), "Representation", "Representative_Docs", "Sample_Docs"
    )


# The block a reader gets per topic.
BLOCK = "### TÓPICO %d ###\ntop_10_words: [%s]\n\ntop_3_transcriptions: \n%s\n\nsample_transcriptions: \n%s\n" + "-" * 80 + "\n"
NO_REPRESENTATIVE = "  - [Nenhum texto representativo]"
NO_SAMPLE = "  - [Nenhuma amostra adicional]"


def topic_blocks(dictionary: DataFrame) -> DataFrame:
    """Readable text per valid topic from the topic dictionary."""

    def bullets(column: str, empty: str):
        lines = F.array_join(F.transform(column, lambda d: F.concat(F.lit("  - "), d)), "\n")
        return F.when(F.size(column) > 0, lines).otherwise(F.lit(empty))

    block = F.format_string(
        BLOCK, "Topic", F.array_join("Representation", ", "), bullets("Representative_Docs", NO_REPRESENTATIVE),
        bullets("Sample_Docs", NO_SAMPLE),
    )
    return dictionary.filter(F.col("Topic") != OUTLIER).select("Topic", block.alias("block"))


def topic_similarity(vectors: DataFrame, topic: str = "topic", max_topics: int = 5_000) -> DataFrame:
    """Cosine of every two topic vectors, both directions and the diagonal included.

    The result is topics squared by definition; the vectors travel as one small matrix and
    each topic row yields its line of it.
    """
    topics, matrix, _ = collect_matrix(vectors, topic, max_topics)
    lengths = [sum(x * x for x in m) ** 0.5 or 1.0 for m in matrix]
    units = [[x / length for x in m] for m, length in zip(matrix, lengths)]
    rows = vectors.select(F.col(topic).alias("topic_a"), dot_products(F.col("vector"), units, vectors.sparkSession).alias("s"))
    pairs = F.arrays_zip(F.array(*[F.lit(t) for t in topics]).alias("topic_b"), F.col("s").alias("similarity"))
    return rows.select("topic_a", F.inline(pairs)).toDF("topic_a", "topic_b", "similarity")


def merge_order(similarities: DataFrame) -> DataFrame:
    """The order in which the closest topics join into a tree (average linkage over the topic matrix).

    ``similarities`` has a row per two topics (both directions or one). ``step`` counts the merges, ``kept`` and ``merged`` are the
    smallest topics of both sides, ``topics`` the size of the joined side. Similarities are compared to nine digits, equal ones by the
    topics. In every round all pairs that are each other's closest are merged at once: with average linkage later merges cannot come
    closer than those, so the tree is that of merging one pair after the other. Pairs live in a table that is stored each round.
    """
    pairs = similarities.filter("topic_a < topic_b").select(
        F.col("topic_a").alias("a"), F.col("topic_b").alias("b"), F.col("similarity").cast("double").alias("s"),
        F.lit(1).cast("long").alias("n_a"), F.lit(1).cast("long").alias("n_b"),
    )
    now, merges = saved(pairs, "links"), []
    while not now.isEmpty():
        ends = now.select(F.col("a").alias("c"), "*").union(now.select(F.col("b").alias("c"), "*"))
        order = F.struct((-F.round("s", 9)).alias("less"), "a", "b")
        closest = ends.groupBy("c").agg(F.min_by(F.struct("a", "b", "s", "n_a", "n_b"), order).alias("pair")).select("pair.*")
        mutual = saved(closest.groupBy("a", "b", "s", "n_a", "n_b").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").drop("n"), "mutual")
        merges.append(mutual.select("a", "b", "s", (F.col("n_a") + F.col("n_b")).alias("topics")))
        into = mutual.select(F.explode(F.array("a", "b")).alias("old"), F.col("a").alias("new"), (F.col("n_a") + F.col("n_b")).alias("size"))
        into = saved(into, "into")
        left = into.select(F.col("old").alias("a"), F.col("new").alias("new_a"), F.col("size").alias("size_a"))
        right = into.select(F.col("old").alias("b"), F.col("new").alias("new_b"), F.col("size").alias("size_b"))
        moved = now.join(left, "a", "left").join(right, "b", "left").select(
            F.struct(F.coalesce("new_a", "a").alias("t"), F.coalesce("size_a", "n_a").alias("n")).alias("x"),
            F.struct(F.coalesce("new_b", "b").alias("t"), F.coalesce("size_b", "n_b").alias("n")).alias("y"),
            "s", (F.col("n_a") * F.col("n_b")).alias("weight"),
        )
        apart = moved.filter("x.t <> y.t").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "s", "weight")
        means = apart.groupBy("x", "y").agg((F.sum(F.col("s") * F.col("weight")) / F.sum("weight")).alias("s"))
        now = saved(
            means.select(F.col("x.t").alias("a"), F.col("y.t").alias("b"), "s", F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b")), "links"
        )
    found = merges[0] if merges else now.select("a", "b", "s", F.col("n_a").alias("topics"))
    for more in merges[1:]:
        found = found.union(more)
    place = F.struct((-F.round("s", 9)).alias("less"), "topics", "a", "b", "s")
    ordered = cumulative(found.select(place.alias("place"), F.lit(1).alias("one")), [], "place", ["one"])
    return ordered.select(
        F.col("cum_one").cast("int").alias("step"), F.col("place.a").alias("kept"), F.col("place.b").alias("merged"),
        F.col("place.s").alias("similarity"), F.col("place.topics").cast("int").alias("topics"),
    )


def top_topics(df: DataFrame, model: str, k: int = 3, words: int = 7) -> DataFrame:
    """The k largest valid topics per model with their first words."""
    valid = df.filter(F.col("topic") != OUTLIER)
    ranked = top_k(valid, [model], [F.desc("n"), F.asc("topic")], k)
    return ranked.withColumn("words", F.array_join(F.slice("words", 1, words), ", "))


def grid_search(
    spark: SparkSession, grid: DataFrame, run: Callable[[dict], dict], path: str
) -> DataFrame:
    """Run every parameter row the result table lacks and append its metrics.

    Only parameter rows pass through the driver; ``run`` starts Spark jobs and returns the metrics.
    A failing combination is stored with its error.
    """
    from pyspark.sql import types as T

    schema = T.StructType([*grid.schema.fields, *GRID_RESULT_METRICS.fields])
    done = sinks.read_log(spark, path, schema)
    names = grid.columns
    pending = grid.join(done.select(*names), names, "left_anti").orderBy(*names)
    for row in pending.toLocalIterator():
        settings = row.asDict()
        try:
            outcome = {**settings, **run(settings), "error": None}
        except Exception as problem:  # a combination may fail without ending the search
            outcome = {**settings, "error": str(problem)}
        values = [tuple(outcome.get(f.name) for f in schema.fields)]
        sinks.append_log(spark.createDataFrame(values, schema), path, schema)
    return sinks.read_log(spark, path, schema)
