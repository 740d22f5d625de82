"""Reducing and clustering document vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import PCA, HashingTF, Normalizer, Tokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators.ranking import cumulative
from parlance.session import checkpointed, saved
from parlance.sources import sinks

OUTLIER = -1


def hashed_vectors(df: DataFrame, text: str, out: str = "vector", dimensions: int = 256) -> DataFrame:
    """Unit-length hashed term counts as an array column; needs no fitting."""
    stages = [
        Tokenizer(inputCol=text, outputCol="__words"),
        HashingTF(inputCol="__words", outputCol="__tf", numFeatures=dimensions),
        Normalizer(inputCol="__tf", outputCol="__unit"),
    ]
    model = Pipeline(stages=stages).fit(df)
    return model.transform(df).withColumn(out, vector_to_array("__unit", "float32")).drop("__words", "__tf", "__unit")


def document_vectors(
    df: DataFrame, text: str, model_name: str, encode: Callable[[DataFrame], DataFrame], cache: str
) -> DataFrame:
    """Add ``vector``, encoding only texts the cache table lacks.

    The cache is keyed by model name and content, so it stays valid for other samples and orders
    of the corpus. ``encode`` gets ``text_hash`` and ``text`` and returns ``text_hash`` and ``vector``.
    """
    spark = df.sparkSession
    keyed = df.withColumn("text_hash", F.sha2(F.col(text), 256))
    wanted = keyed.filter(F.col(text).isNotNull()).groupBy("text_hash").agg(F.min(text).alias("text"))
    if sinks.table_exists(spark, cache):
        done = spark.read.parquet(cache).filter(F.col("model") == model_name)
        wanted = wanted.join(done.select("text_hash"), "text_hash", "left_anti")
    encode(wanted).select(F.lit(model_name).alias("model"), "text_hash", "vector").write.mode("append").parquet(cache)
    # Two runs at a time may both have added a text.
    vectors = spark.read.parquet(cache).filter(F.col("model") == model_name).select("text_hash", "vector")
    vectors = vectors.dropDuplicates(["text_hash"])
    return keyed.join(vectors, "text_hash", "left").drop("text_hash")


def reduce_dimensions(df: DataFrame, vector: str, components: int, out: str = "reduced") -> DataFrame:
    """Principal components of the unit vectors. A linear projection, not a neighbour embedding."""
    pipeline = Pipeline(
        stages=[
            Normalizer(inputCol="__vector", outputCol="__unit"),
            PCA(k=components, inputCol="__unit", outputCol="__reduced"),
        ]
    )
    rows = df.withColumn("__vector", array_to_vector(F.col(vector)))
    reduced = pipeline.fit(rows).transform(rows)
    return reduced.withColumn(out, vector_to_array("__reduced")).drop("__vector", "__unit", "__reduced")


def centroid_clusters(df: DataFrame, vector: str, k: int, bisecting: bool = False, out: str = "topic") -> DataFrame:
    """Cosine k-means over an array column."""
    kind = BisectingKMeans if bisecting else KMeans
    rows = df.withColumn("__features", array_to_vector(F.col(vector)))
    model = kind(k=k, distanceMeasure="cosine", seed=42, featuresCol="__features", predictionCol=out).fit(rows)
    return model.transform(rows).drop("__features")


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node of its component.

    ``edges`` (``src``, ``dst``) must hold both directions. Every round each node, and the root it
    points at, takes the smallest label seen across its edges or held by its root; each round is
    written to the checkpoint folder, so the plan stays short and a lost executor repeats one
    round only.
    """
    links = saved(edges.select("src", "dst").distinct(), "edges")
    labels = checkpointed(nodes.select("node", F.col("node").alias("label")))
    while True:
        near = links.join(labels.withColumnsRenamed({"node": "src", "label": "label_src"}), "src").join(
            labels.withColumnsRenamed({"node": "dst", "label": "label_dst"}), "dst"
        )
        proposals = near.filter(F.col("label_dst") < F.col("label_src")).select(
            F.explode(F.array("src", "label_src")).alias("node"), F.col("label_dst").alias("offer")
        )
        offers = proposals.groupBy("node").agg(F.min("offer").alias("offer"))
        roots = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        updated = labels.join(offers, "node", "left").join(roots, "label", "left").select(
            "node",
            F.col("label").alias("old"),
            F.least("label", F.coalesce("offer", "label"), F.coalesce("root", "label")).alias("label"),
        )
        updated = checkpointed(updated)
        unchanged = updated.filter(F.col("old") != F.col("label")).isEmpty()
        labels = updated.select("node", "label")
        if unchanged:
            return labels


def density_clusters(
    df: DataFrame, key: str, vector: str, eps: float, min_samples: int, min_cluster_size: int, out: str = "cluster"
) -> DataFrame:
    """Density clusters of low-dimensional vectors over a grid of side ``eps``; noise is -1.

    A cell is dense when it and the cells sharing a face with it hold at least ``min_samples`` rows.
    Dense cells that share a face form one cluster, a sparse cell next to a dense one joins its
    cluster (the smallest of several), and clusters below ``min_cluster_size`` rows are noise. A cluster is
    named by the smallest key among the rows of its dense cells.

    Rows are only ever counted per cell, so neither a crowded cell nor a pile of copies costs more
    than one row per map task, and no pairs of rows are formed. There is one density level, no hierarchy.
    """
    cell = F.transform(vector, lambda x: F.floor(x.cast("double") / F.lit(eps)))
    placed = df.withColumn("__cell", cell)
    cells = saved(placed.groupBy("__cell").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first")), "cells")
    steps = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.size("__cell") - 1),
            lambda i: F.array(
                F.transform("__cell", lambda x, j: F.when(j == i, x - 1).otherwise(x)),
                F.transform("__cell", lambda x, j: F.when(j == i, x + 1).otherwise(x)),
            ),
        )
    )
    faces = cells.select("__cell", F.explode(steps).alias("face"))
    beside = faces.join(cells.select(F.col("__cell").alias("face"), F.col("n").alias("n_face"), F.col("first").alias("first_face")), "face")
    beside = saved(beside, "faces")
    around = beside.groupBy("__cell").agg(F.sum("n_face").alias("n_around"))
    weighed = cells.join(around, "__cell", "left").withColumn(
        "dense", F.col("n") + F.coalesce("n_around", F.lit(0)) >= min_samples
    )
    weighed = saved(weighed.select("__cell", "n", "first", "dense"), "weighed")
    dense = weighed.filter("dense")
    joint = beside.join(dense.select("__cell", "first"), "__cell", "left_semi").join(
        dense.select(F.col("__cell").alias("face")), "face", "left_semi"
    )
    names = weighed.select("__cell", "first")
    edges = joint.join(names, "__cell").select(F.col("first").alias("src"), F.col("first_face").alias("dst"))
    components = connected_components(dense.select(F.col("first").alias("node")), edges)
    of_cell = dense.join(components, dense["first"] == components["node"]).select("__cell", "label")
    border = (
        beside.join(weighed.filter("NOT dense").select("__cell"), "__cell", "left_semi")
        .join(of_cell.withColumnRenamed("__cell", "face"), "face")
        .groupBy("__cell")
        .agg(F.min("label").alias("label"))
    )
    assigned = of_cell.unionByName(border)
    sizes = assigned.join(weighed, "__cell").groupBy("label").agg(F.sum("n").alias("rows"))
    kept = assigned.join(sizes.filter(F.col("rows") >= min_cluster_size), "label").select("__cell", "label")
    result = placed.join(saved(kept, "clusters"), "__cell", "left")
    return result.withColumn(out, F.coalesce("label", F.lit(OUTLIER))).drop("__cell", "label")


def number_topics(df: DataFrame, cluster: str, out: str = "topic") -> DataFrame:
    """Replace cluster names by 0, 1, … from the largest cluster down; noise stays -1.

    The clusters are numbered slice by slice, however many there are.
    """
    sizes = df.filter(F.col(cluster) != OUTLIER).groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    ordered = sizes.select(F.struct((-F.col("n")).alias("less"), F.col(cluster).alias("name")).alias("place"), F.lit(1).alias("one"))
    numbers = cumulative(ordered, [], "place", ["one"]).select(
        F.col("place.name").alias(cluster), (F.col("cum_one") - 1).alias(out)
    )
    return df.join(numbers, cluster, "left").withColumn(out, F.coalesce(out, F.lit(OUTLIER)).cast("int"))
