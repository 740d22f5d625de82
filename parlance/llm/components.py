"""Connected components of a graph of any size, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.session import saved


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour (or itself)."""
    near = _both_ways(edges)
    # Stored: right below the join, an aggregation would keep the rows of a node with many neighbours from being split.
    least = saved(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    return near.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = saved(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    others = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``id`` and ``component`` (the smallest id it reaches) of every node in ``edges`` (``u``, ``v``) except the smallest ones.

    Each round is written to the shared folder, so plans stay short and a lost executor costs one round. Rounds
    end when the edges do not change; their number is logarithmic in practice.
    """
    now = saved(edges.filter("u <> v").select("u", "v").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        now = saved(_small_star(saved(_large_star(now), "large-star")), "small-star")
        sums = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(xxhash64(v, u) >> 20)")).first()
        if tuple(sums) == before:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = tuple(sums)
    raise RuntimeError("components did not settle")
