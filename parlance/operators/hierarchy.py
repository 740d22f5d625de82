"""Hierarchical density clustering: clusters of different densities in one run, noise -1.

Three steps, each a chain of joins and aggregations over narrow rows:

1. The neighbour graph. Every distinct vector is linked to its nearest ones; an edge weighs the distance or the larger of the two core
   distances, whichever is more (mutual reachability).
2. Its minimum spanning forest by Boruvka rounds. In a round every component takes its lightest outgoing edge, the components that meet
   become one, and of parallel edges the lightest stays, so the edges shrink as fast as the components.
3. The cluster tree. Edges are taken in bands of ascending weight; the components of a band are independent, and each is merged edge by edge in
   one task. What a component carries into the next band is one row: size, open cluster, stability so far. A merge of two components
   of at least ``min_cluster_size`` rows closes both clusters; smaller components dissolve in the cluster they join. Bands are cut so
   that no task gets more than ``most_edges`` edges.

Closed clusters are chosen by excess of mass: one wins when its own stability is above the best that lies below it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators.clustering import OUTLIER, connected_components
from parlance.operators.neighbours import CELL_ROWS, nearest_neighbours
from parlance.session import saved

MOST_EDGES = 1 << 20


def reachability_edges(near: DataFrame, sizes: DataFrame, min_samples: int) -> DataFrame:
    """Edges ``u`` < ``v`` with ``weight`` from neighbours (``id``, ``other``, ``distance``) and ``sizes`` (``id``, ``n`` rows).

    The core distance of a vector is the one within which it has ``min_samples`` rows, its own copies included; with too few
    neighbours it is the largest known.
    """
    counted = near.join(sizes.select(F.col("id").alias("other"), F.col("n").alias("n_other")), "other")
    ordered = counted.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("distance", "other", "n_other"))).alias("near"))
    known = sizes.join(ordered, "id").withColumn(
        "until",
        F.aggregate(
            "near",
            F.struct(F.col("n").cast("long").alias("rows"), F.lit(0.0).alias("core")),
            lambda s, x: F.when(s["rows"] >= min_samples, s).otherwise(
                F.struct((s["rows"] + x["n_other"]).alias("rows"), x["distance"].alias("core"))
            ),
        ),
    )
    cores = saved(known.select("id", F.col("until.core").alias("core")), "core-distances")
    joined = near.join(cores, "id").join(cores.select(F.col("id").alias("other"), F.col("core").alias("core_other")), "other")
    weighed = joined.select(
        F.least("id", "other").alias("u"), F.greatest("id", "other").alias("v"), F.greatest("distance", "core", "core_other").alias("weight")
    )
    return weighed.groupBy("u", "v").agg(F.min("weight").alias("weight"))


def minimum_spanning_forest(edges: DataFrame) -> DataFrame:
    """The edges (``u``, ``v``, ``weight``) of the minimum spanning forest; equal weights in the order of (``u``, ``v``).

    Every round at least halves the components that still have outgoing edges, and is stored.
    """
    now = saved(edges.select(F.col("u").alias("a"), F.col("v").alias("b"), F.struct("weight", "u", "v").alias("edge")), "graph")
    taken = []
    while not now.isEmpty():
        ends = now.select(F.col("a").alias("c"), F.col("b").alias("to"), "edge").union(now.select("b", "a", "edge"))
        lightest = saved(ends.groupBy("c").agg(F.min(F.struct("edge", "to")).alias("best")), "lightest")
        taken.append(saved(lightest.select("best.edge.*").distinct(), "forest-edges"))
        # Along lightest edges every component leads to one pair that chose each other; the smaller of the two is the root.
        hooks = lightest.select("c", F.col("best.to").alias("to"))
        back = hooks.select(F.col("c").alias("to"), F.col("to").alias("back"))
        root = saved(
            hooks.join(back, "to").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("root")),
            "hooks",
        )
        while True:
            up = root.select(F.col("c").alias("root"), F.col("root").alias("above"))
            jumped = saved(root.join(up, "root").select("c", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "roots")
            done = jumped.filter("moved").isEmpty()
            root = jumped.select("c", "root")
            if done:
                break
        first, second = root.toDF("a", "root_a"), root.toDF("b", "root_b")
        moved = now.join(first, "a").join(second, "b").filter("root_a <> root_b")
        pair = moved.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b"), "edge")
        now = saved(pair.groupBy("a", "b").agg(F.min("edge").alias("edge")), "graph")
    result = taken[0] if taken else edges.select("weight", "u", "v")
    for more in taken[1:]:
        result = result.union(more)
    return result.select("u", "v", "weight")


class Branch:
    """A component while its edges are merged: rows, name of its open cluster, its stability so far, the best below."""

    __slots__ = ("best", "cluster", "nodes", "rows", "total")

    def __init__(self, node: int, rows: int, cluster: str | None, total: float, best: float | None) -> None:
        self.rows, self.cluster, self.total, self.best, self.nodes = rows, cluster, total, best, [node]


def merge_component(part: pa.Table, min_cluster_size: int) -> pa.Table:
    """Merge the components that the edges of ``part`` join, lightest edge first.

    Rows of the result: ``node`` with ``into`` (its new component, unless it dissolved in ``cluster``); ``closed`` clusters with their
    parent, stability and whether they win; the ``open`` state of the component that remains.
    """
    part = part.sort_by([("weight", "ascending"), ("u", "ascending"), ("v", "ascending")])
    states, parent, out = {}, {}, []
    sides = [
        [part[f"{name}_{side}"].to_pylist() for name in ("node", "rows", "cluster", "total", "best")] for side in ("a", "b")
    ]
    for side in sides:
        for node, *state in zip(*side, strict=True):
            if node not in states:
                states[node], parent[node] = Branch(node, *state), node

    def find(node: int) -> int:
        while parent[node] != node:
            parent[node] = node = parent[parent[node]]
        return node

    def open_cluster(branch: Branch, name: str, density: float) -> None:
        """From now on the branch is a cluster; the rows it has so far leave it at this density."""
        branch.cluster, branch.total = name, branch.rows * density
        for node in branch.nodes:
            out.append(("dissolved", node, None, name, None, None))
        branch.nodes = []

    edges = zip(sides[0][0], sides[1][0], part["weight"].to_pylist(), part["u"].to_pylist(), part["v"].to_pylist(), strict=True)
    for a, b, weight, u, v in edges:
        a, b, density = find(a), find(b), 1.0 / weight
        left, right = states[a], states[b]
        if left.rows < right.rows:
            a, b, left, right = b, a, right, left
        parent[b] = a
        for node, side in ((a, left), (b, right)):
            if side.rows >= min_cluster_size and side.cluster is None:  # copies of one vector are a cluster by themselves
                open_cluster(side, f"{node}", density)
        if right.cluster is not None:
            below = 0.0
            for side in (left, right):
                stability = side.total - side.rows * density
                wins = side.best is None or stability > side.best
                out.append(("closed", None, None, side.cluster, f"{u}-{v}", (stability, wins)))
                below += stability if wins else side.best
            left.cluster, left.best, left.total = f"{u}-{v}", below, (left.rows + right.rows) * density
            left.rows += right.rows
        else:
            left.rows += right.rows
            if left.cluster is not None:
                left.total += right.rows * density
                out += [("dissolved", node, None, left.cluster, None, None) for node in right.nodes]
            else:
                left.nodes += right.nodes
                if left.rows >= min_cluster_size:
                    open_cluster(left, f"{u}-{v}", density)
        del states[b]
    for node in parent:
        out.append(("node", node, find(node), None, None, None))
    remains = [(node, s) for node, s in states.items()]
    columns = list(zip(*out, strict=True))
    table = {
        "kind": [*columns[0], *["open"] * len(remains)],
        "node": [*columns[1], *[node for node, _ in remains]],
        "into": [*columns[2], *[None] * len(remains)],
        "cluster": [*columns[3], *[s.cluster for _, s in remains]],
        "parent": [*columns[4], *[None] * len(remains)],
        "stability": [*[None if x is None else x[0] for x in columns[5]], *[s.total for _, s in remains]],
        "wins": [*[None if x is None else x[1] for x in columns[5]], *[None] * len(remains)],
        "rows": [*[None] * len(out), *[s.rows for _, s in remains]],
        "best": [*[None] * len(out), *[s.best for _, s in remains]],
    }
    types = dict(zip(table, [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.bool_(), pa.int64(), pa.float64()], strict=True))
    return pa.table({name: pa.array(values, types[name]) for name, values in table.items()})


MERGED = "kind string, node long, into long, cluster string, parent string, stability double, wins boolean, rows long, best double"


def _next_band(pending: DataFrame, n: int, most_edges: int) -> tuple[DataFrame, DataFrame]:
    """The lightest pending edges as far as no component of them has too many, with ``group``, and the rest."""
    if n <= most_edges:
        return pending.withColumn("group", F.lit(0).cast("long")), pending.limit(0)
    share = min(0.5, 64 * most_edges / n)
    while True:
        cut = pending.approxQuantile("weight", [share], 0.001 if share > 0.01 else share / 10)[0]
        light = saved(pending.filter(F.col("weight") <= cut), "band")
        both = light.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(light.select("b", "a"))
        groups = saved(connected_components(both.select(F.col("src").alias("node")).distinct(), both), "band-groups")
        banded = saved(light.join(groups.select(F.col("node").alias("a"), F.col("label").alias("group")), "a"), "banded")
        largest = banded.groupBy("group").count().agg(F.max("count")).first()[0]
        # Edges of one weight cannot be parted by weight; a smaller share would only find the same band.
        if largest <= most_edges or cut <= pending.agg(F.min("weight")).first()[0]:
            return banded, pending.filter(F.col("weight") > cut)
        share /= 4


def cluster_tree(forest: DataFrame, sizes: DataFrame, min_cluster_size: int, most_edges: int = MOST_EDGES) -> tuple[DataFrame, DataFrame]:
    """Members (``id``, ``cluster`` it leaves last, null for none) and clusters (``cluster``, ``parent``, ``stability``, ``wins``).

    ``sizes`` gives ``n`` rows of every ``id``. A cluster's name is that of the edge at which it appears. Components of the forest that are
    never joined are closed at density zero. The only component of a connected graph cannot win, since it would be everything.
    """
    states = saved(
        sizes.select(
            F.col("id").alias("node"), F.col("n").alias("rows"), F.lit(None).cast("string").alias("cluster"),
            F.lit(0.0).alias("total"), F.lit(None).cast("double").alias("best"),
        ),
        "branches",
    )
    loose = saved(sizes.select("id", F.col("id").alias("node")), "loose")
    pending = saved(forest.select(F.col("u").alias("a"), F.col("v").alias("b"), "u", "v", "weight"), "pending")
    settled, closed = [], []
    while n := pending.count():
        band, rest = _next_band(pending, n, most_edges)
        for side in ("a", "b"):
            band = band.join(states.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("node", "rows", "cluster", "total", "best")]), side)
        merged = saved(band.groupBy("group").applyInArrow(lambda part: merge_component(part, min_cluster_size), MERGED), "merged")
        into = merged.filter("kind = 'node'").select("node", "into")
        fixed = merged.filter("kind = 'dissolved'").select("node", "cluster")
        settled.append(saved(loose.join(fixed, "node").select("id", "cluster"), "settled"))
        loose = saved(
            loose.join(fixed, "node", "left_anti").join(into, "node", "left").select("id", F.coalesce("into", "node").alias("node")), "loose"
        )
        closed.append(merged.filter("kind = 'closed'").select("cluster", "parent", "stability", "wins"))
        opened = merged.filter("kind = 'open'").select("node", "rows", "cluster", F.col("stability").alias("total"), "best")
        states = saved(states.join(into, "node", "left_anti").unionByName(opened), "branches")
        for side in ("a", "b"):
            names = into.select(F.col("node").alias(side), F.col("into").alias("new"))
            rest = rest.join(names, side, "left").withColumn(side, F.coalesce("new", side)).drop("new")
        pending = saved(rest.select("a", "b", "u", "v", "weight"), "pending")
    # A vector with enough copies and no link is a cluster, too.
    name = F.coalesce("cluster", F.when(F.col("rows") >= min_cluster_size, F.col("node").cast("string")))
    last = states.withColumn("alone", F.col("cluster").isNull()).withColumn("cluster", name).filter("cluster is not null")
    only = states.count() == 1
    wins = F.lit(False) if only else F.col("best").isNull() | (F.col("total") > F.col("best"))
    closed.append(last.select("cluster", F.lit(None).cast("string").alias("parent"), F.col("total").alias("stability"), wins.alias("wins")))
    settled.append(loose.join(last.filter("alone").select("node", "cluster"), "node", "left").select("id", "cluster"))
    members, clusters = settled[0], closed[0]
    for more in settled[1:]:
        members = members.unionByName(more)
    for more in closed[1:]:
        clusters = clusters.unionByName(more)
    return members, clusters


def chosen_clusters(clusters: DataFrame) -> DataFrame:
    """``cluster`` and ``top``, its highest winning ancestor (itself included), for clusters that have one. Steps double each round."""
    now = saved(clusters.select("cluster", F.col("parent").alias("above"), F.when(F.col("wins"), F.col("cluster")).alias("top")), "tops")
    while not now.filter("above is not null").isEmpty():
        up = now.select(F.col("cluster").alias("above"), F.col("above").alias("next"), F.col("top").alias("higher"))
        now = saved(
            now.join(up, "above", "left").select("cluster", F.col("next").alias("above"), F.coalesce("higher", "top").alias("top")), "tops"
        )
    return now.filter("top is not null").select("cluster", "top")


def hierarchical_clusters(
    df: DataFrame,
    key: str,
    vector: str,
    min_cluster_size: int = 5,
    min_samples: int = 5,
    n_neighbors: int | None = None,
    out: str = "cluster",
    most_edges: int = MOST_EDGES,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Add the density cluster of every row: the smallest ``key`` among its members, or -1 for noise.

    ``vector`` is an array of a few numbers, ``key`` a whole number. The graph holds the ``n_neighbors`` nearest distinct vectors of each
    (``2 * min_samples`` by default). Equal vectors are one node that counts its rows, so piles of copies cost nothing; copies leave
    their cluster with the first link. A row without a vector is noise, and an empty table gives an empty result.
    """
    if min_cluster_size < 2:
        raise ValueError("a cluster has at least two rows")
    vectors = df.filter(F.col(vector).isNotNull()).groupBy(F.col(vector).alias("v"))
    points = saved(vectors.agg(F.min(F.col(key).cast("long")).alias("id"), F.count(F.lit(1)).alias("n")), "distinct-vectors")
    sizes = points.select("id", "n")
    near = saved(nearest_neighbours(points, "id", "v", n_neighbors or 2 * min_samples, cell_rows), "neighbours")
    forest = saved(minimum_spanning_forest(reachability_edges(near, sizes, min_samples)), "forest")
    members, clusters = cluster_tree(forest, sizes, min_cluster_size, most_edges)
    tops = chosen_clusters(clusters)
    found = saved(members.filter("cluster is not null").join(tops, "cluster").select("id", "top"), "members")
    names = saved(found.groupBy("top").agg(F.min("id").alias("name")), "names")
    labelled = found.join(names, "top").join(points, "id").select(F.col("v").alias("__v"), F.col("name").alias("__name"))
    joined = df.join(saved(labelled, "labelled"), df[vector] == F.col("__v"), "left")
    return joined.withColumn(out, F.coalesce("__name", F.lit(OUTLIER).cast("long"))).drop("__v", "__name")
