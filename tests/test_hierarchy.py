"""Neighbours, spanning forests and hierarchical density clusters against brute force on small fixtures."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from parlance.operators import clustering, hierarchy, neighbours


def near_brute(points, k):
    out = {}
    for i, p in points.items():
        ranked = sorted((math.dist(p, q), j) for j, q in points.items() if j != i)
        out[i] = ranked[:k]
    return out


@pytest.mark.parametrize(("dims", "n", "k", "cell_rows", "sample"), [(3, 400, 5, 30, 1000), (2, 300, 4, 20, 150), (1, 5, 9, 4, 1000)])
def test_nearest_neighbours_are_exact(spark, dims, n, k, cell_rows, sample):
    rng = random.Random(n)
    points = {i: tuple(rng.choice([rng.gauss(0, 1), rng.gauss(9, 0.2), float(rng.randrange(4))]) for _ in range(dims)) for i in range(n)}
    points = dict({p: i for i, p in points.items()}.items()).items()
    points = {i: p for p, i in points}
    rows = spark.createDataFrame([(i, list(p)) for i, p in points.items()] + [(None, [0.0] * dims), (-1, None)], "id long, v array<double>")
    found = {}
    for r in neighbours.nearest_neighbours(rows.repartition(3), "id", "v", k, cell_rows, sample).collect():
        found.setdefault(r["id"], []).append((r["distance"], r["other"]))
    expected = near_brute(points, k)
    assert {i: [j for _, j in sorted(v)] for i, v in found.items()} == {i: [j for _, j in v] for i, v in expected.items()}
    assert all(math.isclose(a[0], b[0], rel_tol=1e-12) for i in found for a, b in zip(sorted(found[i]), expected[i], strict=True))


def kruskal(edges):
    parent, taken = {}, []

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for w, u, v in sorted(edges):
        a, b = find(u), find(v)
        if a != b:
            parent[a] = b
            taken.append((w, u, v))
    return taken


@pytest.mark.parametrize("ties", [False, True])
def test_spanning_forest_against_kruskal(spark, ties):
    rng = random.Random(ties)
    edges = {}
    for block in (0, 100, 200):  # three parts that no edge joins
        for _ in range(150):
            u, v = sorted(rng.sample(range(block, block + 40), 2))
            edges[u, v] = float(rng.randrange(1, 5)) if ties else rng.random()
    frame = spark.createDataFrame([(u, v, w) for (u, v), w in edges.items()], "u long, v long, weight double")
    found = hierarchy.minimum_spanning_forest(frame).collect()
    assert sorted((r["weight"], r["u"], r["v"]) for r in found) == sorted(kruskal([(w, u, v) for (u, v), w in edges.items()]))


def brute_clusters(points, counts, k, min_samples, min_cluster_size):
    """Whole tree on one machine, from the top down: split, shrink, dissolve; then excess of mass."""
    near = near_brute(points, k)
    core = {}
    for i, others in near.items():
        rows, core[i] = counts[i], 0.0
        for d, j in others:
            if rows >= min_samples:
                break
            rows, core[i] = rows + counts[j], d
    edges = {(min(i, j), max(i, j)): max(d, core[i], core[j]) for i, others in near.items() for d, j in others}
    tree = {i: ("leaf", i) for i in points}
    size = lambda t: counts[t[1]] if t[0] == "leaf" else t[4]
    top = dict(tree)
    name = {i: i for i in points}
    groups = {i: [i] for i in points}
    for w, u, v in kruskal([(w, u, v) for (u, v), w in edges.items()]):
        a, b = name[u], name[v]
        top[a] = ("merge", 1 / w, top[a], top[b], size(top[a]) + size(top[b]))
        groups[a] += groups.pop(b)
        del top[b]
        name.update({x: a for x in groups[a]})

    def points_of(t):
        return [t[1]] if t[0] == "leaf" else points_of(t[2]) + points_of(t[3])

    def condense(t, birth, last):
        """Own stability, best, and the chosen clusters below or here as lists of members."""
        total, mine = 0.0, []
        while True:
            if t[0] == "leaf":
                return finish(total + size(t) * last, birth, mine + [t[1]], [])
            _, density, a, b, _ = t
            a, b = sorted((a, b), key=size)
            last = density
            if size(a) >= min_cluster_size:
                children = [condense(x, density, density) for x in (a, b)]
                return finish(total + (size(a) + size(b)) * density, birth, mine + points_of(a) + points_of(b), children, size(a) + size(b))
            total += size(a) * density
            mine += points_of(a)
            if size(b) < min_cluster_size:
                return finish(total + size(b) * density, birth, mine + points_of(b), [])
            t = b

    def finish(total, birth, members, children, _=None):
        own = total - sum(counts[i] for i in members) * birth
        below = sum(c[0] for c in children)
        chosen = [x for c in children for x in c[1]]
        return (own, [members]) if not children or own > below else (below, chosen), children, members

    def flat(result):
        (best, chosen), *_ = result
        return best, chosen

    condense_inner = condense

    def condense(t, birth, last):  # noqa: F811
        return flat(condense_inner(t, birth, last))

    big = [t for t in top.values() if size(t) >= min_cluster_size]
    if len(top) == 1 and big:
        t, last = big[0], 0.0
        while t[0] == "merge":  # the whole graph is no cluster: go down to its first split
            a, b = sorted((t[2], t[3]), key=size)
            if size(a) >= min_cluster_size:
                return [x for side in (a, b) for x in condense(side, t[1], t[1])[1]]
            if size(b) < min_cluster_size:
                return []
            t = b
        return []
    return [x for t in big for x in condense(t, 0.0, 0.0)[1]]


def labels_of(clusters, points):
    label = dict.fromkeys(points, -1)
    for members in clusters:
        label.update(dict.fromkeys(members, min(members)))
    return label


def scene(rng, kind):
    if kind == "densities":
        return [(rng.gauss(0, 0.05), rng.gauss(0, 0.05)) for _ in range(80)] + [(rng.gauss(6, 1.0), rng.gauss(6, 1.0)) for _ in range(80)] + [
            (rng.uniform(-4, 12), rng.uniform(-4, 12)) for _ in range(20)
        ]
    if kind == "copies":
        return [(float(rng.randrange(12)), float(rng.randrange(3))) for _ in range(200)] + [(50.0, 50.0)] * 9
    return [(rng.random(), rng.random(), rng.random()) for _ in range(150)]


@pytest.mark.parametrize(("kind", "most_edges"), [("densities", 60), ("copies", 1 << 20), ("even", 1 << 20)])
def test_clusters_against_the_whole_tree(spark, kind, most_edges):
    rows = list(enumerate(scene(random.Random(5), kind)))
    first, counts = {}, Counter(p for _, p in rows)
    for i, p in rows:
        first.setdefault(p, i)
    points = {i: p for p, i in first.items()}
    chosen = brute_clusters(points, {i: counts[p] for i, p in points.items()}, 8, 4, 6)
    label = labels_of(chosen, points)
    frame = spark.createDataFrame([(i, list(p)) for i, p in rows] + [(-5, None)], "id long, v array<double>").repartition(3)
    found = hierarchy.hierarchical_clusters(frame, "id", "v", 6, 4, 8, most_edges=most_edges)
    assert {r["id"]: r["cluster"] for r in found.collect()} == {-5: -1, **{i: label[first[p]] for i, p in rows}}
    assert kind == "even" or len(chosen) >= 2


def test_two_densities_that_one_grid_cannot_tell(spark):
    rows = list(enumerate(scene(random.Random(8), "densities")))
    truth = {i: "dense" if i < 80 else "loose" if i < 160 else "noise" for i, _ in rows}
    frame = spark.createDataFrame([(i, list(p)) for i, p in rows], "id long, v array<double>")

    def share_right(found):
        """Rows of both groups in the cluster that holds most of their group, if those clusters differ."""
        label = {r["id"]: r["cluster"] for r in found.collect()}
        most = [Counter(label[i] for i in label if truth[i] == g).most_common(1)[0] for g in ("dense", "loose")]
        return 0 if most[0][0] == most[1][0] or -1 in (most[0][0], most[1][0]) else sum(n for _, n in most) / 160

    assert share_right(hierarchy.hierarchical_clusters(frame, "id", "v", 15, 5)) > 0.85
    assert max(share_right(clustering.density_clusters(frame, "id", "v", eps, 5, 15)) for eps in (0.02, 0.1, 0.3)) < 0.85


def test_no_rows_one_row_and_only_copies(spark):
    schema = "id long, v array<double>, cluster string, u long, n string"
    empty = spark.createDataFrame([], schema)
    assert hierarchy.hierarchical_clusters(empty, "id", "v", 5, 3).collect() == []
    one = spark.createDataFrame([(3, [1.0], "x", 1, "y")], schema)
    assert [r["cluster"] for r in hierarchy.hierarchical_clusters(one, "id", "v", 5, 3).collect()] == [-1]
    two = spark.createDataFrame([(i, [float(i % 2 * 100)], None, None, None) for i in range(20)], schema)
    labels = {r["id"]: r["cluster"] for r in hierarchy.hierarchical_clusters(two, "id", "v", 5, 3).collect()}
    assert labels == {i: i % 2 for i in range(20)}


def test_cells_reach_every_ball():
    rng = np.random.default_rng(3)
    points = rng.normal(size=(500, 3))
    cells = neighbours.Cells(points, 20)
    home, radius = cells.home(points), rng.random(500)
    reached = {(int(i), c) for c, rows in cells.reached(points, radius) for i in rows}
    for i in range(0, 500, 17):
        inside = np.flatnonzero(((points - points[i]) ** 2).sum(1) <= radius[i] ** 2)
        assert {(i, c) for c in home[inside]} <= reached
