"""Slice-wise operators against plain ones, with one group holding most rows."""

import random
import statistics

from pyspark.sql import functions as F

from parlance.operators import clustering, ranking, reports, sampling


def skewed(spark, n=3000):
    return spark.range(n).select(
        "id", F.when(F.col("id") % 3 != 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"),
        (F.col("id") * 7919 % 101).cast("double").alias("x"),
    )


def test_hash_row_number_is_a_permutation_per_group(spark):
    df = skewed(spark).withColumn("h", ranking.hash_order(1, "id"))
    rows = ranking.hash_row_number(df, ["g"], "h", ["id"], digits=1).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["g"], []).append((r["h"], r["id"], r["rn"]))
    for members in groups.values():
        assert [m[2] for m in sorted(members)] == list(range(1, len(members) + 1))


def test_hash_row_number_keeps_null_groups(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id long, g string").withColumn("h", ranking.hash_order(1, "id"))
    assert sorted(r["rn"] for r in ranking.hash_row_number(df, ["g"], "h", ["id"]).collect()) == [1, 1, 2]


def test_cumulative_matches_running_sums(spark):
    counts = skewed(spark).groupBy("g", "x").agg(F.count("*").alias("n"))
    got = {(r["g"], r["x"]): r["cum_n"] for r in ranking.cumulative(counts, ["g"], "x", ["n"]).collect()}
    expected, running = {}, {}
    for r in sorted(counts.collect(), key=lambda r: (r["g"], r["x"])):
        running[r["g"]] = running.get(r["g"], 0) + r["n"]
        expected[(r["g"], r["x"])] = running[r["g"]]
    assert got == expected


def test_quantiles_match_sorted_values(spark):
    rows = ranking.exact_quantiles(skewed(spark), ["g"], "x", {"q1": 0.25, "median": 0.5}).collect()
    values = {}
    for r in skewed(spark).collect():
        values.setdefault(r["g"], []).append(r["x"])
    for r in rows:
        assert r["median"] == statistics.median(values[r["g"]])
        if len(values[r["g"]]) > 1:
            assert abs(r["q1"] - statistics.quantiles(values[r["g"]], n=4, method="inclusive")[0]) < 1e-9


def test_stratified_sample_size_per_stratum(spark):
    df = skewed(spark)
    taken = {r["g"]: r["count"] for r in sampling.stratified_sample(df, "g", 300, ["id"]).groupBy("g").count().collect()}
    for r in df.groupBy("g").count().collect():
        assert taken.get(r["g"], 0) == int(r["count"] / 3000 * 300 + 0.5)
    again = sampling.stratified_sample(df.repartition(7), "g", 300, ["id"])
    assert again.exceptAll(sampling.stratified_sample(df, "g", 300, ["id"])).isEmpty()


def test_exact_fraction(spark):
    assert sampling.exact_fraction(skewed(spark), 0.1, ["id"]).count() == 300


def test_box_of_a_single_row_and_constant_group(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 1.0), ("b", 1.0)], "l string, v double")
    got = {r["l"]: (r["q1"], r["whisker_low"], r["whisker_high"], r["outliers"]) for r in reports.box_statistics(df, "l", "v").collect()}
    assert got == {"a": (5.0, 5.0, 5.0, 0), "b": (1.0, 1.0, 1.0, 0)}


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert [tuple(r) for r in reports.histogram(df, "v", 30).collect()] == [(1, 2)]


def test_components_against_union_find(spark):
    rng = random.Random(5)
    nodes = list(range(120))
    edges = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(50, 120), rng.randrange(50, 120)) for _ in range(45)]
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    both = [(a, b) for a, b in edges if a != b] + [(b, a) for a, b in edges if a != b]
    labels = clustering.connected_components(
        spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(both, "src long, dst long")
    )
    assert {r["node"]: r["label"] for r in labels.collect()} == {n: find(n) for n in nodes}


def test_copies_form_a_cluster_without_pairs(spark):
    points = [(i, [0.0, 0.0]) for i in range(500)] + [(1000, [5.0, 5.0]), (1001, [0.15, 0.0]), (1002, [0.35, 0.0])]
    df = spark.createDataFrame(points, "id long, v array<double>")
    got = {r["id"]: r["cluster"] for r in clustering.density_clusters(df, "id", "v", 0.1, 10, 5).collect()}
    assert got[0] == got[499] == got[1001] == 0
    assert got[1000] == got[1002] == -1


def test_bridge_users(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (None, "a"), (2, "a")], "user_id long, group_name string")
    assert tuple(reports.bridge_users(rows).first()) == (1, 1, 50.0, 2)
    assert {tuple(r) for r in reports.bridge_users_per_group(rows).collect()} == {("a", 2, 1), ("b", 1, 1)}
