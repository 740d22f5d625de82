"""Quality measures, tests between models, topic quality and feature scores."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions.numbers import fixed_text, student_t_two_sided
from parlance.operators import classify, coherence, evaluation, features, joins, sampling, selection, topics, toxicity
from parlance.schemas import TOXICITY_SCORES

# Published accuracies of two models over five folds.
ACCURACY = {
    "MINILM_DT": [0.7535427260542842, 0.7544011123883722, 0.7546721817570314, 0.752086983148521, 0.7527194783420594],
    "MINILM_LR": [0.8129320168063009, 0.8140062546746917, 0.8119983334253631, 0.8122995216127623, 0.8126810266501348],
    "DISTILROBERTA_LR": [0.8270226041734643, 0.8292212779414792, 0.8265105842548855, 0.8262194356737329, 0.8267314555923116],
}


def log(spark):
    rows = [(m, i + 1, a) for m, values in ACCURACY.items() for i, a in enumerate(values)]
    return spark.createDataFrame(rows, "model string, fold int, accuracy double")


def test_merge_order_equals_one_pair_at_a_time(spark):
    import random

    from parlance.operators import topics

    for n, seed in ((14, 1), (9, 2), (2, 3)):
        rng = random.Random(seed)
        link = {(a, b): rng.random() for a in range(n) for b in range(a + 1, n)}
        rows = [(a, b, s) for (a, b), s in link.items()] + [(b, a, s) for (a, b), s in link.items()] + [(a, a, 1.0) for a in range(n)]
        size, expected = dict.fromkeys(range(n), 1), []
        while link:
            (a, b), s = min(link.items(), key=lambda item: (-round(item[1], 9), item[0]))
            expected.append((len(expected) + 1, a, b, round(s, 9), size[a] + size[b]))
            for c in size.keys() - {a, b}:
                left, right = link.pop((min(a, c), max(a, c))), link.pop((min(b, c), max(b, c)))
                link[min(a, c), max(a, c)] = (left * size[a] + right * size[b]) / (size[a] + size[b])
            del link[a, b]
            size[a] += size.pop(b)
        found = topics.merge_order(spark.createDataFrame(rows, "topic_a int, topic_b int, similarity double"))
        assert sorted((r["step"], r["kept"], r["merged"], round(r["similarity"], 9), r["topics"]) for r in found.collect()) == expected
    assert topics.merge_order(spark.createDataFrame([], "topic_a int, topic_b int, similarity double")).collect() == []


def test_spread_grid_checks_its_lists(spark):
    from parlance.operators import joins

    values = spark.createDataFrame([(1,), (2,)], "a int")
    lists = spark.createDataFrame([(["x", "y"], [0.1, 0.2, 0.3])], "b array<string>, c array<double>")
    assert len({tuple(r) for r in joins.spread_grid(values, lists).collect()}) == 12
    with pytest.raises(ValueError):
        joins.spread_grid(values, lists, 4)


def test_paired_tests_give_published_p_values(spark):
    got = {(r["model_a"], r["model_b"]): r for r in evaluation.paired_tests(log(spark), "accuracy", 5).collect()}
    assert got[("DISTILROBERTA_LR", "MINILM_LR")]["p_value"] == pytest.approx(4.3908e-07, rel=1e-3)
    assert got[("DISTILROBERTA_LR", "MINILM_DT")]["p_value"] == pytest.approx(1.2960e-08, rel=1e-3)
    assert got[("MINILM_DT", "MINILM_LR")]["p_value"] == pytest.approx(3.3643e-08, rel=1e-3)
    assert all(r["significant"] and math.isclose(r["alpha"], 0.05 / 3) for r in got.values())


def test_unequal_folds_are_an_error_row(spark):
    rows = evaluation.paired_tests(log(spark).filter("NOT (model = 'MINILM_DT' AND fold = 2)"), "accuracy", 5).collect()
    assert sorted(r["error"] or "" for r in rows) == ["", "unequal number of folds", "unequal number of folds"]


def test_model_table_text(spark):
    got = {r["model"]: r["accuracy"] for r in evaluation.model_table(log(spark), ["accuracy"]).collect()}
    for model, values in ACCURACY.items():
        assert got[model] == f"{np.mean(values) * 100:.2f} ({np.std(values) * 100:.2f})"


def test_student_t_odd_and_even_degrees(spark):
    frame = spark.createDataFrame([(2.0,)], "t double")
    # Textbook values of the two-sided probability at t = 2.
    for degrees, expected in {1: 0.295167, 2: 0.183503, 3: 0.139326, 4: 0.116117, 5: 0.101939, 9: 0.076553}.items():
        assert frame.select(student_t_two_sided(F.col("t"), degrees)).first()[0] == pytest.approx(expected, abs=1e-5)


def test_fixed_text(spark):
    frame = spark.createDataFrame([(0.0,), (-0.004,), (-1.235,), (12.5,), (0.05,)], "v double")
    assert [r[0] for r in frame.select(fixed_text(F.col("v"))).collect()] == ["0.00", "0.00", "-1.24", "12.50", "0.05"]


def test_quality_with_a_class_never_predicted(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "a"), ("b", "a"), ("c", "d")], "y string, p string")
    got = evaluation.quality(rows, "y", "p").first()
    assert got["accuracy"] == 0.5
    assert got["f1_macro"] == pytest.approx((0.8 + 0 + 0 + 0) / 4)
    matrix = {(r["y"], r["p"]): r["n"] for r in evaluation.confusion_matrix(rows, "y", "p").collect()}
    assert len(matrix) == 16 and matrix[("b", "a")] == 1 and matrix[("d", "d")] == 0


def test_unknown_classifier_names_the_choices():
    with pytest.raises(ValueError, match="dt.*lr.*rf"):
        classify.get_classifier("svm")


def test_tree_depth_beyond_spark_is_an_error():
    with pytest.raises(ValueError):
        classify.decision_tree(10, max_depth=50)


def test_score_batches_sees_bounded_batches(spark):
    rows = spark.range(1000).coalesce(1)
    sized = classify.score_batches(rows, lambda: lambda b: {"size": len(b)}, [T.StructField("size", T.LongType())], 256)
    assert sized.agg(F.max("size"), F.count("*")).first() == (256, 1000)


def brute_silhouette(vectors, labels):
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    distance = 1 - units @ units.T
    scores = []
    for i, label in enumerate(labels):
        own = [j for j, l in enumerate(labels) if l == label and j != i]
        if not own:
            scores.append(0.0)
            continue
        a = distance[i][own].mean()
        b = min(distance[i][[j for j, l in enumerate(labels) if l == other]].mean() for other in set(labels) - {label})
        scores.append((b - a) / max(a, b))
    return float(np.mean(scores))


def test_silhouette_against_brute_force(spark):
    rng = np.random.default_rng(3)
    labels = [0] * 20 + [1] * 15 + [2]
    vectors = rng.normal(size=(36, 5)) + np.array(labels)[:, None]
    rows = [(i, [float(x) for x in v], l) for i, (v, l) in enumerate(zip(vectors, labels))] + [(99, [1.0] * 5, -1)]
    df = spark.createDataFrame(rows, "id long, v array<double>, topic int")
    assert topics.silhouette_exact(df, "v").first()[0] == pytest.approx(brute_silhouette(vectors, labels), abs=1e-9)


def test_silhouette_of_one_topic_is_null(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0)], "id long, v array<double>, topic int")
    assert topics.silhouette_exact(df, "v").first()[0] is None
    assert topics.silhouette(df, "v") is None


def test_window_counts_against_spelled_out_windows(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(list("abcdefgh"), size=n)) for n in (0, 3, 109, 110, 111, 400)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    words = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (1, 1, "b"), (1, 2, "zz")], "topic int, rank int, term string")
    got = {(r["topic"], r["i"], r["j"]): r["n"] for r in coherence.window_counts(df, ["id"], "text", words, 110).collect()}
    windows = []
    for t in texts:
        tokens = t.split()
        windows += [set(tokens[s : s + 110]) for s in range(max(len(tokens) - 109, 1))]
    assert got == {
        (0, 1, 1): sum("a" in w for w in windows), (0, 2, 2): sum("b" in w for w in windows),
        (0, 1, 2): sum({"a", "b"} <= w for w in windows), (1, 1, 1): sum("b" in w for w in windows),
    }
    assert coherence.window_total(df, "text", 110).first()[0] == len(windows)


def test_outliers_move_only_above_the_threshold(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 1), (3, [0.9, 0.1], -1), (4, [-1.0, -1.0], -1)]
    df = spark.createDataFrame(rows, "id long, v array<double>, topic int")
    assert {r["id"]: r["topic"] for r in topics.reduce_outliers(df, "v", 0.55).collect()} == {1: 0, 2: 1, 3: 0, 4: -1}


def test_grid_search_records_failures_and_resumes(spark, tmp_path):
    grid = spark.createDataFrame([(1,), (2,)], "k int")
    calls = []

    def run(settings):
        calls.append(settings["k"])
        if settings["k"] == 1:
            raise RuntimeError("too few")
        return {"n_topics": 2, "silhouette": 0.5}

    for _ in range(2):
        results = {r["k"]: r for r in topics.grid_search(spark, grid, run, str(tmp_path / "grid")).collect()}
    assert sorted(calls) == [1, 2]
    assert results[1]["error"] == "too few" and results[2]["silhouette"] == 0.5


def gini(labels):
    return 1 - sum((labels.count(l) / len(labels)) ** 2 for l in set(labels)) if labels else 0.0


def test_gini_ranking_against_brute_force(spark):
    rng = np.random.default_rng(7)
    data = [(float(rng.integers(0, 9)), float(rng.normal()), str(rng.integers(0, 3))) for _ in range(120)]
    df = spark.createDataFrame(data, "a double, b double, y string")
    labels = [d[2] for d in data]
    for n in (None, 10):
        for r in selection.gini_ranking(df, ["a", "b"], "y", n).collect():
            column = [d[0 if r["attribute"] == "a" else 1] for d in data]
            left = [l for v, l in zip(column, labels) if v <= r["split"] + 1e-12]
            right = [l for v, l in zip(column, labels) if v > r["split"] + 1e-12]
            gain = gini(labels) - len(left) / 120 * gini(left) - len(right) / 120 * gini(right)
            assert r["gini_gain"] == pytest.approx(gain, abs=1e-9)
    thresholds = sorted(r["split"] for r in selection.gini_ranking(df, ["b"], "y", 10).collect())
    assert thresholds == pytest.approx(list(np.percentile(np.unique([d[1] for d in data]), np.linspace(0, 100, 10))))


def test_select_top_skips_correlated_features(spark):
    rows = [(float(i), float(i * 2), float((i * 37) % 40), "x" if i < 20 else "y") for i in range(40)]
    df = spark.createDataFrame(rows, "a double, twice double, noise double, y string")
    names = ["a", "twice", "noise"]
    top = selection.select_top(df, names, selection.gini_ranking(df, names, "y"), 2, 0.7).collect()
    assert [r["attribute"] for r in top] == ["a", "noise"]


def test_feature_names_are_220_and_distinct(spark):
    names = features.feature_names()
    assert len(names) == len(set(names)) == 220
    kept = features.language_features(["t_word", "fkre", "t_kup", "own"], features.feature_metadata(spark), "pt")
    assert kept == ["t_word", "own"]


def test_features_of_empty_and_missing_text_are_zero(spark):
    lookup = features.token_lookup(spark.createDataFrame([("cat", "noun", "cat")], "token string, tag string, lemma string"))
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "Cat! 3 cats.")], "id long, text string")
    got = {r["id"]: r for r in features.linguistic_features(docs, ["id"], "text", lookup, ["the"]).collect()}
    assert all(got[i][n] == 0 for i in (1, 2) for n in features.feature_names())
    assert (got[3]["t_word"], got[3]["t_sent"], got[3]["n_noun"], got[3]["n_num"], got[3]["n_punct"]) == (3, 2, 2, 1, 2)


def test_blank_text_scores_zero(spark):
    rows = [(f"bad word {i}", *[float(i % 2)] * 6) for i in range(10)] + [(f"fine {i}", *[float(i % 2)] * 6) for i in range(10)]
    df = spark.createDataFrame(rows, "text string, " + ", ".join(f"{s} double" for s in TOXICITY_SCORES))
    model = toxicity.fit_scorer(df, "text", dimensions=64, max_iter=3)
    docs = spark.createDataFrame([(1, None), (2, "  "), (3, "bad")], "id long, text string")
    got = {r["id"]: r for r in toxicity.score(docs, "text", *model).collect()}
    assert got[1]["toxicity"] == got[2]["insult"] == 0.0 and 0 < got[3]["toxicity"] < 1
    assert got[1]["text"] is None


def test_constant_metric_scales_to_zero(spark):
    df = spark.createDataFrame([("m", 0.1, 0.5, 0.2), ("m", 0.3, 0.5, None)], "model string, silhouette double, diversity double, coherence_cv double")
    got = sorted(sampling.add_normalised_scores(df).collect(), key=lambda r: r["silhouette"])
    assert [r["diversity_norm"] for r in got] == [0.0, 0.0]
    assert got[1]["score_sc"] == pytest.approx((1.0 + 0.0) / 2)


def test_lookup_by_text_covers_all_copies(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None)], "id long, text string")
    unique = spark.createDataFrame([("x", 7)], "text string, topic int")
    assert {r["id"]: r["topic"] for r in joins.lookup_by_text(rows, unique, "text", "topic").collect()} == {1: 7, 2: 7, 3: None, 4: None}


def test_rank_correlation_leaves_nulls_out_pair_by_pair(spark):
    rows = [(1.0, 2.0, None), (2.0, 1.0, 1.0), (3.0, 4.0, 2.0), (4.0, 3.0, None), (5.0, 5.0, 3.0)]
    long = selection.spearman_matrix(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"]).collect()
    found = {(r["feature_a"], r["feature_b"]): r["correlation"] for r in long}
    assert len(found) == len(long) == 9
    assert found["a", "b"] == pytest.approx(0.8) and found["a", "c"] == pytest.approx(1.0) and found["b", "c"] == pytest.approx(1.0)


def test_search_does_not_depend_on_partitions(spark):
    from pyspark.ml.functions import array_to_vector

    rows = [(i, float(i % 3 == 0), [float(i % 3), float((i * 7) % 5)]) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, label double, v array<double>").withColumn("features", array_to_vector("v"))
    grid = {"C": [0.01, 1.0], "max_iter": [20], "balanced": [True]}
    found = [classify.search(df.repartition(n), "lr", grid, ["id"], 3)[1:] for n in (2, 8)]
    assert found[0][0] == found[1][0] and found[0][1] == pytest.approx(found[1][1])


def test_labels_and_clusters_are_numbered_in_order(spark):
    rows = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("a",)], "y string")
    assert {r["y"]: r["label_index"] for r in evaluation.encode_labels(rows, "y").collect()} == {"a": 0, "b": 1, "c": 2, None: None}


def test_groups_of_nulls_are_reported(spark):
    from parlance.operators import reports

    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None)], "g string, v double")
    box = {r["g"]: r for r in reports.box_statistics(rows, "g", "v").collect()}
    assert (box["a"]["n"], box["a"]["median"], box["b"]["n"], box["b"]["median"], box["b"]["outliers"]) == (2, 2.0, 0, None, 0)
    assert {r["g"]: r["count"] for r in reports.describe(rows, "v", ["g"]).collect()} == {"a": 2, "b": 0}
    assert reports.median_of(rows.filter("g = 'b'"), "v").first()["n"] == 0


def test_lowest_of_repeated_scores_counts(spark):
    from parlance.operators import reports

    rows = spark.createDataFrame([("2024-01-01", "x", 1, 5.0), ("2024-01-01", "x", 1, 3.0)], "t string, l string, k long, s double")
    for order in ("s", "-s"):
        dated = rows.orderBy(F.expr(order)).withColumn("t", F.to_timestamp("t"))
        assert reports.weekly_mean(dated, "t", "l", "s", ["k"]).first()["mean_score"] == 3.0


def test_hash_sample_does_not_depend_on_partitions(spark):
    rows = spark.range(2000)
    taken = [sorted(r["id"] for r in sampling.approximate_fraction(rows.repartition(n), 0.1, ["id"]).collect()) for n in (2, 7)]
    assert taken[0] == taken[1] and 120 < len(taken[0]) < 280
    assert sampling.approximate_fraction(rows, 1.0, ["id"]).count() == 2000 and sampling.approximate_fraction(rows, 0.0, ["id"]).count() == 0


def test_a_date_is_no_cardinal(spark):
    rows = spark.createDataFrame([(1, "On 2024-01-02 at 10:30 we paid $5.50, 20% of 27 for 3 kg, the 2nd time"), (2, None)], "id long, text string")
    found = {r["id"]: r.asDict() for r in features.add_pattern_entities(rows, "text").collect()}
    assert {k[8:]: v for k, v in found[1].items() if k.startswith("t_n_ent_")} == {
        "date": 1, "time": 1, "percent": 1, "money": 1, "quantity": 1, "ordinal": 1, "cardinal": 1}
    assert not any(v for k, v in found[2].items() if k.startswith("t_n_ent_"))
