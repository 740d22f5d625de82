"""Tag models, Viterbi paths and lemmas by part of speech against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.operators import tagging

TAGGED = [
    (1, 0, "the", "DT"), (1, 1, "saw", "NN"), (1, 2, "cuts", "VB"), (2, 0, "they", "PR"), (2, 1, "saw", "VB"), (2, 2, "cuts", "NN"),
    (3, 0, "the", "DT"), (3, 1, "cuts", "NN"), (3, 2, "hurt", "VB"), (4, 0, "they", "PR"), (4, 1, "cuts", "VB"), (4, 2, None, "VB"), (4, 3, "x", None),
]


@pytest.fixture(scope="module")
def model(spark):
    return tagging.learn_tags(spark.createDataFrame(TAGGED, "s int, position int, token string, tag string"), ["s"])


def brute_path(scores, start, follow):
    """All paths; of the best ones the one with the smaller tag numbers from the end on."""
    n, tags = len(scores), range(len(start))

    def value(path):
        return start[path[0]] + sum(scores[i][t] for i, t in enumerate(path)) + sum(follow[a][b] for a, b in itertools.pairwise(path))

    paths = list(itertools.product(tags, repeat=n))
    best = max(map(value, paths))
    return min((p for p in paths if value(p) == best), key=lambda p: p[::-1])


@pytest.mark.parametrize("seed", range(4))
def test_best_paths_against_all_paths(seed):
    rng = random.Random(seed)
    start, follow = [rng.randrange(-3, 1) for _ in range(3)], [[rng.randrange(-3, 1) for _ in range(3)] for _ in range(3)]
    texts = [[[rng.randrange(-3, 1) for _ in range(3)] for _ in range(rng.choice([0, 1, 2, 5, 7]))] for _ in range(12)]
    flat = np.array([w for t in texts for w in t], np.int64).reshape(-1, 3)
    found = tagging.best_paths(flat, np.array([len(t) for t in texts]), np.array(start), np.array(follow)).tolist()
    assert found == [t for text in texts if text for t in brute_path(text, start, follow)]


def test_no_texts_at_all():
    assert tagging.best_paths(np.zeros((0, 2), np.int64), np.zeros(0, np.int64), np.zeros(2), np.zeros((2, 2))).tolist() == []


def test_model_counts(model):
    assert model.tags == ["DT", "NN", "PR", "VB"]
    assert model.start == [tagging.log_share(n + 1, 8) for n in (2, 0, 2, 0)]
    assert model.follow[model.tags.index("DT")] == [tagging.log_share(n + 1, 6) for n in (0, 2, 0, 0)]
    scores = {r["token"]: r["scores"] for r in model.words.collect()}
    assert scores["saw"] == [tagging.log_share(n + 1, t + 6) for n, t in zip((0, 1, 0, 1), (2, 3, 2, 4), strict=True)]
    assert len(model.unknown) == 4 and max(model.unknown) == model.unknown[model.tags.index("VB")]


ROWS = [
    (1, ["the", "saw", "cuts"]), (2, ["they", "saw", "cuts"]), (3, []), (4, None), (5, ["zzz"]), (6, ["they", None, "cuts"]), (7, ["the"] * 3000),
]


def test_context_decides(spark, model):
    rows = spark.createDataFrame(ROWS, "id int, words array<string>")
    tags = {r["id"]: r["tags"] for r in tagging.tag_words(rows, "words", model).collect()}
    assert tags[1] == ["DT", "NN", "VB"] and tags[2] == ["PR", "VB", "NN"]
    assert tags[3] == [] and tags[4] is None and len(tags[5]) == 1 and len(tags[6]) == 3 and len(tags[7]) == 3000


def test_joined_model_tags_alike(spark, model):
    rows = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "id int, words array<string>, token string, position int")
    sent = tagging.tag_words(rows, "words", model).select("id", "tags").collect()
    joined = tagging.tag_words(rows, "words", model, max_word_bytes=0, key="id")
    assert joined.columns == ["id", "words", "token", "position", "tags"]
    assert sorted(map(tuple, sent)) == sorted(map(tuple, joined.select("id", "tags").collect()))
    with pytest.raises(ValueError):
        tagging.tag_words(rows, "words", model, max_word_bytes=0)


def test_lemmas_by_tag(spark, model):
    dictionary = spark.createDataFrame(
        [("saw", "NN", "saw"), ("saw", "VB", "see"), ("cuts", "NN", "cut"), ("saw", "VB", "zee")], "token string, tag string, lemma string"
    )
    rows = spark.createDataFrame(ROWS[:5], "id int, words array<string>")
    found = tagging.normalise_tagged(rows, "words", ["id"], model, dictionary)
    assert {r["id"]: r["clean_text"] for r in found.collect()} == {1: "the saw cuts", 2: "they see cut", 3: "", 4: "", 5: "zzz"}


def test_too_many_tags_and_none(spark):
    schema = "s int, position int, token string, tag string"
    with pytest.raises(ValueError):
        tagging.learn_tags(spark.createDataFrame([], schema), ["s"])
    with pytest.raises(ValueError):
        tagging.learn_tags(spark.createDataFrame([(1, i, "a", f"t{i}") for i in range(101)], schema), ["s"])


def test_coarse_tags(spark):
    rows = spark.createDataFrame([("JJR",), ("VBZ",), ("NNS",), ("RB",), ("CD",), (None,)], "t string")
    assert [r[0] for r in rows.select(tagging.coarse_tag(F.col("t"))).collect()] == ["adj", "verb", "noun", "adv", "noun", "noun"]
