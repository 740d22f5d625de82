"""Names of several words against brute force."""

import random

import pytest

from parlance.operators import entities

NAMES = [
    ("New York", "gpe"), ("new york city", "gpe"), ("York", "org"), ("york city council", "org"), ("Ann", "person"), ("U.S.", "gpe"), ("Ann", "org"),
    ("", "org"), (None, "org"), ("nobody", None), ("city  HALL", "fac"),
]
TEXTS = [
    (1, "Ann went to New York City Hall."), (2, "york city council of new york"), (3, None), (4, ""), (5, "The U.S. of New, York"),
    (6, "ann ann\nANN"), (7, "newyork anne"), (8, "new york city council"), (9, "x " * 5000 + "new york"),
]
FOUND = [
    (1, 0, 1, "ann", "org"), (1, 3, 3, "new york city", "gpe"), (2, 0, 3, "york city council", "org"), (2, 4, 2, "new york", "gpe"),
    (5, 1, 4, "u . s .", "gpe"), (5, 8, 1, "york", "org"), (6, 0, 1, "ann", "org"), (6, 1, 1, "ann", "org"), (6, 2, 1, "ann", "org"),
    (8, 0, 3, "new york city", "gpe"), (9, 5000, 2, "new york", "gpe"),
]


def frames(spark, names=NAMES, texts=TEXTS):
    rows = spark.createDataFrame([(i, t, 0, "x", "y") for i, t in texts], "id int, text string, start int, tokens string, entity string")
    return rows, spark.createDataFrame(names, "name string, entity string")


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_leftmost_longest_names(spark, most):
    rows, names = frames(spark)
    found = entities.find_entities(rows, ["id"], "text", names, most)
    assert sorted(map(tuple, found.select("id", "start", "words", "name", "entity").collect())) == FOUND


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_no_names_and_no_texts(spark, most):
    rows, names = frames(spark)
    assert entities.find_entities(rows.limit(0), ["id"], "text", names, most).collect() == []
    assert entities.find_entities(rows, ["id"], "text", names.limit(0), most).collect() == []


def brute(words, names):
    at = 0
    while at < len(words):
        n = max((n for n in range(1, 5) if at + n <= len(words) and tuple(words[at : at + n]) in names), default=0)
        if n:
            yield at, n, " ".join(words[at : at + n]), names[tuple(words[at : at + n])]
        at += n or 1


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_overlapping_names_against_brute_force(spark, most):
    rng = random.Random(4)
    names = {tuple(rng.choices("abc", k=rng.randrange(1, 5))): rng.choice(["org", "gpe"]) for _ in range(25)}
    texts = [(i, rng.choices("abcd", k=rng.randrange(60))) for i in range(60)]
    rows, gazetteer = frames(spark, [(" ".join(n), e) for n, e in names.items()], [(i, " ".join(t)) for i, t in texts])
    found = entities.find_entities(rows, ["id"], "text", gazetteer, most).select("id", "start", "words", "name", "entity").collect()
    assert sorted(map(tuple, found)) == sorted((i, *m) for i, t in texts for m in brute(t, names))


def test_counts_per_type(spark):
    rows, names = frames(spark)
    counts = {r["id"]: r for r in entities.entity_counts(rows, ["id"], "text", names, ["gpe", "org", "person"]).collect()}
    assert (counts[1]["t_n_ent_gpe"], counts[1]["t_n_ent_org"], counts[1]["t_n_ent"], counts[1]["a_n_ent_pt"]) == (1, 1, 2, 0.25)
    assert counts[3]["t_n_ent"] == 0 and counts[4]["a_n_ent_pt"] == 0.0 and len(counts) == len(TEXTS)
