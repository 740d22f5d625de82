"""Distinct counts that add up, against sets."""

import random

import pytest

from parlance.operators import bitmaps

SCHEMA = "period string, grp string, num long, bits string, bucket int"


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def some_rows(seed, n=400):
    rng = random.Random(seed)
    numbers = [0, -1, 32_767, 32_768, 10**12, None, *range(100)]
    return [(rng.choice(["p1", "p2", None]), rng.choice(["a", "b", None]), rng.choice(numbers)) for _ in range(n)]


@pytest.mark.parametrize("keys", [["period", "grp"], ["grp"], []])
def test_counts_equal_sets(spark, keys):
    rows = some_rows(1)
    found = bitmaps.counted(bitmaps.distinct_bitmaps(rows_of(spark, rows), ["period", "grp"], "num"), keys)
    place = {"period": 0, "grp": 1}
    sets = {}
    for r in rows:
        if r[2] is not None:
            sets.setdefault(tuple(r[place[k]] for k in keys), set()).add(r[2])
    assert {tuple(r[k] for k in keys): r["n"] for r in found.collect()} == {k: len(v) for k, v in sets.items()}


def test_increments_overlap_and_may_be_repeated(spark, tmp_path):
    path, rows = str(tmp_path / "bits"), [r for r in some_rows(2) if r[0]]
    for part in (rows[:250], rows[100:], rows[100:], []):
        bitmaps.add_to_bitmaps(rows_of(spark, part), ["period"], ["grp"], "num", path)
    found = bitmaps.counted(spark.read.parquet(path), ["grp"])
    assert {r["grp"]: r["n"] for r in found.collect()} == {g: len({r[2] for r in rows if r[1] == g} - {None}) for g in ("a", "b", None)}


def test_no_rows(spark):
    assert bitmaps.counted(bitmaps.distinct_bitmaps(rows_of(spark, []), ["grp"], "num"), ["grp"]).collect() == []
