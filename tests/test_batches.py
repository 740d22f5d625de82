"""Word lists in slices, tables spread by size, ranks from counts."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from parlance import session
from parlance.functions import batches
from parlance.operators import lemmas, selection, toxicity


def test_slices_of_lists_are_bounded_and_whole():
    rows = [["a"] * 3, None, [], ["b"] * 9, ["c"], ["d"] * 2, None]
    column = pa.array([["x"], *rows], pa.list_(pa.string())).slice(1)
    parts = [p.to_pylist() for p in batches.list_slices(column, 4)]
    assert sum(parts, []) == rows and len(parts) > 2
    assert all(len(p) == 1 or sum(len(x or []) for x in p) <= 4 for p in parts)
    assert [len(p) for p in batches.list_slices(column.slice(0, 0), 4)] == [0]


def test_lemmas_and_scores_over_many_slices(spark, monkeypatch):
    rng = random.Random(5)
    texts = [(i, rng.choice([None, "", " ".join(rng.choice(["cats", "dogs", "barked", "ünseen"]) for _ in range(rng.randrange(40)))])) for i in range(300)]
    docs = spark.createDataFrame(texts, "id long, text string").coalesce(1)
    known = spark.createDataFrame([("cats", "cat"), ("barked", "bark")], "token string, lemma string")
    found = {r["id"]: r["clean_text"] for r in lemmas.normalise(docs, "text", ["id"], known).collect()}
    assert found == {i: (t or "").replace("cats", "cat").replace("barked", "bark") for i, t in texts}
    lexicon = spark.createDataFrame([("cats", 0.5, 0.1), ("barked", 1.0, 0.0)], "token string, a double, b double")
    scored = toxicity.lexicon_scores(docs, ["id"], "text", lexicon, ["a", "b"]).collect()
    for row in scored:
        words = (row["text"] or "").split()
        n = max(len(words), 1)
        assert abs(row["a"] - (words.count("cats") * 0.5 + words.count("barked")) / n) < 1e-12
        assert abs(row["b"] - words.count("cats") * 0.1 / n) < 1e-12


def test_spread_grows_with_the_table(spark, tmp_path, monkeypatch):
    spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text")).coalesce(1).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    assert session.spread(table, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(session, "SPREAD_BYTES", 1 << 14)
    wide = session.spread(table, "id")
    assert wide.rdd.getNumPartitions() > 4 * spark.sparkContext.defaultParallelism and wide.count() == 20_000


def test_centred_ranks_share_ties(spark):
    rng = random.Random(2)
    rows = [(float(rng.randrange(5)), rng.choice([-0.0, 0.0, 1.5]), float(i % 7 == 0)) for i in range(200)]
    found = selection.centred_ranks(spark.createDataFrame(rows, "a double, b double, c double").repartition(5), ["a", "b", "c"]).collect()
    values = np.array(rows)
    ranks = np.stack([(values[:, None, i] > values[None, :, i]).sum(1) + ((values[:, None, i] == values[None, :, i]).sum(1) - 1) / 2 - 99.5 for i in range(3)], 1)
    assert sorted(tuple(r) for r in found) == sorted(map(tuple, ranks.tolist()))
