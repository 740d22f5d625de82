"""Rows that are late or repeated: sorted out by a keyed state that forgets."""

import datetime as dt

from pyspark.sql import functions as F

from parlance.streaming import streams

SCHEMA = "k string, ts timestamp, v int, __moment string"


def at(hour):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour)


def test_fates_and_forgotten_keys(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    arrivals = [
        [("a", at(0), 1), ("a", at(1), 2), ("b", at(30), 3), (None, at(2), 4), ("c", None, 5)],
        [("a", at(1), 6), ("b", at(29), 7), ("b", at(40), 8), (None, at(3), 9)],  # the watermark is at hour 20
        [("d", at(500), 10)],
        [("d", at(501), 11)],
        [("d", at(1000), 12), ("a", at(995), 13)],
    ]
    for rows in arrivals:
        spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = streams.read_stream(spark, source, spark.createDataFrame([], SCHEMA).schema).drop("__moment")
        judged = streams.sort_out(stream, "ts", ["k"], "10 hours", poll_ms=1)
        streams.drain(judged, state, streams.batch_writer(out, ["fate"]), one_batch=True)
    found = {r["v"]: r["fate"] for r in spark.read.parquet(out).collect()}
    assert found == {
        1: "first", 2: "repeated", 3: "first", 4: "first", 5: "undated", 6: "late", 7: "repeated", 8: "repeated", 9: "late",
        10: "first", 11: "repeated", 12: "repeated", 13: "first",  # the watermark has not passed d when 12 comes
    }
    kept = spark.read.format("statestore").load(state).filter(F.col("value").isNotNull())
    assert kept.count() <= 2  # only the keys of the last hours are remembered


def test_null_and_long_keys_share_a_bucket(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    near = 2**62 + 1  # as floating point this and the next number are one
    rows = [(near, 1.0, at(1), 1), (near + 1, 1.0, at(2), 2), (None, 0.0, at(3), 3), (None, -0.0, at(4), 4), (near, 1.0, at(5), 5), (near, None, at(6), None)]
    spark.createDataFrame(rows, "k long, x double, ts timestamp, v long").coalesce(1).write.parquet(source)
    stream = streams.read_stream(spark, source, spark.read.parquet(source).schema)
    judged = streams.sort_out(stream, "ts", ["k", "x"], "10 hours", buckets=1)
    streams.drain(judged, state, streams.batch_writer(out, ["fate"]), one_batch=True)
    found = spark.read.parquet(out).select("k", "v", "fate").collect()
    assert {(r["k"], r["v"], r["fate"]) for r in found} == {
        (near, 1, "first"), (near + 1, 2, "first"), (None, 3, "first"), (None, 4, "repeated"), (near, 5, "repeated"), (near, None, "first")
    }
    assert spark.read.format("statestore").load(state).filter(F.col("value").isNotNull()).count() == 1


def test_streams_read_a_file_or_a_folder(spark, tmp_path):
    for name, files in (("one", 1), ("many", 3)):
        spark.range(30).repartition(files).write.parquet(str(tmp_path / f"{name}.parquet"))
    part = next((tmp_path / "one.parquet").glob("part-*"))
    for table, n in ((str(part), "a"), (str(tmp_path / "many.parquet"), "b")):
        rows = streams.read_table_stream(spark, table, spark.range(1).schema)
        streams.drain(rows, str(tmp_path / f"state-{n}"), streams.batch_writer(str(tmp_path / n)))
        assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / n)).collect()) == list(range(30))


def test_intervals():
    assert [streams.interval_ms(t) for t in ("1 second", "2 hours", "1 week")] == [1000, 7_200_000, 604_800_000]
