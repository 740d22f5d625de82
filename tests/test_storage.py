"""Readers, sinks, logs and streams."""

import gzip

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.schemas import EXPERIMENT_LOG, RAW_MESSAGE
from parlance.sources import messages as src
from parlance.sources import sinks
from parlance.sources.runlog import parse_run_log
from parlance.streaming import streams

HEADER = "\t".join(f.name for f in RAW_MESSAGE)


def write_dump(folder, name, lines):
    folder.mkdir(parents=True, exist_ok=True)
    with gzip.open(folder / name, "wt", encoding="utf-8", newline="") as f:
        f.write("\n".join([HEADER, *lines]) + "\n")


def row(i, text):
    return "\t".join([str(i), "7", text, "1704067200", "false", "", "", "", "true", "", "", "1", "2", "3", "4", '"{""a"": 1}"'])


def test_dump_with_quotes_tabs_and_line_breaks(spark, tmp_path):
    write_dump(tmp_path / "extracted" / "g1", "channel_12-a.tsv.gz", [row(1, '"a ""b""\tc\nd"'), row(2, "plain")])
    (tmp_path / "extracted" / "g2").mkdir()
    (tmp_path / "extracted" / "g2" / "broken.tsv.gz").write_bytes(b"not gzip at all")
    rows = src.add_lineage(src.read_dump(spark, str(tmp_path / "extracted"))).orderBy("id").collect()
    assert [(r["id"], r["text"], r["group_name"], r["fwd_flag"], r["reaction_json"]) for r in rows] == [
        (1, 'a "b"\tc\nd', "g1", True, '{"a": 1}'), (2, "plain", "g1", True, '{"a": 1}'),
    ]


def test_batches_log_failures_and_go_on(spark, tmp_path):
    for g in ("g1", "g2", "g3"):
        write_dump(tmp_path / "extracted" / g, "a.tsv.gz", [row(1, g)])

    def read(session, paths):
        if any("g2" in p for p in paths):
            raise OSError("disk")
        return src.add_lineage(src.read_dump(session, paths))

    paths = [str(tmp_path / "extracted" / g / "a.tsv.gz") for g in ("g1", "g2", "g3")]
    ledger = sinks.convert_in_batches(spark, paths, read, str(tmp_path / "out"), str(tmp_path / "ledger"), 1)
    assert [(r["batch"], r["status"], r["error"]) for r in ledger.orderBy("batch").collect()] == [
        (1, "done", None), (2, "failed", "disk"), (3, "done", None)
    ]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    good = lambda session, some: src.add_lineage(src.read_dump(session, some))
    again = sinks.convert_in_batches(spark, paths, good, str(tmp_path / "out"), str(tmp_path / "ledger"), 1)
    assert sorted((r["batch"], r["status"]) for r in again.collect()) == [(1, "done"), (2, "failed"), (3, "done"), (4, "done")]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    assert [p.rsplit("/", 2)[1] for p in src.list_dump(spark, str(tmp_path / "extracted"))] == ["g1", "g2", "g3"]


class Killed(BaseException):
    """Ends a run like a lost driver: nothing catches it."""


@pytest.mark.parametrize("dies_at", ["begun", "written", "done"])
@pytest.mark.parametrize("batch", [1, 2])
def test_a_killed_conversion_loses_and_repeats_nothing(spark, tmp_path, monkeypatch, dies_at, batch):
    paths = [str(tmp_path / "extracted" / g / "a.tsv.gz") for g in ("g1", "g2", "g3")]
    for i, g in enumerate(("g1", "g2", "g3")):
        write_dump(tmp_path / "extracted" / g, "a.tsv.gz", [row(i, g)])
    read = lambda session, some: src.add_lineage(src.read_dump(session, some))
    append = sinks.append_log

    def dying(rows, path, schema):
        state = rows.first()
        if state["batch"] == batch and (state["status"], dies_at) in (("begun", "begun"), ("done", "written")):
            raise Killed
        append(rows, path, schema)
        if state["batch"] == batch and state["status"] == dies_at == "done":
            raise Killed

    monkeypatch.setattr(sinks, "append_log", dying)
    out, ledger = str(tmp_path / "out"), str(tmp_path / "ledger")
    with pytest.raises(Killed):
        sinks.convert_in_batches(spark, paths, read, out, ledger, 1)
    monkeypatch.setattr(sinks, "append_log", append)
    again = sinks.convert_in_batches(spark, paths, read, out, ledger, 1)
    assert sorted((r["batch"], r["status"]) for r in again.collect()) == [(1, "done"), (2, "done"), (3, "done")]
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [0, 1, 2]
    assert sinks.convert_in_batches(spark, paths, read, out, ledger, 1).count() == 3


def test_overwrite_is_idempotent_and_resume_adds_only_new_periods(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, 2024, 1), (2, 2024, 2), (3, None, 2)], "id long, year int, month int")
    for _ in range(2):
        sinks.overwrite_periods(df, path)
    assert spark.read.parquet(path).count() == 3  # a row without a year has a partition of its own
    more = spark.createDataFrame([(9, 2024, 2), (4, 2024, 3)], "id long, year int, month int")
    sinks.resume_by_period(more, path, lambda rows: rows)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 2, 3, 4]


def test_log_keeps_its_columns_when_a_row_lacks_some(spark, tmp_path):
    path = str(tmp_path / "log")
    assert sinks.read_log(spark, path, EXPERIMENT_LOG).count() == 0
    sinks.append_log(spark.createDataFrame([("lr", 1, 0.5)], "model string, fold int, accuracy double"), path, EXPERIMENT_LOG)
    sinks.append_log(spark.createDataFrame([("dt",)], "model string"), path, EXPERIMENT_LOG)
    assert {(r["model"], r["accuracy"]) for r in sinks.read_log(spark, path, EXPERIMENT_LOG).collect()} == {("lr", 0.5), ("dt", None)}


def test_run_log_with_failed_and_cut_off_combinations(spark, tmp_path):
    text = """noise
[1/2] Modelo de embedding: enc-a
[1/3] {'k': 5, 'metric': 'cosine', 'flag': True, 'none': None}
   -> Outliers (ruído): 10 (2.5%)
   -> Silhoueta: nan
   -> Diversidade: 0.8
   -> Coerência (c_v): 0.4
[2/3] {'k': 6, 'metric': 'cosine'}
   -> Falhou: out of memory
[3/3] {'k': 7, 'metric': 'cosine'}
[2/2] Modelo de embedding: enc-b
[1/3] {'k': 5, 'metric': 'cosine'}
   -> Outliers (ruído): 0 (0.0%)
   -> Silhoueta: -0.25
"""
    (tmp_path / "run.log").write_text(text, encoding="utf-8")
    parsed = parse_run_log(src.read_lines(spark, str(tmp_path / "run.log")), ["k", "metric", "flag", "none"])
    got = [tuple(r) for r in parsed.orderBy("run").select("embedding_model", "combo_idx", "k", "flag", "n_outliers", "diversity", "error").collect()]
    assert got == [
        ("enc-a", 1, "5", "true", 10, 0.8, None), ("enc-a", 2, "6", None, None, None, "out of memory"), ("enc-b", 1, "5", None, 0, None, None),
    ]
    # The same lines cut into blocks of three give the same rows.
    lines = [(1, i // 3, i, v) for i, v in enumerate(text.splitlines())]
    blocked = parse_run_log(spark.createDataFrame(lines, "file int, block long, line long, value string"), ["k"])
    assert [r["embedding_model"] for r in blocked.orderBy("run").collect()] == ["enc-a", "enc-a", "enc-b"]


def test_keyed_json_refuses_large_reports(spark):
    df = spark.range(5).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    assert sinks.keyed_json(df, "k").first()["value"].startswith('{"0":{"v":1}')
    try:
        sinks.keyed_json(df, "k", max_keys=3)
        raise AssertionError("accepted")
    except ValueError:
        pass


SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("g", T.StringType())])


def arrive(spark, folder, rows):
    frame = spark.createDataFrame(rows, "id long, ts string, g string").withColumn("ts", F.col("ts").cast("timestamp"))
    frame.coalesce(1).write.mode("append").parquet(folder)


def test_stream_continues_and_drops_repetitions(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    arrive(spark, source, [(1, "2024-01-01 10:00:00", "a"), (1, "2024-01-01 10:05:00", "a"), (2, "2024-01-01 10:06:00", "a")])

    def run():
        unique = streams.drop_duplicates(streams.read_stream(spark, source, SCHEMA), "ts", ["id"], "1 hour")
        streams.drain(unique, state, streams.batch_writer(sink))

    run()
    arrive(spark, source, [(2, "2024-01-01 10:20:00", "a"), (3, "2024-01-01 10:30:00", "a")])
    run()
    assert sorted(r["id"] for r in streams.read_appended(spark, sink, SCHEMA).collect()) == [1, 2, 3]


def test_late_rows_are_dropped_and_counts_are_updated(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def run():
        counts = streams.tumbling_counts(streams.read_stream(spark, source, SCHEMA), "ts", ["g"], "1 day")
        streams.drain(counts, state, streams.batch_writer(sink), "update")

    arrive(spark, source, [(1, "2024-01-10 10:00:00", "a")])
    run()
    arrive(spark, source, [(2, "2024-01-10 11:00:00", "a"), (3, "2024-01-01 00:00:00", "a")])
    run()
    got = [(str(r["window_start"].date()), r["rows"]) for r in streams.read_updated(spark, sink, ["window_start", "g"]).collect()]
    assert got == [("2024-01-10", 2)]


def test_rows_without_a_period_are_kept_and_resumed(spark, tmp_path):
    path = str(tmp_path / "periods")
    rows = spark.createDataFrame([(1, 2024, 1), (2, None, None), (3, 2024, None)], "id long, year int, month int")
    sinks.overwrite_periods(rows.filter("id <> 3"), path)
    assert [r["id"] for r in sinks.pending_periods(rows, spark.read.parquet(path)).collect()] == [3]
    sinks.resume_by_period(rows, path, lambda todo: todo)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_a_bad_period_does_not_stop_the_others(spark, tmp_path):
    path = str(tmp_path / "isolated")
    rows = spark.createDataFrame([(1, 2024, 1), (2, 2024, 2), (3, None, None)], "id long, year int, month int")
    bad = lambda part: part.filter(F.when(F.col("month") == 1, F.raise_error(F.lit("x" * 900))).otherwise(F.lit(True)))
    ledger = {r["month"]: r for r in sinks.run_by_period(rows, path, bad).collect()}
    assert {m: r["status"] for m, r in ledger.items()} == {1: "failed", 2: "done", None: "done"} and "x" * 900 in ledger[1]["error"]
    again = sinks.run_by_period(rows, path, lambda part: part).collect()
    assert [(r["month"], r["status"]) for r in again] == [(1, "done")] and spark.read.parquet(path).count() == 3


def test_release_leaves_nothing_in_the_shared_folder(spark):
    import os

    from parlance.session import release, saved, scratch_paths

    saved(spark.range(3), "probe")
    made = [p for p in scratch_paths if "/probe-" in p]
    assert made and os.path.exists(made[-1])
    release(spark, made)
    assert not any(os.path.exists(p) or p in scratch_paths for p in made)
