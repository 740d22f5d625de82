"""Incremental versions of ingest, duplicate removal, counts, mean scores and inference.

Every run drains what has arrived and stops (``availableNow``); the checkpoint folder remembers what was
read, so running again continues. Sinks write per micro-batch under the batch number, which makes
a repeated batch replace its own output.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Transformer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parlance.operators import filters
from parlance.operators.classify import predict
from parlance.operators.lemmas import normalise
from parlance.sources import sinks

BATCH = "batch"


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType, name_filter: str | None = None, files_per_batch: int | None = None
) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def read_table_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table as a stream, whether it is stored as one file or as a folder of files.

    Spark takes the path of a stream for a folder; a pattern that only this path matches is listed either way.
    """
    return read_stream(spark, f"{path[:-1]}[{path[-1]}]", schema)


def drain(
    stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append", one_batch: bool = False
) -> None:
    """Process everything available now and wait for the end.

    Streams with timers of processing time need ``one_batch``: Spark would otherwise go on with empty batches to serve the timers.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    query = writer.trigger(**({"once": True} if one_batch else {"availableNow": True})).foreachBatch(write).start()
    query.awaitTermination()


def batch_writer(path: str, partitions: Sequence[str] = ()) -> Callable[[DataFrame, int], None]:
    """A sink that stores each micro-batch in its own partition and replaces it when the batch repeats."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn(BATCH, F.lit(number)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy(*partitions, BATCH).parquet(path)

    return write


def read_appended(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of an append sink."""
    if not sinks.table_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.parquet(path).drop(BATCH)


def read_updated(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The latest state of every key of an update sink."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, BATCH)]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), BATCH).alias("__v"))
    return latest.select(*keys, "__v.*")


def ingest(
    stream: DataFrame, text: str, epoch: str, path: str, checkpoint: str, stopwords: Sequence[str] = (),
    partitions: int | None = None,
) -> None:
    """Normalise newly arrived messages and add them to the table partitioned by year and month.

    ``partitions`` spreads a source of few large files over that many tasks.
    """
    spread = stream.repartition(partitions) if partitions else stream
    cleaned = filters.add_period(normalise(spread, text, [], stopwords=stopwords), epoch)
    drain(filters.keep_longer_than(cleaned, "clean_text"), checkpoint, batch_writer(path, sinks.PERIOD))


def drop_duplicates(stream: DataFrame, moment: str, keys: Sequence[str], lateness: str) -> DataFrame:
    """One row per key as long as repetitions arrive within ``lateness``."""
    return stream.withWatermark(moment, lateness).dropDuplicatesWithinWatermark(list(keys))


FIRST, REPEATED, LATE, UNDATED = "first", "repeated", "late", "undated"


def sort_out(
    stream: DataFrame, moment: str, keys: Sequence[str], lateness: str, poll_ms: int = 60_000, buckets: int = 64
) -> DataFrame:
    """Every row with its ``fate``: ``first`` of its key, ``repeated``, ``late`` (behind the watermark) or ``undated``.

    Unlike ``drop_duplicates`` nothing disappears: rows that come too late to be judged, or repeat a key, go on and can be counted and
    stored apart. A key is remembered with one number, the moment after which no repetition is expected (its first row plus ``lateness``).
    Keys share ``buckets`` states by their hash, because a call per key costs far more than its rows; a checkpoint belongs to one number of
    buckets. Timers look every ``poll_ms`` milliseconds of processing time whether the watermark has passed a key, and forget it; so the
    states hold the keys of the last ``lateness`` of event time, and a row of a forgotten key is a first one. Drain it with ``one_batch``.
    Null keys are keys. Other columns travel along; of rows that arrive together the earliest is first.
    """
    columns = stream.schema.fields
    # Pandas turns whole numbers into floating point where some are missing, so long ones travel as text.
    long = [f.name for f in columns if isinstance(f.dataType, T.LongType)]
    schema = T.StructType([*[T.StructField(f.name, T.StringType()) if f.name in long else f for f in columns], T.StructField("fate", T.StringType())])
    marked = stream.withColumn("__moment", F.col(moment)).withWatermark("__moment", lateness)
    marked = marked.withColumns({"__ms": F.unix_millis("__moment"), "__key": key_text(stream, keys)})
    marked = marked.withColumns({"__bucket": F.pmod(F.xxhash64("__key"), F.lit(buckets)), **{c: F.col(f"`{c}`").cast("string") for c in long}})
    names = stream.columns
    keep_ms = interval_ms(lateness)

    def judge(bucket: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        known = {k: until for k, until in zip(*state.get) if until >= watermark} if state.exists else {}
        judged = None
        if not state.hasTimedOut:
            rows = pd.concat(list(parts), ignore_index=True)
            rows = rows.sort_values("__moment", kind="stable", na_position="last", ignore_index=True)
            dated, ms = rows["__ms"].notna().to_numpy(), rows["__ms"].fillna(0).astype("int64").to_numpy()
            late = dated & (ms < watermark)
            fate = np.where(dated, np.where(late, LATE, REPEATED), UNDATED).astype(object)
            timely = rows["__key"][dated & ~late].drop_duplicates()
            for i, k in timely.items():
                if k not in known:
                    fate[i] = FIRST
                    known[k] = int(ms[i]) + keep_ms
            judged = rows[names].assign(fate=fate)
        if known:
            state.update((list(known), list(known.values())))
            state.setTimeoutDuration(poll_ms)
        elif state.exists:
            state.remove()
        if judged is not None:
            yield judged

    fates = marked.groupBy("__bucket").applyInPandasWithState(
        judge, schema, "keys array<string>, until array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout
    )
    return fates.withColumns({c: F.col(f"`{c}`").cast("long") for c in long})


def key_text(df: DataFrame, keys: Sequence[str]) -> Column:
    """The key columns as one text, equal where the keys are (nulls equal nulls)."""
    fields = []
    for k in keys:
        kind, value = df.schema[k].dataType, F.col(f"`{k}`")
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            value = value + F.lit(0.0).cast(kind)  # no negative zero
        elif isinstance(kind, T.TimestampType):
            value = F.unix_micros(value)
        fields.append(value.alias(k))
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    return F.to_json(F.struct(*fields), exact)


def interval_ms(text: str) -> int:
    """Milliseconds of an interval such as ``2 days``; months have no fixed length."""
    amount, unit = text.split()
    seconds = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400, "week": 604_800}[unit.rstrip("s")]
    return int(amount) * seconds * 1000


def tumbling_counts(
    stream: DataFrame, moment: str, keys: Sequence[str], lateness: str, width: str = "1 day", offset: str | None = None
) -> DataFrame:
    """Rows per fixed window and key; rows behind the watermark are dropped.

    Weeks need ``offset="4 days"``: windows are aligned to 1970-01-01, a Thursday, and weeks start on Monday.
    """
    window = F.window(moment, width, width, offset) if offset else F.window(moment, width)
    counts = stream.withWatermark(moment, lateness).groupBy(window.alias("__w"), *keys).agg(F.count(F.lit(1)).alias("rows"))
    return counts.select(F.col("__w.start").alias("window_start"), *keys, "rows")


def sliding_mean(
    stream: DataFrame, moment: str, keys: Sequence[str], score: str, lateness: str, width: str = "7 days", slide: str = "1 day"
) -> DataFrame:
    """Mean score per sliding window and key."""
    means = stream.withWatermark(moment, lateness).groupBy(F.window(moment, width, slide).alias("__w"), *keys).agg(
        F.avg(score).alias("mean_score"), F.count(score).alias("rows")
    )
    return means.select(F.col("__w.start").alias("window_start"), *keys, "mean_score", "rows")


def infer(
    stream: DataFrame, model: Transformer, labels: Sequence[str] | None, out: str, path: str, checkpoint: str
) -> None:
    """Predict newly arrived rows with a fitted pipeline and store them by year and month."""
    drain(predict(stream, model, labels, out), checkpoint, batch_writer(path, sinks.PERIOD))


def as_moment(column: str | Column) -> Column:
    """A zone-less timestamp as the timestamp type watermarks need."""
    return (F.col(column) if isinstance(column, str) else column).cast("timestamp")
