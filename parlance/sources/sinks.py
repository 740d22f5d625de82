"""Writers, resumable runs and report files."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timezone

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.operators.ranking import join_null_safe
from parlance.session import saved

PERIOD = ["year", "month"]

LEDGER = T.StructType(
    [
        T.StructField("batch", T.IntegerType(), False),
        T.StructField("files", T.IntegerType()),
        T.StructField("status", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("finished", T.StringType()),
        T.StructField("paths", T.ArrayType(T.StringType())),
    ]
)


def append_by_period(df: DataFrame, path: str) -> None:
    """Append to a table partitioned by year and month. Running twice writes the rows twice."""
    df.write.mode("append").partitionBy(*PERIOD).parquet(path)


def overwrite_periods(df: DataFrame, path: str) -> None:
    """Replace exactly the (year, month) partitions that occur in ``df``; safe to run again.

    Rows without a year or month have a partition of their own.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PERIOD).parquet(path)


def write_compact(df: DataFrame, path: str, files: int = 1) -> None:
    """Write to at most ``files`` files; the work above stays parallel only down to that number."""
    df.coalesce(files).write.mode("overwrite").parquet(path)


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a Parquet table can be opened at ``path``."""
    try:
        spark.read.parquet(path)
    except PySparkException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def pending_periods(df: DataFrame, done: DataFrame) -> DataFrame:
    """Rows whose (year, month) is not yet in ``done``; a missing year or month is a period like any other."""
    finished = saved(done.select(*PERIOD).distinct(), "finished")
    return join_null_safe(df, finished, PERIOD, "left_anti")


def pending_rows(df: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key (id, channel or text) is not yet in ``done``."""
    return df.join(done.select(*keys).distinct(), list(keys), "left_anti")


def resume_by_period(df: DataFrame, path: str, transform: Callable[[DataFrame], DataFrame]) -> None:
    """Process the periods the sink lacks and add them, as one job over all of them."""
    todo = pending_periods(df, df.sparkSession.read.parquet(path)) if table_exists(df.sparkSession, path) else df
    overwrite_periods(transform(todo), path)


def period_ledger(df: DataFrame) -> DataFrame:
    """One row per period of a written table."""
    return df.groupBy(*PERIOD).agg(F.count(F.lit(1)).alias("rows")).withColumn("status", F.lit("done"))


PERIOD_LEDGER = T.StructType(
    [
        T.StructField("year", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("status", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


def run_by_period(df: DataFrame, path: str, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Process the periods that the sink lacks one by one, so that a bad one does not stop the others.

    The driver sees the distinct periods only. Returns a ledger with ``done`` or ``failed`` and the error of every period
    of this run; a failed period is tried again by the next run.
    """
    spark = df.sparkSession
    todo = pending_periods(df, spark.read.parquet(path)) if table_exists(spark, path) else df
    todo = saved(todo, "pending")
    log = []
    for year, month in sorted(map(tuple, todo.select(*PERIOD).distinct().collect()), key=lambda p: [v if v is not None else -1 for v in p]):
        part = todo.filter(F.col("year").eqNullSafe(F.lit(year)) & F.col("month").eqNullSafe(F.lit(month)))
        try:
            overwrite_periods(transform(part), path)
            log.append((year, month, "done", None))
        except Exception as problem:  # one bad period must not end the run
            log.append((year, month, "failed", str(problem)))
    return spark.createDataFrame(log, PERIOD_LEDGER)


def convert_in_batches(
    spark: SparkSession,
    paths: Sequence[str],
    read: Callable[[SparkSession, list[str]], DataFrame],
    out: str,
    ledger: str,
    batch_size: int = 500,
) -> DataFrame:
    """Convert many source files in batches; a failed batch is logged and skipped.

    Every batch is committed in two phases: a ledger row names its number and files, then its partition ``batch=<number>`` of the target
    is written, then a second row ends it. A run that dies in between leaves a batch that is only begun; the next call does that
    batch again under its number, and its partition is replaced. So no file is lost or converted twice, wherever a run ends.

    The driver handles path names only. A later call goes on with the files that no finished batch holds, those of failed batches
    among them. Without any ledger row the target is overwritten. Returns the ledger with one row per batch, its last.
    """
    batches = last_per_batch(read_log(spark, ledger, LEDGER)).select("batch", "status", "paths").collect()
    known = {p for b in batches if b["status"] == "done" for p in b["paths"]}
    begun = [(b["batch"], b["paths"]) for b in batches if b["status"] == "begun"]
    known.update(p for _, again in begun for p in again)
    todo = [p for p in paths if p not in known]
    number = max((b["batch"] for b in batches), default=0) + 1
    work = sorted(begun) + [(number + i // batch_size, todo[i : i + batch_size]) for i in range(0, len(todo), batch_size)]
    fresh = not batches
    for number, files in work:

        def note(status: str, error: str | None = None, number: int = number, files: list[str] = files) -> None:
            row = (number, len(files), status, error, datetime.now(timezone.utc).isoformat(), files)
            append_log(spark.createDataFrame([row], LEDGER), ledger, LEDGER)

        note("begun")
        try:
            rows = read(spark, files).withColumn("batch", F.lit(number))
            # The first batch of all replaces whatever the target held, later ones their own partition.
            rows.write.mode("overwrite").option("partitionOverwriteMode", "static" if fresh else "dynamic").partitionBy("batch").parquet(out)
        except Exception as problem:  # one bad batch must not end the run
            note("failed", str(problem))
        else:
            fresh = False
            note("done")
    return last_per_batch(read_log(spark, ledger, LEDGER))


def last_per_batch(ledger: DataFrame) -> DataFrame:
    """The state of every batch: ``done`` or ``failed`` where it has ended, else ``begun``."""
    rest = [f.name for f in LEDGER.fields if f.name != "batch"]
    order = F.struct((F.col("status") != "begun").alias("ended"), "finished")
    return ledger.groupBy("batch").agg(F.max_by(F.struct(*rest), order).alias("last")).select("batch", "last.*")


def append_log(rows: DataFrame, path: str, schema: T.StructType) -> None:
    """Append to a log table of fixed columns; columns the rows lack are null."""
    columns = [
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
    ]
    rows.select(*columns).write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The log table, empty when nothing was logged yet."""
    if not table_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def write_csv_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def json_records(df: DataFrame) -> DataFrame:
    """Every row as one JSON text, for line-wise JSON reports."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def keyed_json(df: DataFrame, key: str, max_keys: int = 100_000) -> DataFrame:
    """One JSON object ``{key: {other columns}}`` for a report of a bounded number of keys."""
    if df.select(key).limit(max_keys + 1).count() > max_keys:
        raise ValueError(f"a keyed report holds at most {max_keys} keys; write json_records instead")
    rest = [c for c in df.columns if c != key]
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), F.struct(*rest).alias("v"))))
    return df.agg(F.to_json(F.map_from_entries(entries)).alias("value"))
