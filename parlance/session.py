"""Session factory and the shared folders jobs may write intermediate tables to."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def get_session(app_name: str = "parlance", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; extra settings win."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings results depend on to a session somebody else built.

    Python workers find this package where the driver found it, whatever folder the driver was started in; a cluster
    without that folder gets the package by ``--py-files``.
    """
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    root, environment = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    A local master may go without the setting; a cluster may not, because a folder of
    one machine is of no use to the others.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the whole cluster")
    created = tempfile.mkdtemp(prefix="parlance-")
    spark.conf.set("spark.checkpoint.dir", created)
    return created


#: Scratch paths that this process has handed out and not released yet, oldest first.
scratch_paths: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, unique to this call and noted for ``release``."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    scratch_paths.append(path)
    return path


def release(spark: SparkSession, paths: Iterable[str] | None = None) -> None:
    """Delete stored intermediate tables: the given ones, or all that this process has made.

    Call it when the results that build on them have been read or written.
    """
    for path in list(scratch_paths if paths is None else paths):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        if path in scratch_paths:
            scratch_paths.remove(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the written rows."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Preferred over a checkpoint when the result is joined later, since the file sizes give the
    optimizer the statistics that decide between a broadcast and a shuffled join. Zstandard, because each Snappy writer
    leaves direct buffers behind, and many small tasks then fill the memory beside the heap.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Stored bytes of a table that one task gets when the table is redistributed.
SPREAD_BYTES = 8 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Redistribute a table that is stored in fewer files than it needs tasks, so that all cores parse its text and no task gets much of it.

    A file of one row group is one task, however many splits Spark makes of it: the others are empty. A table gets a task per core and
    per ``SPREAD_BYTES`` of its files at least, so a task's share does not grow with the table. A table that has that many files is left as it is.
    """
    cores, files = df.sparkSession.sparkContext.defaultParallelism, df.inputFiles()
    tasks = max(cores, -(-stored_bytes(df.sparkSession, files) // SPREAD_BYTES))
    return df if len(files) >= tasks else df.repartition(tasks, *keys)


def stored_bytes(spark: SparkSession, files: Iterable[str]) -> int:
    """Total length of stored files."""
    total = 0
    for file in files:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file))
        total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return total


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Hint a broadcast only when ``df`` is proven to hold at most ``max_rows`` rows.

    Above the bound the frame is returned without a hint and the join shuffles, with adaptive
    execution splitting hot keys. Call it on stored tables, so the check is cheap.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
