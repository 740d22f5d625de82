"""Readers for message dumps and stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.schemas import RAW_MESSAGE
from parlance.session import saved

# Where the group and the channel number stand in a dump path. Folders may be
# written by Spark itself (``group_name=...``).
GROUP_FOLDER = r"/extracted/(?:group_name=)?([^/]+)/"
CHANNEL_NUMBER = r"channel_(\d+)-"

BAD_RECORD = "_corrupt_record"


def group_from_path(path: Column) -> Column:
    return F.regexp_extract(path, GROUP_FOLDER, 1)


def channel_from_path(path: Column) -> Column:
    return F.regexp_extract(path, CHANNEL_NUMBER, 1)


def read_dump(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: T.StructType = RAW_MESSAGE,
    malformed: str = "null",
    ignore_corrupt: bool = True,
) -> DataFrame:
    """Tab-separated dumps (plain or gzip), quoted, cells may hold tabs and line breaks.

    ``malformed`` says what happens to a row that does not fit the schema: ``null`` nulls the bad
    cells, ``drop`` removes the row, ``quarantine`` keeps it with its raw line in
    ``_corrupt_record`` (store the result before filtering on it). Unreadable files are skipped when
    ``ignore_corrupt``.
    """
    modes = {"null": "PERMISSIVE", "drop": "DROPMALFORMED", "quarantine": "PERMISSIVE"}
    if malformed not in modes:
        raise ValueError(f"malformed must be one of {sorted(modes)}")
    reader = (
        spark.read.option("header", True)
        .option("sep", "\t")
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("ignoreCorruptFiles", ignore_corrupt)
        .option("mode", modes[malformed])
    )
    if malformed != "null":
        reader = reader.option("columnPruning", False)
    if malformed == "quarantine":
        schema = T.StructType([*schema.fields, T.StructField(BAD_RECORD, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", BAD_RECORD)
    return reader.schema(schema).csv([paths] if isinstance(paths, str) else list(paths))


def list_dump(spark: SparkSession, folder: str, pattern: str = "*.gz") -> list[str]:
    """The paths of the dump files below ``folder``, in order; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return sorted(r["path"] for r in files.select("path").toLocalIterator())


def add_lineage(df: DataFrame) -> DataFrame:
    """The file each row came from and the group its folder names."""
    path = F.col("_metadata.file_path")
    return df.select("*", path.alias("file_path"), group_from_path(path).alias("group_name"))


def keep_allowed(df: DataFrame, allowed: DataFrame, column: str = "group_name") -> DataFrame:
    """Rows of the groups named in the one-column allow-list; its size decides the join."""
    names = allowed.select(F.trim(F.col(allowed.columns[0])).alias(column)).distinct()
    return df.join(saved(names, "allowed"), column, "left_semi")


def load_tables(
    spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """Parquet from one or several paths, optionally only some columns."""
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    return df.select(*columns) if columns else df


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Text lines with file, file split (``block``) and an order within the split (``line``)."""
    lines = spark.read.text([paths] if isinstance(paths, str) else list(paths))
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )
