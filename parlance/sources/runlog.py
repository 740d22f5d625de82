"""Parameter-search run logs as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators.ranking import join_null_safe

# The line forms of a run log.
MODEL_LINE = r"^\[(\d+)/(\d+)\]\s+Modelo de embedding:\s+(.*)$"
COMBO_LINE = r"^\[(\d+)/(\d+)\]\s+(\{.*\})\s*$"
OUTLIERS = r"Outliers \(ruído\):\s*(\d+)\s*\(([\d.]+)%\)"
SILHOUETTE = r"Silhoueta:\s*([-\d.]+|nan)"
DIVERSITY = r"Diversidade:\s*([-\d.]+|nan)"
COHERENCE = r"Coerência \(c_v\):\s*([-\d.]+|nan)"
FAILED = r"Falhou:\s*(.*)$"


def _found(pattern: str, group: int) -> Column:
    return F.when(F.col("value").rlike(pattern), F.regexp_extract("value", pattern, group))


def parse_run_log(lines: DataFrame, parameters: Sequence[str]) -> DataFrame:
    """One row per parameter combination of a log, with the metrics that follow it.

    ``lines`` has ``file``, ``block``, ``line`` and ``value``. A model line holds until the next one,
    a combination starts a row, and metric lines belong to the combination before them. A
    combination with neither outliers nor an error was cut off and is left out.

    Both carried values are found inside each block and completed with what the earlier blocks of
    the file left behind, so a long log is never sorted in one task.
    """
    text = lines.withColumn("value", F.trim("value"))
    marked = text.withColumns(
        {
            "model": F.trim(_found(MODEL_LINE, 3)),
            "combo": _found(COMBO_LINE, 3),
            "combo_idx": _found(COMBO_LINE, 1).cast("int"),
        }
    ).withColumn("starts", F.col("combo").isNotNull().cast("long"))

    blocks = marked.groupBy("file", "block").agg(
        F.max_by("model", F.when(F.col("model").isNotNull(), F.col("line"))).alias("last_model"),
        F.sum("starts").alias("n_starts"),
    )
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(
        "file",
        "block",
        F.last("last_model", ignorenulls=True).over(earlier).alias("carried_model"),
        F.coalesce(F.sum("n_starts").over(earlier), F.lit(0)).alias("carried_starts"),
    )
    inside = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    placed = join_null_safe(marked, carried, ["file", "block"]).withColumns(
        {
            "current_model": F.coalesce(F.last("model", ignorenulls=True).over(inside), F.col("carried_model")),
            "run": F.col("carried_starts") + F.sum("starts").over(inside),
        }
    )
    is_metric = F.col("model").isNull() & F.col("combo").isNull()
    order = F.struct("block", "line")

    def metric(pattern: str, group: int = 1) -> Column:
        found = F.when(is_metric, _found(pattern, group))
        return F.max_by(found, F.when(found.isNotNull(), order))

    starts = F.col("combo").isNotNull()
    rows = placed.filter(F.col("run") > 0).groupBy("file", "run").agg(
        F.max(F.when(starts, F.col("current_model"))).alias("embedding_model"),
        F.max("combo_idx").alias("combo_idx"),
        F.max("combo").alias("combo"),
        metric(OUTLIERS, 1).cast("long").alias("n_outliers"),
        metric(OUTLIERS, 2).cast("double").alias("outliers_pct"),
        metric(SILHOUETTE).cast("double").alias("silhouette"),
        metric(DIVERSITY).cast("double").alias("diversity"),
        metric(COHERENCE).cast("double").alias("coherence_cv"),
        metric(FAILED).alias("error"),
    )
    complete = rows.filter(F.col("outliers_pct").isNotNull() | F.col("error").isNotNull())
    as_json = F.regexp_replace(F.regexp_replace("combo", r"\bTrue\b", "true"), r"\bFalse\b", "false")
    values = F.from_json(F.regexp_replace(F.translate(as_json, "'", '"'), r"\bNone\b", "null"), "map<string,string>")
    parsed = complete.withColumn("__values", values)
    return parsed.select(
        "file", "run", "embedding_model", "combo_idx", *[F.col("__values")[p].alias(p) for p in parameters],
        "n_outliers", "outliers_pct", "silhouette", "diversity", "coherence_cv", "error",
    )
