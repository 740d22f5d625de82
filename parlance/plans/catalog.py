"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parlance.plans import (  # noqa: F401
    classify_queries,
    evaluation_queries,
    feature_queries,
    join_queries,
    language_queries,
    report_queries,
    sampling_queries,
    source_queries,
    stream_queries,
    text_queries,
    topic_queries,
)
from parlance.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["i04_weekly_toxicity_profile"](spark, sf_dir)
