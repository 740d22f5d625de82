"""Vector columns: products with a small matrix, unit length, means per group."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Products in memory at a time; rows of a batch are taken in slices of that many.
SLICE_CELLS = 4_000_000


def _unit_slices(rows: pd.Series, width: int) -> Iterator[tuple[int, np.ndarray]]:
    step = max(1, SLICE_CELLS // max(width, 1))
    for start in range(0, len(rows), step):
        stacked = np.stack(rows.iloc[start : start + step].to_numpy()).astype("float64")
        lengths = np.linalg.norm(stacked, axis=1, keepdims=True)
        yield start, np.divide(stacked, lengths, out=np.zeros_like(stacked), where=lengths > 0)


def dot_products(vector: Column, matrix: Sequence[Sequence[float]], spark: SparkSession) -> Column:
    """The products of an array column, scaled to length 1, with every row of the matrix, for results that are this matrix."""
    shared = spark.sparkContext.broadcast(np.asarray(matrix, dtype="float64").reshape(len(matrix), -1).T)

    @F.pandas_udf("array<double>")
    def product(rows: pd.Series) -> pd.Series:
        parts = [list(units @ shared.value) for _, units in _unit_slices(rows, shared.value.shape[1])]
        return pd.Series([row for part in parts for row in part], dtype=object)

    return product(vector)


def best_product(vector: Column, matrix: Sequence[Sequence[float]], spark: SparkSession) -> Column:
    """The largest product of an array column, scaled to length 1, with a row of the matrix: ``place`` and ``value``.

    The matrix (topics by dimensions) is broadcast once; only the two numbers come back from the batch. Of equal
    products the first counts.
    """
    shared = spark.sparkContext.broadcast(np.asarray(matrix, dtype="float64").reshape(len(matrix), -1).T)

    @F.pandas_udf("struct<place: int, value: double>")
    def best(rows: pd.Series) -> pd.DataFrame:
        place, value = np.zeros(len(rows), int), np.zeros(len(rows))
        for start, units in _unit_slices(rows, shared.value.shape[1]):
            products = units @ shared.value
            part = slice(start, start + len(units))
            place[part], value[part] = products.argmax(1), products.max(1)
        return pd.DataFrame({"place": place, "value": value})

    return best(vector)


def mean_distances(
    vector: Column, own: Column, sums: Sequence[Sequence[float]], sizes: Sequence[int], spark: SparkSession
) -> Column:
    """Mean cosine distance to the other rows of the own group (``own``, null for a group of one) and of the ``nearest`` other group.

    ``own`` is the place of the row's group in ``sums``, the groups' sums of unit vectors, which are broadcast.
    """
    shared = spark.sparkContext.broadcast((np.asarray(sums, dtype="float64").T, np.asarray(sizes, dtype="float64")))

    @F.pandas_udf("struct<own: double, nearest: double>")
    def distances(rows: pd.Series, places: pd.Series) -> pd.DataFrame:
        matrix, n = shared.value
        inside, outside = np.zeros(len(rows)), np.zeros(len(rows))
        for start, units in _unit_slices(rows, len(n)):
            at = places.to_numpy()[start : start + len(units)].astype(int)
            part, row = slice(start, start + len(units)), np.arange(len(units))
            products = units @ matrix
            with np.errstate(divide="ignore", invalid="ignore"):
                inside[part] = np.where(n[at] > 1, (n[at] - products[row, at]) / (n[at] - 1), np.nan)
            away = 1 - products / n
            away[row, at] = np.inf
            outside[part] = away.min(1)
        return pd.DataFrame({"own": pd.Series(inside).astype(object).where(~np.isnan(inside), None), "nearest": outside})

    return distances(vector, own)


def unit(vector: Column) -> Column:
    """The array scaled to length 1; a zero vector stays zero. The length is computed once per row."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    return F.aggregate(
        doubles,
        F.lit(0.0),
        lambda total, x: total + x * x,
        lambda total: F.transform(doubles, lambda x: F.when(total > 0, x / F.sqrt(total)).otherwise(F.lit(0.0))),
    )


def group_vectors(df: DataFrame, group: str, vector: str, kind: str = "mean") -> DataFrame:
    """Sum or mean vector and size per group; vectors combine on the map side."""
    as_vector = array_to_vector(F.col(vector))
    total = Summarizer.sum(as_vector) if kind == "sum" else Summarizer.mean(as_vector)
    return df.groupBy(group).agg(total.alias("__v"), F.count(F.lit(1)).alias("n")).select(
        group, vector_to_array("__v").alias("vector"), "n"
    )


def collect_matrix(vectors: DataFrame, key: str, max_rows: int = 100_000) -> tuple[list, list, list]:
    """Keys, vectors and sizes of a per-topic table, in key order; refuses a table that is not small."""
    rows = vectors.select(key, "vector", "n").orderBy(key).take(max_rows + 1)
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} vectors")
    return [r[key] for r in rows], [list(r["vector"]) for r in rows], [r["n"] for r in rows]
