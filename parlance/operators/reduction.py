"""Principal components of long vectors without a covariance matrix.

The covariance of vectors of d numbers has d squared entries, and Spark's PCA gathers them on the driver. Here the driver holds a few columns of d
numbers: a random start is multiplied by the covariance in passes over the rows, each pass a product that every task sums up for
itself, and is made orthonormal in between, until the columns span the leading components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.vectors import dot_products
from parlance.operators.neighbours import matrix
from parlance.session import saved


def covariance_product(rows: DataFrame, columns: np.ndarray) -> np.ndarray:
    """The covariance of the unit vectors ``v`` in ``rows`` times ``columns`` (d x k); a task sends (d + 1) k + d + 1 numbers at most."""
    d, k = columns.shape
    shared = rows.sparkSession.sparkContext.broadcast(columns)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product, total, n = np.zeros((d, k)), np.zeros(d), 0
        for part in parts:
            x = matrix(part.column(0))
            if len(x):
                product += x.T @ (x @ shared.value)
                total += x.sum(0)
                n += len(x)
        if n:
            values = np.concatenate([product.ravel(), total, [n]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["place", "value"])

    sums = rows.select("v").mapInArrow(batches, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    values = np.zeros(d * k + d + 1)
    values[sums["place"].to_numpy()] = sums["value"].to_numpy()
    n = max(values[-1], 1.0)
    mean = values[d * k : -1] / n
    return values[: d * k].reshape(d, k) / n - np.outer(mean, mean @ columns)


def leading_components(rows: DataFrame, d: int, components: int, passes: int = 6, oversampling: int = 8, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The leading components (d x ``components``) of the vectors ``v`` and their variances, largest first.

    ``oversampling`` more columns than asked for make the found space accurate. A component's sign is such that its largest number is positive.
    """
    k = min(components + oversampling, d)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, k)))[0]
    for _ in range(passes):
        basis = np.linalg.qr(covariance_product(rows, basis))[0]
    inner = basis.T @ covariance_product(rows, basis)
    variances, turns = np.linalg.eigh((inner + inner.T) / 2)
    order = np.argsort(-variances)[: min(components, k)]
    found = basis @ turns[:, order]
    return found * np.sign(found[np.abs(found).argmax(0), np.arange(found.shape[1])]), np.maximum(variances[order], 0.0)


def reduce_randomised(
    df: DataFrame, vector: str, components: int, out: str = "reduced", passes: int = 6, oversampling: int = 8, seed: int = 42
) -> DataFrame:
    """Add the coordinates of the unit vectors on their ``components`` principal components.

    Like ``reduce_dimensions``, which gathers the whole covariance, but for vectors of any length. All vectors have one length; a null or
    zero vector, or one with a null in it, has null coordinates and does not count. An empty table stays empty. Every pass reads the vectors, which are stored once.
    """
    number = F.col(vector).cast("array<double>")
    length = F.sqrt(F.aggregate(number, F.lit(0.0), lambda a, x: a + x * x))
    unit = F.when(length > 0, F.transform(number, lambda x: x / length))
    rows = saved(df.select(unit.alias("v")).filter("v is not null"), "unit-vectors")
    first = rows.select(F.size("v")).first()
    if first is None:
        return df.withColumn(out, F.lit(None).cast("array<double>"))
    found, _ = leading_components(rows, first[0], components, passes, oversampling, seed)
    # The products see every row, so rows without a direction get some vector and lose the result.
    safe = F.coalesce(unit, F.array_repeat(F.lit(1.0), first[0]))
    return df.withColumn(out, F.when(length > 0, dot_products(safe, found.T.tolist(), df.sparkSession)))
