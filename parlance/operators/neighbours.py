"""Exact nearest neighbours of low-dimensional vectors, by cells of a k-d tree.

The driver cuts space into cells from a bounded sample. Every point first finds its neighbours in its own cell, which bounds the
radius that can hold better ones; it then visits just the cells that this radius reaches. No pairs beyond those are formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.session import saved

CELL_ROWS = 1024
SAMPLE_ROWS = 100_000
SLACK = 1 + 1e-9


class Cells:
    """A k-d tree as arrays; a node without a cut is a cell."""

    def __init__(self, sample: np.ndarray, enough: float) -> None:
        self.axis: list[int] = []
        self.cut: list[float] = []
        self.low: list[int] = []
        self.high: list[int] = []
        self._grow(sample, max(enough, 16))

    def _grow(self, points: np.ndarray, enough: float) -> int:
        me = len(self.axis)
        for values, empty in ((self.axis, -1), (self.cut, 0.0), (self.low, -1), (self.high, -1)):
            values.append(empty)
        if len(points) > enough:
            axis = int(np.argmax(points.max(0) - points.min(0)))
            cut = float(np.median(points[:, axis]))
            below = points[:, axis] < cut
            if below.any():  # false when more than half of the points share the smallest value
                self.axis[me], self.cut[me] = axis, cut
                self.low[me] = self._grow(points[below], enough)
                self.high[me] = self._grow(points[~below], enough)
        return me

    def home(self, points: np.ndarray) -> np.ndarray:
        """The cell of every point."""
        cell = np.zeros(len(points), np.int64)
        for node, rows, _ in self._walk(points, None):
            cell[rows] = node
        return cell

    def reached(self, points: np.ndarray, radius: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The cells that the ball around a point may reach, each with the numbers of those points."""
        for node, rows, _ in self._walk(points, radius):
            yield node, rows

    def _walk(self, points: np.ndarray, radius: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        todo = [(0, np.arange(len(points)), np.zeros_like(points))]
        while todo:
            node, rows, gap = todo.pop()
            if not len(rows):
                continue
            axis = self.axis[node]
            if axis < 0:
                yield node, rows, gap
                continue
            beyond = points[rows, axis] - self.cut[node]
            for child, own in ((self.low[node], beyond < 0), (self.high[node], beyond >= 0)):
                wide = gap.copy()
                wide[~own, axis] = beyond[~own]
                near = own if radius is None else own | ((wide**2).sum(1) <= (radius[rows] * SLACK) ** 2)
                todo.append((child, rows[near], wide[near]))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of number arrays of one length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def closest(queries: np.ndarray, own: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Number of the query, place in ``points`` and distance of the ``k`` nearest points that are not the query's ``own`` id.

    Equal distances by the smaller id. Queries are taken in slices, so memory stays bounded.
    """
    step = max(1, (1 << 21) // max(len(points), 1))
    for low in range(0, len(queries), step):
        some = queries[low : low + step]
        square = np.zeros((len(some), len(points)))
        for axis in range(points.shape[1]):
            square += (some[:, axis, None] - points[None, :, axis]) ** 2
        square[own[low : low + step, None] == ids[None]] = np.inf
        if len(points) > k:
            bound = np.partition(square, k - 1, axis=1)[:, k - 1, None]
        else:
            bound = np.full((len(some), 1), np.inf)
        rows, columns = np.nonzero((square <= bound) & np.isfinite(square))
        order = np.lexsort((ids[columns], square[rows, columns], rows))
        rows, columns = rows[order], columns[order]
        kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        rows, columns = rows[kept], columns[kept]
        yield rows + low, columns, np.sqrt(square[rows, columns])


def nearest_neighbours(
    df: DataFrame, key: str, vector: str, k: int, cell_rows: int = CELL_ROWS, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """The ``k`` nearest other rows of every row: ``id``, ``other``, ``distance`` (Euclidean), exact.

    ``key`` is a unique whole number, ``vector`` an array of numbers of one length; rows without either are left out. Equal distances
    go to the smaller key. With fewer than ``k`` other rows all of them are returned. Identical vectors cannot be parted by
    cells: where there may be many, pass distinct vectors. About ``sample_rows`` vectors reach the driver, to cut cells of ``cell_rows``.
    """
    points = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).dropna()
    points = saved(points, "points")
    n = points.count()
    share = min(1.0, sample_rows / max(n, 1))
    sample = points.filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else points
    tree = Cells(matrix(sample.select("v").toArrow()["v"]), share * cell_rows)
    shared = points.sparkSession.sparkContext.broadcast(tree)

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.home(matrix(part.column(1))))], ["id", "v", "cell"])

    placed = saved(points.mapInArrow(place, "id long, v array<double>, cell long"), "placed")

    def within(part: pa.Table) -> pa.Table:
        ids, vectors = part["id"].to_numpy(), matrix(part["v"])
        found = list(closest(vectors, ids, vectors, ids, k))
        rows, columns, d = (np.concatenate([f[i] for f in found]) for i in range(3))
        radius = np.full(len(ids), np.inf)
        n_found = np.bincount(rows, minlength=len(ids))
        last = np.cumsum(n_found) - 1
        radius[n_found == k] = d[last[n_found == k]]
        return pa.table({
            "id": part["id"], "v": part["v"], "cell": part["cell"], "radius": radius,
            "near": pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(n_found)]), pa.int32()),
                pa.StructArray.from_arrays([pa.array(d), pa.array(ids[columns])], ["distance", "other"]),
            ),
        })

    near_type = "array<struct<distance:double,other:long>>"
    own = saved(
        placed.groupBy("cell").applyInArrow(within, f"id long, v array<double>, cell long, radius double, near {near_type}"), "own-cells"
    )

    def visits(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            vectors, radius, home = matrix(part.column(1)), part.column(2).to_numpy(), part.column(3).to_numpy()
            for cell, rows in shared.value.reached(vectors, radius):
                if len(rows := rows[home[rows] != cell]):
                    some = part.take(pa.array(rows)).select([0, 1])
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(np.full(len(rows), cell))], ["id", "v", "cell"])

    guests = saved(own.select("id", "v", "radius", "cell").mapInArrow(visits, "id long, v array<double>, cell long"), "visits")
    # A cell with many guests is several tasks: each gets a part of them and all residents of the cell.
    parts = saved(
        guests.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / (8 * cell_rows)).cast("int").alias("parts")), "guest-parts"
    )
    dealt = guests.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    hosts = placed.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def beyond(guest: pa.Table, host: pa.Table) -> pa.Table:
        ids = host["id"].to_numpy()
        asking = guest["id"].to_numpy()
        found = list(closest(matrix(guest["v"]), asking, matrix(host["v"]), ids, k))
        rows, columns, d = (np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in range(3))
        return pa.table({"id": asking[rows], "distance": d.astype(np.float64), "other": ids[columns]})

    columns = ["cell", "part", "id", "v"]
    visited = dealt.select(columns).groupBy("cell", "part").cogroup(hosts.select(columns).groupBy("cell", "part"))
    more = visited.applyInArrow(beyond, "id long, distance double, other long")
    every = own.select("id", F.inline("near")).unionByName(more)
    # A point has at most k candidates per cell it has met.
    best = F.slice(F.array_sort(F.collect_list(F.struct("distance", "other"))), 1, k)
    return every.groupBy("id").agg(best.alias("near")).select("id", F.inline("near")).select("id", "other", "distance")
