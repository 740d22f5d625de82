"""SimHash fingerprints, and all pairs within a small Hamming distance by vantage-point trees.

A node of a tree has a vantage point and a radius: fingerprints nearer than the radius go inside, the others outside. By the triangle
inequality two fingerprints within ``reach`` of each other can only be parted if the outer one is less than ``reach`` beyond the radius, so
those go inside, too. Every pair therefore meets in some leaf, and leaves that are no neighbours never see each other.

The driver grows a forest from a bounded sample; Spark routes every fingerprint through it to its shards, counts the shards, and grows the
large ones on, until all are small. Whatever cannot be parted (fingerprints that all lie together) is compared in blocks. Within a shard the same
rule divides on down to a few hundred fingerprints, whose distances are all measured.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from parlance.llm.components import connected_components
from parlance.llm.ngrams import texts_of
from parlance.llm.numbering import join_counted
from parlance.session import saved

SHINGLE, SEED, REACH = 3, 42, 3
SHARDS = 64
SHARD_ROWS = 256, 1 << 18
SAMPLE_ROWS = 1 << 17
FEWEST_POINTS = 64
LEAF_ROWS = 384
CHUNK = 1 << 15


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of all word shingles; words are what ASCII white space separates, A-Z is lower-cased.

    Fewer words than ``size`` are one shingle; without a word the fingerprint is zero.
    """
    line = b" ".join(text.lower().split())
    if not line:
        return 0
    blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts, ends = [0, *(blanks + 1).tolist()], [*blanks.tolist(), len(line)]
    if len(starts) < size:
        return xxh64_intdigest(line, SEED)
    ends, n = ends[size - 1 :], len(starts) - size + 1
    counts = np.zeros(64, np.int64)
    for low in range(0, n, CHUNK):  # long texts in slices, so that memory stays bounded
        pieces = [line[s:e] for s, e in zip(starts[low : min(low + CHUNK, n)], ends[low : low + CHUNK], strict=True)]
        hashes = np.fromiter(map(xxh64_intdigest, pieces, repeat(SEED)), np.uint64, len(pieces))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int = SHINGLE) -> DataFrame:
    """``id`` and ``print`` (the fingerprint's 64 bits as a signed number) of every row; null text is empty."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = np.array([fingerprint(t.tobytes(), size) for t in texts_of(part.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], ["id", "print"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    return rows.mapInArrow(batches, f"id {kind}, print long")


def distances(points: np.ndarray, vantage: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


def best_split(points: np.ndarray, reach: int, tries: int = 8) -> tuple[np.uint64, int] | None:
    """The vantage point and radius that leave the least work; None if every split leaves nearly all points on one side."""
    n, best, least = len(points), None, float("inf")
    for vantage in points[np.linspace(0, n - 1, tries).astype(np.int64)]:
        below = np.concatenate([[0], np.cumsum(np.bincount(distances(points, vantage), minlength=65))])
        radii = np.arange(1, 65)
        inside, outside = below[np.minimum(radii + reach, 65)], n - below[radii]
        work = inside.astype(float) ** 1.5 + outside.astype(float) ** 1.5
        work[np.maximum(inside, outside) > 0.95 * n] = float("inf")
        k = int(np.argmin(work))
        if work[k] < least:
            best, least = (vantage, int(radii[k])), work[k]
    return best


def parted(points: np.ndarray, vantage: np.uint64, radius: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Which points go inside (those just beyond the radius as well) and which outside."""
    d = distances(points, vantage)
    return d < radius + reach, d >= radius


class Forest:
    """Vantage-point trees over shards: arrays of nodes, small enough to send to every task."""

    def __init__(self) -> None:
        self.vantage: list[int] = []
        self.radius: list[int] = []
        self.inside: list[int] = []
        self.outside: list[int] = []
        self.roots: dict[int, int] = {}

    def grow(self, shard: int, points: np.ndarray, share: float, most: int, reach: int) -> None:
        """A tree for a shard from a sample of its points, of which ``share`` was sampled; a leaf is expected to hold ``most`` rows at most."""
        root = self._node(points, max(share * most, FEWEST_POINTS), reach)
        if self.radius[root]:
            self.roots[shard] = root

    def _node(self, points: np.ndarray, enough: float, reach: int) -> int:
        me = len(self.radius)
        self.vantage.append(0)
        self.radius.append(0)  # a leaf
        self.inside.append(-1)
        self.outside.append(-1)
        split = best_split(points, reach) if len(points) > enough else None
        if split:
            inner, outer = parted(points, *split, reach)
            self.vantage[me], self.radius[me] = int(split[0]), split[1]
            self.inside[me] = self._node(points[inner], enough, reach)
            self.outside[me] = self._node(points[outer], enough, reach)
        return me

    def leaves(self, shard: int, points: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray]]:
        """The leaves that the points of a shard go to, each with the numbers of its points."""
        todo = [(self.roots[shard], np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if not self.radius[node]:
                yield node, rows
                continue
            inner, outer = parted(points[rows], np.uint64(self.vantage[node]), self.radius[node], reach)
            todo += [(self.inside[node], rows[inner]), (self.outside[node], rows[outer])]


def as_prints(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.to_numpy().view(np.uint64)


def routed(rows: DataFrame, forest: Forest, reach: int) -> DataFrame:
    """Rows (``print``, ``shard``) in the leaves of their shard's tree; shards without a tree stay as they are.

    The new shard is a hash of the old one and the leaf. A sampled tree has fewer leaves than the sample has rows.
    """
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for part in parts:
            prints, shard = as_prints(part.column(0)), part.column(1).to_numpy()
            points, names = [], []
            for one in np.unique(shard).tolist():
                mine = prints[shard == one]
                if one not in trees.roots:
                    points.append(mine)
                    names.append(np.full(len(mine), one))
                    continue
                for leaf, found in trees.leaves(one, mine, reach):
                    points.append(mine[found])
                    names.append(np.full(len(found), xxh64_intdigest(f"{one}/{leaf}".encode()) >> 1))
            if points:
                met = np.concatenate(points).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(np.concatenate(names))], ["print", "shard"])

    return rows.mapInArrow(batches, "print long, shard long")


def shards(prints: DataFrame, n_prints: int, reach: int, most: int, sample: int = SAMPLE_ROWS) -> DataFrame:
    """``print``, ``shard`` and ``rows`` (of the shard): every two prints within ``reach`` share a shard.

    ``prints`` are distinct. About ``sample`` of those in large shards are sampled in every round; rounds end when no large shard
    can be parted any more, so shards of prints that lie closely together may stay large.
    """
    now, settled = saved(prints.select("print", F.lit(0).cast("long").alias("shard")), "shards"), []
    large = n_prints
    while large > most:
        share = min(1.0, sample / large)
        chosen = now.filter(F.pmod(F.xxhash64("print", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else now
        table = chosen.select("print", "shard").toArrow()
        points, of = as_prints(table["print"]), table["shard"].to_numpy()
        order = np.lexsort((points, of))
        points, of = points[order], of[order]
        forest = Forest()
        for part in np.split(np.arange(len(of)), np.flatnonzero(np.diff(of)) + 1):
            if len(part):
                rng = np.random.default_rng(17)  # the points of a shard in an order that no vantage point depends on
                forest.grow(int(of[part[0]]), points[rng.permutation(part)], share, most, reach)
        if not forest.roots:
            break
        now = saved(routed(now, forest, reach), "routed")
        sizes = saved(now.groupBy("shard").agg(F.count(F.lit(1)).alias("rows")), "shard-sizes")
        small = sizes.filter(F.col("rows") <= most)
        settled.append(now.join(small, "shard").select("print", "shard", "rows"))
        now = saved(now.join(sizes.filter(F.col("rows") > most).select("shard"), "shard", "left_semi").select("print", "shard"), "large")
        large = now.count()
    if large or not settled:
        sizes = saved(now.groupBy("shard").agg(F.count(F.lit(1)).alias("rows")), "shard-sizes")
        settled.append(now.join(sizes, "shard").select("print", "shard", "rows"))
    result = settled[0]
    for more in settled[1:]:
        result = result.unionByName(more)
    return result


def measured(rows: np.ndarray, columns: np.ndarray, reach: int) -> np.ndarray:
    """Which of the rows lies within reach of which of the columns."""
    return distances(rows[:, None], columns[None]) <= reach


def star_links(points: np.ndarray, reach: int) -> np.ndarray:
    """Links of each point to the first point of its component among ``points``; all distances are measured."""
    near = measured(points, points, reach)
    if int(near.sum()) == len(points):
        return np.zeros((0, 2), np.int64)
    label = np.arange(len(points))
    while True:
        least = np.where(near, label[None], len(points)).min(1)
        least = least[least]
        if (least == label).all():
            break
        label = least
    moved = np.flatnonzero(label != np.arange(len(points)))
    return np.stack([moved, label[moved]], 1)


def search(points: np.ndarray, reach: int, leaf: int = LEAF_ROWS) -> np.ndarray:
    """Pairs of numbers of points that connect whatever lies within ``reach``, by dividing around vantage points."""
    found, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        split = best_split(points[rows], reach) if len(rows) > leaf else None
        if split:
            todo += [rows[side] for side in parted(points[rows], *split, reach)]
        elif len(rows) <= 2 * leaf:
            found.append(rows[star_links(points[rows], reach)])
        else:  # prints that lie together: block against block
            blocks = np.array_split(rows, -(-len(rows) // leaf))
            for i, first in enumerate(blocks):
                for second in blocks[i:]:
                    both = first if first is second else np.concatenate([first, second])
                    found.append(both[star_links(points[both], reach)])
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    return spanning_pairs(pairs, len(points))


def spanning_pairs(pairs: np.ndarray, n: int) -> np.ndarray:
    """Links to the smallest number of each component that ``pairs`` make among ``n`` points."""
    label = np.arange(n)
    while len(pairs):
        a, b = label[pairs[:, 0]], label[pairs[:, 1]]
        apart = a != b
        if not apart.any():
            break
        pairs, low, high = pairs[apart], np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        np.minimum.at(label, high, low)
        while True:
            shorter = label[label]
            if (shorter == label).all():
                break
            label = shorter
    moved = np.flatnonzero(label != np.arange(n))
    return np.stack([moved, label[moved]], 1)


def near_links(
    prints: DataFrame, n_prints: int, reach: int = REACH, most: int | None = None, sample: int = SAMPLE_ROWS
) -> DataFrame:
    """Links ``u``, ``v`` between distinct prints that connect exactly what pairs within ``reach`` connect.

    ``most`` is the size of a shard. Prints near a boundary are in several shards, and the more shards there are the more copies are
    shuffled, so by default there are about ``SHARDS``, until they would be too large for a task. A shard above ``most`` rows is dealt into blocks, and every two blocks are one task's rows, so no task holds more than twice ``most``.
    """
    most = most or min(max(n_prints // SHARDS, SHARD_ROWS[0]), SHARD_ROWS[1])
    met = saved(shards(prints, n_prints, reach, most, sample), "shards")
    blocks = F.ceil(F.col("rows") / most).cast("int")
    dealt = met.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("print", F.lit(5)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("print", "shard", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def links(part: pa.Table) -> pa.Table:
        points = np.sort(as_prints(part.column("print")))
        pairs = points[search(points, reach)].view(np.int64)
        return pa.table({"u": pairs[:, 0], "v": pairs[:, 1]})

    return dealt.groupBy("shard", "lo", "hi").applyInArrow(links, "u long, v long").distinct()


def near_fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH, size: int = SHINGLE,
    most: int | None = None, sample: int = SAMPLE_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: id, ``fingerprint`` (16 hex digits), ``component_id`` (smallest id that links reach, itself included).

    Fingerprints link at ``reach`` or fewer differing bits; no link is lost, and rows with one fingerprint are linked. Null and blank
    texts have fingerprint zero and are linked like any other. A null id is larger than any other: its rows have the smallest id they
    reach, null if there is none. Rows that share an id are rows of their own. An empty table gives an empty result; other columns are
    not read. At most about ``sample`` fingerprints at a time reach the driver, to grow trees.
    """
    rows = saved(fingerprints(docs, id_col, text_col, size), "fingerprints")
    nodes = saved(rows.groupBy("print").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("first")), "nodes")
    totals = nodes.agg(F.count(F.lit(1)), F.sum("rows")).first()
    links = saved(near_links(nodes.select("print"), totals[0], reach, most, sample), "links")
    found = connected_components(links).select(F.col("id").alias("print"), "component")
    classes = nodes.join(found, "print", "left").withColumn("component", F.coalesce("component", "print"))
    classes = saved(classes, "classes")
    least = saved(classes.groupBy("component").agg(F.min("first").alias("component_id")), "least")
    named = saved(classes.join(least, "component").select("print", "rows", "component_id"), "named")
    joined = join_counted(rows, named, "print", "rows", totals[1] or 0)
    return joined.select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )
