"""Near-duplicate join on word shingles by a MinHash LSH forest, verified exactly.

Texts with equal shingle sets are one node. Every node has a signature of ``trees * depth`` MinHash values; tree ``t`` is the trie of its ``depth``
values, cut at the largest depth at which the chance to meet a pair at the threshold in some tree reaches the target recall, and kept as hashed prefixes.

Within a prefix everybody meets everybody and is verified by the exact Jaccard similarity of the whole shingle sets. The rows of a prefix
are dealt into blocks; a task takes two blocks at a time, counts all their intersections as matrix products and returns a spanning forest of
the similar pairs. So a prefix that many rows share costs time for its pairs, but neither rows for them nor a task that holds them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.components import connected_components
from parlance.llm.ngrams import texts_of
from parlance.llm.shingles import SHINGLE, passes, shingle_set, sieve, text_bytes
from parlance.session import saved

THRESHOLD = 0.8
TARGET_RECALL = 0.99
TREES, DEPTH = 14, 8
BLOCK_ROWS, BLOCK_SHINGLES = 256, 1 << 18


def recall_at(depth: int, similarity: float, trees: int = TREES) -> float:
    """Chance that two texts of this similarity share a prefix of ``depth`` in at least one tree."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_depths(similarity: float, target: float, trees: int = TREES, depth: int = DEPTH) -> list[int]:
    """The full depth of a tree and the largest depth that reaches the target recall, at which texts meet."""
    last = next((d for d in range(depth, 0, -1) if recall_at(d, similarity, trees) >= target), 1)
    return sorted({depth, last}, reverse=True)


def permutations(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1))[:, None], rng.integers(0, 1 << 32, n, np.uint32)[:, None]


def min_hashes(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest value of every permutation; long texts in slices, so that memory stays bounded."""
    x, out = (shingles >> np.uint64(32)).astype(np.uint32), np.full(len(a), 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for low in range(0, len(x), 2048):
            out = np.minimum(out, (x[None, low : low + 2048] * a + b).min(1))
    return out


def signatures(docs: DataFrame, size: int, trees: int, depth: int) -> DataFrame:
    """``id``, ``digest`` and ``size`` of the shingle set and ``sig``; texts without a word are left out."""
    a, b = permutations(trees * depth)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        for part in parts:
            digests, sigs, sizes, keep = [], [], [], []
            for i, text in enumerate(texts_of(part.column(1))):
                if len(shingles := shingle_set(text, size)):
                    keep.append(i)
                    digests.append(blake2b(shingles.tobytes(), digest_size=16).digest())
                    sizes.append(len(shingles))
                    sigs.append(min_hashes(shingles, a, b).astype(">u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(keep, pa.int64())), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int32())],
                ["id", "digest", "sig", "size"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(batches, f"id {kind}, digest binary, sig binary, size int")


def shingle_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``id`` and ``shingles`` (sorted 64-bit hashes) of the rows in ``wanted``. A bitmap drops nearly all others before the shuffle."""
    bitmap = docs.sparkSession.sparkContext.broadcast(sieve(wanted.select(F.xxhash64("id").alias("h"))))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            part = part.filter(pa.array(passes(bitmap.value, part.column(2).to_numpy())))
            sets = [shingle_set(text, size).tobytes() for text in texts_of(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.large_binary()).cast(pa.binary())], ["id", "shingles"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text", F.xxhash64("id").alias("h")).mapInArrow(batches, f"id {kind}, shingles binary")


def in_blocks(members: DataFrame) -> DataFrame:
    """``members`` (``id``, ``key``, ``size``) dealt over the block pairs of their key: ``lo`` <= ``hi`` name the pair, ``block`` the row's own.

    A key of up to ``BLOCK_ROWS`` rows and ``BLOCK_SHINGLES`` shingles is one block, so no task has to hold more than two blocks, however
    many rows share a key; every two rows of a key meet in exactly one block pair.
    """
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total")).filter("n > 1")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    sizes = saved(sizes.select("key", blocks.alias("blocks")), "block-counts")
    dealt = members.join(sizes.hint("merge"), "key").select("id", "key", "blocks", F.pmod(F.xxhash64("id", F.lit(7)), "blocks").cast("int").alias("block"))
    met = dealt.select("id", "key", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return met.select("id", "key", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))


def common_counts(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """How many hashes each of ``sets[rows]`` shares with each of ``sets[columns]``, by products of 0/1 matrices in slices."""
    sizes = np.array([len(x) for x in sets])
    _, code, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.where(n > 1, np.cumsum(n > 1) - 1, -1)[code]  # a hash of one set alone is in no intersection
    owner, out = np.repeat(np.arange(len(sets)), sizes), np.zeros((len(rows), len(columns)))
    keep = np.flatnonzero(place >= 0)
    keep = keep[np.argsort(place[keep], kind="stable")]
    place, owner = place[keep], owner[keep]
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, 4096):
        part = slice(*np.searchsorted(place, [low, low + 4096]))
        has = np.zeros((len(sets), int(place[part][-1]) + 1 - low), np.float32)
        has[owner[part], place[part] - low] = 1
        out += has[rows] @ has[columns].T
    return out


def spanning(n: int, pairs: np.ndarray) -> list[int]:
    """Numbers of those ``pairs`` of nodes below ``n`` that form a spanning forest."""
    parent, used = list(range(n)), []
    for k, (a, b) in enumerate(pairs.tolist()):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a != b:
            parent[a] = b
            used.append(k)
    return used


def verified(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """All pairs of rows of a key by the exact similarity of their sets, one block pair at a time.

    Rows with ``v`` are links that span the similar ones of a block pair, with ``similarity``; rows without give ``n``, how many rows
    of the block pair ``u`` is similar to. So a group costs as many rows as it has members in block pairs, not as it has links.
    """
    both = in_blocks(members).join(sets.hint("merge"), "id")

    def links(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        ids, block = part.column("id"), part.column("block").to_numpy()
        found = [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column("shingles")]
        lo, hi = part.column("lo")[0].as_py(), part.column("hi")[0].as_py()
        rows, columns = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        sizes = np.array([len(x) for x in found])
        common = common_counts(found, rows, columns) if len(rows) and len(columns) else np.zeros((len(rows), len(columns)))
        similarity = common / (sizes[rows][:, None] + sizes[columns][None] - common)
        near = similarity >= threshold
        if lo == hi:
            np.fill_diagonal(near, False)
        degree = np.zeros(len(ids), np.int64)
        degree[rows] += near.sum(1)
        if lo != hi:
            degree[columns] += near.sum(0)
        i, j = np.nonzero(np.triu(near) if lo == hi else near)
        used = spanning(len(ids), np.stack([rows[i], columns[j]], 1))
        i, j, linked = i[used], j[used], np.flatnonzero(degree)
        none = pa.nulls(len(linked))
        first = ids.take(pa.array(np.concatenate([rows[i], linked])))
        second = pa.chunked_array([ids.take(pa.array(columns[j])).combine_chunks(), none.cast(ids.type)], ids.type)
        return pa.table({
            "u": first,
            "v": second,
            "similarity": pa.chunked_array([pa.array(similarity[i, j]), none.cast(pa.float64())]),
            "n": pa.array(np.concatenate([np.zeros(len(used), np.int64), degree[linked]])),
        })

    kind = members.schema["id"].dataType.simpleString()
    return both.groupBy("key", "lo", "hi").applyInArrow(links, f"u {kind}, v {kind}, similarity double, n long")


def prefixes(nodes: DataFrame, depth: int, full_depth: int, trees: int) -> DataFrame:
    """``id``, ``key`` and ``size`` of every prefix that several nodes share. Prefixes with the same nodes are one: the smallest key stands."""
    keys = F.array(*[F.xxhash64(F.lit(t), F.substring("sig", 4 * t * full_depth + 1, 4 * depth)) for t in range(trees)])
    placed = nodes.select("id", "size", F.explode(keys).alias("key"))
    groups = placed.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")
    )
    kept = saved(groups.filter("n > 1").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key"), "prefixes")
    return placed.join(kept.hint("merge"), "key").select("id", "key", "size")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    size: int = SHINGLE,
    target_recall: float = TARGET_RECALL,
    trees: int = TREES,
    depth: int = DEPTH,
    count_links: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Membership and links.

    Membership has a row per input row: ``doc_id``, ``class_id`` (smallest id of the near-duplicate class), ``copy_of`` (smallest id with
    the same shingle set), ``n_links`` (how many different shingle sets of the class that one is similar to, all pairs of the
    class verified; null unless ``count_links``). Links are pairs ``u`` > ``v`` of such
    smallest ids with their exact ``similarity``; together they span every class, and pairs inside a class that
    follow from them are not all spelt out.

    Words are lower-cased and separated by ASCII white space. A text of one to four words is a single shingle, so it only equals itself. Null
    and blank texts are a class of their own each. Rows with one id count as one if their shingles agree; ids should be unique
    otherwise. A null id gets a null class. Other columns are not read, an empty table gives empty results.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text"))
    # Read twice: stored with the two columns that count, so the given table is opened once.
    known = saved(rows.filter(F.col("id").isNotNull()), "known-texts")
    level = prefix_depths(threshold, target_recall, trees, depth)[-1]
    sigs = saved(signatures(known, size, trees, depth), "signatures")
    members = sigs.select("id", "digest")
    first = saved(members.groupBy("digest").agg(F.min("id").alias("copy_of")), "first-copies")
    nodes = sigs.join(first.hint("merge"), "digest").filter("id = copy_of")
    nodes = nodes.groupBy("digest").agg(F.first("id").alias("id"), F.first("sig").alias("sig"), F.first("size").alias("size"))
    placed = saved(prefixes(saved(nodes.drop("digest"), "nodes"), level, depth, trees), "placed")
    # Made distinct before it is stored: an aggregation right below a join keeps its skewed keys from being split.
    sets = saved(shingle_sets(known, placed.select("id").distinct(), size).dropDuplicates(["id"]), "shingle-sets")
    found = saved(verified(placed, sets, threshold), "links").filter("v is not null")
    links = saved(
        found.groupBy(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).agg(F.min("similarity").alias("similarity")), "all-links"
    )
    components = connected_components(links.select("u", "v"))
    if not count_links:
        found = members.join(saved(first.join(components.withColumnRenamed("id", "copy_of"), "copy_of", "left").select(
            "digest", "copy_of", F.coalesce("component", "copy_of").alias("class_id")), "classes").hint("merge"), "digest")
        return _with_blanks(found.withColumn("n_links", F.lit(None).cast("long")), rows, id_col), links
    # Inside a class every pair counts, also one that shares no prefix.
    classed = sets.join(components, "id", "left").select(
        "id", F.coalesce("component", "id").alias("key"), F.expr("octet_length(shingles) div 8").alias("size")
    )
    counts = verified(saved(classed, "classed"), sets, threshold).filter("v is null")
    degree = counts.groupBy(F.col("u").alias("copy_of")).agg(F.sum("n").alias("n_links"))
    classes = first.join(components.withColumnRenamed("id", "copy_of"), "copy_of", "left").join(degree, "copy_of", "left")
    classes = saved(
        classes.select("digest", "copy_of", F.coalesce("component", "copy_of").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")),
        "classes",
    )
    return _with_blanks(members.join(classes.hint("merge"), "digest"), rows, id_col), links


def _with_blanks(found: DataFrame, rows: DataFrame, id_col: str) -> DataFrame:
    """Membership with the rows that have no word, or no id, as classes of their own."""
    blank = rows.filter(F.col("id").isNull() | (F.translate("text", " \t\n\x0b\f\r", "") == "")).select(
        "id", F.col("id").alias("class_id"), F.col("id").alias("copy_of"), F.lit(0).cast("long").alias("n_links")
    )
    return found.select("id", "class_id", "copy_of", "n_links").union(blank).withColumnRenamed("id", id_col)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """``docs`` as they are with the smallest id of every near-duplicate class; blank texts and null ids stay."""
    membership, _ = near_duplicates(docs, id_col, text_col, count_links=False, **options)
    dropped = saved(
        membership.filter(F.col(id_col) != F.col("class_id")).select(F.col(id_col).alias("__dropped")).distinct(), "dropped"
    )
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    return rows.join(dropped.hint("merge"), F.col(f"__row.`{id_col}`") == F.col("__dropped"), "left_anti").select("__row.*")
