"""Merkle manifest of a table: a tree per group, a tree over the groups, proofs, and versions by path copying.

Nodes are persistent: a changed leaf makes a version of its tree that copies the leaf's ancestors and shares every other node. Trees
are cut into aligned blocks of ``arity ** block_levels`` nodes, so that a task holds one block, however many rows a group has. Block roots
are the leaves of the level above, which is cut into blocks in the same way, until one node is left. A version begins in the block of its leaf;
its block root goes on along the path that the distributed upper levels give for that block.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.numbering import numbered
from parlance.session import saved

ARITY = 3
BLOCK_LEVELS = 6


@dataclass(frozen=True, slots=True)
class Node:
    """A digest as hex text; inner nodes know their children. Nodes are never changed, so versions may share them."""

    digest: bytes
    children: tuple[Node, ...] = ()


def parent_of(children: tuple[Node, ...]) -> Node:
    return Node(sha256(b"".join([c.digest for c in children])).hexdigest().encode(), children)


def grow(leaves: Sequence[Node], levels: int, arity: int = ARITY) -> Node:
    """The root above ``leaves`` after ``levels`` levels; the last run of a level may be short, even a single node."""
    row = list(leaves)
    for _ in range(levels):
        row = [parent_of(tuple(row[i : i + arity])) for i in range(0, len(row), arity)]
    return row[0]


def descent(root: Node, levels: int, place: int, arity: int = ARITY) -> list[tuple[Node, int]]:
    """The inner nodes from the root down to the leaf at ``place``, each with the number of the child that is taken."""
    steps = []
    for level in range(levels - 1, -1, -1):
        turn = place // arity**level % arity
        steps.append((root, turn))
        root = root.children[turn]
    return steps


def path_of(steps: list[tuple[Node, int]]) -> list[tuple[int, tuple[bytes, ...]]]:
    """Level by level from the leaf up: the own number in the run and the digests of the others, left to right."""
    return [(turn, tuple(c.digest for i, c in enumerate(node.children) if i != turn)) for node, turn in reversed(steps)]


def changed(steps: list[tuple[Node, int]], leaf: Node) -> Node:
    """The root of the version with another leaf: copies of the ancestors, everything else shared."""
    for node, turn in reversed(steps):
        leaf = parent_of(node.children[:turn] + (leaf,) + node.children[turn + 1 :])
    return leaf


def folded(digest: bytes, path: list[tuple[int, tuple[bytes, ...]]]) -> bytes:
    """The root that a digest and the siblings on its path lead to."""
    for turn, others in path:
        digest = sha256(b"".join([*others[:turn], digest, *others[turn:]])).hexdigest().encode()
    return digest


def packed(path: list[tuple[int, tuple[bytes, ...]]]) -> bytes:
    """A path as bytes: per level the own number, how many others, and their digests."""
    return b"".join([bytes([turn, len(others)]) + bytes.fromhex(b"".join(others).decode()) for turn, others in path])


def unpacked(data: bytes) -> list[tuple[int, tuple[bytes, ...]]]:
    path, at = [], 0
    while at < len(data):
        turn, n = data[at], data[at + 1]
        path.append((turn, tuple(data[at + 2 + 32 * k : at + 34 + 32 * k].hex().encode() for k in range(n))))
        at += 2 + 32 * n
    return path


def levels_of(n: int, arity: int, most: int) -> int:
    """Levels above ``n`` nodes until one is left, at most those of a block."""
    levels = 0
    while n > 1 and levels < most:
        n, levels = -(-n // arity), levels + 1
    return levels


def hex_nodes(column: pa.ChunkedArray) -> list[Node]:
    return [Node(d.hex().encode()) for d in column.to_pylist()]


def climb(nodes: DataFrame, largest: int, arity: int, block_levels: int) -> tuple[DataFrame, DataFrame]:
    """Roots (``tree``, ``root``) and paths (``tree``, ``pos``, ``path``) of trees of up to ``largest`` nodes (``tree``, ``n``, ``pos``, ``digest``)."""
    if largest <= 1:
        return nodes.select("tree", F.col("digest").alias("root")), nodes.select("tree", "pos", F.lit(b"").alias("path"))
    size = arity**block_levels

    def walk(part: pa.Table) -> pa.Table:
        part = part.sort_by("pos")
        levels = levels_of(part.column("n")[0].as_py(), arity, block_levels)
        root = grow(hex_nodes(part.column("digest")), levels, arity)
        paths = [packed(path_of(descent(root, levels, i, arity))) for i in range(len(part))]
        above = part.slice(0, 1)  # the block's own row comes last, without a path
        return pa.table({
            "tree": pa.concat_arrays([*part.column("tree").chunks, *above.column("tree").chunks]),
            "n": pa.concat_arrays([*part.column("n").chunks, *above.column("n").chunks]),
            "pos": pa.array([*part.column("pos").to_pylist(), part.column("block")[0].as_py()], pa.int64()),
            "path": pa.array([*paths, None], pa.binary()),
            "root": pa.array([*[None] * len(paths), bytes.fromhex(root.digest.decode())], pa.binary()),
        })

    blocks = nodes.withColumn("block", F.floor(F.col("pos") / size)).groupBy("tree", "block")
    walked = saved(blocks.applyInArrow(walk, "tree string, n long, pos long, path binary, root binary"), "walked")
    above = walked.filter("root is not null").select(
        "tree", F.ceil(F.col("n") / size).alias("n"), "pos", F.col("root").alias("digest")
    )
    roots, upper = climb(above, -(-largest // size), arity, block_levels)
    inner = walked.filter("path is not null").withColumn("block", F.floor(F.col("pos") / size))
    joined = inner.join(upper.select("tree", F.col("pos").alias("block"), F.col("path").alias("upper")), ["tree", "block"])
    return roots, joined.select("tree", "pos", F.concat("path", "upper").alias("path"))


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    """SHA-256 (binary) of the fields of a row."""
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256))


def manifest(
    docs: DataFrame, id_col: str, group_col: str, leaf: Column, tampered: Column | None = None, arity: int = ARITY,
    block_levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """One row per row of ``docs``: id, ``leaf``, ``subroot`` of its group, ``root`` of all, ``proof_sha256``, ``folded_root``, ``verified``.

    ``leaf`` and ``tampered`` are binary SHA-256 digests; where ``tampered`` is null nothing was changed, otherwise it makes a version of the
    tree. Digests in the result are hex text. ``proof_sha256`` is the digest of all siblings from the leaf to the root, ``folded_root``
    the root of the leaf's version, ``verified`` whether that is the root of all.

    Leaves of a group ascend by id (null first), rows with one id by their leaf. Groups ascend by the bytes of their name, the null
    group first; the empty name is a group of its own. Repeated rows are leaves of their own. A single leaf is its group's subroot, a
    single subroot the root, and the proof of a lone leaf is the digest of nothing. An empty table gives an empty result. Other columns are not
    read unless ``leaf`` names them.
    """
    group, size = F.col(f"`{group_col}`").cast("string"), arity**block_levels
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group)).alias("tree"),
        leaf.alias("leaf"),
        (F.lit(None).cast("binary") if tampered is None else tampered).alias("tampered"),
    )
    # Stored before they are ordered: Spark reads the rows twice to find the ranges, and the texts should be hashed once.
    placed = numbered(saved(rows, "leaf-digests"), ["tree"], ["id", "leaf"]).withColumn("block", F.floor(F.col("pos") / size))
    placed = saved(placed.select("tree", "n", "block", "pos", "id", "leaf", "tampered"), "leaves")
    largest = placed.agg(F.max("n")).first()[0] or 0

    def block_root(part: pa.Table) -> pa.Table:
        part = part.sort_by("pos")
        levels = levels_of(part.column("n")[0].as_py(), arity, block_levels)
        root = grow(hex_nodes(part.column("leaf")), levels, arity)
        first = part.slice(0, 1).select(["tree", "n", "block"])
        return first.append_column("digest", pa.array([bytes.fromhex(root.digest.decode())], pa.binary()))

    roots = placed.select("tree", "n", "block", "pos", "leaf").groupBy("tree", "block")
    blocks = saved(roots.applyInArrow(block_root, "tree string, n long, block long, digest binary"), "blocks")
    above = blocks.select("tree", F.ceil(F.col("n") / size).alias("n"), F.col("block").alias("pos"), "digest")
    subroots, in_group = climb(above, -(-largest // size), arity, block_levels)
    subroots = saved(subroots, "subroots")
    groups = numbered(subroots.select(F.lit("").alias("top"), "tree", F.col("root").alias("digest")), ["top"], ["tree"])
    groups = saved(groups.select(F.col("top"), "tree", "n", "pos", "digest"), "groups")
    n_groups = groups.count()
    top, of_group = climb(groups.select(F.col("top").alias("tree"), "n", "pos", "digest"), n_groups, arity, block_levels)
    found = top.first()
    root_of_all = bytes(found["root"]) if found else b""
    above_group = groups.join(of_group.select("pos", F.col("path").alias("upper")), "pos").select(
        "tree", F.col("digest").alias("subroot"), "upper"
    )
    block_paths = saved(
        in_group.join(above_group, "tree").select(
            "tree", F.col("pos").alias("block"), "subroot", F.concat("path", "upper").alias("path")
        ),
        "block-paths",
    )

    def finish(key: tuple, part: pa.Table, paths: pa.Table) -> pa.Table:
        part = part.sort_by("pos")
        levels, leaves = levels_of(part.column("n")[0].as_py(), arity, block_levels), hex_nodes(part.column("leaf"))
        tree, upper = grow(leaves, levels, arity), unpacked(paths.column("path")[0].as_py())
        whole = folded(tree.digest, upper)
        beyond = b"".join([d for _, others in upper for d in others])
        proofs, roots = [], []
        for place, other in enumerate(part.column("tampered").to_pylist()):
            steps = descent(tree, levels, place, arity)
            siblings = [d for _, others in path_of(steps) for d in others]
            proofs.append(sha256(b"".join(siblings) + beyond).hexdigest())
            # The version of an untouched leaf is the tree itself.
            version = tree if other is None else changed(steps, Node(other.hex().encode()))
            roots.append((whole if version.digest == tree.digest else folded(version.digest, upper)).decode())
        n = len(part)
        return pa.table({
            "id": part.column("id"),
            "leaf": pa.array([x.digest.decode() for x in leaves]),
            "subroot": pa.array([paths.column("subroot")[0].as_py().hex()] * n),
            "root": pa.array([root_of_all.hex()] * n),
            "proof_sha256": pa.array(proofs),
            "folded_root": pa.array(roots),
            "verified": pa.array([r == root_of_all.hex() for r in roots]),
        })

    kind = docs.schema[id_col].dataType.simpleString()
    digests = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    both = placed.groupBy("tree", "block").cogroup(block_paths.groupBy("tree", "block"))
    return both.applyInArrow(finish, f"id {kind}, {digests}").withColumnRenamed("id", id_col)
