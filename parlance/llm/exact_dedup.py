"""Exact duplicates: 128-bit content hashes, one row per group stays, bytes settle collisions.

The text is shuffled once, and of that shuffle only rows of repeated hashes go on. Everything else moves
keys and digests. Groups are counted by partial aggregation and joined back by hash, so a text that makes up
a third of all rows is one row per map task in the count and is split by the adaptive join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import lower_ascii
from parlance.session import saved


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    content_hash: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, ``group_key``.

    Texts are equal when they are the same bytes after lower-casing A-Z; null is the empty text. Of equal texts
    the row with the smallest (or largest) id stays. Of repeated rows with one id exactly one stays. A null
    id is smaller than any other. An empty table gives an empty result, and other columns of ``docs`` are not read.
    ``content_hash`` makes the hash from the normalised text instead of MD5; a weak one only costs time.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    make_hash = content_hash or (lambda norm: F.unhex(F.md5(norm.cast("binary"))))
    keyed = docs.select(F.col(id_col).alias("id"), lower_ascii(F.col(text_col)).alias("norm")).withColumn(
        "h", make_hash(F.col("norm"))
    )
    narrow = saved(
        keyed.select(
            "id", "h", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha"),
            F.monotonically_increasing_id().alias("row_no"),
        ),
        "digests",
    )
    repeated = saved(
        narrow.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).filter("n > 1").drop("n"),
        "repeated",
    )
    # A shuffled join at every size: the table of repeated hashes grows with the data.
    texts = saved(keyed.join(repeated.hint("merge"), "h").select("h", "id", "norm", "first_id"), "repeated-texts")
    # Stored, because an aggregation right below the join would keep the texts of a large group from being split.
    representative = saved(
        texts.filter(F.col("id").eqNullSafe(F.col("first_id"))).groupBy("h").agg(F.min("norm").alias("rep")), "representatives"
    )
    # Rows whose bytes differ from their group's text although the hash agrees. As good as always none.
    differing = saved(
        texts.join(representative, "h").filter(F.col("norm") != F.col("rep"))
        .select("h", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha")),
        "collisions",
    )
    collided = differing.distinct().withColumn("collision", F.lit(True))
    member = narrow.join(collided, ["h", "sha"], "left").withColumn(
        "group_key", F.when(F.col("collision"), F.concat("h", "sha")).otherwise(F.col("h"))
    )
    choose = F.min if keep == "smallest" else F.max
    groups = saved(
        member.groupBy("group_key").agg(
            F.count(F.lit(1)).alias("group_size"), choose(F.struct("id", "row_no")).alias("keep")
        ),
        "groups",
    )
    return member.join(groups.hint("merge"), "group_key").select(
        F.col("id").alias(id_col),
        F.col("keep.id").alias("keep_id"),
        "group_size",
        (F.col("row_no") == F.col("keep.row_no")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "group_key",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """``docs`` with one row per group of equal texts, all columns as they were.

    Same rules as ``exact_groups``. Clashing column names cannot occur, the helper columns carry a double underscore
    and the columns of ``docs`` travel in one struct.
    """
    groups = exact_groups(docs, id_col, text_col, keep)

    def key(identifier: Column, sha: Column) -> Column:
        """Digest and id in one key, so that the copies of a text are spread over all tasks."""
        return F.concat(sha, F.coalesce(identifier.cast("string"), F.lit("")).cast("binary"))

    winners = saved(
        groups.filter("kept").select(F.col(id_col).alias("__keep_id"), key(F.col(id_col), F.unhex("text_sha256")).alias("__key")), "winners"
    )
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    sha = F.unhex(F.sha2(lower_ascii(F.col(f"__row.`{text_col}`")).cast("binary"), 256))
    joined = rows.withColumn("__key", key(F.col(f"__row.`{id_col}`"), sha)).join(winners.hint("merge"), "__key").filter(
        F.col(f"__row.`{id_col}`").eqNullSafe(F.col("__keep_id"))
    )
    # One id with one text may be written several times: the join's order is by its key, so this needs no new sort.
    return joined.groupBy("__key").agg(F.first("__row").alias("__row")).select("__row.*")
