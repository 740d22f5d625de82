"""Importance resampling towards a target: hashed word n-grams counted with Arrow kernels, weights, exact draws.

A document's weight compares how common its n-grams are in the target texts and in the whole corpus. The draw adds to every weight a
Gumbel variable that depends on the document's id only, and takes the highest sums: sampling without replacement in proportion to the
exponential of the weight, the same however the rows are partitioned.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.numbering import numbered
from parlance.session import saved

BUCKETS = 10_000
#: What separates words once A-Z is lower-cased: every ASCII character that is neither a digit nor a letter.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MOST_BYTES = 4 << 20


def in_slices(texts: pa.Array, most_bytes: int = MOST_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive slices of at most ``most_bytes`` of text, or of one longer text, with the number of their first row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    low = 0
    while low < len(texts):
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + most_bytes, "right")))
        yield low, texts.slice(low, high - low)
        low = high


def crc_buckets(strings: pa.Array, buckets: int) -> np.ndarray:
    return np.array([zlib.crc32(s) % buckets for s in strings.cast(pa.large_binary()).to_pylist()], np.int64)


def feature_buckets(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of every n-gram of 1 to ``longest`` words, grouped by n, and the words of every row.

    Words are dictionary-encoded; the codes of n-grams are pairs of the code of an n-1-gram and of the word after it, and the hash of every
    distinct pair is taken once.
    """
    # Taken row by row: a slice shares the buffer of its array, and after the cast Arrow's lower-casing reads it from the wrong place.
    whole = pc.fill_null(texts, "").cast(pa.large_string()).take(pa.array(np.arange(len(texts))))
    lowered = pc.ascii_lower(whole)
    lists = pc.split_pattern_regex(lowered, pattern=SEPARATORS)
    rows, words = pc.list_parent_indices(lists), pc.list_flatten(lists)
    real = pc.not_equal(words, "")
    rows, words = rows.filter(real).to_numpy().astype(np.int64), words.filter(real)
    encoded = words.dictionary_encode()
    code, single = encoded.indices.to_numpy().astype(np.int64), encoded.dictionary
    n_words = np.bincount(rows, minlength=len(texts))
    all_rows, all_buckets = [rows], [crc_buckets(single, buckets)[code]]
    grams, now = single, code
    for n in range(2, longest + 1):
        whole = np.flatnonzero(rows[n - 1 :] == rows[: len(rows) - n + 1])  # n-grams do not cross from one text to the next
        if not len(whole):
            break
        pairs = now[whole] * len(single) + code[whole + n - 1]
        distinct, place = np.unique(pairs, return_inverse=True)
        grams = pc.binary_join_element_wise(
            grams.take(pa.array(distinct // len(single))), single.take(pa.array(distinct % len(single))), pa.scalar(" ", single.type)
        )
        all_rows.append(rows[whole])
        all_buckets.append(crc_buckets(grams, buckets)[place])
        now = np.zeros(len(rows), np.int64)
        now[whole] = place
    return np.concatenate(all_rows), np.concatenate(all_buckets), n_words


def bucket_counts(texts: DataFrame, text_col: str, longest: int, buckets: int) -> np.ndarray:
    """How many n-grams of all texts fall into each bucket. A task sends at most one row per bucket, the driver gets ``buckets`` numbers."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for part in parts:
            for _, some in in_slices(part.column(0)):
                counts += np.bincount(feature_buckets(some, longest, buckets)[1], minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], ["bucket", "n"])

    sums = texts.select(F.col(f"`{text_col}`").cast("string").alias("t")).mapInArrow(batches, "bucket int, n long")
    table = sums.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(buckets, np.int64)
    counts[table["bucket"].to_numpy()] = table["n"].to_numpy()
    return counts


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousand times the logarithm of the ratio of smoothed shares in target and source, rounded down."""
    buckets, all_source, all_target = len(source), int(source.sum()), int(target.sum())
    ratios = [
        float(t + 1) * float(all_source + buckets) / (float(s + 1) * float(all_target + buckets))
        for s, t in zip(source.tolist(), target.tolist(), strict=True)
    ]
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def weights(docs: DataFrame, id_col: str, text_col: str, gains: np.ndarray, longest: int) -> DataFrame:
    """``id``, ``n_features``, ``n_words`` and ``weight`` (sum of its features' gains) of every row. ``gains`` has one number per bucket."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for low, some in in_slices(part.column(1)):
                rows, found, n_words = feature_buckets(some, longest, len(shared.value))
                order = np.argsort(rows, kind="stable") if longest > 1 else slice(None)
                sums = np.concatenate([[0], np.cumsum(shared.value[found[order]])])
                n = np.bincount(rows, minlength=len(some))
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).slice(low, len(some)), pa.array(n), pa.array(n_words), pa.array(sums[ends] - sums[ends - n])],
                    ["id", "n_features", "n_words", "weight"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    return rows.mapInArrow(batches, f"id {kind}, n_features long, n_words long, weight long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    longest: int = 2,
    buckets: int = BUCKETS,
    percent: int = 10,
    min_words: int = 20,
    seed: int = 2024,
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_features``, ``weight``, ``score``, ``rank``.

    Words are runs of ASCII letters, digits and all characters beyond ASCII; A-Z is lower-cased. Features are the n-grams of 1 to ``longest``
    words, hashed by CRC-32. Of the N rows with ``min_words`` words or more the ``percent * N / 100`` highest scores are drawn and
    ranked from 1 on, equal scores by the smaller id (null first); ``rank`` of all others is null. A text without a word, and a null text, has
    weight 0. A null id counts as the empty text in the draw. Repeated rows are drawn one by one. Without target texts the gains compare
    with an even spread. An empty table gives an empty result; other columns are not read.
    """
    gains = bucket_gains(
        bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_text_col, longest, buckets)
    )
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = saved(weights(docs, id_col, text_col, gains, longest).withColumn("score", (F.col("weight") + gumbel).cast("long")), "scored")
    eligible = scored.filter(F.col("n_words") >= min_words).withColumn("less", -F.col("score"))
    drawn = percent * eligible.count() // 100
    ranked = numbered(eligible.withColumn("all", F.lit(0)), ["all"], ["less", "id"], "place").select(
        "id", "n_features", "weight", "score", F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank")
    )
    others = scored.filter(F.col("n_words") < min_words).select(
        "id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")
    )
    return ranked.unionByName(others).withColumnRenamed("id", id_col)
