"""Topic coherence c_v over sliding windows, counted with bit masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.session import broadcast_if_small, saved

EPSILON = 1e-12
BITS = 64


def window_masks(df: DataFrame, keys: Sequence[str], text: str, terms: DataFrame, window: int) -> DataFrame:
    """Per document, block of 64 window starts and term: which of the windows hold the term, as bits.

    A word at position p lies in the windows starting at ``p - window + 1 .. p``, at most three
    blocks; masks of repeated words are or-ed, so windows are never spelled out.
    """
    words = df.select(*keys, tx.tokens(F.col(text)).alias("__t")).withColumn("__n", F.size("__t"))
    last = F.greatest(F.col("__n") - window, F.lit(0))
    hits = words.select(*keys, last.alias("__last"), F.posexplode("__t").alias("__p", "term")).join(terms, "term")
    spans = hits.select(
        *keys, "term", F.greatest(F.col("__p") - (window - 1), F.lit(0)).alias("lo"), F.least("__p", "__last").alias("hi")
    )
    blocks = spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / BITS), F.floor(F.col("hi") / BITS))))
    low = F.greatest(F.col("lo") - F.col("block") * BITS, F.lit(0)).cast("int")
    high = F.least(F.col("hi") - F.col("block") * BITS, F.lit(BITS - 1)).cast("int")
    bits = blocks.withColumns({"__low": low, "__width": (F.lit(BITS - 1) - (high - low)).cast("int")})
    mask = F.expr("shiftleft(shiftrightunsigned(-1L, __width), __low)")
    return bits.groupBy(*keys, "block", "term").agg(F.bit_or(mask).alias("mask"))


def window_counts(df: DataFrame, keys: Sequence[str], text: str, words: DataFrame, window: int) -> DataFrame:
    """Windows holding both of two words of a topic: ``topic``, ``i``, ``j`` (i <= j), ``n``."""
    listed = saved(words.select("topic", "rank", "term"), "topic-terms")
    terms = listed.groupBy("term").agg(F.count(F.lit(1)).alias("__topics")).select("term")
    masks = window_masks(df, keys, text, broadcast_if_small(terms), window)
    placed = masks.join(broadcast_if_small(listed), "term")
    # One array per document, block and topic: at most as long as the topic's word list.
    sets = placed.groupBy(*keys, "block", "topic").agg(F.collect_list(F.struct("rank", "mask")).alias("w"))
    pairs = sets.select("topic", "w", F.explode("w").alias("a")).select("topic", "a", F.explode("w").alias("b"))
    both = F.bit_count(F.col("a.mask").bitwiseAND(F.col("b.mask")))
    return pairs.filter(F.col("a.rank") <= F.col("b.rank")).groupBy(
        "topic", F.col("a.rank").alias("i"), F.col("b.rank").alias("j")
    ).agg(F.sum(both).alias("n"))


def window_total(df: DataFrame, text: str, window: int) -> DataFrame:
    """Sliding windows of all documents; a document shorter than the window is one."""
    size = F.size(tx.tokens(F.col(text)))
    return df.filter(F.col(text).isNotNull()).agg(F.sum(F.greatest(size - window + 1, F.lit(1))).alias("windows"))


def topic_coherence(
    df: DataFrame, keys: Sequence[str], text: str, words: DataFrame, window: int = 110
) -> DataFrame:
    """c_v per topic: the mean cosine between each word's NPMI vector and the topic's summed vector.

    ``words`` has ``topic``, ``rank`` and ``term``, outliers left out. Words that occur in no document are skipped.
    """
    counts = saved(window_counts(df, keys, text, words.filter(F.col("topic") != -1), window), "window-counts")
    total = window_total(df, text, window).scalar()
    single = counts.filter("i = j").select("topic", F.col("i").alias("k"), F.col("n").alias("n_k"))
    half = counts.select("topic", "i", "j", "n")
    mirrored = half.unionByName(half.filter("i < j").select("topic", F.col("j").alias("i"), F.col("i").alias("j"), "n"))
    spine = single.select("topic", F.col("k").alias("i")).join(single.select("topic", F.col("k").alias("j")), "topic")
    full = spine.join(mirrored, ["topic", "i", "j"], "left").fillna(0, ["n"])
    full = full.join(single.withColumnsRenamed({"k": "i", "n_k": "n_i"}), ["topic", "i"]).join(
        single.withColumnsRenamed({"k": "j", "n_k": "n_j"}), ["topic", "j"]
    )
    joint = F.col("n") / total + EPSILON
    npmi = F.log(joint / ((F.col("n_i") / total) * (F.col("n_j") / total))) / -F.log(joint)
    vectors = full.select("topic", "i", "j", npmi.alias("v"))
    sums = vectors.groupBy("topic", "j").agg(F.sum("v").alias("s"))
    lengths = sums.groupBy("topic").agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("len"))
    cosines = vectors.join(sums, ["topic", "j"]).groupBy("topic", "i").agg(
        F.sum(F.col("v") * F.col("s")).alias("dot"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("len_i")
    ).join(lengths, "topic")
    cosine = F.when(F.col("len_i") * F.col("len") > 0, F.col("dot") / (F.col("len_i") * F.col("len"))).otherwise(F.lit(0.0))
    return cosines.groupBy("topic").agg(F.avg(cosine).alias("coherence"))


def coherence_cv(df: DataFrame, keys: Sequence[str], text: str, words: DataFrame, window: int = 110) -> DataFrame:
    """Mean c_v over the topics."""
    return topic_coherence(df, keys, text, words, window).agg(F.avg("coherence").alias("coherence_cv"))
