"""Dictionary lemmatisation as a join."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.functions.batches import by_slices, list_lengths
from parlance.operators.filters import with_computed
from parlance.session import broadcast_if_small, saved


def explode_tokens(df: DataFrame, keys: Sequence[str], words: Column) -> DataFrame:
    """One row per token: keys, ``position``, ``token``."""
    return df.select(*keys, F.posexplode(words).alias("position", "token"))


def distinct_lemmas(dictionary: DataFrame) -> DataFrame:
    """One lemma per token: of several entries the alphabetically first."""
    return dictionary.groupBy("token").agg(F.min("lemma").alias("lemma"))


def lemmatise(token_rows: DataFrame, dictionary: DataFrame, max_broadcast: int = 200_000) -> DataFrame:
    """Add ``lemma``; a token the dictionary lacks stays as it is.

    The dictionary is stored once and broadcast only while it is small. Above that the join shuffles,
    and adaptive execution splits the partitions of frequent words.
    """
    known = saved(distinct_lemmas(dictionary), "lemmas")
    joined = token_rows.join(broadcast_if_small(known, max_broadcast), "token", "left")
    return joined.withColumn("lemma", F.coalesce("lemma", "token"))


def collect_text(token_rows: DataFrame, keys: Sequence[str], word: str = "lemma", out: str = "clean_text") -> DataFrame:
    """Put the words of a document back in order, one blank between them."""
    ordered = F.array_sort(F.collect_list(F.struct("position", F.col(word).alias("word"))))
    return token_rows.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda t: t["word"]), " ").alias(out))


def normalise(
    df: DataFrame,
    text: str,
    keys: Sequence[str],
    dictionary: DataFrame | None = None,
    stopwords: Sequence[str] = (),
    out: str = "clean_text",
    max_dictionary_bytes: int = 128 << 20,
) -> DataFrame:
    """Add the normalised text; with a dictionary the tokens are lemmatised on the way.

    A dictionary of at most ``max_dictionary_bytes`` is shipped to the tasks, which look the words up where the text is
    read. A larger one is joined to the tokens, with the same result; ``keys`` must then identify a row.
    """
    if dictionary is None:
        return with_computed(df, out, tx.normalised_text(F.col(text), stopwords))
    words = tx.normalised_tokens(F.col(text), stopwords)
    known = saved(distinct_lemmas(dictionary), "lemmas")
    size = known.agg(F.sum(F.octet_length("token") + F.octet_length("lemma"))).first()[0] or 0
    if size <= max_dictionary_bytes:
        return df.drop(out).select("*", F.inline(F.array(F.struct(_lemma_writer(known)(words).alias(out)))))
    lemmas = lemmatise(explode_tokens(df, keys, words), dictionary)
    joined = df.join(collect_text(lemmas, keys, "lemma", out), list(keys), "left")
    return joined.withColumn(out, F.coalesce(out, F.lit("")))


def _lemma_writer(known: DataFrame):
    shared = known.sparkSession.sparkContext.broadcast({r["token"]: r["lemma"] for r in known.toLocalIterator()})

    def joined(lists: pa.Array) -> pa.Array:
        lemma = shared.value.get
        distinct = lists.flatten().dictionary_encode()
        found = pa.array([lemma(w) or w for w in distinct.dictionary.to_pylist()], pa.string())
        offsets = np.append(0, np.cumsum(list_lengths(lists))).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), found.take(distinct.indices)), " ")

    @F.arrow_udf("string")
    def write(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield by_slices(column, joined)

    return write
