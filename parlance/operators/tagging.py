"""Parts of speech by a hidden Markov model, and lemmas by word and part of speech.

The model is counted from a tagged token table by aggregations: how often a tag follows another, how often a word has a tag. Scores are
thousandths of natural logarithms, rounded down, so that equal paths tie exactly everywhere. Tagging is a Viterbi fold over the words of a row; an Arrow
batch folds all its rows side by side, one position at a time. Word scores go to the tasks while they fit a byte limit and are joined to
the words otherwise, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.batches import by_slices, list_lengths
from parlance.session import broadcast_if_small, saved

MAX_TAGS = 100
MAX_WORD_BYTES = 128 << 20

#: First letter of a Penn Treebank tag and the part of speech a lemma dictionary knows.
COARSE = {"J": "adj", "V": "verb", "N": "noun", "R": "adv"}


@dataclass(frozen=True)
class TagModel:
    """``tags``; ``start`` and ``unknown`` score per tag, ``follow`` per pair of tags; ``words`` (``token``, ``scores``, one per tag)."""

    tags: list[str]
    start: list[int]
    follow: list[list[int]]
    unknown: list[int]
    words: DataFrame


def coarse_tag(tag: Column) -> Column:
    """The dictionary's part of speech of a Penn Treebank tag; everything that is no adjective, verb or adverb counts as a noun."""
    found = F.lit("noun")
    for letter, name in COARSE.items():
        found = F.when(tag.startswith(letter), F.lit(name)).otherwise(found)
    return found


def score(count: Column | float, total: Column | float) -> Column:
    """Thousandths of the logarithm of a share, rounded down."""
    ratio = (F.lit(count) if not isinstance(count, Column) else count).cast("double") / total
    return F.floor(1000 * F.log(ratio)).cast("int")


def learn_tags(tagged: DataFrame, sequence: Sequence[str], position: str = "position", token: str = "token", tag: str = "tag") -> TagModel:
    """Count a model from rows of tagged words; ``sequence`` are the columns that name a text or sentence.

    Shares are smoothed by adding one. An unknown word is scored like the words that occur once. Rows without a word or tag are left out.
    At most ``MAX_TAGS`` tags; the driver sees counts per tag and pair of tags only.
    """
    rows = saved(
        tagged.select(
            F.struct(*sequence).alias("s"), F.col(position).alias("p"), F.col(token).alias("token"), F.col(tag).alias("tag")
        ).dropna(subset=["token", "tag"]),
        "tagged",
    )
    per_tag = {r["tag"]: r["n"] for r in rows.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).limit(MAX_TAGS + 1).collect()}
    if not per_tag:
        raise ValueError("no tagged words")
    if len(per_tag) > MAX_TAGS:
        raise ValueError(f"more than {MAX_TAGS} tags")
    tags = sorted(per_tag)
    before = F.lag("tag").over(Window.partitionBy("s").orderBy("p"))
    pairs = rows.select(before.alias("before"), "tag").groupBy("before", "tag").agg(F.count(F.lit(1)).alias("n"))
    counted = {(r["before"], r["tag"]): r["n"] for r in pairs.collect()}
    starts = sum(counted.get((None, t), 0) for t in tags)
    start = [log_share(counted.get((None, t), 0) + 1, starts + len(tags)) for t in tags]
    follow = []
    for first in tags:
        leaving = sum(counted.get((first, t), 0) for t in tags)
        follow.append([log_share(counted.get((first, t), 0) + 1, leaving + len(tags)) for t in tags])
    of_word = rows.groupBy("token").agg(*[F.count_if(F.col("tag") == t).alias(f"n{i}") for i, t in enumerate(tags)])
    of_word = saved(of_word, "word-tags")
    once = F.expr(" + ".join(f"n{i}" for i in range(len(tags)))) == 1
    sums = of_word.agg(F.count(F.lit(1)).alias("words"), *[F.sum(F.when(once, F.col(f"n{i}"))).alias(f"o{i}") for i in range(len(tags))]).first()
    words, rare = sums["words"], [sums[f"o{i}"] or 0 for i in range(len(tags))]
    total = sum(per_tag.values())
    unknown = [
        log_share(rare[i] + 1, sum(rare) + len(tags)) - log_share(per_tag[t] + 1, total + len(tags)) + log_share(1, words + 1)
        for i, t in enumerate(tags)
    ]
    scores = F.array(*[score(F.col(f"n{i}") + 1, float(per_tag[t] + words + 1)) for i, t in enumerate(tags)])
    return TagModel(tags, start, follow, unknown, saved(of_word.select("token", scores.alias("scores")), "word-scores"))


def log_share(count: int, total: int) -> int:
    return int(np.floor(1000 * np.log(count / total)))


def best_paths(scores: np.ndarray, lengths: np.ndarray, start: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """The best tag of every word: ``scores`` has a row of numbers per word, ``lengths`` words per text, texts one after the other.

    All texts that are long enough take a step together. Of equal paths the one with the smaller tag numbers, from the end on, is taken.
    """
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    longest = lengths[order]
    back, tag = np.zeros(scores.shape, np.int8), np.zeros(len(scores), np.int8)
    active = int((longest > 0).sum())
    now = start[None] + scores[first[:active]]
    ends = np.zeros((len(lengths), len(start)), np.int64)
    for step in range(1, int(longest[0]) + 1 if len(longest) else 0):
        going = int(np.searchsorted(-longest, -step, "left"))  # texts of more than ``step`` words
        ends[going:active] = now[going:]
        if not going:
            break
        reached = now[:going, :, None] + follow[None]
        places = first[:going] + step
        back[places] = reached.argmax(1)
        now, active = reached.max(1) + scores[places], going
    last = ends.argmax(1)
    for step in range(int(longest[0]) - 1 if len(longest) else -1, -1, -1):
        going = int(np.searchsorted(-longest, -step, "left"))
        places = first[:going] + step
        tag[places] = last[:going]
        last[:going] = back[places, last[:going]]
    return tag


def tag_words(df: DataFrame, words: str, model: TagModel, out: str = "tags", max_word_bytes: int = MAX_WORD_BYTES, key: str | None = None) -> DataFrame:
    """Add ``out``: the part of speech of every element of the string array ``words``; null stays null, a null word is unknown.

    A model of more than ``max_word_bytes`` is joined to the words instead of being sent to the tasks; ``key`` must then identify a row.
    """
    size = model.words.agg(F.sum(F.octet_length("token") + 4 * F.size("scores"))).first()[0] or 0
    if size <= max_word_bytes:
        place = {r["token"]: r["scores"] for r in model.words.toLocalIterator()}
        shared = df.sparkSession.sparkContext.broadcast(
            ({w: i for i, w in enumerate(place)}, np.array([*place.values(), model.unknown], np.int64).reshape(-1, len(model.tags)))
        )
        return df.withColumn(out, _tagger(model, shared)(F.col(words)))
    if key is None:
        raise ValueError("a model of this size needs the column that identifies a row")
    spelt = df.select(key, F.posexplode(words).alias("position", "token"))
    known = spelt.join(broadcast_if_small(model.words), "token", "left")
    unknown = F.array(*[F.lit(x) for x in model.unknown])
    rows = known.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", F.coalesce("scores", unknown).alias("scores")))).alias("s"))
    tagged = rows.select(key, _tagger(model, None)(F.transform("s", lambda x: x["scores"])).alias(out))
    joined = df.drop(out).join(saved(tagged, "tags"), key, "left")
    empty = F.when(F.size(words) == 0, F.array().cast("array<string>"))
    return joined.withColumn(out, F.coalesce(F.col(out), empty))


def _tagger(model: TagModel, shared):
    """A column function from words (or from their scores, if nothing is shared) to tags."""
    start, follow = np.array(model.start, np.int64), np.array(model.follow, np.int64)
    names = pa.array(model.tags)

    def tagged(column: pa.Array) -> pa.Array:
        lengths = list_lengths(column)
        inside = column.flatten()
        if shared is None:
            scores = inside.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, len(start))
        else:
            places, table = shared.value
            distinct = inside.dictionary_encode()
            known = np.array([places.get(w, len(table) - 1) for w in distinct.dictionary.to_pylist()] + [len(table) - 1])
            scores = table[known[pc.fill_null(distinct.indices, len(known) - 1).to_numpy(zero_copy_only=False)]]
        found = names.take(pa.array(best_paths(scores, lengths, start, follow)))
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), mask=np.append(column.is_null().to_numpy(zero_copy_only=False), False))
        return pa.ListArray.from_arrays(offsets, found)

    @F.arrow_udf("array<string>")
    def tag(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield by_slices(column, tagged)

    return tag


def lemmatise_tagged(token_rows: DataFrame, dictionary: DataFrame, max_broadcast: int = 200_000) -> DataFrame:
    """Add ``lemma`` by (``token``, ``tag``); what the dictionary (``token``, ``tag``, ``lemma``) lacks stays as it is.

    Of several entries for a word and tag the alphabetically first counts. The dictionary is broadcast while it is small.
    """
    known = saved(dictionary.groupBy("token", "tag").agg(F.min("lemma").alias("lemma")), "tagged-lemmas")
    joined = token_rows.join(broadcast_if_small(known, max_broadcast), ["token", "tag"], "left")
    return joined.withColumn("lemma", F.coalesce("lemma", "token"))


def normalise_tagged(df: DataFrame, words: str, keys: Sequence[str], model: TagModel, dictionary: DataFrame, out: str = "clean_text") -> DataFrame:
    """Add the words of every row as lemmas by part of speech, one blank between them; ``keys`` identify a row."""
    tagged = tag_words(df.select(*keys, words), words, model, "__tags")
    pairs = tagged.select(*keys, F.posexplode(F.arrays_zip(F.col(words).alias("token"), F.col("__tags").alias("tag"))).alias("position", "pair"))
    lemmas = lemmatise_tagged(pairs.select(*keys, "position", "pair.token", "pair.tag"), dictionary)
    ordered = F.array_sort(F.collect_list(F.struct("position", "lemma")))
    texts = lemmas.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda t: t["lemma"]), " ").alias(out))
    joined = df.drop(out).join(saved(texts, "lemma-texts"), list(keys), "left")
    return joined.withColumn(out, F.coalesce(out, F.lit("")))
