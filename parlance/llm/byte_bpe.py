"""Byte-level BPE: a fold of ranked merges over byte arrays of distinct words, and its inverse.

A word starts as its single bytes. Each step of the fold merges the neighbouring pair whose joined bytes have the smallest rank,
leftmost first, until no pair has a rank. ``fold_merges`` says this with Spark's higher-order functions over a literal rank map;
bytes are written as the characters U+0000 to U+00FF there, and the map is an array of small maps picked by a checksum,
because Spark searches a map from its first key on.

The distinct words of the corpus are counted, and the most frequent ones, at most ``dictionary_words``, are folded once in the JVM. That
table is bounded by its parameter and is broadcast. Documents then pass once through Arrow batches: known words are
looked up, the other distinct words of a task are folded where they stand. No document is shuffled and no word is left out,
however large the vocabulary of the corpus is.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.session import saved

#: White space as the tokenizer's pattern means it (Unicode White_Space); Java's ``\s`` alone is ASCII.
SPACE = r"\t\n\x0B\f\r\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
NO_RANK = 2**31 - 1
RANK_BUCKETS = 16384
LONGEST_DICTIONARY_WORD = 32
#: Bytes of a match from which on its pairs wait in a heap.
LONG_MATCH = 200
#: A task forgets its folded words beyond this many, so that its memory stays bounded; results do not change.
TASK_WORDS = 300_000
#: Rows of an Arrow batch that are Python objects at a time.
BATCH_ROWS = 500

Ranks = list[tuple[bytes, int]]


def load_ranks(path: str) -> Ranks:
    """Lines of base64 bytes and rank. Read on the driver; the vocabulary is a parameter of bounded size."""
    with open(path, "rb") as lines:
        return [(base64.b64decode(token), int(rank)) for token, rank in map(bytes.split, lines)]


def java_pattern(pattern: str) -> str:
    """The tokenizer's pattern with its white space spelt out for Java."""
    return pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")


# The fold as Spark expressions


def rank_literal(ranks: Ranks) -> Column:
    """The ranks as a literal array of maps; a piece lies in the map that its checksum names."""
    buckets: list[dict[str, int]] = [{} for _ in range(RANK_BUCKETS)]
    for piece, rank in ranks:
        key = piece.decode("latin-1")
        buckets[zlib.crc32(key.encode()) % RANK_BUCKETS][key] = rank
    return F.from_json(F.lit(json.dumps(buckets, ensure_ascii=False)), "array<map<string,int>>")


def lookup(ranks: Column, piece: Column) -> Column:
    """The rank of a piece, null if it has none."""
    place = (F.crc32(piece.cast("binary")) % RANK_BUCKETS + 1).cast("int")
    return F.element_at(F.element_at(ranks, place), piece)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_merges(word: Column, ranks: Column) -> Column:
    """Ids of a word, whose bytes are its characters: ranked merges folded over the array of its bytes."""

    def rank(piece: Column) -> Column:
        return F.coalesce(lookup(ranks, piece), F.lit(NO_RANK))

    def merge(state: Column) -> Column:
        def at(i: Column) -> Column:
            parts, pair_ranks = state["parts"], state["ranks"]
            new = F.concat(F.get(parts, i - 1), F.get(parts, i))
            none = F.array().cast("array<int>")
            before = F.when(i > 1, F.array(rank(F.concat(F.get(parts, i - 2), new)))).otherwise(none)
            after = F.when(i + 1 < F.size(parts), F.array(rank(F.concat(new, F.get(parts, i + 1))))).otherwise(none)
            return F.struct(
                F.concat(F.slice(parts, 1, i - 1), F.array(new), F.slice(parts, i + 2, F.size(parts))).alias("parts"),
                F.concat(
                    F.slice(pair_ranks, 1, F.greatest(i - 2, F.lit(0))), before, after,
                    F.slice(pair_ranks, i + 2, F.size(parts)),
                ).alias("ranks"),
            )

        return let(F.array_position(state["ranks"], F.array_min(state["ranks"])).cast("int"), at)

    def step(state: Column, _: Column) -> Column:
        done = F.coalesce(F.array_min(state["ranks"]), F.lit(NO_RANK)) == NO_RANK
        return F.when(done, state).otherwise(merge(state))

    n = F.length(word)
    single = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(word, i, F.lit(1)))
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: rank(F.substring(word, i, F.lit(2))))
    start = F.struct(single.alias("parts"), pairs.alias("ranks"))
    folded = F.aggregate(
        F.sequence(F.lit(2), n), start, step, lambda state: F.transform(state["parts"], lambda p: lookup(ranks, p))
    )
    whole = lookup(ranks, word)
    return F.when(whole.isNotNull(), F.array(whole)).otherwise(folded)


def frequent_words(docs: DataFrame, text_col: str, pattern: str, most: int) -> DataFrame:
    """About the ``most`` most frequent words of the whole table as ``word``.

    Words are counted by partial aggregation. The cutoff comes from how many words have each count, counts grouped by thousandths of their
    logarithm; of the group at the cutoff a part is taken by hash, so the result is never empty however many words are equally frequent.
    Words of more than 32 bytes are left to the tasks, which bounds the bytes of the result.
    """
    matches = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(java_pattern(pattern)), F.lit(0))
    counted = docs.select(F.explode(matches).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counted = saved(counted.filter(F.octet_length("word").between(1, LONGEST_DICTIONARY_WORD)), "word-counts")
    group = F.floor(1000 * F.log2(F.col("n")))
    sizes = counted.groupBy(group.alias("g")).agg(F.count(F.lit(1)).alias("words"))
    room, cutoff, share = most, -1, 1.0
    for row in sizes.orderBy(F.desc("g")).collect():
        if row["words"] >= room:
            cutoff, share = row["g"], room / row["words"]
            break
        room -= row["words"]
    chosen = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30))
    return counted.filter((group > cutoff) | ((group == cutoff) & chosen)).select("word")


def fold_words(words: DataFrame, ranks: Ranks) -> DataFrame:
    """``word`` and its ``ids`` for a table of distinct words."""
    as_bytes = F.decode(F.col("word").cast("binary"), "ISO-8859-1")
    return words.select("word", fold_merges(as_bytes, rank_literal(ranks)).alias("ids"))


# Documents


def fold_in_task(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same fold for a word that the dictionary lacks."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > LONG_MATCH:
        return fold_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [ranks.get(word[i : i + 2], NO_RANK) for i in range(len(word) - 1)]
    while pairs and (best := min(pairs)) != NO_RANK:
        i = pairs.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], NO_RANK)
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], NO_RANK)
    return [ranks[p] for p in parts]


def fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same fold for a long match: pairs wait in a heap by rank and place, pieces are linked by where they end.

    A merge makes at most two new pairs, so the time grows with the length and its logarithm, not with its square.
    """
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n))  # of the piece that starts at a place; ``before`` is the start of the one before
    waiting = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(word[i : i + 2])) is not None]
    heapify(waiting)
    while waiting:
        _, i, stop = heappop(waiting)
        middle = end[i]
        if middle == 0 or middle >= n or end[middle] != stop:
            continue  # one of the two has been merged since
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (rank := ranks.get(word[i : end[stop]])) is not None:
                heappush(waiting, (rank, i, end[stop]))
        if i:
            left = before[i]
            if (rank := ranks.get(word[left:stop])) is not None:
                heappush(waiting, (rank, left, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : end[i]]])
        i = end[i]
    return ids


def little_endian(ids: list[int]) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in ids)


def encode(
    docs: DataFrame,
    ranks: Ranks,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    dictionary_words: int = 100_000,
) -> DataFrame:
    """``doc_id`` and ``ids`` of every whole text: token ids as unsigned 32-bit little-endian numbers, one after the other.

    Null text is empty, an empty text has no ids. Matches of ``pattern`` are encoded separately, without special tokens. Ties cannot
    occur: a rank belongs to one piece, and of equal pairs the leftmost is merged. Repeated rows give
    repeated results; an empty table gives an empty result; other columns are not read.
    """
    words = frequent_words(docs, text_col, pattern, dictionary_words)
    known = {r["word"]: little_endian(r["ids"]) for r in saved(fold_words(words, ranks), "word-ids").toLocalIterator()}
    shared = docs.sparkSession.sparkContext.broadcast((known, dict(ranks)))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        dictionary, rank_of = shared.value
        seen: dict[str, bytes] = {}
        find = regex.compile(pattern).findall

        def ids_of(word: str) -> bytes:
            ids = dictionary.get(word) or seen.get(word)
            if ids is None:
                if len(seen) >= TASK_WORDS:
                    seen.clear()
                ids = seen[word] = little_endian(fold_in_task(word.encode(), rank_of))
            return ids

        for part in parts:
            for low in range(0, len(part), BATCH_ROWS):
                piece = part.slice(low, BATCH_ROWS)
                ids = [b"".join(map(ids_of, find(text))) if text else b"" for text in piece.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(batches, f"doc_id {kind}, ids binary")


def decode(encoded: DataFrame, ranks: Ranks) -> DataFrame:
    """``encoded`` with ``decoded``: the pieces of its ids, one after the other, as binary."""
    pieces = [b""] * (max((r for _, r in ranks), default=-1) + 1)
    for piece, rank in ranks:
        pieces[rank] = piece
    shared = encoded.sparkSession.sparkContext.broadcast(pieces)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        piece = shared.value.__getitem__
        for part in parts:
            for low in range(0, len(part), BATCH_ROWS):
                some = part.slice(low, BATCH_ROWS)
                texts = [b"".join(map(piece, np.frombuffer(ids, "<u4").tolist())) for ids in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(batches, f"doc_id {kind}, ids binary, decoded binary")
