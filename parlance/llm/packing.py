"""Packing token pieces into sequences under several limits at once (vector bin packing).

Every document becomes ids, an end id, and pieces of at most a sequence's length. Pieces as long as a sequence are sequences.
The rest is dealt over groups of about ``GROUP_PIECES`` pieces, each packed by the dot-product rule: the open sequence takes, of
the pieces that fit in tokens, segments and loss-bearing tokens, the one whose demand points most in the direction of what is
left; when none fits the next sequence opens. Only numbers are shuffled, and groups do not grow with the data.
"""

from __future__ import annotations

import os
import string
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.ngrams import texts_of
from parlance.session import saved

GROUP_PIECES = 1024
#: A Python worker forgets its encoded words beyond this many, so that its memory stays bounded; results do not change.
WORKER_WORDS = 800_000

# The bytes that byte-level vocabularies write as themselves, and marks that never join the letters before them.
PLAIN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
MARKS = string.punctuation.replace("'", "")


def byte_alphabet() -> dict[int, str]:
    """The character of every byte in byte-level vocabularies: itself, or the next one from 256 on."""
    others = [b for b in range(256) if b not in PLAIN_BYTES]
    return {b: chr(b) for b in PLAIN_BYTES} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordEncoder(dict[bytes, bytes]):
    """Ids (little-endian unsigned 32-bit) of words, made when asked for and kept by a worker. The tokenizer treats what white space separates on its own.

    A word of letters, with or without marks behind it, is one or two matches of the tokenizer's pattern, so its model is asked directly;
    any other word goes through the whole tokenizer, which makes the string of a special token that token, as the library does by default.
    """

    def __init__(self, tokenizer: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.split = self.tokenizer.model.tokenize
        self.alphabet, self.marks = byte_alphabet(), {"": b""}
        self.letters: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _encode(self, word: bytes) -> bytes:
        text = word.decode()
        if text.isascii():
            letters = text.rstrip(MARKS)
            marks, letters = text[len(letters) :], letters.lower()
        else:
            plain = unicodedata.normalize("NFC", text)
            letters = plain.rstrip(MARKS)
            marks = plain[len(letters) :]
            # Letter by letter, as the tokenizer does it: a sigma at the end of a word is no exception.
            letters = "".join(c.lower() for c in letters) if "\u03a3" in letters else letters.lower()
        found = self.letters.get(letters)
        if found is None:
            if not letters.isalpha():
                return self._whole(text)
            plain = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.alphabet)
            found = self.letters[letters] = array("I", [t.id for t in self.split(plain)]).tobytes()
        if marks not in self.marks:
            if len(self.marks) > WORKER_WORDS:
                self.marks = {"": b""}
            self.marks[marks] = self._whole(marks)
        return found + self.marks[marks]

    def __missing__(self, word: bytes) -> bytes:
        found = self[word] = self._encode(word)
        return found

    def make_room(self) -> None:
        """Forget everything beyond the bound."""
        if len(self) > WORKER_WORDS:
            self.clear()
        if len(self.letters) > WORKER_WORDS:
            self.letters.clear()


_encoders: dict[int, WordEncoder] = {}


def tokenise(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    max_tokens: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = True,
) -> DataFrame:
    """Pieces of every whole text: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens`` and, if asked for, ``ids``.

    Null text is empty, so every row has at least the end id. Ids are unsigned 32-bit little-endian numbers. Repeated rows give
    repeated pieces. Other columns are not read.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    digest = zlib.crc32(shared.value.encode())
    end = int(end_id).to_bytes(4, "little")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: 5 + keep_ids]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if digest not in _encoders:
            _encoders.clear()
            _encoders[digest] = WordEncoder(shared.value)
        encoder = _encoders[digest]
        for part in parts:
            for low in range(0, len(part), 512):
                piece = part.slice(low, 512)
                texts = [text.tobytes().split() for text in texts_of(piece.column(1))]
                encoder.make_room()
                row, start, chunks, total = [], [], [], []
                for i, words in enumerate(texts):
                    ids = b"".join(map(encoder.__getitem__, words)) + end
                    for at in range(0, len(ids), 4 * max_tokens):
                        row.append(i)
                        start.append(at // 4)
                        chunks.append(ids[at : at + 4 * max_tokens])
                        total.append(len(ids) // 4)
                columns = [
                    piece.column(0).take(pa.array(row, pa.int64())),
                    pa.array(start, pa.int64()),
                    pa.array([len(c) // 4 for c in chunks], pa.int64()),
                    pa.array([zlib.crc32(c) for c in chunks], pa.int64()),
                    pa.array(total, pa.int64()),
                    pa.array(chunks, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns[: len(names)], names)

    return rows.mapInArrow(batches, schema)


def pack_group(demand: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and place of every item; ``demand`` is items x limits in token order, no item exceeds a limit.

    Equal scores go to the item that comes first, so the result depends on the order of the rows only.
    """
    weight = (demand / limits).mean(0) + 1e-12
    sequence, offset = np.full(len(demand), -1), np.zeros(len(demand), np.int64)
    items, number = np.arange(len(demand)), 0
    need = demand / limits
    while len(items):
        left, filled, taken = np.ones(len(limits)), 0, []
        while True:
            score = need @ (weight * left)
            score[(need > left + 1e-12).any(1)] = -1.0
            best = int(score.argmax())
            if score[best] < 0:
                break
            item = items[best]
            sequence[item], offset[item] = number, filled
            filled += int(demand[item, 0])
            left = left - need[best]
            need[best] = 2.0  # fits nowhere any more
            taken.append(best)
        items, need = np.delete(items, taken), np.delete(need, taken, axis=0)
        number += 1
    return sequence, offset


def pack(
    pieces: DataFrame, max_tokens: int = 4096, max_segments: int = 64, max_loss_tokens: int = 4096, loss_col: str | None = None
) -> DataFrame:
    """``pieces`` (with ``length``) and the ``sequence_id`` and ``offset`` of each.

    A sequence holds at most ``max_tokens`` tokens, ``max_segments`` pieces and ``max_loss_tokens`` loss-bearing tokens; these are all tokens
    unless ``loss_col`` counts them (null: none). A piece beyond a limit on its own is an error. Sequence ids are unique,
    not consecutive: even for pieces that fill a sequence, odd for packed ones. An empty table gives an empty result.
    """
    source = saved(pieces.withColumn("__n", F.monotonically_increasing_id()), "pieces")
    loss = F.coalesce(F.col(loss_col), F.lit(0)) if loss_col else F.col("length")
    numbers = source.select("__n", F.col("length").cast("long").alias("length"), loss.cast("long").alias("loss"))
    count, longest, most_loss = numbers.agg(
        F.count(F.when(F.col("length") < max_tokens, 1)), F.max("length"), F.max("loss")
    ).first()
    if count is None or (longest or 0) > max_tokens or (most_loss or 0) > max_loss_tokens:
        raise ValueError("a piece exceeds a limit on its own")
    groups = max(1, -(-count // GROUP_PIECES))
    limits = np.array([max_tokens, max_segments, max_loss_tokens], float)

    def pack_rows(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__n", ignore_index=True)
        demand = np.stack([rows["length"], np.ones(len(rows)), rows["loss"]], 1).astype(float)
        sequence, offset = pack_group(demand, limits)
        number = (rows["g"].to_numpy(np.int64) * (1 << 20) + sequence) * 2 + 1
        return pd.DataFrame({"__n": rows["__n"], "sequence_id": number, "offset": offset})

    part = numbers.filter(F.col("length") < max_tokens).withColumn("g", F.pmod(F.xxhash64("__n"), F.lit(groups)))
    packed = part.groupBy("g").applyInPandas(pack_rows, "__n long, sequence_id long, offset long")
    full = numbers.filter(F.col("length") == max_tokens).select("__n", (F.col("__n") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return source.join(packed.union(full), "__n").drop("__n")
