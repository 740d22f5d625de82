"""Hashes of the words and word shingles of whole texts, vectorised per text, and helpers around them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIME = np.uint64(0x100000001B3 | 1)
INVERSE = np.uint64(pow(int(PRIME), -1, 1 << 64))
SHINGLE = 5

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            full = np.full(max(n, 1 << 16), PRIME)
            full[0] = 1
            _powers = np.cumprod(full, dtype=np.uint64)
            full[1:] = INVERSE
            _inverses = np.cumprod(full, dtype=np.uint64)
    return _powers[:n], _inverses[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit number over all of them."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, first and end byte of every word (what ASCII white space separates) of a text's bytes.

    Differences of one running polynomial sum give all words at once.
    """
    blank = np.empty(len(text) + 2, bool)
    blank[0] = blank[-1] = True
    blank[1:-1] = _BLANK[text]
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    with np.errstate(over="ignore"):
        powers, inverses = _tables(len(text) + 1)
        sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers[: len(text)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * inverses[starts]), starts, ends


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every window of ``size`` words; none if there are fewer words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for k in range(size):
            total = total * PRIME + words[k : k + n]
        return mix(total)


def shingle_set(text: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes; a text of fewer words is one shingle of all its words, one without words has none."""
    words = word_hashes(text)[0]
    if 0 < len(words) < size:
        return window_hashes(np.append(words, np.uint64(len(words))), len(words) + 1)
    return np.unique(window_hashes(words, size))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays of distinct hashes; two empty sets have nothing in common."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    return both / union if union else 0.0


def sieve(hashes: DataFrame, column: str = "h", log2_bits: int = 26) -> np.ndarray:
    """A bitmap of fixed size (8 MB by default) of the 64-bit hashes in ``column``, to thin out rows before a shuffle.

    ``passes`` never misses a hash that is in it. The more hashes there are the less it thins out; results do not depend on it.
    The driver receives at most the bitmap.
    """
    bit = F.pmod(F.col(column), F.lit(1 << log2_bits))
    words = (
        hashes.select(F.shiftright(bit, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int")).alias("b"))
        .groupBy("w").agg(F.bit_or("b").alias("b"))
    ).toArrow()
    bitmap = np.zeros(1 << (log2_bits - 6), np.int64)
    bitmap[words["w"].to_numpy()] = words["b"].to_numpy()
    return bitmap


def passes(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which signed 64-bit hashes may be in the bitmap."""
    bit = hashes.astype(np.int64) & np.int64(len(bitmap) * 64 - 1)
    return (bitmap[bit >> 6] >> (bit & 63)) & 1 == 1


def text_bytes(text_col: str) -> Column:
    """Lower-cased text; null is empty."""
    return F.lower(F.coalesce(F.col(text_col), F.lit("")))
