"""Byte n-gram vectors of whole texts, made per Arrow batch, and bounded training samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import crc_remainder


def texts_of(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text of an Arrow column; null is empty. Nothing is copied."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield data[offsets[i] : offsets[i + 1]] if valid[i] else data[:0]


def hashed_counts(text: np.ndarray, orders: tuple[int, ...], buckets: int) -> np.ndarray:
    """How often the byte n-grams of a text fall into each of ``buckets`` (a power of two)."""
    counts = np.zeros(buckets, np.float32)
    shift = np.uint32(32 - buckets.bit_length() + 1)
    for order in orders:
        n = len(text) - order + 1
        for low in range(0, max(n, 0), 1 << 20):  # long texts in slices, so that memory stays bounded
            part = text[low : min(low + (1 << 20), n) + order - 1].astype(np.uint32)
            code = np.full(len(part) - order + 1, order, np.uint32)
            for k in range(order):
                code = code * np.uint32(257) + part[k : k + len(code)]
            counts += np.bincount((code * np.uint32(2654435761)) >> shift, minlength=buckets).astype(np.float32)
    return counts


def hellinger(counts: np.ndarray) -> np.ndarray:
    """Square roots of the shares: a vector of length one, or zero for no counts."""
    total = counts.sum()
    return np.sqrt(counts / total) if total else counts


def sampling_key(key: str) -> Column:
    """A number from 0 to 1 that depends on the key only, so a sample is the same however rows are partitioned."""
    digest = F.md5(F.concat_ws("_", F.lit("sample"), F.col(key).cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(16.0**12)


def sampled(df: DataFrame, key: str, share: Column | float, out: str = "u") -> DataFrame:
    """Rows whose key's number is below ``share``, one per number: repeated rows of one key cannot enlarge the sample."""
    share = F.lit(share) if isinstance(share, float) else share
    return df.withColumn(out, sampling_key(key)).filter(F.col(out) < share).dropDuplicates([out])


def held_out(key: str, divisor: int, remainder: int) -> Column:
    return crc_remainder(key, divisor) == remainder
