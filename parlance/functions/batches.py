"""Arrow batches of word lists, taken a bounded number of words at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MOST_WORDS = 500_000


def list_lengths(column: pa.Array) -> np.ndarray:
    """Elements of every list; a missing list has none."""
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def list_slices(column: pa.Array, most: int = MOST_WORDS) -> Iterator[pa.Array]:
    """Consecutive slices of at most ``most`` elements, or of one longer list; an empty column is one slice."""
    ends = np.cumsum(list_lengths(column))
    low = 0
    while True:
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + most, "right")))
        yield column.slice(low, high - low)
        low = high
        if low >= len(column):
            return


def by_slices(column: pa.Array, function: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """``function`` of every slice, put together again."""
    return pa.concat_arrays([function(part) for part in list_slices(column)])
