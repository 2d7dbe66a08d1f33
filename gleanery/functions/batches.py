"""Arrow batches a few rows at a time.

A batch has thousands of rows, and rows as Python objects, or as numbers per token, take many times their Arrow size. What a task
holds of them is one slice, whatever the batch; the results of the slices are Arrow arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

#: Rows of a slice, and their bytes in Arrow; a larger row is a slice of its own.
SLICE_ROWS = 256
SLICE_BYTES = 1 << 20


def slices(n: int, n_bytes: int) -> Iterator[tuple[int, int]]:
    """Start and length of the slices of n rows with n_bytes in all."""
    rows = max(1, min(SLICE_ROWS, n * SLICE_BYTES // max(1, n_bytes)))
    return ((start, min(rows, n - start)) for start in range(0, n, rows))


def in_slices(make: Callable[..., pa.Array], empty: pa.DataType, *columns: pa.Array) -> pa.Array:
    """make(*columns), which goes row by row, as one array made slice by slice."""
    cuts = slices(len(columns[0]), sum(c.nbytes for c in columns))
    parts = [make(*[c.slice(*cut) for c in columns]) for cut in cuts]
    whole = pa.concat_arrays(parts) if parts else pa.array([], empty)
    # What the slices took goes back before the batch is sent on.
    parts.clear()
    pa.default_memory_pool().release_unused()
    return whole
