"""Vectors and stretches of Arrow batches as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.ListArray, rows: slice | np.ndarray) -> np.ndarray:
    """Rows of lists of one length, as doubles."""
    part = column.slice(rows.start, rows.stop - rows.start) if isinstance(rows, slice) else column.take(pa.array(rows))
    flat = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(part), len(flat) // max(1, len(part)))


def runs(*columns: np.ndarray) -> list[slice]:
    """Stretches of equal values."""
    n = len(columns[0])
    if not n:
        return []
    change = np.zeros(n, dtype=bool)
    change[0] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(change)
    return [slice(a, b) for a, b in zip(starts, [*starts[1:], n])]
