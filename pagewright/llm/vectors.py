"""Vectors of list columns as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def finite_rows(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By length, ascending: row numbers, and the vectors as doubles, of the rows that are not
    null and hold neither nulls nor non-finite numbers."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(vectors), -1), dtype=np.int64)
    values = pc.list_flatten(vectors)  # without those of null rows
    good = np.asarray(pc.fill_null(pc.is_finite(values), False)).astype(bool)
    flat = np.asarray(pc.fill_null(values, 0)).astype(np.float64)
    starts = np.concatenate(([0], np.cumsum(np.maximum(lengths, 0))))[:-1]
    for n in np.unique(lengths[lengths >= 0]).tolist():
        rows = np.flatnonzero(lengths == n)
        at = starts[rows][:, None] + np.arange(n)
        fine = good[at].all(axis=1)
        if fine.any():
            yield rows[fine], flat[at[fine]]
