"""Helpers for operators that stream sorted Arrow batches: runs of equal keys, found with vector kernels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def starts(batch: pa.RecordBatch, keys: list[str], before: tuple | None) -> np.ndarray:
    """For each row, whether its key differs from the row before it (`before`: the key of the row before the batch).

    Nulls equal nulls and NaN equals NaN, as in Spark's grouping."""
    n = batch.num_rows
    out = np.zeros(n, dtype=bool)
    for k in keys:
        col = batch.column(batch.schema.get_field_index(k))
        if n > 1:
            a, b = col.slice(1), col.slice(0, n - 1)
            differ = pc.fill_null(pc.not_equal(a, b), False)
            differ = pc.or_(differ, pc.not_equal(pc.is_null(a), pc.is_null(b)))
            if pa.types.is_floating(col.type):
                both = pc.and_(pc.fill_null(pc.is_nan(a), False), pc.fill_null(pc.is_nan(b), False))
                differ = pc.and_not(differ, both)
            out[1:] |= differ.to_numpy(zero_copy_only=False)
    if n:
        out[0] = before is None or before != key_at(batch, keys, 0)
    return out


def key_at(batch: pa.RecordBatch, keys: list[str], i: int) -> tuple:
    """The key of row i, with NaN made comparable."""
    row = [batch.column(batch.schema.get_field_index(k))[i].as_py() for k in keys]
    return tuple("NaN" if isinstance(x, float) and x != x else x for x in row)
