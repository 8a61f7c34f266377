"""Top N rows within every group, by secondary sort.

Every partition of the input is sorted by group, score and identifier and streamed once, passing on its first N rows of
each group: no exchange, and whatever a hot group weighs, it leaves a partition with N rows at most. What is left is
hash-partitioned by group, sorted the same way and streamed again. Neither pass buffers a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kelpie.operators.arrowrun import key_at, starts


def _first(groups: list[str], n: int, rank: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, seen = None, 0
        for b in batches:
            m = b.num_rows
            if not m:
                continue
            new = starts(b, groups, before)
            at = np.arange(m)
            place = at - np.maximum.accumulate(np.where(new, at, -1))
            place[: int(np.argmax(new)) if new.any() else m] = 0
            lead = int(np.argmax(new)) if new.any() else m  # rows that go on with the group of the batch before
            place[:lead] = at[:lead] + seen
            seen, before = int(place[-1]) + 1, key_at(b, groups, m - 1)
            keep = place < n
            if not keep.any():
                continue
            out = b.filter(pa.array(keep))
            if rank:
                out = pa.RecordBatch.from_arrays([*out.columns, pa.array((place[keep] + 1).astype(np.int32))], [*b.schema.names, rank])
            yield out

    return run


def top_n(df: DataFrame, groups: list[str], order: list[Column], n: int, rank: str = "rnk") -> DataFrame:
    """The first n rows of every group in the given order, with their place from 1 as `rank` (INT).

    order: sort columns (F.desc(..), F.asc(..)); they should end in an identifier, so that ties have one fixed order. Rows
    that tie on all of it come in any order. Null groups form a group of their own, as do NaN ones. A column of df that
    bears the name of `rank`, in any case, is replaced. An empty table gives an empty table; n < 1 gives no row."""
    clash = [c for c in df.columns if c.lower() == rank.lower()]
    if set(clash) & set(groups):
        raise ValueError(f"the rank can't be named as the group {clash}")
    df = df.drop(*clash)
    by = [F.col(f"`{g}`") for g in groups]
    few = df.sortWithinPartitions(*by, *order).mapInArrow(_first(groups, n, None), df.schema)
    lined = few.repartition(*by).sortWithinPartitions(*by, *order)
    return lined.mapInArrow(_first(groups, n, rank), T.StructType([*df.schema.fields, T.StructField(rank, T.IntegerType())]))
