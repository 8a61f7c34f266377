"""Latest row per key (W01, W02): one hash exchange, combined map-side, so a hot key never meets in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, order: list[Column | str], keep: list[str]) -> DataFrame:
    """One row per non-null `key`: the one with the greatest `order`, null being least.

    Rows that tie on `order` are told apart by their kept columns, so the result is one fixed row whatever the input's
    order, and repeated rows are one. `keep`: the columns to return besides the key; they must be orderable. An empty
    table gives an empty table; rows whose key is null are left out."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    best = F.max(F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]))
    out = df.where(F.col(key).isNotNull()).groupBy(key).agg(best.alias("_best"))
    return out.select(key, *[F.col(f"_best._k{i}").alias(c) for i, c in enumerate(keep)])
