"""Entity-attribute-value rows into one typed row per entity.

Cells are first combined map-side to the winning row per (entity, attribute), so an entity with a third of all rows
shrinks to at most one row per attribute before it is brought together. The survivors are hash-partitioned and sorted by
entity with the attribute encoded as a column index, and one pass over the sorted Arrow batches builds the columns from their
(row, value) runs: buffers and validity masks are filled for the attributes that occur in a batch only, all others share one
array of nulls, and a batch never has more than `_CELLS` cells. No entity is ever buffered beyond its own row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kelpie.functions.keys import usable
from kelpie.operators.arrowrun import starts
from kelpie.sources.tables import durable, small_table

_ARROW = {"double": (pa.float64(), np.float64), "bigint": (pa.int64(), np.int64), "boolean": (pa.bool_(), np.bool_)}


def attributes(df: DataFrame, attribute: str, limit: int = 20_000) -> list[str]:
    """The attribute names present, sorted. They become columns, so their number is checked: more than `limit` is an error."""
    found = [r[0] for r in df.select(attribute).where(F.col(attribute).isNotNull()).distinct().limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"more than {limit} attributes: not a set of columns")
    return sorted(found)


def column_names(entity: str, names: list[str]) -> list[str]:
    """A column name for each attribute, unlike the entity's and unlike each other in any case."""
    taken, out = {entity.lower()}, []
    for name in names:
        new, i = name, 2
        while new.lower() in taken or f"{new}__src".lower() in taken:
            new, i = f"{name}_{i}", i + 1
        taken |= {new.lower(), f"{new}__src".lower()}
        out.append(new)
    return out


_CELLS = 2_000_000  # of a batch that comes out: 16 MB a value and as much a source


def widen(df: DataFrame, entity: str, attribute: str, value: str, order: list[Column | str], source: str | None = None, types: dict[str, str] | None = None, names: list[str] | None = None) -> DataFrame:
    """One row per non-null entity, with a typed column for each attribute.

    df: entity (string), attribute (string, already in its normal form; null is no attribute), value (double).
    order: of the rows of one cell that hold a usable value the greatest wins, null being least; fixed-width columns keep
    this in a hash-free sort aggregation of small rows. Rows that tie on `order` are told apart by source and value.
    source: a BIGINT column; each cell's comes out as `<attribute>__src`.
    types: attribute -> double (the default), bigint or boolean. A value that its type can't hold (a fraction in a whole
    column) leaves the typed cell null while its source stays.
    names: the attributes, if known; else they are read from the winning cells, which are kept for that.
    Entities without any usable value come out with nulls; an empty table gives an empty table; null, NaN and infinite
    values fill no cell; other columns of df are ignored, whatever their names."""
    return widened(df, entity, attribute, value, order, source, types, names)[0]


def widened(df: DataFrame, entity: str, attribute: str, value: str, order: list[Column | str], source: str | None = None, types: dict[str, str] | None = None, names: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """As widen, with the names of the attributes in the order of their columns."""
    types = types or {}
    rows = df.where(F.col(entity).isNotNull())
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    src = F.col(source).cast("bigint") if source else F.lit(None).cast("bigint")
    name = F.when(usable(value), F.col(attribute))
    best = rows.select(F.col(entity).cast("string").alias("_e"), name.alias("_n"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], src.alias("s"), F.col(value).cast("double").alias("v")).alias("_c"))
    best = best.groupBy("_e", "_n").agg(F.max("_c").alias("_c")).select("_e", "_n", F.col("_c.s").alias("_s"), F.col("_c.v").alias("_v"))
    if names is None:
        best = durable(best)
        names = attributes(best, "_n")
    cols = column_names(entity, names)
    kinds = [types.get(n, "double") for n in names]
    # The dictionary is bounded by the check in attributes(), so it may be broadcast.
    known = F.broadcast(small_table(df.sparkSession, list(enumerate(names)), "_a int, _an string"))
    best = best.join(known, F.col("_n") == F.col("_an"), "left").select("_e", F.coalesce("_a", F.lit(-1)).alias("_a"), "_s", "_v")
    lined = best.repartition("_e").sortWithinPartitions("_e", "_a")
    fields = [T.StructField(entity, T.StringType())]
    for c, k in zip(cols, kinds):
        fields.append(T.StructField(c, {"double": T.DoubleType(), "bigint": T.LongType(), "boolean": T.BooleanType()}[k]))
        if source:
            fields.append(T.StructField(f"{c}__src", T.LongType()))
    return lined.mapInArrow(_builder(entity, cols, kinds, bool(source)), T.StructType(fields)), names


def _fits(kind: str, v: np.ndarray) -> np.ndarray:
    if kind == "bigint":
        return (v == np.floor(v)) & (np.abs(v) < 2.0**63)
    return (v == 0) | (v == 1) if kind == "boolean" else np.ones(len(v), bool)


def _column(n: int, kind: str, at: np.ndarray, v: np.ndarray) -> pa.Array:
    """A column of n rows that has the values v at the rows `at`."""
    arrow, plain = _ARROW[kind]
    buf, valid = np.zeros(n, plain), np.zeros(n, bool)
    buf[at] = v.astype(plain)
    valid[at] = True
    return pa.array(buf, arrow, mask=~valid)


def _builder(entity: str, cols: list[str], kinds: list[str], with_source: bool):
    most = max(1, _CELLS // max(1, len(cols)))  # rows of a batch

    def build(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(starts(batch, ["_e"], None))
        for lo in range(0, len(first), most):
            end = first[lo + most] if lo + most < len(first) else batch.num_rows
            yield rows(batch.slice(first[lo], end - first[lo]), first[lo : lo + most] - first[lo])

    def rows(batch: pa.RecordBatch, first: np.ndarray) -> pa.RecordBatch:
        n = len(first)
        row = np.repeat(np.arange(n), np.diff(np.append(first, batch.num_rows)))
        at = batch.column(1).to_numpy(zero_copy_only=False)
        src, val = batch.column(2), batch.column(3).to_numpy(zero_copy_only=False)
        has_src = src.is_valid().to_numpy(zero_copy_only=False)
        src = src.fill_null(0).to_numpy(zero_copy_only=False)
        by = np.argsort(at, kind="stable")
        by = by[np.searchsorted(at[by], 0) :]
        blank = {k: pa.nulls(n, _ARROW[k][0]) for k in {*kinds, "bigint"}}
        values, sources = [blank[k] for k in kinds], [blank["bigint"]] * len(cols)
        edges = np.flatnonzero(np.diff(at[by], prepend=-1))  # where the next attribute's run begins
        for lo, hi in zip(edges, [*edges[1:], len(by)]):
            run = by[lo:hi]
            c, v = int(at[run[0]]), val[run]
            ok = _fits(kinds[c], v)
            values[c] = _column(n, kinds[c], row[run[ok]], v[ok])
            if with_source:
                told = run[has_src[run]]
                sources[c] = _column(n, "bigint", row[told], src[told])
        arrays, labels = [batch.column(0).take(pa.array(first))], [entity]
        for c, name in enumerate(cols):
            arrays.append(values[c])
            labels.append(name)
            if with_source:
                arrays.append(sources[c])
                labels.append(f"{name}__src")
        return pa.RecordBatch.from_arrays(arrays, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            cut = int(np.flatnonzero(starts(b, ["_e"], None))[-1])  # the last entity may go on in the next batch
            held = b.slice(cut)
            if cut:
                yield from build(b.slice(0, cut))
        if held is not None:
            yield from build(held)

    return run


def cells(wide: DataFrame, entity: str, names: list[str]) -> DataFrame:
    """The filled cells of a wide table made with sources: (entity, attribute, source)."""
    cols = column_names(entity, names)
    if not names:
        return wide.select(entity, F.lit(None).cast("string").alias("attribute"), F.lit(None).cast("bigint").alias("source")).limit(0)
    each = wide.select(entity, F.posexplode(F.array(*[F.col(f"`{c}__src`") for c in cols])).alias("_at", "source")).where(F.col("source").isNotNull())
    return each.select(entity, F.element_at(F.array(*map(F.lit, names)), F.col("_at") + 1).alias("attribute"), "source")
