"""The whole profile and quality job of a table as a graph of metrics (P13..P16)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kelpie.operators.graphs import topological_order
from kelpie.operators.quality import column_profile, guess_target


@dataclass(frozen=True)
class Metric:
    """needs: metrics it is made from. make: of (columns by type, inputs) an aggregate Column (without needs) or a Column over the needed
    metrics' names, or a function of the table that gives one row with one column. inputs: what the caller must tell, else the metric is pending."""

    make: Callable
    needs: tuple[str, ...] = ()
    inputs: tuple[str, ...] = ()
    frame: bool = False


def _missing(kinds: dict, _) -> Column:
    return sum((F.count(F.lit(1)) - F.count(F.col(f"`{c}`")) for c in kinds), F.lit(0))


def _whole(kinds: dict, _) -> Column:
    ok = F.lit(True)
    for c in kinds:
        ok = ok & F.col(f"`{c}`").isNotNull()
    return F.count_if(ok)


def _labelled(kinds: dict, inputs: dict) -> Column:
    c = F.col(f"`{inputs['target']}`")
    return F.count_if(c.isNotNull() & (F.trim(c.cast("string")) != ""))


#: The metrics of a job by name.
METRICS: dict[str, Metric] = {
    "rows": Metric(lambda k, i: F.count(F.lit(1))),
    "columns": Metric(lambda k, i: F.lit(len(k)) + F.count(F.lit(1)) * 0),
    "numeric_columns": Metric(lambda k, i: F.lit(sum(isinstance(t, T.NumericType) for t in k.values())) + F.count(F.lit(1)) * 0),
    "missing_cells": Metric(_missing),
    "complete_rows": Metric(_whole),
    "labelled_rows": Metric(_labelled, inputs=("target",)),
    "distinct_rows": Metric(lambda df: df.distinct().agg(F.count(F.lit(1)).alias("v")), frame=True),
    "missing_ratio": Metric(lambda k, i: F.col("missing_cells") / F.nullif(F.col("rows") * F.col("columns"), F.lit(0)), ("missing_cells", "rows", "columns")),
    "record_completeness": Metric(lambda k, i: F.col("complete_rows") / F.nullif(F.col("rows"), F.lit(0)), ("complete_rows", "rows")),
    "label_completeness": Metric(lambda k, i: F.col("labelled_rows") / F.nullif(F.col("rows"), F.lit(0)), ("labelled_rows", "rows")),
    "duplicate_ratio": Metric(lambda k, i: 1 - F.col("distinct_rows") / F.nullif(F.col("rows"), F.lit(0)), ("distinct_rows", "rows")),
    "quality": Metric(lambda k, i: (F.col("record_completeness") + 1 - F.col("missing_ratio") + 1 - F.col("duplicate_ratio")) / 3, ("record_completeness", "missing_ratio", "duplicate_ratio")),
}


def profile_job(df: DataFrame, wanted: list[str], inputs: dict | None = None, metrics: dict[str, Metric] | None = None) -> DataFrame:
    """(metric, value, status) of the wanted metrics; what they need is found and ordered from the graph of metrics.

    All aggregates of one pass are one aggregation, whatever asks for them; those that need another grouping are one-row
    tables beside it, and derived metrics are arithmetic on the row. status: done, or pending_input where an input (or one of a
    metric it needs) isn't told. An unknown metric or a cycle is an error. Array, map and struct columns don't count."""
    metrics, inputs = metrics or METRICS, inputs or {}
    need, todo = set(), list(wanted)
    while todo:
        m = todo.pop()
        if m not in metrics:
            raise KeyError(f"unknown metric {m}")
        if m not in need:
            need.add(m)
            todo += metrics[m].needs
    order = topological_order([(b, a) for a in need for b in metrics[a].needs], sorted(need))
    if order is None:
        raise ValueError("the metrics need each other")
    kinds = {f.name: f.dataType for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))}
    able: dict[str, bool] = {}
    for m in order:
        able[m] = all(i in inputs for i in metrics[m].inputs) and all(able[n] for n in metrics[m].needs)
    plain = [m for m in order if able[m] and not metrics[m].needs and not metrics[m].frame]
    row = df.agg(F.lit(0).alias("_"), *[metrics[m].make(kinds, inputs).cast("double").alias(m) for m in plain])
    for m in order:
        if able[m] and metrics[m].frame:
            row = row.crossJoin(metrics[m].make(df.select(*[f"`{c}`" for c in kinds])).toDF(m))  # one row each
    for m in order:
        if able[m] and metrics[m].needs:
            row = row.withColumn(m, metrics[m].make(kinds, inputs).cast("double"))
    cells = [F.struct(F.lit(m).alias("metric"), (F.col(m).cast("double") if able[m] else F.lit(None).cast("double")).alias("value"), F.lit("done" if able[m] else "pending_input").alias("status")) for m in dict.fromkeys(wanted)]
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def form_defaults(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, range, expected_type, decimals, allowed_values, rule, rule_values): what a form about the columns is filled with.

    range: [min, max] of numeric columns; decimals: 0 for these; allowed_values: the sample values of categorical and binary
    columns; rule: `between` the range, else `in` the allowed values. Columns without any value have the type `str` and no rule."""
    p = column_profile(df.select(*[f"`{c}`" for c in columns]) if columns else df)
    numeric = F.col("is_numeric") & F.col("min").isNotNull() & F.col("max").isNotNull()
    few = F.col("scale").isin("categorical", "binary") & (F.size("sample_values") > 0)
    span = F.when(numeric, F.array("min", "max"))
    return p.select("column", span.alias("range"), F.coalesce("inferred_type", F.lit("str")).alias("expected_type"), F.when(F.col("is_numeric"), 0).alias("decimals"), F.when(few, F.col("sample_values")).alias("allowed_values"), F.when(numeric, "between").when(few, "in").alias("rule"), F.when(numeric, F.transform(span, lambda x: x.cast("string"))).when(few, F.col("sample_values")).alias("rule_values"))


def target_of(df: DataFrame) -> str | None:
    """The column that a table most likely predicts, from its names and the last one's profile (one pass over that column)."""
    names = df.columns
    rows = [r.asDict() for r in column_profile(df.select(f"`{names[-1]}`")).collect()] if names else []  # one row
    return guess_target(rows, names)
