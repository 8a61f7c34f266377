"""Profiles, data-quality metrics and their decisions (P, Q, D).

Row-level metrics are aggregate Columns, so any number of them is computed in one pass (`evaluate`)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kelpie.operators.docstore import rule
from kelpie.sources.tables import durable


def share(cond: Column) -> Column:
    """The share of all rows that satisfy a condition; an unknown one (null) fails, and stays in the denominator."""
    return F.avg(F.when(F.coalesce(cond, F.lit(False)), 1.0).otherwise(0.0))


def evaluate(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """(metric, value) of aggregate Columns, all in one pass over the data."""
    names = list(metrics)
    one = df.agg(*[c.cast("double").alias(f"m{i}") for i, c in enumerate(metrics.values())])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"m{i}").alias("value")) for i, n in enumerate(names)])).alias("x")).select("x.metric", "x.value")


# Row-level metrics.


def syntactic_accuracy(col: str, allowed: list[str]) -> Column:
    """Q01"""
    return share(F.upper(F.trim(col)).isin(*[a.strip().upper() for a in allowed]))


def semantic_accuracy(when: Column, then: Column) -> Column:
    """Q02: of the rows to which the rule applies, the share that satisfies it."""
    return F.count_if(when & F.coalesce(then, F.lit(False))) / F.nullif(F.count_if(when), F.lit(0))


def range_accuracy(col: str, lo, hi) -> Column:
    """Q04"""
    return share(F.col(col).between(lo, hi))


def completeness(col: str) -> Column:
    """Q05, Q06"""
    return F.count(col) / F.nullif(F.count(F.lit(1)), F.lit(0))


def overall_completeness(cols: list[str]) -> Column:
    """Q05: filled cells of all cells."""
    total = sum((F.count(c) for c in cols[1:]), F.count(cols[0]))
    return total / F.nullif(F.count(F.lit(1)) * len(cols), F.lit(0))


def record_completeness(df: DataFrame, cols: list[str]) -> Column:
    """Q07: rows without anything missing; an empty text is missing."""
    kinds, ok = dict(df.dtypes), F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull() & ((F.col(c) != "") if kinds[c] == "string" else F.lit(True))
    return share(ok)


def label_completeness(col: str) -> Column:
    """Q08"""
    return share(F.col(col).isNotNull() & (F.col(col).cast("string") != ""))


def occurrence(col: str, value, expected: int) -> Column:
    """Q09: observed of expected occurrences."""
    return F.count_if(F.col(col) == value) / expected


def rules_share(rules: list[dict]) -> Column:
    """Q13: mean over rules of the share that satisfies each."""
    return sum((share(rule(r)) for r in rules[1:]), share(rule(rules[0]))) / len(rules)


def compliance(clauses: dict) -> Column:
    """Q19, Q23, Q25, Q28"""
    return share(rule(clauses))


def distinct_share(col: str) -> Column:
    """Q20, Q22: distinct values of all rows."""
    return F.count_distinct(F.col(col)) / F.nullif(F.count(F.lit(1)), F.lit(0))


def precision_share(col: str, places: int) -> Column:
    """Q26: of the values, the share that is already rounded."""
    return F.avg(F.when(F.abs(F.round(F.col(col), places) - F.col(col)) < 1e-9, 1.0).when(F.col(col).isNotNull(), 0.0))


def format_match(col: str, kind: str) -> Column:
    """Q12: of the values, the share that parses as int, float, bool or datetime."""
    sql = {"int": "bigint", "float": "double", "bool": "boolean", "datetime": "timestamp", "str": "string"}[kind]
    return F.count(F.col(col).cast("string").try_cast(sql)) / F.nullif(F.count(col), F.lit(0))


def list_share(wanted: list[str], present: list[str]) -> float:
    """Q27, Q29: of the wanted names, the share that is present."""
    return len(set(wanted) & set(present)) / len(wanted) if wanted else 0.0


# Metrics that need another grouping.


def quantiles(df: DataFrame, col: str, probs: list[float]) -> DataFrame:
    """Exact quantiles with linear interpolation as one row (q0, q1, ..), from cumulative counts of a range-partitioned
    histogram: no task holds more than its range of distinct values."""
    hist = df.where(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double"))).groupBy(F.col(col).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    part = durable(hist.repartitionByRange("v").withColumn("_p", F.spark_partition_id()))  # kept, so both uses see the same ranges
    base = part.groupBy("_p").agg(F.sum("c").alias("pc")).withColumn("before", F.coalesce(F.sum("pc").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    run = part.join(F.broadcast(base.select("_p", "before")), "_p").withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy("_p").orderBy("v")))
    run = run.crossJoin(F.broadcast(hist.agg(F.sum("c").alias("n"))))  # one row
    cols = []
    for i, p in enumerate(probs):
        h = (F.col("n") - 1) * F.lit(p)
        at = lambda k: F.min(F.when(F.col("upto") > k, F.col("v")))
        frac = F.max(h - F.floor(h))
        cols.append((at(F.floor(h)) + frac * (at(F.least(F.floor(h) + 1, F.col("n") - 1)) - at(F.floor(h)))).alias(f"q{i}"))
    return run.agg(*cols)


def outlier_share(df: DataFrame, col: str) -> DataFrame:
    """Q03: the share outside of the quartiles by over 1.5 times their distance."""
    q = quantiles(df, col, [0.25, 0.75])
    wide = 1.5 * (F.col("q1") - F.col("q0"))
    return df.crossJoin(F.broadcast(q)).agg(share((F.col(col) < F.col("q0") - wide) | (F.col(col) > F.col("q1") + wide)).alias("value"))  # q is one row


def duplicate_share(df: DataFrame, cols: list[str]) -> DataFrame:
    """Q10: rows beyond the first of each kind, of all rows."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).agg((1 - F.count(F.lit(1)) / F.nullif(F.sum("n"), F.lit(0))).alias("value"))


def neighbour_label_consistency(df: DataFrame, key: str, x: str, y: str, label: str, t: float) -> DataFrame:
    """Q11: of the pairs no farther apart than t, the share with equal labels. Pairs meet in the cells of a grid of width t,
    each pair once; equal points with equal labels are counted, not paired."""
    pts = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(label).alias("l")).agg(F.count(F.lit(1)).alias("n"))
    pts = pts.withColumn("cx", F.floor(F.col("x") / t)).withColumn("cy", F.floor(F.col("y") / t))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = pts.select("x", "y", "l", "n", F.explode(steps).alias("s"), "cx", "cy").select("x", "y", "l", "n", (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"))
    b = pts.select(F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("l").alias("l2"), F.col("n").alias("n2"), "cx", "cy")
    near = a.join(b, ["cx", "cy"]).where(F.pow(F.col("x") - F.col("x2"), 2) + F.pow(F.col("y") - F.col("y2"), 2) <= t * t)
    same = F.col("l").eqNullSafe(F.col("l2"))
    self_ = (F.col("x") == F.col("x2")) & (F.col("y") == F.col("y2")) & same
    pairs = F.when(self_, F.col("n") * (F.col("n") - 1)).otherwise(F.col("n") * F.col("n2"))  # ordered pairs
    return near.agg((F.sum(F.when(same, pairs).otherwise(0)) / F.nullif(F.sum(pairs), F.lit(0))).alias("value"))


def format_efficiency(df: DataFrame, cols: list[str]) -> DataFrame:
    """Q14: bytes that the integer columns need, of the bytes that their types take."""
    width = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8}
    kinds = dict(df.dtypes)
    need = lambda c: F.when((F.min(c) >= -(2**7)) & (F.max(c) < 2**7), 1).when((F.min(c) >= -(2**15)) & (F.max(c) < 2**15), 2).when((F.min(c) >= -(2**31)) & (F.max(c) < 2**31), 4).otherwise(8)
    total = sum((need(c) for c in cols[1:]), need(cols[0]))
    return df.agg((total / sum(width[kinds[c]] for c in cols)).alias("value"))


def label_proportions(df: DataFrame, group: str, label: str, most: int = 1000) -> DataFrame:
    """Q17: (key `g1|g2|label`, P(label|g1) - P(label|g2)) of every two groups, g1 < g2. The result has a row for every two groups and
    label, so both are checked to be categories: more than `most` of either are an error."""
    n = df.where(F.col(group).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(group).cast("string").alias("g"), F.col(label).cast("string").alias("l")).agg(F.count(F.lit(1)).alias("n"))
    n = durable(n)
    for c in ("g", "l"):
        if n.select(c).distinct().limit(most + 1).count() > most:
            raise ValueError(f"more than {most} values: not categories")
    tot = n.groupBy("g").agg(F.sum("n").alias("t"))
    full = tot.crossJoin(n.select("l").distinct()).join(n, ["g", "l"], "left").select("g", "l", (F.coalesce("n", F.lit(0)) / F.col("t")).alias("p"))
    other = full.select(F.col("g").alias("g2"), "l", F.col("p").alias("p2"))
    return full.join(other, "l").where(F.col("g") < F.col("g2")).select(F.concat_ws("|", "g", "g2", "l").alias("key"), (F.col("p") - F.col("p2")).alias("value"))


def label_divergence(df: DataFrame, label: str, labels: list) -> DataFrame:
    """Q18: Jensen-Shannon divergence (base 2) of the label shares to the uniform distribution over `labels`."""
    counts = df.agg(*[F.count_if(F.col(label) == v).alias(f"n{i}") for i, v in enumerate(labels)])
    total = sum((F.col(f"n{i}") for i in range(1, len(labels))), F.col("n0"))
    u = 1.0 / len(labels)
    out = F.lit(0.0)
    for i in range(len(labels)):
        p = F.col(f"n{i}") / total
        m = (p + u) / 2
        out = out + 0.5 * F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + 0.5 * u * F.log2(F.lit(u) / m)
    return counts.select(F.when(total > 0, out).alias("value"))


def label_abundance(df: DataFrame, label: str) -> DataFrame:
    """Q21: the share of each label among all rows."""
    n = df.groupBy(F.col(label).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("t")))).select("key", (F.col("n") / F.col("t")).alias("value"))  # one row


def category_effectiveness(df: DataFrame, col: str, least: int) -> DataFrame:
    """Q24: the share of categories with at least `least` rows."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n")).agg((F.count_if(F.col("n") >= least) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("value"))


# Decisions.


def decide(value: Column, threshold: Column, higher: Column | bool = True) -> Column:
    """Passed or failed against a constant threshold; pending without a value."""
    higher = F.lit(higher) if isinstance(higher, bool) else higher
    ok = F.when(higher, value >= threshold).otherwise(value <= threshold)
    return F.when(value.isNull(), "pending").when(ok, "passed").otherwise("failed")


def decide_moving(value: float, history: list, threshold: float, window: int, least: int, higher: bool = True) -> str:
    """How far the value lies on the wrong side of the mean of the last `window` values. A value that is worse at
    all is a warning short of `threshold`: the only rule that the known case allows, where a drop of 0.027 warns at a warning
    threshold of 0.05, which therefore has no part. Under `least` values the threshold is a constant one."""
    past = numbers(history)
    if len(past) < least:
        return "passed" if (value >= threshold) == higher or value == threshold else "failed"
    mean = sum(past[-window:]) / len(past[-window:])
    worse = (mean - value) if higher else (value - mean)
    return "failed" if worse > threshold else "warning" if worse > 0 else "passed"


def decide_learned(value: float, history: list, threshold: float, warn: float, least: int, higher: bool = True) -> str:
    """Deviations from the history's mean on the wrong side: over `threshold` fails, over `warn` warns."""
    past = numbers(history)
    if len(past) < least:
        return "pending"
    mean = sum(past) / len(past)
    sd = math.sqrt(sum((x - mean) ** 2 for x in past) / len(past)) or 1e-12
    z = ((mean - value) if higher else (value - mean)) / sd
    return "failed" if z > threshold else "warning" if z > warn else "passed"


def decide_series(df: DataFrame, series: list[str], order: list[Column], value: str, spec: dict) -> DataFrame:
    """D01..D04 over the rows of metric series: df with `status` and `decision` (which rule decided).

    spec: kind (constant_threshold, moving_average, learned_model, if_then_else), threshold, warning (learned), window, least,
    higher. Each value is judged against the usable values before it in its series: the mean of the last `window`, or mean and
    deviation of all; if_then_else is a moving average that falls back to the constant threshold under `least` values, the
    others are pending. A null or NaN value is pending. A series is a metric's history: one value a run."""
    kind, t, least, higher = spec["kind"], spec["threshold"], spec.get("least", 1), spec.get("higher", True)
    v = F.when(~F.isnan(F.col(value)), F.col(value))
    w = Window.partitionBy(*series).orderBy(*order)
    flat = decide(v, F.lit(t), higher)
    if kind == "constant_threshold":
        return df.withColumn("status", flat).withColumn("decision", F.lit(kind))
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    n = F.count(v).over(upto)
    side = F.lit(1.0 if higher else -1.0)
    if kind == "learned_model":
        z = side * (F.avg(v).over(upto) - v) / F.greatest(F.stddev_pop(v).over(upto), F.lit(1e-12))
        told = F.when(z > t, "failed").when(z > spec["warning"], "warning").otherwise("passed")
    elif kind in ("moving_average", "if_then_else"):
        worse = side * (F.avg(v).over(w.rowsBetween(-spec["window"], -1)) - v)
        told = F.when(worse > t, "failed").when(worse > 0, "warning").otherwise("passed")
    else:
        raise ValueError(kind)
    short = flat if kind == "if_then_else" else F.lit("pending")
    ready = n >= least
    return df.withColumn("status", F.when(v.isNull(), "pending").when(ready, told).otherwise(short)).withColumn("decision", F.when(ready, "moving_average" if kind == "if_then_else" else kind).otherwise("constant_threshold" if kind == "if_then_else" else kind))


def numbers(history: list, key: str = "overall") -> list[float]:
    """The numeric values of a history; a composite entry gives its `key`."""
    out = []
    for h in history:
        h = h.get(key) if isinstance(h, dict) else h
        if isinstance(h, (int, float)) and not isinstance(h, bool) and h == h:
            out.append(float(h))
    return out


def check_table(values: DataFrame, specs: DataFrame, override: float | None = None) -> DataFrame:
    """values(metric, key, value) against specs(metric, threshold, higher); a metric without a value is pending.

    `override` replaces every threshold. Specs are a fixed list of metrics, so they may be broadcast."""
    t = F.lit(override) if override is not None else F.col("threshold")
    out = specs.join(values, "metric", "left")
    name = F.when(F.col("key").isNotNull(), F.concat_ws(":", "metric", "key")).otherwise(F.col("metric"))
    return out.select(name.alias("check"), "value", t.alias("threshold"), decide(F.col("value"), t, F.col("higher")).alias("status"))


# Profiles.


def column_profile(df: DataFrame, samples: int = 12) -> DataFrame:
    """P01..P06: one row per column: is_numeric, null_count, null_pct, unique_count, min, max, mean, inferred_type, scale, sample_values.

    Two passes over the data whatever the number of columns: one fused aggregation and one for the distinct values, which
    are counted, and sampled, as text. NaN counts as a value. An empty table has counts of 0 and no type."""
    kinds = {f.name: f.dataType for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))}
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, (c, k) in enumerate(kinds.items()):
        x, text = F.col(f"`{c}`"), F.col(f"`{c}`").cast("string")
        num = x.cast("double") if isinstance(k, T.NumericType) else text.try_cast("double")
        aggs += [F.count(x).alias(f"c{i}"), F.count(num).alias(f"f{i}"), F.count_if((num == F.floor(num)) & ~text.contains(".")).alias(f"i{i}"), F.count_if(F.lower(text).isin("true", "false")).alias(f"b{i}"), F.min(num).alias(f"lo{i}"), F.max(num).alias(f"hi{i}"), F.avg(num).alias(f"av{i}")]
    one = df.agg(*aggs)
    rows = []
    for i, (c, k) in enumerate(kinds.items()):
        n = F.col(f"c{i}")
        parsed = F.col(f"f{i}") >= 0.9 * n
        if isinstance(k, T.BooleanType):
            kind, numeric = F.lit("bool"), F.lit(False)
        elif isinstance(k, T.IntegralType):
            kind, numeric = F.lit("int"), F.lit(True)
        elif isinstance(k, T.NumericType):
            kind, numeric = F.lit("float"), F.lit(True)
        else:
            kind = F.when(F.col(f"b{i}") >= 0.9 * n, "bool").when(F.col(f"i{i}") >= 0.9 * n, "int").when(parsed, "float").otherwise("str")
            numeric = parsed & (n > 0)
        kind = F.when(n == 0, F.lit(None)).otherwise(kind)
        shown = F.when(numeric, F.col(f"lo{i}")), F.when(numeric, F.col(f"hi{i}")), F.when(numeric, F.col(f"av{i}"))
        rows.append(F.struct(F.lit(c).alias("column"), numeric.alias("is_numeric"), (F.col("n") - n).alias("null_count"), F.coalesce(F.round((F.col("n") - n) / F.nullif(F.col("n"), F.lit(0)), 6), F.lit(0.0)).alias("null_pct"), shown[0].alias("min"), shown[1].alias("max"), shown[2].alias("mean"), kind.alias("inferred_type"), n.alias("_n")))
    out = one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    cells = durable(df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in kinds])).alias("x")).select("x.column", "x.v").where("v is not null").distinct())
    w = Window.partitionBy("column").orderBy("v")  # partitions pass on their first rows only, as the rank is bounded
    some = cells.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= samples).groupBy("column").agg(F.array_sort(F.collect_list("v")).alias("sample_values"))
    out = out.join(cells.groupBy("column").agg(F.count(F.lit(1)).alias("unique_count")), "column", "left").withColumn("unique_count", F.coalesce("unique_count", F.lit(0)))
    k, u = F.col("inferred_type"), F.col("unique_count")
    scale = F.when(F.col("_n") == 0, F.lit(None)).when(u <= 2, "binary").when(k.isin("str", "bool"), "categorical").when((k == "int") & (u <= 20), "ordinal").otherwise("continuous")
    out = out.withColumn("scale", scale).select("column", "is_numeric", "null_count", "null_pct", "unique_count", "min", "max", "mean", "inferred_type", "scale")
    return out.join(some, "column", "left")


def entropy(df: DataFrame, label: str) -> DataFrame:
    """Class entropy in nats, number of classes and the least, mean and greatest class probability."""
    n = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    p = n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("t")))).select((F.col("n") / F.col("t")).alias("p"))  # one row
    return p.agg(F.count(F.lit(1)).alias("NumberOfClasses"), F.min("p").alias("ClassProbabilityMin"), F.avg("p").alias("ClassProbabilityMean"), F.max("p").alias("ClassProbabilityMax"), F.sum(-F.col("p") * F.log("p")).alias("ClassEntropy"))


#: Words in a metafeature's name that mark it as a count.
COUNT_WORDS = ["Number", "Count", "Instances", "Features", "Dimensionality"]


def is_count_scale(name: str) -> bool:
    return not name.startswith("Log") and any(w in name for w in COUNT_WORDS)


def profile_vector(profile: Column, order: list[str]) -> Column:
    """P10: a JSON profile as a vector in the given order; absent, non-numeric and non-finite entries are NaN."""
    doc = F.try_parse_json(profile)
    one = lambda k: F.try_variant_get(doc, f"$['{k}']", "double")
    return F.array(*[F.when(one(k).isNotNull() & ~F.isnan(one(k)) & (F.abs(one(k)) < float("inf")), one(k)).otherwise(float("nan")) for k in order])


def policy_vector(vec: Column, order: list[str]) -> Column:
    """NaN as 0, and log1p of count-scale entries."""
    flags = F.array(*[F.lit(is_count_scale(k)) for k in order])
    clean = F.transform(vec, lambda x: F.when(F.isnan(x), 0.0).otherwise(x))
    return F.zip_with(clean, flags, lambda x, f: F.when(f & (x > -1), F.log1p(x)).otherwise(x))


def min_max_normalise(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Every dimension to 0..1 over the table (a constant one to 0); non-finite entries are 0 after scaling.

    The bounds are one row of arrays, aggregated per position, and come back by broadcast."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    each = df.select(F.posexplode(vec).alias("i", "x")).where(finite(F.col("x"))).groupBy("i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    bounds = each.agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct("lo", "hi")))).alias("b"))  # one row, as wide as a vector
    scaled = F.transform(F.col(vec), lambda x, i: F.when(finite(x), (x - F.col("b")[i]["lo"]) / F.when(F.col("b")[i]["hi"] > F.col("b")[i]["lo"], F.col("b")[i]["hi"] - F.col("b")[i]["lo"]).otherwise(1.0)).otherwise(0.0))
    return df.crossJoin(F.broadcast(bounds)).withColumn(vec, scaled).drop("b")


def guess_target(profile: list[dict], names: list[str]) -> str | None:
    """A column named as a target, else the last one if it has at most 50 distinct values or is not numeric."""
    for n in names:
        if n.lower() in ("target", "label", "class", "y", "outcome"):
            return n
    last = next((p for p in profile if names and p["column"] == names[-1]), None)
    return names[-1] if last and (last["unique_count"] <= 50 or not last["is_numeric"]) else None


def type_map(df: DataFrame) -> dict[str, str]:
    """Numeric or categorical, by type."""
    return {f.name: "numeric" if isinstance(f.dataType, T.NumericType) else "categorical" for f in df.schema.fields}
