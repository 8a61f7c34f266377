"""Statistical risk checks, fairness and mitigations (C, R)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpie.sources.tables import durable

from kelpie.operators.docstore import rule


def chi2_p(stat: float, dof: int) -> float:
    """The upper tail of the chi-square distribution, by the incomplete gamma function."""
    a, x = dof / 2, stat / 2
    if x <= 0 or dof <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def ks_p(d: float, n: int, m: int) -> float:
    """The asymptotic p-value of a two-sample Kolmogorov-Smirnov statistic."""
    if not n or not m:
        return 1.0
    e = math.sqrt(n * m / (n + m))
    t = (e + 0.12 + 0.11 / e) * d
    if t < 1e-3:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101))))


def class_imbalance(df: DataFrame, label: str) -> DataFrame:
    """Chi-square of the class counts to uniform, with total / k as a DOUBLE: (stat, dof)."""
    n = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return n.agg((F.sum(F.col("n") * F.col("n")) * F.count(F.lit(1)) / F.sum("n") - F.sum("n")).alias("stat"), (F.count(F.lit(1)) - 1).alias("dof"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square of independence: (stat, dof); Yates' correction when dof is 1."""
    n = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    ra, rb = n.groupBy("a").agg(F.sum("n").alias("ra")), n.groupBy("b").agg(F.sum("n").alias("rb"))
    one = n.agg(F.sum("n").alias("t")).crossJoin(ra.agg((F.count(F.lit(1)) - 1).alias("da"))).crossJoin(rb.agg((F.count(F.lit(1)) - 1).alias("db")))  # one row each
    one = one.select("t", (F.col("da") * F.col("db")).alias("dof"))
    # Over the cells that occur: the empty ones are told from the margins.
    full = n.join(ra, "a").join(rb, "b").agg(F.sum(F.col("n") * F.col("n") / (F.col("ra") * F.col("rb"))).alias("f"))
    # Yates' correction needs the empty cells of a table of two by two: the margins have two rows each, else none pass.
    two = F.broadcast(one.where("dof = 1"))
    e = F.col("ra") * F.col("rb") / F.col("t")
    gap = F.abs(F.coalesce("n", F.lit(0)) - e)
    gap = gap - F.least(F.lit(0.5), gap)
    yates = ra.crossJoin(two).crossJoin(rb.crossJoin(two.select("dof")).select("b", "rb")).join(n, ["a", "b"], "left").agg(F.sum(gap * gap / e).alias("y"))
    return one.crossJoin(full).crossJoin(yates).select(F.when(F.col("dof") == 1, F.col("y")).otherwise(F.col("t") * (F.col("f") - 1)).alias("stat"), "dof")  # one row each


def ks_statistic(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """The two-sample KS statistic (d, n, m), over cumulative counts of a range-partitioned histogram."""
    both = a.select(F.col(col).cast("double").alias("v"), F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(F.col(col).cast("double").alias("v"), F.lit(0).alias("x"), F.lit(1).alias("y")))
    hist = both.where("v is not null").groupBy("v").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    part = durable(hist.repartitionByRange("v").withColumn("_p", F.spark_partition_id()))  # kept, so both uses see the same ranges
    up = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = part.groupBy("_p").agg(F.sum("x").alias("px"), F.sum("y").alias("py")).select("_p", F.coalesce(F.sum("px").over(up), F.lit(0)).alias("bx"), F.coalesce(F.sum("py").over(up), F.lit(0)).alias("by"))
    w = Window.partitionBy("_p").orderBy("v")
    run = part.join(F.broadcast(base), "_p").crossJoin(F.broadcast(hist.agg(F.sum("x").alias("n"), F.sum("y").alias("m"))))  # one row per partition; one row
    run = run.select(((F.col("bx") + F.sum("x").over(w)) / F.col("n")).alias("fx"), ((F.col("by") + F.sum("y").over(w)) / F.col("m")).alias("fy"), "n", "m")
    return run.agg(F.max(F.abs(F.col("fx") - F.col("fy"))).alias("d"), F.first("n").alias("n"), F.first("m").alias("m"))


def scale_shift(before: DataFrame, after: DataFrame, cols: list[str]) -> DataFrame:
    """|sd after - sd before| / (sd before + 1e-8) per column (sample form); biased over 0.1."""
    return _compare(before, after, cols, [(F.stddev_samp, "s")], lambda x: (F.abs(x["s2"] - x["s1"]) / (x["s1"] + 1e-8)).alias("shift"))


def outlier_removal(before: DataFrame, after: DataFrame, cols: list[str]) -> DataFrame:
    """Ratio of the standard deviations and of the ranges per column; biased under 0.1 and 0.2; constants are skipped."""
    spread = lambda c: F.max(c) - F.min(c)
    return _compare(before, after, cols, [(F.stddev_samp, "s"), (spread, "r")], lambda x: F.when((x["s1"] > 0) & (x["r1"] > 0), F.struct((x["s2"] / x["s1"]).alias("sd"), (x["r2"] / x["r1"]).alias("range"))).alias("ratio"))


def _compare(before, after, cols, stats, f):
    one = [df.agg(*[g(F.col(c)).alias(f"{n}{k}_{i}") for i, c in enumerate(cols) for g, n in stats]) for k, df in ((1, before), (2, after))]
    row = one[0].crossJoin(one[1])  # one row each
    cells = [F.struct(F.lit(c).alias("column"), f({f"{n}{k}": F.col(f"{n}{k}_{i}") for _, n in stats for k in (1, 2)})) for i, c in enumerate(cols)]
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def zero_variance(df: DataFrame, cols: list[str]) -> DataFrame:
    """The columns with at most one distinct value, in one pass (least equals greatest)."""
    one = df.agg(*[(F.count(c) == 0).alias(f"e{i}") for i, c in enumerate(cols)], *[(F.min(c) == F.max(c)).alias(f"z{i}") for i, c in enumerate(cols)])
    cells = [F.struct(F.lit(c).alias("column"), (F.col(f"e{i}") | F.coalesce(F.col(f"z{i}"), F.lit(False))).alias("constant")) for i, c in enumerate(cols)]
    return one.select(F.explode(F.array(*cells)).alias("x")).select("x.column", "x.constant")


def fairness(df: DataFrame, group: str, privileged, truth: str, guess: str) -> DataFrame:
    """C14: disparate impact, statistical parity difference, equal opportunity difference and Theil index, of 0/1 labels."""
    p, u = F.col(group) == privileged, F.col(group) != privileged
    rate = lambda who: F.avg(F.when(who, F.col(guess)))
    tpr = lambda who: F.avg(F.when(who & (F.col(truth) == 1), F.col(guess)))
    b = (F.col(guess) - F.col(truth) + 1).cast("double")
    one = df.agg(rate(u).alias("ru"), rate(p).alias("rp"), tpr(u).alias("tu"), tpr(p).alias("tp"), F.avg(b).alias("mu"), F.avg(F.when(b > 0, b * F.log(b)).otherwise(0.0)).alias("bl"))
    # the mean of (b/mu) ln(b/mu), from two sums
    theil = F.col("bl") / F.col("mu") - F.log("mu")
    return one.select((F.col("ru") / F.nullif(F.col("rp"), F.lit(0.0))).alias("disparate_impact"), (F.col("ru") - F.col("rp")).alias("statistical_parity"), (F.col("tu") - F.col("tp")).alias("equal_opportunity"), theil.alias("theil"))


def reweigh(df: DataFrame, group: str, label: str) -> DataFrame:
    """w(g, y) = P(g) P(y) / P(g, y) of every combination that occurs."""
    n = df.groupBy(F.col(group).alias("g"), F.col(label).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # over the few combinations
    return n.select("g", "y", (F.sum("n").over(Window.partitionBy("g")) * F.sum("n").over(Window.partitionBy("y")) / total / F.col("n")).alias("weight"))


# Mitigations: every one is DataFrame -> DataFrame; logs are DataFrames of (key, column, old, new, method).


def remove_duplicates(df: DataFrame, cols: list[str]) -> DataFrame:
    """R01"""
    return df.dropDuplicates(cols)


def remove_missing(df: DataFrame, cols: list[str]) -> DataFrame:
    """R02, R04"""
    return df.na.drop(subset=cols)


def impute(df: DataFrame, numeric: list[str], text: list[str]) -> DataFrame:
    """Means for numbers; for text the most frequent value, the least of those that tie."""
    if numeric:
        one = df.agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(numeric)])
        df = df.crossJoin(F.broadcast(one)).withColumns({c: F.coalesce(F.col(c), F.col(f"_m{i}")) for i, c in enumerate(numeric)}).drop(*[f"_m{i}" for i in range(len(numeric))])  # one row
    for c in text:
        mode = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("_v")).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "_v").limit(1).select("_v")
        df = df.join(F.broadcast(mode), F.lit(True), "left").withColumn(c, F.coalesce(c, "_v")).drop("_v")  # one row
    return df


def impute_outliers(df: DataFrame, col: str, lo, hi) -> DataFrame:
    """Values out of range become the mean of those in range; nulls stay."""
    ok = F.col(col).between(lo, hi)
    one = df.agg(F.avg(F.when(ok, F.col(col))).alias("_m"))
    return df.crossJoin(F.broadcast(one)).withColumn(col, F.when(F.col(col).isNull() | ok, F.col(col)).otherwise(F.col("_m"))).drop("_m")  # one row


def repair_syntax(df: DataFrame, key: str, col: str, allowed: list[str], most: int = 2) -> DataFrame:
    """(key, old, new, method): the allowed value nearest in edit distance, at most `most`; two equally near go to review.

    Distances are taken once for each distinct value, against the caller's list."""
    v = df.select(F.col(col).alias("old")).where("old is not null").groupBy("old").agg(F.count(F.lit(1)).alias("n"))
    tidy = F.upper(F.trim("old"))
    near = F.array_sort(F.array(*[F.struct(F.levenshtein(tidy, F.lit(a.upper())).alias("d"), F.lit(a).alias("a")) for a in allowed]))
    v = v.withColumn("near", near)
    best, tie = F.col("near")[0], F.col("near")[1]["d"] == F.col("near")[0]["d"] if len(allowed) > 1 else F.lit(False)
    method = F.when(best["d"] == 0, "exact").when(best["d"] > most, "review").when(tie, "review").otherwise("edit_distance")
    v = v.select("old", "n", F.when(method != "review", best["a"]).alias("new"), method.alias("method"))
    # Values that a 4096th of the rows bear number under 4096, so their repairs may be broadcast; the rest have no skew to join.
    v = durable(v)
    least = (v.agg(F.sum("n")).first()[0] or 0) / 4096
    rows = df.select(F.col(key), F.col(col).alias("old")).where("old is not null")
    often = F.broadcast(v.where(F.col("n") > least).select(F.col("old").alias("_o"), F.col("new").alias("_n"), F.col("method").alias("_m")))
    rows = rows.join(often, F.col("old") == F.col("_o"), "left")
    seldom = v.where(F.col("n") <= least).select("old", "new", "method")
    return rows.where("_o is not null").select(key, "old", F.col("_n").alias("new"), F.col("_m").alias("method")).unionByName(rows.where("_o is null").select(key, "old").join(seldom, "old").select(key, "old", "new", "method"))


def enforce(df: DataFrame, rules: list[dict]) -> DataFrame:
    """`between` clamps, `in` replaces others by the first allowed value; nulls stay."""
    for r in rules:
        c = F.col(r["column"])
        if r["op"] == "between":
            new = F.least(F.greatest(c, F.lit(r["value"][0])), F.lit(r["value"][1]))
            df = df.withColumn(r["column"], F.when(c.isNotNull(), new))
        elif r["op"] == "in":
            df = df.withColumn(r["column"], F.when(c.isNull() | c.isin(*r["value"]), c).otherwise(F.lit(r["value"][0])))
        else:
            raise NotImplementedError(r["op"])
    return df


def normalise_formats(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Int ("31.0" is 31), float, bool (yes/no, 1/0, true/false) and datetime (as text); what doesn't parse is null."""
    for name, kind in kinds.items():
        t = F.trim(F.col(name).cast("string"))
        new = {
            "int": F.round(t.try_cast("double")).cast("bigint"),
            "float": t.try_cast("double"),
            "bool": F.when(F.lower(t).isin("yes", "y", "true", "t", "1", "1.0"), True).when(F.lower(t).isin("no", "n", "false", "f", "0", "0.0"), False),
            "datetime": F.date_format(t.try_cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss"),
        }[kind]
        df = df.withColumn(name, new)
    return df


def round_values(df: DataFrame, places: dict[str, int]) -> DataFrame:
    """R09"""
    return df.withColumns({c: F.round(F.col(c), p) for c, p in places.items()})


def remove_irrelevant(df: DataFrame, keep: dict) -> tuple[DataFrame, DataFrame]:
    """(rows that satisfy the rule, rows removed with a `method`); a row for which it is unknown is removed."""
    ok: Column = F.coalesce(rule(keep), F.lit(False))
    return df.where(ok), df.where(~ok).withColumn("method", F.lit("remove_irrelevant_records"))


def repair_log(before: DataFrame, after: DataFrame, key: str, cols: list[str], method: str) -> DataFrame:
    """(key, column, old, new, method) of every changed cell."""
    b = after.select(F.col(key).alias("_k"), *[F.col(c).cast("string").alias(f"n_{c}") for c in cols])
    both = before.select(F.col(key), *[F.col(c).cast("string").alias(f"o_{c}") for c in cols]).join(b, F.col(key) == F.col("_k"))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"o_{c}").alias("old"), F.col(f"n_{c}").alias("new")) for c in cols])
    return both.select(key, F.explode(F.filter(cells, lambda x: ~x["old"].eqNullSafe(x["new"]))).alias("x")).select(key, "x.column", "x.old", "x.new", F.lit(method).alias("method"))


def unordered_categories(df: DataFrame) -> list[str]:
    """Text columns that no metadata (`ordered`) marks as ordered."""
    return [f.name for f in df.schema.fields if f.dataType.typeName() == "string" and not (f.metadata or {}).get("ordered", False)]


#: Scanners of text guardrails. An extension: the checks of these names elsewhere never fire.
GUARDRAILS = {
    "prompt_injection": r"(?i)\b(ignore|disregard) (all |any )?(previous|prior|above) (instructions|rules)",
    "pii_leak": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "link": r"https?://",
}


def scan_text(df: DataFrame, text: str) -> DataFrame:
    """(check, hits) of every guardrail, in one pass."""
    one = df.agg(*[F.count_if(F.col(text).rlike(p)).alias(n) for n, p in GUARDRAILS.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("hits")) for n in GUARDRAILS])).alias("x")).select("x.check", "x.hits")


def _imbalanced(df: DataFrame, label: str) -> bool:
    r = class_imbalance(df, label).first()
    return r.stat is not None and r.dof > 0 and chi2_p(r.stat, r.dof) < 0.05


def _dependent(df: DataFrame, group: str, label: str) -> bool:
    r = contingency(df, group, label).first()
    return r.stat is not None and r.dof > 0 and chi2_p(r.stat, r.dof) < 0.05


def _shifted(train: DataFrame, test: DataFrame, cols: list[str]) -> bool:
    kinds = dict(train.dtypes)
    for c in cols:
        if kinds[c] == "string":
            both = train.select(c, F.lit("a").alias("_s")).unionByName(test.select(c, F.lit("b").alias("_s")))
            if _dependent(both, c, "_s"):
                return True
        else:
            r = ks_statistic(train, test, c).first()
            if r.d is not None and ks_p(r.d, r.n, r.m) < 0.05:
                return True
    return False


#: The checks by name.
CHECKS = {
    "class_imbalance": _imbalanced,
    "group_bias": _dependent,
    "selection_bias": _shifted,
    "sampling_bias": _shifted,
    "domain_shift_bias": _shifted,
    "feature_scaling_bias": lambda a, b, cols: any((r.shift or 0) > 0.1 for r in scale_shift(a, b, cols).collect()),  # one row per column
    "outlier_bias": lambda a, b, cols: any(r.ratio is not None and (r.ratio["sd"] < 0.1 or r.ratio["range"] < 0.2) for r in outlier_removal(a, b, cols).collect()),
    "zero_variance_feature_bias": lambda df, cols: any(r.constant for r in zero_variance(df, cols).collect()),
    "loss_of_ordinality_bias": lambda df: bool(unordered_categories(df)),
}


def run_check(name: str, *args) -> tuple[bool, str]:
    """(found, message); a name without a check is not found, and the message says so."""
    if name not in CHECKS:
        return False, f"{name} is not implemented"
    found = bool(CHECKS[name](*args))
    return found, f"{name} {'found' if found else 'not found'}"
