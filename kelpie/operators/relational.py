"""Joins, aggregations, windows, ordering and set operators of the experiment store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpie.sources.tables import durable


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key in the given order (which should end in a unique column)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key; one exchange, no sort of the old side. Null keys match each other."""
    cond = None
    fresh = new.select(*[F.col(k).alias(f"_n_{k}") for k in keys]).distinct()
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_n_{k}"))
        cond = c if cond is None else cond & c
    return old.join(fresh, cond, "left_anti").unionByName(new)


def win_rates(interactions: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Wins, comparisons and their ratio per pipeline (and `by`).

    The OR-join (compared = p or preferred = p) becomes an explode of both ids and an equi-aggregation; a row that
    names a pipeline in both columns counts once. Rows without a preferred id still count as comparisons."""
    ids = F.array_distinct(F.filter(F.array("compared_id", "preferred_id"), lambda x: x.isNotNull()))
    each = interactions.select(*by, "preferred_id", F.explode(ids).alias("pipeline_id"))
    won = F.count_if(F.col("preferred_id") == F.col("pipeline_id"))
    return each.groupBy("pipeline_id", *by).agg(won.alias("wins"), F.count(F.lit(1)).alias("compared")).withColumn("win_rate", F.col("wins") / F.col("compared"))


def pending_pairs(n_left: Column, n_right: Column, done: Column) -> Column:
    """Pairs still to be evaluated, floored at 0."""
    return F.greatest(n_left * n_right - done, F.lit(0))


def nearest_rank(values: Column, p: int) -> Column:
    """The element at int(n * p / 100) of a sorted array (not interpolated); null for an empty one."""
    i = F.least(F.floor(F.size(values) * p / 100), F.size(values) - 1).cast("int")
    return F.when(F.size(values) > 0, F.element_at(values, i + 1))


def duration_stats(df: DataFrame, seconds: str) -> DataFrame:
    """N, median, p75, p95, min, max, mean of positive durations; 30/45/120 where there is none.

    Ranks are read off a cumulative count of distinct values, so no array of all durations is built."""
    pos = df.where(F.col(seconds) > 0)
    hist = pos.groupBy(F.col(seconds).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    part = hist.repartitionByRange("v").withColumn("_p", F.spark_partition_id())
    # offsets of the range partitions: one row per partition
    base = part.groupBy("_p").agg(F.sum("c").alias("pc")).withColumn("before", F.coalesce(F.sum("pc").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = pos.agg(F.count(F.lit(1)).alias("n"), F.min(seconds).alias("lo"), F.max(seconds).alias("hi"), F.avg(seconds).alias("mean"))
    run = part.join(F.broadcast(base.select("_p", "before")), "_p").withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy("_p").orderBy("v")))
    run = run.crossJoin(F.broadcast(total.select("n")))  # one row
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1), F.col("v")))
    ranks = run.agg(at(50).alias("median"), at(75).alias("p75"), at(95).alias("p95"))
    return total.crossJoin(ranks).select("n", F.coalesce("median", F.lit(30.0)).alias("median"), F.coalesce("p75", F.lit(45.0)).alias("p75"), F.coalesce("p95", F.lit(120.0)).alias("p95"), F.col("lo").alias("min"), F.col("hi").alias("max"), "mean")


def running(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column], totals: bool = False) -> DataFrame:
    """df with running sums of the (non-null) columns `sums` over each group of `by` (none: over all rows) in an order whose last column is
    unique; with `totals`, also each group's total as <name>_total.

    Rows are cut into ranges of (by, order), so a hot group is spread over many tasks; a range is summed on its own and moved on
    by what its group has in the ranges before. Only groups that lie in several ranges need that, at most two rows a range,
    so it may be broadcast. Null keys form a group. The ranges are kept, so that both uses see the same ones."""
    part = durable(df.withColumns({f"_v{i}": c for i, c in enumerate(sums.values())}).repartitionByRange(*[F.col(c) for c in by], *order).withColumn("_p", F.spark_partition_id()))
    n = range(len(sums))
    per = part.groupBy("_p", *by).agg(*[F.sum(f"_v{i}").alias(f"_s{i}") for i in n])
    group = Window.partitionBy(*[F.col(c) for c in by]) if by else Window.partitionBy(F.lit(1))
    if by:
        spread = per.groupBy(*by).agg(F.count(F.lit(1)).alias("_k"), F.collect_list(F.struct("_p", *[f"_s{i}" for i in n])).alias("_x")).where("_k > 1")
        per = spread.select(*by, F.explode("_x").alias("_y")).select(*by, "_y.*")
    ahead = group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("_p", *[F.col(c).alias(f"_g{j}") for j, c in enumerate(by)], *[F.coalesce(F.sum(f"_s{i}").over(ahead), F.lit(0)).alias(f"_b{i}") for i in n], *[F.sum(f"_s{i}").over(group).alias(f"_t{i}") for i in n])
    same = part["_p"] == per["_p"]
    for j, c in enumerate(by):
        same = same & part[c].eqNullSafe(per[f"_g{j}"])
    out = part.join(F.broadcast(per), same, "left").drop(per["_p"])
    w = Window.partitionBy("_p", *by)
    out = out.withColumns({name: F.coalesce(f"_b{i}", F.lit(0)) + F.sum(f"_v{i}").over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) for i, name in enumerate(sums)})
    if totals:
        out = out.withColumns({f"{name}_total": F.coalesce(f"_t{i}", F.sum(f"_v{i}").over(w)) for i, name in enumerate(sums)})
    return out.drop("_p", *[f"_g{j}" for j in range(len(by))], *[f"_{k}{i}" for k in "vbt" for i in n])


def ranked(df: DataFrame, order: list[Column], place: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """`place` from 1 of every row (of its group) in an order whose last column is unique."""
    return running(df, by, order, {place: F.lit(1)}).withColumn(place, F.col(place).cast("int"))


def tied_places(df: DataFrame, by: list[str], value: str, descending: bool = False) -> DataFrame:
    """(by, value, n_at, n_upto, n_group) of each distinct value of each group: rows that have it, that come no later, and in all.

    From running sums over the histogram; rank, percent rank and cumulative share follow by arithmetic."""
    hist = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n_at"))
    out = running(hist, by, [F.desc(value) if descending else F.asc(value)], {"n_upto": F.col("n_at")}, totals=True)
    return out.withColumnRenamed("n_upto_total", "n_group")


def with_places(df: DataFrame, by: list[str], value: str, descending: bool = False) -> DataFrame:
    """df with n_at, n_upto and n_group of its value; nulls are values."""
    t = tied_places(df, by, value, descending).select(*[F.col(c).alias(f"_t{i}") for i, c in enumerate([*by, value])], "n_at", "n_upto", "n_group")
    same = None
    for i, c in enumerate([*by, value]):
        eq = F.col(c).eqNullSafe(F.col(f"_t{i}"))
        same = eq if same is None else same & eq
    return df.join(t, same).drop(*[f"_t{i}" for i in range(len(by) + 1)])


def promotion(ledger: DataFrame, hit_rate: float = 0.95, least: int = 20, instability: float = 0.05) -> DataFrame:
    """(source, rule, target, hits, observations, rate, decision) of each source and rule; ledger: source, rule, target, one row a rewrite.

    target: the most frequent one (ties: the greatest). `defer` under `least` observations; `demote` if its share is under `hit_rate`;
    `defer` if the target is itself a source whose most frequent target has a share over 1 - instability; else `promote`.
    Rows without a target are observations of none and are left out; combined map-side before anything meets."""
    each = ledger.where("source is not null and target is not null").groupBy("source", "rule", "target").agg(F.count(F.lit(1)).alias("n"))
    best = each.groupBy("source", "rule").agg(F.sum("n").alias("observations"), F.max(F.struct("n", "target")).alias("m"))
    best = durable(best.select("source", "rule", F.col("m.target").alias("target"), F.col("m.n").alias("hits"), "observations", (F.col("m.n") / F.col("observations")).alias("rate")))
    firm = best.groupBy(F.col("source").alias("target")).agg(F.max("rate").alias("_onward"))
    decision = F.when(F.col("observations") < least, "defer").when(F.col("rate") < hit_rate, "demote").when(F.coalesce("_onward", F.lit(0.0)) > 1 - instability, "defer").otherwise("promote")
    return best.join(firm, "target", "left").select("source", "rule", "target", "hits", "observations", "rate", decision.alias("decision"))


def or_flag(df: DataFrame, other: DataFrame, key: str, flag: str) -> DataFrame:
    """Whether `key` occurs in `other`, as a column that an OR may use (a left join to its distinct keys)."""
    keys = other.select(F.col(key).alias("_k")).distinct().withColumn(flag, F.lit(True))
    return df.join(keys, F.col(key) == F.col("_k"), "left").drop("_k").withColumn(flag, F.coalesce(flag, F.lit(False)))


def by_id_list(df: DataFrame, key: str, ids: list) -> DataFrame:
    """Rows of the listed ids in the list's order, which `pos` gives. The list is the caller's, so it may be broadcast."""
    spark = df.sparkSession
    kind = dict(df.dtypes)[key]
    listed = spark.createDataFrame([(i, v) for i, v in enumerate(ids)], f"pos int, _k {kind}")
    return df.join(F.broadcast(listed), F.col(key) == F.col("_k")).drop("_k")


def smallest_graphs(df: DataFrame, nodes: Column) -> DataFrame:
    """Size of a JSON graph: elements of an array, else keys of an object, else 1,000,000."""
    kind = F.substring(F.ltrim(nodes), 1, 1)
    size = F.when(kind == "[", F.json_array_length(nodes)).when(kind == "{", F.size(F.json_object_keys(nodes)))
    return df.withColumn("graph_size", F.coalesce(size, F.lit(1_000_000)))


def folds(df: DataFrame, key: str, k: int) -> DataFrame:
    """A reproducible fold number from a hash of the key."""
    return df.withColumn("fold", F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(k)).cast("int"))


def sample_hashed(df: DataFrame, key: str, n: int) -> DataFrame:
    """N rows in the order of a hash of their key: random in effect, the same at every run."""
    return df.orderBy(F.md5(F.col(key).cast("string").cast("binary")), key).limit(n)


def sample_or_all(df: DataFrame, fits: Column, key: str, n: int, least: int = 5) -> DataFrame:
    """Up to n rows that fit, in the order of a hash of their key; if fewer than `least` fit, n rows of all, whether they fit or not."""
    some = sample_hashed(df.where(fits), key, n)
    return some if some.count() >= least else sample_hashed(df, key, n)


def weighted_pick(df: DataFrame, weight: str, n: int, key: str, seed: int = 42) -> DataFrame:
    """N rows, each drawn with a chance in proportion to its weight: the least exponential keys -ln(u) / weight, u from a hash of seed
    and key, so the draw is the same however the rows are spread. Unusable weights are never drawn; ties by key."""
    ok = df.where((F.col(weight) > 0) & (F.col(weight) < float("inf")))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), 1, 12), 16, 10).cast("double") + 1) / float((1 << 48) + 1)
    return ok.withColumn("_key", -F.log(u) / F.col(weight)).orderBy("_key", key).limit(n).drop("_key")


def recency_prior(df: DataFrame, by: str, cos: str, success: str, age: str, half_life: float) -> DataFrame:
    """0.25 + sum of cos * success * 0.5^(age / half-life) over rows with cos > 0."""
    w = F.when(F.col(cos) > 0, F.col(cos) * F.col(success) * F.pow(F.lit(0.5), F.col(age) / half_life)).otherwise(0.0)
    return df.groupBy(by).agg((F.lit(0.25) + F.sum(w)).alias("prior"))
