"""Multi-objective ranking of candidates (M12..M24, M39, M40, L11, X20)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kelpie.operators.relational import ranked, running
from kelpie.sources.tables import durable


def _skyline(x: np.ndarray) -> np.ndarray:
    """Indices of the rows that no other row dominates (all objectives are maximised). Rows come in falling order of their sum,
    so a row can only be dominated by one that is already kept."""
    order = np.argsort(-x.sum(1), kind="stable")
    kept: list[int] = []
    held = np.zeros((0, x.shape[1]))
    for i in order:
        if len(held) and ((held >= x[i]).all(1) & (held > x[i]).any(1)).any():
            continue
        kept.append(int(i))
        held = np.vstack([held, x[i]])
    return np.array(sorted(kept), dtype=np.int64)


def pareto_front(df: DataFrame, key: str, objectives: list[str], block: int = 20_000) -> DataFrame:
    """M20, front 0: rows (key, objectives) that no row dominates; rows that tie on every objective are all kept.

    Each partition streams its rows past its own skyline and passes on only that. What is left is deduplicated to distinct
    points and checked against itself: by broadcast while it is under `block` points, else by a theta anti-join. Rows with a
    null or NaN objective are left out; an empty table gives an empty front."""
    rows = df.select(key, *[F.col(c).cast("double").alias(c) for c in objectives])
    for c in objectives:
        rows = rows.where(F.col(c).isNotNull() & ~F.isnan(c))
    schema = T.StructType([f for f in rows.schema.fields if f.name in objectives])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if b.num_rows:
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
                x = np.unique(x if held is None else np.vstack([held, x]), axis=0)
                held = x[_skyline(x)]
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(held[:, i]) for i in range(held.shape[1])], [f.name for f in schema])

    points = durable(rows.select(*objectives).mapInArrow(local, schema).distinct())
    n = points.count()
    other = points.select(*[F.col(c).alias(f"_{c}") for c in objectives])
    better, strict = F.lit(True), F.lit(False)
    for c in objectives:
        better, strict = better & (F.col(f"_{c}") >= F.col(c)), strict | (F.col(f"_{c}") > F.col(c))
    front = points.join(F.broadcast(other) if n <= block else other, better & strict, "left_anti")
    return rows.join(F.broadcast(front) if n <= block else front, objectives, "left_semi")


def fronts(df: DataFrame, key: str, objectives: list[str], pool: int = 5000) -> DataFrame:
    """(key, front) of a candidate pool. The pool is the retrieved list of candidates and so bounded; more than `pool` rows
    are an error (use pareto_front). Null objectives count as 0."""
    rows = df.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in objectives]).limit(pool + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        if t.num_rows > pool:
            raise ValueError(f"a pool of more than {pool} candidates")
        if not t.num_rows:
            return
        x = np.column_stack([t.column(c).to_numpy() for c in objectives])
        out, left, k = np.zeros(len(x), np.int32), np.arange(len(x)), 0
        while len(left):
            here = left[_skyline(x[left])]
            out[here], k = k, k + 1
            left = np.setdiff1d(left, here)
        yield pa.RecordBatch.from_arrays([t.column(key).combine_chunks(), pa.array(out)], [key, "front"])

    kind = dict(df.dtypes)[key]
    return rows.coalesce(1).mapInArrow(run, f"`{key}` {kind}, front int")


def js_fitness(df: DataFrame, objectives: list[str], alpha: float = 0.5, eps: float = 1e-12) -> DataFrame:
    """1 - the generalised Jensen-Shannon divergence of a row's shares to those of the ideal (the best of every objective)."""
    ideal = df.agg(*[F.max(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"_i{k}") for k, c in enumerate(objectives)])
    d = df.crossJoin(F.broadcast(ideal))  # one row
    row, best = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in objectives]), F.array(*[F.col(f"_i{k}") for k in range(len(objectives))])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    entropy = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s - x * F.log(x + eps))
    share = lambda a: F.transform(a, lambda x: x / F.nullif(total(a), F.lit(0.0)))
    p, q = share(row), share(best)
    m = F.zip_with(p, q, lambda x, y: alpha * x + (1 - alpha) * y)
    most = -alpha * np.log(alpha + eps) - (1 - alpha) * np.log(1 - alpha + eps)
    fit = 1 - (entropy(m) - alpha * entropy(p) - (1 - alpha) * entropy(q)) / float(most)
    return d.withColumn("fitness", F.when((total(row) < eps) | (total(best) < eps), 0.0).otherwise(fit)).drop(*[f"_i{k}" for k in range(len(objectives))])


def rank_by(df: DataFrame, strategy: str, key: str, objectives: list[str], weights: list[float] | None = None) -> DataFrame:
    """`place` from 1 in a candidate pool, by strategy: lexicographic, nds_lex, nds_sum, jensen or weighted_sum; ties by key."""
    lex = [F.desc_nulls_last(c) for c in objectives]
    added = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in objectives[1:]), F.coalesce(F.col(objectives[0]), F.lit(0.0)))
    if strategy == "lexicographic":
        order = lex
    elif strategy in ("nds_lex", "nds_sum"):
        df = df.join(fronts(df, key, objectives), key)
        order = [F.asc("front"), *(lex if strategy == "nds_lex" else [F.desc(added)])]
    elif strategy == "jensen":
        df, order = js_fitness(df, objectives), [F.desc("fitness")]
    elif strategy == "weighted_sum":
        w = weights or [1.0 / len(objectives)] * len(objectives)
        order = [F.desc(sum((F.coalesce(F.col(c), F.lit(0.0)) * x for c, x in zip(objectives[1:], w[1:])), F.coalesce(F.col(objectives[0]), F.lit(0.0)) * w[0]))]
    else:
        raise ValueError(strategy)
    return ranked(df, [*order, F.asc(key)], "place")


def similar_data_score(evals: DataFrame, near: DataFrame) -> DataFrame:
    """(pipeline_id, score): the mean of the scores weighted by 1 / (1 + distance) on the nearest data sets, by 0.1 elsewhere.

    near: (dataset_id, dist) of the k nearest data sets, k rows."""
    w = F.coalesce(1 / (1 + F.col("dist")), F.lit(0.1))
    return evals.join(F.broadcast(near), "dataset_id", "left").groupBy("pipeline_id").agg((F.sum(F.col("score") * w) / F.sum(w)).alias("score"))


def faster(durations: DataFrame, sizes: DataFrame) -> DataFrame:
    """1 / (1 + mean positive duration), else 1 / (1 + number of operators)."""
    m = durations.where("seconds > 0").groupBy("id").agg(F.avg("seconds").alias("s"))
    return sizes.join(m, "id", "left").select("id", (1 / (1 + F.coalesce("s", F.col("n_ops").cast("double"), F.lit(0.0)))).alias("faster"))


def simplicity(n: Column) -> Column:
    """1 up to 3 nodes, 0 from 30, linear between."""
    return F.when(n <= 3, 1.0).when(n >= 30, 0.0).otherwise(1 - (n - 3) / 27)


def parametrisation(params: Column, operators: Column) -> Column:
    """Parameters per operator against 0.3, from 0 to 1."""
    return F.least(F.greatest(params / F.nullif(operators, F.lit(0)) / 0.3, F.lit(0.0)), F.lit(1.0))


def evict(df: DataFrame, budget: int, seconds: str, size: str, redundancy: str, key: str) -> DataFrame:
    """Entries in order of benefit (compute / size * redundancy), least first; evicted until what is left fits the budget.

    The running sum is taken range by range."""
    b = F.col(seconds) / F.greatest(F.col(size), F.lit(1)) * F.greatest(F.col(redundancy), F.lit(1))
    total = df.agg(F.sum(size).alias("_t"))
    out = running(df.withColumn("benefit", b), [], [F.asc("benefit"), F.asc(key)], {"_upto": F.coalesce(F.col(size), F.lit(0))}).crossJoin(F.broadcast(total))  # one row
    return out.withColumn("evicted", F.col("_t") - (F.col("_upto") - F.coalesce(F.col(size), F.lit(0))) > budget).drop("_t", "_upto")


def hedge(df: DataFrame, action: str, reward: str, eta: float) -> DataFrame:
    """Softmax of the log-weights, each the sum of eta * reward."""
    w = df.groupBy(action).agg((eta * F.sum(reward)).alias("log_weight"))
    top = w.agg(F.max("log_weight").alias("_m"))
    e = w.crossJoin(F.broadcast(top)).withColumn("_e", F.exp(F.col("log_weight") - F.col("_m")))  # one row
    total = e.agg(F.sum("_e").alias("_s"))
    return e.crossJoin(F.broadcast(total)).select(action, "log_weight", (F.col("_e") / F.col("_s")).alias("p"))  # one row


def normal_cdf(z: Column) -> Column:
    """By a rational approximation of erf, within 1.5e-7."""
    x = F.abs(z) / float(np.sqrt(2))
    t = 1 / (1 + 0.3275911 * x)
    erf = 1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * F.exp(-x * x)
    return 0.5 * (1 + F.signum(z) * erf)


def expected_improvement(mu: Column, sigma: Column, best: Column) -> Column:
    """(mu - f) * Phi(z) + sigma * phi(z); max(mu - f, 0) where sigma vanishes."""
    z = (mu - best) / sigma
    ei = (mu - best) * normal_cdf(z) + sigma * F.exp(-z * z / 2) / float(np.sqrt(2 * np.pi))
    return F.when(sigma <= 1e-12, F.greatest(mu - best, F.lit(0.0))).otherwise(ei)


def user_objective(df: DataFrame, f: Callable[[dict], float], cols: list[str], name: str = "score") -> DataFrame:
    """A registered Python callable over each candidate, in Arrow batches; an error or a result that isn't a number counts as 0."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def one(r: dict) -> float:
        try:
            v = float(f(r))
            return v if np.isfinite(v) else 0.0
        except Exception:  # noqa: BLE001
            return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([one(r) for r in b.select(cols).to_pylist()], pa.float64())], [*b.schema.names, name])

    return df.mapInArrow(run, schema)


#: The built-in objectives and the tables that each depends on.
OBJECTIVES = {"general_performance": {"evaluations"}, "similar_data": {"evaluations", "datasets"}, "unseen": {"suggestions"}, "preference": {"interactions"}, "faster": {"evaluations", "pipelines"}, "atomic_changes": {"pipelines"}}


def objective_status(present: set[str]) -> dict[str, str]:
    """Active, or degraded where a table is missing."""
    return {k: "active" if v <= present else "degraded" for k, v in OBJECTIVES.items()}
