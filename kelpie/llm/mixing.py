"""Mixing sources to target weights, by entropy balancing.

A document may be taken up to m times (its source's limit). Beforehand each of the m draws takes it with the same small
probability, so that it is taken size_ratio times on average. The rates nearest to that in relative entropy whose expected
tokens meet a source's target are an exponential tilt in the document's length: r(t) = m / (1 + (m - q) / q * exp(-x t / T)), with
one multiplier x for each mix and source. The convex dual is solved by Newton steps (held inside a bracket), whose sums
run over the distributed table of (source, length, documents): all that the rates depend on. Rates are then rounded into
whole copies by each document's hash, with a cut per mix and source below which the tokens taken stay within the target. The
first document beyond the cut may be a long one, so what is missing then is filled up: over the table of (length, copies
left) the longest length that still fits is taken as often as it fits, then the next, down to the shortest. What remains
open is less than the shortest document that has a copy left."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpie.functions.keys import stripped
from kelpie.llm.topn import top_n
from kelpie.sources.tables import durable, small_table


def norm_source(c: Column | str) -> Column:
    """Trimmed, in lower case, `-` as `_`; blank is null."""
    return F.nullif(F.translate(F.lower(stripped(c)), "-", "_"), F.lit(""))


@dataclass
class Goal:
    """One source of one mix. lo and hi bracket the multiplier x."""

    mix: str
    source: str
    share: float
    target: float
    m: int
    q: float
    mean: float
    total: int
    x: float = 0.0
    lo: float = -math.inf
    hi: float = math.inf
    full: bool = False
    done: bool = False


def asked_of(targets: DataFrame, most: int = 100_000) -> list:
    """The usable rows of the targets, which are configuration: more than `most` of them are an error."""
    rows = targets.select("mix_name", F.col("size_ratio").cast("double"), norm_source("source").alias("source"), F.col("weight").cast("double").alias("weight"), F.col("max_repeats").cast("int").alias("m"))
    rows = rows.where((F.col("weight") > 0) & ~F.isnan("weight") & (F.col("weight") < float("inf")) & (F.col("size_ratio") > 0) & (F.col("m") > 0) & F.col("mix_name").isNotNull() & F.col("source").isNotNull())
    rows = rows.groupBy("mix_name", "source").agg(F.max("size_ratio").alias("size_ratio"), F.sum("weight").alias("weight"), F.max("m").alias("m"))
    got = rows.orderBy("mix_name", "source").limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} targets")
    return got


def goals_of(asked: list, totals: dict[str, tuple[int, int]], every: int) -> list[Goal]:
    """The goals of all mixes. totals: tokens and documents of each source."""
    got = [r for r in asked if totals.get(r.source, (0, 0))[0] > 0]
    sums: dict[str, float] = {}
    for r in got:
        sums[r.mix_name] = sums.get(r.mix_name, 0.0) + r.weight
    out = []
    for r in got:
        tokens, docs = totals[r.source]
        share = r.weight / sums[r.mix_name]
        target = share * r.size_ratio * every
        out.append(Goal(r.mix_name, r.source, share, target, r.m, min(r.size_ratio, 0.9 * r.m), tokens / docs, tokens, full=target >= r.m * tokens, done=target >= r.m * tokens))
    return out


def _table(spark, goals: list[Goal]) -> DataFrame:
    """The goals as a table: configuration, checked to be small, so it may be broadcast."""
    rows = [(i, g.mix, g.source, float(g.m), g.q, g.mean, g.x, g.full) for i, g in enumerate(goals)]
    return F.broadcast(small_table(spark, rows, "g int, mix_name string, source string, m double, q double, mean double, x double, full boolean"))


def _rate() -> Column:
    tilt = F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -F.col("x") * F.col("n_tokens") / F.col("mean"))))
    return F.when(F.col("full"), F.col("m")).otherwise(F.col("m") / (1 + (F.col("m") - F.col("q")) / F.col("q") * tilt))


def near_solution(hist: DataFrame, goals: list[Goal]) -> None:
    """Sets each goal's multiplier near its solution: the dual over lengths in classes (four to a doubling, so at most some eighty rows a source
    come to the driver), by bisection. The Newton steps over all lengths start there and need few rounds."""
    live = [g for g in goals if not g.done]
    if not live:
        return
    asked = F.broadcast(small_table(hist.sparkSession, [(x,) for x in {g.source for g in live}], "source string"))
    rows = hist.join(asked, "source", "left_semi").groupBy("source", F.floor(4 * F.log2("n_tokens")).alias("b")).agg(F.sum("docs").alias("n"), F.sum(F.col("docs") * F.col("n_tokens")).alias("t")).collect()
    per: dict[str, list] = {}
    for r in rows:
        per.setdefault(r.source, []).append((r.n, r.t))
    for g in live:
        n, t = np.array(per[g.source], float).T
        size = t / n

        def gap(x: float) -> float:
            return float((t * g.m / (1 + (g.m - g.q) / g.q * np.exp(np.clip(-x * size / g.mean, -700, 700)))).sum()) - g.target

        lo, hi = -4.0, 4.0
        while gap(lo) > 0 and lo > -1e6:
            lo *= 2
        while gap(hi) < 0 and hi < 1e6:
            hi *= 2
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if gap(mid) > 0 else (mid, hi)
        g.x = (lo + hi) / 2


def solve(hist: DataFrame, goals: list[Goal], steps: int = 100, tolerance: float = 1e-7) -> list[Goal]:
    """Newton steps on the dual of every goal at once, from near its solution; one distributed sum a step."""
    near_solution(hist, goals)
    for _ in range(steps):
        if all(g.done for g in goals):
            break
        live = [g for g in goals if not g.done]
        rate, t = _rate(), F.col("n_tokens")
        sums = hist.join(_table(hist.sparkSession, live), "source").groupBy("g").agg(F.sum(F.col("docs") * t * rate).alias("have"), F.sum(F.col("docs") * t * t / F.col("mean") * rate * (1 - rate / F.col("m"))).alias("slope"))
        for r in sums.collect():  # one row per goal
            g = live[r.g]
            gap = r.have - g.target
            if abs(gap) <= tolerance * g.target:
                g.done = True
                continue
            if gap > 0:
                g.hi = g.x
            else:
                g.lo = g.x
            new = g.x - gap / r.slope if r.slope > 0 else math.nan
            if not g.lo < new < g.hi or abs(new - g.x) > 4:  # outside of the bracket, or too far for the slope to tell
                inside = math.isfinite(g.lo) and math.isfinite(g.hi)
                new = (g.lo + g.hi) / 2 if inside else g.x + (-4 if gap > 0 else 4)
            g.done = new == g.x
            g.x = new
    return goals


def _edges(spark, goals: list[Goal], at: list[tuple[float, float, float]]) -> DataFrame:
    """The interval of margins looked at, and the tokens taken below it, of each goal: configuration's size."""
    return F.broadcast(small_table(spark, [(i, g.target, *x) for i, (g, x) in enumerate(zip(goals, at))], "g int, target double, lo double, hi double, below double"))


def _cuts(drawn: DataFrame, goals: list[Goal], wide: int = 1024) -> list[float]:
    """For each goal a cut on the margin below which the tokens taken stay within the target; two passes.

    A pass sums the tokens in `wide` intervals of the margin; the running sum over these, at most `wide` rows a goal, is taken
    where they lie, and one row a goal comes to the driver."""
    spark, at = drawn.sparkSession, [(-1.0, 1.0, math.nan)] * len(goals)
    for _ in range(2):
        step = (F.col("hi") - F.col("lo")) / wide
        rows = drawn.join(_edges(spark, goals, at), "g").withColumn("b", F.floor((F.col("margin") - F.col("lo")) / step).cast("int"))
        inside = F.when((F.col("margin") >= F.col("lo")) & (F.col("margin") < F.col("hi")), F.col("n_tokens"))
        sums = rows.groupBy("g", F.greatest(F.lit(-1), F.least(F.lit(wide), "b")).alias("b")).agg(F.sum(inside).alias("s"), F.sum(F.col("n_tokens") * F.col("whole")).alias("w"), F.first("below").alias("below"), F.first("target").alias("target"))
        goal = Window.partitionBy("g")
        base = F.when(F.isnan("below"), F.sum("w").over(goal)).otherwise(F.col("below"))
        have = base + F.coalesce(F.sum("s").over(goal.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
        sums = sums.select("g", "b", (have <= F.col("target")).alias("fits"), have.cast("double").alias("have"), base.cast("double").alias("base"))
        got = sums.where((F.col("b") >= 0) & (F.col("b") < wide)).groupBy("g").agg(F.min(F.when(~F.col("fits"), F.col("b"))).alias("over"), F.max(F.when(F.col("fits"), F.col("have"))).alias("have"), F.first("base").alias("base"))
        for r in got.collect():  # one row a goal
            lo, hi, _ = at[r.g]
            step = (hi - lo) / wide
            at[r.g] = (hi, hi + step, r.have if r.have is not None else r.base) if r.over is None else (lo + r.over * step, lo + (r.over + 1) * step, r.have if r.have is not None else r.base)
    return [x[0] for x in at]


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by goal and falling length: (g, n_tokens, left, gap). Takes of each length what fits into the rest of the gap."""
    goal, gap = None, 0.0
    for b in batches:
        out = []
        for g, t, left, whole_gap in zip(*(c.to_pylist() for c in b.columns)):
            if g != goal:
                goal, gap = g, whole_gap
            k = min(left, int(gap // t))
            if k > 0:
                gap -= k * t
                out.append((g, t, k))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64()))], ["g", "n_tokens", "k"])


def _filled(taken: DataFrame, goals: list[Goal]) -> DataFrame:
    """`taken` (g, doc_id, n_tokens, m, margin, copies, ..) with further copies that fill up each goal's gap."""
    spark = taken.sparkSession
    target = F.broadcast(small_table(spark, [(i, g.target) for i, g in enumerate(goals) if not g.full] or [(-1, 0.0)], "g int, target double"))
    lengths = taken.groupBy("g", "n_tokens").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("have"), F.sum(F.col("m") - F.col("copies")).cast("bigint").alias("left"))
    lengths = lengths.join(target, "g").withColumn("gap", F.col("target") - F.sum("have").over(Window.partitionBy("g")))
    line = lengths.where((F.col("left") > 0) & (F.col("n_tokens") <= F.col("gap"))).select("g", "n_tokens", "left", "gap").repartition("g").sortWithinPartitions("g", F.desc("n_tokens"))
    # Distinct lengths whose sum is within a gap: fewer than the root of twice the gap, which the longest document bounds.
    picks = [tuple(r) for r in line.mapInArrow(_fill, "g int, n_tokens bigint, k bigint").collect()]
    if not picks:
        return taken
    want = F.broadcast(small_table(spark, picks, "g int, n_tokens bigint, k bigint"))
    spare = taken.where(F.col("copies") < F.col("m")).join(want, ["g", "n_tokens"]).select("g", "n_tokens", "doc_id", "margin", "k", (F.col("m") - F.col("copies")).cast("bigint").alias("spare"))
    first = top_n(spare, ["g", "n_tokens"], [F.asc("margin"), F.asc("doc_id")], max(k for _, _, k in picks)).where(F.col("rnk") <= F.col("k"))
    before = F.coalesce(F.sum("spare").over(Window.partitionBy("g", "n_tokens").orderBy("rnk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over at most k rows
    more = first.withColumn("before", before).where(F.col("before") < F.col("k")).select("g", "n_tokens", "doc_id", F.least("spare", F.col("k") - F.col("before")).cast("int").alias("more"))
    if sum(k for _, _, k in picks) <= 200_000:  # the most rows it can have
        more = F.broadcast(more)
    return taken.join(more, ["g", "n_tokens", "doc_id"], "left").withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0))).drop("more")


_SELECTION = "mix_name string, doc_id {}, source string, n_tokens bigint, copies int"
_SHARES = "mix_name string, source string, target_share double, target_tokens double, tokens bigint, share double, documents bigint, copies bigint, full boolean, gap double"


def mix(docs: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(selection, shares). docs: doc_id, source, n_tokens, one row per document. targets: mix_name, size_ratio, source, weight, max_repeats.

    selection: (mix_name, doc_id, source, n_tokens, copies), copies from 1 to max_repeats.
    shares: (mix_name, source, target_share, target_tokens, tokens, share, documents, copies, full, gap): what was reached, for
    every source of a mix that takes part; full: the source was too small, and each of its documents is taken max_repeats
    times; gap: target_tokens less tokens. Unless full, it is not negative and less than the shortest document of the source
    that could be taken once more.
    Sources compare trimmed, in any case, `-` as `_`. Target rows without a usable weight, ratio or limit, and those of
    sources without tokens, take no share; rows of one mix and source are one (weights added, the higher limit).
    Documents without a source or without tokens are never taken, but their tokens count in the total. Rows that repeat a
    doc_id are taken alike, each up to max_repeats times. Extra columns are ignored; without documents or targets both
    results are empty."""
    spark = docs.sparkSession
    docs = durable(docs.select("doc_id", norm_source("source").alias("source"), F.col("n_tokens").cast("bigint").alias("n_tokens")))
    hist = durable(docs.where((F.col("n_tokens") > 0) & F.col("source").isNotNull()).groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("docs")))
    every = docs.agg(F.sum("n_tokens")).first()[0] or 0
    asked = asked_of(targets)
    sums = hist.join(F.broadcast(small_table(spark, [(x,) for x in {r.source for r in asked}], "source string")), "source", "left_semi").groupBy("source").agg(F.sum(F.col("docs") * F.col("n_tokens")).alias("t"), F.sum("docs").alias("n")).collect()  # at most one row per source asked for
    goals = solve(hist, goals_of(asked, {r.source: (r.t, r.n) for r in sums}, every))
    if not goals:
        return small_table(spark, [], _SELECTION.format(dict(docs.dtypes)["doc_id"])), small_table(spark, [], _SHARES)
    rate = docs.where(F.col("n_tokens") > 0).join(_table(spark, goals), "source").withColumn("rate", _rate())
    whole = F.least(F.floor("rate"), F.col("m")).cast("int")
    chance = F.pmod(F.xxhash64("g", "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    drawn = rate.select("g", "mix_name", "doc_id", "source", "n_tokens", "full", F.col("m").cast("int").alias("m"), whole.alias("whole"), (chance - (F.col("rate") - F.floor("rate"))).alias("margin"))
    cut = _cuts(drawn.where(~F.col("full")), goals)
    edge = F.broadcast(small_table(spark, [(i, -2.0 if g.full else cut[i]) for i, g in enumerate(goals)], "g int, cut double"))
    copies = F.least(F.col("whole") + (F.col("margin") < F.col("cut")).cast("int"), F.col("m"))
    taken = drawn.join(edge, "g").select("g", "mix_name", "doc_id", "source", "n_tokens", "m", "margin", copies.alias("copies"))
    selection = _filled(taken, goals).where("copies > 0").select("mix_name", "doc_id", "source", "n_tokens", "copies")
    table = F.broadcast(small_table(spark, [(g.mix, g.source, g.share, g.target, g.full) for g in goals], "mix_name string, source string, target_share double, target_tokens double, full boolean"))
    took = selection.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.sum("copies").alias("copies"))
    whole_mix = took.groupBy("mix_name").agg(F.sum("tokens").alias("all_tokens"))
    shares = table.join(took, ["mix_name", "source"], "left").join(whole_mix, "mix_name", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return selection, shares.select("mix_name", "source", "target_share", "target_tokens", zero("tokens"), F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("share"), zero("documents"), zero("copies"), "full", (F.col("target_tokens") - F.coalesce("tokens", F.lit(0))).alias("gap"))
