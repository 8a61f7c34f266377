"""Streaming queries (Z, S09, S10), each run over the events as a stream and stated in SQL as its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.operators.relational import ranked
from kelpie.sources.tables import load
from kelpie.streaming import ops

Q, SQL = {}, {}
_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _events(s, d) -> DataFrame:
    return ops.source(s, f"{d}/events.parquet", _SCHEMA, "ts", "30 days")


def _naive(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


@query("S09_stream_source", "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY 1")
def s09(s, d):
    return ops.result(ops.source(s, f"{d}/events.parquet", _SCHEMA)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))


@query("S10_stream_sink", "SELECT event_id, value FROM events WHERE value > 20")
def s10(s, d):
    return ops.result(ops.source(s, f"{d}/events.parquet", _SCHEMA).where("value > 20").select("event_id", "value"))


@query("Z01_two_lanes", "SELECT CASE WHEN event_type IN ('view', 'click') THEN 'background' ELSE 'user' END AS lane, count(*) AS n FROM events GROUP BY 1")
def z01(s, d):
    user, low = ops.lanes(ops.source(s, f"{d}/events.parquet", _SCHEMA), ["view", "click"])
    n = lambda x, name: ops.result(x.select("event_id")).agg(F.lit(name).alias("lane"), F.count(F.lit(1)).alias("n"))
    return n(user, "user").unionByName(n(low, "background"))


@query("Z02_suppressed", "SELECT event_id FROM events WHERE NOT (event_type IN ('view') AND user_id % 2 = 0)")
def z02(s, d):
    return ops.result(ops.suppress(ops.source(s, f"{d}/events.parquet", _SCHEMA), ["view"], F.col("user_id") % 2 == 0).select("event_id"))


_DAYS = "t AS (SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL)"


@query("Z03_tumbling_zero_filled", f"WITH {_DAYS}, g AS (SELECT unnest(generate_series(min(start), max(start), INTERVAL 1 DAY)) AS start FROM t) SELECT g.start, k.event_type, coalesce(t.n, 0) AS n FROM g CROSS JOIN (SELECT DISTINCT event_type FROM t) k LEFT JOIN t ON t.start = g.start AND t.event_type = k.event_type")
def z03(s, d):
    got = ops.result(ops.throughput(_events(s, d), "ts", "1 day", "event_type"), ["start", "event_type"], "update")
    return _naive(ops.zero_fill(got, "event_type", "1 day"), "start")


@query("Z04_tumbling_metrics", "SELECT date_trunc('day', ts) AS start, round(avg(value), 6) AS mean, arg_max(value, (ts, event_id)) AS last, max(value) AS most FROM events GROUP BY 1")
def z04(s, d):
    got = ops.result(ops.host_metrics(_events(s, d), "ts", "1 day", "value", "event_id"), ["start"], "update")
    return _naive(got, "start").withColumn("mean", F.round("mean", 6))


@query("Z05_incremental_ingest", "SELECT count(*) AS n, max(ts) AS mark FROM events")
def z05(s, d):
    """The stream's own offsets are the high-water mark; what has been taken in once isn't taken in again."""
    return ops.result(ops.source(s, f"{d}/events.parquet", _SCHEMA)).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("mark"))


@query("Z06_deduplicated", "SELECT count(*) AS n FROM events")
def z06(s, d):
    """Every event delivered twice, locally and from afar."""
    e = _events(s, d).select("event_id", "ts")
    return ops.result(ops.deduplicate(e.select("event_id", "ts", F.explode(F.array(F.lit("local"), F.lit("remote"))).alias("via")), "event_id").select("event_id")).agg(F.count(F.lit(1)).alias("n"))


@query("Z07_dead_letters", "SELECT CASE WHEN value >= 5 THEN 'done' ELSE 'dead' END AS outcome, count(*) AS n FROM events GROUP BY 1")
def z07(s, d):
    good, dead = ops.with_dead_letters(ops.source(s, f"{d}/events.parquet", _SCHEMA).select("event_id", "value"), lambda b: b, F.col("value") >= 5)
    n = lambda p, name: s.read.parquet(p).agg(F.lit(name).alias("outcome"), F.count(F.lit(1)).alias("n"))
    return n(good, "done").unionByName(n(dead, "dead"))


@query("Z08_event_order", "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS seq FROM events")
def z08(s, d):
    """Within a batch events are handled in order of time and number, per user."""
    got = ops.result(ops.source(s, f"{d}/events.parquet", _SCHEMA).select("event_id", "ts", "user_id"))
    return ranked(got, [F.asc("ts"), F.asc("event_id")], "seq", ["user_id"]).select("event_id", "seq")


@query("Z11_rate_limit", "WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_ms(ts) AS ms FROM events), x AS MATERIALIZED (SELECT *, min(ms) OVER (PARTITION BY user_id ORDER BY ms RANGE BETWEEN 3600000 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM e), s AS MATERIALIZED (SELECT DISTINCT user_id, ms, nxt FROM x), w AS (SELECT user_id, min(ms) AS a FROM s GROUP BY 1 UNION ALL SELECT s.user_id, s.nxt FROM w JOIN s ON s.user_id = w.user_id AND s.ms = w.a WHERE s.nxt IS NOT NULL), p AS (SELECT x.user_id, event_id, x.ms, max(a) AS a FROM x JOIN w ON w.user_id = x.user_id AND w.a <= x.ms GROUP BY ALL) SELECT user_id AS key, event_id AS id, row_number() OVER (PARTITION BY user_id, a ORDER BY ms, event_id) <= 2 AS allowed FROM p")
def z11(s, d):
    """Two events an hour for each user, the hour beginning with the first."""
    return ops.result(ops.rate_limit(_events(s, d).select("event_id", "ts", "user_id"), "user_id", "ts", "event_id", 2, 3600))


@query("Z13_node_states", "SELECT user_id AS key, CASE WHEN min(CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END) = 0 THEN 'running' ELSE 'pending' END AS state FROM events GROUP BY 1")
def z13(s, d):
    """A purchase starts a user's node; nothing else moves it."""
    e = ops.source(s, f"{d}/events.parquet", _SCHEMA).select("user_id", "ts", F.when(F.col("event_type") == "purchase", "running").otherwise("pending").alias("status"))
    return ops.result(ops.node_states(e, "user_id", "ts", "status"), ["key"], "update").select("key", "state")


@query("Z14_shadow_compare", "SELECT event_id, 'differs' AS verdict FROM events WHERE value > 60 AND event_id % 50 <> 0 UNION ALL SELECT event_id, 'only_left' FROM events WHERE event_id % 50 = 0")
def z14(s, d):
    a = load(s, d, "events").select("event_id", "value")
    b = a.where("event_id % 50 <> 0").withColumn("value", F.when(F.col("value") > 60, F.col("value") + 1).otherwise(F.col("value")))
    return ops.shadow(a, b, ["event_id"])


@query("Z15_hysteresis", "WITH q AS (SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS depth FROM events GROUP BY ALL), b AS (SELECT CAST(ceil(avg(depth)) AS BIGINT) AS hi FROM q) SELECT event_type, day, depth, coalesce(last_value(CASE WHEN depth >= hi + 5 THEN true WHEN depth <= hi - 5 THEN false END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY day), false) AS paused FROM q, b")
def z15(s, d):
    """Daily events of a type as the depth of its queue, paused above and resumed below the mean by five."""
    q = load(s, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("depth"))
    hi = q.agg(F.ceil(F.avg("depth"))).first()[0] or 0
    return ops.paused(q, ["event_type"], ["day"], "depth", hi + 5, hi - 5)


@query("Z01_drop_oldest", "SELECT event_id FROM events WHERE event_type IN ('view', 'click') ORDER BY ts DESC, event_id DESC LIMIT 300")
def z01b(s, d):
    """The background lane holds 300 events; it is fed in three batches."""
    e = load(s, d, "events")
    folder = ops.in_parts([e.where(F.col("event_id") % 3 == i) for i in range(3)])
    _, low = ops.lanes(ops.source(s, folder, _SCHEMA, per_trigger=1), ["view", "click"])
    return s.read.parquet(ops.drop_oldest(low.select("event_id", "ts"), ["ts", "event_id"], 300)).select("event_id")


@query("Z09_worker_pools", "WITH w AS (SELECT event_type, CAST(least(8, greatest(1, ceil(count(*) / 700.0))) AS INTEGER) AS workers FROM events GROUP BY 1) SELECT event_type, workers, CAST(event_id % workers AS INTEGER) AS worker, count(*) AS n FROM events JOIN w USING (event_type) GROUP BY ALL")
def z09(s, d):
    return ops.pools(load(s, d, "events"), "event_type", "event_id", 700).groupBy("event_type", "workers", "worker").agg(F.count(F.lit(1)).alias("n"))


@query("Z10_retention", "WITH l AS (SELECT user_id, max(ts) AS t FROM events GROUP BY 1) SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM l WHERE t >= (SELECT max(t) FROM l) - INTERVAL 1 DAY)")
def z10(s, d):
    """Users idle for over a day before the newest event are let go."""
    return ops.retained(load(s, d, "events"), "user_id", "ts", "1 DAY").select("event_id")


@query("Z12_late_data", "WITH m AS (SELECT date_trunc('day', max(ts)) AS t, date_trunc('day', min(ts)) AS f FROM events) SELECT date_trunc('day', ts) AS start, count(*) + CASE WHEN date_trunc('day', ts) = any_value(m.t) THEN count(*) ELSE 0 END AS n FROM events, m GROUP BY 1")
def z12(s, d):
    """Three batches: all events; those of the last day again, in time; those of the first day again, behind the watermark of a day, which are dropped."""
    e = load(s, d, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    day = F.date_trunc("day", "ts")
    first, last = e.agg(F.min(day), F.max(day)).first()
    folder = ops.in_parts([e, e.where(day == F.lit(last)), e.where(day == F.lit(first))])
    w = ops.source(s, folder, _SCHEMA, "ts", "1 day", per_trigger=1).groupBy(F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")
    return _naive(ops.result(w, ["start"], "update"), "start")


QUERIES = Q
