"""Queries over joins, aggregations, windows, ordering and sets (J, A, W, T, U)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpie.functions.keys import norm_id, norm_metric, usable
from kelpie.operators import relational as r
from kelpie.operators.quality import quantiles
from kelpie.sources.tables import durable, load

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# The store's tables, with ids in normal form and repeated rows as one. The SQL states the same.


def evals(s: SparkSession, d: str, once: bool = True) -> DataFrame:
    """once: rows of the same id as one; not needed where only distinct values count."""
    e = load(s, d, "evaluations").select("id", norm_id("pipeline_id").alias("pipeline_id"), norm_id("dataset_id").alias("dataset_id"), "run_id", norm_metric("metric_name").alias("metric"), "metric_value", "source", "status", "wall_clock_s", "error_message", "created_at")
    return e.dropDuplicates(["id"]) if once else e


def pipes(s: SparkSession, d: str) -> DataFrame:
    p = load(s, d, "pipelines").select(norm_id("id").alias("id"), F.lower(F.trim("task")).alias("task"), "provenance", "source", "created_at", F.size("operators").alias("n_ops"))
    return r.latest_by(p, ["id"], [F.desc_nulls_last("created_at"), F.desc_nulls_last("n_ops"), F.desc_nulls_last("task"), F.desc_nulls_last("provenance"), F.desc_nulls_last("source")])


def sets(s: SparkSession, d: str) -> DataFrame:
    p = load(s, d, "datasets").select(norm_id("id").alias("id"), "name", "owner_id", "is_public", "data_type", "item_count", "created_at", "updated_at")
    return r.latest_by(p, ["id"], [F.desc_nulls_last("updated_at"), F.desc_nulls_last("name"), F.desc_nulls_last("owner_id"), F.desc_nulls_last("data_type"), F.desc_nulls_last("item_count")])


def inter(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "interactions").dropDuplicates(["id"])


EV = """ev AS (SELECT DISTINCT id, nullif(lower(trim(pipeline_id)), '') AS pipeline_id, nullif(lower(trim(dataset_id)), '') AS dataset_id, run_id,
  nullif(replace(replace(lower(trim(metric_name)), '-', '_'), ' ', '_'), '') AS metric, metric_value, source, status, wall_clock_s, error_message, created_at FROM evaluations)"""
PI = """pi AS (SELECT lower(trim(id)) AS id, lower(trim(task)) AS task, provenance, source, created_at, len(operators) AS n_ops FROM pipelines
  QUALIFY row_number() OVER (PARTITION BY lower(trim(id)) ORDER BY created_at DESC NULLS LAST, len(operators) DESC NULLS LAST, lower(trim(task)) DESC NULLS LAST, provenance DESC NULLS LAST, source DESC NULLS LAST) = 1)"""
DS = """ds AS (SELECT lower(trim(id)) AS id, name, owner_id, is_public, data_type, item_count, created_at, updated_at FROM datasets
  QUALIFY row_number() OVER (PARTITION BY lower(trim(id)) ORDER BY updated_at DESC NULLS LAST, name DESC NULLS LAST, owner_id DESC NULLS LAST, data_type DESC NULLS LAST, item_count DESC NULLS LAST) = 1)"""
IA = "ia AS (SELECT DISTINCT * FROM interactions)"
OKV = "metric_value IS NOT NULL AND isfinite(metric_value)"


def scored(s, d) -> DataFrame:
    return evals(s, d).where((F.col("metric") == "accuracy") & (F.col("status") == "success") & usable("metric_value"))


@query("J01_leaderboard", f"WITH {EV}, {PI} SELECT DISTINCT e.dataset_id, e.pipeline_id, p.task, e.metric_value AS score FROM ev e JOIN pi p ON e.pipeline_id = p.id WHERE e.metric = 'accuracy' AND e.status = 'success' AND {OKV} AND e.dataset_id IS NOT NULL")
def j01(s, d):
    e = scored(s, d).where("dataset_id is not null").select("dataset_id", "pipeline_id", F.col("metric_value").alias("score"))
    return e.join(pipes(s, d), F.col("pipeline_id") == F.col("id")).select("dataset_id", "pipeline_id", "task", "score").distinct()


_WINS = f"WITH {IA}, x AS (SELECT DISTINCT id, %s unnest([compared_id, preferred_id]) AS pipeline_id, preferred_id FROM ia) SELECT pipeline_id, %s count(*) FILTER (preferred_id = pipeline_id) AS wins, count(*) AS compared, count(*) FILTER (preferred_id = pipeline_id) / count(*) AS win_rate FROM x WHERE pipeline_id IS NOT NULL GROUP BY ALL"


@query("J02_or_join_wins", _WINS % ("", ""))
def j02(s, d):
    return r.win_rates(inter(s, d))


@query("J03_left_join_trial_counts", f"WITH {EV}, {DS}, {PI}, n AS (SELECT dataset_id, pipeline_id, count(DISTINCT run_id) AS runs FROM ev GROUP BY ALL), t AS (SELECT id AS dataset_id, owner_id FROM ds) SELECT t.dataset_id, t.owner_id, coalesce(count(n.pipeline_id), 0) AS pipelines, CAST(coalesce(sum(n.runs), 0) AS BIGINT) AS trials FROM t LEFT JOIN n ON t.dataset_id = n.dataset_id GROUP BY ALL")
def j03(s, d):
    n = evals(s, d).groupBy("dataset_id", "pipeline_id").agg(F.count_distinct("run_id").alias("runs")).groupBy("dataset_id").agg(F.count("pipeline_id").alias("pipelines"), F.sum("runs").alias("trials"))
    out = sets(s, d).select(F.col("id").alias("dataset_id"), "owner_id").join(n, "dataset_id", "left")
    return out.select("dataset_id", "owner_id", F.coalesce("pipelines", F.lit(0)).alias("pipelines"), F.coalesce("trials", F.lit(0)).alias("trials"))


@query("J04_cross_join", "SELECT r_name, n_name FROM region, nation")
def j04(s, d):
    """Two dimensions of fixed size; pairs of growing tables are counted instead (A05) or read off a bounded queue."""
    return load(s, d, "region").select("r_name").crossJoin(F.broadcast(load(s, d, "nation").select("n_name")))


def _done(s, d):
    """Distinct (pipeline_id, dataset_id) that were evaluated, of data sets that exist."""
    e = evals(s, d).select("pipeline_id", "dataset_id").dropna().distinct()
    return e.join(sets(s, d).select(F.col("id").alias("dataset_id")), "dataset_id", "left_semi")


_OPEN = f"WITH {EV}, {PI}, {DS} SELECT pi.id AS pipeline_id, ds.id AS dataset_id FROM pi, ds WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.pipeline_id = pi.id AND ev.dataset_id = ds.id)"


@query("J05_anti_unevaluated_pairs", _OPEN)
def j05(s, d):
    """All pairs: a block of about 64 data sets meets the pipelines one after the other, each less what it evaluated of the block.

    Pairs are never shuffled. Tables are cut so that a task has 16 million pairs at most, of about as many pipelines as data
    sets: its file then holds few distinct ids, one column in long runs, the other repeating within a page. The counts are
    those of the stored rows; they only move the work."""
    n_p, n_q = load(s, d, "pipelines").count(), load(s, d, "datasets").count()
    most = min(16e6, max(1e6, n_p * n_q / (4 * s.sparkContext.defaultParallelism)))
    n_left = math.ceil(n_q / most**0.5) or 1
    n_right = math.ceil(n_p * n_q / n_left / most) or 1
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(n_q // 64 + 1)).cast("int").alias("block")
    done = evals(s, d, once=False).select("pipeline_id", "dataset_id").dropna().distinct().repartition("pipeline_id")
    done = done.groupBy("pipeline_id", block("dataset_id")).agg(F.collect_list("dataset_id").alias("ids"))
    done = done.groupBy(F.col("pipeline_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("block", "ids"))).alias("done"))
    p = pipes(s, d).select("id").join(done, "id", "left").select(F.col("id").alias("pipeline_id"), "done").repartition(n_right, "pipeline_id")
    blocks = sets(s, d).select("id").groupBy(block("id")).agg(F.collect_list("id").alias("ids"), F.count_if(F.col("id").isNull()).alias("nulls"))
    ids = F.concat("ids", F.array_repeat(F.lit(None).cast("string"), F.col("nulls").cast("int")))
    pairs = blocks.select("block", ids.alias("ids")).repartitionById(n_left, F.pmod("block", F.lit(n_left))).hint("shuffle_replicate_nl").crossJoin(p)
    left = F.array_except("ids", F.try_element_at("done", "block"))  # null where nothing of the block was evaluated
    return pairs.select("pipeline_id", F.explode(F.coalesce(left, "ids")).alias("dataset_id"))


@query("J06_conditional_anti_retry", f"WITH {EV}, f AS (SELECT DISTINCT pipeline_id, dataset_id, error_message FROM ev WHERE status <> 'success'), pat AS (SELECT error_message, count(*) >= 3 AS active FROM ev WHERE error_message IS NOT NULL GROUP BY 1), blocked AS (SELECT f.pipeline_id, f.dataset_id FROM f LEFT JOIN pat USING (error_message) WHERE f.error_message IS NULL OR pat.active IS NOT FALSE) SELECT DISTINCT e.pipeline_id, e.dataset_id FROM ev e WHERE e.pipeline_id IS NOT NULL AND e.dataset_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM blocked b WHERE b.pipeline_id = e.pipeline_id AND b.dataset_id = e.dataset_id)")
def j06(s, d):
    """Pairs that may be tried (again): a failure blocks its pair unless its pattern is known and inactive."""
    e = evals(s, d)
    pat = e.where("error_message is not null").groupBy("error_message").agg((F.count(F.lit(1)) >= 3).alias("active"))
    fails = e.where(F.col("status") != "success").select("pipeline_id", "dataset_id", "error_message").distinct()
    blocked = fails.join(pat, "error_message", "left").where(F.col("error_message").isNull() | F.coalesce("active", F.lit(True))).select("pipeline_id", "dataset_id")
    return e.select("pipeline_id", "dataset_id").dropna().distinct().join(blocked, ["pipeline_id", "dataset_id"], "left_anti")


@query("J07_semi_or_gate", f"WITH {EV}, {PI} SELECT id, provenance FROM pi WHERE provenance = 'user' OR id IN (SELECT DISTINCT pipeline_id FROM ev WHERE status = 'success' AND pipeline_id IS NOT NULL)")
def j07(s, d):
    ok = evals(s, d).where("status = 'success' and pipeline_id is not null").select(F.col("pipeline_id").alias("id"))
    return r.or_flag(pipes(s, d), ok, "id", "ran").where(F.col("ran") | (F.col("provenance") == "user")).select("id", "provenance")


@query("J08_both_keys_exist", f"WITH {EV}, {PI}, {DS} SELECT e.id FROM ev e WHERE EXISTS (SELECT 1 FROM pi WHERE pi.id = e.pipeline_id) AND EXISTS (SELECT 1 FROM ds WHERE ds.id = e.dataset_id)")
def j08(s, d):
    e = evals(s, d).select("id", "pipeline_id", "dataset_id")
    return e.join(pipes(s, d).select(F.col("id").alias("pipeline_id")), "pipeline_id", "left_semi").join(sets(s, d).select(F.col("id").alias("dataset_id")), "dataset_id", "left_semi").select("id")


@query("J09_semi_any", f"WITH {EV}, {DS} SELECT id, dataset_id, metric FROM ev WHERE dataset_id = ANY (SELECT id FROM ds WHERE data_type = 'parquet')")
def j09(s, d):
    return evals(s, d).join(sets(s, d).where("data_type = 'parquet'").select(F.col("id").alias("dataset_id")), "dataset_id", "left_semi").select("id", "dataset_id", "metric")


_IDS = [30, 7, 7, 199, 100000000, 1]


@query("J10_lookup_by_id_list", f"SELECT CAST(i - 1 AS INTEGER) AS pos, p_partkey, p_name FROM (SELECT generate_subscripts({_IDS}, 1) AS i, unnest({_IDS}) AS k) JOIN part ON p_partkey = k")
def j10(s, d):
    return r.by_id_list(load(s, d, "part"), "p_partkey", _IDS).select("pos", "p_partkey", "p_name").orderBy("pos")


@query("J11_first_metric_per_run", f"WITH {EV}, b AS (SELECT run_id, metric, metric_value, id FROM ev WHERE metric NOT IN ('__none__', '__failed__') AND {OKV} QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY metric, id) = 1) SELECT run_id, metric, metric_value FROM b")
def j11(s, d):
    e = evals(s, d).where(~F.col("metric").isin("__none__", "__failed__") & usable("metric_value"))
    return e.groupBy("run_id").agg(F.min(F.struct("metric", "id", "metric_value")).alias("b")).select("run_id", "b.metric", "b.metric_value")


@query("J13_broadcast_lookup", "SELECT c.c_custkey, n.n_name, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey")
def j13(s, d):
    n = load(s, d, "nation").join(load(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return load(s, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query("J14_self_anti_alternatives", "WITH t AS (SELECT DISTINCT p_type, p_brand FROM part), risky AS (SELECT DISTINCT p_type, p_brand FROM part WHERE p_size > 45) SELECT a.p_type, a.p_brand, b.p_brand AS alternative FROM t a JOIN t b ON a.p_type = b.p_type AND a.p_brand <> b.p_brand WHERE EXISTS (SELECT 1 FROM risky r WHERE r.p_type = a.p_type AND r.p_brand = a.p_brand) AND NOT EXISTS (SELECT 1 FROM risky r WHERE r.p_type = b.p_type AND r.p_brand = b.p_brand)")
def j14(s, d):
    """Brands of one type stand for operators of one task; a part over size 45 for a risk."""
    p = load(s, d, "part")
    t, risky = p.select("p_type", "p_brand").distinct(), p.where("p_size > 45").select("p_type", "p_brand").distinct()
    bad, good = t.join(risky, ["p_type", "p_brand"], "left_semi"), t.join(risky, ["p_type", "p_brand"], "left_anti")
    return bad.join(good.withColumnRenamed("p_brand", "alternative"), "p_type").select("p_type", "p_brand", "alternative")


@query("J15_outer_histograms", "WITH a AS (SELECT l_quantity AS v, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' GROUP BY 1), b AS (SELECT l_quantity + 5 AS v, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) SELECT coalesce(a.v, b.v) AS v, coalesce(a.n, 0) AS n_train, coalesce(b.n, 0) AS n_test FROM a FULL JOIN b ON a.v = b.v")
def j15(s, d):
    li = load(s, d, "lineitem")
    a = li.where("l_returnflag = 'R' and l_linestatus = 'F'").groupBy(F.col("l_quantity").alias("v")).agg(F.count(F.lit(1)).alias("a"))
    b = li.where("l_returnflag = 'N'").groupBy((F.col("l_quantity") + 5).alias("v")).agg(F.count(F.lit(1)).alias("b"))
    return a.join(b, "v", "full_outer").select("v", F.coalesce("a", F.lit(0)).alias("n_train"), F.coalesce("b", F.lit(0)).alias("n_test"))


@query("J16_three_way_join", "SELECT c.c_custkey, o.o_orderkey, count(*) AS n, round(sum(l.l_extendedprice), 2) AS total FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE l.l_discount > 0 GROUP BY 1, 2")
def j16(s, d):
    c, o, li = load(s, d, "customer"), load(s, d, "orders"), load(s, d, "lineitem")
    li = li.where("l_discount > 0").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey", "n", "total")


@query("A01_filtered_count", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS n_high FROM events GROUP BY 1")
def a01(s, d):
    return load(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("n_high"))


@query("A02_win_rate", f"WITH {IA}, {PI}, x AS (SELECT DISTINCT id, unnest([compared_id, preferred_id]) AS k, preferred_id FROM ia), w AS (SELECT k, count(*) FILTER (preferred_id = k) / count(*) AS win_rate FROM x WHERE k IS NOT NULL GROUP BY k) SELECT pi.id AS pipeline_id, coalesce(w.win_rate, 0.0) AS win_rate FROM pi LEFT JOIN w ON pi.id = w.k")
def a02(s, d):
    w = r.win_rates(inter(s, d)).select("pipeline_id", "win_rate")
    return pipes(s, d).select(F.col("id").alias("pipeline_id")).join(w, "pipeline_id", "left").select("pipeline_id", F.coalesce("win_rate", F.lit(0.0)).alias("win_rate"))


@query("A03_win_rate_by_dataset", _WINS % ("dataset_id,", "dataset_id,"))
def a03(s, d):
    return r.win_rates(inter(s, d), ["dataset_id"])


@query("A04_count_distinct_pairs", f"WITH {EV} SELECT count(DISTINCT (pipeline_id, dataset_id)) AS n_pairs FROM ev WHERE pipeline_id IS NOT NULL AND dataset_id IS NOT NULL")
def a04(s, d):
    return evals(s, d).dropna(subset=["pipeline_id", "dataset_id"]).agg(F.count_distinct(F.struct("pipeline_id", "dataset_id")).alias("n_pairs"))


@query("A05_pending_pairs", f"WITH {EV}, {PI}, {DS}, done AS (SELECT count(DISTINCT (e.pipeline_id, e.dataset_id)) AS n FROM ev e JOIN pi ON pi.id = e.pipeline_id JOIN ds ON ds.id = e.dataset_id) SELECT greatest((SELECT count(*) FROM pi) * (SELECT count(*) FROM ds) - n, 0) AS pending FROM done")
def a05(s, d):
    p, q = pipes(s, d).select(F.col("id").alias("pipeline_id")), sets(s, d).select(F.col("id").alias("dataset_id"))
    done = evals(s, d).select("pipeline_id", "dataset_id").distinct().join(p, "pipeline_id", "left_semi").join(q, "dataset_id", "left_semi").agg(F.count(F.lit(1)).alias("n"))
    one = done.crossJoin(p.agg(F.count(F.lit(1)).alias("a"))).crossJoin(q.agg(F.count(F.lit(1)).alias("b")))  # one row each
    return one.select(r.pending_pairs(F.col("a"), F.col("b"), F.col("n")).alias("pending"))


@query("A06_distinct", "SELECT DISTINCT source FROM evaluations")
def a06(s, d):
    return load(s, d, "evaluations").select("source").distinct()


@query("A07_metric_availability", f"WITH {EV} SELECT metric, count(*) AS n FROM ev WHERE {OKV} GROUP BY 1 ORDER BY n DESC, metric")
def a07(s, d):
    return evals(s, d).where(usable("metric_value")).groupBy("metric").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "metric")


@query("A08_two_level_group", f"WITH {EV}, runs AS (SELECT pipeline_id, dataset_id, run_id, count(*) AS n_rows FROM ev GROUP BY ALL) SELECT pipeline_id, dataset_id, count(*) AS trials, max(n_rows) AS most_rows FROM runs GROUP BY ALL")
def a08(s, d):
    runs = evals(s, d).groupBy("pipeline_id", "dataset_id", "run_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return runs.groupBy("pipeline_id", "dataset_id").agg(F.count(F.lit(1)).alias("trials"), F.max("n_rows").alias("most_rows"))


@query("A09_watermark", f"WITH {EV} SELECT source, max(created_at) AS mark FROM ev GROUP BY 1")
def a09(s, d):
    return evals(s, d).groupBy("source").agg(F.max("created_at").alias("mark"))


@query("A10_handler_stats", "SELECT user_id AS handler, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, max(value) AS most, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'error') / count(*) AS error_rate, list(event_id ORDER BY ts, event_id) FILTER (event_type = 'error')[-5:] AS last_errors FROM events GROUP BY 1")
def a10(s, d):
    """The five latest errors are cut by a window before they are gathered, so no group's errors are held together."""
    ev = load(s, d, "events")
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    last = ev.where("event_type = 'error'").select("user_id", "ts", "event_id").withColumn("rn", F.row_number().over(w)).where("rn <= 5")
    last = last.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda x: x["event_id"]).alias("last_errors"))
    err = F.count_if(F.col("event_type") == "error")
    agg = ev.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 4).alias("mean"), F.max("value").alias("most"), err.alias("errors"), (err / F.count(F.lit(1))).alias("error_rate"))
    return agg.join(last, "user_id", "left").withColumnRenamed("user_id", "handler")


@query("A11_error_summary", f"WITH {EV} SELECT source AS handler, count(*) AS total, count(*) FILTER (status <> 'success') AS errors, count(DISTINCT regexp_extract(error_message, '^\\w+')) FILTER (error_message IS NOT NULL) AS kinds FROM ev GROUP BY 1")
def a11(s, d):
    kind = F.when(F.col("error_message").isNotNull(), F.regexp_extract("error_message", r"^\w+", 0))
    return evals(s, d).groupBy(F.col("source").alias("handler")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") != "success").alias("errors"), F.count_distinct(kind).alias("kinds"))


@query("A12_duration_stats", f"WITH {EV}, s AS (SELECT list(wall_clock_s ORDER BY wall_clock_s) AS v, count(*) AS n, avg(wall_clock_s) AS mean FROM ev WHERE wall_clock_s > 0) SELECT n, v[least(n * 50 // 100, n - 1) + 1] AS median, v[least(n * 75 // 100, n - 1) + 1] AS p75, v[least(n * 95 // 100, n - 1) + 1] AS p95, v[1] AS min, v[n] AS max, round(mean, 6) AS mean FROM s")
def a12(s, d):
    return r.duration_stats(evals(s, d), "wall_clock_s").withColumn("mean", F.round("mean", 6))


@query("A13_interpolated_median", f"WITH {EV}, m AS (SELECT max(created_at) AS t FROM ev) SELECT coalesce(quantile_cont(wall_clock_s, 0.5), 30.0) AS eta FROM ev, m WHERE status = 'success' AND created_at >= m.t - INTERVAL 30 DAY")
def a13(s, d):
    """The window is 30 days back from the latest row: the store's rows are sparser than a live queue's 30 minutes."""
    e = evals(s, d).where("status = 'success'")
    last = evals(s, d).agg(F.max("created_at").alias("t"))
    recent = e.crossJoin(F.broadcast(last)).where(F.col("created_at") >= F.col("t") - F.expr("INTERVAL 30 DAY"))  # one row
    return quantiles(recent, "wall_clock_s", [0.5]).select(F.coalesce("q0", F.lit(30.0)).alias("eta"))


_FAIL = f"WITH {EV}, f AS (SELECT pipeline_id, regexp_replace(error_message, '[0-9]+', '<NUM>', 'g') AS sig, error_message, created_at, id FROM ev WHERE error_message IS NOT NULL AND pipeline_id IS NOT NULL)"


def _failures(s, d):
    f = evals(s, d).where("error_message is not null and pipeline_id is not null")
    return f.withColumn("sig", F.regexp_replace("error_message", "[0-9]+", "<NUM>"))


@query("A14_failure_priors", _FAIL + " SELECT pipeline_id, count(*) AS failures, count(DISTINCT sig) AS kinds, arg_max(error_message, (coalesce(created_at, TIMESTAMP '0001-01-01'), id)) AS preview FROM f GROUP BY 1")
def a14(s, d):
    key = F.struct("created_at", "id")
    return _failures(s, d).groupBy("pipeline_id").agg(F.count(F.lit(1)).alias("failures"), F.count_distinct("sig").alias("kinds"), F.max_by("error_message", key).alias("preview"))


@query("A15_failure_mask", _FAIL + " SELECT pipeline_id, count(*) AS failures FROM f GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT sig) <= 1")
def a15(s, d):
    return _failures(s, d).groupBy("pipeline_id").agg(F.count(F.lit(1)).alias("failures"), F.count_distinct("sig").alias("k")).where("failures >= 3 and k <= 1").drop("k")


@query("A16_mean_score", f"WITH {EV}, {PI} SELECT pi.id AS pipeline_id, round(coalesce(avg(e.metric_value), 0), 8) AS score FROM pi LEFT JOIN (SELECT * FROM ev WHERE metric = 'accuracy' AND {OKV}) e ON e.pipeline_id = pi.id GROUP BY 1")
def a16(s, d):
    m = evals(s, d).where((F.col("metric") == "accuracy") & usable("metric_value")).groupBy("pipeline_id").agg(F.avg("metric_value").alias("m"))
    return pipes(s, d).select(F.col("id").alias("pipeline_id")).join(m, "pipeline_id", "left").select("pipeline_id", F.round(F.coalesce("m", F.lit(0.0)), 8).alias("score"))


@query("A18_running_mean", "SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 9) AS running FROM events")
def a18(s, d):
    e = r.running(load(s, d, "events").select("event_id", "user_id", "ts", "value"), ["user_id"], [F.asc("ts"), F.asc("event_id")], {"total": F.coalesce("value", F.lit(0.0)), "n": F.col("value").isNotNull().cast("int")})
    return e.select("event_id", "user_id", F.round(F.col("total") / F.nullif(F.col("n"), F.lit(0)), 9).alias("running"))


@query(
    "A19_mode_promotion",
    """WITH g AS (
      SELECT strftime(l_shipdate, '%Y-%m') AS source, 'month' AS rule, l_linestatus AS target FROM lineitem UNION ALL SELECT l_linestatus, 'status', l_returnflag FROM lineitem
      UNION ALL SELECT 'part' || l_partkey, 'part', l_returnflag FROM lineitem),
    c AS (SELECT source, rule, target, count(*) AS n FROM g GROUP BY ALL),
    m AS (SELECT source, rule, CAST(sum(n) AS BIGINT) AS observations, max(n) AS hits, arg_max(target, (n, target)) AS target FROM c GROUP BY ALL),
    o AS (SELECT source, max(hits / observations) AS onward FROM m GROUP BY 1)
    SELECT m.source, rule, target, hits, observations, hits / observations AS rate,
      CASE WHEN observations < 20 THEN 'defer' WHEN hits / observations < 0.95 THEN 'demote' WHEN coalesce(onward, 0) > 0.95 THEN 'defer' ELSE 'promote' END AS decision
    FROM m LEFT JOIN o ON o.source = m.target""",
)
def a19(s, d):
    """Months rewritten to the status of their lines, a status to its return flags, parts to their return flags: status O leads on to one flag
    always, so months that lead to it wait; F is a firm target."""
    li = load(s, d, "lineitem")
    parts = [(F.date_format("l_shipdate", "yyyy-MM"), "month", "l_linestatus"), (F.col("l_linestatus"), "status", "l_returnflag"), (F.concat(F.lit("part"), "l_partkey"), "part", "l_returnflag")]
    one = [li.select(c.alias("source"), F.lit(rule).alias("rule"), F.col(t).alias("target")) for c, rule, t in parts]
    return r.promotion(one[0].unionByName(one[1]).unionByName(one[2]))


@query("A20_collapse_ratio", f"WITH {EV} SELECT source, count(*) AS n, count(*) - count(DISTINCT (pipeline_id, dataset_id, metric)) AS collapsed, (count(*) - count(DISTINCT (pipeline_id, dataset_id, metric))) / count(*) AS ratio FROM ev GROUP BY 1")
def a20(s, d):
    n, k = F.count(F.lit(1)), F.count_distinct(F.struct("pipeline_id", "dataset_id", "metric"))
    return evals(s, d).groupBy("source").agg(n.alias("n"), (n - k).alias("collapsed"), ((n - k) / n).alias("ratio"))


@query("A21_kfold_mean", "WITH f AS (SELECT l_orderkey % 5 AS fold, avg(l_discount) AS score FROM lineitem GROUP BY 1) SELECT round(avg(round(score, 6)), 4) AS cv_score, count(*) AS folds FROM f")
def a21(s, d):
    f = load(s, d, "lineitem").groupBy((F.col("l_orderkey") % 5).alias("fold")).agg(F.avg("l_discount").alias("score"))
    return f.agg(F.round(F.avg(F.round("score", 6)), 4).alias("cv_score"), F.count(F.lit(1)).alias("folds"))


@query("A22_contingency", "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') / count(*) AS f, count(*) FILTER (l_linestatus = 'O') / count(*) AS o FROM lineitem GROUP BY 1")
def a22(s, d):
    t = load(s, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count().na.fill(0)
    return t.select("l_returnflag", (F.col("F") / (F.col("F") + F.col("O"))).alias("f"), (F.col("O") / (F.col("F") + F.col("O"))).alias("o"))


@query("A23_value_counts", "SELECT p_size, count(*) AS n FROM part GROUP BY 1")
def a23(s, d):
    return load(s, d, "part").groupBy("p_size").agg(F.count(F.lit(1)).alias("n"))


@query("A24_exact_distinct", "SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS kinds, count(DISTINCT value) AS vals FROM events")
def a24(s, d):
    return load(s, d, "events").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("kinds"), F.count_distinct("value").alias("vals"))


@query("A25_status_rows", f"WITH {EV} SELECT id, run_id, status, coalesce(wall_clock_s, 0.0) AS duration_s, created_at FROM ev WHERE status <> 'success'")
def a25(s, d):
    return evals(s, d).where(F.col("status") != "success").select("id", "run_id", "status", F.coalesce("wall_clock_s", F.lit(0.0)).alias("duration_s"), "created_at").orderBy(F.desc_nulls_last("created_at"), "id")


_LATEST = f"WITH {EV}, l AS (SELECT dataset_id, pipeline_id, metric_value, id FROM ev WHERE metric = 'accuracy' AND status = 'success' AND {OKV} AND dataset_id IS NOT NULL AND pipeline_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dataset_id, pipeline_id ORDER BY created_at DESC NULLS LAST, id DESC) = 1)"


def _last_scores(s, d) -> DataFrame:
    """The latest score of every pipeline on every data set; the pairs are combined map-side."""
    e = scored(s, d).dropna(subset=["dataset_id", "pipeline_id"])
    return e.groupBy("dataset_id", "pipeline_id").agg(F.max(F.struct("created_at", "id", "metric_value"))["metric_value"].alias("score"))


@query("W01_latest_leaderboard", _LATEST + " SELECT dataset_id, pipeline_id, metric_value AS score, CAST(rank() OVER (PARTITION BY dataset_id ORDER BY metric_value DESC) AS INTEGER) AS rnk FROM l")
def w01(s, d):
    """The latest score of every pipeline on every data set, ranked within the data set, from counts of the distinct scores."""
    last = durable(_last_scores(s, d))
    return r.with_places(last, ["dataset_id"], "score", descending=True).select("dataset_id", "pipeline_id", "score", (F.col("n_upto") - F.col("n_at") + 1).cast("int").alias("rnk"))


@query("W02_upsert", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders UNION ALL SELECT -o_orderkey, 'N' FROM orders WHERE o_orderkey % 1000 = 0")
def w02(s, d):
    o = load(s, d, "orders").select("o_orderkey", "o_orderstatus")
    new = o.where("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("X")).unionByName(o.where("o_orderkey % 1000 = 0").select((-F.col("o_orderkey")).alias("o_orderkey"), F.lit("N").alias("o_orderstatus")))
    return r.upsert(o, new, ["o_orderkey"])


@query("W03_first_per_key", "SELECT p_brand, p_partkey, p_name FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) = 1")
def w03(s, d):
    return r.latest_by(load(s, d, "part"), ["p_brand"], [F.asc("p_retailprice"), F.asc("p_partkey")]).select("p_brand", "p_partkey", "p_name")


@query("W04_rank_numbers", _LATEST + " SELECT dataset_id, pipeline_id, CAST(row_number() OVER (PARTITION BY dataset_id ORDER BY metric_value DESC, pipeline_id) AS INTEGER) AS rn FROM l")
def w04(s, d):
    return r.ranked(_last_scores(s, d), [F.desc("score"), F.asc("pipeline_id")], "rn", ["dataset_id"]).select("dataset_id", "pipeline_id", "rn")


@query("W07_last_messages", "SELECT user_id, list(event_id ORDER BY ts, event_id)[-3:] AS last3 FROM events GROUP BY 1")
def w07(s, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    e = load(s, d, "events").select("user_id", "ts", "event_id").withColumn("rn", F.row_number().over(w)).where("rn <= 3")
    return e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda x: x["event_id"]).alias("last3"))


@query("W08_percentile_rank", f"WITH {EV}, h AS (SELECT dataset_id, metric_value, id FROM ev WHERE metric = 'accuracy' AND {OKV} AND dataset_id IS NOT NULL) SELECT id, dataset_id, CASE WHEN count(*) OVER (PARTITION BY dataset_id) >= 5 THEN round(cume_dist() OVER (PARTITION BY dataset_id ORDER BY metric_value), 9) END AS pct FROM h")
def w08(s, d):
    h = evals(s, d).where((F.col("metric") == "accuracy") & usable("metric_value") & F.col("dataset_id").isNotNull())
    h = r.with_places(durable(h.select("id", "dataset_id", "metric_value")), ["dataset_id"], "metric_value")
    return h.select("id", "dataset_id", F.when(F.col("n_group") >= 5, F.round(F.col("n_upto") / F.col("n_group"), 9)).alias("pct"))


@query("W09_upsert_by_run", f"WITH {EV} SELECT run_id, status, wall_clock_s FROM ev QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY created_at DESC NULLS LAST, id DESC) = 1")
def w09(s, d):
    best = F.max(F.struct("created_at", "id", "status", "wall_clock_s")).alias("b")
    return evals(s, d).groupBy("run_id").agg(best).select("run_id", "b.status", "b.wall_clock_s")


@query("W10_recency_prior", "WITH m AS (SELECT max(ts) AS t FROM events) SELECT event_type, round(0.25 + sum(CASE WHEN value > 10 THEN value / 100 * pow(0.5, date_diff('second', ts, m.t) / 86400.0) ELSE 0 END), 5) AS prior FROM events, m GROUP BY 1")
def w10(s, d):
    ev = load(s, d, "events")
    last = ev.agg(F.max("ts").alias("t"))  # one row
    age = F.timestamp_diff("SECOND", F.date_trunc("second", "ts"), F.date_trunc("second", "t")).cast("double")
    rows = ev.crossJoin(F.broadcast(last)).select("event_type", F.when(F.col("value") > 10, F.col("value") / 100).otherwise(0.0).alias("cos"), F.lit(1.0).alias("ok"), age.alias("age"))
    return r.recency_prior(rows, "event_type", "cos", "ok", "age", 86400.0).withColumn("prior", F.round("prior", 5))


@query("W11_conditional_update", f"WITH {PI} SELECT id, provenance, CASE WHEN n_ops > 5 AND provenance = 'generated' THEN false ELSE true END AS active FROM pi")
def w11(s, d):
    return pipes(s, d).select("id", "provenance", (~F.coalesce((F.col("n_ops") > 5) & (F.col("provenance") == "generated"), F.lit(False))).alias("active"))


@query("T01_order_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
def t01(s, d):
    return load(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(10).limit(20)


@query("T02_top_k_excluding", _WINS.replace("SELECT pipeline_id, %s", "SELECT * FROM (SELECT pipeline_id, %s") % ("", "") + ") WHERE pipeline_id NOT IN ('pl-x', 'pl-y') ORDER BY win_rate DESC, compared DESC, pipeline_id LIMIT 10")
def t02(s, d):
    return r.win_rates(inter(s, d)).where(~F.col("pipeline_id").isin("pl-x", "pl-y")).orderBy(F.desc("win_rate"), F.desc("compared"), "pipeline_id").limit(10)


@query("T03_smallest_graphs", "WITH p AS (SELECT lower(trim(id)) AS id, created_at, CASE WHEN json_valid(dag) THEN CASE json_type(dag, '$.nodes') WHEN 'ARRAY' THEN json_array_length(dag, '$.nodes') WHEN 'OBJECT' THEN len(json_keys(dag, '$.nodes')) END END AS k FROM pipelines), q AS (SELECT id, min(CAST(coalesce(k, 1000000) AS INTEGER)) AS graph_size FROM p GROUP BY 1) SELECT id, graph_size FROM q ORDER BY graph_size, id LIMIT 40")
def t03(s, d):
    p = load(s, d, "pipelines").select(norm_id("id").alias("id"), F.variant_get(F.try_parse_json("dag"), "$.nodes", "string").alias("nodes"))
    return r.smallest_graphs(p, F.col("nodes")).groupBy("id").agg(F.min("graph_size").alias("graph_size")).orderBy("graph_size", "id").limit(40)


@query("T04_seeded_sample", "SELECT p_partkey FROM part ORDER BY md5(CAST(p_partkey AS VARCHAR)), p_partkey LIMIT 50")
def t04(s, d):
    return r.sample_hashed(load(s, d, "part").select("p_partkey"), "p_partkey", 50)


@query("T04_sample_or_all", "WITH p AS (SELECT lower(trim(id)) AS id, bool_or(lower(trim(task)) IN ('classification', 'no such task')) AS a, bool_or(lower(trim(task)) = 'no such task') AS b FROM pipelines WHERE trim(id) <> '' GROUP BY 1), x AS (SELECT 'task' AS kind, id FROM p WHERE a ORDER BY md5(id), id LIMIT 20), y AS (SELECT 'fallback' AS kind, id FROM p ORDER BY md5(id), id LIMIT 20) SELECT * FROM x UNION ALL SELECT * FROM y")
def t04b(s, d):
    """Pipelines of a task; for a task that fewer than five have, pipelines of any."""
    t = F.lower(F.trim("task"))
    p = load(s, d, "pipelines").select(norm_id("id").alias("id"), t.isin("classification", "no such task").alias("a"), (t == "no such task").alias("b")).where("id is not null").groupBy("id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    one = r.sample_or_all(p, F.col("a"), "id", 20).select(F.lit("task").alias("kind"), "id")
    return one.unionByName(r.sample_or_all(p, F.col("b"), "id", 20).select(F.lit("fallback").alias("kind"), "id"))


@query("T05_lexicographic_sort", f"WITH {EV}, m AS (SELECT pipeline_id, max(metric_value) FILTER (metric = 'accuracy') AS acc, min(metric_value) FILTER (metric = 'fit_seconds') AS secs FROM ev WHERE {OKV} AND pipeline_id IS NOT NULL GROUP BY 1) SELECT pipeline_id, acc, secs, CAST(row_number() OVER (ORDER BY acc DESC NULLS LAST, secs NULLS LAST, pipeline_id) AS INTEGER) AS place FROM m")
def t05(s, d):
    e = evals(s, d).where(usable("metric_value") & F.col("pipeline_id").isNotNull())
    m = e.groupBy("pipeline_id").agg(F.max(F.when(F.col("metric") == "accuracy", F.col("metric_value"))).alias("acc"), F.min(F.when(F.col("metric") == "fit_seconds", F.col("metric_value"))).alias("secs"))
    return r.ranked(m, [F.desc_nulls_last("acc"), F.asc_nulls_last("secs"), F.asc("pipeline_id")], "place")


@query("T06_pair_queue", _OPEN + " ORDER BY pi.created_at DESC NULLS LAST, pi.id DESC, ds.created_at DESC NULLS LAST, ds.id DESC LIMIT 100")
def t06(s, d):
    """Every pipeline that has an open pair gives at least one row, so the 100 newest of these hold the queue; the few that fill it meet all data sets."""
    done, n = _done(s, d), sets(s, d).agg(F.count(F.lit(1)).alias("sets"))
    left = pipes(s, d).join(done.groupBy(F.col("pipeline_id").alias("id")).agg(F.count(F.lit(1)).alias("done")), "id", "left").crossJoin(F.broadcast(n))  # n is one row
    newest = [F.desc_nulls_last("p_at"), F.desc("pipeline_id")]
    p = left.select(F.col("id").alias("pipeline_id"), F.col("created_at").alias("p_at"), (F.col("sets") - F.coalesce("done", F.lit(0))).alias("open")).where("open > 0").orderBy(*newest).limit(100)
    before = F.sum("open").over(Window.orderBy(*newest).rowsBetween(Window.unboundedPreceding, -1))  # over at most 100 rows
    p = p.withColumn("before", F.coalesce(before, F.lit(0))).where("before < 100").select("pipeline_id", "p_at")
    pairs = sets(s, d).select(F.col("id").alias("dataset_id"), F.col("created_at").alias("d_at")).crossJoin(F.broadcast(p))
    return pairs.join(done.join(F.broadcast(p.select("pipeline_id")), "pipeline_id", "left_semi"), ["pipeline_id", "dataset_id"], "left_anti").orderBy(*newest, F.desc_nulls_last("d_at"), F.desc("dataset_id")).limit(100).select("pipeline_id", "dataset_id")


@query("T07_priority_queue", "SELECT event_id, CASE event_type WHEN 'error' THEN -20 WHEN 'purchase' THEN -10 ELSE -1 END AS score FROM events ORDER BY score, ts, event_id LIMIT 25")
def t07(s, d):
    score = F.when(F.col("event_type") == "error", -20).when(F.col("event_type") == "purchase", -10).otherwise(-1)
    return load(s, d, "events").withColumn("score", score).orderBy("score", "ts", "event_id").limit(25).select("event_id", "score")


@query("T09_weighted_pick", "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > 0 ORDER BY -ln((CAST('0x' || substr(md5('42:' || p_partkey), 1, 12) AS BIGINT) + 1) / (pow(2, 48) + 1)) / p_retailprice, p_partkey LIMIT 100")
def t09(s, d):
    return r.weighted_pick(load(s, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 100, "p_partkey")


@query("T10_stratified_folds", "WITH f AS (SELECT p_partkey, p_brand, CAST((row_number() OVER (PARTITION BY p_brand ORDER BY md5(CAST(p_partkey AS VARCHAR)), p_partkey) - 1) % 5 AS INTEGER) AS fold FROM part) SELECT p_brand, fold, count(*) AS n, min(p_partkey) AS first_key FROM f GROUP BY ALL")
def t10(s, d):
    p = load(s, d, "part").select("p_partkey", "p_brand", F.md5(F.col("p_partkey").cast("string").cast("binary")).alias("h"))
    f = r.ranked(p, [F.asc("h"), F.asc("p_partkey")], "place", ["p_brand"]).select("p_partkey", "p_brand", ((F.col("place") - 1) % 5).alias("fold"))
    return f.groupBy("p_brand", "fold").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_key"))


@query("T10_train_test_split", "WITH RECURSIVE bits AS (SELECT 0 AS k, i AS i, i AS c FROM range(256) t(i) UNION ALL SELECT k + 1, i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8), tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8), st AS (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS x, 0 AS k, 4294967295::BIGINT AS c FROM part UNION ALL SELECT p_partkey, x, k + 1, xor(t[1 + (xor(c, ascii(x[k + 1])) & 255)], c >> 8) FROM st, tab WHERE k < len(x)), f AS (SELECT CAST(xor(c, 4294967295) % 5 AS INTEGER) AS fold FROM st WHERE k = len(x)) SELECT fold, count(*) AS n FROM f GROUP BY 1")
def t10b(s, d):
    return r.folds(load(s, d, "part").select("p_partkey"), "p_partkey", 5).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@query("U01_union_distinct", "SELECT compared_id AS id FROM interactions WHERE compared_id IS NOT NULL UNION SELECT preferred_id FROM interactions WHERE preferred_id IS NOT NULL")
def u01(s, d):
    i = load(s, d, "interactions")
    return i.select(F.col("compared_id").alias("id")).union(i.select("preferred_id")).where("id is not null").distinct()


@query("U02_concat_with_origin", "SELECT origin, count(*) AS n, round(avg(v), 6) AS mean FROM (SELECT 'train' AS origin, l_quantity AS v FROM lineitem WHERE l_linestatus = 'F' UNION ALL SELECT 'test', l_quantity FROM lineitem WHERE l_linestatus = 'O') GROUP BY 1")
def u02(s, d):
    li = load(s, d, "lineitem")
    part = lambda st, o: li.where(F.col("l_linestatus") == st).select(F.lit(o).alias("origin"), F.col("l_quantity").alias("v"))
    return part("F", "train").unionByName(part("O", "test")).groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean"))


@query("U03_concat_columns", "SELECT c_custkey, c_acctbal, c_mktsegment AS target FROM customer")
def u03(s, d):
    c = load(s, d, "customer")
    return c.select("c_custkey", "c_acctbal").join(c.select("c_custkey", F.col("c_mktsegment").alias("target")), "c_custkey")


_OPS = "o AS (SELECT lower(trim(id)) AS id, list_sort(list_distinct(list_filter(list_transform(operators, lambda x: lower(trim(x))), lambda x: x <> ''))) AS ops FROM pipelines QUALIFY row_number() OVER (PARTITION BY lower(trim(id)) ORDER BY created_at DESC NULLS LAST, list_sort(list_distinct(list_filter(list_transform(operators, lambda x: lower(trim(x))), lambda x: x <> ''))) DESC NULLS LAST) = 1), b AS (SELECT ops AS base FROM o ORDER BY len(ops) DESC NULLS LAST, id LIMIT 1)"


def operator_sets(s, d) -> DataFrame:
    o = F.array_sort(F.array_distinct(F.filter(F.transform("operators", lambda x: F.lower(F.trim(x))), lambda x: x.isNotNull() & (x != ""))))
    p = load(s, d, "pipelines").select(norm_id("id").alias("id"), o.alias("ops"), "created_at")
    return r.latest_by(p, ["id"], [F.desc_nulls_last("created_at"), F.desc_nulls_last("ops")]).select("id", "ops")


def _with_base(s, d) -> DataFrame:
    o = operator_sets(s, d)
    base = o.orderBy(F.desc_nulls_last(F.size("ops")), "id").limit(1).select(F.col("ops").alias("base"))
    return o.crossJoin(F.broadcast(base))  # one row


@query("U04_symmetric_difference", f"WITH {_OPS} SELECT id, len(list_filter(ops, lambda x: NOT list_contains(base, x))) + len(list_filter(base, lambda x: NOT list_contains(ops, x))) AS diff FROM o, b WHERE ops IS NOT NULL")
def u04(s, d):
    x = F.size(F.array_except("ops", "base")) + F.size(F.array_except("base", "ops"))
    return _with_base(s, d).where("ops is not null").select("id", x.cast("bigint").alias("diff"))


@query("U05_jaccard", f"WITH {_OPS} SELECT id, CASE WHEN len(ops) + len(base) = 0 THEN 0.0 ELSE len(list_intersect(ops, base)) / len(list_distinct(list_concat(ops, base))) END AS jaccard FROM o, b WHERE ops IS NOT NULL")
def u05(s, d):
    u = F.size(F.array_union("ops", "base"))
    return _with_base(s, d).where("ops is not null").select("id", F.when(u == 0, 0.0).otherwise(F.size(F.array_intersect("ops", "base")) / u).alias("jaccard"))


@query("U06_intersect_except", "SELECT 'both' AS part, count(*) AS n FROM (SELECT compared_id FROM interactions INTERSECT SELECT preferred_id FROM interactions) UNION ALL SELECT 'only', count(*) FROM (SELECT compared_id FROM interactions EXCEPT SELECT preferred_id FROM interactions)")
def u06(s, d):
    i = load(s, d, "interactions")
    a, b = i.select("compared_id"), i.select("preferred_id")
    n = lambda x, p: x.agg(F.lit(p).alias("part"), F.count(F.lit(1)).alias("n"))
    return n(a.intersect(b), "both").unionByName(n(a.subtract(b), "only"))


QUERIES = Q
