"""Running sums and places over kept ranges, profile jobs, nested updates, rewriting, learning operators: brute force and edge cases."""

import json
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from kelpie.operators import docstore as doc
from kelpie.operators import graphs as g
from kelpie.operators import jobs
from kelpie.operators import learning as ml
from kelpie.operators import quality as q
from kelpie.operators import relational as rel
from kelpie.streaming import ops


def hot(n=900, seed=1):
    r = random.Random(seed)
    return [("hot" if r.random() < 0.5 else r.choice(["a", "b", None]), r.choice([None, float(r.randrange(6))]), i) for i in range(n)]


def test_running_sums_of_a_hot_group_that_spans_ranges(spark):
    data = hot()
    df = spark.createDataFrame(data, "k string, v double, id int").withColumn("_clash", F.lit(1)).repartition(5)
    got = {r.id: (r.s, r.n, r.s_total) for r in rel.running(df, ["k"], [F.asc("id")], {"s": F.coalesce("v", F.lit(0.0)), "n": F.lit(1)}, totals=True).collect()}
    by = defaultdict(list)
    for k, v, i in data:
        by[k].append((i, v or 0.0))
    want = {i: (sum(v for _, v in x[: j + 1]), j + 1, sum(v for _, v in x)) for x in by.values() for j, (i, _) in enumerate(x)}
    assert got == want
    assert rel.running(df.limit(0), ["k"], [F.asc("id")], {"n": F.lit(1)}).count() == 0
    assert rows(rel.ranked(df.select("id"), [F.desc("id")], "place")) == sorted([(i, len(data) - i) for i in range(len(data))], key=str)


def test_places_of_ties_and_nulls(spark):
    data = hot(300, 2)
    df = spark.createDataFrame(data, "k string, v double, id int")
    by = defaultdict(list)
    for k, v, _ in data:
        by[k].append(v)
    low = lambda v: -1.0 if v is None else v
    got = {r.id: (r.n_at, r.n_upto, r.n_group) for r in rel.with_places(df, ["k"], "v").collect()}
    assert got == {i: (by[k].count(v), sum(low(x) <= low(v) for x in by[k]), len(by[k])) for k, v, i in data}


def test_decisions_of_series(spark):
    data = [("a", i, v) for i, v in enumerate([0.90, 0.92, 0.91, 0.89, 0.88, None, 0.5])] + [("b", 0, 0.94), ("b", 1, 0.96), ("c", 0, float("nan"))]
    df = spark.createDataFrame(data, "m string, day int, v double")
    said = lambda spec: {(r.m, r.day): (r.status, r.decision) for r in q.decide_series(df, ["m"], [F.asc("day")], "v", spec).collect()}
    a = said({"kind": "moving_average", "threshold": 0.10, "window": 3, "least": 3})
    assert a["a", 4][0] == "warning" and a["a", 2][0] == "pending" and a["a", 5][0] == "pending" and a["a", 6][0] == "failed" and a["c", 0][0] == "pending"
    b = said({"kind": "learned_model", "threshold": 1.0, "warning": 0.25, "least": 3})
    assert b["a", 6][0] == "failed"
    c = said({"kind": "if_then_else", "threshold": 0.95, "window": 3, "least": 3})
    assert c["b", 1] == ("passed", "constant_threshold") and c["b", 0] == ("failed", "constant_threshold") and c["a", 3][1] == "moving_average"
    with pytest.raises(ValueError):
        said({"kind": "other", "threshold": 1})


def test_profile_jobs(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "a", None), (2, None, "x"), (3, "c", " ")], "n int, s string, y string").withColumn("arr", F.array(F.lit(1)))
    got = {r.metric: (r.value, r.status) for r in jobs.profile_job(df, ["missing_ratio", "duplicate_ratio", "label_completeness", "rows"], {"target": "y"}).collect()}
    assert got == {"missing_ratio": (3 / 12, "done"), "duplicate_ratio": (0.25, "done"), "label_completeness": (0.25, "done"), "rows": (4.0, "done")}
    assert {r.metric: r.status for r in jobs.profile_job(df, ["label_completeness"]).collect()} == {"label_completeness": "pending_input"}
    assert {r.metric: r.value for r in jobs.profile_job(df.limit(0), ["missing_ratio", "rows"]).collect()} == {"missing_ratio": None, "rows": 0.0}
    with pytest.raises(KeyError):
        jobs.profile_job(df, ["nothing"])
    loop = {"a": jobs.Metric(lambda k, i: F.col("b"), ("b",)), "b": jobs.Metric(lambda k, i: F.col("a"), ("a",))}
    with pytest.raises(ValueError):
        jobs.profile_job(df, ["a"], metrics=loop)
    form = {r.column: r for r in jobs.form_defaults(df.drop("arr")).collect()}
    assert form["n"].range == [1.0, 3.0] and form["n"].rule == "between" and form["s"].allowed_values == ["a", "c"] and form["s"].rule == "in" and form["s"].decimals is None


def test_nested_rebuild_and_updates(spark):
    assert doc.rebuild({"a.b": 1, "a.c.d": 2, "e": 3}) == {"a": {"b": 1, "c": {"d": 2}}, "e": 3} and doc.rebuild({}) == {}
    for bad in ({"a": 1, "a.b": 2}, {"a.b": 2, "a": 1}):
        with pytest.raises(ValueError):
            doc.rebuild(bad)
    texts = ['{"a":{"b":{"n":1,"keep":true}},"z":[1]}', "{}", "not json", None, '{"a":5}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, data string")
    out = {r.id: r.data for r in doc.update(df, {}, {"$inc": {"a.b.n": 2}, "$set": {"q.r": [1]}, "$unset": {"x.y": 1, "z": 1}}).collect()}
    assert json.loads(out[0]) == {"a": {"b": {"n": 3, "keep": True}}, "q": {"r": [1]}} and json.loads(out[1]) == {"a": {"b": {"n": 2}}, "q": {"r": [1]}} and out[2] == "not json" and out[3] is None
    with pytest.raises(NotImplementedError):
        doc.update(df, {}, {"$rename": {"a": "b"}})


def test_rewrite_steps(spark):
    n = spark.createDataFrame([(1, "a", "A"), (1, "b", "B"), (1, "c", "C"), (2, "x", "C")], "graph int, node string, label string")
    e = spark.createDataFrame([(1, "a", "b"), (1, "b", "c")], "graph int, src string, dst string")
    at = lambda label: lambda a, b: a.where(F.col("label") == label)
    go = lambda label, *steps: tuple(rows(x) for x in g.rewrite(n, e, at(label), list(steps)))
    assert go("B", ("add", "+", "N", "between"))[1] == [(1, "a", "b"), (1, "b", "b+"), (1, "b+", "c")]
    assert go("B", ("add", "+", "N", "before"), ("reroute", "+"))[1] == [(1, "a", "b+"), (1, "b", "c"), (1, "b+", "b+")]
    assert go("B", ("delete", True)) == ([(1, "a", "A"), (1, "c", "C"), (2, "x", "C")], [(1, "a", "c")])
    assert go("C", ("relabel", "Z"))[0] == [(1, "a", "A"), (1, "b", "B"), (1, "c", "Z"), (2, "x", "Z")]
    assert go("B", ("replace",)) == ([(2, "x", "C")], [])
    assert go("B", ("apply", lambda a, b, hit: (a.limit(0), b)))[0] == []
    assert go("none", ("delete", True), ("replace",)) == (rows(n), rows(e))
    with pytest.raises(NotImplementedError):
        go("B", ("twist",))


def test_learning_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3)) @ np.diag([3.0, 1.0, 0.2])
    y = (x[:, 0] + 0.5 * x[:, 1] > 0).astype(float)
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id bigint, a double, b double, c double, y double")
    cols = ["a", "b", "c"]
    _, s = ml.truncated_svd(df, cols, 2)
    assert s == pytest.approx(np.linalg.svd(x)[1][:2].tolist())
    got = ml.nystroem(df, ["a", "b"], "id", 60, 0.2).orderBy("id").limit(40).collect()
    f = np.array([[r[k] for k in r.asDict() if k.startswith("f")] for r in got])
    want = np.exp(-0.2 * ((x[:40, None, :2] - x[None, :40, :2]) ** 2).sum(2))
    assert np.abs(f @ f.T - want).mean() < 0.05
    for name, make in ml.own_classifiers(cols, "y").items():
        hit = make().fit(df).transform(df).agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]
        assert hit > (0.8 if name in ("ada_boost", "extra_trees") else 0.93), name
    skew = spark.createDataFrame([(float(math.exp(v)),) for v in rng.normal(size=500)], "v double")
    out, lam = ml.power_transform(skew, "v")
    assert lam < 0 and abs(out.agg(F.skewness("y")).first()[0]) < 0.4
    first = {r.feature: r.place for r in ml.select_k_best(df, cols, "y").collect()}
    assert first["a"] == 1
    auc = ml.roc_auc(df, "y", "a").first()[0]
    pos, neg = x[y == 1, 0], x[y == 0, 0]
    assert auc == pytest.approx((pos[:, None] > neg[None]).mean())
    assert ml.roc_auc(df.limit(0), "y", "a").first()[0] is None
    unit = ml.normalise_rows(spark.createDataFrame([(3.0, 4.0), (0.0, 0.0), (None, 2.0)], "a double, b double"), ["a", "b"])
    assert rows(unit) == sorted([(0.6, 0.8), (0.0, 0.0), (None, 1.0)], key=str)


def test_components_against_numpy(spark):
    rng = np.random.default_rng(3)
    src = np.column_stack([np.sign(np.sin(np.arange(800) / 7)), rng.uniform(-1, 1, 800), rng.laplace(size=800)])
    mixed = src @ np.array([[1.0, 0.5, 0.2], [0.3, 1.0, -0.4], [-0.6, 0.1, 1.0]])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(mixed)], "id bigint, a double, b double, c double")
    got = ml.fast_ica(df, ["a", "b", "c"], 3).orderBy("id").select("i0", "i1", "i2").collect()
    match = np.abs(np.corrcoef(np.array(got).T, src.T)[:3, 3:])
    assert match.max(0).min() > 0.95
    assert ml.fast_ica(df.limit(0), ["a", "b", "c"], 2).count() == 0
    k = np.array(ml.kernel_pca(df, ["a", "b"], "id", 2, 0.3, 80).orderBy("id").select("k0", "k1").collect())
    gram = np.exp(-0.3 * ((mixed[:, None, :2] - mixed[None, :, :2]) ** 2).sum(2))
    c = gram - gram.mean(0) - gram.mean(1)[:, None] + gram.mean()
    top = np.linalg.eigh(c)[1][:, -2:][:, ::-1]
    assert abs(np.corrcoef(k[:, 0], top[:, 0])[0, 1]) > 0.98 and abs(np.corrcoef(k[:, 1], top[:, 1])[0, 1]) > 0.95


def test_sample_falls_back_when_few_fit(spark):
    df = spark.range(30).withColumnRenamed("id", "k")
    assert rel.sample_or_all(df, F.col("k") < 4, "k", 10).count() == 10 and rel.sample_or_all(df, F.col("k") < 7, "k", 10).where("k >= 7").count() == 0


def test_streams_take_in_only_what_is_new_and_keep_state_across_batches(spark, tmp_path):
    schema = "id bigint, ts timestamp, k string"
    rows_ = [(i, f"2024-01-01 00:{i:02d}:00", "a" if i % 2 else "b") for i in range(30)]
    df = spark.createDataFrame(rows_, "id bigint, ts string, k string").withColumn("ts", F.col("ts").cast("timestamp"))
    src, state, out = (str(tmp_path / x) for x in ("src", "state", "out"))
    seen = []

    def go():
        ops.source(spark, src, schema, per_trigger=1).writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(lambda b, n: seen.append((n, sorted(r.id for r in b.collect())))).start().awaitTermination()

    for i in range(2):
        df.where(F.col("id") % 3 == i).coalesce(1).write.mode("append").parquet(src)
    go()
    assert [n for n, _ in seen] == [0, 1] and seen[0][1] == list(range(0, 30, 3))
    df.where(F.col("id") % 3 == 2).coalesce(1).write.mode("append").parquet(src)
    go()
    assert len(seen) == 3 and seen[2][1] == list(range(2, 30, 3))  # nothing is taken in twice
    folder = ops.in_parts([df.where(f"id < {c}" if c == 10 else f"id >= {c - 10} and id < {c}") for c in (10, 20, 30)])
    lim = ops.result(ops.rate_limit(ops.source(spark, folder, schema, "ts", "1 hour", per_trigger=1), "k", "ts", "id", 4, 3600))
    assert {r.key: r.n for r in lim.where("allowed").groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()} == {"a": 4, "b": 4}
    late = ops.result(ops.deduplicate(ops.source(spark, ops.in_parts([df, df]), schema, "ts", "1 hour", per_trigger=1), "id").select("id"))
    assert late.count() == 30
