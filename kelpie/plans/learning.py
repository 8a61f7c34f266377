"""Queries over machine-learning operators and user functions (L, V, C02, P05..)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.operators import learning as ml
from kelpie.sources.tables import load

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _li(s, d) -> DataFrame:
    return load(s, d, "lineitem").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_returnflag")


@query("L01_standard_scaler", "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS z FROM customer")
def l01(s, d):
    return ml.scale(load(s, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], "standard").select("c_custkey", F.round("c_acctbal", 6).alias("z"))


@query("L01_minmax_scaler", "SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 6) AS z FROM customer")
def l01b(s, d):
    return ml.scale(load(s, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], "minmax").select("c_custkey", F.round("c_acctbal", 6).alias("z"))


@query("L01_robust_scaler", "WITH q AS (SELECT quantile_cont(c_acctbal, 0.5) AS m, quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25) AS w FROM customer) SELECT c_custkey, round((c_acctbal - m) / w, 6) AS z FROM customer, q")
def l01c(s, d):
    return ml.scale(load(s, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], "robust").select("c_custkey", F.round("c_acctbal", 6).alias("z"))


@query("L01_normalizer", "WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity AS a, l_extendedprice AS b, sqrt(l_quantity ** 2 + l_extendedprice ** 2) AS n FROM lineitem) SELECT l_orderkey, l_linenumber, round(a / n, 9) AS a, round(b / n, 9) AS b FROM x")
def l01d(s, d):
    x = ml.normalise_rows(_li(s, d), ["l_quantity", "l_extendedprice"])
    return x.select("l_orderkey", "l_linenumber", F.round("l_quantity", 9).alias("a"), F.round("l_extendedprice", 9).alias("b"))


_YJ = "CASE WHEN value >= 0 THEN CASE WHEN lam = 0 THEN ln(1 + value) ELSE ((value + 1) ** lam - 1) / lam END ELSE CASE WHEN lam = 2 THEN -ln(1 - value) ELSE -((1 - value) ** (2 - lam) - 1) / (2 - lam) END END"
_FIT = f"SELECT lam, -count(*) / 2.0 * ln(var_pop({_YJ})) + (lam - 1) * sum(CASE WHEN value >= 0 THEN ln(1 + value) ELSE -ln(1 - value) END) AS fit FROM events, %s GROUP BY lam"


@query("L02_power_transform", f"WITH g AS (SELECT round(-2 + 0.1 * i, 1)::DOUBLE AS lam FROM range(61) t(i)), a AS (SELECT arg_max(lam, fit) AS best FROM ({_FIT % 'g'})), h AS (SELECT round(best + 0.01 * i, 2)::DOUBLE AS lam FROM a, range(-9, 10) t(i)), b AS (SELECT arg_max(lam, fit) AS lam FROM ({_FIT % 'h'})) SELECT event_id, lam, round({_YJ}, 7) AS y FROM events, b")
def l02b(s, d):
    out, lam = ml.power_transform(load(s, d, "events").select("event_id", "value"), "value")
    return out.select("event_id", F.lit(lam).alias("lam"), F.round("y", 7).alias("y"))


@query("L02_quantile_transform", "SELECT c_custkey, round(percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal), 9) AS q FROM customer")
def l02(s, d):
    return ml.quantile_transform(load(s, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), ["c_nationkey"], "c_acctbal").select("c_custkey", F.round("c_acctbal_q", 9).alias("q"))


@query("L03_ordinal_encoding", "SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS code FROM part")
def l03(s, d):
    return ml.ordinal_encode(load(s, d, "part").select("p_partkey", "p_brand"), "p_brand").select("p_partkey", F.col("p_brand_code").alias("code"))


@query("L03_one_hot", "SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS f, CAST(o_orderstatus = 'O' AS INTEGER) AS o FROM orders")
def l03b(s, d):
    return ml.one_hot(load(s, d, "orders"), "o_orderstatus", ["F", "O"]).select("o_orderkey", F.col("o_orderstatus_F").alias("f"), F.col("o_orderstatus_O").alias("o"))


@query("L04_simple_imputer", "SELECT id, round(coalesce(wall_clock_s, (SELECT avg(wall_clock_s) FROM evaluations)), 6) AS v FROM evaluations")
def l04(s, d):
    from kelpie.operators.risk import impute

    return impute(load(s, d, "evaluations").select("id", "wall_clock_s"), ["wall_clock_s"], []).select("id", F.round("wall_clock_s", 6).alias("v"))


_V = "v AS (SELECT vec_id, label, embedding[1]::DOUBLE AS t, list_transform(embedding[2:9], lambda x: x::DOUBLE) AS f FROM embeddings)"


def _points(s, d) -> DataFrame:
    return load(s, d, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("t"), F.slice("embedding", 2, 8).cast("array<double>").alias("f"))


@query("L04_knn_imputer", f"WITH {_V}, n AS (SELECT a.vec_id, b.t FROM v a JOIN v b ON a.vec_id % 20 = 0 AND b.vec_id % 20 <> 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.f, b.f), b.vec_id) <= 5) SELECT vec_id, round(avg(t), 9) AS t FROM n GROUP BY 1 UNION ALL SELECT vec_id, round(t, 9) FROM v WHERE vec_id % 20 <> 0")
def l04b(s, d):
    """The first entry is missing in every twentieth vector; the others tell who is near."""
    v = _points(s, d).withColumn("t", F.when(F.col("vec_id") % 20 != 0, F.col("t")))
    return ml.knn_impute(v, "vec_id", "f", "t").select("vec_id", F.round("t", 9).alias("t"))


@query("L08_knn_classifier", f"WITH {_V}, n AS (SELECT a.vec_id, b.label FROM v a JOIN v b ON a.vec_id % 20 = 0 AND b.vec_id % 20 <> 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.f, b.f), b.vec_id) <= 5), c AS (SELECT vec_id, label, count(*) AS n FROM n GROUP BY ALL) SELECT vec_id, label AS prediction FROM c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label) = 1")
def l08b(s, d):
    v = _points(s, d)
    return ml.knn_classify(v.where("vec_id % 20 = 0"), v.where("vec_id % 20 <> 0"), "vec_id", "f", "label").select("vec_id", "prediction")


@query("L05_truncated_svd", "WITH g AS (SELECT sum(l_quantity ** 2) AS a, sum(l_quantity * l_tax) AS b, sum(l_tax ** 2) AS c FROM lineitem) SELECT round(sqrt((a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b ** 2)), 4) AS s0, round(sqrt((a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b ** 2)), 4) AS s1 FROM g")
def l05b(s, d):
    """The singular values of two columns, which SQL can say in closed form."""
    _, value = ml.truncated_svd(_li(s, d), ["l_quantity", "l_tax"], 2)
    return s.createDataFrame([tuple(round(v, 4) for v in value)], "s0 double, s1 double")


@query("L06_select_k_best", "WITH u AS (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS v, l_returnflag AS y FROM lineitem), p AS (SELECT feature, y, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM u GROUP BY ALL), a AS (SELECT feature, avg(v) AS m FROM u GROUP BY 1), f AS (SELECT p.feature, sum(n * (p.m - a.m) ** 2) / (count(*) - 1) / (sum(n * s) / (sum(n) - count(*))) AS f FROM p JOIN a USING (feature) GROUP BY 1) SELECT feature, round(f, 4) AS f, CAST(row_number() OVER (ORDER BY f DESC) AS INTEGER) AS place FROM f")
def l06b(s, d):
    return ml.select_k_best(_li(s, d), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "l_returnflag").select("feature", F.round("f", 4).alias("f"), "place")


_W, _B = ml.rbf_weights(2, 4, 0.5)
_RBF = ", ".join(f"round(sqrt(2 / 4.0) * cos({_W[j, 0]} * l_discount + {_W[j, 1]} * l_tax + {_B[j]}), 9) AS f{j}" for j in range(4))


@query("L07_rbf_sampler", f"SELECT l_orderkey, l_linenumber, {_RBF} FROM lineitem")
def l07b(s, d):
    x = ml.rbf_sampler(_li(s, d), ["l_discount", "l_tax"], 4, 0.5)
    return x.select("l_orderkey", "l_linenumber", *[F.round(f"f{j}", 9).alias(f"f{j}") for j in range(4)])


@query("L07_nystroem")
def l07c(s, d):
    return ml.nystroem(load(s, d, "part").select("p_partkey", (F.col("p_size") / 50).alias("a"), (F.col("p_retailprice") / 2000).alias("b")), ["a", "b"], "p_partkey", 16, 1.0).drop("a", "b")


@query("L09_roc_auc", "WITH r AS (SELECT l_linestatus = 'F' AS y, l_extendedprice AS v FROM lineitem), k AS (SELECT y, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM r) SELECT round((sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / (count(*) FILTER (y) * 1.0 * count(*) FILTER (NOT y)), 9) AS auc FROM k")
def l09c(s, d):
    df = _li(s, d).select((F.col("l_linestatus") == "F").cast("int").alias("y"), "l_extendedprice")
    return ml.roc_auc(df, "y", "l_extendedprice").select(F.round("auc", 9).alias("auc"))


@query("L05_pca")
def l05(s, d):
    return ml.principal_components(_li(s, d), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 3)


@query("L05_fast_ica")
def l05c(s, d):
    e = load(s, d, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(4)])
    return ml.fast_ica(e, [f"x{i}" for i in range(4)], 3).select("vec_id", "i0", "i1", "i2")


@query("L05_kernel_pca")
def l05d(s, d):
    e = load(s, d, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(4)])
    return ml.kernel_pca(e, [f"x{i}" for i in range(4)], "vec_id", 2, 0.5, 32).select("vec_id", "k0", "k1")


@query("L06_variance_threshold", "SELECT c AS \"column\" FROM (SELECT 'l_quantity' AS c, var_pop(l_quantity) AS v FROM lineitem UNION ALL SELECT 'l_tax', var_pop(l_tax) FROM lineitem) WHERE v > 0.5")
def l06(s, d):
    return s.createDataFrame([(c,) for c in ml.variance_threshold(_li(s, d), ["l_quantity", "l_tax"], 0.5)], "column string")


@query("L07_polynomial_and_bins", "SELECT event_id, round(value * value, 6) AS sq, CASE WHEN value < 10 THEN 0 WHEN value < 50 THEN 1 ELSE 2 END AS bin FROM events")
def l07(s, d):
    e = ml.polynomial(load(s, d, "events").select("event_id", "value"), ["value"])
    return e.select("event_id", F.round("`value*value`", 6).alias("sq"), ml.bins(F.col("value"), [10, 50]).alias("bin"))


@query("L08_classifiers")
def l08(s, d):
    df = _li(s, d).withColumn("label", (F.col("l_linestatus") == "F").cast("int"))
    return ml.train_and_score(df, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "label", "l_orderkey", [*ml.classifiers(), *ml.own_classifiers([], "")])


@query("L09_class_metrics", "WITH f AS (SELECT CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS y, CASE WHEN l_quantity > 20 THEN 1 ELSE 0 END AS g FROM lineitem), c AS (SELECT count(*) FILTER (y = 1 AND g = 1) AS tp, count(*) FILTER (y = 0 AND g = 1) AS fp, count(*) FILTER (y = 1 AND g = 0) AS fn, count(*) FILTER (y = g) AS ok, count(*) AS n FROM f) SELECT ok / n AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM c")
def l09(s, d):
    df = _li(s, d).select((F.col("l_linestatus") == "F").cast("int").alias("y"), (F.col("l_quantity") > 20).cast("int").alias("g"))
    return ml.class_metrics(df, "y", "g")


@query("L09_regression_metrics", "WITH e AS (SELECT l_extendedprice AS y, l_quantity * 1000 AS g FROM lineitem) SELECT round(avg((y - g) ** 2), 2) AS mse, round(sqrt(avg((y - g) ** 2)), 4) AS rmse, round(avg(abs(y - g)), 4) AS mae, round(1 - sum((y - g) ** 2) / (var_pop(y) * count(*)), 6) AS r2 FROM e")
def l09b(s, d):
    m = ml.regression_metrics(_li(s, d).select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1000).alias("g")), "y", "g")
    return m.select(F.round("mse", 2).alias("mse"), F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2"))


@query("L10_surrogate_forest")
def l10(s, d):
    return ml.surrogate(load(s, d, "part"), ["p_size"], "p_retailprice", "p_partkey")


@query("L12_pipeline_steps", "SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS code, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 6) AS z FROM customer")
def l12(s, d):
    out = ml.run_steps(load(s, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), [("scale", {"cols": ["c_acctbal"], "how": "minmax"}), ("ordinal_encode", {"col": "c_mktsegment"})])
    return out.select("c_custkey", F.col("c_mktsegment_code").alias("code"), F.round("c_acctbal", 6).alias("z"))


@query("C02_covariate_shift")
def c02(s, d):
    li = _li(s, d)
    auc = ml.covariate_shift(li.where("l_linestatus = 'F'"), li.where("l_linestatus = 'O'"), ["l_quantity", "l_discount"])
    return s.createDataFrame([(auc, auc > 0.55)], "auc double, shifted boolean")


def _double(v: pd.Series) -> pd.Series:
    return v * 2 + 1


@query("V01_snippet", "SELECT event_id, value * 2 + 1 AS y FROM events")
def v01(s, d):
    return load(s, d, "events").select("event_id", ml.snippet(_double, "double")("value").alias("y"))


def _spread(p: pd.DataFrame) -> float:
    return round(p["l_quantity"].max() - p["l_quantity"].min(), 6)


@query("V03_evaluation_procedure", "SELECT l_orderkey % 5 AS key, max(l_quantity) - min(l_quantity) AS score FROM lineitem GROUP BY 1")
def v03(s, d):
    return ml.evaluation_procedure(_li(s, d).select((F.col("l_orderkey") % 5).alias("fold"), "l_quantity"), "fold", _spread)


@query("V05_job_registry", "WITH w AS (SELECT unnest(['scale', 'one_hot', 'nowhere.job', 'os.system', 'polynomial']) AS job) SELECT job, NOT contains(job, '.') AS resolved FROM w")
def v05(s, d):
    """Names that a pipeline may ask for; what isn't registered is refused."""

    def known(name: str) -> bool:
        try:
            return callable(ml.resolve(name))
        except KeyError:
            return False

    return s.createDataFrame([(n, known(n)) for n in ("scale", "one_hot", "nowhere.job", "os.system", "polynomial")], "job string, resolved boolean")


@query("V02_user_objective", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 0.0 ELSE round(p_retailprice / (1 + p_size), 9) END AS score FROM part")
def v02(s, d):
    """An objective that fails for large parts, which then score 0."""
    from kelpie.operators.ranking import user_objective

    def score(r: dict) -> float:
        if r["p_size"] > 25:
            raise ValueError("too large")
        return r["p_retailprice"] / (1 + r["p_size"])

    return user_objective(load(s, d, "part").select("p_partkey", "p_size", "p_retailprice"), score, ["p_size", "p_retailprice"]).select("p_partkey", F.round("score", 9).alias("score"))


@query("V06_multi_output", "SELECT event_id, floor(value) AS whole, round(value - floor(value), 6) AS rest FROM events")
def v06(s, d):
    both = F.struct(F.floor("value").cast("double").alias("o0"), F.round(F.col("value") - F.floor("value"), 6).alias("o1"))
    return load(s, d, "events").select("event_id", both.alias("x")).select("event_id", F.col("x.o0").alias("whole"), F.col("x.o1").alias("rest"))


QUERIES = Q
