"""Queries over profiles, data-quality metrics, decisions, risk checks and mitigations (P, Q, D, C, R)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.operators import quality as q
from kelpie.operators import risk as k
from kelpie.sources.tables import load

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


_EV = ["pipeline_id", "metric_value", "wall_clock_s", "error_message"]


@query("P01_missing_values", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing, round((count(*) - count({c})) / count(*), 6) AS ratio FROM evaluations" for c in _EV))
def p01(s, d):
    m = load(s, d, "evaluations").agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in _EV])
    x = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), (F.col("n") - F.col(c)).alias("missing"), F.round((F.col("n") - F.col(c)) / F.col("n"), 6).alias("ratio")) for c in _EV]))
    return m.select(x.alias("x")).select("x.*")


_OC = ["o_custkey", "o_orderstatus", "o_orderpriority"]


@query("P02_uniqueness", " UNION ALL ".join(f"SELECT '{c}' AS metric, round(count(DISTINCT {c}) / count({c}), 6) AS value FROM orders" for c in _OC))
def p02(s, d):
    return q.evaluate(load(s, d, "orders"), {c: F.round(F.count_distinct(F.col(c)) / F.count(c), 6) for c in _OC})


_LN = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("P03_numeric_range", " UNION ALL ".join(f"SELECT '{c}' AS column_name, min({c}) AS lo, max({c}) AS hi, round(avg({c}), 6) AS mean FROM lineitem" for c in _LN))
def p03(s, d):
    one = load(s, d, "lineitem").agg(*[f(c).alias(f"{n}_{c}") for c in _LN for f, n in ((F.min, "lo"), (F.max, "hi"), (F.avg, "mean"))])
    x = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"lo_{c}").alias("lo"), F.col(f"hi_{c}").alias("hi"), F.round(f"mean_{c}", 6).alias("mean")) for c in _LN]))
    return one.select(x.alias("x")).select("x.*")


@query("P04_column_profile", " UNION ALL ".join(f"""SELECT '{c}' AS "column", CASE WHEN avg(CASE WHEN try_cast(s AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0 END) < 0.9 THEN 'str' WHEN avg(CASE WHEN try_cast(s AS DOUBLE) = floor(try_cast(s AS DOUBLE)) AND NOT contains(s, '.') THEN 1.0 ELSE 0 END) >= 0.9 THEN 'int' ELSE 'float' END AS inferred_type,
  CASE WHEN count(DISTINCT s) <= 2 THEN 'binary' WHEN avg(CASE WHEN try_cast(s AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0 END) < 0.9 THEN 'categorical' WHEN avg(CASE WHEN try_cast(s AS DOUBLE) = floor(try_cast(s AS DOUBLE)) AND NOT contains(s, '.') THEN 1.0 ELSE 0 END) >= 0.9 AND count(DISTINCT s) <= 20 THEN 'ordinal' ELSE 'continuous' END AS scale,
  CAST(count(*) FILTER (s IS NULL) AS INTEGER) AS null_count, count(DISTINCT s) AS unique_count FROM (SELECT CAST({c} AS VARCHAR) AS s FROM events) t""" for c in ("event_id", "ts", "user_id", "event_type", "value", "props")))
def p04(s, d):
    p = q.column_profile(load(s, d, "events"))
    return p.select("column", "inferred_type", "scale", F.col("null_count").cast("int").alias("null_count"), "unique_count")


@query("P05_type_inference", "SELECT 'int' AS inferred_type, avg(CASE WHEN try_cast(json_extract_string(profile, '$.NumberOfFeatures') AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0.0 END) >= 0.9 AS numeric FROM datasets WHERE json_valid(profile) AND json_extract_string(profile, '$.NumberOfFeatures') IS NOT NULL")
def p05(s, d):
    v = load(s, d, "datasets").select(F.get_json_object("profile", "$.NumberOfFeatures").alias("v")).where("v is not null")
    p = q.column_profile(v)
    return p.select("inferred_type", F.col("is_numeric").alias("numeric"))


@query("P06_scale_inference", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CASE WHEN count(DISTINCT {c}) <= 2 THEN 'binary' WHEN typeof(any_value({c})) = 'VARCHAR' THEN 'categorical' WHEN typeof(any_value({c})) IN ('INTEGER', 'BIGINT') AND count(DISTINCT {c}) <= 20 THEN 'ordinal' ELSE 'continuous' END AS scale FROM part" for c in ("p_size", "p_brand", "p_retailprice")))
def p06(s, d):
    return q.column_profile(load(s, d, "part").select("p_size", "p_brand", "p_retailprice")).select("column", "scale")


@query("P07_summary", "SELECT count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS lo, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS hi FROM events")
def p07(s, d):
    e = load(s, d, "events")
    one = e.agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    z = q.quantiles(e, "value", [0.25, 0.5, 0.75]).select(F.round("q0", 6).alias("q1"), F.round("q1", 6).alias("q2"), F.round("q2", 6).alias("q3"))
    return one.crossJoin(z)  # one row each


@query("P08_class_metafeatures", "WITH c AS (SELECT count(*) / (SELECT count(*) FROM orders) AS p FROM orders GROUP BY o_orderpriority) SELECT count(*) AS NumberOfClasses, min(p) AS ClassProbabilityMin, round(avg(p), 9) AS ClassProbabilityMean, max(p) AS ClassProbabilityMax, round(sum(-p * ln(p)), 9) AS ClassEntropy FROM c")
def p08(s, d):
    e = q.entropy(load(s, d, "orders"), "o_orderpriority")
    return e.withColumn("ClassProbabilityMean", F.round("ClassProbabilityMean", 9)).withColumn("ClassEntropy", F.round("ClassEntropy", 9))


@query("P08_moments", "WITH m AS (SELECT avg(value) AS a FROM events), c AS (SELECT avg((value - a) ** 2) AS m2, avg((value - a) ** 3) AS m3, avg((value - a) ** 4) AS m4 FROM events, m) SELECT round(m3 / m2 ** 1.5, 6) AS skewness, round(m4 / m2 ** 2 - 3, 6) AS kurtosis FROM c")
def p08b(s, d):
    return load(s, d, "events").agg(F.round(F.skewness("value"), 6).alias("skewness"), F.round(F.kurtosis("value"), 6).alias("kurtosis"))


@query("P09_derived_metafeatures", "WITH c AS (SELECT count(*) / (SELECT count(*) FROM orders) AS p FROM orders GROUP BY o_orderstatus) SELECT CAST(round(1 / avg(p)) AS BIGINT) AS n_classes, round(1 - min(p) / max(p), 9) AS imbalance FROM c")
def p09(s, d):
    e = q.entropy(load(s, d, "orders"), "o_orderstatus")
    return e.select(F.round(1 / F.col("ClassProbabilityMean")).cast("bigint").alias("n_classes"), F.round(1 - F.col("ClassProbabilityMin") / F.col("ClassProbabilityMax"), 9).alias("imbalance"))


_ORDER = ["ClassEntropy", "KurtosisMax", "LogNumberOfInstances", "NumberOfFeatures", "NumberOfInstances"]
_JV = ", ".join(f"coalesce(try_cast(json_extract_string(profile, '$.{c}') AS DOUBLE), 'nan'::DOUBLE)" for c in _ORDER)
_VALID = "FROM datasets WHERE json_valid(profile) AND json_type(profile) = 'OBJECT'"


def _profiles(s, d):
    return load(s, d, "datasets").where(F.startswith(F.ltrim("profile"), F.lit("{")) & F.try_parse_json("profile").isNotNull()).select("id", "updated_at", q.profile_vector(F.col("profile"), _ORDER).alias("vec"))


@query("P10_profile_vector", f"SELECT DISTINCT id, updated_at, [{_JV}] AS vec {_VALID}")
def p10(s, d):
    return _profiles(s, d).distinct()


_P11 = ", ".join((f"ln(1 + {x})" if q.is_count_scale(c) else x) for c in _ORDER for x in [f"coalesce(try_cast(json_extract_string(profile, '$.{c}') AS DOUBLE), 0.0)"])


@query("P11_policy_vector", f"SELECT DISTINCT id, updated_at, list_transform([{_P11}], lambda x: round(x, 9)) AS vec {_VALID}")
def p11(s, d):
    v = F.transform(q.policy_vector(F.col("vec"), _ORDER), lambda x: F.round(x, 9))
    return _profiles(s, d).select("id", "updated_at", v.alias("vec")).distinct()


@query("P12_min_max", "WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), b AS (SELECT i, min(x) AS lo, max(x) AS hi FROM e GROUP BY i) SELECT vec_id, round(sum((x - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END), 6) AS total FROM e JOIN b USING (i) GROUP BY 1")
def p12(s, d):
    e = load(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    n = q.min_max_normalise(e, "vec_id", "v")
    return n.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def _one(name, sql, table, metric):
    @query(name, f"SELECT '{name[:3]}' AS metric, {sql} AS value FROM {table}")
    def f(s, d):
        return q.evaluate(load(s, d, table), {name[:3]: metric()})


_one("Q01_syntactic_accuracy", "avg(CASE WHEN upper(trim(source)) IN ('TUTORIAL', 'REVIEW', 'KB_NOTE') THEN 1.0 ELSE 0.0 END)", "documents", lambda: q.syntactic_accuracy("source", ["tutorial", "review", "kb_note"]))
_one("Q02_semantic_accuracy", "count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') / count(*) FILTER (l_returnflag = 'R')", "lineitem", lambda: q.semantic_accuracy(F.col("l_returnflag") == "R", F.col("l_linestatus") == "F"))
_one("Q04_range_accuracy", "avg(CASE WHEN metric_value BETWEEN 0 AND 1 THEN 1.0 ELSE 0.0 END)", "evaluations", lambda: q.range_accuracy("metric_value", 0, 1))
_one("Q05_value_completeness", "(count(metric_value) + count(wall_clock_s) + count(pipeline_id)) / (3 * count(*))", "evaluations", lambda: q.overall_completeness(["metric_value", "wall_clock_s", "pipeline_id"]))
_one("Q06_feature_completeness", "count(wall_clock_s) / count(*)", "evaluations", lambda: q.completeness("wall_clock_s"))
_one("Q08_label_completeness", "avg(CASE WHEN lang IS NOT NULL AND lang <> '' THEN 1.0 ELSE 0.0 END)", "documents", lambda: q.label_completeness("lang"))
_one("Q09_occurrence", "count(*) FILTER (o_orderstatus = 'F') / 1000.0", "orders", lambda: q.occurrence("o_orderstatus", "F", 1000))
_RULES = [{"clauses": [{"column": "l_quantity", "op": "gte", "value": 10}]}, {"operator": "AND", "clauses": [{"column": "l_discount", "op": "between", "value": [0.02, 0.06]}, {"column": "l_returnflag", "op": "in", "value": ["A", "N"]}]}]
_one("Q13_semantic_consistency", "(avg(CASE WHEN l_quantity >= 10 THEN 1.0 ELSE 0.0 END) + avg(CASE WHEN l_discount BETWEEN 0.02 AND 0.06 AND l_returnflag IN ('A', 'N') THEN 1.0 ELSE 0.0 END)) / 2", "lineitem", lambda: q.rules_share(_RULES))
_one("Q12_format_consistency", "count(try_cast(data_type AS BIGINT)) / count(data_type)", "datasets", lambda: q.format_match("data_type", "int"))
_one("Q19_compliance", "avg(CASE WHEN l_discount BETWEEN 0.02 AND 0.06 AND l_returnflag IN ('A', 'N') THEN 1.0 ELSE 0.0 END)", "lineitem", lambda: q.compliance(_RULES[1]))
_one("Q20_label_richness", "count(DISTINCT p_brand) / count(*)", "part", lambda: q.distinct_share("p_brand"))
_one("Q22_category_size_diversity", "count(DISTINCT p_type) / count(*)", "part", lambda: q.distinct_share("p_type"))
_one("Q23_feature_effectiveness", "avg(CASE WHEN l_quantity >= 10 THEN 1.0 ELSE 0.0 END)", "lineitem", lambda: q.compliance(_RULES[0]))
_one("Q25_label_effectiveness", "avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END)", "orders", lambda: q.compliance({"clauses": [{"column": "o_orderstatus", "value": "F"}]}))
_one("Q26_precision", "avg(CASE WHEN abs(round(wall_clock_s, 1) - wall_clock_s) < 1e-9 THEN 1.0 ELSE 0.0 END) FILTER (wall_clock_s IS NOT NULL)", "evaluations", lambda: q.precision_share("wall_clock_s", 1))
_one("Q28_record_relevance", "avg(CASE WHEN status = 'success' THEN 1.0 ELSE 0.0 END)", "evaluations", lambda: q.compliance({"clauses": [{"column": "status", "value": "success"}]}))


_TABLES = ["customer", "orders", "events", "part", "nation"]


@query("P13_target_guess", " UNION ALL ".join(f"SELECT '{t}' AS table_name, CASE WHEN (SELECT count(DISTINCT {c}) FROM {t}) <= 50 OR {'false' if n else 'true'} THEN '{c}' END AS target" for t, c, n in (("customer", "c_mktsegment", False), ("orders", "o_orderpriority", False), ("events", "props", False), ("part", "p_retailprice", True), ("nation", "n_regionkey", True))))
def p13(s, d):
    from kelpie.operators.jobs import target_of

    return s.createDataFrame([(t, target_of(load(s, d, t))) for t in _TABLES], "table_name string, target string")


@query("P14_type_map", "SELECT column_name AS \"column\", CASE WHEN regexp_matches(column_type, '^(TINYINT|SMALLINT|INTEGER|BIGINT|HUGEINT|FLOAT|DOUBLE|DECIMAL.*)$') THEN 'numeric' ELSE 'categorical' END AS kind FROM (DESCRIBE SELECT * FROM evaluations)")
def p14(s, d):
    return s.createDataFrame(list(q.type_map(load(s, d, "evaluations")).items()), "column string, kind string")


def _form(c: str, kind: str) -> str:
    if kind == "str":
        allowed = f"(SELECT list(v ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM part ORDER BY v LIMIT 12))"
        return f"SELECT '{c}' AS \"column\", NULL::DOUBLE[] AS range, 'str' AS expected_type, NULL::INTEGER AS decimals, {allowed} AS allowed_values, 'in' AS rule"
    return f"SELECT '{c}', [min({c})::DOUBLE, max({c})::DOUBLE], '{kind}', 0, NULL::VARCHAR[], 'between' FROM part"


@query("P15_form_defaults", " UNION ALL ".join(_form(c, t) for c, t in (("p_brand", "str"), ("p_type", "str"), ("p_size", "int"), ("p_retailprice", "float"))))
def p15(s, d):
    from kelpie.operators.jobs import form_defaults

    return form_defaults(load(s, d, "part"), ["p_brand", "p_type", "p_size", "p_retailprice"]).drop("rule_values")


_JOB = ["rows", "columns", "missing_ratio", "record_completeness", "label_completeness", "duplicate_ratio", "quality", "labelled_rows"]
_E8 = ["pipeline_id", "dataset_id", "metric_value", "wall_clock_s", "status"]


@query("P16_profile_job", f"WITH c AS (SELECT count(*) AS n, {' + '.join(f'count(*) - count({c})' for c in _E8)} AS miss, count(*) FILTER ({' AND '.join(f'{c} IS NOT NULL' for c in _E8)}) AS whole FROM evaluations), u AS (SELECT count(*) AS k FROM (SELECT DISTINCT {', '.join(_E8)} FROM evaluations)), m AS (SELECT n::DOUBLE AS n, miss / (n * 5) AS mr, whole / n AS rc, 1 - k / n AS dr FROM c, u) SELECT unnest(['rows', 'columns', 'missing_ratio', 'record_completeness', 'label_completeness', 'duplicate_ratio', 'quality', 'labelled_rows']) AS metric, unnest([n, 5.0, round(mr, 9), round(rc, 9), NULL, round(dr, 9), round((rc + 1 - mr + 1 - dr) / 3, 9), NULL]) AS value, unnest(['done', 'done', 'done', 'done', 'pending_input', 'done', 'done', 'pending_input']) AS status FROM m")
def p16(s, d):
    """No target is told, so what needs labels waits."""
    from kelpie.operators.jobs import profile_job

    return profile_job(load(s, d, "evaluations").select(*_E8), _JOB).withColumn("value", F.round("value", 9))


@query("Q03_outlier_share", "WITH b AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events) SELECT avg(CASE WHEN value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) THEN 1.0 ELSE 0.0 END) AS value FROM events, b")
def q03(s, d):
    return q.outlier_share(load(s, d, "events"), "value")


@query("Q07_record_completeness", "SELECT avg(CASE WHEN pipeline_id <> '' AND metric_value IS NOT NULL AND wall_clock_s IS NOT NULL THEN 1.0 ELSE 0.0 END) AS value FROM evaluations")
def q07(s, d):
    e = load(s, d, "evaluations")
    return e.agg(q.record_completeness(e, ["pipeline_id", "metric_value", "wall_clock_s"]).alias("value"))


@query("Q10_duplicate_share", "SELECT 1 - count(DISTINCT (id, run_id, metric_name)) / count(*) AS value FROM evaluations")
def q10(s, d):
    return q.duplicate_share(load(s, d, "evaluations"), ["id", "run_id", "metric_name"])


@query("Q11_neighbour_labels", "WITH e AS (SELECT embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label, vec_id FROM embeddings) SELECT count(*) FILTER (a.label = b.label) / count(*) AS value FROM e a JOIN e b ON a.vec_id <> b.vec_id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 0.01 ** 2")
def q11(s, d):
    e = load(s, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), "label")
    return q.neighbour_label_consistency(e, "vec_id", "x", "y", "label", 0.01)


@query("Q14_format_efficiency", "SELECT CASE WHEN min(c_custkey) >= -128 AND max(c_custkey) < 128 THEN 1 WHEN min(c_custkey) >= -32768 AND max(c_custkey) < 32768 THEN 2 WHEN min(c_custkey) >= -2147483648 AND max(c_custkey) < 2147483648 THEN 4 ELSE 8 END / 8.0 AS value FROM customer")
def q14(s, d):
    return q.format_efficiency(load(s, d, "customer"), ["c_custkey"])


@query("Q17_label_proportions", "WITH n AS (SELECT l_returnflag AS g, l_linestatus AS l, count(*) AS n FROM lineitem GROUP BY ALL), t AS (SELECT g, sum(n) AS t FROM n GROUP BY g), f AS (SELECT t.g, y.l, coalesce(n.n, 0) / t.t AS p FROM t CROSS JOIN (SELECT DISTINCT l FROM n) y LEFT JOIN n ON n.g = t.g AND n.l = y.l) SELECT a.g || '|' || b.g || '|' || a.l AS key, a.p - b.p AS value FROM f a JOIN f b ON a.l = b.l AND a.g < b.g")
def q17(s, d):
    return q.label_proportions(load(s, d, "lineitem"), "l_returnflag", "l_linestatus")


@query("Q18_label_divergence", "WITH s AS (SELECT l, coalesce(n, 0) / sum(coalesce(n, 0)) OVER () AS p FROM (VALUES ('A'), ('N'), ('R')) v(l) LEFT JOIN (SELECT l_returnflag AS l, count(*) AS n FROM lineitem GROUP BY 1) USING (l)) SELECT round(sum(0.5 * CASE WHEN p > 0 THEN p * log2(p / ((p + 1 / 3.0) / 2)) ELSE 0 END + 0.5 / 3.0 * log2((1 / 3.0) / ((p + 1 / 3.0) / 2))), 9) AS value FROM s")
def q18(s, d):
    return q.label_divergence(load(s, d, "lineitem"), "l_returnflag", ["A", "N", "R"]).select(F.round("value", 9).alias("value"))


@query("Q21_label_abundance", "SELECT o_orderpriority AS key, count(*) / (SELECT count(*) FROM orders) AS value FROM orders GROUP BY 1")
def q21(s, d):
    return q.label_abundance(load(s, d, "orders"), "o_orderpriority")


@query("Q24_category_effectiveness", "WITH c AS (SELECT dataset_id, count(*) AS n FROM evaluations WHERE dataset_id IS NOT NULL GROUP BY 1) SELECT count(*) FILTER (n >= 20) / count(*) AS value FROM c")
def q24(s, d):
    return q.category_effectiveness(load(s, d, "evaluations"), "dataset_id", 20)


@query("Q27_feature_relevance", "SELECT count(*) FILTER (w IN (SELECT column_name FROM (DESCRIBE SELECT * FROM lineitem))) / count(*) AS value FROM (VALUES ('l_tax'), ('l_quantity'), ('missing')) t(w)")
def q27(s, d):
    return s.range(1).select(F.lit(q.list_share(["l_tax", "l_quantity", "missing"], load(s, d, "lineitem").columns)).alias("value"))


@query("Q29_representativeness", "SELECT count(DISTINCT o_orderpriority) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH', 'none')) / 3.0 AS value FROM orders")
def q29(s, d):
    want = ["1-URGENT", "2-HIGH", "none"]
    return load(s, d, "orders").agg((F.count_distinct(F.when(F.col("o_orderpriority").isin(*want), F.col("o_orderpriority"))) / 3).alias("value"))


_SPECS = [("value_completeness", 0.95, True), ("outliers", 0.05, False), ("duplicates", 0.05, False), ("label_richness", 0.95, True)]
_VALUES = "WITH v AS (SELECT 'value_completeness' AS metric, NULL AS key, count(wall_clock_s) / count(*) AS value FROM evaluations UNION ALL SELECT 'duplicates', NULL, 1 - count(DISTINCT id) / count(*) FROM evaluations UNION ALL SELECT 'outliers', status, count(*) / (SELECT count(*) FROM evaluations) FROM evaluations GROUP BY status), s AS (SELECT * FROM (VALUES ('value_completeness', 0.95, true), ('outliers', 0.05, false), ('duplicates', 0.05, false), ('label_richness', 0.95, true)) t(metric, threshold, higher))"


def _values(s, d):
    e = load(s, d, "evaluations")
    no = F.lit(None).cast("string").alias("key")
    a = e.agg(q.completeness("wall_clock_s").alias("value")).select(F.lit("value_completeness").alias("metric"), no, "value")
    b = q.duplicate_share(e.select("id"), ["id"]).select(F.lit("duplicates").alias("metric"), no, "value")
    c = q.label_abundance(e, "status").select(F.lit("outliers").alias("metric"), F.col("key").cast("string").alias("key"), "value")
    return _union([a, b, c]), s.createDataFrame(_SPECS, "metric string, threshold double, higher boolean")


_STATUS = "CASE WHEN value IS NULL THEN 'pending' WHEN CASE WHEN higher THEN value >= %s ELSE value <= %s END THEN 'passed' ELSE 'failed' END AS status"
_NAME = "CASE WHEN key IS NOT NULL THEN s.metric || ':' || key ELSE s.metric END AS \"check\""


@query("D05_check_table", _VALUES + f" SELECT {_NAME}, value, CAST(threshold AS DOUBLE) AS threshold, {_STATUS % ('threshold', 'threshold')} FROM s LEFT JOIN v ON s.metric = v.metric")
def d05(s, d):
    return q.check_table(*_values(s, d))


@query("D06_threshold_override", _VALUES + f" SELECT {_NAME}, value, CAST(0.5 AS DOUBLE) AS threshold, {_STATUS % ('0.5', '0.5')} FROM s LEFT JOIN v ON s.metric = v.metric")
def d06(s, d):
    return q.check_table(*_values(s, d), override=0.5)


@query("D01_constant_threshold", "SELECT event_type, avg(value) AS mean, CASE WHEN avg(value) >= 50 THEN 'passed' ELSE 'failed' END AS status FROM events GROUP BY 1")
def d01(s, d):
    m = load(s, d, "events").groupBy("event_type").agg(F.avg("value").alias("mean"))
    return m.select("event_type", "mean", q.decide(F.col("mean"), F.lit(50.0)).alias("status"))


_DAILY = "d AS (SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS day, avg(value) AS v FROM events GROUP BY ALL)"


def _daily(s, d):
    return load(s, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))


@query("W05_moving_average", f"WITH {_DAILY} SELECT event_type, day, round(avg(v) OVER w, 6) AS past, CASE WHEN count(v) OVER w < 3 THEN 'short' WHEN avg(v) OVER w - v > 5 THEN 'failed' WHEN avg(v) OVER w - v > 0 THEN 'warning' ELSE 'passed' END AS status FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)")
def w05(s, d):
    """The mean of the three days before."""
    from pyspark.sql import Window

    w = Window.partitionBy("event_type").orderBy("day").rowsBetween(-3, -1)
    past = F.avg("v").over(w)
    st = F.when(F.count("v").over(w) < 3, "short").when(past - F.col("v") > 5, "failed").when(past - F.col("v") > 0, "warning").otherwise("passed")
    return _daily(s, d).select("event_type", "day", F.round(past, 6).alias("past"), st.alias("status"))


@query("W06_learned_baseline", f"WITH {_DAILY} SELECT event_type, day, CASE WHEN count(v) OVER w < 3 THEN 'short' WHEN (avg(v) OVER w - v) / stddev_pop(v) OVER w > 1 THEN 'failed' WHEN (avg(v) OVER w - v) / stddev_pop(v) OVER w > 0.25 THEN 'warning' ELSE 'passed' END AS status FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def w06(s, d):
    """Deviations from all days before."""
    from pyspark.sql import Window

    w = Window.partitionBy("event_type").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    z = (F.avg("v").over(w) - F.col("v")) / F.stddev_pop("v").over(w)
    st = F.when(F.count("v").over(w) < 3, "short").when(z > 1, "failed").when(z > 0.25, "warning").otherwise("passed")
    return _daily(s, d).select("event_type", "day", st.alias("status"))


_BEFORE = "PARTITION BY event_type ORDER BY day ROWS BETWEEN"


def _series(s, d, spec: dict) -> DataFrame:
    return q.decide_series(_daily(s, d), ["event_type"], [F.asc("day")], "v", spec).select("event_type", "day", "status", "decision")


@query("D02_moving_average", f"WITH {_DAILY} SELECT event_type, day, CASE WHEN count(v) OVER u < 4 THEN 'pending' WHEN avg(v) OVER w - v > 4 THEN 'failed' WHEN avg(v) OVER w - v > 0 THEN 'warning' ELSE 'passed' END AS status, 'moving_average' AS decision FROM d WINDOW w AS ({_BEFORE} 5 PRECEDING AND 1 PRECEDING), u AS ({_BEFORE} UNBOUNDED PRECEDING AND 1 PRECEDING)")
def d02(s, d):
    return _series(s, d, {"kind": "moving_average", "threshold": 4.0, "window": 5, "least": 4})


@query("D03_learned_model", f"WITH {_DAILY} SELECT event_type, day, CASE WHEN count(v) OVER u < 3 THEN 'pending' WHEN (v - avg(v) OVER u) / greatest(stddev_pop(v) OVER u, 1e-12) > 1 THEN 'failed' WHEN (v - avg(v) OVER u) / greatest(stddev_pop(v) OVER u, 1e-12) > 0.25 THEN 'warning' ELSE 'passed' END AS status, 'learned_model' AS decision FROM d WINDOW u AS ({_BEFORE} UNBOUNDED PRECEDING AND 1 PRECEDING)")
def d03(s, d):
    """Here less is better."""
    return _series(s, d, {"kind": "learned_model", "threshold": 1.0, "warning": 0.25, "least": 3, "higher": False})


@query("D04_if_then_else", f"WITH {_DAILY} SELECT event_type, day, CASE WHEN count(v) OVER u < 3 THEN CASE WHEN v >= 20 THEN 'passed' ELSE 'failed' END WHEN avg(v) OVER w - v > 20 THEN 'failed' WHEN avg(v) OVER w - v > 0 THEN 'warning' ELSE 'passed' END AS status, CASE WHEN count(v) OVER u < 3 THEN 'constant_threshold' ELSE 'moving_average' END AS decision FROM d WINDOW w AS ({_BEFORE} 3 PRECEDING AND 1 PRECEDING), u AS ({_BEFORE} UNBOUNDED PRECEDING AND 1 PRECEDING)")
def d04(s, d):
    return _series(s, d, {"kind": "if_then_else", "threshold": 20.0, "window": 3, "least": 3})


@query("D07_risk_pathways", _VALUES + ", p AS (SELECT * FROM (VALUES ('value_completeness', 'missing_data', 'linear', 0.99, 'below'), ('duplicates', 'leakage', 'tree', 0.001, 'above'), ('outliers', 'outlier_bias', 'linear', 0.02, 'above')) t(metric, risk, family, bound, side)) SELECT p.metric, coalesce(v.key, '') AS key, risk, family FROM p JOIN v ON p.metric = v.metric WHERE CASE side WHEN 'below' THEN v.value < bound ELSE v.value > bound END")
def d07(s, d):
    """Metric, risk and sensitive family by breach of a bound."""
    p = s.createDataFrame([("value_completeness", "missing_data", "linear", 0.99, "below"), ("duplicates", "leakage", "tree", 0.001, "above"), ("outliers", "outlier_bias", "linear", 0.02, "above")], "metric string, risk string, family string, bound double, side string")
    v, _ = _values(s, d)
    hit = F.when(F.col("side") == "below", F.col("value") < F.col("bound")).otherwise(F.col("value") > F.col("bound"))
    return v.join(F.broadcast(p), "metric").where(hit).select("metric", F.coalesce("key", F.lit("")).alias("key"), "risk", "family")


@query("C01_class_imbalance", "WITH n AS (SELECT count(*)::DOUBLE AS n FROM orders GROUP BY o_orderstatus) SELECT round(sum((n - e) ** 2 / e), 6) AS stat, count(*) - 1 AS dof FROM n, (SELECT sum(n) / count(*) AS e FROM n)")
def c01(s, d):
    return k.class_imbalance(load(s, d, "orders"), "o_orderstatus").select(F.round("stat", 6).alias("stat"), "dof")


@query("C03_selection_bias_ks", "WITH u AS (SELECT l_quantity AS v, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS x FROM lineitem), h AS (SELECT v, sum(x) AS x, sum(1 - x) AS y FROM u GROUP BY v), c AS (SELECT sum(x) OVER (ORDER BY v) / sum(x) OVER () AS fx, sum(y) OVER (ORDER BY v) / sum(y) OVER () AS fy FROM h) SELECT round(max(abs(fx - fy)), 9) AS d FROM c")
def c03(s, d):
    li = load(s, d, "lineitem")
    return k.ks_statistic(li.where("l_linestatus = 'F'"), li.where("l_linestatus = 'O'"), "l_quantity").select(F.round("d", 9).alias("d"))


_CHI = "WITH n AS (SELECT {a} AS a, {b} AS b, count(*)::DOUBLE AS n FROM {t} GROUP BY ALL), ra AS (SELECT a, sum(n) AS ra FROM n GROUP BY a), rb AS (SELECT b, sum(n) AS rb FROM n GROUP BY b), t AS (SELECT sum(n) AS t FROM n), dof AS (SELECT ((SELECT count(*) FROM ra) - 1) * ((SELECT count(*) FROM rb) - 1) AS dof), c AS (SELECT ra * rb / t AS e, abs(coalesce(n.n, 0) - ra * rb / t) AS g FROM ra CROSS JOIN rb CROSS JOIN t LEFT JOIN n ON n.a = ra.a AND n.b = rb.b) SELECT round(sum((CASE WHEN dof = 1 THEN g - least(0.5, g) ELSE g END) ** 2 / e), 6) AS stat, any_value(dof) AS dof FROM c, dof"


@query("C04_group_bias", _CHI.format(a="l_returnflag", b="l_linestatus", t="lineitem"))
def c04(s, d):
    return k.contingency(load(s, d, "lineitem"), "l_returnflag", "l_linestatus").select(F.round("stat", 6).alias("stat"), "dof")


@query("C05_sampling_bias", _CHI.format(a="o_orderstatus", b="o_orderkey % 2", t="orders"))
def c05(s, d):
    """Train against test: the halves of the orders by key."""
    o = load(s, d, "orders").select("o_orderstatus", (F.col("o_orderkey") % 2).alias("half"))
    return k.contingency(o, "o_orderstatus", "half").select(F.round("stat", 6).alias("stat"), "dof")


@query("C06_scaling_bias", "SELECT 'l_quantity' AS \"column\", round(abs(stddev_samp(l_quantity * 1.5) - stddev_samp(l_quantity)) / (stddev_samp(l_quantity) + 1e-8), 9) AS shift FROM lineitem UNION ALL SELECT 'l_tax', round(abs(stddev_samp(l_tax) - stddev_samp(l_tax)) / (stddev_samp(l_tax) + 1e-8), 9) FROM lineitem")
def c06(s, d):
    li = load(s, d, "lineitem")
    return k.scale_shift(li, li.withColumn("l_quantity", F.col("l_quantity") * 1.5), ["l_quantity", "l_tax"]).select("column", F.round("shift", 9).alias("shift"))


@query("C07_outlier_bias", "SELECT 'value' AS \"column\", round(stddev_samp(value) FILTER (value < 100) / stddev_samp(value), 9) AS sd, round((max(value) FILTER (value < 100) - min(value) FILTER (value < 100)) / (max(value) - min(value)), 9) AS range FROM events")
def c07(s, d):
    e = load(s, d, "events")
    return k.outlier_removal(e, e.where("value < 100"), ["value"]).select("column", F.round("ratio.sd", 9).alias("sd"), F.round("ratio.range", 9).alias("range"))


@query("C08_domain_shift", "WITH u AS (SELECT unnest(['l_quantity', 'l_tax']) AS \"column\", unnest([l_quantity, l_tax]) AS v, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS x FROM lineitem), h AS (SELECT \"column\", v, sum(x) AS x, sum(1 - x) AS y FROM u GROUP BY ALL), c AS (SELECT \"column\", sum(x) OVER (PARTITION BY \"column\" ORDER BY v) / sum(x) OVER (PARTITION BY \"column\") AS fx, sum(y) OVER (PARTITION BY \"column\" ORDER BY v) / sum(y) OVER (PARTITION BY \"column\") AS fy FROM h) SELECT \"column\", round(max(abs(fx - fy)), 9) AS d FROM c GROUP BY 1")
def c08(s, d):
    li = load(s, d, "lineitem")
    a, b = li.where("l_linestatus = 'F'"), li.where("l_linestatus = 'O'")
    return _union([k.ks_statistic(a, b, c).select(F.lit(c).alias("column"), F.round("d", 9).alias("d")) for c in ("l_quantity", "l_tax")])


@query("C10_zero_variance", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) <= 1 AS constant FROM lineitem WHERE l_returnflag = 'N'" for c in ("l_returnflag", "l_tax", "l_linestatus")))
def c10(s, d):
    return k.zero_variance(load(s, d, "lineitem").where("l_returnflag = 'N'"), ["l_returnflag", "l_tax", "l_linestatus"])


_FAIR = "f AS (SELECT l_returnflag AS g, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS y, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS p FROM lineitem)"


def _fair(s, d):
    return load(s, d, "lineitem").select(F.col("l_returnflag").alias("g"), (F.col("l_linestatus") == "F").cast("int").alias("y"), (F.col("l_quantity") > 25).cast("int").alias("p"))


@query("C09_loss_of_ordinality", "SELECT column_name AS \"column\" FROM (DESCRIBE SELECT * FROM orders) WHERE column_type = 'VARCHAR'")
def c09(s, d):
    return s.createDataFrame([(c,) for c in k.unordered_categories(load(s, d, "orders"))], "column string")


@query("C12_text_guardrails", " UNION ALL ".join(f"SELECT '{n}' AS \"check\", count(*) FILTER (regexp_matches(text, '{p}')) AS hits FROM documents" for n, p in k.GUARDRAILS.items()))
def c12(s, d):
    return k.scan_text(load(s, d, "documents"), "text")


#: Fixed value: the chi-square quantile of 0.95 at two degrees of freedom.
_CRITICAL = 5.991464547107979


@query("C13_check_dispatch", "WITH n AS (SELECT count(*)::DOUBLE AS n FROM lineitem GROUP BY l_returnflag), i AS (SELECT sum(n * n) * count(*) / sum(n) - sum(n) AS stat FROM n), g AS (" + _CHI.format(a="l_returnflag", b="l_linestatus", t="lineitem") + f") SELECT 'class_imbalance' AS \"check\", stat > {_CRITICAL} AS found FROM i UNION ALL SELECT 'group_bias', stat > {_CRITICAL} FROM g UNION ALL SELECT 'zero_variance_feature_bias', count(DISTINCT l_tax) <= 1 FROM lineitem UNION ALL SELECT 'data_leakage', false")
def c13(s, d):
    li = load(s, d, "lineitem")
    runs = [("class_imbalance", (li, "l_returnflag")), ("group_bias", (li, "l_returnflag", "l_linestatus")), ("zero_variance_feature_bias", (li, ["l_tax"])), ("data_leakage", ())]
    return s.createDataFrame([(n, k.run_check(n, *a)[0]) for n, a in runs], "check string, found boolean")


@query("C14_fairness", f"WITH {_FAIR}, b AS (SELECT avg(p - y + 1) AS mu FROM f) SELECT round(avg(p) FILTER (g <> 'A') / avg(p) FILTER (g = 'A'), 6) AS disparate_impact, round(avg(p) FILTER (g <> 'A') - avg(p) FILTER (g = 'A'), 6) AS statistical_parity, round(avg(p) FILTER (g <> 'A' AND y = 1) - avg(p) FILTER (g = 'A' AND y = 1), 6) AS equal_opportunity, round(avg(CASE WHEN p - y + 1 > 0 THEN (p - y + 1) / mu * ln((p - y + 1) / mu) ELSE 0 END), 6) AS theil FROM f, b")
def c14(s, d):
    out = k.fairness(_fair(s, d), "g", "A", "y", "p")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("C15_reweighing", f"WITH {_FAIR}, n AS (SELECT g, y, count(*)::DOUBLE AS n FROM f GROUP BY ALL) SELECT g, y, round(sum(n) OVER (PARTITION BY g) * sum(n) OVER (PARTITION BY y) / sum(n) OVER () / n, 9) AS weight FROM n")
def c15(s, d):
    return k.reweigh(_fair(s, d), "g", "y").withColumn("weight", F.round("weight", 9))


@query("R01_remove_duplicates", "SELECT count(*) AS n, count(DISTINCT id) AS ids FROM (SELECT DISTINCT id, run_id, metric_name FROM evaluations)")
def r01(s, d):
    e = k.remove_duplicates(load(s, d, "evaluations").select("id", "run_id", "metric_name"), ["id", "run_id", "metric_name"])
    return e.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))


@query("R02_remove_missing", "SELECT id, metric_value, wall_clock_s FROM evaluations WHERE metric_value IS NOT NULL AND wall_clock_s IS NOT NULL AND NOT isnan(metric_value)")
def r02(s, d):
    return k.remove_missing(load(s, d, "evaluations").select("id", "metric_value", "wall_clock_s"), ["metric_value", "wall_clock_s"])


@query("R03_impute", "WITH m AS (SELECT avg(wall_clock_s) AS a FROM evaluations), o AS (SELECT source AS mode FROM evaluations WHERE source IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, source LIMIT 1) SELECT id, round(coalesce(wall_clock_s, a), 6) AS wall_clock_s, coalesce(source, mode) AS source FROM evaluations, m, o")
def r03(s, d):
    return k.impute(load(s, d, "evaluations").select("id", "wall_clock_s", "source"), ["wall_clock_s"], ["source"]).select("id", F.round("wall_clock_s", 6).alias("wall_clock_s"), "source")


@query("R04_remove_missing_label", "SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL")
def r04(s, d):
    return k.remove_missing(load(s, d, "documents").select("doc_id", "lang"), ["lang"])


@query("R05_impute_outliers", "WITH m AS (SELECT avg(value) FILTER (value BETWEEN 5 AND 80) AS a FROM events) SELECT event_id, round(CASE WHEN value IS NULL OR value BETWEEN 5 AND 80 THEN value ELSE a END, 6) AS value FROM events, m")
def r05(s, d):
    return k.impute_outliers(load(s, d, "events").select("event_id", "value"), "value", 5, 80).withColumn("value", F.round("value", 6))


_LANGS = ["EN", "DE", "FR", "ES", "JA", "ZH"]


@query("R06_repair_syntax", "WITH a AS (SELECT unnest(['EN', 'DE', 'FR', 'ES', 'JA', 'ZH']) AS a), v AS (SELECT DISTINCT lang AS old FROM documents WHERE lang IS NOT NULL), x AS (SELECT old, a, levenshtein(upper(trim(old)), a) AS d FROM v, a), b AS (SELECT old, min(d) AS d, arg_min(a, (d, a)) AS a, count(*) FILTER (d = md) AS ties FROM (SELECT *, min(d) OVER (PARTITION BY old) AS md FROM x) GROUP BY old) SELECT o.doc_id, o.lang AS old, CASE WHEN d = 0 OR (d <= 2 AND ties = 1) THEN b.a END AS new, CASE WHEN d = 0 THEN 'exact' WHEN d > 2 OR ties > 1 THEN 'review' ELSE 'edit_distance' END AS method FROM documents o JOIN b ON o.lang = b.old")
def r06(s, d):
    return k.repair_syntax(load(s, d, "documents"), "doc_id", "lang", _LANGS)


@query("R07_enforce_rules", "SELECT event_id, least(greatest(value, 10), 50) AS value, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'click' END AS event_type FROM events")
def r07(s, d):
    return k.enforce(load(s, d, "events").select("event_id", "value", "event_type"), [{"column": "value", "op": "between", "value": [10.0, 50.0]}, {"column": "event_type", "op": "in", "value": ["click", "view"]}])


@query("R08_normalise_formats", "SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS price, o_orderstatus = 'F' AS done, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS day FROM orders")
def r08(s, d):
    o = load(s, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("string").alias("price"), F.when(F.col("o_orderstatus") == "F", "yes").otherwise("0").alias("done"), F.col("o_orderdate").cast("string").alias("day"))
    return k.normalise_formats(o, {"price": "int", "done": "bool", "day": "datetime"})


@query("R09_round_values", "SELECT event_id, round(value, 1) AS value FROM events")
def r09(s, d):
    return k.round_values(load(s, d, "events").select("event_id", "value"), {"value": 1})


@query("R10_remove_irrelevant", "SELECT id, status, 'remove_irrelevant_records' AS method FROM evaluations WHERE status <> 'success' OR status IS NULL")
def r10(s, d):
    return k.remove_irrelevant(load(s, d, "evaluations").select("id", "status"), {"clauses": [{"column": "status", "value": "success"}]})[1]


@query("R11_repair_log", "SELECT event_id, 'event_type' AS \"column\", event_type AS old, 'click' AS new, 'enforce_compliance_rules' AS method FROM events WHERE event_type NOT IN ('click', 'view')")
def r11(s, d):
    e = load(s, d, "events").select("event_id", "event_type")
    return k.repair_log(e, k.enforce(e, [{"column": "event_type", "op": "in", "value": ["click", "view"]}]), "event_id", ["event_type"], "enforce_compliance_rules")


QUERIES = Q
