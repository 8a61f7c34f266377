"""Golden vectors of the data-quality metrics, decisions, profiles and mitigations."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from kelpie.operators import quality as q
from kelpie.operators import risk as k


def value(df, metric):
    return df.agg(metric.alias("v")).first()[0]


def test_row_level_metrics(spark):
    status = spark.createDataFrame([(" Open ",), ("closed",), ("BAD",), (None,)], "status string")
    assert value(status, q.syntactic_accuracy("status", ["OPEN", "CLOSED"])) == 0.5
    cur = spark.createDataFrame([("DE", "EUR"), ("DE", "USD"), ("US", "USD")], "country string, currency string")
    assert value(cur, q.semantic_accuracy(F.col("country") == "DE", F.col("currency") == "EUR")) == 0.5
    age = spark.createDataFrame([(10.0,), (20.0,), (130.0,), (None,)], "age double")
    assert value(age, q.range_accuracy("age", 0, 120)) == 0.5
    ab = spark.createDataFrame([(1, "x"), (None, "y"), (3, None)], "a int, b string")
    assert value(ab, q.overall_completeness(["a", "b"])) == pytest.approx(0.67, abs=0.01)
    assert value(ab, q.completeness("a")) == pytest.approx(0.67, abs=0.01)
    amount = spark.createDataFrame([(1.23,), (2.34,), (3.456,)], "amount double")
    assert value(amount, q.precision_share("amount", 2)) == pytest.approx(0.67, abs=0.01)
    num = spark.createDataFrame([(1, True), (2, False), (3, True)], "num int, flag boolean")
    assert value(num, q.format_match("num", "int")) == value(num, q.format_match("flag", "bool")) == 1.0


def test_records_labels_and_duplicates(spark):
    df = spark.createDataFrame([(1.0, "yes"), (None, ""), (1.0, "yes")], "feature double, label string")
    assert value(df, q.record_completeness(df, ["feature", "label"])) == pytest.approx(0.67, abs=0.01)
    assert value(df, q.label_completeness("label")) == pytest.approx(0.67, abs=0.01)
    assert value(df, q.occurrence("label", "yes", 2)) == 1.0
    assert q.duplicate_share(df, ["feature", "label"]).first()[0] == pytest.approx(0.33, abs=0.01)


def test_rules(spark):
    df = spark.createDataFrame([("DE", "EUR"), ("US", "USD"), ("FR", "EUR")], "country string, currency string")
    rules = [{"clauses": [{"column": "country", "op": "in", "value": ["DE", "FR"]}]}, {"clauses": [{"column": "currency", "value": "USD"}]}]
    assert value(df, q.rules_share(rules)) == pytest.approx(0.5)
    df = spark.createDataFrame([(25, "DE"), (17, "US"), (30, "FR")], "age int, country string")
    rule = {"operator": "AND", "clauses": [{"column": "age", "op": "gte", "value": 18}, {"column": "country", "op": "in", "value": ["DE", "FR"]}]}
    assert value(df, q.compliance(rule)) == pytest.approx(0.67, abs=0.01)
    assert q.list_share(["a", "flag", "missing"], ["a", "b", "flag"]) == pytest.approx(0.67, abs=0.01)


def test_grouped_metrics(spark):
    amount = spark.createDataFrame([(10.0,), (12.0,), (11.0,), (500.0,)], "amount double")
    assert q.outlier_share(amount, "amount").first()[0] == 0.25
    assert tuple(q.quantiles(amount, "amount", [0.25, 0.75]).first()) == (10.75, 134.0)
    g = spark.createDataFrame([("A", "yes"), ("A", "no"), ("B", "yes"), ("B", "yes")], "g string, l string")
    assert rows(q.label_proportions(g, "g", "l")) == [("A|B|no", 0.5), ("A|B|yes", -0.5)]
    assert q.label_divergence(g, "l", ["yes", "no"]).first()[0] == pytest.approx(0.05, abs=0.01)
    t = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("c", "y")], "target string, category string")
    assert value(t, q.distinct_share("target")) == 0.75 and value(t, q.distinct_share("category")) == 0.5
    assert rows(q.label_abundance(t, "target")) == [("a", 0.5), ("b", 0.25), ("c", 0.25)]
    assert q.category_effectiveness(t, "category", 2).first()[0] == 0.5
    xy = spark.createDataFrame([(0.0, 0.0, "a"), (0.1, 0.1, "a"), (9.0, 9.0, "b"), (9.1, 9.0, "b")], "x double, y double, target string")
    assert q.neighbour_label_consistency(xy, "x", "x", "y", "target", 1.0).first()[0] == 1.0
    n = spark.createDataFrame([(1,), (2,), (3,)], "num bigint")
    assert q.format_efficiency(n, ["num"]).first()[0] == pytest.approx(0.12, abs=0.01)


def test_decisions():
    assert q.decide_moving(0.88, [0.90, 0.92, 0.91, 0.89], 0.10, 3, 3) == "warning"
    assert q.decide_learned(0.70, [0.90, 0.91, 0.89, 0.92], 1.0, 0.25, 3) == "failed"
    assert q.decide_moving(0.96, [0.94], 0.95, 3, 3) == "passed"
    assert q.numbers([{"overall": 0.9}, 0.95, "bad", None, float("nan")]) == [0.9, 0.95]


def test_constant_decisions_and_table(spark):
    v = spark.createDataFrame([("a", None, 0.97), ("b", "x", 0.02)], "metric string, key string, value double")
    s = spark.createDataFrame([("a", 0.95, True), ("b", 0.05, False), ("c", 0.5, True)], "metric string, threshold double, higher boolean")
    assert {(r["check"], r.status) for r in q.check_table(v, s).collect()} == {("a", "passed"), ("b:x", "passed"), ("c", "pending")}
    assert {(r["check"], r.status) for r in q.check_table(v, s, 0.99).collect()} == {("a", "failed"), ("b:x", "passed"), ("c", "pending")}


def test_column_profile(spark):
    df = spark.createDataFrame([(25, "Ann", True, 0.1), (30, "Bob", False, 0.5), (35, "Cy", True, 1.25), (40, "Di", True, 2.5), (None, "Ed", False, 3.5)], "age int, name string, active boolean, score double")
    p = {r["column"]: r for r in q.column_profile(df).collect()}
    assert (p["age"].null_count, p["age"].null_pct, p["age"]["min"], p["age"]["max"], p["age"].unique_count) == (1, 0.2, 25.0, 40.0, 4)
    assert (p["name"].inferred_type, p["name"].scale, len(p["name"].sample_values)) == ("str", "categorical", 5)
    assert (p["active"].inferred_type, p["active"].scale) == ("bool", "binary")
    nulls = q.column_profile(spark.createDataFrame([(None,), (None,)], "a double")).first()
    assert (nulls.null_pct, nulls["min"], nulls.inferred_type) == (1.0, None, None)
    empty = q.column_profile(spark.createDataFrame([], "a double")).first()
    assert (empty.null_count, empty.unique_count, empty.null_pct) == (0, 0, 0.0)
    many = q.column_profile(spark.range(100).withColumnRenamed("id", "n")).first()
    assert len(many.sample_values) == 12
    texts = {r["column"]: r.inferred_type for r in q.column_profile(spark.createDataFrame([("1", "1.5", "true", "x")] * 9 + [("y", "2", "false", "3")], "i string, f string, b string, s string")).collect()}
    assert texts == {"i": "int", "f": "float", "b": "bool", "s": "str"}


def test_mitigations(spark):
    df = spark.createDataFrame([(15, "bad"), (35, "approved"), (105, "unknown"), (None, None)], "age int, status string")
    out = k.enforce(df, [{"column": "age", "op": "between", "value": [18, 100]}, {"column": "status", "op": "in", "value": ["approved", "pending"]}])
    assert rows(out) == rows(spark.createDataFrame([(18, "approved"), (35, "approved"), (100, "approved"), (None, None)], df.schema))
    f = spark.createDataFrame([("20", "1.5", "yes", "2024-01-02"), ("31.0", "2", "0", "x")], "age string, score string, active string, day string")
    assert rows(k.normalise_formats(f, {"age": "int", "score": "float", "active": "bool", "day": "datetime"})) == [(20, 1.5, True, "2024-01-02 00:00:00"), (31, 2.0, False, None)]
    r = spark.createDataFrame([(1.2345, 100.987), (2.3456, 200.111)], "rate double, amount double")
    assert rows(k.round_values(r, {"rate": 2, "amount": 1})) == [(1.23, 101.0), (2.35, 200.1)]
    loans = spark.createDataFrame([(1,), (0,), (1,), (None,)], "loan int")
    kept, log = k.remove_irrelevant(loans, {"clauses": [{"column": "loan", "value": 1}]})
    assert kept.count() == 2 and log.count() == 2
    cells = k.repair_log(spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, v string"), spark.createDataFrame([(1, "a"), (2, "c"), (3, "d")], "id int, v string"), "id", ["v"], "m")
    assert rows(cells) == [(2, "v", "b", "c", "m"), (3, "v", None, "d", "m")]
    fixed = k.repair_syntax(spark.createDataFrame([(1, "opne"), (2, "OPEN"), (3, "zzzzzz"), (4, None)], "id int, s string"), "id", "s", ["OPEN", "CLOSED"])
    assert rows(fixed) == [(1, "opne", "OPEN", "edit_distance"), (2, "OPEN", "OPEN", "exact"), (3, "zzzzzz", None, "review")]
    imputed = k.impute(spark.createDataFrame([(1.0, "a"), (3.0, "a"), (None, None)], "x double, s string"), ["x"], ["s"])
    assert rows(imputed) == [(1.0, "a"), (2.0, "a"), (3.0, "a")]


def test_statistics(spark):
    assert k.chi2_p(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert k.chi2_p(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert k.ks_p(0.0, 10, 10) == 1.0 and k.ks_p(0.9, 100, 100) < 1e-6
    x = spark.createDataFrame([("a",)] * 6 + [("b",)] * 5, "y string")
    assert tuple(k.class_imbalance(x, "y").first()) == (pytest.approx(1 / 11), 1)
    a, b = spark.createDataFrame([(1.0,), (2.0,)], "v double"), spark.createDataFrame([(3.0,), (4.0,), (None,)], "v double")
    assert k.ks_statistic(a, b, "v").first()[0] == 1.0
    z = spark.createDataFrame([(1, None, 5), (2, None, 5)], "a int, b int, c int")
    assert rows(k.zero_variance(z, ["a", "b", "c"])) == [("a", False), ("b", True), ("c", True)]


def test_check_dispatch(spark):
    df = spark.createDataFrame([("a", 1.0)] * 30 + [("b", 1.0)] * 5, "y string, c double")
    assert k.run_check("class_imbalance", df, "y") == (True, "class_imbalance found")
    assert k.run_check("zero_variance_feature_bias", df, ["c"])[0] and k.run_check("loss_of_ordinality_bias", df)[0]
    assert k.run_check("temporal_bias") == (False, "temporal_bias is not implemented")
    assert not k.run_check("sampling_bias", df, df, ["y", "c"])[0]
    shifted = df.withColumn("c", F.col("c") + F.rand(1))
    assert k.run_check("domain_shift_bias", df, shifted, ["c"])[0]
