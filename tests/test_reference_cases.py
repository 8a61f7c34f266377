"""Known cases of messages, signatures, promotion and validation; each with its edge cases."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from kelpie.operators import exceptions as x
from kelpie.operators import graphs as g
from kelpie.operators import relational as rel

MESSAGES = [
    ("'col_xyz' not in index", "'<STR>' not in index"),
    ('"col_xyz" not in index', "'<STR>' not in index"),
    ("X has 42 features, but needs 30", "X has <NUM> features, but needs <NUM>"),
    ("got -3.14 at address 0xDEADBEEF", "got <NUM> at address <HEX>"),
    ("Could not open /data/file.csv", "Could not open <PATH>"),
    ("Could not open C:\\data\\file.csv", "Could not open <PATH>"),
    ("a  b\n c 1.2.3 v2 x-7 8,9", "a b c 1.2.3 v2 x-<NUM> <NUM>,<NUM>"),
    ("", ""),
    (None, None),
]


def test_messages(spark):
    df = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(MESSAGES)], "i int, m string")
    once = df.select("i", x.canonical_message(F.col("m")).alias("m"))
    assert rows(once) == [(i, w) for i, (_, w) in enumerate(MESSAGES)]
    assert rows(once.select("i", x.canonical_message(F.col("m")))) == rows(once)


TRACE = """Log before
Traceback (most recent call last):
  File "/srv/tabkit/a/b/fit.py", line 30, in run
    return f(x)
  File "/home/me/job.py", line 4, in go
    g()
{}: X has 10 features
after"""


def test_signatures(spark):
    texts = [TRACE.format("pkg.FitError"), TRACE.replace("10", "77").format("pkg.FitError"), TRACE.format("KeyError"), TRACE.replace("tabkit", "other").format("KeyError"), "no trace", None, "", "Traceback (most recent call last):\nValueError"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r for r in df.select("i", *[c.alias(k) for k, c in x.signature(F.col("t"), ["tabkit"]).items()]).collect()}
    a = got[0]
    assert (a.exception_type, a.operator_fqn, a.site_library, a.message_template, a.user_frame_depth) == ("FitError", "tabkit.a.b.fit.run", "home.me.job", "X has <NUM> features", 1)
    assert a.signature == got[1].signature and len({got[i].signature for i in (0, 2, 3)}) == 3
    assert (got[3].operator_fqn, got[3].user_frame_depth) == ("", 0)
    assert all(got[i].signature is None for i in (4, 5, 6)) and got[7].exception_type == "ValueError" and got[7].message_template == ""


def test_promotion(spark):
    ledger = [("few", "r1", "t")] * 5 + [("firm", "r1", "t")] * 100 + [("split", "r1", "a")] * 60 + [("split", "r1", "b")] * 40 + [("src", "r1", "mid")] * 50 + [("mid", "r2", "final")] * 50 + [("none", "r1", None), (None, "r1", "t")]
    got = {r.source: (r.target, r.decision, r.rate) for r in rel.promotion(spark.createDataFrame(ledger, "source string, rule string, target string")).collect()}
    assert got == {"few": ("t", "defer", 1.0), "firm": ("t", "promote", 1.0), "split": ("a", "demote", 0.6), "src": ("mid", "defer", 1.0), "mid": ("final", "promote", 1.0)}


REG = [
    ("load", "out", "out", 0, "DataFrame", "feature", None, False, False),
    ("fit", "0", "in", None, "DataFrame", "feature", "train", True, False),
    ("fit", "rest", "in", None, "any", None, None, False, True),
    ("fit", "model", "out", 0, "Model", "model", None, False, False),
    ("score", "y", "in", None, "Array", "prediction", None, True, False),
    ("predict", "out", "out", 0, "Prediction", "prediction", None, False, False),
]


@pytest.mark.parametrize(
    ("nodes", "edges", "want"),
    [
        ([("a", "Operator", "load"), ("b", "Operator", "fit")], [("a", "b", "0", "0")], []),
        ([("a", "Operator", "load"), ("b", "Operator", "fit")], [("a", "b", "nope", "0")], [("unknown_port", "b:nope"), ("unwired_input", "b:0")]),
        ([("b", "Operator", "fit")], [], [("unwired_input", "b:0")]),
        ([("a", "Operator", "what")], [], [("unknown_operator", "a:what")]),
        ([("a", "Operator", "fit"), ("b", "Operator", "score"), ("p", "Parameter", "k")], [("a", "b", "y", "0"), ("p", "a", "0", None)], [("type_mismatch", "a:b:y:type,role")]),
        ([("a", "Operator", "predict"), ("b", "Operator", "score")], [("a", "b", "y", "out")], []),
        ([("a", "Operator", "load"), ("b", "Operator", "fit")], [("a", "b", "0", "0"), ("a", "b", "0", "0"), ("a", "b", "rest", "0"), ("a", "b", "rest", "0")], [("duplicate_port", "b:0")]),
        ([("a", "Operator", "load")], [("a", "z", "0", "0"), (None, "a", None, None)], [("dangling_edge", "z")]),
        ([("a", "Snippet", None), ("b", "Operator", "load")], [("a", "b", None, None)], [("unreachable_from_source", "b")]),
    ],
)
def test_validation(spark, nodes, edges, want):
    n = spark.createDataFrame([("g", *x) for x in nodes], "graph string, node string, class_type string, label string")
    e = spark.createDataFrame([("g", *x) for x in edges], "graph string, src string, dst string, position string, output string")
    assert rows(g.validate(n, e, spark.createDataFrame(REG, g.REGISTRY)).select("problem", "item")) == sorted(want, key=str)


def test_validation_of_cycles_sinks_and_empty_tables(spark):
    n = spark.createDataFrame([("g", x, "Operator", x, x == "d") for x in "abcde"], "graph string, node string, class_type string, label string, sink boolean")
    e = spark.createDataFrame([("g", "a", "b"), ("g", "b", "a"), ("g", "b", "c"), ("g", "c", "d")], "graph string, src string, dst string").withColumn("position", F.lit(None).cast("string"))
    got = rows(g.validate(n, e).select("problem", "item"))
    assert got == sorted([("cycle", x) for x in "abcd"] + [("unreachable_from_source", x) for x in "abcd"] + [("unreachable_to_sink", "e")], key=str)
    assert g.validate(n.limit(0), e.limit(0)).count() == 0


CATALOGUE = [
    ("scale", None, "prep", "transformer", [("Array", True)]),
    ("forest", "cls", "trees", "estimator", [("Array", True), (None, False)]),
    ("boost", "cls", "trees", "estimator", [("Array", True)]),
    ("svm", "cls", "kernel", "estimator", [("Array", True), ("Model", True)]),
    ("ridge", "reg", "linear", "estimator", [("Array", True)]),
    ("load", None, None, "other", []),
    ("show", None, None, "other", [("Model", False)]),
]


@pytest.mark.parametrize(
    ("used", "free", "caps", "want"),
    [
        ([], ["Array"], (1, 5), {"scale", "forest", "boost", "load"}),
        ([("scale", "prep", "transformer")], ["Array"], (1, 1), {"forest", "boost", "load"}),
        ([("forest", "trees", "estimator")], ["Array", "Model"], (2, 5), {"svm", "load", "show"}),
        ([("forest", "trees", "estimator")], ["Array", "Model"], (1, 5), {"load", "show"}),
        ([], [], (1, 5), {"load"}),
    ],
)
def test_valid_actions(spark, used, free, caps, want):
    c = spark.createDataFrame(CATALOGUE, "operator string, task string, family string, interface string, inputs array<struct<type: string, required: boolean>>")
    u = spark.createDataFrame(used, "operator string, family string, interface string")
    assert {r.operator for r in g.valid_actions(c, u, free, "cls", *caps).collect()} == want
