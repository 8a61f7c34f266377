"""Orphan references, wide tables, shredding, filters, graphs, ranking: small cases with nulls, ties, repeats and empty tables."""

import math
import random
from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kelpie.operators import docstore as doc
from kelpie.operators import graphs as g
from kelpie.operators import ranking as rk
from kelpie.operators import relational as rel
from kelpie.operators import shred
from kelpie.operators import similarity as sim
from kelpie.operators.latest import latest
from kelpie.operators.references import layout, orphans, report
from kelpie.operators.widen import attributes, cells, column_names, widen

PARENTS = "ref_table string, key string, first_at bigint, present boolean, deleted boolean"
REFS = "id bigint, ref_table string, key string, at bigint, period string, key2 string"


def brute(refs, parents):
    known = {(t, k): (a, p, g) for t, k, a, p, g in parents if k is not None}
    out = set()
    for i, t, k, at, period, _ in refs:
        if k is None:
            continue
        born, there, gone = known.get((t, k), (None, False, False))
        if there:
            if born is not None and at is not None and born > at:
                out.add((i, t, "late", period))
        else:
            out.add((i, t, "deleted" if gone else "missing", period))
    return sorted(out, key=str)


def test_orphans_against_brute_force_with_a_hot_key(spark):
    r = random.Random(3)
    parents = [(t, f"k{i:04d}", r.choice([None, r.randrange(100)]), r.random() < 0.8, r.random() < 0.3) for t in ("p", "d") for i in range(300)] + [("p", "x" * 400, 5, True, False), ("p", "é\x00", 1, True, False)]
    refs = [(i, r.choice(["p", "d"]), "k0007" if r.random() < 0.4 else r.choice([f"k{r.randrange(400):04d}", "x" * 400, "x" * 399, "é\x00", "é", None]), r.choice([None, r.randrange(100)]), "2024-01", "clash") for i in range(2000)]
    got = orphans(spark.createDataFrame(refs + refs[:200], REFS), spark.createDataFrame(parents, PARENTS), ranges=7, refs_per_task=60)
    assert rows(got) == brute(refs, parents)
    assert sum(x[-1] for x in rows(report(got))) == len(brute(refs, parents))


def test_orphans_of_empty_tables(spark):
    none, ref = spark.createDataFrame([], PARENTS), spark.createDataFrame([(1, "p", "a", None, "none", "")], REFS)
    assert rows(orphans(ref, none)) == [(1, "p", "missing", "none")]
    assert rows(orphans(ref.limit(0), none)) == []


def test_widen_takes_the_latest_usable_value(spark):
    data = [("r1", "acc", 0.5, 1, 1), ("r1", "acc", 0.6, None, 2), ("r1", "acc", float("nan"), 9, 3), ("r1", "n", 3.0, 1, 4), ("r1", "n", 3.5, 1, 5), ("r2", None, 1.0, 1, 6), ("r2", "flag", 1.0, 2, 7), ("r2", "flag", 0.0, 2, 8), (None, "acc", 1.0, 1, 9), ("r3", "acc", float("inf"), 1, 10), ("r1", "r1", 7.0, 1, 11)]
    df = spark.createDataFrame(data, "run_id string, metric string, v double, at bigint, id bigint").withColumn("acc", F.lit("clash"))
    names = attributes(df, "metric")
    wide = widen(df, "run_id", "metric", "v", ["at", "id"], "id", {"n": "bigint", "flag": "boolean"}, names)
    got = {r.run_id: r for r in wide.collect()}
    assert set(got) == {"r1", "r2", "r3"}
    assert (got["r1"].acc, got["r1"].acc__src, got["r1"].n, got["r1"].n__src) == (0.5, 1, None, 5)
    assert (got["r2"].flag, got["r2"].flag__src, got["r3"].acc) == (False, 8, None)
    assert rows(cells(wide, "run_id", names)) == [("r1", "acc", 1), ("r1", "n", 5), ("r1", "r1", 11), ("r2", "flag", 8)]
    assert widen(df.limit(0), "run_id", "metric", "v", ["at", "id"]).count() == 0


def test_widen_entities_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(600).select(F.concat(F.lit("e"), (F.col("id") / 5).cast("int")).alias("e"), F.concat(F.lit("a"), F.col("id") % 5).alias("a"), F.col("id").cast("double").alias("v"), "id")
        got = widen(df, "e", "a", "v", ["id"]).collect()
        assert len(got) == 120 and all(int(r.e[1:]) * 5 + i == r[f"a{i}"] for r in got for i in range(5))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_widen_with_very_many_attributes_stays_small():
    """20,000 attributes, few of them in a row: only what occurs is filled, and batches are cut by their cells."""
    import tracemalloc

    from kelpie.operators import widen as w

    cols = [f"a{i}" for i in range(20_000)]
    n = 2000
    e = pa.array([f"e{i:05d}" for i in range(n) for _ in range(3)])
    at = np.array([sorted({i % 7, 5000 + i % 11, 19_999}) for i in range(n)], np.int32).ravel()
    batch = pa.RecordBatch.from_arrays([e, pa.array(at), pa.array(np.arange(3 * n)), pa.array(np.arange(3 * n, dtype=float))], ["_e", "_a", "_s", "_v"])
    seen, most = 0, 0
    tracemalloc.start()
    for out in w._builder("run", cols, ["double"] * len(cols), True)(iter([batch])):
        most = max(most, out.num_rows)
        got = out.column(out.schema.get_field_index("a19999")).to_pylist()
        assert got == [float(3 * (seen + i) + 2) for i in range(out.num_rows)] and out.column(out.schema.get_field_index("a17")).null_count == out.num_rows
        seen += out.num_rows
    assert seen == n and most * len(cols) <= w._CELLS and tracemalloc.get_traced_memory()[1] < 1 << 30
    tracemalloc.stop()


def test_layout_isolates_a_hot_key_and_spreads_it():
    parents = sorted(f"k{i:05d}".encode() for i in range(5000))
    refs = sorted([b"k00700"] * 3000 + [f"k{i % 5000:05d}".encode() for i in range(6000)])
    cuts, salts, place = layout(parents, refs, 9_000_000, 10, 900_000)
    at = bisect_right(cuts, b"k00700")
    assert cuts[at - 1] == b"k00700" and cuts[at] == b"k00700\x01" and salts[at] == 3 and max(s for i, s in enumerate(salts) if i != at) == 1
    first = sum(salts[:at])
    assert len({place[first + i] for i in range(3)}) == 3 and set(place) <= set(range(10))
    assert layout([], [], 0, 4, 1) == ([], [1], [0])


def test_column_names_are_distinct():
    assert column_names("run", ["Run", "a", "A", "a__src"]) == ["Run_2", "a", "A_2", "a__src_2"]


def test_latest_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", None, "x"), ("a", 1, "y"), ("a", 1, "z"), ("a", 1, "z"), ("b", None, None), (None, 5, "q")], "id string, at int, v string")
    assert rows(latest(df, "id", ["at"], ["v"])) == [("a", "z"), ("b", None)]


JSON = st.recursive(st.just({"class_type": "Operator", "name": "x"}), lambda kids: st.builds(lambda c, e, io: {"children": c, "internal_edges": e, "ioMap": io}, st.one_of(st.dictionaries(st.sampled_from(["a", "b", "c"]), kids, max_size=3), st.lists(kids.map(lambda k: k | {"id": "q"}), max_size=2)), st.lists(st.just({"source": "s"}), max_size=2), st.dictionaries(st.sampled_from(["in", "out"]), st.just({"direction": "input"}), max_size=2)), max_leaves=12)


def walk(nodes, pre, out):
    for k, v in nodes.items() if isinstance(nodes, dict) else [(x.get("id"), x) for x in nodes or []]:
        path = f"{pre}/{k}" if pre else k
        out["node"].append(path)
        out["edge"] += [f"{path}#{i}" for i, _ in enumerate(v.get("internal_edges") or [])]
        out["port"] += [f"{path}@{h}" for h in v.get("ioMap") or {}]
        walk(v.get("children"), path, out)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.dictionaries(st.sampled_from(["n1", "n2", "n3"]), JSON, max_size=3), max_size=5))
def test_shredding_round_trip(docs):
    want, got = defaultdict(list), defaultdict(list)
    for i, d in enumerate(docs):
        one = defaultdict(list)
        walk(d, "", one)
        for k, v in one.items():
            want[k] += [(i, p) for p in v]
    for kind, cols in shred.tables(list(range(len(docs))), [{"nodes": d} for d in docs], shred.NODES):
        got[kind] += list(zip(cols["owner_id"], cols["path"]))
    assert {k: sorted(v) for k, v in want.items() if v} == {k: sorted(v) for k, v in got.items()}


def test_flatten_of_odd_texts(spark):
    texts = [("a", None), ("b", ""), ("c", '{"nodes": {"n": {"na'), ("d", '"{\\"nodes\\": [{\\"id\\": \\"n\\", \\"name\\": \\"f\\"}, null]}"'), ("e", "null"), ("f", "[]"), ("g", '{"nodes": {"n1": null, "n2": {"name": 5}}, "edges": [null, {"source": "n2"}]}')]
    df = spark.createDataFrame(texts, "id string, dag string").withColumn("path", F.lit("clash"))
    assert rows(shred.flatten(df, "id", "dag", "dag").select("owner_id", "kind", "path")) == [("d", "node", "n"), ("g", "edge", "#1"), ("g", "node", "n2")]
    assert rows(shred.flatten(df, "id", "dag", "dag", "node", ["name"]).select("owner_id", "name")) == [("d", "f"), ("g", "5")]
    assert shred.flatten(df.limit(0), "id", "dag", "dag").count() == 0


def _spelled(x, r, names):
    """The same document with its field names spelled at random; names of items stay."""
    if isinstance(x, list):
        return [_spelled(v, r, names) for v in x]
    if not isinstance(x, dict):
        return x
    out = {}
    for k, v in x.items():
        if k in names:
            k = r.choice(["_", "-", " ", ""]).join(r.choice([str.upper, str.lower, str.title])(w) for w in k.split("_"))
        out[k] = _spelled(v, r, names)
    return out


def test_any_spelling_of_the_fields_gives_the_same_tables():
    names = {"nodes", "edges", "children", "internal_edges", "io_map", "id", "name", "class_type", "source", "target", "direction", "internal_node_id", "categories", "stats", "range", "min", "value", "count", "inferred_type", "class_occurences", "label", "pca", "components", "ratio"}
    dag = {"nodes": {"h_1": {"name": "g", "class_type": "Group", "children": [{"id": "n2", "name": "x"}, {"id": "n3", "children": {"N_4": {"name": "deep"}}}], "internal_edges": [{"source": "n2", "target": "n3"}, None, {"source": "n3"}], "io_map": {"in_A": {"direction": "in", "internal_node_id": "n2"}}}}, "edges": [{"source": "h_1", "target": "q"}]}
    cols = [{"name": "c_1", "inferred_type": "str", "stats": {"range": {"min": 2}, "categories": [{"value": "a", "count": 3}]}}, {"name": "c-2", "min": 1, "categories": ["x", None, "y"]}, {"name": "c3", "stats": {}}]
    prof = {"class_occurences": [{"label": "A_b", "count": 2}], "pca": {"components": [{"ratio": 0.5}]}}
    r = random.Random(5)

    def flat(doc, specs):
        return [(k, {n: v for n, v in c.items()}) for s in specs for k, c in shred.tables(["o"], [doc], s)]

    for doc, shape in ((dag, "dag"), (cols, "columns"), (prof, "profile")):
        specs = [s for s in shred.SHAPES[shape] if s.name != "scalar"]
        want = flat(doc, specs)
        assert want
        for _ in range(30):
            assert flat(_spelled(doc, r, names), specs) == want
    got = dict(flat(cols, shred.SHAPES["columns"]))
    assert got["column"]["min"] == [2.0, 1.0, None] and got["category"]["path"] == ["c_1#0", "c-2#0", "c-2#2"]


def test_levels_are_those_of_each_leaf_path():
    docs = [{"a": {"min": 1}, "b": {"stats": {"range": {"min": 2}}}, "c": {"stats": {}}, "d": {}}, None, {"e": {"stats": {"range": {}}}}]
    (_, leaves), *_ = shred.shred(docs, shred.COLUMNS, {"min"})
    direct, nested = leaves["min"]
    assert direct.rep.tolist() == nested.rep.tolist() == [0, 1, 1, 1, 0, 0]
    assert direct.dfn.tolist() == [2, 1, 1, 1, 0, 1] and direct.top == 2 and direct.values == [1]
    assert nested.dfn.tolist() == [1, 4, 2, 1, 0, 3] and nested.top == 4 and nested.values == [2]
    assert shred.column(nested, 1) == [None, 2, None, None, None]


def test_filters(spark):
    df = spark.createDataFrame([("1", '{"a": {"b": 1}, "n": null, "t": "X1"}'), ("2", '{"a": {"b": 2}, "t": "y"}'), ("3", "not json"), ("4", None)], "id string, data string")
    ids = lambda spec: [r.id for r in doc.find(df, spec).orderBy("id").collect()]
    assert ids({"a.b": 1}) == ["1"] and ids({"a.b": {"$gt": 1}}) == ["2"] and ids({"a.b": {"$ne": 1}}) == ["2"]
    assert ids({"n": {"$exists": True}}) == ["1"] and ids({"_id": "2"}) == ["2"] and ids({"t": {"$regex": "^x", "$options": "i"}}) == ["1"]
    assert ids({"a.b": {"$in": []}}) == [] and ids({"a.b": {"$nin": []}}) == ["1", "2", "3", "4"]
    assert ids({"$or": [{"a.b": 2}, {"t": "X1"}]}) == ["1", "2"]
    for bad in ({"a": {"$foo": 1}}, {"$foo": []}, {"_id": {"$gt": 1}}):
        with pytest.raises(NotImplementedError):
            doc.where(bad)
    with pytest.raises(ValueError):
        doc.project(df, {"a": 1, "t": 0})
    assert [r.data for r in doc.project(df, {"t": 1}).orderBy("id").collect()][:2] == ['{"t":"X1"}', '{"t":"y"}']
    up = doc.update(df, {"a.b": 2}, {"$set": {"t": "z"}, "$push": {"l": {"$each": [1, 2]}}, "$unset": {"a": 1}, "$addToSet": {"s": "q"}})
    assert [r.data for r in up.orderBy("id").collect()][1] == '{"l":[1,2],"s":["q"],"t":"z"}'


def test_win_rates(spark):
    df = spark.createDataFrame([("p", "p"), ("p", "q"), ("q", None), (None, None)], "compared_id string, preferred_id string")
    assert rows(rel.win_rates(df)) == [("p", 1, 2, 0.5), ("q", 1, 2, 0.5)]


def test_duration_stats_defaults_and_ranks(spark):
    assert tuple(rel.duration_stats(spark.createDataFrame([], "s double"), "s").first())[:4] == (0, 30.0, 45.0, 120.0)
    got = rel.duration_stats(spark.createDataFrame([(float(i),) for i in range(1, 11)] + [(-1.0,), (None,)], "s double"), "s").first()
    assert (got.n, got.median, got.p75, got.p95, got["min"], got["max"]) == (10, 6.0, 8.0, 10.0, 1.0, 10.0)


def test_fronts_and_skyline(spark):
    r = random.Random(1)
    pts = [(i, float(r.randrange(12)), float(r.randrange(12)), float(r.randrange(12))) for i in range(400)]
    df = spark.createDataFrame(pts, "id int, a double, b double, c double")
    dom = lambda x, y: all(p >= q for p, q in zip(x[1:], y[1:])) and x[1:] != y[1:]
    want = sorted(y[0] for y in pts if not any(dom(x, y) for x in pts))
    assert sorted(x.id for x in rk.pareto_front(df.repartition(5), "id", ["a", "b", "c"]).collect()) == want
    got = {x.id: x.front for x in rk.fronts(df, "id", ["a", "b", "c"]).collect()}
    assert sorted(i for i, f in got.items() if f == 0) == want
    by = {p[0]: p for p in pts}
    assert all(any(got[x[0]] == f - 1 and dom(x, by[i]) for x in pts) for i, f in got.items() if f)
    with pytest.raises(Exception, match="a pool of more than 10"):
        rk.fronts(df, "id", ["a"], pool=10).collect()


def test_js_fitness(spark):
    fit = lambda data: [r.fitness for r in rk.js_fitness(spark.createDataFrame(data, "id int, a double, b double"), ["a", "b"]).orderBy("id").collect()]
    assert fit([(1, 0.5, 0.5), (2, 0.5, 0.5)]) == [pytest.approx(1), pytest.approx(1)]
    one, two = fit([(1, 1.0, 1.0), (2, 1.0, 0.0)])
    assert one > two
    assert fit([(1, 0.0, 0.0)]) == [0.0] and fit([(1, 3.0, 1.0)]) == [pytest.approx(1)]


def test_class_hash_ignores_ids_and_values(spark):
    def h(ids, value, second="fit"):
        n = spark.createDataFrame([(1, ids[0], "load", value), (1, ids[1], second, None)], "graph int, node string, label string, v string")
        e = spark.createDataFrame([(1, ids[0], ids[1])], "graph int, src string, dst string")
        return g.class_hash(n, e).first().hash, g.class_hash(n, e, "v").first().hash

    a, b, c, d = h(("1", "2"), "x"), h(("7", "9"), "x"), h(("1", "2"), "y"), h(("1", "2"), "x", "cut")
    assert a == b and a[0] == c[0] and a[1] != c[1] and a[0] != d[0]


def test_levels_keys_validation_and_patterns(spark):
    n = spark.createDataFrame([(1, x, x.upper()) for x in "abcd"] + [(2, "x", "X"), (2, "y", "Y"), (2, "z", "Z")], "graph int, node string, label string")
    e = spark.createDataFrame([(1, "a", "b", "0"), (1, "b", "c", "0"), (1, "a", "c", "0"), (1, "c", "gone", None), (2, "x", "y", None), (2, "y", "x", None)], "graph int, src string, dst string, position string")
    assert rows(g.levels(n, e)) == [(1, "a", 0), (1, "b", 1), (1, "c", 2), (1, "d", 0), (2, "x", None), (2, "y", None), (2, "z", 0)]
    assert rows(g.cyclic(n, e)) == [(2,)]
    assert {r.node for r in g.reuse_keys(n, e).collect()} == set("abcdz")
    assert rows(g.validate(n.select("graph", "node"), e)) == [(1, "dangling_edge", "gone"), (1, "duplicate_port", "c:0"), (2, "cycle", "x"), (2, "cycle", "y")]
    assert rows(g.match_pattern(n, e, ["^A$", "^B$", "^C$"], [(0, 1), (1, 2)])) == [(1, "a", "b", "c")]
    assert g.topological_order([("a", "b"), ("b", "c")], ["c", "b", "a"]) == ["a", "b", "c"] and g.topological_order([("a", "a")], ["a"]) is None


def test_edit_distance_and_templates():
    a = ({"1": "load", "2": "fit"}, [("1", "2")])
    assert sim.edit_distance(a, a)[0] == 0
    assert sim.edit_distance(a, ({"x": "load", "y": "cut", "z": "fit"}, [("x", "y"), ("y", "z")]))[0] == 3  # a relabelling, a node and an edge
    assert g.template(["bad value 3 in a", "bad value 17 in b c"]) == "bad value <*> in <*>" and g.template(["one"]) is None


def test_knn_blocks_matches_brute_force(spark):
    r = random.Random(5)
    data = [(i, [r.random() for _ in range(4)]) for i in range(80)] + [(200, None), (201, [1.0])]
    df = spark.createDataFrame(data, "id int, v array<double>")
    got = defaultdict(list)
    for q, nb, _, rnk in rows(sim.knn_blocks(df.where("id % 20 = 0"), df.repartition(3), "id", "v", 3, block=2)):
        got[q].append((rnk, nb))
    ok = [(i, v) for i, v in data if v and len(v) == 4]
    for q, v in ok:
        if q % 20 == 0:
            want = sorted((math.dist(v, w), j) for j, w in ok if j != q)[:3]
            assert [n for _, n in sorted(got[q])] == [j for _, j in want]


def test_expected_improvement_and_scores(spark):
    df = spark.createDataFrame([(1.0, 0.5), (2.0, 0.0)], "mu double, s double")
    a, b = (r[0] for r in df.select(rk.expected_improvement(F.col("mu"), F.col("s"), F.lit(1.0))).collect())
    assert a == pytest.approx(0.5 * 0.3989422804, abs=1e-6) and b == 1.0
    one = spark.range(1).select(rk.simplicity(F.lit(3)), rk.simplicity(F.lit(30)), rk.parametrisation(F.lit(3), F.lit(10))).first()
    assert tuple(one) == (1.0, 0.0, pytest.approx(1.0))


def test_user_objective_errors_count_as_zero(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None)], "id int, x double")
    assert rows(rk.user_objective(df, lambda r: r["x"] * 2, ["x"])) == [(1, 2.0, 4.0), (2, None, 0.0)]


def test_landmark_embedding_approximates_the_kernel(spark):
    import numpy as np

    r = random.Random(9)
    data = [(i, [r.random(), r.random()]) for i in range(200)] + [(900, None), (901, [1.0])]
    got = {x.i: np.array(x.embedding) for x in sim.nystroem(spark.createDataFrame(data, "i int, v array<double>"), "i", "v", 40, 1.0, 30).collect()}
    assert set(got) == set(range(200))
    gap = [abs(got[i] @ got[j] - math.exp(-math.dist(data[i][1], data[j][1]) ** 2)) for i in range(0, 200, 7) for j in range(0, 200, 11)]
    assert max(gap) < 1e-3
