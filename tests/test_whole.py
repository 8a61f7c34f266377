"""Queries that must cover all of their input: small tables against brute force."""

import datetime
import hashlib
import json
import random
import re
import string
from collections import Counter, defaultdict
from itertools import combinations

import __spark_entry__ as entry
from conftest import rows

from kelpie.operators import graphs as g

DAY = datetime.datetime(2024, 1, 1)


def run(name, spark, d):
    return entry.queries()[name](spark, str(d))


def at(i):
    return None if i is None else DAY + datetime.timedelta(days=i)


def store(spark, d, pipes, sets, done):
    """pipes, sets: [(id, day)]; done: [(pipeline, data set)]."""
    ts = "created_at timestamp_ntz"
    spark.createDataFrame([(i, "t", "user", "s", at(t), ["a"]) for i, t in pipes], f"id string, task string, provenance string, source string, {ts}, operators array<string>").write.parquet(f"{d}/pipelines.parquet")
    spark.createDataFrame([(i, i, "o", True, "csv", 1, at(t), at(0)) for i, t in sets], f"id string, name string, owner_id string, is_public boolean, data_type string, item_count bigint, {ts}, updated_at timestamp_ntz").write.parquet(f"{d}/datasets.parquet")
    spark.createDataFrame([(str(k), p, q, f"r{k}", "accuracy", 0.5, "s", "success", 1.0, None, at(0)) for k, (p, q) in enumerate(done)], f"id string, pipeline_id string, dataset_id string, run_id string, metric_name string, metric_value double, source string, status string, wall_clock_s double, error_message string, {ts}").write.parquet(f"{d}/evaluations.parquet")


def test_pair_queue_and_open_pairs_reach_beyond_the_newest(spark, tmp_path):
    sets = [(f"d{i:03d}", i // 2 if i else None) for i in range(90)]
    pipes = [(f"p{i:03d}", i) for i in range(1, 70)] + [("old", None)]
    full = [(p, q) for p, _ in pipes[5:69] for q, _ in sets]  # all of the newest 64 are evaluated
    done = full + [("p005", q) for q, _ in sets[10:]] + [("p005", "gone"), ("p005", "d050"), ("gone", "d001"), (None, "d002")]
    store(spark, tmp_path, pipes, sets, done)
    order = lambda x: sorted(sorted(x, key=lambda r: r[0], reverse=True), key=lambda r: -1 if r[1] is None else r[1], reverse=True)
    want = [(p, q) for p, _ in order(pipes) for q, _ in order(sets) if (p, q) not in set(done)]
    assert len(want) == 10 + 5 * 90 and want[0][0] == "p005"
    assert [tuple(r) for r in run("T06_pair_queue", spark, tmp_path).collect()] == want[:100]
    assert rows(run("J05_anti_unevaluated_pairs", spark, tmp_path)) == sorted(want, key=str)


def test_open_pairs_are_cut_to_tasks_and_take_little_disk(spark, tmp_path):
    rng = random.Random(5)
    sets = [(f"ds-{rng.getrandbits(64):016x}", i) for i in range(3000)] + [(None, 1)]
    pipes = [(f"pl-{rng.getrandbits(64):016x}", i) for i in range(400)] + [(None, 1)]
    done = [(p, q) for p, _ in pipes[:2] for q, _ in sets[:-1]] + [(rng.choice(pipes)[0], rng.choice(sets)[0]) for _ in range(6000)] + [(pipes[9][0], "gone")] * 2
    store(spark, tmp_path, pipes, sets, done)
    run("J05_anti_unevaluated_pairs", spark, tmp_path).write.parquet(f"{tmp_path}/out")
    files = list((tmp_path / "out").glob("*.parquet"))
    got = spark.read.parquet(f"{tmp_path}/out").toArrow().to_pydict()
    got = list(zip(got["pipeline_id"], got["dataset_id"]))
    evaluated = {x for x in done if None not in x}
    assert len(got) == len(set(got)) and set(got) == {(p, q) for p, _ in pipes for q, _ in sets} - evaluated
    assert len(files) > 1 and sum(x.stat().st_size for x in files) < 0.5 * len(got)  # bytes


def wl_brute(nodes, edges):
    """{(graph, round): [label]} by a walk over each graph."""
    md = lambda x: hashlib.md5(x.encode()).hexdigest()[:12]
    cur, out = {k: md(v) for k, v in nodes.items()}, defaultdict(list)
    for i in range(4):
        for (g, _), v in cur.items():
            out[g, i].append(v)
        cur = {(g, n): md(v + "|" + ",".join(sorted(cur[g, b if a == n else a] for a, b in edges[g] if n in (a, b)))) for (g, n), v in cur.items()}
    return out


def test_graphs_of_all_customers(spark, tmp_path):
    orders = [(k, k % 7 + 8, "FOP"[k % 3]) for k in range(1, 30)]
    lines = [(k, k * j % 5 + 1) for k, _, _ in orders for j in (1, 2, 3)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, f"b{i % 2}") for i in range(1, 6)], "p_partkey bigint, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    cust, nodes, edges = {k: c for k, c, _ in orders}, {}, defaultdict(set)
    nodes |= {(c, f"o{k}"): s for k, c, s in orders}
    for k, p in lines:
        nodes[cust[k], f"p{p}"] = f"b{p % 2}"
        edges[cust[k]].add((f"o{k}", f"p{p}"))
    want = wl_brute(nodes, edges)
    assert len({g for g, _ in want}) == 7
    assert {(r.graph, r["round"]): (r.labels, r.least) for r in run("M09_wl_labels", spark, tmp_path).collect()} == {k: (len(set(v)), min(v)) for k, v in want.items()}
    kernel = {g: sum(sum((Counter(want[g, i]) & Counter(want[10, i])).values()) for i in range(4)) for g in {g for g, _ in want}}
    assert {r.graph: r.kernel for r in run("M10_wl_kernel", spark, tmp_path).collect()} == {g: n for g, n in kernel.items() if n}


def test_recent_window_of_all_users(spark, tmp_path):
    spark.createDataFrame([(i, i % 3 or None, at(i)) for i in range(20)], "event_id bigint, user_id bigint, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    assert rows(run("F17_recent_window", spark, tmp_path)) == sorted([(i,) for i in range(12, 20)], key=str)


def test_tokens_of_texts_beyond_ascii(spark, tmp_path):
    texts = [(1, "Die Größe def x9 X9 the"), (2, "変数 foo_bar と Foo_Bar"), (3, "\u212aelvin \u0130x 5ab"), (4, ""), (5, None), (6, "plain and simple")]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    small = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    want = [(i, len(set(re.findall("[a-z_][a-z0-9_]+", t.translate(small))) - {"the", "and", "def", "return"})) for i, t in texts if t is not None]
    assert rows(run("X09_tokens", spark, tmp_path)) == sorted(want, key=str)


def test_format_efficiency_follows_the_whole_column(spark, tmp_path):
    for top, want in ((127, 1 / 8), (32_767, 2 / 8), (32_768, 4 / 8), (2**31, 1.0)):
        spark.createDataFrame([(1,), (None,), (top,)], "c_custkey bigint").write.parquet(f"{tmp_path}/{top}/customer.parquet")
        assert run("Q14_format_efficiency", spark, tmp_path / str(top)).first()[0] == want


def test_edit_distance_of_every_pipeline(spark, tmp_path):
    def dag(n):
        return json.dumps({"nodes": {f"n{i}": {"class_type": "Operator", "name": f"op{i}"} for i in range(n)}, "edges": [{"source": f"n{i}", "destination": f"n{i + 1}"} for i in range(n - 1)]})

    sizes = [1, *range(2, 46), 29, 30]
    data = [(f"p{i:02d}", dag(n), at(0)) for i, n in enumerate(sizes)] + [("empty", '{"nodes": {}, "edges": []}', at(0)), ("cut", '{"nodes": {"n', at(0)), ("none", None, at(0))]
    spark.createDataFrame(data, "id string, dag string, created_at timestamp_ntz").write.parquet(f"{tmp_path}/pipelines.parquet")
    got = {r.pipeline_id: (r.distance, r.edits and len(r.edits)) for r in run("M04_edit_distance", spark, tmp_path).collect()}
    want = {f"p{i:02d}": (2.0 * (n - 1), n - 1 if n + 1 <= 30 else None) for i, n in enumerate(sizes)}
    assert {k: (a, b or None) for k, (a, b) in got.items()} == {k: (a, b or None) for k, (a, b) in want.items()} | {"empty": (1.0, 1), "cut": (None, None), "none": (None, None)}


def test_pattern_matches_in_all_segments(spark, tmp_path):
    spark.createDataFrame([(1, "BUILDING"), (2, "MACHINERY"), (3, None)], "c_custkey bigint, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    orders = [(10 * c + i, c, s) for c in (1, 2, 3, 4) for i, s in enumerate("FOPF")]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    assert rows(run("M29_pattern_match", spark, tmp_path)) == [(c, 10 * c + f, 10 * c + 1) for c in (1, 2, 3) for f in (0, 3)]


def test_template_of_long_messages():
    words = [f"w{i}" for i in range(700)]
    change = lambda at, x: " ".join([*words[:at], x, *words[at + 1 :]])
    assert g.template([change(600, "a"), change(600, "b")]) == change(600, "<*>")
    assert g.template([" ".join(words), " ".join(words[:400])]) == " ".join([*words[:400], "<*>"])
    r = random.Random(4)
    for _ in range(50):
        a, b = ([r.choice("abc") for _ in range(r.randrange(9))] for _ in "ab")
        best = max((k for k in range(len(a) + 1) for c in combinations(a, k) if is_part(c, b)), default=0)
        assert len(g.lcs(a, b)) == best and is_part(g.lcs(a, b), a) and is_part(g.lcs(a, b), b)


def is_part(c, words):
    left = iter(words)
    return all(x in left for x in c)


def test_every_pipeline_has_a_place(spark, tmp_path):
    rnd = random.Random(6)
    data = [(f"{p}-{m}", f"p{p:03d}", "d", "r", m, float(rnd.randrange(5)), "s", "success", 1.0, None, at(0)) for p in range(300) for m in ("accuracy", "fit_seconds") if rnd.random() < 0.8]
    spark.createDataFrame(data, "id string, pipeline_id string, dataset_id string, run_id string, metric_name string, metric_value double, source string, status string, wall_clock_s double, error_message string, created_at timestamp_ntz").write.parquet(f"{tmp_path}/evaluations.parquet")
    v = defaultdict(dict)
    for x in data:
        v[x[1]][x[4]] = x[5]
    order = sorted(v, key=lambda p: (-v[p].get("accuracy", -1), v[p].get("fit_seconds", 99), p))
    assert len(order) > 100
    assert {r.pipeline_id: r.place for r in run("T05_lexicographic_sort", spark, tmp_path).collect()} == {p: i + 1 for i, p in enumerate(order)}
