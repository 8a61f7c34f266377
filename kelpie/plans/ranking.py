"""Queries over similarity, ranking and graphs (M, X13, X14, X20, J12, T08, A17, L11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.functions.keys import usable
from kelpie.operators import graphs as g
from kelpie.operators import ranking as k
from kelpie.operators import similarity as m
from kelpie.operators.quality import min_max_normalise
from kelpie.plans import corpus
from kelpie.plans import relational as rel
from kelpie.plans.corpus import p6_edges, p6_nodes
from kelpie.plans.experiments import current_pipelines
from kelpie.sources.tables import durable, load

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# Nearest neighbours: the query set is every vector whose id is divisible by 20, against all.
_E = "e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


@query("J12_knn_join", f"WITH {_E} SELECT a.vec_id AS query, b.vec_id AS neighbour, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS INTEGER) AS rnk FROM e a JOIN e b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id QUALIFY rnk <= 5")
def j12(s, d):
    e = load(s, d, "embeddings")
    return m.knn_blocks(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 5).select("query", "neighbour", "rnk")


@query("M01_knn_normalised", "WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), b AS (SELECT i, min(x) AS lo, max(x) AS hi FROM x GROUP BY i), e AS (SELECT vec_id, list((x - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END ORDER BY i) AS v FROM x JOIN b USING (i) GROUP BY 1) SELECT a.vec_id AS query, b.vec_id AS neighbour, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS INTEGER) AS rnk FROM e a JOIN e b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id QUALIFY rnk <= 5")
def m01(s, d):
    e = load(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    n = min_max_normalise(e, "vec_id", "v")
    return m.knn_blocks(n.where("vec_id % 20 = 0"), n, "vec_id", "v", 5).select("query", "neighbour", "rnk")


@query("T08_knn_top_k", f"WITH {_E}, q AS (SELECT v AS q FROM e WHERE vec_id = (SELECT min(vec_id) FROM e)) SELECT vec_id, round(list_distance(v, q), 6) AS dist FROM e, q ORDER BY list_distance(v, q), vec_id LIMIT 10")
def t08(s, d):
    e = load(s, d, "embeddings")
    first = e.agg(F.min_by("embedding", "vec_id").alias("q"))  # one row
    return e.crossJoin(F.broadcast(first)).select("vec_id", m.l2(F.col("embedding"), F.col("q")).alias("x")).orderBy("x", "vec_id").limit(10).select("vec_id", F.round("x", 6).alias("dist"))


@query("M02_cosine", f"WITH {_E}, q AS (SELECT v AS q FROM e WHERE vec_id = (SELECT min(vec_id) FROM e)) SELECT vec_id, round(list_cosine_similarity(v, q), 6) AS cos FROM e, q")
def m02(s, d):
    e = load(s, d, "embeddings")
    first = e.agg(F.min_by("embedding", "vec_id").alias("q"))  # one row
    return e.crossJoin(F.broadcast(first)).select("vec_id", F.round(m.cosine(F.col("embedding"), F.col("q")), 6).alias("cos"))


_NEAR = "c AS (SELECT lower(trim(id)) AS id, profile_vec AS v FROM datasets WHERE vec_version = 2 AND len(profile_vec) = 48 AND len(list_filter(profile_vec, lambda x: x IS NULL OR NOT isfinite(x))) = 0 QUALIFY row_number() OVER (PARTITION BY lower(trim(id)) ORDER BY updated_at DESC NULLS LAST, profile_vec DESC) = 1), q AS (SELECT id AS qid, v AS q FROM c ORDER BY id LIMIT 1), near AS (SELECT id AS dataset_id, list_distance(v, q) AS dist FROM c, q WHERE id <> qid ORDER BY dist, id LIMIT 5)"


def _near(s, d) -> DataFrame:
    """The five data sets nearest to the one with the least id."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    c = load(s, d, "datasets").where("vec_version = 2").select(F.lower(F.trim("id")).alias("id"), F.col("profile_vec").alias("v"), "updated_at").where((F.size("v") == 48) & ~bad)
    c = rel.r.latest_by(c, ["id"], [F.desc_nulls_last("updated_at"), F.desc("v")])
    q = c.orderBy("id").limit(1).select(F.col("id").alias("qid"), F.col("v").alias("q"))
    return c.crossJoin(F.broadcast(q)).where("id <> qid").select(F.col("id").alias("dataset_id"), m.l2(F.col("v"), F.col("q")).alias("dist")).orderBy("dist", "dataset_id").limit(5)  # q is one row


@query("A17_similar_data_score", f"WITH {rel.EV}, {_NEAR} SELECT e.pipeline_id, round(sum(e.metric_value * coalesce(1 / (1 + n.dist), 0.1)) / sum(coalesce(1 / (1 + n.dist), 0.1)), 9) AS score FROM ev e LEFT JOIN near n USING (dataset_id) WHERE e.metric = 'accuracy' AND e.status = 'success' AND {rel.OKV} AND e.pipeline_id IS NOT NULL GROUP BY 1")
def a17(s, d):
    e = rel.scored(s, d).where("pipeline_id is not null").select("pipeline_id", "dataset_id", F.col("metric_value").alias("score"))
    return k.similar_data_score(e, _near(s, d)).withColumn("score", F.round("score", 9))


_SETS = "li AS (SELECT l_orderkey AS id, list_sort(list(DISTINCT l_partkey)) AS parts, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT parts AS base, n AS bn FROM li ORDER BY id LIMIT 1)"


def _orders(s, d) -> DataFrame:
    li = load(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set("l_partkey")).alias("parts"), F.count(F.lit(1)).alias("n"))
    b = li.orderBy("id").limit(1).select(F.col("parts").alias("base"), F.col("n").alias("bn"))
    return li.crossJoin(F.broadcast(b))  # one row


@query("M03_fast_graph_distance", f"WITH {_SETS} SELECT id, len(list_filter(parts, lambda x: NOT list_contains(base, x))) + len(list_filter(base, lambda x: NOT list_contains(parts, x))) + abs(n - bn) AS dist FROM li, b")
def m03(s, d):
    return _orders(s, d).select("id", m.fast_distance(F.col("parts"), F.col("base"), F.col("n"), F.col("bn")).alias("dist"))


@query("M08_range_query", f"WITH {_SETS} SELECT id FROM li, b WHERE len(list_filter(parts, lambda x: NOT list_contains(base, x))) + len(list_filter(base, lambda x: NOT list_contains(parts, x))) + abs(n - bn) <= 6 AND abs(n - bn) <= 6")
def m08(s, d):
    """The bound on the edges comes before the sets are compared."""
    near = _orders(s, d).where(F.abs(F.col("n") - F.col("bn")) <= 6)
    return near.where(m.fast_distance(F.col("parts"), F.col("base"), F.col("n"), F.col("bn")) <= 6).select("id")


_M04 = corpus._N + """,
  nn AS MATERIALIZED (SELECT oid AS graph, spot AS v, coalesce(%s, %s) AS label FROM n WHERE spot IS NOT NULL),
  ee AS MATERIALIZED (SELECT oid AS graph, %s AS s, %s AS t FROM ed WHERE spot IS NOT NULL),
  size AS MATERIALIZED (SELECT graph, count(*) AS k FROM nn GROUP BY 1),
  base AS (SELECT 1 AS k),
  bl AS (SELECT 'plinth.linear.NullFlagger' AS label),
  be AS (SELECT 0 AS be),
  ue AS (SELECT DISTINCT ee.graph, s, t, a.v IS NOT NULL AS hs, b.v IS NOT NULL AS ht FROM ee LEFT JOIN nn a ON a.graph = ee.graph AND a.v = s LEFT JOIN nn b ON b.graph = ee.graph AND b.v = t),
  te AS (SELECT graph, count(*) FILTER (hs OR ht) AS touching FROM ue GROUP BY 1),
  own AS (SELECT graph, v, count(*) AS alone, count(*) FILTER (s = t AND s = v) AS loops FROM (SELECT graph, s AS v, s, t FROM ue WHERE hs AND (NOT ht OR s = t) UNION ALL SELECT graph, t, s, t FROM ue WHERE ht AND NOT hs) GROUP BY ALL),
  c AS (
    SELECT nn.graph, min((nn.label IS DISTINCT FROM (SELECT label FROM bl))::INT + k - 1 + coalesce(touching, 0) - coalesce(alone, 0) + coalesce(loops, 0)) AS best, any_value(k) AS k, any_value(coalesce(touching, 0)) AS touching
    FROM nn JOIN size USING (graph) LEFT JOIN te USING (graph) LEFT JOIN own ON own.graph = nn.graph AND own.v = nn.v GROUP BY 1),
  q AS (SELECT graph, count(*) AS edges FROM ee GROUP BY 1),
  far AS (SELECT size.graph, (SELECT count(*) FROM (SELECT label FROM nn WHERE nn.graph = size.graph EXCEPT SELECT label FROM bl)) + (SELECT count(*) FROM (SELECT label FROM bl EXCEPT SELECT label FROM nn WHERE nn.graph = size.graph)) AS gap FROM size)
  SELECT cur.oid AS pipeline_id, CASE
      WHEN size.k + (SELECT k FROM base) <= 30 THEN least(best, 1 + size.k + touching)
      WHEN size.k IS NOT NULL THEN gap + abs(coalesce(q.edges, 0) - be)
      WHEN top.h IS NOT NULL THEN (SELECT k FROM base) + CASE WHEN (SELECT k FROM base) <= 30 THEN be ELSE abs(coalesce(q.edges, 0) - be) END END::DOUBLE AS distance
  FROM cur LEFT JOIN top ON top.oid = cur.oid LEFT JOIN size ON size.graph = cur.oid LEFT JOIN c ON c.graph = cur.oid LEFT JOIN q ON q.graph = cur.oid LEFT JOIN far ON far.graph = cur.oid, be""" % tuple(corpus._string(corpus._field(*x)) for x in (("v", "name"), ("v", "class_type", "type"), ("v", "source", "src"), ("v", "destination", "dst", "target")))


def _graphs(s, d) -> DataFrame:
    n = p6_nodes(s, d).groupBy("owner_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("path", F.coalesce("name", "class_type").alias("label")))).alias("nodes"))
    e = p6_edges(s, d).groupBy("owner_id").agg(F.collect_list(F.struct("source", "destination")).alias("edges"))
    known = F.variant_get(F.try_parse_json("dag"), "$.nodes", "string").isNotNull()
    p = current_pipelines(s, d, ["dag"]).select(F.col("id").alias("owner_id"), known.alias("known"))
    return p.join(n, "owner_id", "left").join(e, "owner_id", "left").select("owner_id", "nodes", "edges", (F.col("nodes").isNotNull() | F.col("known")).alias("known"), "n")


@query("M04_edit_distance")
def m04(s, d):
    """Every pipeline against the smallest one (ties by id)."""
    p = durable(_graphs(s, d))
    least = p.where("n is not null").orderBy("n", "owner_id").limit(1).collect()  # one row
    base = ({x.path: x.label for x in least[0].nodes}, [(x.source, x.destination) for x in least[0].edges or []]) if least else None
    return m.edit_distances(p, base)


@query("M04_distance_to_operator", _M04)
def m04b(s, d):
    """Every pipeline against a single operator, which SQL can say in closed form."""
    return m.edit_distances(_graphs(s, d), ({"n1": "plinth.linear.NullFlagger"}, [])).select("pipeline_id", "distance")


@query("M05_edit_path")
def m05(s, d):
    """The edits of every graph that is compared exactly, one row each, in the order of the base's nodes, insertions last."""
    return m04(s, d).where("edits is not null").select("pipeline_id", F.posexplode("edits").alias("step", "edit"))


@query("M06_weighted_distance", "SELECT p_partkey, CASE WHEN p_type = q_type AND p_brand = q_brand THEN 0.0 WHEN p_type = q_type THEN 1.0 WHEN substr(p_type, 1, 3) = substr(q_type, 1, 3) THEN 4.0 ELSE 5.0 END AS cost FROM part, (SELECT p_type AS q_type, p_brand AS q_brand FROM part ORDER BY p_partkey LIMIT 1)")
def m06(s, d):
    """A part's type stands for an operator's family, the start of it for two hops in the knowledge graph."""
    p = load(s, d, "part")
    q = p.orderBy("p_partkey").limit(1).select(F.col("p_type").alias("q_type"), F.col("p_brand").alias("q_brand"))
    same = (F.col("p_type") == F.col("q_type")) & (F.col("p_brand") == F.col("q_brand"))
    known = F.substring("p_type", 1, 3) == F.substring("q_type", 1, 3)
    return p.crossJoin(F.broadcast(q)).select("p_partkey", m.weighted_label_cost(same, F.col("p_type") == F.col("q_type"), F.lit(2), known).alias("cost"))  # one row


_TOK = "list_distinct(regexp_extract_all(lower(text), '([a-z_][a-z0-9_]+)', 1))"


@query("M07_few_shot_retrieval", f"WITH t AS (SELECT doc_id, list_filter({_TOK}, lambda x: x NOT IN ('the', 'and')) AS w, lower(trim(source)) AS src FROM documents WHERE text IS NOT NULL AND text <> ''), q AS (SELECT w AS qw, src AS qs FROM t ORDER BY doc_id LIMIT 1), x AS (SELECT doc_id, 0.5 * CASE WHEN len(w) + len(qw) = 0 THEN 0 ELSE len(list_intersect(w, qw)) / len(list_distinct(list_concat(w, qw))) END + 0.5 * CASE WHEN src = qs THEN 1 ELSE 0 END AS score FROM t, q) SELECT doc_id, round(score, 9) AS score FROM x ORDER BY score DESC, doc_id LIMIT 10")
def m07(s, d):
    """Half the token sets, half the source, as the operators of a case."""
    t = load(s, d, "documents").where("text is not null and text <> ''").select("doc_id", m.token_set(F.col("text"), ["the", "and"]).alias("w"), F.lower(F.trim("source")).alias("src"))
    q = t.orderBy("doc_id").limit(1).select(F.col("w").alias("qw"), F.col("src").alias("qs"))
    score = 0.5 * m.jaccard(F.col("w"), F.col("qw")) + 0.5 * F.when(F.col("src") == F.col("qs"), 1).otherwise(0)
    return t.crossJoin(F.broadcast(q)).select("doc_id", score.alias("x")).orderBy(F.desc("x"), "doc_id").limit(10).select("doc_id", F.round("x", 9).alias("score"))  # one row


def _order_graph(s, d) -> tuple[DataFrame, DataFrame]:
    """A customer's orders and their parts' brands as a graph."""
    o = load(s, d, "orders").select(F.col("o_custkey").alias("graph"), F.concat(F.lit("o"), "o_orderkey").alias("node"), F.col("o_orderstatus").alias("label"), "o_orderkey")
    li = load(s, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    e = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select("graph", F.col("node").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), "l_partkey")
    p = e.join(load(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("graph", F.col("dst").alias("node"), F.col("p_brand").alias("label")).distinct()
    return o.select("graph", "node", "label").distinct().unionByName(p), e.select("graph", "src", "dst").distinct()


_GRAPH = "o AS (SELECT DISTINCT o_custkey AS graph, 'o' || o_orderkey AS node, o_orderstatus AS label, o_orderkey FROM orders), e AS (SELECT DISTINCT o.graph, o.node AS src, 'p' || l_partkey AS dst, l_partkey FROM o JOIN lineitem ON o_orderkey = l_orderkey), n AS (SELECT graph, node, label FROM o UNION SELECT graph, dst, p_brand FROM e JOIN part ON l_partkey = p_partkey), u AS (SELECT graph, src, dst FROM e UNION SELECT graph, dst, src FROM e), w0 AS (SELECT graph, node, substr(md5(label), 1, 12) AS label FROM n)"
for _i in (1, 2, 3):
    _GRAPH += f", w{_i} AS (SELECT w.graph, w.node, substr(md5(any_value(w.label) || '|' || coalesce(string_agg(x.label, ',' ORDER BY x.label), '')), 1, 12) AS label FROM w{_i - 1} w LEFT JOIN u ON u.graph = w.graph AND u.src = w.node LEFT JOIN w{_i - 1} x ON x.graph = u.graph AND x.node = u.dst GROUP BY 1, 2)"
_ALL = "a AS (" + " UNION ALL ".join(f"SELECT graph, node, label, {i} AS round FROM w{i}" for i in range(4)) + ")"


@query("M09_wl_labels", f"WITH {_GRAPH}, {_ALL} SELECT graph, round, count(DISTINCT label) AS labels, min(label) AS least FROM a GROUP BY 1, 2")
def m09(s, d):
    return m.wl_labels(*_order_graph(s, d)).groupBy("graph", "round").agg(F.count_distinct("label").alias("labels"), F.min("label").alias("least"))


@query("M10_wl_kernel", f"WITH {_GRAPH}, {_ALL}, h AS (SELECT graph, round, label, count(*) AS n FROM a GROUP BY ALL), b AS (SELECT round, label, n AS m FROM h WHERE graph = 10) SELECT graph, CAST(sum(least(n, m)) AS BIGINT) AS kernel FROM h JOIN b USING (round, label) GROUP BY 1")
def m10(s, d):
    return m.wl_kernel(m.wl_labels(*_order_graph(s, d)), 10)


_POOL = f"WITH {rel.EV}, pool AS (SELECT pipeline_id, max(metric_value) FILTER (metric = 'accuracy') AS acc, max(metric_value) FILTER (metric = 'recall') AS rec, 1 / (1 + min(metric_value) FILTER (metric = 'fit_seconds')) AS fast FROM ev WHERE {rel.OKV} AND pipeline_id IS NOT NULL GROUP BY 1), c AS (SELECT pipeline_id, coalesce(acc, 0.0) AS acc, coalesce(rec, 0.0) AS rec, coalesce(fast, 0.0) AS fast FROM pool ORDER BY acc DESC NULLS LAST, pipeline_id LIMIT 40)"
_OBJ = ["acc", "rec", "fast"]
_DOM = "a.acc >= b.acc AND a.rec >= b.rec AND a.fast >= b.fast AND (a.acc > b.acc OR a.rec > b.rec OR a.fast > b.fast)"
_FRONTS = _POOL.replace("WITH ", "WITH RECURSIVE ", 1) + f", r(id, k) AS (SELECT pipeline_id, 0 FROM c UNION SELECT b.pipeline_id, k + 1 FROM r JOIN c a ON a.pipeline_id = r.id JOIN c b ON {_DOM}), f AS (SELECT id AS pipeline_id, CAST(max(k) AS INTEGER) AS front FROM r GROUP BY 1)"


def _scores(s, d) -> DataFrame:
    e = rel.evals(s, d).where(usable("metric_value") & F.col("pipeline_id").isNotNull())
    pick = lambda f, name: f(F.when(F.col("metric") == name, F.col("metric_value")))
    return e.groupBy("pipeline_id").agg(pick(F.max, "accuracy").alias("acc"), pick(F.max, "recall").alias("rec"), (1 / (1 + pick(F.min, "fit_seconds"))).alias("fast"))


def _pool(s, d) -> DataFrame:
    """Candidates anchored by the first objective, a pool of 40."""
    return _scores(s, d).orderBy(F.desc_nulls_last("acc"), "pipeline_id").limit(40).na.fill(0.0, _OBJ)


@query("M20_pareto_front", "SELECT p_partkey, p_size, p_retailprice FROM part b WHERE NOT EXISTS (SELECT 1 FROM part a WHERE a.p_size >= b.p_size AND a.p_retailprice >= b.p_retailprice AND (a.p_size > b.p_size OR a.p_retailprice > b.p_retailprice))")
def m20(s, d):
    out = k.pareto_front(load(s, d, "part"), "p_partkey", ["p_size", "p_retailprice"])
    return out.select("p_partkey", F.col("p_size").cast("int").alias("p_size"), "p_retailprice")


@query("M20_fronts", _FRONTS + " SELECT pipeline_id, front FROM f")
def m20b(s, d):
    return k.fronts(_pool(s, d), "pipeline_id", _OBJ)


_ENT = "list_sum(list_transform({0}, lambda x: -x * ln(x + 1e-12)))"
_JS = _POOL + f", i AS (SELECT [max(acc), max(rec), max(fast)] AS q0 FROM c), p AS (SELECT pipeline_id, [acc, rec, fast] AS r, acc + rec + fast AS t, list_transform([acc, rec, fast], lambda x: x / nullif(acc + rec + fast, 0)) AS p, list_transform(q0, lambda x: x / nullif(list_sum(q0), 0)) AS q FROM c, i), m AS (SELECT *, [0.5 * p[1] + 0.5 * q[1], 0.5 * p[2] + 0.5 * q[2], 0.5 * p[3] + 0.5 * q[3]] AS m FROM p), js AS (SELECT pipeline_id, CASE WHEN t < 1e-12 THEN 0.0 ELSE 1 - ({_ENT.format('m')} - 0.5 * {_ENT.format('p')} - 0.5 * {_ENT.format('q')}) / (-0.5 * ln(0.5 + 1e-12) - 0.5 * ln(0.5 + 1e-12)) END AS fitness FROM m)"


@query("M21_js_fitness", _JS + " SELECT pipeline_id, round(fitness, 9) AS fitness FROM js")
def m21(s, d):
    return k.js_fitness(_pool(s, d), _OBJ).select("pipeline_id", F.round("fitness", 9).alias("fitness"))


@query("M22_nds_lex", _FRONTS + " SELECT pipeline_id, CAST(row_number() OVER (ORDER BY front, acc DESC, rec DESC, fast DESC, pipeline_id) AS INTEGER) AS place FROM f JOIN c USING (pipeline_id)")
def m22(s, d):
    return k.rank_by(_pool(s, d), "nds_lex", "pipeline_id", _OBJ).select("pipeline_id", "place")


@query("M22_weighted_sum", _POOL + " SELECT pipeline_id, CAST(row_number() OVER (ORDER BY acc * 0.5 + rec * 0.25 + fast * 0.25 DESC, pipeline_id) AS INTEGER) AS place FROM c")
def m22b(s, d):
    return k.rank_by(_pool(s, d), "weighted_sum", "pipeline_id", _OBJ, [0.5, 0.25, 0.25]).select("pipeline_id", "place")


@query("M22_nds_sum", _FRONTS + " SELECT pipeline_id, CAST(row_number() OVER (ORDER BY front, acc + rec + fast DESC, pipeline_id) AS INTEGER) AS place FROM f JOIN c USING (pipeline_id)")
def m22c(s, d):
    return k.rank_by(_pool(s, d), "nds_sum", "pipeline_id", _OBJ).select("pipeline_id", "place")


@query("M22_lexicographic", _POOL + " SELECT pipeline_id, CAST(row_number() OVER (ORDER BY acc DESC, rec DESC, fast DESC, pipeline_id) AS INTEGER) AS place FROM c")
def m22d(s, d):
    return k.rank_by(_pool(s, d), "lexicographic", "pipeline_id", _OBJ).select("pipeline_id", "place")


@query("M22_jensen", _JS + " SELECT pipeline_id, CAST(row_number() OVER (ORDER BY fitness DESC, pipeline_id) AS INTEGER) AS place FROM js")
def m22e(s, d):
    return k.rank_by(_pool(s, d), "jensen", "pipeline_id", _OBJ).select("pipeline_id", "place")


@query("M23_candidate_pool", _POOL + " SELECT pipeline_id, acc FROM c ORDER BY acc DESC, pipeline_id LIMIT 10")
def m23(s, d):
    return _pool(s, d).orderBy(F.desc("acc"), "pipeline_id").limit(10).select("pipeline_id", "acc")


@query("M12_general_performance", f"WITH {rel.EV} SELECT pipeline_id, round(avg(metric_value), 8) AS score FROM ev WHERE metric = 'f1_macro' AND {rel.OKV} AND pipeline_id IS NOT NULL GROUP BY 1")
def m12(s, d):
    e = rel.evals(s, d).where((F.col("metric") == "f1_macro") & usable("metric_value") & F.col("pipeline_id").isNotNull())
    return e.groupBy("pipeline_id").agg(F.round(F.avg("metric_value"), 8).alias("score"))


@query("M13_similar_data_top", f"WITH {rel.EV}, {_NEAR} SELECT e.pipeline_id, count(n.dist) AS n_near FROM ev e LEFT JOIN near n USING (dataset_id) WHERE e.metric = 'accuracy' AND e.status = 'success' AND {rel.OKV} AND e.pipeline_id IS NOT NULL GROUP BY 1 HAVING count(n.dist) > 0")
def m13(s, d):
    e = rel.scored(s, d).where("pipeline_id is not null").select("pipeline_id", "dataset_id")
    return e.join(F.broadcast(_near(s, d)), "dataset_id").groupBy("pipeline_id").agg(F.count(F.lit(1)).alias("n_near"))  # five rows


@query("M14_unseen", "SELECT compared_id AS pipeline_id, CASE WHEN count(*) FILTER (preferred_id = compared_id) > 0 THEN 0 ELSE -count(*) END AS unseen FROM (SELECT DISTINCT * FROM interactions) GROUP BY 1")
def m14(s, d):
    i = rel.inter(s, d).groupBy(F.col("compared_id").alias("pipeline_id"))
    return i.agg(F.when(F.count_if(F.col("preferred_id") == F.col("compared_id")) > 0, F.lit(0).cast("bigint")).otherwise(-F.count(F.lit(1))).alias("unseen"))


@query("M15_preference", rel.SQL["J02_or_join_wins"].replace("wins, count(*) AS compared, count(*) FILTER (preferred_id = pipeline_id) / count(*) AS win_rate", "wins"))
def m15(s, d):
    return rel.r.win_rates(rel.inter(s, d)).select("pipeline_id", "wins")


@query("M16_faster", f"WITH {rel.EV}, {rel.PI}, t AS (SELECT pipeline_id, avg(metric_value) AS s FROM ev WHERE metric = 'fit_seconds' AND {rel.OKV} AND metric_value > 0 GROUP BY 1) SELECT pi.id, round(1 / (1 + coalesce(t.s, n_ops, 0)), 9) AS faster FROM pi LEFT JOIN t ON pi.id = t.pipeline_id")
def m16(s, d):
    e = rel.evals(s, d).where((F.col("metric") == "fit_seconds") & usable("metric_value")).select(F.col("pipeline_id").alias("id"), F.col("metric_value").alias("seconds"))
    return k.faster(e, rel.pipes(s, d).select("id", "n_ops")).withColumn("faster", F.round("faster", 9))


@query("M17_atomic_changes", rel.SQL["U05_jaccard"])
def m17(s, d):
    return rel.u05(s, d)


@query("M11_landmark_embedding")
def m11(s, d):
    return m.nystroem(load(s, d, "embeddings"), "vec_id", "embedding", gamma=0.5)


def _score(r: dict) -> float:
    return 0.7 * r["acc"] + 0.3 * r["rec"]


@query("M18_user_objective", _POOL + " SELECT pipeline_id, round(0.7 * acc + 0.3 * rec, 9) AS score FROM c")
def m18(s, d):
    return k.user_objective(_pool(s, d), _score, ["acc", "rec"]).select("pipeline_id", F.round("score", 9).alias("score"))


_NEEDS = " UNION ALL ".join(f"SELECT '{o}' AS objective, [{', '.join(repr(t) for t in sorted(needs))}] AS needs" for o, needs in k.OBJECTIVES.items())


@query("M19_objective_registry", f"SELECT objective, CASE WHEN list_has_all((SELECT list(t) FROM (SELECT view_name AS t FROM duckdb_views() UNION SELECT table_name FROM duckdb_tables())), needs) THEN 'active' ELSE 'degraded' END AS status FROM ({_NEEDS})")
def m19(s, d):
    """Objectives by the tables that are there."""
    jvm = s._jvm.org.apache.hadoop.fs

    def there(t: str) -> bool:
        path = jvm.Path(f"{d}/{t}.parquet")
        return path.getFileSystem(s._jsc.hadoopConfiguration()).exists(path)

    tables = {t for needs in k.OBJECTIVES.values() for t in needs if there(t)}
    return s.createDataFrame(list(k.objective_status(tables).items()), "objective string, status string")


@query("M24_masked_operators", f"WITH {rel._OPS}, bad AS (SELECT unnest(ops) AS op FROM o GROUP BY 1 HAVING count(*) >= 100) SELECT id FROM o WHERE ops IS NOT NULL AND NOT EXISTS (SELECT 1 FROM (SELECT o2.id AS i, unnest(o2.ops) AS op FROM o o2) x JOIN bad USING (op) WHERE x.i = o.id)")
def m24(s, d):
    """Operators of a hundred pipelines and more stand for masked ones."""
    o = rel.operator_sets(s, d).where("ops is not null")
    each = o.select("id", F.explode("ops").alias("op"))
    bad = each.groupBy("op").agg(F.count(F.lit(1)).alias("n")).where("n >= 100").select("op")
    return o.select("id").join(each.join(bad, "op", "left_semi").select("id"), "id", "left_anti")


@query("M25_ancestors", "SELECT 'N' || n_nationkey AS node, 'R' || n_regionkey AS ancestor, 1 AS distance FROM nation UNION ALL SELECT 'R' || r_regionkey, 'WORLD', 1 FROM region UNION ALL SELECT 'N' || n_nationkey, 'WORLD', 2 FROM nation")
def m25(s, d):
    n, r = load(s, d, "nation"), load(s, d, "region")
    e = n.select(F.concat(F.lit("N"), "n_nationkey").alias("c"), F.concat(F.lit("R"), "n_regionkey").alias("p")).unionByName(r.select(F.concat(F.lit("R"), "r_regionkey").alias("c"), F.lit("WORLD").alias("p")))
    return g.ancestors(e, "c", "p")


@query("M26_kb_lookup", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def m26(s, d):
    dim = load(s, d, "nation").join(load(s, d, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return load(s, d, "supplier").join(F.broadcast(dim), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")


def pipeline_graphs(s, d) -> tuple[DataFrame, DataFrame]:
    """All current pipelines' nodes and edges, by node id."""
    n = p6_nodes(s, d).select(F.col("owner_id").alias("graph"), F.element_at(F.split("path", "/"), -1).alias("node"), F.coalesce("name", "class_type", F.lit("?")).alias("label"), "class_type", "value", "parent")
    e = p6_edges(s, d).select(F.col("owner_id").alias("graph"), F.col("source").alias("src"), F.col("destination").alias("dst"), "position", "output")
    return n, e


_TOP = "top AS (SELECT lower(trim(id)) AS id, dag FROM pipelines WHERE json_valid(dag) AND json_type(dag, '$.nodes') = 'OBJECT' QUALIFY row_number() OVER (PARTITION BY lower(trim(id)) ORDER BY created_at DESC NULLS LAST, dag DESC) = 1)"


_STEPS = corpus._N + """,
  nn AS MATERIALIZED (SELECT DISTINCT oid AS graph, string_split(spot, '/')[-1] AS node FROM n WHERE spot IS NOT NULL),
  ee AS MATERIALIZED (SELECT oid AS graph, %s AS src, %s AS dst FROM ed WHERE spot IS NOT NULL),
  st AS MATERIALIZED (SELECT DISTINCT graph, src, dst FROM ee WHERE (graph, src) IN (SELECT graph, node FROM nn) AND (graph, dst) IN (SELECT graph, node FROM nn)),
  clos AS (SELECT graph, src, dst FROM st UNION SELECT c.graph, c.src, st.dst FROM clos c JOIN st ON c.graph = st.graph AND c.dst = st.src),
  cyc AS (SELECT graph, src AS node FROM clos WHERE src = dst UNION SELECT graph, dst FROM clos WHERE (graph, src) IN (SELECT graph, src FROM clos WHERE src = dst)),
  lv AS (
    SELECT graph, node, 0 AS level FROM nn WHERE (graph, node) NOT IN (SELECT graph, dst FROM st)
    UNION SELECT st.graph, st.dst, level + 1 FROM lv JOIN st ON lv.graph = st.graph AND lv.node = st.src WHERE (st.graph, st.dst) NOT IN (SELECT graph, node FROM cyc))""" % tuple(corpus._string(corpus._field(*x)) for x in (("v", "source", "src"), ("v", "destination", "dst", "target")))


@query("M27_levels", _STEPS + " SELECT nn.graph, max(level) AS depth, count(DISTINCT nn.node) FILTER ((nn.graph, nn.node) IN (SELECT graph, node FROM cyc)) AS cyclic_nodes FROM nn LEFT JOIN lv ON lv.graph = nn.graph AND lv.node = nn.node GROUP BY 1")
def m27(s, d):
    """The longest path to every node of every pipeline, and how many nodes lie on a cycle."""
    n, e = pipeline_graphs(s, d)
    lv = g.levels(n.select("graph", "node"), e)
    return lv.groupBy("graph").agg(F.max("level").alias("depth"), F.count_if(F.col("level").isNull()).alias("cyclic_nodes"))


@query("M28_validation", "WITH s AS (SELECT l_orderkey AS graph, l_partkey AS node, l_suppkey AS dst, l_linenumber AS position FROM lineitem) SELECT graph, 'duplicate_port' AS problem, dst || ':' || position AS item FROM s GROUP BY graph, dst, position HAVING count(*) > 1")
def m28(s, d):
    """An order's lines as wires from part to supplier, the line number as the port; every end is a node, so only ports clash."""
    li = load(s, d, "lineitem").select(F.col("l_orderkey").alias("graph"), F.concat(F.lit("p"), "l_partkey").alias("src"), F.col("l_suppkey").cast("string").alias("dst"), F.col("l_linenumber").cast("string").alias("position"))
    n = li.select("graph", F.col("src").alias("node")).unionByName(li.select("graph", F.col("dst").alias("node"))).distinct()
    return g.validate(n, li)


def _registry(n: DataFrame, e: DataFrame) -> DataFrame:
    """Signatures told from use, as this store holds none: an operator used twice is known, and its input ports are those wired twice; a port wired in
    nine of ten uses is required; its type is the family of the operators that feed it, if one family makes up nine tenths."""
    ops = n.where("class_type = 'Operator'").select("graph", "node", F.col("label").alias("operator")).distinct()
    uses = durable(ops.groupBy("operator").agg(F.count(F.lit(1)).alias("uses")).where("uses >= 2"))
    family = F.split_part(F.col("from"), F.lit("."), F.lit(2))
    wired = e.where("position is not null").join(ops.withColumnRenamed("node", "dst"), ["graph", "dst"]).join(ops.select("graph", F.col("node").alias("src"), F.col("operator").alias("from")), ["graph", "src"], "left")
    port = durable(wired.groupBy("operator", "position", family.alias("family")).agg(F.count(F.lit(1)).alias("k")))
    top = port.where("family is not null").groupBy("operator", "position").agg(F.max(F.struct("k", "family")).alias("m"), F.sum("k").alias("fed"))
    nodes = wired.groupBy("operator", "position").agg(F.count_distinct("graph", "dst").alias("nodes"), F.count(F.lit(1)).alias("k")).where("k >= 2")
    kind = F.when(F.col("m.k") >= 0.9 * F.col("fed"), F.col("m.family"))
    inputs = nodes.join(uses, "operator").join(top, ["operator", "position"], "left").select("operator", F.col("position").alias("port"), F.lit("in").alias("direction"), F.lit(None).cast("int").alias("place"), kind.alias("type"), (F.col("nodes") >= 0.9 * F.col("uses")).alias("required"))
    outputs = uses.select("operator", F.lit("out").alias("port"), F.lit("out").alias("direction"), F.lit(0).alias("place"), F.split_part("operator", F.lit("."), F.lit(2)).alias("type"), F.lit(False).alias("required"))
    return inputs.unionByName(outputs).select("operator", "port", "direction", "place", "type", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("split"), "required", F.lit(False).alias("variadic"))


_VALID = corpus._N + """,
  nn AS MATERIALIZED (
    SELECT DISTINCT oid AS graph, string_split(spot, '/')[-1] AS node, CASE WHEN cls = 'Operator' THEN coalesce(nm, cls) END AS op, cls = 'Parameter' AS par
    FROM (SELECT oid, spot, %s AS cls, %s AS nm FROM n WHERE spot IS NOT NULL)),
  ee AS MATERIALIZED (SELECT oid AS graph, %s AS src, %s AS dst, %s AS pos, %s AS output FROM ed WHERE spot IS NOT NULL),
  ops AS (SELECT graph, node, op FROM nn WHERE op IS NOT NULL),
  used AS (SELECT op, count(*) AS uses FROM ops GROUP BY 1 HAVING count(*) >= 2),
  w AS (SELECT o.op, ee.*, f.op AS fop, split_part(f.op, '.', 2) AS fam FROM ee JOIN ops o ON o.graph = ee.graph AND o.node = ee.dst LEFT JOIN ops f ON f.graph = ee.graph AND f.node = ee.src WHERE pos IS NOT NULL),
  fk AS (SELECT op, pos, fam, count(*) AS k FROM w WHERE fam IS NOT NULL GROUP BY ALL),
  ft AS (SELECT op, pos, max(k) AS mk, arg_max(fam, (k, fam)) AS fam, sum(k) AS fed FROM fk GROUP BY ALL),
  inp AS (
    SELECT p.op, p.pos, CASE WHEN mk >= 0.9 * fed THEN fam END AS kind, nodes >= 0.9 * uses AS need
    FROM (SELECT op, pos, count(DISTINCT (graph, dst)) AS nodes, count(*) AS k FROM w GROUP BY ALL HAVING count(*) >= 2) p
    JOIN used USING (op) LEFT JOIN ft USING (op, pos)),
  st AS MATERIALIZED (SELECT DISTINCT graph, src, dst FROM ee WHERE (graph, src) IN (SELECT graph, node FROM nn) AND (graph, dst) IN (SELECT graph, node FROM nn)),
  reach AS (
    SELECT DISTINCT graph, node FROM nn WHERE (op IS NOT NULL OR par) AND (graph, node) NOT IN (SELECT graph, dst FROM st)
    UNION SELECT st.graph, st.dst FROM st JOIN reach r ON r.graph = st.graph AND r.node = st.src),
  clos AS (SELECT graph, src, dst FROM st UNION SELECT c.graph, c.src, st.dst FROM clos c JOIN st ON c.graph = st.graph AND c.dst = st.src),
  cyc AS (SELECT graph, src AS node FROM clos WHERE src = dst UNION SELECT graph, dst FROM clos WHERE (graph, src) IN (SELECT graph, src FROM clos WHERE src = dst)),
  bad AS (
    SELECT DISTINCT graph, 'dangling_edge' AS problem, node AS item FROM (SELECT graph, src AS node FROM ee UNION ALL SELECT graph, dst FROM ee) WHERE node IS NOT NULL AND (graph, node) NOT IN (SELECT graph, node FROM nn)
    UNION ALL SELECT DISTINCT graph, 'cycle', node FROM cyc
    UNION ALL SELECT DISTINCT graph, 'unreachable_from_source', node FROM ops WHERE (graph, node) NOT IN (SELECT graph, node FROM reach)
    UNION ALL SELECT ee.graph, 'duplicate_port', dst || ':' || pos FROM ee LEFT JOIN ops o ON o.graph = ee.graph AND o.node = ee.dst WHERE pos IS NOT NULL AND dst IS NOT NULL GROUP BY ee.graph, dst, pos, op HAVING count(*) > 1
    UNION ALL SELECT graph, 'unknown_operator', node || ':' || op FROM ops WHERE op NOT IN (SELECT op FROM used)
    UNION ALL SELECT graph, 'unknown_port', dst || ':' || pos FROM w WHERE op IN (SELECT op FROM used) AND (op, pos) NOT IN (SELECT op, pos FROM inp)
    UNION ALL SELECT graph, 'unwired_input', node || ':' || pos FROM ops JOIN inp USING (op) WHERE need AND (graph, node, pos) NOT IN (SELECT graph, dst, pos FROM ee WHERE pos IS NOT NULL AND dst IS NOT NULL)
    UNION ALL SELECT graph, 'type_mismatch', src || ':' || dst || ':' || pos || ':type' FROM w JOIN inp USING (op, pos) WHERE fop IN (SELECT op FROM used) AND output IN ('0', 'out') AND fam <> kind)
  SELECT problem, count(*) AS n, count(DISTINCT graph) AS pipelines FROM bad GROUP BY 1""" % tuple(corpus._string(corpus._field(*x)) for x in (("v", "class_type", "type"), ("v", "name"), ("v", "source", "src"), ("v", "destination", "dst", "target"), ("v", "position"), ("v", "output")))


@query("M28_pipeline_validation", _VALID)
def m28b(s, d):
    n, e = pipeline_graphs(s, d)
    n, e = durable(n), durable(e)
    return g.validate(n, e, _registry(n, e)).groupBy("problem").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("graph").alias("pipelines"))


@query("M29_pattern_match", "WITH e AS (SELECT DISTINCT c_custkey, o_orderkey, o_orderstatus, o_orderpriority FROM customer JOIN orders ON c_custkey = o_custkey) SELECT a.c_custkey AS graph, a.o_orderkey AS n1, b.o_orderkey AS n2 FROM e a JOIN e b ON a.c_custkey = b.c_custkey AND a.o_orderkey <> b.o_orderkey WHERE a.o_orderstatus = 'F' AND b.o_orderstatus = 'O'")
def m29(s, d):
    """A customer with an order of status F and one of status O."""
    c = load(s, d, "customer").select("c_custkey")
    o = load(s, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_custkey").alias("graph"), "o_orderkey", "o_orderstatus")
    n = o.select("graph", F.concat(F.lit("o"), "o_orderkey").alias("node"), F.col("o_orderstatus").alias("label")).unionByName(o.select("graph", F.lit("c").alias("node"), F.lit("customer").alias("label")).distinct())
    e = o.select("graph", F.lit("c").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst"))
    out = g.match_pattern(n, e, ["^customer$", "^F$", "^O$"], [(0, 1), (0, 2)])
    return out.select("graph", F.substring("n1", 2, 20).cast("bigint").alias("n1"), F.substring("n2", 2, 20).cast("bigint").alias("n2"))


@query("M30_rewrite_fixpoint")
def m30(s, d):
    """Parameters are folded away: their nodes go, and their wires with them, until nothing changes."""
    n, e = pipeline_graphs(s, d)
    rule = lambda a, b: g.delete_nodes(a, b, a.where("class_type = 'Parameter'").select("graph", "node").distinct())
    n2, e2 = g.fixpoint((n.select("graph", "node", "class_type").distinct(), e.select("graph", "src", "dst").distinct()), rule)
    return n2.groupBy("graph").agg(F.count(F.lit(1)).alias("nodes")).join(e2.groupBy("graph").agg(F.count(F.lit(1)).alias("edges")), "graph", "left")


@query("M30_rewrite_steps", """WITH n AS (SELECT l_orderkey AS graph, l_linenumber AS i, any_value(l_returnflag) AS label FROM lineitem GROUP BY ALL), e AS (SELECT a.graph, a.i AS src, b.i AS dst, a.label AS sl, b.label AS dl FROM n a JOIN n b ON a.graph = b.graph AND b.i = a.i + 1),
  keep AS (SELECT graph, CASE WHEN sl = 'R' THEN src || '+check' ELSE src || '' END AS src, dst || '' AS dst FROM e WHERE sl <> 'A' AND dl <> 'A' UNION SELECT a.graph, CASE WHEN a.sl = 'R' THEN a.src || '+check' ELSE a.src || '' END, b.dst || '' FROM e a JOIN e b ON a.graph = b.graph AND a.dst = b.src WHERE a.dl = 'A' AND a.sl <> 'A' AND b.dl <> 'A'
    UNION SELECT graph, i || '', i || '+check' FROM n WHERE label = 'R'),
  nn AS (SELECT graph, count(*) FILTER (label <> 'A') + count(*) FILTER (label = 'R') AS nodes FROM n GROUP BY 1), ee AS (SELECT graph, count(*) AS edges, count(*) FILTER (contains(src, '+')) AS moved FROM keep GROUP BY 1)
  SELECT graph, nodes, edges, moved FROM nn LEFT JOIN ee USING (graph) WHERE nodes > 0""")
def m30b(s, d):
    """An order's lines as a chain: returned lines get a check behind them, then accepted lines are taken out and their neighbours linked."""
    li = load(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("graph"), "l_linenumber").agg(F.first("l_returnflag").alias("label"))
    n = durable(li.select("graph", F.col("l_linenumber").cast("string").alias("node"), "label", "l_linenumber"))
    e = n.select("graph", F.col("node").alias("src"), (F.col("l_linenumber") + 1).alias("_next")).join(n.select("graph", F.col("l_linenumber").alias("_next"), F.col("node").alias("dst")), ["graph", "_next"])
    n2, e2 = g.rewrite(n, e, lambda a, b: a.where("label = 'R'"), [("add", "+check", "check", "between")])
    n3, e3 = g.rewrite(n2, e2, lambda a, b: a.where("label = 'A'"), [("delete", True)])
    return n3.groupBy("graph").agg(F.count(F.lit(1)).alias("nodes")).join(e3.groupBy("graph").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("src").contains("+")).alias("moved")), "graph", "left")


@query("M31_delete_and_reroute", "WITH e AS (SELECT DISTINCT l_orderkey AS graph, l_partkey AS src, l_suppkey AS dst FROM lineitem) SELECT graph, src, dst FROM e WHERE dst % 10 <> 0")
def m31(s, d):
    li = load(s, d, "lineitem").select(F.col("l_orderkey").alias("graph"), F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).distinct()
    n = li.select("graph", F.col("src").alias("node")).unionByName(li.select("graph", F.col("dst").alias("node"))).distinct()
    gone = n.where(F.col("node").rlike("^s[0-9]*0$"))
    _, e = g.delete_nodes(n, li, gone)
    return e.select("graph", F.substring("src", 2, 20).cast("bigint").alias("src"), F.substring("dst", 2, 20).cast("bigint").alias("dst"))


@query("M32_rule_prefilter", f"WITH {rel._OPS} SELECT id FROM o WHERE list_contains(ops, 'plinth.linear.nullflagger') AND list_contains(ops, 'graftml.cluster.bincutter')")
def m32(s, d):
    return rel.operator_sets(s, d).where(F.array_contains("ops", "plinth.linear.nullflagger") & F.array_contains("ops", "graftml.cluster.bincutter")).select("id")


@query("M33_ledger_substitution", "WITH l AS (SELECT p_brand, min(p_partkey) AS canon FROM part WHERE p_size > 40 GROUP BY 1) SELECT p_partkey, coalesce(canon, p_partkey) AS canonical FROM part LEFT JOIN l USING (p_brand)")
def m33(s, d):
    p = load(s, d, "part")
    led = p.where("p_size > 40").groupBy("p_brand").agg(F.min("p_partkey").alias("canon"))
    return p.join(led, "p_brand", "left").select("p_partkey", F.coalesce("canon", "p_partkey").alias("canonical"))


_SIG = "CASE WHEN error_message IS NULL THEN NULL ELSE regexp_extract(error_message, '^(\\w+)', 1) END"


@query("M34_exception_tiers", f"WITH {rel.EV}, x AS (SELECT id, md5(error_message) AS hash, regexp_extract(error_message, '^(\\w+)', 1) AS type, error_message AS message FROM ev WHERE error_message IS NOT NULL), t AS (SELECT type, min(message) AS m FROM x GROUP BY type) SELECT x.id, CASE WHEN x.message = t.m THEN 'hash' WHEN x.message SIMILAR TO '.*[0-9].*' THEN 'leaf' ELSE 'bucket' END AS tier FROM x JOIN t USING (type)")
def m34(s, d):
    """One known message and one regex (a digit) per error type, all of one library."""
    x = rel.evals(s, d).where("error_message is not null").select("id", F.md5("error_message").alias("hash"), F.regexp_extract("error_message", r"^(\w+)", 1).alias("type"), F.lit("lib.core").alias("library"), F.col("error_message").alias("message"))
    p = x.groupBy("type").agg(F.min("message").alias("m")).select(F.concat(F.lit("pat:"), "type").alias("pattern"), F.md5("m").alias("phash"), F.col("type").alias("ptype"), F.lit("lib.core").alias("plibrary"), F.lit("[0-9]").alias("regex"))
    return g.match_exceptions(x, p).select("id", "tier")


@query("M35_templates")
def m35(s, d):
    x = rel.evals(s, d).where("error_message is not null").select(F.regexp_extract("error_message", r"^(\w+)", 1).alias("type"), "error_message")
    return g.mine_templates(x, "type", "error_message")


@query("M36_sample_buffer", f"WITH {rel.EV}, x AS (SELECT DISTINCT regexp_extract(error_message, '^(\\w+)', 1) AS bucket, error_message AS message FROM ev WHERE error_message IS NOT NULL) SELECT bucket, message FROM x QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY message) <= 32")
def m36(s, d):
    from pyspark.sql import Window

    x = rel.evals(s, d).where("error_message is not null").select(F.regexp_extract("error_message", r"^(\w+)", 1).alias("bucket"), F.col("error_message").alias("message")).distinct()
    return x.withColumn("rn", F.row_number().over(Window.partitionBy("bucket").orderBy("message"))).where("rn <= 32").drop("rn")


@query("M37_action_mask", "WITH c AS (SELECT p_name AS operator, p_type AS task, p_brand AS family, p_partkey FROM part), u AS (SELECT operator, family FROM c WHERE p_partkey <= 50), n AS (SELECT family, count(*) AS n FROM u GROUP BY 1) SELECT operator, task, family FROM c LEFT JOIN n USING (family) WHERE task = (SELECT max(task) FROM c) AND operator NOT IN (SELECT operator FROM u) AND (family <> (SELECT min(family) FROM c) OR coalesce(n.n, 0) < 1)")
def m37(s, d):
    p = load(s, d, "part").select(F.col("p_name").alias("operator"), F.col("p_type").alias("task"), F.col("p_brand").alias("family"), "p_partkey")
    one = p.agg(F.max("task"), F.min("family")).first()
    return g.action_mask(p, p.where("p_partkey <= 50"), one[0], {one[1]: 1})


@query("M38_reuse_plan")
def m38(s, d):
    """How many nodes of all pipelines share a content address: what a cache would save."""
    n, e = pipeline_graphs(s, d)
    keys = g.reuse_keys(n.select("graph", "node", "label"), e)
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("nodes"), F.count(F.lit(1)).alias("addresses"))


@query("M39_benefit_eviction", "WITH c AS (SELECT s_suppkey, CAST(floor(s_acctbal * 10) AS BIGINT) AS size, s_nationkey + 1.0 AS secs, 1 AS red FROM supplier WHERE s_acctbal > 0), b AS (SELECT *, secs / greatest(size, 1) * greatest(red, 1) AS benefit FROM c), t AS (SELECT sum(size) AS t FROM b) SELECT s_suppkey, t - coalesce(sum(size) OVER (ORDER BY benefit, s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 1500000 AS evicted FROM b, t")
def m39(s, d):
    c = load(s, d, "supplier").where("s_acctbal > 0").select("s_suppkey", F.floor(F.col("s_acctbal") * 10).alias("size"), (F.col("s_nationkey") + 1.0).alias("secs"), F.lit(1).alias("red"))
    return k.evict(c, 1_500_000, "secs", "size", "red", "s_suppkey").select("s_suppkey", "evicted")


_CAND = "c AS (SELECT p_partkey, p_name AS operator, p_type AS task, p_brand AS family, CASE WHEN p_size <= 15 THEN 'transformer' WHEN p_size <= 35 THEN 'estimator' ELSE 'other' END AS interface, CASE WHEN p_retailprice < 1200 THEN 'Array' WHEN p_retailprice < 1500 THEN 'DataFrame' END AS kind FROM part), one AS (SELECT max(task) AS task FROM c), u AS (SELECT * FROM c WHERE p_partkey <= 3)"


@query("M37_valid_actions", f"WITH {_CAND} SELECT operator, family, interface FROM c, one WHERE c.task = one.task AND operator NOT IN (SELECT operator FROM u) AND NOT (interface = 'transformer' AND (SELECT count(*) FROM u WHERE interface = 'estimator') > 0) AND NOT (interface = 'estimator' AND ((SELECT count(*) FROM u WHERE interface = 'estimator') >= 2 OR family IN (SELECT family FROM u))) AND NOT (interface = 'transformer' AND (SELECT count(*) FROM u WHERE interface = 'transformer') >= 5) AND (kind IS NULL OR kind = 'Array')")
def m37b(s, d):
    """Parts as operators of one task: their size tells the interface, their price what they take in; the graph so far frees an Array."""
    size, price = F.col("p_size"), F.col("p_retailprice")
    c = load(s, d, "part").select("p_partkey", F.col("p_name").alias("operator"), F.col("p_type").alias("task"), F.col("p_brand").alias("family"), F.when(size <= 15, "transformer").when(size <= 35, "estimator").otherwise("other").alias("interface"), F.array(F.struct(F.when(price < 1200, "Array").when(price < 1500, "DataFrame").alias("type"), F.lit(True).alias("required"))).alias("inputs"))
    task = c.agg(F.max("task")).first()[0] or ""
    return g.valid_actions(c, c.where("p_partkey <= 3"), ["Array"], task, 2, 5).select("operator", "family", "interface")


_M40 = corpus._N + """,
  k AS (SELECT oid, count(*) AS n, count(*) FILTER (cls = 'Operator') AS ops, count(*) FILTER (cls = 'Parameter') AS params, count(*) FILTER (cls = 'Operator' AND contains(lower(nm), 'guard')) > 0 AS guard
    FROM (SELECT oid, %s AS cls, %s AS nm FROM n WHERE up = '' AND spot IS NOT NULL) GROUP BY 1)
  SELECT oid AS id, round(CASE WHEN n <= 3 THEN 1.0 WHEN n >= 30 THEN 0.0 ELSE 1 - (n - 3) / 27 END, 9) AS simplicity, CASE WHEN ops = 0 THEN 0.0 ELSE round(least(params / ops / 0.3, 1.0), 9) END AS parametrisation, guard::INTEGER::DOUBLE AS guardrail FROM k""" % tuple(corpus._string(corpus._field(*x)) for x in (("v", "class_type", "type"), ("v", "name")))


@query("M40_structural_scores", _M40)
def m40(s, d):
    """Of every pipeline's outermost nodes: few of them, parameters to its operators, a guardrail among these."""
    n, _ = pipeline_graphs(s, d)
    op = F.col("class_type") == "Operator"
    c = n.where("parent = ''").groupBy(F.col("graph").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.count_if(op).alias("ops"), F.count_if(F.col("class_type") == "Parameter").alias("params"), F.count_if(op & F.lower("label").contains("guard")).alias("guards"))
    return c.select("id", F.round(k.simplicity(F.col("n")), 9).alias("simplicity"), F.coalesce(F.round(k.parametrisation(F.col("params"), F.col("ops")), 9), F.lit(0.0)).alias("parametrisation"), (F.col("guards") > 0).cast("int").cast("double").alias("guardrail"))


_HASH = corpus._N + """,
  nn AS MATERIALIZED (SELECT oid AS graph, string_split(spot, '/')[-1] AS node, coalesce(%s, %s, '?') AS label, coalesce(%s, '') AS value FROM n WHERE spot IS NOT NULL),
  ee AS (SELECT oid AS graph, %s AS src, %s AS dst FROM ed WHERE spot IS NOT NULL),
  ns AS (SELECT graph, string_agg(label, ',' ORDER BY label) AS c, string_agg(label || '=' || value, ',' ORDER BY label || '=' || value) AS i FROM nn GROUP BY 1),
  es AS (SELECT ee.graph, string_agg(a.label || '>' || b.label, ',' ORDER BY a.label || '>' || b.label) AS e FROM ee JOIN nn a ON a.graph = ee.graph AND a.node = ee.src JOIN nn b ON b.graph = ee.graph AND b.node = ee.dst GROUP BY 1)
  SELECT 'class' AS kind, count(*) AS pipelines, count(DISTINCT c || ';' || coalesce(e, '')) AS hashes FROM ns LEFT JOIN es USING (graph) UNION ALL SELECT 'instance', count(*), count(DISTINCT i || ';' || coalesce(e, '')) FROM ns LEFT JOIN es USING (graph)""" % tuple(corpus._string(corpus._field(*x)) for x in (("v", "name"), ("v", "class_type", "type"), ("v", "value"), ("v", "source", "src"), ("v", "destination", "dst", "target")))


@query("X13_class_hash", _HASH)
def x13(s, d):
    """How many pipelines share a class hash and how many an instance hash."""
    n, e = pipeline_graphs(s, d)
    one = g.class_hash(n, e).agg(F.lit("class").alias("kind"), F.count(F.lit(1)).alias("pipelines"), F.count_distinct("hash").alias("hashes"))
    return one.unionByName(g.class_hash(n, e, "value").agg(F.lit("instance").alias("kind"), F.count(F.lit(1)).alias("pipelines"), F.count_distinct("hash").alias("hashes")))


@query("X14_instance_hash", "WITH n AS (SELECT l_orderkey AS graph, l_linenumber AS i, p_brand AS b, p_brand || '=' || l_quantity::BIGINT AS v FROM lineitem JOIN part ON l_partkey = p_partkey), ns AS (SELECT graph, string_agg(v, ',' ORDER BY v) AS ns FROM n GROUP BY 1), es AS (SELECT x.graph, string_agg(x.b || '>' || y.b, ',' ORDER BY x.b || '>' || y.b) AS es FROM n x JOIN n y ON x.graph = y.graph AND y.i = x.i + 1 GROUP BY 1) SELECT graph, sha256(ns || ';' || coalesce(es, '')) AS hash FROM ns LEFT JOIN es USING (graph)")
def x14(s, d):
    """An order's lines as a chain of parts, with their quantities."""
    li = load(s, d, "lineitem").join(load(s, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    n = li.select(F.col("l_orderkey").alias("graph"), F.col("l_linenumber").cast("string").alias("node"), F.col("p_brand").alias("label"), F.col("l_quantity").cast("bigint").cast("string").alias("v"))
    e = n.select("graph", F.col("node").alias("src"), (F.col("node").cast("int") + 1).cast("string").alias("dst")).distinct()
    return g.class_hash(n, e, "v")


@query("X20_expected_improvement", "WITH m AS (SELECT event_type, avg(value) AS mu, stddev_pop(value) AS sd FROM events GROUP BY 1), z AS (SELECT *, (mu - 50) / sd AS z FROM m), p AS (SELECT *, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) AS t FROM z), c AS (SELECT *, 0.5 * (1 + sign(z) * (1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-z * z / 2))) AS phi FROM p) SELECT event_type, (mu - 50) * phi + sd * exp(-z * z / 2) / sqrt(2 * pi()) AS ei FROM c")
def x20(s, d):
    m_ = load(s, d, "events").groupBy("event_type").agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sigma"))
    return m_.select("event_type", k.expected_improvement(F.col("mu"), F.col("sigma"), F.lit(50.0)).alias("ei"))


@query("L11_hedge", "WITH w AS (SELECT event_type, 0.001 * sum(value) AS lw FROM events GROUP BY 1), e AS (SELECT event_type, lw, exp(lw - max(lw) OVER ()) AS e FROM w) SELECT event_type, round(lw, 6) AS log_weight, round(e / sum(e) OVER (), 6) AS p FROM e")
def l11(s, d):
    h = k.hedge(load(s, d, "events"), "event_type", "value", 0.001)
    return h.select("event_type", F.round("log_weight", 6).alias("log_weight"), F.round("p", 6).alias("p"))


QUERIES = Q
