"""Queries over document filters, scalar functions and sources (F, X, S)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.operators import docstore as doc
from kelpie.operators.exceptions import canonical_message, signature
from kelpie.operators.graphs import parse_triples
from kelpie.operators.similarity import ascii_lower, token_set
from kelpie.plans import relational as rel
from kelpie.sources import formats as fm
from kelpie.sources.tables import load

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _events(s, d) -> DataFrame:
    return load(s, d, "events").select(F.col("event_id").alias("id"), F.col("props").alias("data"), "ts")


def _datasets(s, d) -> DataFrame:
    return load(s, d, "datasets").select("id", F.col("storage").alias("data"), "updated_at")


_EID = "SELECT event_id AS id FROM events WHERE "
_K = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"


def _filter(name: str, spec: dict, where: str):
    @query(name, _EID + where)
    def f(s, d):
        return doc.find(_events(s, d), spec).select("id")


_filter("F01_equality", {"k": 3}, f"{_K} = 3")
_filter("F02_eq_ne", {"k": {"$ne": 3}}, f"{_K} <> 3")
_filter("F03_comparisons", {"k": {"$gt": 2, "$lte": 7}}, f"{_K} > 2 AND {_K} <= 7")
_filter("F04_in", {"k": {"$in": [1, 5, 9]}}, f"{_K} IN (1, 5, 9)")
_filter("F04_in_empty", {"k": {"$in": []}}, "false")
_filter("F05_nin", {"k": {"$nin": [1, 5, 9]}}, f"{_K} NOT IN (1, 5, 9)")
_filter("F06_exists", {"k": {"$exists": True}, "missing": {"$exists": False}}, "json_exists(props, '$.k') AND NOT json_exists(props, '$.missing')")
_filter("F08_boolean", {"$or": [{"k": 1}, {"k": {"$gte": 8}}], "$nor": [{"k": 9}]}, f"({_K} = 1 OR {_K} >= 8) AND NOT ({_K} = 9)")
_filter("F09_id_clause", {"_id": {"$in": [1, 2, 77]}}, "event_id IN (1, 2, 77)")


@query("F01_dotted_path", "SELECT DISTINCT id FROM datasets WHERE json_extract_string(task, '$.type') = 'regression'")
def f01(s, d):
    t = load(s, d, "datasets").select("id", F.col("task").alias("data"))
    return doc.find(t, {"type": "regression"}).select("id").distinct()


@query("F07_regex", "SELECT DISTINCT id FROM datasets WHERE regexp_matches(json_extract_string(storage, '$.path'), 'STORE/[0-9]+/1', 'i')")
def f07(s, d):
    return doc.find(_datasets(s, d), {"path": {"$regex": "STORE/[0-9]+/1", "$options": "i"}}).select("id").distinct()


@query("F11_projection", "SELECT event_id AS id, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS data FROM events")
def f11(s, d):
    return doc.project(_events(s, d).drop("ts"), {"k": 1})


@query("F12_rule_clauses", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45")
def f12(s, d):
    rule = {"operator": "AND", "clauses": [{"column": "l_returnflag", "value": "R"}, {"column": "l_quantity", "op": "gte", "value": 45}]}
    return load(s, d, "lineitem").where(doc.rule(rule)).select("l_orderkey", "l_linenumber")


@query("F13_rule_operators", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') OR o_totalprice BETWEEN 1000 AND 2000")
def f13(s, d):
    rule = {"operator": "OR", "clauses": [{"column": "o_orderstatus", "op": "in", "value": ["F", "P"]}, {"column": "o_totalprice", "op": "between", "value": [1000, 2000]}]}
    return load(s, d, "orders").where(doc.rule(rule)).select("o_orderkey")


@query("F14_path_existence", "WITH n AS (SELECT id, dag, created_at FROM pipelines WHERE json_valid(dag) AND json_type(dag, '$.nodes') = 'OBJECT') SELECT DISTINCT id FROM n, (SELECT unnest(['Snippet']) AS x) WHERE len(list_filter(json_extract_string(dag, '$.nodes.*.class_type'), lambda v: v = x)) > 0")
def f14(s, d):
    v = F.try_variant_get(F.try_parse_json("dag"), "$.nodes", "map<string,struct<class_type:string>>")
    p = load(s, d, "pipelines").select("id", v.alias("n"))
    return p.where(F.exists(F.map_values("n"), lambda x: x["class_type"] == "Snippet")).select("id").distinct()


@query("F15_exclude_ids", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def f15(s, d):
    gone = load(s, d, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return load(s, d, "part").select("p_partkey").join(gone, "p_partkey", "left_anti")


@query("F16_not_nan", "SELECT DISTINCT id FROM evaluations WHERE metric_value IS NOT NULL AND NOT isnan(metric_value)")
def f16(s, d):
    return load(s, d, "evaluations").where(F.col("metric_value").isNotNull() & ~F.isnan("metric_value")).select("id").distinct()


@query("F17_recent_window", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def f17(s, d):
    e = load(s, d, "events")
    anchor = e.agg(F.max("ts").alias("t"))  # one row
    return e.crossJoin(F.broadcast(anchor)).where(F.col("ts") >= F.col("t") - F.expr("INTERVAL 7 DAY")).select("event_id")


@query("T01_text_order", f"SELECT event_id AS id FROM events ORDER BY json_extract_string(props, '$.k'), event_id LIMIT 15")
def t01(s, d):
    """The store orders by a value's text."""
    return doc.find(_events(s, d), {}, sort=[("k", 1), ("_id", 1)], limit=15).select("id")


@query("X01_json_text_path", "SELECT DISTINCT id, json_extract_string(storage, '$.path') AS path, CAST(json_extract_string(storage, '$.bytes') AS BIGINT) AS bytes FROM datasets")
def x01(s, d):
    return _datasets(s, d).select("id", doc.value("path", "string").alias("path"), doc.value("bytes", "bigint").alias("bytes")).distinct()


@query("X02_json_value_path", "SELECT DISTINCT id, json_extract_string(source, '$.kind') AS kind FROM datasets")
def x02(s, d):
    return load(s, d, "datasets").select("id", doc.value("kind", "string", "source").alias("kind")).distinct()


@query("X03_json_kinds", "WITH p AS (SELECT CASE json_type(columns) WHEN 'OBJECT' THEN 'OBJECT' WHEN 'ARRAY' THEN 'ARRAY' ELSE 'OTHER' END AS kind, CASE json_type(columns) WHEN 'OBJECT' THEN len(json_keys(columns)) WHEN 'ARRAY' THEN json_array_length(columns) END AS n FROM datasets WHERE json_valid(columns)) SELECT kind, count(*) AS n, CAST(sum(n) AS BIGINT) AS items FROM p GROUP BY 1")
def x03(s, d):
    v = F.try_parse_json("columns")
    kind = F.schema_of_variant(v)
    p = load(s, d, "datasets").where(v.isNotNull()).select(F.when(F.startswith(kind, F.lit("OBJECT")), "OBJECT").when(F.startswith(kind, F.lit("ARRAY")), "ARRAY").otherwise("OTHER").alias("kind"), F.json_array_length("columns").alias("a"), F.size(F.json_object_keys("columns")).alias("o"))
    n = F.when(F.col("kind") == "OBJECT", F.col("o")).when(F.col("kind") == "ARRAY", F.col("a")).cast("bigint")
    return p.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(n).alias("items"))


@query("X04_nested_rebuild", "SELECT event_id AS id, json_object('actor', json_object('id', user_id, 'kind', event_type), 'event', json_object('ref', json_object('id', event_id)))::VARCHAR AS data FROM events")
def x04(s, d):
    made = doc.nest({"actor.kind": F.col("event_type"), "actor.id": F.col("user_id"), "event.ref.id": F.col("event_id")})
    return load(s, d, "events").select(F.col("event_id").alias("id"), made.alias("data"))


@query("X05_nested_updates", f"SELECT event_id AS id, CASE WHEN {_K} >= 5 THEN '{{{{\"k\":' || CAST({_K} AS BIGINT) || ',\"meta\":{{{{\"by\":{{{{\"who\":\"x\"}}}},\"hits\":2,\"tags\":[\"a\",\"b\"]}}}}}}}}' ELSE props END AS data FROM events".replace("{{", "{").replace("}}", "}"))
def x05b(s, d):
    """Paths that are not there are made; taking something out of one that isn't there changes nothing."""
    ops = {"$set": {"meta.by.who": "x"}, "$inc": {"meta.hits": 2}, "$push": {"meta.tags": {"$each": ["a", "b"]}}, "$unset": {"gone.away": 1}}
    return doc.update(_events(s, d).drop("ts"), {"k": {"$gte": 5}}, ops).select("id", "data")


@query("F10_unknown_operators", "SELECT op, NOT regexp_matches(op, '^.(eq|ne|gte?|lte?|n?in|exists|regex)$') AS refused FROM (SELECT unnest(['$eq', '$ne', '$gt', '$gte', '$lt', '$lte', '$in', '$nin', '$exists', '$regex', '$size', '$near', '$where']) AS op)")
def f10(s, d):
    """Which operators of a filter are refused when the query is built, before anything runs."""

    def refused(op: str) -> bool:
        v = [1] if op in ("$in", "$nin") else "x" if op == "$regex" else 1
        try:
            doc.find(_events(s, d), {"k": {op: v}})
        except NotImplementedError:
            return True
        return False

    ops = ["$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$exists", "$regex", "$size", "$near", "$where"]
    return s.createDataFrame([(o, refused(o)) for o in ops], "op string, refused boolean")


@query("X05_updates", f"SELECT event_id AS id, '{{\"k\":' || CAST({_K} + 10 AS BIGINT) || ',\"tag\":\"x\"}}' AS data FROM events WHERE {_K} >= 5")
def x05(s, d):
    u = doc.update(_events(s, d).drop("ts"), {"k": {"$gte": 5}}, {"$inc": {"k": 10}, "$set": {"tag": "x"}})
    return u.where(doc.where({"tag": "x"}))


@query("X06_delete_count", f"SELECT count(*) AS n FROM events WHERE NOT ({_K} < 3)")
def x06(s, d):
    e = _events(s, d)
    return e.where(~doc.where({"k": {"$lt": 3}})).agg(F.count(F.lit(1)).alias("n"))


def _canon(c: str) -> str:
    """In SQL, whose regexes know no look-around: what precedes and follows a match is put back, and numbers are replaced twice, as neighbours share it."""
    bs = chr(92)
    rules = [(f"[a-zA-Z]:{bs}{bs}[^{bs}s''" + f'"]+{bs}{bs}[^{bs}s' + """''"]+""", "<PATH>"), (f"(^|[^{bs}w''])/(?:[^{bs}s''" + f'"/]+/)+[^{bs}s' + """''"]+""", f"{bs}1<PATH>"), ('"[^"]*"', "''<STR>''"), ("''[^'']*''", "''<STR>''"), ("0x[0-9a-fA-F]+", "<HEX>")]
    rules += [(f"(^|[^{bs}w.])-?[0-9]+{bs}.[0-9]+($|[^{bs}w.])", f"{bs}1<NUM>{bs}2")] * 2 + [(f"(^|[^{bs}w.])-?[0-9]+($|[^{bs}w.])", f"{bs}1<NUM>{bs}2")] * 2 + [(f"{bs}s+", " ")]
    for p, t in rules:
        c = f"regexp_replace({c}, '{p}', '{t}', 'g')"
    return f"trim({c})"


@query("X07_canonical_messages", f"WITH {rel.EV} SELECT id, {_canon('error_message')} AS message FROM ev WHERE error_message IS NOT NULL")
def x07(s, d):
    return rel.evals(s, d).where("error_message is not null").select("id", canonical_message(F.col("error_message")).alias("message"))


#: The libraries whose operators occur in this store.
_LIBRARIES = ["graftml", "mosaiq", "nuvo", "orchid", "plinth", "quern", "sievepy", "tabkit"]
_X08 = f"""
  WITH t AS (SELECT doc_id, text, regexp_extract(text, '(?s)Traceback \\(most recent call last\\):.*?\\n([A-Za-z_][\\w.]*)(?:: ([^\\n]*))?(?:\\n|$)', ['kind', 'msg']) AS e,
      regexp_extract_all(text, 'File "([^"]+)", line \\d+, in (\\S+)', 1) AS fs, regexp_extract_all(text, 'File "([^"]+)", line \\d+, in (\\S+)', 2) AS ns
    FROM documents WHERE contains(text, 'Traceback (most recent call last):')),
  f AS (SELECT doc_id, e, ns, list_transform(fs, lambda x: replace(regexp_replace(regexp_replace(x, '^/srv/|^/', ''), '\\.py$', ''), '/', '.')) AS ms FROM t WHERE e.kind <> ''),
  g AS (SELECT *, list_max(list_filter(range(1, len(ms) + 1), lambda i: split_part(ms[i], '.', 1) IN ({", ".join(f"'{x}'" for x in _LIBRARIES)}))) AS k FROM f),
  s AS (SELECT doc_id, split_part(e.kind, '.', -1) AS exception_type, {_canon("e.msg")} AS message_template,
      coalesce(ms[k] || '.' || ns[k], '') AS operator_fqn, coalesce(array_to_string(string_split(ms[len(ms)], '.')[1:3], '.'), '') AS site_library,
      CAST(CASE WHEN k IS NULL THEN 0 ELSE len(ms) - k END AS INTEGER) AS user_frame_depth FROM g)
  SELECT *, sha256('exception_type' || chr(0) || exception_type || chr(0) || 'message_template' || chr(0) || message_template || chr(0) || 'operator_fqn' || chr(0) || operator_fqn || chr(0)
    || 'site_library' || chr(0) || site_library || chr(0) || 'user_frame_depth' || chr(0) || user_frame_depth || chr(0)) AS signature FROM s"""


@query("X08_traceback_signature", _X08)
def x08(s, d):
    t = load(s, d, "documents").where(F.col("text").contains("Traceback (most recent call last):"))
    return t.select("doc_id", *[c.alias(k) for k, c in signature(F.col("text"), _LIBRARIES).items()]).where("signature is not null")


@query("X09_tokens", "SELECT doc_id, len(list_filter(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '([a-z_][a-z0-9_]+)', 1)), lambda x: x NOT IN ('the', 'and', 'def', 'return'))) AS n_tokens FROM documents WHERE text IS NOT NULL")
def x09(s, d):
    t = load(s, d, "documents").where("text is not null")
    return t.select("doc_id", F.size(token_set(F.col("text"), ["the", "and", "def", "return"], ascii_lower)).cast("bigint").alias("n_tokens"))


@query("X10_math", "SELECT event_id, round(ln(1 + value), 6) AS l, round(exp(-value / 100), 6) AS e, round(sqrt(value), 6) AS s, round(pow(value, 1.5), 3) AS p, abs(value - 50) AS a FROM events")
def x10(s, d):
    v = F.col("value")
    return load(s, d, "events").select("event_id", F.round(F.log1p(v), 6).alias("l"), F.round(F.exp(-v / 100), 6).alias("e"), F.round(F.sqrt(v), 6).alias("s"), F.round(F.pow(v, F.lit(1.5)), 3).alias("p"), F.abs(v - 50).alias("a"))


@query("X11_round_before_hash", "SELECT l_returnflag, count(DISTINCT round(l_extendedprice, -2)) AS n FROM lineitem GROUP BY 1")
def x11(s, d):
    return load(s, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct(F.round("l_extendedprice", -2)).alias("n"))


@query("X12_canonical_json_hash", "SELECT n_nationkey, sha256('{\"key\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}') AS hash FROM nation")
def x12(s, d):
    n = load(s, d, "nation")
    return n.select("n_nationkey", F.sha2(F.to_json(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))), 256).alias("hash"))


@query("X15_content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents WHERE text IS NOT NULL")
def x15(s, d):
    return load(s, d, "documents").where("text is not null").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))


@query("X16_wildcard_compare", "SELECT p_partkey FROM part WHERE regexp_full_match(p_brand, '.*[135]')")
def x16(s, d):
    return load(s, d, "part").where(F.col("p_brand").rlike("^.*[135]$")).select("p_partkey")


@query("X17_strings", "SELECT DISTINCT source, trim(lower(source)) AS t, starts_with(source, 'run') AS r, string_split(trim(lower(source)), '_')[1] AS first FROM documents WHERE source IS NOT NULL")
def x17(s, d):
    t = F.trim(F.lower("source"))
    return load(s, d, "documents").where("source is not null").select("source", t.alias("t"), F.startswith("source", F.lit("run")).alias("r"), F.split(t, "_")[0].alias("first")).distinct()


@query("X18_dates", "SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS secs, strftime(o_orderdate - INTERVAL 30 DAY, '%Y-%m-%dT%H:%M:%S') AS iso FROM orders")
def x18(s, d):
    secs = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("o_orderdate"))
    return load(s, d, "orders").select("o_orderkey", secs.alias("secs"), F.date_format(F.col("o_orderdate") - F.expr("INTERVAL 30 DAY"), "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("X19_templates", "SELECT n_nationkey, replace(replace('{name} lies in region {region}.', '{name}', n_name), '{region}', CAST(n_regionkey AS VARCHAR)) AS text FROM nation")
def x19(s, d):
    t = F.replace(F.replace(F.lit("{name} lies in region {region}."), F.lit("{name}"), F.col("n_name")), F.lit("{region}"), F.col("n_regionkey").cast("string"))
    return load(s, d, "nation").select("n_nationkey", t.alias("text"))


# Sources and sinks: round trips through the shared folder.


@query("S01_csv_scan", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def s01(s, d):
    path = fm.write_csv(load(s, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"), fm.scratch(s))
    return fm.read(s, path, "text/csv", "p_partkey bigint, p_name string, p_size int, p_retailprice double")


@query("S02_arrow_scan", "SELECT n_nationkey, n_name FROM nation")
def s02(s, d):
    """A table of fixed size across the Arrow boundary and back."""
    return s.createDataFrame(load(s, d, "nation").select("n_nationkey", "n_name").toArrow())


@query("S03_loader_by_mime", "SELECT c_custkey, c_mktsegment FROM customer")
def s03(s, d):
    path = fm.dump_json(load(s, d, "customer").select("c_custkey", "c_mktsegment"), fm.scratch(s))
    return fm.read(s, path, "application/json").select("c_custkey", "c_mktsegment")


@query("S04_split_target", "SELECT c_mktsegment AS target, count(*) AS n FROM customer GROUP BY 1")
def s04(s, d):
    _, y = fm.split_target(load(s, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"))
    return y.groupBy(F.col("c_mktsegment").alias("target")).agg(F.count(F.lit(1)).alias("n"))


@query("S05_scan_with_predicate", f"SELECT event_id AS id FROM events WHERE {_K} = 4 ORDER BY ts, event_id LIMIT 20 OFFSET 5")
def s05(s, d):
    return doc.find(_events(s, d), {"k": 4}).orderBy("ts", "id").offset(5).limit(20).select("id")


@query("S06_json_dump", "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys FROM orders")
def s06(s, d):
    path = fm.dump_json(load(s, d, "orders").select("o_orderkey", "o_orderstatus"), fm.scratch(s))
    return s.read.json(path).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("keys"))


@query("S07_restore_upsert", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'old' ELSE 'restored' END AS state FROM supplier")
def s07(s, d):
    x = load(s, d, "supplier").select("s_suppkey")
    path = fm.dump_json(x.where("s_suppkey % 2 = 1").withColumn("state", F.lit("restored")), fm.scratch(s))
    return rel.r.upsert(x.withColumn("state", F.lit("old")), s.read.schema("s_suppkey bigint, state string").json(path), ["s_suppkey"])


@query("S11_artefact_store", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def s11(s, d):
    store = fm.ArtefactStore(s)
    make = lambda: load(s, d, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    store.get(f"{d}/flags", make)
    return store.get(f"{d}/flags", make)


@query("S12_insert", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey + 100, r_name FROM region")
def s12(s, d):
    r, path = load(s, d, "region").select("r_regionkey", "r_name"), fm.scratch(s)
    fm.append(r, path)
    return s.read.parquet(fm.append(r.withColumn("r_regionkey", F.col("r_regionkey") + 100), path))


@query("S13_triples", "SELECT n_name AS subject, CASE WHEN n_regionkey = 1 THEN 'is not in' ELSE 'is in' END AS predicate, 'R' || n_regionkey AS object FROM nation")
def s13(s, d):
    n = load(s, d, "nation").select(F.concat_ws(" ", "n_name", F.when(F.col("n_regionkey") == 1, "is not in").otherwise("is in"), F.concat(F.lit("R"), "n_regionkey")).alias("value"))
    return parse_triples(n, ["is", "is in", "is not in"])


@query("S14_pivot", "WITH p AS (SELECT l_orderkey, min(l_quantity) FILTER (l_returnflag = 'A') AS A, min(l_quantity) FILTER (l_returnflag = 'R') AS R FROM lineitem GROUP BY 1) SELECT * FROM p WHERE A IS NOT NULL AND R IS NOT NULL")
def s14(s, d):
    return fm.pivot_first(load(s, d, "lineitem"), ["l_orderkey"], "l_returnflag", "l_quantity", ["A", "R"])


@query("S15_csv_export", "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0")
def s15(s, d):
    path = fm.write_csv(load(s, d, "supplier").where("s_acctbal > 0").select("s_suppkey", "s_name"), fm.scratch(s))
    return s.read.csv(path, header=True, schema="s_suppkey bigint, s_name string")


QUERIES = Q
