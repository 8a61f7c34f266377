"""Queries of the general training-data problems (2, 5 and 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.operators import references as ref
from kelpie.operators.shred import flatten
from kelpie.operators.widen import cells, widened
from kelpie.plans import experiments as x

#: How this store types the metrics that are not plain scores.
METRIC_TYPES = {"n_test_rows": "bigint", "n_clusters": "bigint", "converged": "boolean"}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return ref.orphans(x.references(spark, d), x.parents(spark, d))


def p2_orphans(spark: SparkSession, d: str) -> DataFrame:
    return ref.report(p2_found(spark, d))


def _wide(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    return widened(x.metric_rows(spark, d), "run_id", "metric", "metric_value", ["at", "id"], source="id", types=METRIC_TYPES)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    wide, names = _wide(spark, d)
    return cells(wide, "run_id", names).select("run_id", F.col("attribute").alias("metric"), F.col("source").alias("evaluation_id"))


def p5_wide(spark: SparkSession, d: str) -> DataFrame:
    wide, names = _wide(spark, d)
    return wide.select("run_id", *[f"`{n}`" for n in names])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    pipes, sets = x.current_pipelines(spark, d, ["dag"]), x.current_datasets(spark, d, ["columns", "profile"])
    parts = [flatten(pipes, "id", "dag", "dag"), flatten(sets, "id", "columns", "columns"), flatten(sets, "id", "profile", "profile").where(F.col("kind") != "scalar")]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.select("owner_id", "kind", "path")


def p6_nodes(spark: SparkSession, d: str) -> DataFrame:
    out = flatten(x.current_pipelines(spark, d, ["dag"]), "id", "dag", "dag", "node", ["class_type", "name", "dtype", "value", "language"])
    return out.select("owner_id", "parent", "path", "class_type", "name", "dtype", "value", "language")


def p6_edges(spark: SparkSession, d: str) -> DataFrame:
    out = flatten(x.current_pipelines(spark, d, ["dag"]), "id", "dag", "dag", "edge", ["source", "destination", "position", "output"])
    return out.select("owner_id", "parent", "path", "source", "destination", "position", "output")


def p6_ports(spark: SparkSession, d: str) -> DataFrame:
    out = flatten(x.current_pipelines(spark, d, ["dag"]), "id", "dag", "dag", "port", ["direction", "node", "handle"])
    return out.select("owner_id", "parent", "path", "direction", "node", "handle")


def p6_columns(spark: SparkSession, d: str) -> DataFrame:
    out = flatten(x.current_datasets(spark, d, ["columns"]), "id", "columns", "columns", "column", ["inferred_type", "null_count", "null_pct", "min", "max"])
    return out.select("owner_id", "path", "place", "inferred_type", "null_count", "null_pct", "min", "max")


def p6_categories(spark: SparkSession, d: str) -> DataFrame:
    out = flatten(x.current_datasets(spark, d, ["columns"]), "id", "columns", "columns", "category", ["value", "count"])
    return out.select("owner_id", F.col("parent").alias("column_name"), "path", "value", F.col("count").alias("n"))


def p6_profile(spark: SparkSession, d: str) -> DataFrame:
    """Scalars, class counts and component ratios of every current profile, one row each."""
    sets = x.current_datasets(spark, d, ["profile"])
    parts = [flatten(sets, "id", "profile", "profile", k, [v]).select("owner_id", "kind", "path", F.col(v).alias("number")) for k, v in (("scalar", "number"), ("class", "n"), ("component", "ratio"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


QUERIES = {"p2_found": p2_found, "p2_orphans": p2_orphans, "p5_found": p5_found, "p5_wide": p5_wide, "p6_found": p6_found, "p6_nodes": p6_nodes, "p6_edges": p6_edges, "p6_ports": p6_ports, "p6_columns": p6_columns, "p6_categories": p6_categories, "p6_profile": p6_profile}

_P2 = """
  WITH ev AS (
    SELECT DISTINCT id, nullif(lower(trim(pipeline_id)), '') AS pid, nullif(lower(trim(dataset_id)), '') AS did, created_at
    FROM evaluations),
  refs AS (
    SELECT id, 'pipelines' AS ref_table, pid AS k, created_at FROM ev WHERE pid IS NOT NULL
    UNION ALL SELECT id, 'datasets', did, created_at FROM ev WHERE did IS NOT NULL),
  live AS (
    SELECT 'pipelines' AS ref_table, lower(trim(id)) AS k, min(created_at) AS born FROM pipelines GROUP BY 2
    UNION ALL SELECT 'datasets', lower(trim(id)), min(created_at) FROM datasets GROUP BY 2),
  gone AS (SELECT DISTINCT lower(trim(table_name)) AS ref_table, lower(trim(record_id)) AS k FROM deletions),
  found AS (
    SELECT r.id AS evaluation_id, r.ref_table,
           CASE WHEN l.k IS NOT NULL THEN CASE WHEN l.born > r.created_at THEN 'late' END
                WHEN g.k IS NOT NULL THEN 'deleted' ELSE 'missing' END AS state,
           coalesce(strftime(r.created_at, '%Y-%m'), 'none') AS period
    FROM refs r LEFT JOIN live l ON r.ref_table = l.ref_table AND r.k = l.k
                LEFT JOIN gone g ON r.ref_table = g.ref_table AND r.k = g.k)
"""
_P5_CELLS = """
  WITH m AS (
    SELECT DISTINCT id, run_id, replace(replace(lower(trim(metric_name)), '-', '_'), ' ', '_') AS metric, metric_value, created_at
    FROM evaluations WHERE run_id IS NOT NULL),
  best AS (
    SELECT run_id, metric, id, metric_value FROM m
    WHERE metric NOT IN ('', '__none__', '__failed__') AND metric_value IS NOT NULL AND isfinite(metric_value)
    QUALIFY row_number() OVER (PARTITION BY run_id, metric ORDER BY created_at DESC NULLS LAST, id DESC) = 1)
"""



def _field(j: str, *names: str) -> str:
    """In SQL: the JSON at the first of these fields, in any of the spellings that occur; null if absent or a JSON null."""
    ways = []
    for n in names:
        head, *rest = n.split("_")
        camel = head + "".join(w.title() for w in rest)
        ways += [n, camel, n.replace("_", "-"), camel[:1].upper() + camel[1:]]
    return "coalesce(" + ", ".join(f"""nullif(json_extract({j}, '$."{w}"'), 'null'::JSON)""" for w in dict.fromkeys(ways)) + ")"


def _string(j: str) -> str:
    return f"({j} ->> '$')"


def _double(j: str) -> str:
    return f"CASE WHEN json_type({j}) <> 'BOOLEAN' THEN try_cast({j} ->> '$' AS DOUBLE) END"


def _current(table: str, column: str, newest: str) -> str:
    return f"""SELECT lower(trim(id)) AS oid, {column} AS t FROM {table} WHERE trim(id) <> ''
      QUALIFY row_number() OVER (PARTITION BY lower(trim(id)) ORDER BY {newest} DESC NULLS LAST, {column} DESC NULLS LAST) = 1"""


def _each(holder: str, key: str) -> str:
    """In SQL: an item's name, held by a keyed object or a list."""
    return f"CASE WHEN json_type({holder}) = 'OBJECT' THEN e.key ELSE {_string(_field('e.value', key))} END"


#: In SQL: the complete documents; one that is held in a JSON string is taken out of it.
_DOC = """open AS (SELECT oid, CASE WHEN json_type(try_cast(t AS JSON)) = 'VARCHAR' THEN try_cast(t AS JSON) ->> '$' ELSE t END AS t FROM cur WHERE json_valid(t)),
  doc AS MATERIALIZED (SELECT oid, try_cast(t AS JSON) AS j FROM open WHERE json_valid(t))"""
_N = f"""
  WITH RECURSIVE cur AS ({_current("pipelines", "dag", "created_at")}),
  {_DOC},
  top AS MATERIALIZED (SELECT oid, {_field("j", "nodes")} AS h, {_field("j", "edges")} AS edges FROM doc),
  n AS (
    SELECT oid, '' AS up, {_each("h", "id")} AS spot, e.value AS v FROM top, json_each(h) e WHERE e.type <> 'NULL'
    UNION ALL
    SELECT oid, spot AS up, spot || '/' || {_each("h", "id")} AS spot, e.value AS v
    FROM (SELECT oid, spot, {_field("v", "children")} AS h FROM n) g, json_each(h) e WHERE e.type <> 'NULL'),
  ed AS (
    SELECT oid, '' AS up, '#' || e.key AS spot, e.value AS v FROM top, json_each(edges) e WHERE e.type <> 'NULL'
    UNION ALL
    SELECT oid, spot AS up, spot || '#' || e.key AS spot, e.value AS v
    FROM (SELECT oid, spot, {_field("v", "internal_edges")} AS h FROM n) g, json_each(h) e WHERE e.type <> 'NULL'),
  po AS (
    SELECT oid, spot AS up, spot || '@' || {_each("h", "name")} AS spot, e.value AS v
    FROM (SELECT oid, spot, {_field("v", "io_map")} AS h FROM n) g, json_each(h) e WHERE e.type <> 'NULL')
"""
_C = f"""
  WITH cur AS ({_current("datasets", "columns", "updated_at")}),
  {_DOC},
  col AS (
    SELECT oid, {_each("j", "name")} AS spot, CAST(row_number() OVER (PARTITION BY oid ORDER BY e.id) - 1 AS INTEGER) AS place, e.value AS v, e.type AS kind
    FROM doc, json_each(j) e),
  cat AS (
    SELECT oid, spot AS up, spot || '#' || e.key AS spot, e.value AS v
    FROM (SELECT oid, spot, coalesce({_field("v", "categories")}, {_field(_field("v", "stats"), "categories")}) AS h FROM col WHERE kind <> 'NULL') g, json_each(h) e WHERE e.type <> 'NULL')
"""
_F = f"""
  WITH cur AS ({_current("datasets", "profile", "updated_at")}),
  {_DOC},
  sc AS (SELECT oid, 'scalar' AS kind, e.key AS spot, {_double("e.value")} AS number FROM doc, json_each(j) e WHERE json_type(j) = 'OBJECT' AND e.type NOT IN ('NULL', 'OBJECT', 'ARRAY')),
  cl AS (
    SELECT oid, 'class' AS kind, {_each("h", "label")} AS spot, CASE WHEN e.type = 'OBJECT' THEN {_double(_field("e.value", "count"))} ELSE {_double("e.value")} END AS number
    FROM (SELECT oid, coalesce({_field("j", "ClassOccurences")}, {_field("j", "class_occurences")}) AS h FROM doc) g, json_each(h) e WHERE e.type <> 'NULL'),
  pc AS (SELECT oid, coalesce({_field("j", "PCA")}, {_field("j", "pca")}) AS p FROM doc),
  co AS (
    SELECT oid, 'component' AS kind, '#' || e.key AS spot, {_double(_field("e.value", "ratio"))} AS number
    FROM (SELECT oid, CASE WHEN json_type(p) = 'ARRAY' THEN p ELSE {_field("p", "components")} END AS h FROM pc) g, json_each(h) e WHERE e.type <> 'NULL')
"""


def _texts(v: str, **names: tuple[str, ...]) -> str:
    return ", ".join(f"{_string(_field(v, *n))} AS {k}" for k, n in names.items())


_FOUND = f"""SELECT oid AS owner_id, kind, spot AS path FROM (
    SELECT * FROM ({_N} SELECT oid, 'node' AS kind, spot FROM n UNION ALL SELECT oid, 'edge', spot FROM ed UNION ALL SELECT oid, 'port', spot FROM po)
    UNION ALL SELECT * FROM ({_C} SELECT oid, 'column' AS kind, spot FROM col WHERE kind <> 'NULL' UNION ALL SELECT oid, 'category', spot FROM cat)
    UNION ALL SELECT * FROM ({_F} SELECT oid, kind, spot FROM cl UNION ALL SELECT oid, kind, spot FROM co))
  WHERE spot IS NOT NULL"""

#: The metrics of the wide table's SQL, in the order of its columns.
_METRICS = ["accuracy", "converged", "davies_index", "f1_macro", "fairness_gap", "fit_seconds", "log_loss", "mae", "mape", "median_ae", "n_clusters", "n_test_rows", "peak_mb", "precision", "r2", "recall", "rmse", "roc_auc", "silhouette", "weighted_kappa"]


def _cell(m: str) -> str:
    v = f"max(CASE WHEN metric = '{m}' THEN metric_value END)"
    kind = METRIC_TYPES.get(m)
    return f"CAST({v} AS {kind.upper()}) AS {m}" if kind else f"{v} AS {m}"


SQL = {
    "p2_found": _P2 + "SELECT evaluation_id, ref_table, state, period FROM found WHERE state IS NOT NULL",
    "p2_orphans": _P2 + "SELECT ref_table, state, period, count(*) AS n_refs FROM found WHERE state IS NOT NULL GROUP BY ALL",
    "p5_found": _P5_CELLS + "SELECT run_id, metric, id AS evaluation_id FROM best",
    "p5_wide": _P5_CELLS + ", runs AS (SELECT DISTINCT run_id FROM m) SELECT r.run_id, " + ", ".join(map(_cell, _METRICS)) + " FROM runs r LEFT JOIN best b ON r.run_id = b.run_id GROUP BY r.run_id",
    "p6_found": _FOUND,
    "p6_nodes": _N + f"SELECT oid AS owner_id, up AS parent, spot AS path, {_texts('v', class_type=('class_type', 'type'), name=('name',), dtype=('dtype',), value=('value',), language=('language',))} FROM n WHERE spot IS NOT NULL",
    "p6_edges": _N + f"SELECT oid AS owner_id, up AS parent, spot AS path, {_texts('v', source=('source', 'src'), destination=('destination', 'dst', 'target'), position=('position',), output=('output',))} FROM ed WHERE spot IS NOT NULL",
    "p6_ports": _N + f"SELECT oid AS owner_id, up AS parent, spot AS path, {_texts('v', direction=('direction',), node=('internal_node_id',), handle=('internal_handle',))} FROM po WHERE spot IS NOT NULL",
    "p6_columns": _C + f"SELECT oid AS owner_id, spot AS path, place, {_string(_field('v', 'inferred_type'))} AS inferred_type, {_double(_field('v', 'null_count'))} AS null_count, {_double(_field('v', 'null_pct'))} AS null_pct, "
    + ", ".join(f"{_double('coalesce(' + _field('v', x) + ', ' + _field(_field(_field('v', 'stats'), 'range'), x) + ')')} AS {x}" for x in ("min", "max"))
    + " FROM col WHERE spot IS NOT NULL AND kind <> 'NULL'",
    "p6_categories": _C + f"SELECT oid AS owner_id, up AS column_name, spot AS path, {_string(_field('v', 'value'))} AS value, {_double(_field('v', 'count'))} AS n FROM cat WHERE spot IS NOT NULL",
    "p6_profile": _F + "SELECT oid AS owner_id, kind, spot AS path, number FROM (SELECT * FROM sc UNION ALL SELECT * FROM cl UNION ALL SELECT * FROM co) WHERE spot IS NOT NULL",
}
