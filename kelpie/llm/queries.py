"""The training-data queries of this subpackage, and the SQL of those that SQL can say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.functions.keys import norm_id, norm_metric, usable
from kelpie.llm import tokens
from kelpie.llm.mixing import mix, norm_source
from kelpie.llm.reading import reading_level
from kelpie.llm.setjoin import similar_pairs
from kelpie.llm.topn import top_n
from kelpie.llm.vectors import knn
from kelpie.plans import experiments as x
from kelpie.sources.tables import durable, load


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    ev = load(spark, d, "evaluations").select("dataset_id", "pipeline_id", "metric_name", "metric_value", "status")
    ev = ev.where((norm_metric("metric_name") == "accuracy") & (F.col("status") == "success") & usable("metric_value"))
    ev = ev.select(norm_id("dataset_id").alias("dataset_id"), norm_id("pipeline_id").alias("pipeline_id"), "metric_value")
    best = ev.dropna().groupBy("dataset_id", "pipeline_id").agg(F.max("metric_value").alias("score"))
    return top_n(best, ["dataset_id"], [F.desc("score"), F.asc("pipeline_id")], 10).select("dataset_id", "pipeline_id", "rnk")


#: The length of the profile vectors of each version.
VECTOR_LENGTHS = {1: 40, 2: 48}


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest data sets of every data set with a usable profile vector."""
    sets = x.current_datasets(spark, d, ["profile_vec", "vec_version"])
    out = knn(sets, "id", "profile_vec", "vec_version", VECTOR_LENGTHS, 5)
    return out.select(F.col("id").alias("dataset_id"), "neighbour", F.col("dist").alias("distance"), "rnk")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    n = p3_neighbours(spark, d)
    return n.select(F.least("dataset_id", "neighbour").alias("dataset_a"), F.greatest("dataset_id", "neighbour").alias("dataset_b")).distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs, _ = similar_pairs(x.current_pipelines(spark, d, ["operators"]), "id", "operators", 0.8, 4)
    return pairs.select(F.col("a").alias("pipeline_a"), F.col("b").alias("pipeline_b"))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every pipeline that takes part, with its class of equal sets and the number of other classes similar to it."""
    _, members = similar_pairs(x.current_pipelines(spark, d, ["operators"]), "id", "operators", 0.8, 4)
    return members.select(F.col("id").alias("pipeline_id"), "class_id", "n_links")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(load(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = tokens.count(load(spark, d, "documents").select("doc_id", "text", "source"), "doc_id", "text", ["source"])
    return mix(docs, load(spark, d, "mix_targets"))


def p8_selection(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def p8_gaps(spark: SparkSession, d: str) -> DataFrame:
    """How far each source of each mix stays from its target; near: the source was too small, or less than its shortest document is missing
    that could be taken once more."""
    docs = durable(tokens.count(load(spark, d, "documents").select("doc_id", "text", "source"), "doc_id", "text", ["source"]))
    targets = load(spark, d, "mix_targets")
    selection, shares = mix(docs, targets)
    limit = targets.where("weight > 0").groupBy("mix_name", norm_source("source").alias("source")).agg(F.max("max_repeats").alias("m"))
    plain = docs.where("n_tokens > 0").select("doc_id", norm_source("source").alias("source"), "n_tokens")
    left = plain.join(F.broadcast(limit), "source").join(selection.select("mix_name", "doc_id", "copies"), ["mix_name", "doc_id"], "left").where(F.coalesce("copies", F.lit(0)) < F.col("m"))
    left = left.groupBy("mix_name", "source").agg(F.min("n_tokens").alias("shortest_left"))
    near = F.col("full") | ((F.col("gap") >= 0) & (F.col("gap") < F.col("shortest_left")))
    return shares.join(left, ["mix_name", "source"], "left").select("mix_name", "source", "target_tokens", "tokens", F.abs("gap").alias("distance"), "shortest_left", "full", near.alias("near"))


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading_level(load(spark, d, "documents").select("doc_id", "text", "lang"), load(spark, d, "reading_labels"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_levels(spark, d).select("doc_id", "level")


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p4_found": p4_found, "p4_classes": p4_classes, "p7_ids": p7_ids, "p8_selection": p8_selection, "p8_shares": p8_shares, "p8_gaps": p8_gaps, "p9_found": p9_found, "p9_levels": p9_levels}

_SETS = """
  WITH cur AS (
    SELECT DISTINCT lower(trim(id)) AS id, list_sort(list_distinct(list_filter(list_transform(operators, lambda x: lower(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)))), lambda x: x <> ''))) AS s
    FROM pipelines
    QUALIFY row_number() OVER (PARTITION BY lower(trim(id)) ORDER BY created_at DESC NULLS LAST) = 1),
  big AS (SELECT id, s, len(s) AS n FROM cur WHERE len(s) >= 4)
"""

SQL = {
    "p1_found": """
        WITH s AS (
          SELECT nullif(lower(trim(dataset_id)), '') AS dataset_id, nullif(lower(trim(pipeline_id)), '') AS pipeline_id,
                 max(metric_value) AS score
          FROM evaluations
          WHERE replace(replace(lower(trim(metric_name)), '-', '_'), ' ', '_') = 'accuracy' AND status = 'success'
            AND metric_value IS NOT NULL AND isfinite(metric_value)
          GROUP BY 1, 2)
        SELECT dataset_id, pipeline_id, rnk FROM (
          SELECT dataset_id, pipeline_id,
                 CAST(row_number() OVER (PARTITION BY dataset_id ORDER BY score DESC, pipeline_id) AS INTEGER) AS rnk
          FROM s WHERE dataset_id IS NOT NULL AND pipeline_id IS NOT NULL)
        WHERE rnk <= 10""",
    "p3_found": """
        WITH cur AS (
          SELECT lower(trim(id)) AS id, vec_version AS ver,
                 list_transform(profile_vec, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 0.0 ELSE x END) AS v
          FROM datasets
          QUALIFY row_number() OVER (PARTITION BY lower(trim(id)) ORDER BY updated_at DESC NULLS LAST) = 1),
        ok AS (
          SELECT * FROM cur WHERE len(v) = CASE ver WHEN 1 THEN 40 WHEN 2 THEN 48 END AND len(list_filter(v, lambda x: x <> 0)) > 0),
        near AS (
          SELECT a.id AS a, b.id AS b FROM ok a JOIN ok b ON a.ver = b.ver AND a.id <> b.id
          QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) <= 5)
        SELECT DISTINCT least(a, b) AS dataset_a, greatest(a, b) AS dataset_b FROM near""",
    "p4_found": _SETS + """
        SELECT a.id AS pipeline_a, b.id AS pipeline_b FROM big a JOIN big b ON a.id < b.id AND b.n BETWEEN a.n * 0.8 - 0.001 AND a.n / 0.8 + 0.001
        WHERE len(list_intersect(a.s, b.s)) >= 0.8 * len(list_distinct(list_concat(a.s, b.s))) - 1e-9""",
    "p4_classes": _SETS + """
        , c AS (SELECT s, min(id) AS class_id, any_value(n) AS n FROM big GROUP BY s),
        l AS (
          SELECT a.class_id, count(*) AS k FROM c a JOIN c b ON a.class_id <> b.class_id AND b.n BETWEEN a.n * 0.8 - 0.001 AND a.n / 0.8 + 0.001
          WHERE len(list_intersect(a.s, b.s)) >= 0.8 * len(list_distinct(list_concat(a.s, b.s))) - 1e-9 GROUP BY 1)
        SELECT big.id AS pipeline_id, c.class_id, coalesce(l.k, 0) AS n_links FROM big JOIN c ON big.s = c.s LEFT JOIN l ON c.class_id = l.class_id""",
}
