"""The experiment store's tables in normal form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.functions.keys import epoch_us, norm_id, norm_metric
from kelpie.operators.latest import latest
from kelpie.sources.tables import load


def current_datasets(spark: SparkSession, d: str, keep: list[str]) -> DataFrame:
    """The current row of every data set: latest updated_at, null oldest."""
    return latest(load(spark, d, "datasets").withColumn("id", norm_id("id")), "id", ["updated_at"], keep)


def current_pipelines(spark: SparkSession, d: str, keep: list[str]) -> DataFrame:
    """The current row of every pipeline: latest created_at, null oldest."""
    return latest(load(spark, d, "pipelines").withColumn("id", norm_id("id")), "id", ["created_at"], keep)


def parents(spark: SparkSession, d: str) -> DataFrame:
    """One row per referenced table and key: whether a record exists, whether it was deleted, when it was first created."""
    no_ts = F.lit(None).cast("bigint")
    parts = [load(spark, d, t).select(F.lit(t).alias("ref_table"), norm_id("id").alias("key"), epoch_us("created_at").alias("t"), F.lit(True).alias("p"), F.lit(False).alias("g")) for t in ("pipelines", "datasets")]
    gone = load(spark, d, "deletions").select(norm_id("table_name").alias("ref_table"), norm_id("record_id").alias("key"), no_ts.alias("t"), F.lit(False).alias("p"), F.lit(True).alias("g"))
    every = parts[0].unionByName(parts[1]).unionByName(gone.where(F.col("ref_table").isNotNull()))
    return every.where(F.col("key").isNotNull()).groupBy("ref_table", "key").agg(F.min("t").alias("first_at"), F.max("p").alias("present"), F.max("g").alias("deleted"))


def references(spark: SparkSession, d: str) -> DataFrame:
    """Every reference that an evaluation makes, one row each."""
    ev = load(spark, d, "evaluations").select("id", "pipeline_id", "dataset_id", "created_at")
    both = F.array(F.struct(F.lit("pipelines").alias("t"), norm_id("pipeline_id").alias("k")), F.struct(F.lit("datasets").alias("t"), norm_id("dataset_id").alias("k")))
    out = ev.select("id", epoch_us("created_at").alias("at"), F.coalesce(F.date_format("created_at", "yyyy-MM"), F.lit("none")).alias("period"), F.explode(both).alias("r"))
    return out.select("id", F.col("r.t").alias("ref_table"), F.col("r.k").alias("key"), "at", "period").where(F.col("key").isNotNull())


def metric_rows(spark: SparkSession, d: str) -> DataFrame:
    """Evaluations with their metric in normal form; null where the name says that there is no metric."""
    ev = load(spark, d, "evaluations").select("id", "run_id", "metric_name", "metric_value", "created_at")
    m = norm_metric("metric_name")
    return ev.select("id", "run_id", F.when(~m.isin("__none__", "__failed__"), m).alias("metric"), "metric_value", epoch_us("created_at").alias("at"))
