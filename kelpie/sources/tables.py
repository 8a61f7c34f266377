"""Table loading and durable intermediate results."""

from __future__ import annotations

import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` under `sf_dir` (a file, or a directory of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in spark.checkpoint.dir. A temporary folder is made only for a local
    master, whose executors are this process; on a cluster without a shared folder this is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="kelpie-"))
    return sc.getCheckpointDir()


def small_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A few rows of the driver's as a relation that the plan itself holds: no job is run to bring it out."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema)], schema=schema))


def durable(df: DataFrame) -> DataFrame:
    """`df` written once to the shared checkpoint folder: its lineage is cut and executors may be lost afterwards."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
