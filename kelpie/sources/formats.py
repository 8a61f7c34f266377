"""Reading and writing files of several formats (S01..S15)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.sources.tables import checkpoint_dir


def scratch(spark: SparkSession) -> str:
    """A fresh path in the shared folder."""
    return f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"


#: The loader of each MIME type.
LOADERS = {"text/csv": "csv", "text/plain": "text", "application/json": "json", "application/x-ndjson": "json", "application/vnd.apache.parquet": "parquet", "application/vnd.apache.orc": "orc", "application/octet-stream": "binaryFile", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "excel", "application/vnd.ms-excel": "excel"}


def read(spark: SparkSession, path: str, mime: str, schema: str | None = None) -> DataFrame:
    """A file by its MIME type; CSV has a header and, unless a schema is given, inferred types. Spreadsheets are
    small and read by pandas on the driver, where its reader is installed."""
    fmt = LOADERS.get(mime)
    if fmt is None:
        raise ValueError(f"no loader for {mime}")
    if fmt == "excel":
        import pandas as pd

        return spark.createDataFrame(pd.read_excel(path))
    reader = spark.read.schema(schema) if schema else spark.read
    if fmt == "csv":
        return reader.csv(path, header=True, inferSchema=schema is None, multiLine=True, escape='"')
    return reader.format(fmt).load(path)


def write_csv(df: DataFrame, path: str) -> str:
    """With a header; one file per partition."""
    df.write.csv(path, header=True, escape='"', mode="overwrite")
    return path


def dump_json(df: DataFrame, path: str) -> str:
    """JSON lines."""
    df.write.json(path, mode="overwrite", ignoreNullFields=False)
    return path


def append(df: DataFrame, path: str) -> str:
    """Add rows to a parquet table."""
    df.write.mode("append").parquet(path)
    return path


def split_target(df: DataFrame, target: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(features, target); the last column is the target unless one is named."""
    target = target or df.columns[-1]
    return df.drop(target), df.select(target)


def pivot_first(df: DataFrame, index: list[str], column: str, value: str, names: list) -> DataFrame:
    """Tall rows to wide ones, the first (least) value of each cell; entities that lack a value are dropped."""
    return df.groupBy(*index).pivot(column, names).agg(F.min(value)).dropna()


class ArtefactStore:
    """Results kept as parquet under a key; the key is the hash of what makes them."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root or scratch(spark)

    def path(self, key: str) -> str:
        import hashlib

        return f"{self.root}/{hashlib.sha256(key.encode()).hexdigest()}"

    def get(self, key: str, make) -> DataFrame:
        path = self.path(key)
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)
