"""Folders for tables that a query writes and reads again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; below the warehouse where none is set."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/stepwright-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """df written as Parquet and read back: cuts its lineage, survives lost executors."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


def swap(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Replace a table by one made from it: written beside it first, then moved into its place.

    A crash before the moves leaves the table as it was; between them the old one is at `path`.old. A move that fails is
    undone and raised, and the old table goes only after the new one is in its place.
    """
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    new, old, now = fs_path(f"{path}.new"), fs_path(f"{path}.old"), fs_path(path)
    df.write.mode("overwrite").parquet(f"{path}.new")
    fs = now.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(old):
        raise FileExistsError(f"{path}.old is left from a swap that broke off")
    if fs.exists(now) and not fs.rename(now, old):
        raise OSError(f"could not move {path} aside")
    if not fs.rename(new, now):
        if fs.exists(old) and not fs.rename(old, now):
            raise OSError(f"could not put {path}.new in place; the old table is at {path}.old")
        raise OSError(f"could not put {path}.new in place")
    if fs.exists(old):
        fs.delete(old, True)
