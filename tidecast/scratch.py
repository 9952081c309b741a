"""Folders for what jobs write on the way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; below a temporary folder only where a local session has none."""
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not told:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        told = tempfile.mkdtemp(prefix="tidecast-")
    return f"{told.rstrip('/')}/tidecast-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to such a folder and read back: its lineage ends, and executors that are lost cost no work before it.
    The files go when the application ends."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)
