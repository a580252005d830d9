"""Intermediate tables in the cluster's shared folder.

A staged table cuts lineage: losing an executor later costs a re-read, not a
recomputation. The folder is the one named in `spark.checkpoint.dir`, else it lies below
`spark.sql.warehouse.dir`; both are shared by driver and executors.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staged"
    return root.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """Where this application stages its tables."""
    return f"{shared_dir(spark)}/strayrows/{spark.sparkContext.applicationId}"


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` once and continue from the written table."""
    path = f"{run_dir(df.sparkSession)}/{uuid.uuid4().hex}/{tag}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder, if it exists, in whatever store it lies."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Remove everything this application has staged; no earlier result may be read afterwards."""
    remove(spark, run_dir(spark))
