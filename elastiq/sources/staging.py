"""Intermediate tables on the shared folder of the cluster.

A table that is read more than once is written and read back. That cuts its lineage, survives lost
executors, and gives Spark its real size for the choice between broadcast and shuffle joins.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get(SETTING, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder that all executors can reach")
    folder = tempfile.mkdtemp(prefix="elastiq-")
    spark.conf.set(SETTING, folder)
    return folder


def staged_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/elastiq/{spark.sparkContext.applicationId}"


def drop_staged(spark: SparkSession) -> None:
    """Remove the staged tables of this application. A job calls it last, once its results are written."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(staged_folder(spark))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{staged_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
