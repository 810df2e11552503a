"""Published vendor lists: one gzip JSON document per country, or per country and cluster."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from elastiq.sources import files as store

_SCHEMA = "vendor_ids array<string>, update_timestamp string"
# Fixed value: where the cluster label stands in a file name such as "xx_yy-<cluster>-v1.gzip".
CLUSTER_IN_NAME = r"(?<=.._..-)(.*)(?=-v1)"


def epoch_text(seconds: Column) -> Column:
    """Epoch seconds as ``yyyy-MM-dd HH:mm:ss`` in UTC, whatever the session time zone."""
    ts = F.timestamp_seconds(seconds.cast("bigint"))
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd HH:mm:ss")


def write_published(files: DataFrame, path: str) -> None:
    """Publish each list as one gzip JSON document in a file of its name. ``files`` has one row per name.

    Spark writes a folder per name with the one document in it; the document then moves to its place under its name. Names are dealt
    out over all tasks, which put their documents into the folder for writing themselves. The driver sees names only, and has
    many moves under way at once.
    """
    spark, folder = files.sparkSession, path.rstrip("/")
    writing = f"{folder}/_writing-{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    written = files.repartition(parts, "file_name").write.partitionBy("file_name").option("compression", "gzip")
    # Safe here: no one reads this folder until the write has ended.
    written.option("mapreduce.fileoutputcommitter.algorithm.version", "2").json(writing)
    own = [name for name in store.names(spark, writing) if name.startswith("file_name=")]
    store.move_only_files(spark, [(f"{writing}/{x}", f"{folder}/{unquote(x.removeprefix('file_name='))}") for x in own])
    store.delete(spark, writing)


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: ``file_name, vendor_ids, update_timestamp``."""
    files = spark.read.schema(_SCHEMA).option("multiLine", True).option("pathGlobFilter", "*.gzip").json(path)
    return files.select(F.col("_metadata.file_name").alias("file_name"), "vendor_ids", "update_timestamp")


def published_ids(files: DataFrame, *, with_cluster: bool = False) -> DataFrame:
    """One row per published id. The file name starts with the country and may hold a cluster label."""
    cluster = F.regexp_extract("file_name", CLUSTER_IN_NAME, 1).alias("cluster")
    return files.select(
        F.substring("file_name", 1, 2).alias("country_code"),
        *([cluster] if with_cluster else []),
        epoch_text(F.col("update_timestamp")).alias("update_timestamp"),
        F.explode("vendor_ids").alias("vendor_ids"),
    )
