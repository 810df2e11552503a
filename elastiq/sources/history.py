"""The result table of all runs: one partition per run, so a retry leaves one copy of its rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = "run"


def run_name(run_ts: dt.datetime) -> str:
    return run_ts.astimezone(dt.timezone.utc).strftime("%Y%m%dT%H%M%S.%fZ")


def stamped(df: DataFrame, run_ts: dt.datetime) -> DataFrame:
    """One run's rows, stamped with ``run_ts`` (with time zone), and the name of their partition."""
    return df.withColumn("update_timestamp", F.lit(run_ts)).withColumn(RUN, F.lit(run_name(run_ts)))


def append_history(df: DataFrame, path: str, run_ts: dt.datetime) -> None:
    """Add one run's rows in a partition of its own; writing the same run again replaces it."""
    rows = stamped(df, run_ts).hint("rebalance").write.mode("overwrite")
    rows.option("partitionOverwriteMode", "dynamic").partitionBy(RUN).parquet(path)


def of_run(history: DataFrame, run_ts: dt.datetime) -> DataFrame:
    """One run of the history; only its partition is scanned."""
    return history.filter(F.col(RUN) == run_name(run_ts)).drop(RUN)


def read_run(spark: SparkSession, path: str, run_ts: dt.datetime) -> DataFrame:
    return of_run(spark.read.parquet(path), run_ts)
