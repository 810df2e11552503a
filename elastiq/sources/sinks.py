"""Where result tables go: versioned folders, or tables of a catalog.

Both replace a table as a whole and add a run to the history, and both leave the old table readable until the new one is
complete, so that a write that fails changes nothing. Rows are written once, to the place of a new version, and then published.
"""

from __future__ import annotations

import datetime as dt
import uuid
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from elastiq.sources import files
from elastiq.sources.history import RUN, append_history, run_name, stamped

# The pointer file of a folder table holds the name of its current version.
POINTER = "_current"


class Sink(Protocol):
    def place(self, name: str) -> str | None:
        """A folder for the rows of a new version, or None where only the catalog knows places."""

    def publish(self, name: str, path: str) -> None:
        """Make the rows in ``path`` the table."""

    def replace(self, df: DataFrame, name: str) -> None: ...

    def append_run(self, df: DataFrame, name: str, run_ts: dt.datetime) -> None: ...

    def read(self, name: str) -> DataFrame: ...


def sink(spark: SparkSession, target: str) -> Sink:
    """``catalog:my_schema`` (or ``catalog:my_catalog.my_schema``), else a folder."""
    if target.startswith("catalog:"):
        return CatalogSink(spark, target.removeprefix("catalog:"))
    return FolderSink(spark, target)


def _new_version(table: str) -> str:
    return f"{table}/version-{uuid.uuid4().hex}"


def _last(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def _keep_versions(spark: SparkSession, table: str, *versions: str | None) -> None:
    for old in files.names(spark, table):
        if old.startswith("version-") and old not in versions:
            files.delete(spark, f"{table}/{old}")


class FolderSink:
    """One folder per table with a folder per version and a pointer to the current one, which is swapped last.

    The version before the current one stays for readers that have it open; older ones go.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def place(self, name: str) -> str:
        return _new_version(f"{self.root}/{name}")

    def publish(self, name: str, path: str) -> None:
        at, version = f"{self.root}/{name}", _last(path)
        before = files.read_text(self.spark, f"{at}/{POINTER}")
        files.write_text(self.spark, f"{at}/{POINTER}", version)
        _keep_versions(self.spark, at, version, before)

    def replace(self, df: DataFrame, name: str) -> None:
        path = self.place(name)
        df.hint("rebalance").write.parquet(path)
        self.publish(name, path)

    def append_run(self, df: DataFrame, name: str, run_ts: dt.datetime) -> None:
        append_history(df, f"{self.root}/{name}", run_ts)

    def path(self, name: str) -> str:
        """The folder that holds the rows of a table now."""
        version = files.read_text(self.spark, f"{self.root}/{name}/{POINTER}")
        return f"{self.root}/{name}/{version}" if version else f"{self.root}/{name}"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


class CatalogSink:
    """Tables of a catalog schema.

    A catalog that supports it (any but Spark's own) replaces a table in one step: ``createOrReplace`` and ``overwritePartitions``.
    Spark's own catalog can't, so there the rows of a new version are written below the schema's location first, and
    the table is then pointed at them.
    """

    def __init__(self, spark: SparkSession, schema: str) -> None:
        self.spark, self.schema = spark, schema
        catalog = schema.split(".")[0] if "." in schema else spark.catalog.currentCatalog()
        self.own = catalog == "spark_catalog"

    def _name(self, name: str) -> str:
        return ".".join(f"`{part}`" for part in (*self.schema.split("."), name))

    def _folder(self, name: str) -> str:
        quoted = ".".join(f"`{part}`" for part in self.schema.split("."))
        found = self.spark.sql(f"DESCRIBE SCHEMA {quoted}").filter("lower(info_name) = 'location'").first()
        return f"{found['info_value'].rstrip('/')}/{name}-versions"

    def place(self, name: str) -> str | None:
        return _new_version(self._folder(name)) if self.own else None

    def publish(self, name: str, path: str) -> None:
        at, rows = self._name(name), self.spark.read.parquet(path)
        if not self.own:
            rows.writeTo(at).createOrReplace()
            return
        before = self._location(name) if self.spark.catalog.tableExists(at) else None
        # A folder takes columns by name, so only another schema needs another table.
        if before and self.spark.table(at).schema == rows.schema:
            self.spark.sql(f"ALTER TABLE {at} SET LOCATION '{path}'")
            self.spark.catalog.refreshTable(at)
        else:
            self.spark.sql(f"DROP TABLE IF EXISTS {at}")
            self.spark.sql(f"CREATE TABLE {at} USING parquet LOCATION '{path}'")
        _keep_versions(self.spark, self._folder(name), _last(path), _last(before or ""))

    def replace(self, df: DataFrame, name: str) -> None:
        path = self.place(name)
        if path is None:
            df.hint("rebalance").writeTo(self._name(name)).createOrReplace()
        else:
            df.hint("rebalance").write.parquet(path)
            self.publish(name, path)

    def _location(self, name: str) -> str:
        described = self.spark.sql(f"DESCRIBE FORMATTED {self._name(name)}").filter("col_name = 'Location'").first()
        return described["data_type"]

    def append_run(self, df: DataFrame, name: str, run_ts: dt.datetime) -> None:
        """Add a run's rows as a partition of their own; the same run again replaces them."""
        rows, at = stamped(df, run_ts).hint("rebalance"), self._name(name)
        exists = self.spark.catalog.tableExists(at)
        if not self.own:
            if exists:
                rows.writeTo(at).overwritePartitions()
            else:
                rows.writeTo(at).partitionedBy(F.col(RUN)).create()
        elif exists:
            view, columns = f"run_{uuid.uuid4().hex}", ", ".join(f"`{c}`" for c in self.spark.table(at).columns if c != RUN)
            rows.createOrReplaceTempView(view)
            self.spark.sql(f"INSERT OVERWRITE TABLE {at} PARTITION ({RUN} = '{run_name(run_ts)}') SELECT {columns} FROM {view}")
            self.spark.catalog.dropTempView(view)
        else:
            rows.write.partitionBy(RUN).format("parquet").saveAsTable(at)

    def read(self, name: str) -> DataFrame:
        return self.spark.table(self._name(name))
