"""Stages of a run that a later attempt takes up again.

A run is known by a digest of its inputs, its parameters and the library's own code. Its staged tables lie in a folder of
that name below ``spark.checkpoint.dir``, one folder per attempt, and a marker beside them is written once an attempt is
complete. A run that is started again with the same inputs and parameters reads the stages that have a marker and
builds the rest; a changed input file, parameter or rule gives another digest and so another folder. Nothing else decides: there is no
clock and no number of the application in a name.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from elastiq.sources import files
from elastiq.sources.staging import shared_folder

_LIBRARY = Path(__file__).resolve().parents[1]
_OWN_CODE = ("operators", "functions", "sources", "plans")


def code_digest() -> str:
    """Changes whenever the text of a module that takes part in a run does."""
    modules = [_LIBRARY / "params.py", _LIBRARY / "schemas.py"]
    modules += [m for folder in _OWN_CODE for m in sorted((_LIBRARY / folder).glob("*.py"))]
    return hashlib.sha256(b"\0".join(m.name.encode() + b"\0" + m.read_bytes() for m in modules)).hexdigest()


def run_digest(inputs: Iterable[tuple[str, DataFrame]], params: object) -> str:
    """The identity of a run. Of each input counts where its files are, how long and how old.

    ``inputs`` are read tables by name; their files are those that Spark has listed, so a table of a catalog counts as well.
    """
    digest = hashlib.sha256(f"{code_digest()} {params!r}".encode())
    for name, df in inputs:
        found = files.fingerprints(df.sparkSession, sorted(df.inputFiles()))
        digest.update(f"\0{name} {df.schema.simpleString()}\0".encode() + "\n".join(found).encode())
    return digest.hexdigest()[:32]


class Manifest:
    """Staged tables by name: call it like ``stage``.

    ``place`` may give a stage another place for its rows: results are written once, where they will be published.
    """

    def __init__(self, spark: SparkSession, digest: str, place: Callable[[str], str | None] = lambda name: None) -> None:
        self.spark, self.place = spark, place
        self.folder = f"{shared_folder(spark).rstrip('/')}/elastiq/run-{digest}"
        self.reused: list[str] = []
        self.built: list[str] = []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        done = self.find(name)
        if done is not None:
            self.reused.append(name)
            return done
        placed = self.place(name)
        path = placed or f"{self.folder}/{name}/{uuid.uuid4().hex}"
        (df.hint("rebalance") if placed else df).write.parquet(path)
        files.write_text(self.spark, self._marker(name), json.dumps({"path": path, "schema": df.schema.json()}))
        self.built.append(name)
        return self._read(path, df.schema)

    def find(self, name: str) -> DataFrame | None:
        """The table of a stage that was completed, by this or an earlier attempt."""
        marker = self._completed(name)
        return self._read(marker["path"], T.StructType.fromJson(json.loads(marker["schema"]))) if marker else None

    def path(self, name: str) -> str:
        """Where the rows of a completed stage are."""
        return self._completed(name)["path"]

    def _completed(self, name: str) -> dict | None:
        text = files.read_text(self.spark, self._marker(name))
        marker = json.loads(text) if text else None
        # Someone may have removed the rows, but not the marker.
        return marker if marker and files.exists(self.spark, marker["path"]) else None

    def clear(self) -> None:
        """Remove the stages. A job calls it last, once its results are published."""
        files.delete(self.spark, self.folder)

    def _marker(self, name: str) -> str:
        return f"{self.folder}/{name}.json"

    def _read(self, path: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(path)


class Recorded:
    """A source of input tables that each open their files once, however often they are asked for."""

    def __init__(self, source: Callable[[str], DataFrame]) -> None:
        self.source = source
        self.tables: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self.tables:
            self.tables[name] = self.source(name)
        return self.tables[name]
