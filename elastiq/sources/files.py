"""Small files and folders on the file system of a path, whichever Spark can reach."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str) -> tuple[Any, Any]:
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(context._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _path(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _path(spark, path)
    fs.delete(at, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    at, fs = _path(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


# Files that are looked up and renamed at the same time: each waits for the file system, not for the driver.
_AT_ONCE = 32


def _overwriting(spark: SparkSession, fs: Any) -> Any:
    """A rename of one path object to another, over an older file of the new name."""
    context = spark.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs
    options = context._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    every = hadoop.FileContext.getFileContext(fs.getUri(), context._jsc.hadoopConfiguration())
    return lambda source, target: every.rename(source, target, options)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file, over an older one of the new name."""
    at, fs = _path(spark, source)
    _overwriting(spark, fs)(at, _path(spark, target)[0])


def move_only_files(spark: SparkSession, moves: Sequence[tuple[str, str]]) -> None:
    """Rename the only file in each folder, over an older one of its new name; all on one file system, and many under way at once."""
    if not moves:
        return
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    _, fs = _path(spark, moves[0][0])
    replace = _overwriting(spark, fs)

    def rename(pair: tuple[str, str]) -> None:
        (own,) = fs.listStatus(at(pair[0]))
        source, target = own.getPath(), at(pair[1])
        # The plain rename looks less often at the file system, but does not replace a file everywhere.
        if fs.exists(target) or not fs.rename(source, target):
            replace(source, target)

    with ThreadPoolExecutor(min(_AT_ONCE, len(moves))) as pool:
        for _ in pool.map(rename, moves):
            pass


def read_text(spark: SparkSession, path: str) -> str | None:
    at, fs = _path(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file. It is written beside its place and then renamed, so a reader sees the old or the new one."""
    beside = f"{path}.{uuid.uuid4().hex}"
    at, fs = _path(spark, beside)
    stream = fs.create(at, True)
    try:
        stream.write(text.encode())
    finally:
        stream.close()
    move(spark, beside, path)


def fingerprints(spark: SparkSession, paths: list[str]) -> list[str]:
    """Path, length and time of change of each file."""
    out = []
    for path in paths:
        at, fs = _path(spark, path)
        status = fs.getFileStatus(at)
        out.append(f"{path} {status.getLen()} {status.getModificationTime()}")
    return out
