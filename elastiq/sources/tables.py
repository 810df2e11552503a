"""Input tables by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from elastiq.schemas import SCHEMAS


def _found(fields: T.StructType, name: str) -> T.StructField | None:
    return next((f for f in fields.fields if f.name.lower() == name.lower()), None)


def _wanted_part(found: T.DataType, declared: T.DataType) -> T.DataType:
    """The declared fields of a stored type, in declared order, with the types they are stored in."""
    if isinstance(declared, T.StructType) and isinstance(found, T.StructType):
        parts = [(f, _found(found, f.name)) for f in declared.fields]
        return T.StructType([T.StructField(f.name, _wanted_part(g.dataType, f.dataType) if g else f.dataType) for f, g in parts])
    if isinstance(declared, T.ArrayType) and isinstance(found, T.ArrayType):
        return T.ArrayType(_wanted_part(found.elementType, declared.elementType))
    return found


def _by_name(value: Column, found: T.DataType, declared: T.DataType) -> Column:
    """``value`` as the declared type: nested fields by name, leaves cast, fields that are not there NULL."""
    if found.simpleString().lower() == declared.simpleString().lower():
        return value
    if isinstance(declared, T.StructType) and isinstance(found, T.StructType):
        parts = [(f, _found(found, f.name)) for f in declared.fields]
        rebuilt = F.struct(
            *[
                (_by_name(value.getField(g.name), g.dataType, f.dataType) if g else F.lit(None).cast(f.dataType)).alias(f.name)
                for f, g in parts
            ]
        )
        return F.when(value.isNotNull(), rebuilt)
    if isinstance(declared, T.ArrayType) and isinstance(found, T.ArrayType):
        return F.transform(value, lambda x: _by_name(x, found.elementType, declared.elementType))
    return value.cast(declared)


def as_declared(df: DataFrame, name: str) -> DataFrame:
    """The declared columns in the declared types. Nested fields are matched by name, never by position;
    further fields are left out, missing ones are NULL, and decimals and other widths are cast at this edge."""
    declared, have = T.StructType.fromDDL(SCHEMAS[name]), df.schema
    parts = [(f, _found(have, f.name)) for f in declared.fields]
    return df.select(
        *[
            (_by_name(F.col(f"`{g.name}`"), g.dataType, f.dataType) if g else F.lit(None).cast(f.dataType)).alias(f.name)
            for f, g in parts
        ]
    )


def read_input(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Table ``name`` below ``root`` (parquet; a date-partitioned layout is pruned by the date filters).

    ``root`` may also be a catalog schema, written as ``catalog:my_schema``. The parquet reader is given the
    declared fields only, so the scan reads no others and keeps pruning nested columns.
    """
    if root.startswith("catalog:"):
        return as_declared(spark.table(f"{root.removeprefix('catalog:')}.{name}"), name)
    path = f"{root.rstrip('/')}/{name}"
    stored = spark.read.parquet(path).schema
    return as_declared(spark.read.schema(_wanted_part(stored, T.StructType.fromDDL(SCHEMAS[name]))).parquet(path), name)

