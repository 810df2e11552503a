"""Percentile ranks within groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from elastiq.sources.staging import stage


def value_ranks(df: DataFrame, by: Sequence[str], metrics: Sequence[str], *, parts: int | None = None) -> DataFrame:
    """``by``, metric, value, below, rows: how many rows of the group have a lower value, and how many rows it has.

    Rows are counted per group, metric and value first, so a value that most rows share is one row here and no tie crosses
    a border. One range partitioning then puts all values in order, a large group over as many partitions as it needs. A value has
    below it the counts before it in its partition, and the totals of the group in earlier partitions: one row per partition.
    The order is written down with its partitions before it is read twice, since a sample decides them.
    """
    by = list(by)
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    counts = df.select(*by, pairs.alias("p")).groupBy(*by, "p.metric", "p.value").agg(F.count(F.lit(1)).alias("n"))
    order = [*by, "metric"]
    ranged = counts.repartitionByRange(parts, *order, "value").withColumn("part", F.spark_partition_id())
    ranged = stage(ranged, "value_counts")

    before = Window.partitionBy(*order).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*order, "part").agg(F.sum("n").alias("in_part"))
    totals = totals.select(
        *[F.col(c).alias(f"_{c}") for c in (*order, "part")],
        F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("earlier"),
        F.sum("in_part").over(Window.partitionBy(*order)).alias("rows"),
    )
    inside = Window.partitionBy(*order, "part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    same = F.lit(True)
    for c in (*order, "part"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return placed.join(totals, same).select(*order, "value", (F.col("earlier") + F.col("inside")).alias("below"), "rows")


def percent_ranks(df: DataFrame, by: Sequence[str], metrics: Mapping[str, str], *, places: int = 4, parts: int | None = None) -> DataFrame:
    """Add ``round(percent_rank(), places)`` of each metric within ``by``; ``metrics`` maps output to input.

    ``df`` is read more than once, so pass a staged table. The ranks are joined back by group and value: one row per distinct value,
    never repeated; adaptive execution splits a value that a large share of the rows has.
    """
    by = list(by)
    ranked = value_ranks(df, by, list(metrics.values()), parts=parts)
    rank = F.when(F.col("rows") > 1, F.round(F.col("below") / (F.col("rows") - 1), places)).otherwise(F.lit(0.0))
    ranks = stage(ranked.select(*by, "metric", "value", rank.alias("rank")), "value_ranks")
    for out, value in metrics.items():
        own = ranks.filter(F.col("metric") == value).select(
            *[F.col(c).alias(f"_{c}") for c in by], F.col("value").alias("_value"), F.col("rank").alias(out)
        )
        same = F.col(value).cast("double").eqNullSafe(F.col("_value"))
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        df = df.join(own, same, "left").drop("_value", *[f"_{c}" for c in by])
    return df
