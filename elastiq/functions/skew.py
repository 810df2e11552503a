"""Joins that stay balanced when one key holds a large share of the rows.

Salts are hashes of row values, never random numbers: a task that is run again after an executor
was lost must send every row to the same place as before.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST_SALTS = 8
LEAST_DEALT = 200
# Lets adaptive execution split a hot key of a join of large tables, even at the price of a shuffle.
SPLIT_HOT_KEYS = "spark.sql.adaptive.forceOptimizeSkewedJoin"


def split_hot_keys(spark: SparkSession) -> None:
    """Every run, query and check relies on this setting; a value set by the user stays."""
    if spark.conf.get(SPLIT_HOT_KEYS, None) in (None, "false"):
        spark.conf.set(SPLIT_HOT_KEYS, "true")


def salts_of(df: DataFrame) -> int:
    """As many parts as a shuffle has, so that a hot key spreads over the cluster whatever its size."""
    return max(LEAST_SALTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def dealt(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of equal ``on`` in one partition, ahead of an aggregation by keys that hardly repeat.

    Without it Spark aggregates before the shuffle as well, which for such keys means a hash table with every row of a task that is sorted
    and spilled when memory ends, and as many rows to shuffle as before. ``on`` is as fine as the keys, so that no hot key of a part of them
    gathers; rows that do repeat are reduced as they are read. There are many partitions even if few are set, since the hash tables after the
    shuffle must fit too; the number is not coalesced.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(LEAST_DEALT, parts), *on)


def salt(cols: Sequence[str], salts: int) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int")


# Heavy hitters that are looked for, and counters of the sketch that finds them; a key with a larger share is never missed.
MOST_HOT = 1000
_TRACKED = 8 * MOST_HOT


def hot_keys(facts: DataFrame, on: Sequence[str], parts: int) -> DataFrame:
    """Hashes ``_hot`` of the keys that hold more rows than a task should get, one ``parts``-th of all.

    One pass with a sketch of fixed size (``approx_top_k``), combined before its one-row shuffle; no job runs on the driver. The
    result has at most ``min(parts, MOST_HOT)`` rows, so it may be broadcast.
    """
    k = min(parts, MOST_HOT)
    counted = facts.select(F.xxhash64(*on).alias("_key")).agg(
        F.call_function("approx_top_k", F.col("_key"), F.lit(k), F.lit(max(_TRACKED, 8 * k))).alias("_top"), F.count(F.lit(1)).alias("_rows")
    )
    top = counted.select("_rows", F.explode("_top").alias("_t"))
    return top.filter(F.col("_t.count") * parts > F.col("_rows")).select(F.col("_t.item").alias("_hot"))


def _salted(facts: DataFrame, right: DataFrame, on: Sequence[str], hot: DataFrame, spread_by: Sequence[str], salts: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a salt: hot keys are cut into ``salts`` parts on the one and repeated as often on the other, other keys have salt 0."""
    hot = F.broadcast(hot)
    left = facts.join(hot, F.xxhash64(*on) == F.col("_hot"), "left")
    left = left.withColumn("_salt", F.when(F.col("_hot").isNotNull(), salt(spread_by, salts)).otherwise(F.lit(0))).drop("_hot")
    right = right.join(hot, F.xxhash64(*[f"_on_{c}" for c in on]) == F.col("_hot"), "left")
    every = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return left, right.withColumn("_salt_of_dim", F.explode(every)).drop("_hot")


def salted_join(
    facts: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    how: str,
    spread_by: Sequence[str],
    *,
    salts: int | None = None,
    null_safe: bool = False,
    condition: Column | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join ``dim`` to ``facts``, the hot keys of ``facts`` cut into ``salts`` parts by ``spread_by``.

    Only the rows of hot keys of ``dim`` are repeated, so its size hardly depends on the number of partitions. ``hot`` are measured unless
    given; ``how`` may be ``inner``, ``left`` or ``left_semi``. Adaptive execution may still split a part further, or broadcast
    ``dim`` once its real size is known.
    """
    salts = salts or salts_of(facts)
    hot = hot_keys(facts, on, salts) if hot is None else hot
    left, right = _salted(facts, _renamed(dim, on), on, hot, spread_by, salts)
    same = [
        F.col(c).eqNullSafe(F.col(f"_on_{c}")) if null_safe else F.col(c) == F.col(f"_on_{c}") for c in on
    ]
    test = reduce(and_, same, F.col("_salt") == F.col("_salt_of_dim"))
    if condition is not None:
        test = test & condition
    return left.join(right, test, how).drop("_salt", "_salt_of_dim", *[f"_on_{c}" for c in on])


def lookup_join(facts: DataFrame, dim: DataFrame, on: Sequence[str], how: str, condition: Column | None = None) -> DataFrame:
    """Join a table that is usually small, such as ids in use.

    There is no hint: ``dim`` is a staged table, so Spark knows its bytes and broadcasts it if they are few. Otherwise
    both sides are shuffled and adaptive execution splits the hot keys of ``facts`` (``split_hot_keys``).
    """
    if condition is None:
        return facts.join(dim, list(on), how)
    test = reduce(and_, [F.col(c) == F.col(f"_on_{c}") for c in on], condition)
    return facts.join(_renamed(dim, on), test, how).drop(*[f"_on_{c}" for c in on])


def _renamed(dim: DataFrame, on: Sequence[str]) -> DataFrame:
    return dim.select(*[F.col(c).alias(f"_on_{c}") if c in on else F.col(c) for c in dim.columns])


def with_totals(
    df: DataFrame,
    by: Sequence[str],
    aggregates: Sequence[Column],
    *,
    null_safe: bool = True,
) -> DataFrame:
    """Add group aggregates to every row.

    Same result as unordered window aggregates, but the groups are pre-aggregated before the shuffle, and a hot group is never
    gathered in one task: it is joined back by adaptive execution, which splits a group that is too large
    for a task (``split_hot_keys``), or broadcasts the totals if they are few.
    """
    totals = _renamed(df.groupBy(*by).agg(*aggregates), by)
    same = [F.col(c).eqNullSafe(F.col(f"_on_{c}")) if null_safe else F.col(c) == F.col(f"_on_{c}") for c in by]
    return df.join(totals, reduce(and_, same), "left").drop(*[f"_on_{c}" for c in by])


def null_lane(keys: Sequence[str], spread_by: Sequence[str], lanes: int = 256) -> Column:
    """Extra join column that spreads rows whose key is NULL (they match nothing) over many tasks."""
    missing = reduce(or_, [F.col(k).isNull() for k in keys])
    return F.when(missing, F.lit(1) + salt(spread_by, lanes)).otherwise(F.lit(0))
