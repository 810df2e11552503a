"""Connected components of links, as joins and aggregates that gather no node's neighbours in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from elastiq.sources.staging import stage


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "m").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node with a link (a, b) to another, by large-star and small-star rounds.

    Each round is written to the shared folder. The least neighbour of a node is an aggregate, combined before the shuffle
    and joined back, so the centre of a star with millions of rays is no hot group. Nulls and loops link nothing.
    """
    pairs = links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("m")).distinct()
    edges = stage(pairs, "graph-edges")
    before, now = (0, None), _state(edges)
    while now != before:
        # Large star: the larger neighbours of a node point to the least of the node and its neighbours.
        both = edges.unionByName(edges.select(F.col("m").alias("u"), F.col("u").alias("m")))
        least = both.groupBy("u").agg(F.min("m").alias("low")).select(F.col("u").alias("centre"), F.least("low", "u").alias("low"))
        large = both.filter("m > u").join(least, F.col("u") == F.col("centre")).select(F.col("m").alias("u"), F.col("low").alias("m"))
        large = stage(large.distinct(), "graph-large")
        # Small star: a node and its smaller neighbours point to the least of them.
        least = large.groupBy("u").agg(F.min("m").alias("low")).select(F.col("u").alias("centre"), "low")
        ends = F.array_distinct(F.array(F.col("u"), F.when(F.col("m") == F.col("low"), F.col("u")).otherwise(F.col("m"))))
        small = large.join(least, F.col("u") == F.col("centre")).select(F.explode(ends).alias("u"), F.col("low").alias("m"))
        edges = stage(small.distinct(), "graph-edges")
        before, now = now, _state(edges)
    stars = edges.select(F.col("u").alias("node"), F.col("m").alias("component"))
    return stars.unionByName(edges.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct())
