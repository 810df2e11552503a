"""Checks to run next to the steps."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from elastiq.params import KEYS


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with more than one row: a join on them multiplies rows, and sums with them."""
    return df.groupBy(*keys).count().filter("count > 1")


def linked_chains(setups: DataFrame, *, suffix: str = "_LB") -> DataFrame:
    """Every linked group with the chain of names it belongs to: ``A``, ``A_LB``, ``A_LB_LB``.

    A chain is a component of the links between a name and the same name with the suffix, cases folded. All its names share what is
    left without trailing suffixes and carry consecutive numbers of them, so components are runs of numbers and need no rounds. The
    window holds the names of one stem, which are at most as many as suffixes fit into a name.

    ``chain_name`` is the shortest name, ``chain_place`` counts names from 1, ``chain_names`` and ``chain_groups`` are the size of the
    chain, ``n_links`` the groups this one is linked with. Each link repeats the rows of its group, so more than one multiply sums
    (``repeats_rows``). Groups without a link, a name, an entity or a country have no row; a group with two names has one for each.
    """
    if not suffix:
        raise ValueError("an empty suffix links every group with itself")
    groups = setups.select(*KEYS, "asa_id", "asa_name").dropna(subset=[*KEYS, "asa_name"]).distinct()
    low = F.lower("asa_name")
    stem = F.regexp_extract(low, f"(?s)^(.*?)((?:{re.escape(suffix.lower())})*)$", 1)
    groups = groups.withColumn("_name", low).withColumn("_stem", stem)
    groups = groups.withColumn("_depth", ((F.length("_name") - F.length("_stem")) / len(suffix)).cast("int"))

    by_depth = Window.partitionBy(*KEYS, "_stem").orderBy("_depth")
    names = groups.groupBy(*KEYS, "_stem", "_depth", "_name").agg(F.count(F.lit(1)).alias("_groups"))

    def beside(step: int):
        """Groups under the name one suffix shorter or longer."""
        near = F.lag(F.struct("_depth", "_groups"), step).over(by_depth)
        return F.when(near["_depth"] == F.col("_depth") - step, near["_groups"]).otherwise(F.lit(0))

    names = names.withColumn("n_links", beside(1) + beside(-1)).withColumn("_run", F.col("_depth") - F.row_number().over(by_depth))
    chain = Window.partitionBy(*KEYS, "_stem", "_run")
    names = names.filter("n_links > 0").select(
        *KEYS,
        "_name",
        F.min(F.struct("_depth", "_name")).over(chain)["_name"].alias("chain_name"),
        (F.col("_depth") - F.min("_depth").over(chain) + 1).alias("chain_place"),
        F.count(F.lit(1)).over(chain).alias("chain_names"),
        F.sum("_groups").over(chain).alias("chain_groups"),
        "n_links",
        (F.col("n_links") > 1).alias("repeats_rows"),
    )
    return groups.drop("_stem", "_depth").join(names, [*KEYS, "_name"]).drop("_name")
