"""Conversion by fee tier, for vendors and for their groups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from elastiq.functions.numbers import nonzero
from elastiq.functions.skew import lookup_join
from elastiq.operators.screening import MARK, VENDOR, distinct_marks, mark_counts, session_marks
from elastiq.params import KEYS, Params

# Slopes are compared with each other; this many decimals hide the order in which rows were added up.
SLOPE_PLACES = 12


@dataclass(frozen=True)
class Level:
    """Column names of one level of the analysis."""

    own: tuple[str, ...]
    cvr: str
    min_fee: str
    base_cvr: str
    change: str
    rank: str
    tiers: str
    slope: str

    def ids(self, p: Params) -> list[str]:
        return [*KEYS, p.group_key, *self.own]

    def grain(self, p: Params) -> list[str]:
        return ["region", *KEYS, p.group_key, p.group_name, "vendor_count_caught_by_asa", *self.own]


VENDOR_LEVEL = Level(
    own=("vendor_code",),
    cvr="cvr3",
    min_fee="min_df_total_of_vendor",
    base_cvr="vendor_cvr3_at_min_df",
    change="pct_chng_of_actual_cvr3_from_base",
    rank="tier_rank_vendor",
    tiers="num_tiers_vendor",
    slope="vendor_cvr3_slope",
)
GROUP_LEVEL = Level(
    own=(),
    cvr="asa_cvr3_per_df",
    min_fee="min_df_total_of_asa",
    base_cvr="asa_cvr3_at_min_df",
    change="pct_chng_of_asa_cvr3_from_base",
    rank="tier_rank_master_asa",
    tiers="num_tiers_master_asa",
    slope="asa_cvr3_slope",
)


def curve_marks(sessions: DataFrame, screened: DataFrame, p: Params) -> DataFrame:
    """Session marks per vendor and fee seen, of the screened vendors only. Both curves are built on it."""
    priced = sessions.filter(F.col("df_total").isNotNull()).select(
        *VENDOR, "df_total", "events_ga_session_id", "event_action", "event_time"
    )
    kept = lookup_join(priced, screened.select(*VENDOR), VENDOR, "left_semi")
    return session_marks(kept, [*VENDOR, "df_total"], tx_unit=p.tx_unit)


def _current_fees(tiers: DataFrame, p: Params) -> DataFrame:
    return tiers.select(*KEYS, p.group_key, F.col("fee").alias("df_total"))


def vendor_curve(screened: DataFrame, marks: DataFrame, tiers: DataFrame, p: Params) -> DataFrame:
    """Metrics per vendor and fee, for fees that are current tiers of the vendor's group."""
    grain = VENDOR_LEVEL.grain(p)
    counts = mark_counts(marks, [*VENDOR, "df_total"], "cvr3", tx_unit=p.tx_unit)
    rows = counts.join(screened.select(*grain).distinct(), VENDOR)
    on = [*KEYS, p.group_key, "df_total"]
    rows = lookup_join(rows, _current_fees(tiers, p), on, "left_semi")
    return rows.select(*grain, "df_total", *[c for c in counts.columns if c not in (*VENDOR, "df_total")])


def group_curve(screened: DataFrame, marks: DataFrame, tiers: DataFrame, p: Params) -> DataFrame:
    """The same pooled over the screened vendors of a group.

    A session that saw several vendors counts once, so marks are reduced again per group; the key keeps
    the session, which spreads a hot group. Groups have no impressions, so a time is reduced only if it counts as
    a transaction; other times just keep the row of their fee.
    """
    grain = [*GROUP_LEVEL.grain(p), "df_total"]
    members = screened.select(*VENDOR_LEVEL.grain(p)).distinct()
    on = [*KEYS, p.group_key, "df_total"]
    pooled = lookup_join(marks, members, VENDOR, "inner")
    pooled = lookup_join(pooled, _current_fees(tiers, p), on, "left_semi")
    counts = ~F.col("of_time") | (F.col("tx") if p.tx_unit == "event_time" else F.lit(False))
    columns = [*grain, *MARK, "visit", "tx"]
    marks = distinct_marks(pooled.filter(counts), grain).unionByName(pooled.filter(~counts).select(*columns))
    return mark_counts(marks, grain, GROUP_LEVEL.cvr, tx_unit=p.tx_unit).drop("num_total_vendor_impressions")


def curve_base(curve: DataFrame, level: Level, p: Params) -> DataFrame:
    """The lowest fee and the conversion there.

    The lowest fee is per row of the full grain but joined on the ids alone, so an id with several names
    or vendor counts gets several base rows.
    """
    grain = level.grain(p)
    lowest = curve.groupBy(*grain).agg(F.min("df_total").alias(level.min_fee))
    lowest = lowest.select(*level.ids(p), level.min_fee, F.col(level.min_fee).alias("df_total"))
    joined = curve.join(lowest, [*level.ids(p), "df_total"])
    return joined.select(*grain, level.min_fee, F.col(level.cvr).alias(level.base_cvr))


def curve_change(curve: DataFrame, base: DataFrame, level: Level, p: Params) -> DataFrame:
    """Change of conversion from the base, and with it the rank of each tier and the number of tiers.

    The change is NULL at any tier whose conversion equals the base.
    """
    ids = level.ids(p)
    joined = curve.join(base.select(*ids, level.min_fee, level.base_cvr), ids, "left")
    cvr, base_cvr = F.col(level.cvr), F.col(level.base_cvr)
    change = F.when(cvr == base_cvr, F.lit(None).cast("double")).otherwise(
        F.round(cvr / nonzero(base_cvr) - 1, 4)
    )
    out = joined.select(*curve.columns, level.min_fee, level.base_cvr, change.alias(level.change))
    if not p.tier_ranks:
        return out
    ties = [p.group_name, "vendor_count_caught_by_asa", level.cvr, level.min_fee, level.base_cvr]
    tiers = Window.partitionBy(*ids)
    return out.withColumn(level.rank, F.row_number().over(tiers.orderBy("df_total", *ties))).withColumn(
        level.tiers, F.max(level.rank).over(tiers)
    )


def with_slope(curve: DataFrame, level: Level, p: Params) -> DataFrame:
    """Add the least-squares slope of conversion on fee, over all rows of an id with more than one tier.

    Rows that all share one fee have slope 0. An id has as many rows as its price list, so the window
    needs no more than the one that ranked the tiers.
    """
    own = Window.partitionBy(*level.ids(p))
    slope = F.coalesce(F.regr_slope(level.cvr, "df_total").over(own), F.lit(0.0))
    several = F.count(F.lit(1)).over(own) > 1
    return curve.withColumn(level.slope, F.when(several, F.round(slope, SLOPE_PLACES)))
