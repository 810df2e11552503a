"""Fee tiers of price schemes and of vendor groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from elastiq.functions.skew import salted_join, with_totals
from elastiq.params import FEE_PLACES, KEYS

# Fixed value: stands for the open threshold of the last tier.
OPEN_THRESHOLD = 9999999.0
SCHEME = [*KEYS, "scheme_id"]


def _second(name: str):
    return F.date_trunc("SECOND", F.col(name))


def scheme_fee_tiers(configs: DataFrame, schemes: DataFrame) -> DataFrame:
    """Current fee tiers of the schemes in use, one row per tier and group that uses the scheme.

    History, travel-time config and details are sibling arrays: every open detail meets every open config.
    The rank counts the rows of all groups of a scheme, so it is taken once per scheme and scaled.
    """
    detail = F.col("ttd.travel_time_threshold")
    minutes = F.floor(detail)
    open_rows = (
        configs.join(schemes.select(*SCHEME).distinct(), SCHEME, "left_semi")
        .select(
            *SCHEME,
            "travel_time_config",
            "travel_time_detail",
            F.explode("price_scheme_history").alias("h"),
        )
        .filter("h.active_to IS NULL")
        .select(*SCHEME, "h", "travel_time_detail", F.explode("travel_time_config").alias("ttc"))
        .filter("ttc.active_to IS NULL")
        .select(*SCHEME, "h", "ttc", F.explode_outer("travel_time_detail").alias("ttd"))
        .filter("ttd.active_to IS NULL")
        .select(
            *SCHEME,
            F.col("h.scheme_name").alias("scheme_name"),
            _second("h.active_from").alias("scheme_active_from"),
            _second("h.active_to").alias("scheme_active_to"),
            F.col("h.travel_time_config_id").alias("travel_time_config_id"),
            F.col("ttc.config_name").alias("config_name"),
            _second("ttc.active_from").alias("tt_config_active_from"),
            _second("ttc.active_to").alias("tt_config_active_to"),
            F.coalesce(detail, F.lit(OPEN_THRESHOLD)).alias("tt_threshold"),
            F.when(detail.isNull(), F.lit(OPEN_THRESHOLD))
            .otherwise(F.round(minutes + (detail - minutes) * 60 / 100, 2))
            .alias("threshold_in_min_and_sec"),
            F.round("ttd.travel_time_fee", FEE_PLACES).alias("fee"),
            _second("ttd.active_from").alias("tt_detail_active_from"),
            _second("ttd.active_to").alias("tt_detail_active_to"),
        )
    )
    newest = [
        F.max("scheme_active_from").alias("_scheme_from"),
        F.max("tt_config_active_from").alias("_config_from"),
    ]
    tiers = (
        with_totals(open_rows, SCHEME, newest, null_safe=False)
        .filter(
            (F.col("scheme_active_from") == F.col("_scheme_from"))
            & (F.col("tt_config_active_from") == F.col("_config_from"))
        )
        .drop("_scheme_from", "_config_from")
        .distinct()
    )
    by_threshold = Window.partitionBy(*SCHEME, "travel_time_config_id").orderBy("tt_threshold")
    ranked = tiers.withColumn("_rank", F.rank().over(by_threshold))
    users = schemes.select(
        "region", *SCHEME, "asa_id", "master_asa_id", "asa_name", "asa_common_name"
    )
    counted = with_totals(users, SCHEME, [F.count(F.lit(1)).alias("_users")], null_safe=False)
    joined = salted_join(counted, ranked, SCHEME, "inner", ["asa_id"])
    return joined.withColumn("tier", (F.col("_rank") - 1) * F.col("_users") + 1).select(
        "region",
        *KEYS,
        "asa_id",
        "master_asa_id",
        "asa_name",
        "asa_common_name",
        "scheme_id",
        *[c for c in tiers.columns if c not in SCHEME],
        "tier",
    )


def group_fee_tiers(tiers: DataFrame) -> DataFrame:
    """Distinct fees of every group."""
    return tiers.select(
        "region", *KEYS, "asa_id", "master_asa_id", "asa_name", "asa_common_name", "fee"
    ).distinct()
