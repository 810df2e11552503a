"""Orders per vendor and per group, and the fee the customer really paid."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from elastiq.functions.numbers import nonzero
from elastiq.functions.skew import lookup_join, null_lane
from elastiq.params import AUTOMATIC_SCHEME, COMPLETED, EXTERNAL_FEE_REGIONS, KEYS


def paid_fee(
    region: Column,
    external: Column,
    by_discount: Column,
    by_voucher: Column,
    fee: Column,
    *,
    unknown_is_covered: bool,
) -> Column:
    """Delivery fee paid by the customer.

    Regions with an external feed take its fee; elsewhere, and where the feed has none, a fee covered by
    a discount or voucher counts as 0. Outside those regions a NULL flag means covered in the group
    impact (``unknown_is_covered``) and not covered in the economics.
    """
    covered = by_discount | by_voucher
    own = F.when(covered, F.lit(0.0)).otherwise(fee)
    other = F.when(~by_voucher & ~by_discount, fee).otherwise(F.lit(0.0)) if unknown_is_covered else own
    listed = region.isin(*EXTERNAL_FEE_REGIONS)
    return F.when(listed, F.coalesce(external, own)).when(~listed, other)


def with_external_fee(orders: DataFrame, external: DataFrame) -> DataFrame:
    """Add ``external_fee``, joined on entity, order code and date."""
    feed = external.select(
        F.col("global_entity_id").alias("entity_id"),
        F.col("code").alias("platform_order_code"),
        F.col("created_date_utc").alias("created_date"),
        F.col("delivery_fee_local").alias("external_fee"),
        F.lit(0).alias("_lane"),
    )
    lane = null_lane(["platform_order_code"], ["vendor_id", "created_date", "gmv_local"])
    on = ["entity_id", "platform_order_code", "created_date", "_lane"]
    return orders.withColumn("_lane", lane).join(feed, on, "left").drop("_lane")


def vendor_orders(orders: DataFrame, vendors: DataFrame, window: tuple[date, date]) -> DataFrame:
    """Completed orders per known vendor in the window."""
    first, last = window
    done = orders.filter(
        F.col("created_date").between(F.lit(first), F.lit(last)) & (F.col("delivery_status") == COMPLETED)
    ).select(*KEYS, F.col("vendor_id").alias("vendor_code"), "platform_order_code")
    on = [*KEYS, "vendor_code"]
    return (
        lookup_join(done, vendors.select(*on), on, "left_semi")
        .groupBy("entity_id", F.lower("country_code").alias("country_code"), "vendor_code")
        .agg(F.countDistinct("platform_order_code").alias("num_orders"))
    )


def group_order_impact(
    orders: DataFrame,
    external: DataFrame,
    active: DataFrame,
    vendors: DataFrame,
    window: tuple[date, date],
) -> DataFrame:
    """Orders and delivery fee revenue per group, from orders priced by an automatic scheme."""
    first, last = window
    done = (
        orders.filter(
            F.col("created_date").between(F.lit(first), F.lit(last))
            & (F.col("vendor_price_scheme_type") == AUTOMATIC_SCHEME)
            & (F.col("delivery_status") == COMPLETED)
        )
        .select(
            *KEYS,
            "assignment_id",
            "platform_order_code",
            "created_date",
            "vendor_id",
            "gmv_local",
            "exchange_rate",
            "delivery_fee_local",
            "is_delivery_fee_covered_by_discount",
            "is_delivery_fee_covered_by_voucher",
        )
    )
    # An assignment id is compared as text: only ids of known groups become numbers, whatever else is stored.
    on = [*KEYS, "asa_id"]
    known = vendors.select(*KEYS, F.col("asa_id").cast("string").alias("assignment_id")).distinct()
    done = lookup_join(done, known, [*KEYS, "assignment_id"], "left_semi")
    done = done.withColumn("asa_id", F.col("assignment_id").try_cast("bigint")).drop("assignment_id")
    done = lookup_join(done, active.select("region", *KEYS), KEYS, "inner")
    fee = paid_fee(
        F.col("region"),
        F.col("external_fee"),
        F.col("is_delivery_fee_covered_by_discount"),
        F.col("is_delivery_fee_covered_by_voucher"),
        F.col("delivery_fee_local"),
        unknown_is_covered=True,
    )
    n = F.col("num_orders_asa")
    return (
        with_external_fee(done, external)
        .select(*on, "platform_order_code", fee.alias("fee"), nonzero(F.col("exchange_rate")).alias("rate"))
        .groupBy(*on)
        .agg(
            F.countDistinct("platform_order_code").alias("num_orders_asa"),
            F.sum("fee").alias("_local"),
            F.sum(F.col("fee") / F.col("rate")).alias("_eur"),
        )
        .select(
            *on,
            "num_orders_asa",
            F.round("_local", 2).alias("total_df_revenue_local"),
            F.round("_eur", 2).alias("total_df_revenue_eur"),
            F.round(F.col("_local") / nonzero(n), 2).alias("avg_df_asa_local"),
            F.round(F.col("_eur") / nonzero(n), 2).alias("avg_df_asa_eur"),
        )
    )
