"""Orders, revenue and gross profit by fee tier, and the elasticity from one tier to the next."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from elastiq.functions.numbers import nonzero, ratio
from elastiq.functions.skew import lookup_join, null_lane, salted_join
from elastiq.operators.orders import paid_fee, with_external_fee
from elastiq.params import COMPLETED, KEYS

MASTER = [*KEYS, "master_asa_id"]
TIER_COLUMNS = ["region", *MASTER, "asa_common_name"]
MEMBER_COLUMNS = ["is_asa_clustered", "vendor_count_caught_by_asa", "vendor_code"]
GRID = [*TIER_COLUMNS, *MEMBER_COLUMNS, "fee", "min_tt_fee_master_asa_level"]


def fee_key(c: Column) -> Column:
    """Fees are joined as decimals, not as floating point numbers."""
    return c.cast("decimal(18,4)")


def _grid(tiers: DataFrame, vendors: DataFrame) -> DataFrame:
    """Distinct rows of the vendor and fee grid, with the number of ``copies`` of each.

    Groups pooled under one id list the same fee once each, and those copies must count in sums.
    """
    lowest = tiers.groupBy(*MASTER).agg(F.min("fee").alias("min_tt_fee_master_asa_level"))
    fees = tiers.groupBy(*TIER_COLUMNS, "fee").agg(F.count(F.lit(1)).alias("_fee_copies"))
    fees = fees.join(lowest, MASTER)
    members = vendors.groupBy(*MASTER, *MEMBER_COLUMNS).agg(F.count(F.lit(1)).alias("_member_copies"))
    matched = salted_join(members, fees, MASTER, "inner", ["vendor_code"])
    types = dict(members.dtypes)
    without = fees.join(vendors.select(*MASTER).distinct(), MASTER, "left_anti").select(
        "*",
        *[F.lit(None).cast(types[c]).alias(c) for c in MEMBER_COLUMNS],
        F.lit(1).cast("bigint").alias("_member_copies"),
    )
    copies = (F.col("_fee_copies") * F.col("_member_copies")).alias("copies")
    return matched.unionByName(without).select(*GRID, copies)


def vendor_fee_grid(tiers: DataFrame, vendors: DataFrame) -> DataFrame:
    """Every vendor of a group with every fee of the group, and the lowest fee of the group."""
    repeats = F.sequence(F.lit(1).cast("bigint"), F.col("copies"))
    return _grid(tiers, vendors).select(*GRID, F.explode(repeats).alias("_copy")).drop("_copy")


def small_order_fee(order_value: Column, minimum: Column, recorded: Column) -> Column:
    """0 if the order reaches the minimum, else the recorded fee, else the shortfall."""
    return F.when(order_value - minimum >= 0, F.lit(0.0)).otherwise(F.coalesce(recorded, minimum - order_value))


def order_economics(
    orders: DataFrame,
    values: DataFrame,
    external: DataFrame,
    entities: DataFrame,
    window: tuple[date, date],
) -> DataFrame:
    """Fee, revenue and cost components of the completed and sent orders of the window."""
    first, last = window
    done = orders.filter(
        F.col("created_date").between(F.lit(first), F.lit(last))
        & (F.col("delivery_status") == COMPLETED)
        & F.col("is_sent")
    )
    done = lookup_join(done, entities.select("region", "entity_id"), ["entity_id"], "inner")
    recorded = values.select(
        F.col("global_entity_id").alias("entity_id"),
        F.col("order_id").alias("platform_order_code"),
        F.col("value.mov_customer_fee_local").alias("sof_local_cdwh"),
        F.lit(0).alias("_lane"),
    )
    lane = null_lane(["platform_order_code"], ["vendor_id", "created_date", "gmv_local"])
    on = ["entity_id", "platform_order_code", "_lane"]
    joined = done.withColumn("_lane", lane).join(recorded, on, "left").drop("_lane")
    joined = with_external_fee(joined, external)
    return joined.select(
        F.col("created_date").alias("created_date_utc"),
        *KEYS,
        "platform_order_code",
        "vendor_id",
        "exchange_rate",
        "dps_travel_time_fee_local",
        "commission_local",
        "joker_vendor_fee_local",
        F.coalesce("service_fee_local", F.lit(0.0)).alias("service_fee_local"),
        "sof_local_cdwh",
        small_order_fee(
            F.col("gfv_local"), F.col("dps_minimum_order_value_local"), F.col("sof_local_cdwh")
        ).alias("sof_local"),
        "delivery_costs_local",
        paid_fee(
            F.col("region"),
            F.col("external_fee"),
            F.col("is_delivery_fee_covered_by_discount"),
            F.col("is_delivery_fee_covered_by_voucher"),
            F.col("delivery_fee_local"),
            unknown_is_covered=False,
        ).alias("actual_df_paid_by_customer"),
        "gmv_local",
    )


# output names and the amounts they add up
AMOUNTS = {"df_revenue": "_fee", "vendor_gmv": "_gmv", "tot_revenue": "_revenue", "gp": "_profit"}


def vendor_fee_performance(
    tiers: DataFrame, vendors: DataFrame, economics: DataFrame, final_list: DataFrame
) -> DataFrame:
    """Orders, fee revenue, order value, revenue and profit per vendor, fee and label.

    The label is joined per vendor, not per group, and the grid repeats pooled groups; both multiply the
    order rows. Orders are added up once per vendor and fee and then multiplied by the number of copies,
    instead of joining every order to every copy.
    """
    fee = F.col("actual_df_paid_by_customer")
    revenue = (
        fee
        + F.col("commission_local")
        + F.col("joker_vendor_fee_local")
        + F.col("service_fee_local")
        + F.coalesce("sof_local_cdwh", "sof_local")
    )
    rate = nonzero(F.col("exchange_rate"))
    sums = [
        s
        for name, c in AMOUNTS.items()
        for s in (F.sum(c).alias(f"{name}_local"), F.sum(F.col(c) / F.col("_rate")).alias(f"{name}_eur"))
    ]
    vendor = [*KEYS, "vendor_code"]
    per_fee = (
        economics.select(
            *KEYS,
            F.col("vendor_id").alias("vendor_code"),
            fee_key(F.col("dps_travel_time_fee_local")).alias("_fee_key"),
            "platform_order_code",
            rate.alias("_rate"),
            fee.alias("_fee"),
            F.col("gmv_local").alias("_gmv"),
            revenue.alias("_revenue"),
            (revenue - F.col("delivery_costs_local")).alias("_profit"),
        )
        .groupBy(*vendor, "_fee_key")
        .agg(F.countDistinct("platform_order_code").alias("vendor_order_count"), *sums)
    )
    labels = final_list.groupBy(*vendor, "is_lb_lm").agg(F.count(F.lit(1)).alias("_label_copies"))
    joined = (
        _grid(tiers, vendors)
        .withColumn("_fee_key", fee_key(F.col("fee")))
        .join(per_fee, [*vendor, "_fee_key"], "left")
        .join(labels, vendor, "left")
    )
    copies = F.col("copies") * F.coalesce("_label_copies", F.lit(1))
    totals = [f"{name}_{money}" for name in AMOUNTS for money in ("local", "eur")]
    return joined.select(
        *GRID,
        "is_lb_lm",
        F.coalesce("vendor_order_count", F.lit(0)).alias("vendor_order_count"),
        *[F.coalesce(F.col(t) * copies, F.lit(0.0)).alias(t) for t in totals],
    )


CLUSTER = [*TIER_COLUMNS, "is_asa_clustered", "vendor_count_caught_by_asa", "fee", "is_lb_lm"]
_LEVEL = "vendor_cluster_tt_fee_level"
ORDERS = f"order_count_{_LEVEL}"


def cluster_fee_rollup(performance: DataFrame) -> DataFrame:
    """Sums per group, fee and label."""
    totals = [f"{name}_{money}" for name in AMOUNTS for money in ("local", "eur")]
    return performance.groupBy(*CLUSTER).agg(
        F.avg("min_tt_fee_master_asa_level").alias("min_tt_fee_master_asa_level"),
        F.sum("vendor_order_count").alias(ORDERS),
        *[F.round(F.sum(t), 2).alias(f"{t}_{_LEVEL}") for t in totals],
    )


# ties in the fee are decided by the rest of the roll-up key
_TIES = ["vendor_count_caught_by_asa", "asa_common_name", "is_asa_clustered", "region"]


def cluster_totals(rollup: DataFrame) -> DataFrame:
    """Totals per label, group and entity, order shares, and the previous fee with its orders.

    Totals are per entity, whatever the country. They roll up from the label level, so the large groups
    are built from small ones.
    """
    group = ["entity_id", "master_asa_id"]
    label = [*group, "is_lb_lm"]
    money = {
        f"{name}_{m}_{_LEVEL}": f"{name.removeprefix('vendor_')}_{m}_vendor_cluster_level"
        for name in AMOUNTS
        for m in ("local", "eur")
    }
    by_label = rollup.groupBy(*label).agg(
        F.sum(ORDERS).alias("order_count_vendor_cluster_level"),
        *[F.sum(c).alias(out) for c, out in money.items()],
    )
    by_group = by_label.groupBy(*group).agg(
        F.sum("order_count_vendor_cluster_level").alias("order_count_master_asa_level")
    )
    by_entity = by_group.groupBy("entity_id").agg(
        F.sum("order_count_master_asa_level").alias("order_count_entity_level")
    )
    totals = by_label.join(by_group, group).join(by_entity, "entity_id")
    joined = salted_join(rollup, totals, label, "left", ["fee", *_TIES[:2]], null_safe=True)
    entity = F.col("order_count_entity_level")
    # one row per fee tier of a group and label: as short as a price list
    tiers = Window.partitionBy(*label).orderBy("fee", *_TIES, "country_code")
    return joined.select(
        *rollup.columns,
        "order_count_vendor_cluster_level",
        "order_count_master_asa_level",
        "order_count_entity_level",
        ratio(F.col("order_count_vendor_cluster_level"), entity, 4).alias("vendor_cluster_order_share_of_entity"),
        ratio(F.col("order_count_master_asa_level"), entity, 4).alias("master_asa_order_share_of_entity"),
        *money.values(),
        F.lag("fee").over(tiers).alias(f"previous_fee_{_LEVEL}"),
        F.lag(ORDERS).over(tiers).alias(f"previous_{ORDERS}"),
    )


def tier_ranks(totals: DataFrame) -> DataFrame:
    """Rank of each fee tier and number of tiers, per group and label."""
    label = Window.partitionBy(*MASTER, "is_lb_lm")
    return totals.withColumn(
        "tier_rank_master_asa", F.row_number().over(label.orderBy("fee", *_TIES))
    ).withColumn("num_tiers_master_asa", F.max("tier_rank_master_asa").over(label))


def tier_elasticity(ranked: DataFrame) -> DataFrame:
    """Percentage change of orders over percentage change of fee, against the tier below.

    NULL for a base fee or base orders of 0, a single tier, the first tier, and an unchanged fee.
    """
    fee, before = F.col("fee"), F.col(f"previous_fee_{_LEVEL}")
    orders, orders_before = F.col(ORDERS), F.col(f"previous_{ORDERS}")
    no_step = (before == 0) | (F.col("num_tiers_master_asa") == 1) | (F.col("tier_rank_master_asa") == 1)
    step = fee / nonzero(before) - 1
    none = F.lit(None).cast("double")
    elasticity = (orders / nonzero(orders_before) - 1) / nonzero(step)
    return ranked.withColumn(
        "tier_elasticity_vendor_cluster_level",
        F.when(no_step | (orders_before == 0), none).otherwise(elasticity),
    ).withColumn("fee_pct_diff_vendor_cluster_level", F.when(no_step, none).otherwise(step))
