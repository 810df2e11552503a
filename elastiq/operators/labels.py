"""Label vendors whose conversion holds up better than their group's as the fee rises."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from elastiq.functions.numbers import plain_number, ratio
from elastiq.functions.skew import salted_join
from elastiq.operators.curves import GROUP_LEVEL, VENDOR_LEVEL
from elastiq.operators.screening import STAGES
from elastiq.params import KEYS, Params


def compare_curves(vendor: DataFrame, group_base: DataFrame, group: DataFrame, p: Params) -> DataFrame:
    """Vendor rows with the base of their group and with the group row at the same fee."""
    ids = [*KEYS, p.group_key]
    g, v = GROUP_LEVEL, VENDOR_LEVEL
    extras = [c for c in (g.slope, g.rank, g.tiers) if c in group.columns]
    own = [c for c in (v.slope, v.rank, v.tiers) if c in vendor.columns]
    base = group_base.select(*ids, g.min_fee, g.base_cvr)
    curve = group.select(*ids, "df_total", g.cvr, g.change, *extras)
    joined = salted_join(vendor, base, ids, "left", ["vendor_code"])
    joined = salted_join(joined, curve, [*ids, "df_total"], "left", ["vendor_code"])
    moved = [v.cvr, v.min_fee, v.base_cvr, v.change, *own]
    return joined.select(
        *[c for c in vendor.columns if c not in moved],
        v.min_fee,
        v.base_cvr,
        g.min_fee,
        g.base_cvr,
        g.cvr,
        g.change,
        *extras,
        v.cvr,
        v.change,
        *own,
    )


def pct_test(compared: DataFrame, p: Params) -> DataFrame:
    """Does the vendor lose less than its group at this fee, and at how many fees does it?"""
    better = F.col(VENDOR_LEVEL.change) > F.col(GROUP_LEVEL.change)
    vendor = Window.partitionBy(*VENDOR_LEVEL.ids(p))
    return compared.withColumn("is_lb_test_passed", F.when(better, "Y").otherwise("N")).withColumn(
        "num_yes", F.sum(F.when(better, 1).otherwise(0)).over(vendor)
    )


def slope_test(compared: DataFrame) -> DataFrame:
    """Is the vendor's slope above its group's? A zero or missing slope is a no."""
    own, group = F.col(VENDOR_LEVEL.slope), F.col(GROUP_LEVEL.slope)
    verdict = (
        F.when((own == 0) | own.isNull() | (own <= group), "N").when(own > group, "Y").otherwise("Unknown")
    )
    return compared.withColumn("is_lb_test_passed_lm", verdict)


def _by_fee(name: str, value: str | None = None, text: Callable[[Column], Column] = plain_number) -> Column:
    """The values of a vendor's tiers in fee order as one text; NULLs are left out.

    A vendor has one value per current fee tier of its group, so the list is as short as a price list.
    """
    pair = F.struct(F.col("df_total").alias("fee"), F.col(value or name).alias("value"))
    texts = F.transform(F.sort_array(F.collect_list(pair)), lambda t: text(t["value"]))
    return F.array_join(texts, ", ").alias(name)


def _as_is(value: Column) -> Column:
    return value


def vendor_labels(tested: DataFrame, p: Params) -> DataFrame:
    """One row per vendor: its label and its curve as comma lists."""
    v, g = VENDOR_LEVEL, GROUP_LEVEL
    grain = v.grain(p)
    label = F.when(F.col("num_yes") > 0, "Y").otherwise("N").alias("is_lb")
    by_slope = [F.col("is_lb_test_passed_lm").alias("is_lb_lm")] if p.slope_test else []
    lists = [
        _by_fee("dfs_seen_in_sessions", "df_total"),
        _by_fee("is_lb_test_passed", text=_as_is),
        _by_fee("vendor_cvr3_by_df", v.cvr),
        _by_fee(v.change),
        _by_fee(g.cvr),
        _by_fee(g.change),
    ]
    if p.slope_test:
        lists.append(_by_fee("is_lb_test_passed_lm", text=_as_is))
        counts = (v.tiers, g.tiers) if p.tier_ranks else ()
        lists += [F.avg(c).alias(c) for c in (v.slope, g.slope, *counts)]
    return tested.groupBy(*grain, label, *by_slope).agg(*lists)


def final_vendor_list(ranked: DataFrame, labels: DataFrame, directory: DataFrame, p: Params) -> DataFrame:
    """All vendors, screened or not, with their label, metrics and the funnel after labelling."""
    v, g = VENDOR_LEVEL, GROUP_LEVEL
    ids = [*KEYS, p.group_key, "vendor_code"]
    methods = {"": "is_lb", "_lm": "is_lb_lm"} if p.slope_test else {"": "is_lb"}
    texts = ["dfs_seen_in_sessions", "vendor_cvr3_by_df", v.change, g.cvr, g.change]
    slopes = [v.slope, g.slope] if p.slope_test else []
    tiers = [v.tiers, g.tiers] if p.slope_test and p.tier_ranks else []
    tests = ["is_lb_test_passed", "is_lb_test_passed_lm"] if p.slope_test else ["is_lb_test_passed"]
    marked = labels.select(
        *ids,
        # the keys of the label row itself: NULL for vendors without one
        *[F.col(k).alias(f"_{k}") for k in KEYS],
        *[F.col(m).alias(f"_{m}") for m in methods.values()],
        *texts,
        *slopes,
        *[F.round(t).cast("bigint").alias(t) for t in tiers],
        *tests,
    )
    verticals = directory.select(
        F.col("global_entity_id").alias("entity_id"), F.col("vendor_id").alias("vendor_code"), "vertical_type"
    )
    joined = ranked.join(marked, ids, "left").join(verticals, ["entity_id", "vendor_code"], "left")

    label_group = [*[f"_{k}" for k in KEYS], "asa_id"]
    yes = {s: F.col(f"_{m}") == "Y" for s, m in methods.items()}
    per_vendor = (
        joined.filter(F.col("_entity_id").isNotNull())
        .groupBy(*label_group, "vendor_code")
        .agg(
            *[F.sum(F.when(y, F.col("num_orders")).otherwise(0)).alias(f"_orders{s}") for s, y in yes.items()],
            *[F.max(F.when(y, 1).otherwise(0)).alias(f"_vendors{s}") for s, y in yes.items()],
        )
    )
    totals = per_vendor.groupBy(*label_group).agg(
        *[F.sum(c).alias(c) for s in methods for c in (f"_orders{s}", f"_vendors{s}")]
    )
    # vendors without a label row match no total and count 0
    joined = salted_join(joined, totals, label_group, "left", ["vendor_code"])
    orders = {s: F.coalesce(f"_orders{s}", F.lit(0)) for s in methods}
    vendors = {s: F.coalesce(f"_vendors{s}", F.lit(0)) for s in methods}
    entity, caught = F.col("entity_orders"), F.col("vendor_count_caught_by_asa")

    def top(method: str):
        return F.when(F.col(f"_{method}").isNotNull(), "Top 25%").otherwise("Bottom 75%")

    names = ["asa_id", "master_asa_id", "asa_name", "asa_common_name"]
    return joined.select(
        "region",
        *KEYS,
        *[c for c in names if c in ranked.columns],
        "vendor_code",
        "vertical_type",
        *[top(m).alias(f"vendor_rank{s}") for s, m in methods.items()],
        *[F.coalesce(f"_{m}", F.lit("N")).alias(m) for m in methods.values()],
        *[F.coalesce(t, F.lit("N")).alias(t) for t in tests],
        *texts,
        *slopes,
        *tiers,
        "num_orders",
        "num_unique_vendor_visits",
        "cvr3",
        "orders_pct_rank",
        "unique_visits_pct_rank",
        "cvr3_pct_rank",
        "entity_orders",
        "asa_orders",
        "asa_order_share_of_entity",
        *[f"asa_orders_after_{s}" for s in STAGES],
        *[orders[s].alias(f"asa_orders_after_lb_logic{s}") for s in methods],
        *[f"asa_order_share_after_{s}" for s in STAGES],
        *[ratio(orders[s], entity, 4).alias(f"asa_order_share_after_lb_logic{s}") for s in methods],
        "vendor_count_caught_by_asa",
        *[f"vendor_count_remaining_after_{s}" for s in STAGES],
        *[vendors[s].alias(f"vendor_count_remaining_after_lb_logic{s}") for s in methods],
        *[f"perc_vendors_remaining_after_{s}" for s in STAGES],
        *[ratio(vendors[s], caught, 4).alias(f"perc_vendors_remaining_after_lb_logic{s}") for s in methods],
    )
