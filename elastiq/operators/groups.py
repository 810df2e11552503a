"""Vendor groups: current setup, linked groups, members, schemes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from elastiq.functions.skew import lookup_join, salted_join, with_totals
from elastiq.params import KEYS

GROUP = [*KEYS, "asa_id"]


def _second(name: str):
    return F.date_trunc("SECOND", F.col(name))


def newest_versions(configs: DataFrame, active: DataFrame) -> DataFrame:
    """The newest open assignment and price setup of every group, one row per vendor and price config.

    Newest is per group, not per vendor: a vendor whose price setup did not change at the last change of
    its group drops out. Versions are filtered before their condition arrays are flattened.
    """
    regions = active.select("region", *KEYS)
    versions = (
        lookup_join(configs, regions, KEYS, "inner")
        .select("region", *KEYS, "vendor_code", F.explode("dps_automatic_assignment_history").alias("h"))
        .select("region", *KEYS, "vendor_code", "h", F.explode_outer("h.price_config").alias("pc"))
        .select(
            "region",
            *KEYS,
            F.col("h.id").alias("asa_id"),
            F.col("h.name").alias("asa_name"),
            F.col("h.priority").alias("asa_priority"),
            _second("h.active_from").alias("asa_setup_active_from"),
            _second("h.active_to").alias("asa_setup_active_to"),
            "vendor_code",
            F.col("pc.price_scheme_id").alias("scheme_id"),
            F.col("pc.vendor_group_price_config_id").alias("vendor_group_price_config_id"),
            F.col("pc.priority").alias("condition_priority"),
            F.col("pc.schedule").alias("schedule"),
            F.col("pc.customer_condition").alias("customer_condition"),
            _second("pc.active_from").alias("pc_setup_active_from"),
            _second("pc.active_to").alias("pc_setup_active_to"),
        )
    )
    newest = [
        F.max("asa_setup_active_from").alias("asa_setup_active_from_max_date"),
        F.max("pc_setup_active_from").alias("pc_setup_active_from_max_date"),
    ]
    return with_totals(versions, GROUP, newest).filter(
        (F.col("asa_setup_active_from") == F.col("asa_setup_active_from_max_date"))
        & F.col("asa_setup_active_to").isNull()
        & (F.col("pc_setup_active_from") == F.col("pc_setup_active_from_max_date"))
        & F.col("pc_setup_active_to").isNull()
    )


def current_setups(newest: DataFrame) -> DataFrame:
    """One row per vendor and condition, with the number of vendors in the group.

    ``newest`` is read twice, so pass a staged table.
    """
    vendors = [F.countDistinct("vendor_code").alias("vendor_count_caught_by_asa")]
    return (
        with_totals(newest, GROUP, vendors)
        .withColumn("sch", F.explode_outer("schedule"))
        .withColumn("cc", F.explode_outer("customer_condition"))
        .withColumn("time_condition_id", F.col("sch.id"))
        .withColumn("customer_condition_id", F.col("cc.id"))
        .drop("schedule", "customer_condition", "sch", "cc")
        .distinct()
    )


def linked_groups(setups: DataFrame, *, suffix: str = "_LB", suffix_only: bool = False) -> DataFrame:
    """Parent and child groups of one (entity, country): the child is named ``parent + suffix``.

    One equi-join on the folded names finds each pair; both of its sides become a row. The common name is
    the group's own without any leading or trailing character of the suffix; with ``suffix_only`` it is
    the parent's name.
    """
    groups = setups.select(*KEYS, "asa_name", "asa_id").distinct()
    child = groups.select(*KEYS, F.struct("asa_name", "asa_id").alias("child"))
    parent = groups.select(*KEYS, F.struct("asa_name", "asa_id").alias("parent"))
    child = child.withColumn("_name", F.lower("child.asa_name"))
    parent = parent.withColumn("_name", F.lower(F.concat("parent.asa_name", F.lit(suffix))))
    pairs = child.join(parent, [*KEYS, "_name"])
    sides = F.array(
        F.struct(F.col("child").alias("own"), F.col("parent.asa_name").alias("linked_asa")),
        F.struct(F.col("parent").alias("own"), F.col("child.asa_name").alias("linked_asa")),
    )
    flat = pairs.select(*KEYS, "parent", F.explode(sides).alias("s"))
    common = F.col("parent.asa_name") if suffix_only else F.btrim("s.own.asa_name", F.lit(suffix))
    return flat.select(
        *KEYS,
        F.col("s.own.asa_name").alias("asa_name"),
        F.col("s.own.asa_id").alias("asa_id"),
        *[F.col(k).alias(f"{k}_linked_asa") for k in KEYS],
        F.col("s.linked_asa").alias("linked_asa"),
        F.lit(True).alias("is_asa_clustered"),
        common.alias("asa_common_name"),
    )


def with_master_id(setups: DataFrame, links: DataFrame, *, per_pair_ids: bool = False) -> DataFrame:
    """Add the id, name and flag under which linked groups are pooled.

    By default all linked groups of one (entity, country) share one id, its largest group id plus 1;
    ``per_pair_ids`` numbers the common names instead. A group linked twice appears twice.
    """
    last = setups.groupBy(*KEYS).agg(F.max("asa_id").alias("_last"))
    pooled = links.select(*GROUP, "is_asa_clustered", "asa_common_name").join(last, list(KEYS))
    if per_pair_ids:
        names = pooled.select(*KEYS, "asa_common_name").distinct()
        order = Window.partitionBy(*KEYS).orderBy("asa_common_name")
        numbered = names.withColumn("_offset", F.row_number().over(order))
        pooled = pooled.join(numbered, [*KEYS, "asa_common_name"])
    else:
        pooled = pooled.withColumn("_offset", F.lit(1))
    pooled = pooled.select(
        *GROUP,
        (F.col("_last") + F.col("_offset")).alias("_master"),
        F.col("is_asa_clustered").alias("_linked"),
        F.col("asa_common_name").alias("_common"),
    )
    joined = salted_join(setups, pooled, GROUP, "left", ["vendor_code"])
    return joined.select(
        "region",
        *GROUP,
        F.coalesce("_master", "asa_id").alias("master_asa_id"),
        "asa_name",
        F.coalesce("_common", "asa_name").alias("asa_common_name"),
        F.coalesce("_linked", F.lit(False)).alias("is_asa_clustered"),
        "asa_priority",
        "asa_setup_active_from",
        "asa_setup_active_from_max_date",
        "asa_setup_active_to",
        "vendor_code",
        "scheme_id",
        "vendor_group_price_config_id",
        "condition_priority",
        "time_condition_id",
        "customer_condition_id",
        "pc_setup_active_from",
        "pc_setup_active_from_max_date",
        "pc_setup_active_to",
        "vendor_count_caught_by_asa",
    )


def vendors_per_group(setups: DataFrame) -> DataFrame:
    """Vendors of every group, from the rows without a time or customer condition."""
    return (
        setups.filter(F.col("time_condition_id").isNull() & F.col("customer_condition_id").isNull())
        .select(
            "region",
            *GROUP,
            "master_asa_id",
            "asa_name",
            "asa_common_name",
            "is_asa_clustered",
            "vendor_count_caught_by_asa",
            "vendor_code",
        )
        .distinct()
    )


def schemes_per_group(setups: DataFrame) -> DataFrame:
    """Price schemes of every group, labelled as main or condition scheme."""
    main = F.col("time_condition_id").isNull() & F.col("customer_condition_id").isNull()
    return setups.select(
        "region",
        *GROUP,
        "master_asa_id",
        "asa_name",
        "asa_common_name",
        "vendor_count_caught_by_asa",
        "scheme_id",
        F.when(main, "Main Scheme").otherwise("Condition Scheme").alias("scheme_type"),
    ).distinct()
