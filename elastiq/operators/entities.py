"""Active entities and their delivery zones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from elastiq.functions.skew import lookup_join
from elastiq.params import ENTITY_DENY, ENTITY_DENY_LITE, ENTITY_NOT_LIKE


def _platforms(entities: DataFrame, orders: DataFrame, not_like: Sequence[str], deny: Sequence[str]) -> DataFrame:
    flat = entities.select(
        "region", F.explode("platforms.entity_id").alias("entity_id"), "country_iso", "country_name"
    )
    for pattern in not_like:
        flat = flat.filter(~F.col("entity_id").like(pattern))
    flat = flat.filter(~F.col("entity_id").isin(*deny))
    # distinct first: the orders of a hot entity are reduced to one row before the shuffle
    return flat.join(orders.select("entity_id").distinct(), "entity_id", "left_semi")


def active_entities(
    entities: DataFrame,
    orders: DataFrame,
    *,
    not_like: Sequence[str] = ENTITY_NOT_LIKE,
    deny: Sequence[str] = ENTITY_DENY,
) -> DataFrame:
    """Entities that have orders, without the excluded ones. ``_`` in a pattern matches any character."""
    return _platforms(entities, orders, not_like, deny).select(
        "region", "entity_id", F.lower("country_iso").alias("country_code"), "country_name"
    )


def entities_lite(
    entities: DataFrame,
    orders: DataFrame,
    *,
    not_like: Sequence[str] = ENTITY_NOT_LIKE,
    deny: Sequence[str] = ENTITY_DENY_LITE,
) -> DataFrame:
    """The same with a shorter exclusion list and the country code as it is."""
    return _platforms(entities, orders, not_like, deny).select(
        "region", "entity_id", "country_iso", "country_name"
    )


def active_zones(countries: DataFrame, active: DataFrame) -> DataFrame:
    """Active zones of active cities of active entities."""
    flat = (
        countries.select(
            "region", "country_code", "cities", F.explode("platforms.entity_id").alias("entity_id")
        )
        .select("region", "entity_id", "country_code", F.explode("cities").alias("ci"))
        .filter("ci.is_active")
        .select("region", "entity_id", "country_code", "ci.name", "ci.id", F.explode("ci.zones").alias("zo"))
        .filter("zo.is_active")
        .select(
            "region",
            "entity_id",
            "country_code",
            F.col("name").alias("city_name"),
            F.col("id").alias("city_id"),
            F.col("zo.name").alias("zone_name"),
            F.col("zo.id").alias("zone_id"),
            F.col("zo.shape").alias("zone_shape"),
        )
    )
    keys = ["entity_id", "country_code"]
    return lookup_join(flat, active.select(*keys), keys, "inner").select(*flat.columns)
