"""Web sessions inside delivery zones, the last fee each one saw, and their join."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from elastiq.functions.geo import point_text, points_in_zones, points_in_zones_on_sphere, zone_cells, zones_on_sphere
from elastiq.functions.skew import lookup_join, null_lane
from elastiq.params import FEE_PLACES, KEYS, TRANSACTION, VISIT

VENDOR = [*KEYS, "vendor_code"]


def _vertical(name: str):
    low = F.lower(name)
    return (
        F.when(low.isin("restaurant", "restaurants"), "restaurant")
        .when(low == "shop", "shop")
        .when(low == "darkstores", "darkstores")
    )


def zone_index(zones: DataFrame, cell_size: float, *, sphere: bool = False) -> DataFrame:
    """Quadtree cells of the active zones, for both spatial joins. Stage it: it may be larger than its zones."""
    on = [*KEYS, "city_name"]
    if sphere:
        return zone_cells(zones_on_sphere(zones, "zone_shape"), [*on, "_side"], "zone_shape", math.radians(cell_size))
    return zone_cells(zones, on, "zone_shape", cell_size)


def _in_zones(points: DataFrame, cells: DataFrame, on: Sequence[str], cell_size: float, sphere: bool, **names: str) -> DataFrame:
    if sphere:
        return points_in_zones_on_sphere(points, cells, on, math.radians(cell_size), **names)
    return points_in_zones(points, cells, on, cell_size, **names)


def sessions_in_zones(
    sessions: DataFrame,
    zones: DataFrame,
    cells: DataFrame,
    vendors: DataFrame,
    window: tuple[date, date],
    *,
    cell_size: float = 0.02,
    sphere: bool = False,
) -> DataFrame:
    """Visit and transaction events of known vendors, in sessions located inside an active zone.

    The date filter and the event kinds are applied before anything is flattened, the zone tests before
    the events are. The zone tests are semi joins: overlapping zones never multiply a session.
    """
    first, last = window
    # The cheap test of kinds drops sessions; the exact filter runs once, on those that are left.
    kinds = F.arrays_overlap("events.event_action", F.array(F.lit(VISIT), F.lit(TRANSACTION)))
    kept = sessions.filter(F.col("created_date").between(F.lit(first), F.lit(last)) & kinds).withColumn(
        "events",
        F.filter(
            "events", lambda e: e["event_action"].isin(VISIT, TRANSACTION) & e["vendor_code"].isNotNull()
        ),
    )
    located = (
        kept.withColumn("dps", F.explode("dps_zone"))
        .withColumn("city_name", F.col("dps.city_name"))
        .withColumn("zone_name", F.col("dps.name"))
    )
    names = zones.select(*KEYS, "city_name", "zone_name")
    located = lookup_join(located, names, [*KEYS, "city_name", "zone_name"], "left_semi")
    located = _in_zones(located, cells, [*KEYS, "city_name"], cell_size, sphere)
    s = "sessions."
    flat = located.withColumn("e", F.explode("events")).select(
        "created_date",
        *KEYS,
        "platform",
        "brand",
        "events_ga_session_id",
        "fullvisitor_id",
        "visit_id",
        "has_transaction",
        "total_transactions",
        "ga_dps_session_id",
        s + "dps_session_timestamp",
        s + "endpoint",
        s + "perseus_client_id",
        s + "variant",
        F.col(s + "experiment_id").alias("test_id"),
        _vertical(s + "vertical_parent").alias("vertical_parent"),
        s + "customer_status",
        s + "location",
        s + "variant_concat",
        s + "location_concat",
        s + "customer_status_concat",
        "e.event_action",
        "e.vendor_code",
        "e.vertical_type",
        "e.event_time",
        "e.transaction_id",
        "e.expedition_type",
        F.col("dps.city_id").alias("city_id"),
        "city_name",
        F.col("dps.id").alias("zone_id"),
        "zone_name",
        F.col("dps.timezone").alias("timezone"),
        point_text(F.col("lon"), F.col("lat")).alias("ga_location"),
    )
    return lookup_join(flat, vendors.select(*VENDOR), VENDOR, "left_semi").distinct()


# Bits of the mask of the vendors a session saw. A vendor that shares its bit with one that was seen passes the mask.
_MASK = 64


def _bit(vendor_code: Column) -> Column:
    place = F.pmod(F.xxhash64(vendor_code), F.lit(_MASK)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def sessions_seen(events: DataFrame) -> DataFrame:
    """Session ids of located events with a mask of the vendors they name, to reduce the requests before their arrays are flattened.

    The mask has a fixed size, so a session with very many events is no larger than another. Sessions without an id match no request.
    """
    return (
        events.filter(F.col("ga_dps_session_id").isNotNull())
        .groupBy(*KEYS, F.col("ga_dps_session_id").alias("dps_session_id"))
        .agg(F.bit_or(_bit(F.col("vendor_code"))).alias("_seen"))
    )


def fee_requests(
    requests: DataFrame,
    zones: DataFrame,
    cells: DataFrame,
    window: tuple[date, date],
    *,
    seen: DataFrame | None = None,
    endpoints: Sequence[str] = ("singleFee",),
    cell_size: float = 0.02,
    sphere: bool = False,
) -> DataFrame:
    """Pricing requests with a session id, made inside an active zone of the entity (of any country).

    With ``seen`` (of ``sessions_seen``) only those of its sessions, and of their offers those that pass the mask: offers of vendors the
    session never looked at cannot be the fee it saw, and are dropped before the zone tests and before anything is flattened.
    """
    first, last = window
    flat = requests.filter(
        F.col("created_date").between(F.lit(first), F.lit(last))
        & F.col("endpoint").isin(*endpoints)
        & F.col("customer.session.id").isNotNull()
    ).select(
        "entity_id",
        F.lower("country_code").alias("country_code"),
        "created_date",
        F.col("customer.user_id").alias("perseus_id"),
        F.col("customer.session.id").alias("dps_session_id"),
        "vendors",
        F.col("customer.session.timestamp").alias("session_timestamp"),
        "created_at",
        F.col("customer.lon").alias("_lon"),
        F.col("customer.lat").alias("_lat"),
    )
    flat = lookup_join(flat, zones.select(*KEYS).distinct(), KEYS, "left_semi")
    if seen is not None:
        passes = lambda v: _bit(v["id"]).bitwiseAND(F.col("_seen")) != 0
        flat = flat.join(seen, [*KEYS, "dps_session_id"]).withColumn("vendors", F.filter("vendors", passes)).drop("_seen")
        flat = flat.filter(F.size("vendors") > 0)
    return _in_zones(flat, cells, ["entity_id"], cell_size, sphere, lon="_lon", lat="_lat").drop("_lon", "_lat")


def fee_offers(requests: DataFrame, vendors: DataFrame, *, fee_field: str = "travel_time") -> DataFrame:
    """One row per request and known vendor with the scheme and fee shown, without repeats."""
    return known_offers(requests, vendors, fee_field=fee_field).distinct()


def known_offers(requests: DataFrame, vendors: DataFrame, *, fee_field: str = "travel_time") -> DataFrame:
    """The same with repeats, which cannot matter to the last fee."""
    return lookup_join(_flat_offers(requests, fee_field), vendors.select(*VENDOR), VENDOR, "left_semi")


def seen_offers(requests: DataFrame, events: DataFrame, *, fee_field: str = "travel_time") -> DataFrame:
    """Offers of the vendors that located events of the same session name, all of them known, with repeats.

    The mask of ``sessions_seen`` lets some others pass; the semi join here has the keys of ``last_fee``, so both share a shuffle.
    """
    on = [*KEYS, "dps_session_id", "vendor_code"]
    pairs = events.withColumn("dps_session_id", F.col("ga_dps_session_id")).select(*on).filter(F.col("dps_session_id").isNotNull())
    return _flat_offers(requests, fee_field).join(pairs.distinct(), on, "left_semi")


def _flat_offers(requests: DataFrame, fee_field: str) -> DataFrame:
    return requests.withColumn("v", F.explode("vendors")).select(
        *KEYS,
        "created_date",
        "perseus_id",
        "dps_session_id",
        F.col("v.id").alias("vendor_code"),
        F.col("v.meta_data.scheme_id").alias("scheme_id"),
        F.col("v.meta_data.vendor_price_scheme_type").alias("vendor_price_scheme_type"),
        F.round(f"v.delivery_fee.{fee_field}", FEE_PLACES).alias("df_total"),
        "session_timestamp",
        "created_at",
    )


def last_fee(offers: DataFrame) -> DataFrame:
    """The newest offer per session and vendor.

    The largest struct wins, so equal times are decided by scheme, then fee, then the other columns, and
    offers are reduced before the shuffle. Repeated offers cannot matter.
    """
    by = [*KEYS, "dps_session_id", "vendor_code"]
    order = ["created_at", "scheme_id", "df_total"]
    rest = [c for c in offers.columns if c not in by and c not in order]
    newest = offers.groupBy(*by).agg(F.max(F.struct(*order, *rest)).alias("o"))
    return newest.select(*[F.col(c) if c in by else F.col(f"o.{c}").alias(c) for c in offers.columns])


def sessions_with_fee(sessions: DataFrame, fees: DataFrame) -> DataFrame:
    """Add the fee seen to every session event; NULL where none was logged.

    Sessions without an id match nothing and are spread over many tasks instead of one.
    """
    logged = fees.select(
        *KEYS,
        F.col("dps_session_id").alias("ga_dps_session_id"),
        "vendor_code",
        "df_total",
        "scheme_id",
        "vendor_price_scheme_type",
        F.col("created_at").alias("dps_logs_created_at"),
        F.lit(0).alias("_lane"),
    )
    lane = null_lane(["ga_dps_session_id"], ["events_ga_session_id", "event_time"])
    on = [*KEYS, "ga_dps_session_id", "vendor_code", "_lane"]
    joined = sessions.withColumn("_lane", lane).join(logged, on, "left")
    return joined.select(
        *sessions.columns, "df_total", "scheme_id", "vendor_price_scheme_type", "dps_logs_created_at"
    )
