"""The input tables of a run, derived from the test tables.

A region is an entity, a nation a vendor group, a supplier a vendor and a delivery zone, an order a
session, a discount a fee. Every stand-in has the nesting of the real table; arrays are built per row, so
no stand-in gathers rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import wraps
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from elastiq.functions.skew import lookup_join, split_hot_keys
from elastiq.params import AUTOMATIC_SCHEME, COMPLETED, TRANSACTION, VISIT, Params
from elastiq.sources.staging import stage

# the stand-in dates fall into January and the first days of February 2024
AS_OF = dt.date(2024, 2, 15)
# a child group is named after its parent with a "1" at the end: NATION_1 and NATION_11
PARAMS = Params(as_of=AS_OF, visits_thr=0.25, orders_thr=0.25, cvr_thr=0.25, link_suffix="1", cell_size=0.5)


def once(build: Callable[..., Any]) -> Callable[..., Any]:
    """Build a frame once per set of stand-ins, so that one query opens each file a single time."""

    @wraps(build)
    def lookup(s: StandIns, *args: Any) -> Any:
        key = (build.__name__, *args)
        if key not in s.made:
            s.made[key] = build(s, *args)
        return s.made[key]

    return lookup


class StandIns:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        split_hot_keys(spark)
        self.spark = spark
        self.folder = folder
        self.made: dict[tuple, Any] = {}

    @once
    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __call__(self, name: str) -> DataFrame:
        return getattr(self, name)()

    @once
    def places(self) -> DataFrame:
        """Suppliers with their entity, country and group; staged, so that its size is known."""
        nation = self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")
        )
        places = (
            self.table("supplier")
            .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                "s_suppkey",
                "s_name",
                "s_acctbal",
                F.col("s_suppkey").cast("string").alias("vendor_code"),
                F.col("n_nationkey").cast("bigint").alias("nationkey"),
                "n_name",
                "r_regionkey",
                F.col("r_name").alias("entity_id"),
                *_region_names(),
            )
        )
        return stage(places, "places")

    @once
    def lines(self) -> DataFrame:
        lines = self.table("lineitem").withColumn("s_suppkey", F.col("l_suppkey"))
        return lookup_join(lines, self.places(), ["s_suppkey"], "inner")

    @once
    def entities(self) -> DataFrame:
        region, code = _region_names()
        return self.table("region").select(
            region,
            F.upper(F.substring("r_name", 1, 2)).alias("country_iso"),
            F.col("r_name").alias("country_name"),
            F.array(
                F.struct(F.col("r_name").alias("entity_id")),
                F.struct(F.concat(F.lit("DN_"), "r_name").alias("entity_id")),
            ).alias("platforms"),
        )

    @once
    def countries(self) -> DataFrame:
        zone = F.struct(
            F.col("s_suppkey").alias("id"),
            F.col("s_name").alias("name"),
            (F.col("s_acctbal") > 0).alias("is_active"),
            _shape().alias("shape"),
        )
        city = F.struct(
            F.col("nationkey").alias("id"),
            F.col("n_name").alias("name"),
            (F.col("n_name") != "NATION_9").alias("is_active"),
            F.array(zone).alias("zones"),
        )
        return self.places().select(
            "region",
            "country_code",
            F.array(F.struct("entity_id")).alias("platforms"),
            F.array(city).alias("cities"),
        )

    @once
    def group_config_versions(self) -> DataFrame:
        """One version of a vendor's group per year of shipments; the last year is still open."""
        years = (
            self.lines()
            .groupBy(
                "entity_id", "country_code", "vendor_code", "nationkey", "n_name", F.year("l_shipdate").alias("y")
            )
            .agg(
                F.date_trunc("QUARTER", F.max("l_shipdate")).cast("timestamp_ntz").alias("changed"),
                F.max("l_linenumber").alias("condition"),
            )
        )
        from_, to = F.make_timestamp_ntz("y", *_midnight()), F.make_timestamp_ntz(F.col("y") + 1, *_midnight())
        open_ = F.col("y") == 2001

        def config(offset: int, schedule: Column, condition: Column) -> Column:
            return F.struct(
                (F.col("nationkey") * 10 + offset).alias("price_scheme_id"),
                F.col("nationkey").alias("vendor_group_price_config_id"),
                F.lit(offset + 1).alias("priority"),
                F.col("changed").alias("active_from"),
                F.when(~open_, to).alias("active_to"),
                schedule.alias("schedule"),
                condition.alias("customer_condition"),
            )

        none = F.array().cast("array<struct<id:bigint>>")
        times = F.array(F.struct(F.lit(1).cast("bigint").alias("id")), F.struct(F.lit(2).cast("bigint").alias("id")))
        customers = F.array(F.struct(F.col("condition").cast("bigint").alias("id")))
        version = F.struct(
            F.col("nationkey").alias("id"),
            F.col("n_name").alias("name"),
            F.lit(1).alias("priority"),
            from_.alias("active_from"),
            F.when(~open_, to).alias("active_to"),
            F.array(config(0, none, none), config(1, times, customers)).alias("price_config"),
        )
        return years.select(
            "entity_id", "country_code", "vendor_code", F.array(version).alias("dps_automatic_assignment_history")
        )

    @once
    def scheme_config_versions(self) -> DataFrame:
        """The fees of a group's main and condition scheme; the highest fee has an open threshold."""
        fees = self.lines().groupBy("region", "entity_id", "country_code", "nationkey", "n_name", "l_discount").agg(
            F.max("l_tax").alias("tax")
        )
        since = F.expr("TIMESTAMP_NTZ '2001-01-01'")
        before = F.expr("TIMESTAMP_NTZ '2000-01-01'")
        never = F.lit(None).cast("timestamp_ntz")

        def version(name: Column, label: str, start: Column, end: Column) -> Column:
            return F.struct(name.alias(label), start.alias("active_from"), end.alias("active_to"))

        def history(name: Column, start: Column, end: Column) -> Column:
            return F.struct(
                name.alias("scheme_name"),
                start.alias("active_from"),
                end.alias("active_to"),
                F.col("nationkey").alias("travel_time_config_id"),
            )

        old, new = F.concat(F.lit("old "), "n_name"), F.concat(F.lit("new "), "n_name")
        threshold = F.round(F.col("l_discount") * 100 + 5.5, 2)
        details = F.array(
            F.struct(
                F.when(F.col("l_discount") < 0.1, threshold).alias("travel_time_threshold"),
                F.col("l_discount").alias("travel_time_fee"),
                since.alias("active_from"),
                F.when(F.col("l_discount") == 0.05, since).alias("active_to"),
            )
        )
        return fees.select(
            "region",
            "entity_id",
            "country_code",
            F.explode(F.array(F.col("nationkey") * 10, F.col("nationkey") * 10 + 1)).alias("scheme_id"),
            F.array(history(old, before, since), history(old, before, never), history(new, since, never)).alias(
                "price_scheme_history"
            ),
            F.array(version(old, "config_name", before, never), version(new, "config_name", since, never)).alias(
                "travel_time_config"
            ),
            details.alias("travel_time_detail"),
        )

    @once
    def web_sessions(self) -> DataFrame:
        """One session row per line; its order is the session and its supplier the vendor visited."""
        order = F.col("l_orderkey").cast("string")
        sold = F.col("l_returnflag") == "R"
        kind = F.col("l_linenumber")
        nothing = F.lit(None).cast("string")

        def event(action: Column, vendor: Column, transaction: Column) -> Column:
            return F.struct(
                action.alias("event_action"),
                vendor.alias("vendor_code"),
                F.lit("restaurants").alias("vertical_type"),
                F.col("l_shipdate").alias("event_time"),
                transaction.alias("transaction_id"),
                F.lit("delivery").alias("expedition_type"),
            )

        def zone(id_: Column, name: Column) -> Column:
            return F.struct(
                F.col("nationkey").alias("city_id"),
                F.col("n_name").alias("city_name"),
                id_.alias("id"),
                name.alias("name"),
                F.lit("UTC").alias("timezone"),
            )

        lon, lat = _point()
        return self.lines().select(
            _january(F.col("l_shipdate")).alias("created_date"),
            "entity_id",
            "country_code",
            F.when(F.col("l_linestatus") == "F", "iOS").otherwise("Android").alias("platform"),
            F.col("n_name").alias("brand"),
            order.alias("events_ga_session_id"),
            F.col("l_partkey").cast("string").alias("fullvisitor_id"),
            F.concat_ws("-", order, kind.cast("string")).alias("visit_id"),
            sold.alias("has_transaction"),
            sold.cast("bigint").alias("total_transactions"),
            F.when(F.col("l_orderkey") % 50 != 0, F.concat(F.lit("d"), order)).alias("ga_dps_session_id"),
            lon.alias("lon"),
            lat.alias("lat"),
            F.struct(
                F.col("l_shipdate").alias("dps_session_timestamp"),
                F.lit("singleFee").alias("endpoint"),
                F.col("vendor_code").alias("perseus_client_id"),
                F.col("l_returnflag").alias("variant"),
                nothing.alias("experiment_id"),
                F.when(kind == 1, "Restaurants")
                .when(kind == 2, "SHOP")
                .when(kind == 3, "darkstores")
                .when(kind == 4, "other")
                .alias("vertical_parent"),
                F.lit("new").alias("customer_status"),
                F.col("n_name").alias("location"),
                F.col("l_returnflag").alias("variant_concat"),
                F.col("n_name").alias("location_concat"),
                F.lit("new").alias("customer_status_concat"),
            ).alias("sessions"),
            F.array(
                event(F.lit("home_screen.loaded"), nothing, nothing),
                event(F.lit(VISIT), F.col("vendor_code"), nothing),
                event(
                    F.when(sold, TRANSACTION).otherwise("checkout.loaded"), F.col("vendor_code"), F.when(sold, order)
                ),
            ).alias("events"),
            F.array(
                zone(F.col("s_suppkey"), F.col("s_name")), zone(F.lit(-1).cast("bigint"), F.lit("Nowhere"))
            ).alias("dps_zone"),
        )

    @once
    def pricing_requests(self) -> DataFrame:
        """One request per line, made in the session of its order."""
        order = F.col("l_orderkey").cast("string")
        lon, lat = _point()
        session = F.struct(
            F.when(F.col("l_orderkey") % 40 != 0, F.concat(F.lit("d"), order)).alias("id"),
            F.col("l_shipdate").alias("timestamp"),
        )
        offer = F.struct(
            F.col("vendor_code").alias("id"),
            F.struct(
                F.col("l_linenumber").cast("bigint").alias("scheme_id"),
                F.when(F.col("l_returnflag") == "N", "Manual").otherwise(AUTOMATIC_SCHEME).alias(
                    "vendor_price_scheme_type"
                ),
            ).alias("meta_data"),
            F.struct(
                F.col("l_discount").alias("travel_time"), F.round(F.col("l_discount") + F.col("l_tax"), 2).alias("total")
            ).alias("delivery_fee"),
        )
        return self.lines().select(
            "entity_id",
            F.upper("country_code").alias("country_code"),
            _january(F.col("l_shipdate")).alias("created_date"),
            F.col("l_shipdate").alias("created_at"),
            F.when(F.col("l_linenumber") == 4, "multipleFee").otherwise("singleFee").alias("endpoint"),
            F.struct(
                F.col("l_partkey").cast("string").alias("user_id"),
                lon.alias("lon"),
                lat.alias("lat"),
                session.alias("session"),
            ).alias("customer"),
            F.array(offer).alias("vendors"),
        )

    @once
    def orders_mapped(self) -> DataFrame:
        """One order row per line."""
        line = F.col("l_linenumber")
        # no amount divided by these ends on half a cent, where two engines may round differently
        rates = F.array(*[F.lit(r) for r in (1.0, 1.25, 1.5, 3.0, 7.0)])
        orders = self.table("orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
        return (
            self.lines()
            .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                "entity_id",
                "country_code",
                F.col("vendor_code").alias("vendor_id"),
                F.col("l_orderkey").cast("string").alias("platform_order_code"),
                _january(F.col("o_orderdate")).alias("created_date"),
                F.when(F.col("o_orderstatus") == "P", "cancelled").otherwise(COMPLETED).alias("delivery_status"),
                (F.col("l_linestatus") == "F").alias("is_sent"),
                F.when(line == 7, "none").otherwise(F.col("nationkey").cast("string")).alias("assignment_id"),
                F.when(F.col("l_returnflag") == "N", "Manual").otherwise(AUTOMATIC_SCHEME).alias(
                    "vendor_price_scheme_type"
                ),
                rates[F.col("r_regionkey")].alias("exchange_rate"),
                (F.col("l_tax") * 100).alias("delivery_fee_local"),
                F.when(line != 3, F.col("l_quantity") > 40).alias("is_delivery_fee_covered_by_discount"),
                F.when(line != 4, F.col("l_quantity") < 5).alias("is_delivery_fee_covered_by_voucher"),
                F.col("l_discount").alias("dps_travel_time_fee_local"),
                (F.col("l_extendedprice") * 0.12).alias("commission_local"),
                F.col("l_tax").alias("joker_vendor_fee_local"),
                F.when(line != 2, F.lit(0.5)).alias("service_fee_local"),
                F.col("l_quantity").alias("gfv_local"),
                F.lit(20.0).alias("dps_minimum_order_value_local"),
                (F.col("l_quantity") * 0.2).alias("delivery_costs_local"),
                F.col("l_extendedprice").alias("gmv_local"),
            )
        )

    @once
    def external_fee_orders(self) -> DataFrame:
        """Orders with a first line have an external fee."""
        orders = self.table("orders").select("o_orderkey", "o_orderdate")
        return (
            self.lines()
            .filter(F.col("l_linenumber") <= 2)
            .groupBy("entity_id", "l_orderkey")
            .agg(F.max("l_tax").alias("tax"))
            .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                F.col("entity_id").alias("global_entity_id"),
                F.col("l_orderkey").cast("string").alias("code"),
                _january(F.col("o_orderdate")).alias("created_date_utc"),
                (F.col("tax") * 50).alias("delivery_fee_local"),
            )
        )

    @once
    def order_values(self) -> DataFrame:
        return (
            self.lines()
            .groupBy("entity_id", "l_orderkey")
            .agg(F.min("l_quantity").alias("q"))
            .select(
                F.col("entity_id").alias("global_entity_id"),
                F.col("l_orderkey").cast("string").alias("order_id"),
                F.struct(F.when(F.col("q") > 10, F.col("q") * 0.1).alias("mov_customer_fee_local")).alias("value"),
            )
        )

    @once
    def vendor_directory(self) -> DataFrame:
        return self.places().select(
            F.col("entity_id").alias("global_entity_id"),
            F.col("vendor_code").alias("vendor_id"),
            F.when(F.col("s_acctbal") > 3000, "restaurants").otherwise("shop").alias("vertical_type"),
        )

    # flat stand-ins for the steps after flattening

    @once
    def vendors(self) -> DataFrame:
        """Suppliers as members of their nation's group, NATION_1 and NATION_11 pooled."""
        places = self.places()
        sizes = places.groupBy("nationkey").agg(F.count(F.lit(1)).alias("vendor_count_caught_by_asa"))
        linked = F.col("n_name").isin("NATION_1", "NATION_11")
        return places.join(sizes, "nationkey").select(
            "region",
            "entity_id",
            "country_code",
            F.col("nationkey").alias("asa_id"),
            F.when(linked, F.lit(22).cast("bigint")).otherwise(F.col("nationkey")).alias("master_asa_id"),
            F.col("n_name").alias("asa_name"),
            F.when(linked, "NATION_").otherwise(F.col("n_name")).alias("asa_common_name"),
            linked.alias("is_asa_clustered"),
            "vendor_count_caught_by_asa",
            "vendor_code",
        )

    @once
    def group_fees(self) -> DataFrame:
        """Fees now in force per group: all seen discounts but the highest."""
        groups = self.vendors().select(
            "region", "entity_id", "country_code", "asa_id", "master_asa_id", "asa_name", "asa_common_name"
        )
        fees = self.lines().select(F.col("nationkey").alias("asa_id"), F.col("l_discount").alias("fee")).distinct()
        return groups.distinct().join(fees.filter("fee < 0.1"), "asa_id").select(*groups.columns, "fee")

    @once
    def events(self) -> DataFrame:
        """Every line is a visit; a returned line is a transaction as well."""
        sold = F.when(F.col("l_returnflag") == "R", TRANSACTION)
        return self.lines().select(
            "entity_id",
            "country_code",
            "vendor_code",
            F.col("l_orderkey").cast("string").alias("events_ga_session_id"),
            F.explode(F.array(F.lit(VISIT), sold)).alias("event_action"),
            F.col("l_shipdate").alias("event_time"),
            F.col("l_discount").alias("df_total"),
        ).filter(F.col("event_action").isNotNull())


def _region_names() -> tuple[Column, Column]:
    region = F.concat(F.substring("r_name", 1, 1), F.lower(F.substring("r_name", 2, 100)))
    return region.alias("region"), F.lower(F.substring("r_name", 1, 2)).alias("country_code")


def _midnight() -> tuple[Column, ...]:
    return F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)


def _january(ts: Column) -> Column:
    """A day of January or early February 2024, from the distance to the first order."""
    days = F.datediff(ts.cast("date"), F.lit(dt.date(1995, 1, 1))) % 35
    return F.date_add(F.lit(dt.date(2024, 1, 1)), days)


def _point() -> tuple[Column, Column]:
    lon = (F.col("l_orderkey") % 1200) / 100.0
    lat = ((F.col("l_orderkey") * 7 + F.col("l_partkey")) % 1200) / 100.0
    return F.when(F.col("l_partkey") % 100 != 0, lon), lat


def _shape() -> Column:
    """A box of 3 by 2: every third one an L, every third one with a hole."""
    x = (F.col("s_suppkey") % 10).cast("double")
    y = (F.col("s_suppkey") * 3 % 10).cast("double")

    def ring(*corners: tuple[float, float]) -> Column:
        return F.array(*[F.struct((x + dx).alias("x"), (y + dy).alias("y")) for dx, dy in corners])

    box = ring((0, 0), (3, 0), (3, 2), (0, 2), (0, 0))
    ell = ring((0, 0), (3, 0), (3, 1), (1, 1), (1, 2), (0, 2))
    hole = ring((1, 0.5), (2, 0.5), (2, 1.5), (1, 1.5), (1, 0.5))
    form = F.col("s_suppkey") % 3
    return F.when(form == 1, F.array(ell)).when(form == 2, F.array(box, hole)).otherwise(F.array(box))
