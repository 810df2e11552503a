"""The registered queries: every step of a run over the test tables."""

from __future__ import annotations

import dataclasses
import datetime as dt
import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from elastiq.functions import checks
from elastiq.functions.geo import points_in_zones_on_sphere
from elastiq.operators import (
    curves,
    economics,
    entities,
    groups,
    labels,
    orders,
    reconcile,
    screening,
    sessions,
    tiers,
)
from elastiq.operators.curves import GROUP_LEVEL, VENDOR_LEVEL
from elastiq.params import KEYS, Params
from elastiq.plans import job
from elastiq.plans.standins import PARAMS, StandIns, once
from elastiq.sources.history import append_history, read_run
from elastiq.sources.published import epoch_text, published_ids, read_published, write_published
from elastiq.sources.sinks import CatalogSink, FolderSink
from elastiq.sources.staging import shared_folder, stage
from elastiq.sources.tables import read_input

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ELASTICITY = "tier_elasticity_vendor_cluster_level"
FEE_STEP = "fee_pct_diff_vendor_cluster_level"


def query(build: Callable[[StandIns], DataFrame]) -> Callable[[StandIns], DataFrame]:
    """Register a query under the name of its function."""
    QUERIES[build.__name__] = lambda spark, folder: _comparable(build(StandIns(spark, folder)))
    return build


def _comparable(df: DataFrame) -> DataFrame:
    """Timestamps without zone, decimals as doubles."""

    def plain(f: T.StructField):
        if isinstance(f.dataType, T.TimestampType):
            return F.col(f.name).cast("timestamp_ntz").alias(f.name)
        if isinstance(f.dataType, T.DecimalType):
            return F.col(f.name).cast("double").alias(f.name)
        return F.col(f.name)

    return df.select(*[plain(f) for f in df.schema.fields])


def _rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# configuration


@query
def active_entities(s: StandIns) -> DataFrame:
    per_region = _nations_as_entities(s)
    return entities.active_entities(
        per_region, _customer_orders(s), not_like=("NATION_2%", "NATION_1_"), deny=("NATION_3", "NATION_4")
    )


@query
def entities_lite(s: StandIns) -> DataFrame:
    per_region = _nations_as_entities(s)
    return entities.entities_lite(per_region, _customer_orders(s), not_like=("NATION_2%",), deny=("NATION_3",))


def _nations_as_entities(s: StandIns) -> DataFrame:
    nations = s.table("nation").join(s.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return nations.select(
        F.col("r_name").alias("region"),
        F.upper(F.substring("r_name", 1, 2)).alias("country_iso"),
        F.col("r_name").alias("country_name"),
        F.array(
            F.struct(F.col("n_name").alias("entity_id")),
            F.struct(F.concat("n_name", F.lit("X")).alias("entity_id")),
        ).alias("platforms"),
    )


def _customer_orders(s: StandIns) -> DataFrame:
    """Orders by the nation of the customer; an urgent order counts for a second entity of the nation."""
    customers = s.table("customer").join(s.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    urgent = (F.col("o_orderpriority") == "1-URGENT") & (F.col("n_nationkey") % 2 == 0)
    return (
        s.table("orders")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select(F.concat("n_name", F.when(urgent, "X").otherwise("")).alias("entity_id"))
    )


@once
def _vendors(s: StandIns) -> DataFrame:
    return stage(s.vendors(), "vendors")


@once
def _known(s: StandIns) -> DataFrame:
    """Vendors without one supplier in ten, so that the vendor filters have something to drop."""
    return stage(_vendors(s).filter(~F.col("vendor_code").endswith("7")), "known_vendors")


@once
def _fees(s: StandIns) -> DataFrame:
    return stage(s.group_fees(), "group_fees")


@once
def _active(s: StandIns) -> DataFrame:
    return stage(entities.active_entities(s.entities(), s.orders_mapped()), "active_entities")


@once
def _zones(s: StandIns) -> DataFrame:
    return stage(entities.active_zones(s.countries(), _active(s)), "active_zones")


@once
def _cells(s: StandIns) -> DataFrame:
    return stage(sessions.zone_index(_zones(s), PARAMS.cell_size), "zone_cells")


@query
def active_zones(s: StandIns) -> DataFrame:
    corners = F.flatten("zone_shape")
    return entities.active_zones(s.countries(), _active(s)).select(
        "region",
        *KEYS,
        "city_name",
        "city_id",
        "zone_name",
        "zone_id",
        F.size("zone_shape").cast("bigint").alias("rings"),
        F.size(corners).cast("bigint").alias("corners"),
        F.array_min(corners["x"]).alias("min_x"),
        F.array_max(corners["y"]).alias("max_y"),
    )


@query
def current_setups(s: StandIns) -> DataFrame:
    newest = groups.newest_versions(s.group_config_versions(), _active(s))
    return groups.current_setups(stage(newest, "newest_versions"))


@once
def _setups(s: StandIns) -> DataFrame:
    return stage(current_setups(s), "setups")


@query
def linked_groups(s: StandIns) -> DataFrame:
    return groups.linked_groups(_setups(s), suffix=PARAMS.link_suffix)


@once
def _linked(s: StandIns, p: Params = PARAMS) -> DataFrame:
    setups = _setups(s)
    links = groups.linked_groups(setups, suffix=p.link_suffix, suffix_only=p.suffix_only)
    return groups.with_master_id(setups, links, per_pair_ids=p.per_pair_ids)


@query
def linked_chains(s: StandIns) -> DataFrame:
    """Chains of linked names; groups are renamed so that chains have gaps, groups of one name and letters of both cases."""
    name = F.when(F.col("asa_id") % 2 == 0, "Group").otherwise("GROUP")
    marks = F.expr("repeat('_x', cast(asa_id % 7 AS int))")
    return checks.linked_chains(_setups(s).withColumn("asa_name", F.concat(name, marks)), suffix="_X")


@query
def master_ids(s: StandIns) -> DataFrame:
    return _linked(s)


@query
def group_members(s: StandIns) -> DataFrame:
    return groups.vendors_per_group(_linked(s))


@query
def group_schemes(s: StandIns) -> DataFrame:
    return groups.schemes_per_group(_linked(s))


@query
def fee_tiers(s: StandIns) -> DataFrame:
    schemes = stage(groups.schemes_per_group(_linked(s)), "schemes")
    return tiers.scheme_fee_tiers(s.scheme_config_versions(), schemes)


@query
def group_tiers(s: StandIns) -> DataFrame:
    return tiers.group_fee_tiers(fee_tiers(s))


# sessions


@once
def _located(s: StandIns) -> DataFrame:
    return sessions.sessions_in_zones(
        s.web_sessions(), _zones(s), _cells(s), _known(s), PARAMS.window, cell_size=PARAMS.cell_size
    )


@query
def sessions_in_zones(s: StandIns) -> DataFrame:
    return _located(s)


@once
def _requests(s: StandIns, endpoints: tuple[str, ...] = PARAMS.endpoints) -> DataFrame:
    return sessions.fee_requests(
        s.pricing_requests(), _zones(s), _cells(s), PARAMS.window, endpoints=endpoints, cell_size=PARAMS.cell_size
    )


@query
def fee_requests(s: StandIns) -> DataFrame:
    return _requests(s).drop("vendors")


def _wrapped(lon: Column) -> Column:
    return F.when(lon > 180, lon - 360).otherwise(lon)


@query
def places_on_sphere(s: StandIns) -> DataFrame:
    """Places inside a zone of their entity, both moved over the date line and far north, where great circles matter."""
    corner = lambda p: F.struct(_wrapped(p["x"] + 174).alias("x"), (p["y"] + 55).alias("y"))
    zones = _zones(s).withColumn("zone_shape", F.transform("zone_shape", lambda ring: F.transform(ring, corner)))
    cells = stage(sessions.zone_index(zones, PARAMS.cell_size, sphere=True), "zone_cells_on_sphere")
    seen = s.web_sessions().filter("lon is not null")
    places = seen.select("entity_id", _wrapped(F.col("lon") + 174.00317).alias("lon"), (F.col("lat") + 55.00211).alias("lat"))
    return points_in_zones_on_sphere(places.distinct(), cells, ["entity_id"], math.radians(PARAMS.cell_size))


@query
def fee_offers(s: StandIns) -> DataFrame:
    return sessions.fee_offers(_requests(s), _known(s))


@query
def last_fee(s: StandIns) -> DataFrame:
    return sessions.last_fee(sessions.known_offers(_requests(s), _known(s)))


@query
def located_fees(s: StandIns) -> DataFrame:
    """The last fee of the vendors that located sessions looked at; requests are reduced before they are flattened."""
    events = stage(_located(s), "sessions")
    requests = sessions.fee_requests(
        s.pricing_requests(), _zones(s), _cells(s), PARAMS.window, seen=sessions.sessions_seen(events), cell_size=PARAMS.cell_size
    )
    return sessions.last_fee(sessions.seen_offers(requests, events))


@query
def input_by_name(s: StandIns) -> DataFrame:
    """Requests stored with their nested fields in another order, one more and one fewer, and read back by name."""
    offer = lambda v: F.struct(
        F.struct(
            v["delivery_fee"]["total"].cast("decimal(12,4)").alias("total"),
            F.lit(9.5).alias("surcharge"),
            v["delivery_fee"]["travel_time"].alias("travel_time"),
        ).alias("delivery_fee"),
        v["id"].alias("id"),
        F.struct(v["meta_data"]["vendor_price_scheme_type"], v["meta_data"]["scheme_id"].cast("int").alias("scheme_id")).alias("meta_data"),
    )
    session = F.struct(F.col("customer.session.timestamp"), F.col("customer.session.id"))
    stored = s.pricing_requests().select(
        F.transform("vendors", offer).alias("vendors"),
        F.struct(session.alias("session"), "customer.lat", "customer.lon").alias("customer"),
        F.lit("x").alias("further"),
        "created_at", "created_date", "endpoint", "country_code", "entity_id",
    )
    root = f"{shared_folder(s.spark).rstrip('/')}/elastiq/{s.spark.sparkContext.applicationId}/input-{uuid.uuid4().hex}"
    stored.write.parquet(f"{root}/pricing_requests")
    v = F.col("vendors")[0]
    return read_input(s.spark, root, "pricing_requests").select(
        *KEYS, "endpoint", "created_date", "created_at",
        F.col("customer.user_id").alias("user_id"), F.col("customer.lon").alias("lon"), F.col("customer.session.id").alias("session_id"),
        v["id"].alias("vendor_code"), v["meta_data"]["scheme_id"].alias("scheme_id"),
        v["delivery_fee"]["travel_time"].alias("travel_time"), v["delivery_fee"]["total"].alias("total"),
    )


@query
def sessions_with_fee(s: StandIns) -> DataFrame:
    return sessions.sessions_with_fee(_located(s), last_fee(s))


# orders


@query
def vendor_orders(s: StandIns) -> DataFrame:
    return orders.vendor_orders(s.orders_mapped(), _known(s), PARAMS.window)


@query
def paid_fee(s: StandIns) -> DataFrame:
    priced = orders.with_external_fee(s.orders_mapped(), s.external_fee_orders())
    region = F.concat(F.substring("entity_id", 1, 1), F.lower(F.substring("entity_id", 2, 100)))

    def fee(unknown_is_covered: bool):
        return orders.paid_fee(
            region,
            F.col("external_fee"),
            F.col("is_delivery_fee_covered_by_discount"),
            F.col("is_delivery_fee_covered_by_voucher"),
            F.col("delivery_fee_local"),
            unknown_is_covered=unknown_is_covered,
        )

    return priced.select(
        *KEYS,
        "vendor_id",
        "platform_order_code",
        F.round(fee(True), 4).alias("fee_in_impact"),
        F.round(fee(False), 4).alias("fee_in_economics"),
    )


@query
def group_impact(s: StandIns) -> DataFrame:
    return orders.group_order_impact(
        s.orders_mapped(), s.external_fee_orders(), _active(s), _vendors(s), PARAMS.window
    )


# screening


@once
def _metrics(s: StandIns, p: Params = PARAMS) -> DataFrame:
    per_vendor = orders.vendor_orders(s.orders_mapped(), _vendors(s), p.window)
    return screening.vendor_metrics(_vendors(s), s.events(), per_vendor, tx_unit=p.tx_unit)


@query
def vendor_metrics(s: StandIns) -> DataFrame:
    return _metrics(s)


@query
def percentile_screen(s: StandIns) -> DataFrame:
    return screening.percentile_screen(stage(_metrics(s), "vendor_metrics"))


@query
def percentile_screen_banded(s: StandIns) -> DataFrame:
    """The same ranks with far more partitions than tasks, so that every group is cut."""
    return screening.percentile_screen(stage(_metrics(s), "vendor_metrics"), parts=97)


@once
def _screened(s: StandIns, p: Params = PARAMS) -> dict[str, DataFrame]:
    per_vendor = orders.vendor_orders(s.orders_mapped(), _vendors(s), p.window)
    return job.screen(_vendors(s), s.events(), per_vendor, p)


@query
def screening_funnel(s: StandIns) -> DataFrame:
    return screening.screening_funnel(percentile_screen(s), PARAMS)


@query
def screened_vendors(s: StandIns) -> DataFrame:
    return _screened(s)["screened_vendors"]


# curves


@once
def _marks(s: StandIns) -> tuple[DataFrame, DataFrame]:
    screened = _screened(s)["screened_vendors"]
    return screened, curves.curve_marks(s.events(), screened, PARAMS)


@once
def _vendor_curve(s: StandIns) -> DataFrame:
    screened, marks = _marks(s)
    return curves.vendor_curve(screened, marks, _fees(s), PARAMS)


@once
def _group_curve(s: StandIns) -> DataFrame:
    screened, marks = _marks(s)
    return curves.group_curve(screened, marks, _fees(s), PARAMS)


@query
def vendor_curve(s: StandIns) -> DataFrame:
    return _vendor_curve(s)


@query
def group_curve(s: StandIns) -> DataFrame:
    return _group_curve(s)


@query
def vendor_base(s: StandIns) -> DataFrame:
    return curves.curve_base(stage(_vendor_curve(s), "vendor_curve"), VENDOR_LEVEL, PARAMS)


@query
def group_base(s: StandIns) -> DataFrame:
    return curves.curve_base(stage(_group_curve(s), "group_curve"), GROUP_LEVEL, PARAMS)


def _changed(curve: DataFrame, level: curves.Level) -> DataFrame:
    curve = stage(curve, "curve")
    return curves.curve_change(curve, curves.curve_base(curve, level, PARAMS), level, PARAMS)


@query
def vendor_change(s: StandIns) -> DataFrame:
    return _changed(_vendor_curve(s), VENDOR_LEVEL)


@query
def group_change(s: StandIns) -> DataFrame:
    return _changed(_group_curve(s), GROUP_LEVEL)


@query
def vendor_slope(s: StandIns) -> DataFrame:
    changed = stage(vendor_change(s), "vendor_change")
    return _rounded(curves.with_slope(changed, VENDOR_LEVEL, PARAMS), 8, VENDOR_LEVEL.slope)


@query
def group_slope(s: StandIns) -> DataFrame:
    changed = stage(group_change(s), "group_change")
    return _rounded(curves.with_slope(changed, GROUP_LEVEL, PARAMS), 8, GROUP_LEVEL.slope)


# labels


@once
def _labelled(s: StandIns, p: Params = PARAMS) -> dict[str, DataFrame]:
    out = _screened(s, p)
    return out | job.label(s.events(), out["screened_vendors"], _fees(s), p)


_SLOPES = (VENDOR_LEVEL.slope, GROUP_LEVEL.slope)
_TESTS = ("is_lb_test_passed", "num_yes", "is_lb_test_passed_lm")


@query
def compare_curves(s: StandIns) -> DataFrame:
    return _rounded(_labelled(s)["compared_curves"], 8, *_SLOPES).drop(*_TESTS)


@query
def pct_test(s: StandIns) -> DataFrame:
    compared = _labelled(s)["compared_curves"]
    return compared.select(
        *KEYS, "master_asa_id", "vendor_code", "df_total", VENDOR_LEVEL.change, GROUP_LEVEL.change, *_TESTS[:2]
    )


@query
def slope_test(s: StandIns) -> DataFrame:
    compared = _labelled(s)["compared_curves"]
    return _rounded(compared, 8, *_SLOPES).select(
        *KEYS, "master_asa_id", "vendor_code", "df_total", *_SLOPES, "is_lb_test_passed_lm"
    )


@query
def vendor_labels(s: StandIns) -> DataFrame:
    return _rounded(_labelled(s)["vendor_labels"], 8, *_SLOPES)


def _final(s: StandIns, p: Params = PARAMS) -> DataFrame:
    out = _labelled(s, p)
    return labels.final_vendor_list(out["all_metrics"], out["vendor_labels"], s.vendor_directory(), p)


@query
def final_list(s: StandIns) -> DataFrame:
    return _rounded(_final(s), 8, *_SLOPES)


@query
def history(s: StandIns) -> DataFrame:
    """Two runs appended to a history, the first one twice, the second one read back on its own as well."""
    rows = stage(_metrics(s).select(*KEYS, "asa_id", "vendor_code", "num_orders", "cvr3"), "history_rows")
    path = f"{shared_folder(s.spark).rstrip('/')}/elastiq/history-{uuid.uuid4().hex}"
    first = dt.datetime(2024, 1, 15, 17, 49, 40, tzinfo=dt.timezone.utc)
    second = dt.datetime(2024, 2, 15, 17, 49, 40, tzinfo=dt.timezone.utc)
    append_history(rows, path, first)
    append_history(rows.filter("cvr3 >= 0.3"), path, second)
    append_history(rows, path, first)  # a retry
    everything = s.spark.read.parquet(path).drop("run").withColumn("part", F.lit("all"))
    last = read_run(s.spark, path, second).withColumn("part", F.lit("last"))
    return everything.unionByName(last).withColumn(
        "update_timestamp", epoch_text(F.unix_seconds("update_timestamp"))
    )


@query
def replaced_tables(s: StandIns) -> DataFrame:
    """A table of a catalog and one in a folder, each written twice, the second time with other columns and rows, and read."""
    rows = stage(_metrics(s).select(*KEYS, "asa_id", "vendor_code", "num_orders", "cvr3"), "replaced_rows")
    folder, schema = f"{shared_folder(s.spark).rstrip('/')}/elastiq", f"elastiq_{uuid.uuid4().hex}"
    s.spark.sql(f"CREATE SCHEMA {schema} LOCATION '{folder}/{schema}'")
    out = []
    for kind, target in (("catalog", CatalogSink(s.spark, schema)), ("folder", FolderSink(s.spark, f"{folder}/{schema}-folder"))):
        target.replace(rows.drop("cvr3"), "metrics")
        target.replace(rows, "metrics")
        target.replace(rows.filter("num_orders > 0"), "metrics")
        out.append(target.read("metrics").withColumn("sink", F.lit(kind)))
    return out[0].unionByName(out[1])


# economics


@query
def vendor_fee_grid(s: StandIns) -> DataFrame:
    return economics.vendor_fee_grid(_fees(s), _vendors(s))


@once
def _order_rows(s: StandIns) -> DataFrame:
    lite = stage(entities.entities_lite(s.entities(), s.orders_mapped()), "entities_lite")
    return economics.order_economics(
        s.orders_mapped(), s.order_values(), s.external_fee_orders(), lite, PARAMS.window
    )


@query
def order_economics(s: StandIns) -> DataFrame:
    money = [
        "commission_local",
        "sof_local_cdwh",
        "sof_local",
        "delivery_costs_local",
        "actual_df_paid_by_customer",
    ]
    return _rounded(_order_rows(s), 4, *money)


@query
def small_order_fee(s: StandIns) -> DataFrame:
    return _rounded(
        _order_rows(s)
        .groupBy(*KEYS, "vendor_id")
        .agg(
            F.sum("sof_local").alias("sof_local"),
            F.sum("sof_local_cdwh").alias("sof_local_cdwh"),
            F.count_if(F.col("sof_local") == 0).alias("orders_without_fee"),
        ),
        2,
        "sof_local",
        "sof_local_cdwh",
    )


def _slope_labels(s: StandIns) -> DataFrame:
    """A label for most vendors, so that some have none."""
    places = s.places().filter("s_acctbal > 500")
    return places.select(
        *KEYS, "vendor_code", F.when(F.col("s_acctbal") > 4000, "Y").otherwise("N").alias("is_lb_lm")
    )


@once
def _performance(s: StandIns) -> DataFrame:
    return economics.vendor_fee_performance(_fees(s), _vendors(s), _order_rows(s), _slope_labels(s))


@query
def vendor_fee_perf(s: StandIns) -> DataFrame:
    totals = [f"{name}_{money}" for name in economics.AMOUNTS for money in ("local", "eur")]
    return _rounded(_performance(s), 2, *totals)


@query
def cluster_rollup(s: StandIns) -> DataFrame:
    return _rounded(economics.cluster_fee_rollup(_performance(s)), 4, "min_tt_fee_master_asa_level")


@once
def _rollup(s: StandIns) -> DataFrame:
    return stage(cluster_rollup(s), "cluster_rollup")


@query
def cluster_totals(s: StandIns) -> DataFrame:
    out = economics.cluster_totals(_rollup(s))
    money = [c for c in out.columns if c.endswith(("_local_vendor_cluster_level", "_eur_vendor_cluster_level"))]
    return _rounded(out, 2, *money)


@query
def tier_ranks(s: StandIns) -> DataFrame:
    ranked = economics.tier_ranks(economics.cluster_totals(_rollup(s)))
    return ranked.select(*economics.CLUSTER, "tier_rank_master_asa", "num_tiers_master_asa")


@query
def tier_elasticity(s: StandIns) -> DataFrame:
    ranked = economics.tier_ranks(economics.cluster_totals(_rollup(s)))
    out = economics.tier_elasticity(ranked).select(
        *economics.CLUSTER, "tier_rank_master_asa", economics.ORDERS, ELASTICITY, FEE_STEP
    )
    return _rounded(out, 6, ELASTICITY, FEE_STEP)


# publication check


def _published_files(s: StandIns) -> DataFrame:
    """Published files of at most 1000 ids: documents by language and source."""
    chunk = F.floor(F.col("doc_id") / 1000)
    chunk_name = F.col("chunk").cast("string")
    return (
        s.table("documents")
        .groupBy("lang", "source", chunk.alias("chunk"))
        .agg(F.collect_list(F.col("doc_id").cast("string")).alias("vendor_ids"))
        .select(
            F.concat("lang", F.lit("_xx-"), "source", F.lit("-v1-"), chunk_name, F.lit(".gzip")).alias("file_name"),
            "vendor_ids",
            (F.col("chunk") * 3600 + 1668534580).cast("string").alias("update_timestamp"),
        )
    )


def _stored(s: StandIns) -> DataFrame:
    """Labelled documents under the language and source their id stands for, half of them in one region."""
    docs = s.table("documents").select("doc_id", "lang", "source")
    moved = F.when(F.col("toxic") == 1, "src0").otherwise(F.col("source"))
    known = s.table("labels").join(docs, "doc_id")
    ids = F.when(F.col("quality") == 1, F.col("doc_id")).otherwise(F.col("doc_id") + 1_000_000_000)
    return known.select(
        F.when(F.col("quality") == 1, "Americas").otherwise("Europe").alias("region"),
        F.col("lang").alias("country_code"),
        ids.cast("string").alias("vendor_id"),
        moved.alias("cluster"),
    )


@query
def published(s: StandIns) -> DataFrame:
    """Written as one gzip JSON document per file to the shared folder and read from there."""
    path = f"{shared_folder(s.spark).rstrip('/')}/elastiq/{s.spark.sparkContext.applicationId}/published-{uuid.uuid4().hex}"
    write_published(_published_files(s), path)
    return published_ids(read_published(s.spark, path), with_cluster=True)


def _compare(s: StandIns, with_cluster: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    left = published_ids(_published_files(s), with_cluster=with_cluster)
    right = _stored(s)
    return left, right, reconcile.reconcile(left, right, table_id="vendor_id", with_cluster=with_cluster)


@query
def reconcile_by_country(s: StandIns) -> DataFrame:
    return _compare(s, with_cluster=False)[2]


@query
def reconcile_by_cluster(s: StandIns) -> DataFrame:
    return _compare(s, with_cluster=True)[2]


@query
def recon_counts(s: StandIns) -> DataFrame:
    left, right, both = _compare(s, with_cluster=False)
    return reconcile.reconcile_counts(left, right, both, table_id="vendor_id")


@query
def recon_counts_by_cluster(s: StandIns) -> DataFrame:
    left, right, both = _compare(s, with_cluster=True)
    return reconcile.reconcile_counts(
        left, right, both, table_id="vendor_id", with_cluster=True, regions=("Americas",)
    )


@query
def recon_nulls(s: StandIns) -> DataFrame:
    return reconcile.reconcile_nulls(_compare(s, with_cluster=False)[2], table_id="vendor_id")


# options


@query
def variant_group_key(s: StandIns) -> DataFrame:
    """Groups kept apart: screening and curves per group instead of per pooled group."""
    return _rounded(_final(s, dataclasses.replace(PARAMS, group_key="asa_id")), 8, *_SLOPES)


@query
def variant_tx_unit(s: StandIns) -> DataFrame:
    """Transactions counted by event time instead of by session."""
    return _rounded(_final(s, dataclasses.replace(PARAMS, tx_unit="event_time")), 8, *_SLOPES)


@query
def variant_without_slope(s: StandIns) -> DataFrame:
    """Labels by percentage change alone, without tier ranks."""
    return _final(s, dataclasses.replace(PARAMS, slope_test=False, tier_ranks=False))


@query
def variant_without_tier_ranks(s: StandIns) -> DataFrame:
    """Labels by slope without the tier counts in the result."""
    return _rounded(_final(s, dataclasses.replace(PARAMS, tier_ranks=False)), 8, *_SLOPES)


@query
def variant_fee_field(s: StandIns) -> DataFrame:
    """The total fee as the price seen, from requests of both kinds."""
    requests = _requests(s, ("singleFee", "multipleFee"))
    return sessions.last_fee(sessions.known_offers(requests, _vendors(s), fee_field="total"))


@query
def variant_linking(s: StandIns) -> DataFrame:
    """One id per linked name, and only the suffix stripped from it."""
    setups = _linked(s, dataclasses.replace(PARAMS, per_pair_ids=True, suffix_only=True))
    return groups.vendors_per_group(setups)


# the whole run


@query
def full_run_labels(s: StandIns) -> DataFrame:
    return _rounded(job.run_labels(s, PARAMS)["final_list"], 8, *_SLOPES)


@query
def full_run_elasticity(s: StandIns) -> DataFrame:
    out = job.run(s, PARAMS)["tier_elasticity"].select(
        *economics.CLUSTER, "tier_rank_master_asa", economics.ORDERS, ELASTICITY, FEE_STEP
    )
    return _rounded(out, 6, ELASTICITY, FEE_STEP)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Which vendors keep their conversion better than their group as the fee rises?"""
    return QUERIES["final_list"](spark, folder)


