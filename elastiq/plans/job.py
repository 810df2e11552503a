"""The monthly run: from the input tables to labels, tier elasticity and the result history.

    spark-submit --conf spark.checkpoint.dir=<shared folder> elastiq/plans/job.py \\
        --input <folder or catalog:schema> --output <folder or catalog:schema> --as-of 2024-02-15

A run that fails is started again with the same command: stages that were completed are read, the rest is built.
Results are published together at the end, so until then readers see those of the run before.
"""

from __future__ import annotations

import argparse
import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from elastiq.functions.checks import linked_chains, repeated_keys
from elastiq.functions.skew import split_hot_keys
from elastiq.operators import curves, economics, entities, groups, labels, orders, screening, sessions, tiers
from elastiq.operators.curves import GROUP_LEVEL, VENDOR_LEVEL
from elastiq.params import Params
from elastiq.sources.manifest import Manifest, Recorded, run_digest
from elastiq.sources.sinks import sink
from elastiq.sources.staging import stage
from elastiq.sources.tables import read_input

Source = Callable[[str], DataFrame]
Stage = Callable[[DataFrame, str], DataFrame]

INPUTS = (
    "entities", "countries", "group_config_versions", "scheme_config_versions", "web_sessions", "pricing_requests", "orders_mapped",
    "external_fee_orders", "order_values", "vendor_directory",
)
# Stages that no one but the run itself reads. All others are results, and staged under the name of the result.
INTERNAL = ("ordered_entities", "newest_versions", "setups_plain", "vendor_metrics", "curve_marks", "vendor_points", "group_points", "cluster_rollup")


def configure(source: Source, p: Params, keep: Stage = stage) -> dict[str, DataFrame]:
    """Entities, zones, vendor groups and fee tiers in force. All of them are read several times."""
    out: dict[str, DataFrame] = {}
    # The ids that have orders are the one thing taken from the full order history; it is read once.
    ordered = keep(source("orders_mapped").select("entity_id").distinct(), "ordered_entities")
    split_hot_keys(ordered.sparkSession)
    out["entities_lite"] = keep(entities.entities_lite(source("entities"), ordered), "entities_lite")
    out["active_entities"] = keep(entities.active_entities(source("entities"), ordered), "active_entities")
    active = out["active_entities"]
    out["active_zones"] = keep(entities.active_zones(source("countries"), active), "active_zones")
    out["zone_cells"] = keep(sessions.zone_index(out["active_zones"], p.cell_size, sphere=p.sphere), "zone_cells")
    newest = keep(groups.newest_versions(source("group_config_versions"), active), "newest_versions")
    setups = keep(groups.current_setups(newest), "setups_plain")
    out["linked_groups"] = groups.linked_groups(setups, suffix=p.link_suffix, suffix_only=p.suffix_only)
    out["linked_chains"] = linked_chains(setups, suffix=p.link_suffix)
    linked = groups.with_master_id(setups, out["linked_groups"], per_pair_ids=p.per_pair_ids)
    out["setups"] = keep(linked, "setups")
    out["vendors"] = keep(groups.vendors_per_group(out["setups"]), "vendors")
    out["schemes"] = keep(groups.schemes_per_group(out["setups"]), "schemes")
    scheme_tiers = tiers.scheme_fee_tiers(source("scheme_config_versions"), out["schemes"])
    out["scheme_tiers"] = keep(scheme_tiers, "scheme_tiers")
    out["group_tiers"] = keep(tiers.group_fee_tiers(out["scheme_tiers"]), "group_tiers")
    return out


def screen(
    vendors: DataFrame, events: DataFrame, vendor_orders: DataFrame, p: Params, keep: Stage = stage
) -> dict[str, DataFrame]:
    """Vendor metrics, their percentile ranks and the screened vendors."""
    metrics = keep(
        screening.vendor_metrics(vendors, events, vendor_orders, tx_unit=p.tx_unit), "vendor_metrics"
    )
    ranked = screening.percentile_screen(metrics, group_key=p.group_key)
    funnel = keep(screening.screening_funnel(ranked, p), "all_metrics")
    return {"all_metrics": funnel, "screened_vendors": screening.screened_vendors(funnel, p)}


def label(
    priced: DataFrame,
    screened: DataFrame,
    group_tiers: DataFrame,
    p: Params,
    keep: Stage = stage,
) -> dict[str, DataFrame]:
    """Conversion curves of vendors and groups, their comparison, and one label row per vendor."""
    marks = keep(curves.curve_marks(priced, screened, p), "curve_marks")
    out: dict[str, DataFrame] = {}
    sides = {"vendor": (VENDOR_LEVEL, curves.vendor_curve), "group": (GROUP_LEVEL, curves.group_curve)}
    for side, (level, build) in sides.items():
        curve = keep(build(screened, marks, group_tiers, p), f"{side}_points")
        base = curves.curve_base(curve, level, p)
        changed = curves.curve_change(curve, base, level, p)
        if p.slope_test:
            changed = curves.with_slope(changed, level, p)
        out[f"{side}_base"] = base
        out[f"{side}_curve"] = changed
    compared = labels.compare_curves(out["vendor_curve"], out["group_base"], out["group_curve"], p)
    tested = labels.pct_test(compared, p)
    if p.slope_test:
        tested = labels.slope_test(tested)
    out["compared_curves"] = tested
    out["repeated_group_keys"] = repeated_keys(out["group_base"], GROUP_LEVEL.ids(p))
    out["vendor_labels"] = labels.vendor_labels(tested, p)
    return out


def performance(
    group_tiers: DataFrame,
    vendors: DataFrame,
    order_rows: DataFrame,
    final_list: DataFrame,
    keep: Stage = stage,
) -> dict[str, DataFrame]:
    """Performance per vendor and fee, and the elasticity between the fee tiers of a group."""
    fees = economics.vendor_fee_performance(group_tiers, vendors, order_rows, final_list)
    per_vendor = keep(fees, "vendor_fee_performance")
    rollup = keep(economics.cluster_fee_rollup(per_vendor), "cluster_rollup")
    ranked = economics.tier_ranks(economics.cluster_totals(rollup))
    return {"vendor_fee_performance": per_vendor, "tier_elasticity": economics.tier_elasticity(ranked)}


def run_labels(source: Source, p: Params, keep: Stage = stage, run_ts: dt.datetime | None = None) -> dict[str, DataFrame]:
    """All result tables up to the final list, which carries the stamp of the run."""
    out = configure(source, p, keep)
    vendors, zones, cells = out["vendors"], out["active_zones"], out["zone_cells"]
    located = sessions.sessions_in_zones(
        source("web_sessions"), zones, cells, vendors, p.window, cell_size=p.cell_size, sphere=p.sphere
    )
    out["sessions"] = events = keep(located, "sessions")
    out["vendor_orders"] = per_vendor = orders.vendor_orders(source("orders_mapped"), vendors, p.window)
    out["group_order_impact"] = orders.group_order_impact(
        source("orders_mapped"), source("external_fee_orders"), out["active_entities"], vendors, p.window
    )
    out |= screen(vendors, events, per_vendor, p, keep)

    requests = sessions.fee_requests(
        source("pricing_requests"), zones, cells, p.window, seen=None if p.all_fees else sessions.sessions_seen(events),
        endpoints=p.endpoints, cell_size=p.cell_size, sphere=p.sphere,
    )
    if p.all_fees:
        offers = sessions.known_offers(requests, vendors, fee_field=p.fee_field)
    else:
        offers = sessions.seen_offers(requests, events, fee_field=p.fee_field)
    out["last_fees"] = fees = sessions.last_fee(offers)
    out["priced_sessions"] = priced = sessions.sessions_with_fee(events, fees)
    out |= label(priced, out["screened_vendors"], out["group_tiers"], p, keep)

    final = labels.final_vendor_list(out["all_metrics"], out["vendor_labels"], source("vendor_directory"), p)
    out["final_list"] = keep(final.withColumn("update_timestamp", F.lit(run_ts or stamp_of(p))), "final_list")
    return out


def stamp_of(p: Params) -> dt.datetime:
    """The stamp of a run that is given none: midnight of its day."""
    return dt.datetime.combine(p.as_of, dt.time(), dt.timezone.utc)


def run(source: Source, p: Params, keep: Stage = stage, run_ts: dt.datetime | None = None) -> dict[str, DataFrame]:
    """All result tables of a run by name: the labels and, with slopes, the economics."""
    out = run_labels(source, p, keep, run_ts)
    if p.slope_test:
        order_rows = economics.order_economics(
            source("orders_mapped"), source("order_values"), source("external_fee_orders"), out["entities_lite"], p.window
        )
        out |= performance(out["group_tiers"], out["vendors"], order_rows, out["final_list"], keep)
    return out


def run_and_publish(source: Source, p: Params, output: str, stamp: dt.datetime, around: Callable[[Stage], Stage] = lambda keep: keep) -> None:
    """Build all results, taking up what an earlier attempt completed, then publish them together.

    ``around`` may wrap the function that keeps a stage, to watch a run.
    """
    source = Recorded(source)
    inputs = [(name, source(name)) for name in INPUTS]
    spark = inputs[0][1].sparkSession
    target = sink(spark, output)
    manifest = Manifest(spark, run_digest(inputs, (p, stamp, output)), lambda name: None if name in INTERNAL else target.place(name))
    keep = around(manifest)
    results = run(source, p, keep, stamp)
    for name, df in results.items():
        if manifest.find(name) is None:
            keep(df, name)
    for name in results:
        target.publish(name, manifest.path(name))
    target.append_run(target.read("final_list"), "history", stamp)
    manifest.clear()


def arguments() -> argparse.ArgumentParser:
    """One option per parameter."""
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawTextHelpFormatter)
    parser.add_argument("--input", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--as-of", required=True, type=dt.date.fromisoformat)
    parser.add_argument("--visits-thr", type=float, default=Params.visits_thr)
    parser.add_argument("--orders-thr", type=float, default=Params.orders_thr)
    parser.add_argument("--cvr-thr", type=float, default=Params.cvr_thr)
    parser.add_argument("--group-key", choices=("master_asa_id", "asa_id"), default=Params.group_key)
    parser.add_argument("--tx-unit", choices=("session", "event_time"), default=Params.tx_unit)
    parser.add_argument("--fee-field", choices=("travel_time", "total"), default=Params.fee_field)
    parser.add_argument("--no-slope-test", dest="slope_test", action="store_false")
    parser.add_argument("--no-tier-ranks", dest="tier_ranks", action="store_false")
    parser.add_argument("--link-suffix", default=Params.link_suffix)
    parser.add_argument("--per-pair-ids", action="store_true", help="one master id per linked name")
    parser.add_argument("--suffix-only", action="store_true", help="strip the suffix, not any of its characters")
    parser.add_argument("--all-fees", action="store_true", help="last fees of all requests, not only of located sessions")
    parser.add_argument("--endpoints", nargs="+", default=Params.endpoints, help="request kinds, such as multipleFee")
    parser.add_argument("--cell-size", type=float, default=Params.cell_size, help="degrees of the smallest cells of the zone index")
    parser.add_argument("--sphere", action="store_true", help="sides of zones are great circles")
    parser.add_argument("--run-ts", type=dt.datetime.fromisoformat, help="stamp of the history rows")
    return parser


def main(argv: list[str] | None = None) -> None:
    args = vars(arguments().parse_args(argv))
    root, output, run_ts = args.pop("input"), args.pop("output"), args.pop("run_ts")
    p = Params(**args | {"endpoints": tuple(args["endpoints"])})
    stamp = run_ts or stamp_of(p)

    spark = SparkSession.builder.appName("elastiq").getOrCreate()
    run_and_publish(lambda name: read_input(spark, root, name), p, output, stamp)


if __name__ == "__main__":
    main()
