"""Conversion metrics per vendor and the percentile screen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from elastiq.functions.numbers import ratio
from elastiq.functions.ranks import percent_ranks
from elastiq.functions.skew import dealt, salted_join
from elastiq.params import KEYS, TRANSACTION, VISIT, Params

VENDOR = [*KEYS, "vendor_code"]
# a distinct session (``sid``) or, if ``of_time``, a distinct event time (``at``)
MARK = ["of_time", "sid", "at"]


def session_marks(sessions: DataFrame, by: Sequence[str], *, tx_unit: str = "session") -> DataFrame:
    """Distinct sessions and distinct event times per ``by``, flagged as visit and as transaction.

    All distinct counts of a curve are sums over these rows, so they need one shuffle of the events, on a
    key that includes the session or time: a hot vendor is spread over all tasks. Most events have a key of
    their own, so they are not aggregated before it.
    """
    visit = F.col("event_action") == VISIT
    tx = F.col("event_action") == TRANSACTION
    timed = visit | tx if tx_unit == "event_time" else visit
    of_time = F.col("of_time")
    marks = (
        sessions.select(
            *by,
            visit.alias("visit"),
            tx.alias("tx"),
            F.when(visit | tx, F.col("events_ga_session_id")).alias("sid"),
            F.when(timed, F.col("event_time")).alias("at"),
            F.explode(F.array(F.lit(False), F.lit(True))).alias("of_time"),
        )
        .withColumns({"sid": F.when(~of_time, F.col("sid")), "at": F.when(of_time, F.col("at"))})
        .filter(F.col("sid").isNotNull() | F.col("at").isNotNull())
    )
    return distinct_marks(marks, by)


def distinct_marks(marks: DataFrame, by: Sequence[str]) -> DataFrame:
    keys = [*by, *MARK]
    return dealt(marks, keys).groupBy(*keys).agg(F.max("visit").alias("visit"), F.max("tx").alias("tx"))


def _count(of_time: bool, flag: str) -> Column:
    return F.count_if((F.col("of_time") == of_time) & F.col(flag))


def mark_counts(marks: DataFrame, by: Sequence[str], cvr: str, *, tx_unit: str = "session") -> DataFrame:
    """Visits, impressions, transactions and conversion rate from session marks."""
    counted = marks.groupBy(*by).agg(
        _count(False, "visit").alias("num_unique_vendor_visits"),
        _count(True, "visit").alias("num_total_vendor_impressions"),
        _count(tx_unit == "event_time", "tx").alias("num_transactions"),
    )
    return counted.withColumn(cvr, conversion())


def conversion() -> Column:
    rate = ratio(F.col("num_transactions"), F.col("num_unique_vendor_visits"), 5)
    return F.coalesce(rate, F.lit(0.0))


def vendor_metrics(
    vendors: DataFrame, sessions: DataFrame, orders: DataFrame, *, tx_unit: str = "session"
) -> DataFrame:
    """Orders, visits, impressions, transactions and conversion of every vendor; zeros where it has none."""
    counts = mark_counts(session_marks(sessions, VENDOR, tx_unit=tx_unit), VENDOR, "cvr3", tx_unit=tx_unit)
    columns = [
        "num_orders",
        "num_unique_vendor_visits",
        "num_total_vendor_impressions",
        "num_transactions",
        "cvr3",
    ]
    joined = vendors.join(counts, VENDOR, "left").join(orders.select(*VENDOR, "num_orders"), VENDOR, "left")
    zero = {c: F.lit(0.0) if c == "cvr3" else F.lit(0).cast("bigint") for c in columns}
    return joined.select(*vendors.columns, *[F.coalesce(c, zero[c]).alias(c) for c in columns])


def percentile_screen(metrics: DataFrame, *, group_key: str = "master_asa_id", parts: int | None = None) -> DataFrame:
    """Percentile rank of each vendor within its group by orders, visits and conversion."""
    ranks = {
        "orders_pct_rank": "num_orders",
        "unique_visits_pct_rank": "num_unique_vendor_visits",
        "cvr3_pct_rank": "cvr3",
    }
    return percent_ranks(metrics, [*KEYS, group_key], ranks, parts=parts)


def passed(p: Params) -> tuple[Column, Column, Column]:
    """The three nested screening tests: visits; visits and orders; all."""
    visits = F.col("unique_visits_pct_rank") >= p.visits_thr
    orders = visits & (F.col("orders_pct_rank") >= p.orders_thr)
    return visits, orders, orders & (F.col("cvr3_pct_rank") >= p.cvr_thr)


STAGES = ("visits_filter", "visits_and_orders_filters", "all_initial_filters")


def screening_funnel(ranked: DataFrame, p: Params) -> DataFrame:
    """Orders and vendors left in each group after every screening test, as counts and shares.

    Vendors are reduced to one row per group first, which makes distinct vendor counts plain sums; group
    totals then roll up to the entity. Only the small totals table is joined back.
    """
    tests = dict(zip(STAGES, passed(p)))
    asa = [*KEYS, "asa_id"]
    per_vendor = ranked.groupBy(*asa, "vendor_code").agg(
        F.sum("num_orders").alias("_orders"),
        *[F.sum(F.when(t, F.col("num_orders"))).alias(f"_orders_{s}") for s, t in tests.items()],
        *[F.max(F.when(t, 1).otherwise(0)).alias(f"_vendor_{s}") for s, t in tests.items()],
    )
    groups = per_vendor.groupBy(*asa).agg(
        F.sum("_orders").alias("asa_orders"),
        *[F.sum(f"_orders_{s}").alias(f"asa_orders_after_{s}") for s in STAGES],
        *[F.sum(f"_vendor_{s}").alias(f"vendor_count_remaining_after_{s}") for s in STAGES],
    )
    entities = groups.groupBy(*KEYS).agg(F.sum("asa_orders").alias("entity_orders"))
    totals = groups.join(entities, list(KEYS))
    joined = salted_join(ranked, totals, asa, "left", ["vendor_code"], null_safe=True)
    entity, caught = F.col("entity_orders"), F.col("vendor_count_caught_by_asa")
    left = [f"vendor_count_remaining_after_{s}" for s in STAGES]
    return joined.select(
        *ranked.columns,
        "entity_orders",
        "asa_orders",
        ratio(F.col("asa_orders"), entity, 4).alias("asa_order_share_of_entity"),
        *[f"asa_orders_after_{s}" for s in STAGES],
        *left,
        *[
            ratio(F.col(f"asa_orders_after_{s}"), entity, 4).alias(f"asa_order_share_after_{s}")
            for s in STAGES
        ],
        *[ratio(F.col(c), caught, 4).alias(f"perc_vendors_remaining_after_{s}") for c, s in zip(left, STAGES)],
    )


def screened_vendors(funnel: DataFrame, p: Params) -> DataFrame:
    """Vendors that pass all three tests."""
    return funnel.filter(passed(p)[2]).drop("is_asa_clustered", "asa_orders")
