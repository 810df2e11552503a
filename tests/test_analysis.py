"""Screening, curves and labels."""

import dataclasses
import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import tuples
from elastiq.operators import curves, labels, screening
from elastiq.operators.curves import GROUP_LEVEL, VENDOR_LEVEL

VENDOR_SCHEMA = (
    "region string, entity_id string, country_code string, asa_id long, master_asa_id long, asa_name string,"
    " asa_common_name string, is_asa_clustered boolean, vendor_count_caught_by_asa long, vendor_code string"
)
EVENT_SCHEMA = (
    "entity_id string, country_code string, vendor_code string, events_ga_session_id string, event_action string,"
    " event_time timestamp, df_total double"
)


def _vendors(spark, *rows):
    """Rows of (group id, master id, vendors in the group, vendor)."""
    return spark.createDataFrame([("Asia", "E", "sg", a, m, f"g{a}", f"g{m}", a != m, n, v) for a, m, n, v in rows], VENDOR_SCHEMA)


class Events:
    """Visits and transactions by vendor and fee, each in a session and at a time of its own."""

    def __init__(self):
        self.rows = []

    def add(self, vendor, visits, transactions=0, fee=None):
        for i in range(visits):
            self._one(vendor, f"{vendor}-{fee}-{i}", "shop_details.loaded", fee)
        for i in range(transactions):
            self._one(vendor, f"{vendor}-{fee}-{i}", "transaction", fee)
        return self

    def _one(self, vendor, session, action, fee):
        at = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=len(self.rows))
        self.rows.append(("E", "sg", vendor, session, action, at, fee))

    def frame(self, spark):
        return spark.createDataFrame(self.rows, EVENT_SCHEMA)


def _orders(spark, **counts):
    return spark.createDataFrame([("E", "sg", v, n) for v, n in counts.items()], "entity_id string, country_code string, vendor_code string, num_orders long")


def test_vendor_metrics(spark):
    events = Events().add("a", 4, 1)
    events._one("a", "a-None-0", "shop_details.loaded", None)
    events._one("a", "a-None-0", "transaction", None)
    events._one("a", None, "checkout.loaded", None)
    events.add("only sold", 0, 2)
    vendors = _vendors(spark, (1, 1, 3, "a"), (1, 1, 3, "none"), (2, 2, 1, "a"), (1, 1, 3, "only sold"))
    out = screening.vendor_metrics(vendors, events.frame(spark), _orders(spark, a=7))
    columns = ["asa_id", "vendor_code", "num_orders", "num_unique_vendor_visits", "num_total_vendor_impressions", "num_transactions", "cvr3"]
    assert tuples(out, *columns) == [
        (1, "a", 7, 4, 5, 1, 0.25), (1, "none", 0, 0, 0, 0, 0.0), (1, "only sold", 0, 0, 0, 2, 0.0), (2, "a", 7, 4, 5, 1, 0.25),
    ]
    by_time = screening.vendor_metrics(vendors, events.frame(spark), _orders(spark, a=7), tx_unit="event_time")
    assert tuples(by_time.filter("asa_id = 2"), "num_transactions", "num_total_vendor_impressions", "cvr3") == [(2, 5, 0.5)]


@pytest.fixture
def ranked(spark):
    vendors = _vendors(spark, *[(1, 1, 5, f"v{i}") for i in range(1, 6)], (2, 2, 1, "w"))
    events = Events()
    for i in range(1, 6):
        events.add(f"v{i}", 10 * i, 2 * i * i)
    metrics = screening.vendor_metrics(vendors, events.frame(spark), _orders(spark, v1=1, v2=2, v3=3, v4=4, v5=5))
    return screening.percentile_screen(metrics)


def test_percentile_screen(ranked):
    assert tuples(ranked.filter("asa_id = 1"), "vendor_code", "orders_pct_rank", "unique_visits_pct_rank", "cvr3_pct_rank") == [
        (f"v{i + 1}", i / 4, i / 4, i / 4) for i in range(5)
    ]
    assert tuples(ranked.filter("asa_id = 2"), "vendor_code", "orders_pct_rank") == [("w", 0.0)]


def test_screening_funnel(ranked, params):
    p = dataclasses.replace(params, visits_thr=0.25, orders_thr=0.5)
    funnel = screening.screening_funnel(ranked, p)
    row = funnel.filter("vendor_code = 'v1'").first().asDict()
    assert (row["entity_orders"], row["asa_orders"], row["asa_order_share_of_entity"]) == (15, 15, 1.0)
    names = screening.STAGES
    assert [row[f"asa_orders_after_{s}"] for s in names] == [14, 12, 9]
    assert [row[f"vendor_count_remaining_after_{s}"] for s in names] == [4, 3, 2]
    assert [row[f"asa_order_share_after_{s}"] for s in names] == [0.9333, 0.8, 0.6]
    assert [row[f"perc_vendors_remaining_after_{s}"] for s in names] == [0.8, 0.6, 0.4]
    assert tuples(screening.screened_vendors(funnel, p), "vendor_code") == [("v4",), ("v5",)]
    # a group in which nobody passes has no orders left, which is not the same as 0 orders
    other = funnel.filter("vendor_code = 'w'").first()
    assert other["asa_orders_after_visits_filter"] is None and other["vendor_count_remaining_after_visits_filter"] == 0


def _curves(spark, p, vendors, events, fees):
    """The compared curves of vendors that all passed the screen."""
    tiers = spark.createDataFrame([("E", "sg", m, m, f) for m, f in fees], "entity_id string, country_code string, asa_id long, master_asa_id long, fee double")
    marks = curves.curve_marks(events.frame(spark), vendors, p)
    out = {}
    for side, level, build in (("v", VENDOR_LEVEL, curves.vendor_curve), ("g", GROUP_LEVEL, curves.group_curve)):
        curve = build(vendors, marks, tiers, p)
        out[f"{side}curve"] = curve
        out[f"{side}base"] = curves.curve_base(curve, level, p)
        changed = curves.curve_change(curve, out[f"{side}base"], level, p)
        out[side] = curves.with_slope(changed, level, p) if p.slope_test else changed
    out["compared"] = labels.compare_curves(out["v"], out["gbase"], out["g"], p)
    tested = labels.pct_test(out["compared"], p)
    out["tested"] = labels.slope_test(tested) if p.slope_test else tested
    return out


def test_pct_change_and_slope(spark, params):
    vendors = _vendors(spark, (1, 1, 2, "a"), (1, 1, 2, "one tier"))
    events = Events().add("a", 10, 5, 1.0).add("a", 10, 4, 2.0).add("a", 10, 5, 3.0).add("a", 10, 9, 4.0).add("one tier", 4, 1, 1.0)
    events.add("a", 50, 0, None).add("z", 5, 5, 1.0)
    out = _curves(spark, params, vendors, events, [(1, 1.0), (1, 2.0), (1, 3.0), (2, 4.0)])
    v = out["v"].filter("vendor_code = 'a'")
    assert tuples(v, "df_total", "cvr3", VENDOR_LEVEL.change, VENDOR_LEVEL.rank, VENDOR_LEVEL.tiers) == [
        (1.0, 0.5, None, 1, 3), (2.0, 0.4, -0.2, 2, 3), (3.0, 0.5, None, 3, 3),
    ]
    assert tuples(out["v"], "vendor_code", VENDOR_LEVEL.slope) == [("a", 0.0)] * 3 + [("one tier", None)]
    assert tuples(out["g"], "df_total", "num_unique_vendor_visits", "num_transactions", "asa_cvr3_per_df") == [
        (1.0, 14, 6, 0.42857), (2.0, 10, 4, 0.4), (3.0, 10, 5, 0.5),
    ]


def test_slope_value_does_not_depend_on_row_order(spark, params):
    rows = [("E", "sg", 1, "a", x, y, 3) for x, y in ((1.0, 0.5), (2.0, 0.3), (3.0, 0.2))]
    schema = "entity_id string, country_code string, master_asa_id long, vendor_code string, df_total double, cvr3 double, num_tiers_vendor int"
    for ordered in (rows, rows[::-1]):
        df = curves.with_slope(spark.createDataFrame(ordered, schema), VENDOR_LEVEL, params)
        assert df.select("vendor_cvr3_slope").distinct().collect() == [(-0.15,)]
    # all rows at one fee: slope 0
    flat = spark.createDataFrame([(*r[:4], 1.0, *r[5:]) for r in rows], schema)
    assert curves.with_slope(flat, VENDOR_LEVEL, params).first()["vendor_cvr3_slope"] == 0.0


def test_a_session_with_two_vendors_counts_once_per_group(spark, params):
    vendors = _vendors(spark, (1, 1, 2, "a"), (1, 1, 2, "b"))
    events = Events()
    for v in "ab":
        events._one(v, "same", "shop_details.loaded", 1.0)
    events._one("a", "same", "transaction", 1.0)
    out = _curves(spark, params, vendors, events, [(1, 1.0)])
    assert tuples(out["gcurve"], "num_unique_vendor_visits", "num_transactions") == [(1, 1)]
    assert out["vcurve"].count() == 2


def test_marks_are_shuffled_once_and_then_reduced(spark, params):
    """Keys of marks hardly repeat: reduced before the shuffle they filled a hash table with every event of a task."""
    vendors = _vendors(spark, (1, 1, 1, "a"))
    events = Events().add("a", 3, 2, 1.0).frame(spark)
    tiers = spark.createDataFrame([("E", "sg", 1, 1.0)], "entity_id string, country_code string, master_asa_id long, fee double")
    for unit, transactions in (("session", 2), ("event_time", 4)):
        p = dataclasses.replace(params, tx_unit=unit)
        # the same events from several partitions, transactions of half of them at another time
        late = events.filter("event_action = 'transaction'").withColumn("event_time", F.col("event_time") + F.expr("INTERVAL 1 DAY"))
        seen = events.union(events).union(late).repartition(3)
        marks = curves.curve_marks(seen, vendors, p)
        plan = screening.session_marks(seen, screening.VENDOR, tx_unit=unit)._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning")
        assert len(plan) == 2 and "HashAggregate" in plan[0] and "HashAggregate" not in plan[1]
        curve = curves.group_curve(vendors, marks, tiers, p)
        assert tuples(curve, "num_unique_vendor_visits", "num_transactions") == [(3, transactions)]


def test_marks_at_a_fee_of_minus_zero_meet_those_at_zero(spark, params):
    vendors = _vendors(spark, (1, 1, 1, "a"))
    events = Events()
    for i in range(20):
        for fee in (0.0, -0.0):
            events._one("a", f"s{i}", "shop_details.loaded", fee)
    out = _curves(spark, params, vendors, events, [(1, 0.0)])
    assert tuples(out["vcurve"], "df_total", "num_unique_vendor_visits") == [(0.0, 20)]
    assert tuples(out["gcurve"], "df_total", "num_unique_vendor_visits") == [(0.0, 20)]


@pytest.mark.parametrize("unit", ["session", "event_time"])
def test_a_fee_seen_without_a_session_keeps_its_group_row(spark, params, unit):
    p = dataclasses.replace(params, tx_unit=unit)
    events = Events().add("a", 2, 1, 1.0)
    events._one("a", None, "shop_details.loaded", 2.0)
    out = _curves(spark, p, _vendors(spark, (1, 1, 1, "a")), events, [(1, 1.0), (1, 2.0)])
    assert tuples(out["gcurve"], "df_total", "num_unique_vendor_visits", "num_transactions", "asa_cvr3_per_df") == [
        (1.0, 2, 1, 0.5), (2.0, 0, 0, 0.0),
    ]


def test_several_names_under_one_id_multiply_rows(spark, params):
    """Two groups pooled under id 9 differ in vendor count, so the pooled curve has two rows per fee."""
    vendors = _vendors(spark, (1, 9, 1, "a"), (2, 9, 2, "b"))
    events = Events().add("a", 4, 2, 1.0).add("a", 4, 1, 2.0).add("b", 4, 4, 1.0).add("b", 4, 2, 2.0)
    out = _curves(spark, params, vendors, events, [(9, 1.0), (9, 2.0)])
    assert out["gcurve"].count() == 4
    assert tuples(out["gbase"], "vendor_count_caught_by_asa", "asa_cvr3_at_min_df") == [(1, 0.5), (1, 0.5), (2, 1.0), (2, 1.0)]
    assert out["g"].count() == 16
    assert out["g"].agg(F.max(GROUP_LEVEL.tiers)).first()[0] == 16
    assert out["compared"].count() == 4 * 4 * 8


def _slopes(spark, *pairs):
    return spark.createDataFrame(list(pairs), "vendor_cvr3_slope double, asa_cvr3_slope double")


def test_slope_test(spark):
    df = _slopes(spark, (0.0, -1.0), (None, -1.0), (-2.0, -1.0), (-1.0, -1.0), (-0.5, -1.0), (-0.5, None))
    verdicts = [r["is_lb_test_passed_lm"] for r in labels.slope_test(df).collect()]
    assert verdicts == ["N", "N", "N", "N", "Y", "Unknown"]


@pytest.fixture
def loyal(spark, params):
    """Vendor a holds its conversion, vendor b loses it; c is not screened."""
    vendors = _vendors(spark, (1, 1, 3, "a"), (1, 1, 3, "b"))
    events = Events().add("a", 10, 6, 0.0).add("a", 10, 5, 1.5).add("b", 10, 6, 0.0).add("b", 10, 2, 1.5)
    return _curves(spark, params, vendors, events, [(1, 0.0), (1, 1.5)])


def test_vendor_labels(loyal, params):
    out = {r["vendor_code"]: r.asDict() for r in labels.vendor_labels(loyal["tested"], params).collect()}
    a, b = out["a"], out["b"]
    assert (a["is_lb"], a["is_lb_lm"], b["is_lb"], b["is_lb_lm"]) == ("Y", "Y", "N", "N")
    assert a["dfs_seen_in_sessions"] == "0, 1.5"
    assert a["vendor_cvr3_by_df"] == "0.6, 0.5"
    # the base tier has no change, so this list is shorter
    assert a["pct_chng_of_actual_cvr3_from_base"] == "-0.1667"
    assert a["is_lb_test_passed"] == "N, Y"
    assert (a["num_tiers_vendor"], a["num_tiers_master_asa"]) == (2.0, 2.0)
    assert a["vendor_cvr3_slope"] == pytest.approx(-0.1 / 1.5)


def test_final_list(spark, make, loyal, params):
    vendors = _vendors(spark, (1, 1, 3, "a"), (1, 1, 3, "b"), (1, 1, 3, "c"), (2, 2, 1, "d"))
    events = Events().add("a", 20, 11).add("b", 20, 8).add("c", 1, 0)
    metrics = screening.vendor_metrics(vendors, events.frame(spark), _orders(spark, a=6, b=3, c=1))
    funnel = screening.screening_funnel(screening.percentile_screen(metrics), params)
    directory = make("vendor_directory", {"global_entity_id": "E", "vendor_id": "a", "vertical_type": "restaurants"})
    final = labels.final_vendor_list(funnel, labels.vendor_labels(loyal["tested"], params), directory, params)
    rows = {r["vendor_code"]: r.asDict() for r in final.collect()}
    assert {v: (r["vendor_rank"], r["is_lb"], r["is_lb_lm"], r["is_lb_test_passed"]) for v, r in rows.items()} == {
        "a": ("Top 25%", "Y", "Y", "N, Y"), "b": ("Top 25%", "N", "N", "N, N"),
        "c": ("Bottom 75%", "N", "N", "N"), "d": ("Bottom 75%", "N", "N", "N"),
    }
    after = {v: (r["asa_orders_after_lb_logic"], r["vendor_count_remaining_after_lb_logic_lm"], r["asa_order_share_after_lb_logic"], r["perc_vendors_remaining_after_lb_logic"]) for v, r in rows.items()}
    assert after == {"a": (6, 1, 0.6, 0.3333), "b": (6, 1, 0.6, 0.3333), "c": (0, 0, 0.0, 0.0), "d": (0, 0, 0.0, 0.0)}
    assert (rows["a"]["vertical_type"], rows["b"]["vertical_type"], rows["a"]["num_tiers_vendor"]) == ("restaurants", None, 2)


def test_labels_without_slopes_or_ranks(spark, make, params):
    p = dataclasses.replace(params, slope_test=False, tier_ranks=False, group_key="asa_id", tx_unit="event_time")
    vendors = _vendors(spark, (1, 9, 3, "a"), (2, 9, 3, "b"))
    events = Events().add("a", 10, 6, 0.0).add("a", 10, 5, 1.5).add("b", 10, 6, 0.0).add("b", 10, 2, 1.5)
    tiers = [(1, 0.0), (1, 1.5), (2, 0.0), (2, 1.5)]
    out = _curves(spark, p, vendors, events, tiers)
    assert "asa_id" in out["v"].columns and "tier_rank_vendor" not in out["v"].columns
    # each group is its own average now, so nobody beats it
    found = labels.vendor_labels(out["tested"], p)
    assert tuples(found, "asa_id", "vendor_code", "is_lb") == [(1, "a", "N"), (2, "b", "N")]
    assert "is_lb_lm" not in found.columns
