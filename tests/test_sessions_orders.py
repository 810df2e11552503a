import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import tuples
from elastiq.operators import orders, sessions
from elastiq.params import AUTOMATIC_SCHEME

JAN = dt.date(2024, 1, 10)
AT = dt.datetime(2024, 1, 10, 12)
WINDOW = (dt.date(2024, 1, 1), dt.date(2024, 1, 31))
SHAPE = "array<array<struct<x:double,y:double>>>"


def _box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


@pytest.fixture
def zones(spark):
    rows = [
        ("E", "sg", "c1", "z1", [_box(0.0, 0.0, 4.0, 4.0), _box(1.0, 1.0, 2.0, 2.0)]),
        ("E", "sg", "c1", "z2", [_box(0.0, 0.0, 0.5, 0.5)]),
        ("E", "my", "c9", "z9", [_box(50.0, 0.0, 51.0, 1.0)]),
    ]
    return spark.createDataFrame(rows, f"entity_id string, country_code string, city_name string, zone_name string, zone_shape {SHAPE}")


@pytest.fixture
def vendors(spark):
    return spark.createDataFrame([("E", "sg", "v1"), ("E", "sg", "v2"), ("E", "sg", "v1")], "entity_id string, country_code string, vendor_code string")


def _session(id_, lon, lat, events=(("shop_details.loaded", "v1"),), vertical="Restaurants", **more):
    return {
        "created_date": JAN, "entity_id": "E", "country_code": "sg", "events_ga_session_id": id_, "ga_dps_session_id": f"d{id_}",
        "lon": lon, "lat": lat,
        "sessions": (AT, "singleFee", None, None, None, vertical, None, None, None, None, None),
        "events": [(a, v, None, AT, None, None) for a, v in events],
        "dps_zone": [(1, "c1", 10, "z1", "UTC"), (1, "c1", 10, "z1", "UTC"), (1, "c1", 99, "unknown", "UTC")],
        **more,
    }


def _located(make, zones, vendors, *rows):
    cells = sessions.zone_index(zones, 0.25)
    return sessions.sessions_in_zones(make("web_sessions", *rows), zones, cells, vendors, WINDOW, cell_size=0.25)


def test_sessions_in_zones(make, zones, vendors):
    found = _located(
        make, zones, vendors,
        _session("inside", 3.0, 3.0),
        _session("outside", 5.0, 3.0),
        _session("edge", 4.0, 3.0),
        _session("hole", 1.5, 1.5),
        _session("two zones", 0.25, 0.25),
        _session("nowhere", None, 1.0),
        _session("other vendor", 3.0, 3.0, [("shop_details.loaded", "v9"), ("shop_details.loaded", None)]),
        _session("other kind", 3.0, 3.0, [("checkout.loaded", "v1")]),
        _session("bought", 3.0, 3.0, [("transaction", "v1"), ("shop_details.loaded", "v2"), ("home_screen.loaded", None)]),
        _session("too late", 3.0, 3.0, created_date=dt.date(2024, 2, 1)),
        _session("no zone", 3.0, 3.0, dps_zone=[]),
        _session("other city", 3.0, 3.0, dps_zone=[(9, "c9", 9, "z9", "UTC")]),
    )
    assert tuples(found, "events_ga_session_id", "event_action", "vendor_code") == [
        ("bought", "shop_details.loaded", "v2"),
        ("bought", "transaction", "v1"),
        ("inside", "shop_details.loaded", "v1"),
        ("two zones", "shop_details.loaded", "v1"),
    ]
    assert found.filter("events_ga_session_id = 'two zones'").first()["ga_location"] == "POINT(0.25 0.25)"


def test_vertical(make, zones, vendors):
    names = ["Restaurants", "SHOP", "darkstores", "other", None]
    rows = [_session(str(i), 3.0, 3.0, vertical=n) for i, n in enumerate(names)]
    found = _located(make, zones, vendors, *rows)
    assert tuples(found, "events_ga_session_id", "vertical_parent") == [
        ("0", "restaurant"), ("1", "shop"), ("2", "darkstores"), ("3", None), ("4", None),
    ]


def _request(session, fee, at=AT, scheme=1, lon=3.0, endpoint="singleFee", vendor="v1", country="SG"):
    return {
        "entity_id": "E", "country_code": country, "created_date": JAN, "created_at": at, "endpoint": endpoint,
        "customer": ("u", lon, 3.0, (session, AT)),
        "vendors": [(vendor, (scheme, AUTOMATIC_SCHEME), (fee, fee + 10))],
    }


def _last(make, zones, vendors, *rows, **options):
    cells = sessions.zone_index(zones, 0.25)
    fee = options.pop("fee_field", "travel_time")
    kept = sessions.fee_requests(make("pricing_requests", *rows), zones, cells, WINDOW, cell_size=0.25, **options)
    return sessions.last_fee(sessions.fee_offers(kept, vendors, fee_field=fee))


def test_last_fee(make, zones, vendors):
    rows = [
        _request("s1", 1.0),
        _request("s1", 2.0, AT + dt.timedelta(seconds=1)),
        _request("tie", 3.0, scheme=1),
        _request("tie", 1.0, scheme=2),
        _request("tie", 1.5, scheme=2),
        _request("tie", 1.5, scheme=2),
        _request("outside", 1.0, lon=9.0),
        _request(None, 1.0),
        _request("other vendor", 1.0, vendor="v9"),
        _request("many", 1.0, endpoint="multipleFee"),
        _request("elsewhere", 1.0, country="TH"),
    ]
    assert tuples(_last(make, zones, vendors, *rows), "dps_session_id", "df_total", "country_code") == [
        ("s1", 2.0, "sg"), ("tie", 1.5, "sg"),
    ]
    both = _last(make, zones, vendors, *rows, endpoints=("singleFee", "multipleFee"), fee_field="total")
    assert tuples(both, "dps_session_id", "df_total") == [("many", 11.0), ("s1", 12.0), ("tie", 11.5)]


def test_requests_are_reduced_before_they_are_flattened(make, zones, vendors):
    menu = [(f"v{i}", (1, AUTOMATIC_SCHEME), (float(i), 10.0)) for i in range(1, 201)]
    rows = [_request("ds1", 0.0) | {"vendors": menu}, _request("unseen", 1.0) | {"vendors": menu}, _request("dn", 1.0) | {"vendors": None}]
    events = _located(
        make, zones, vendors, _session("s1", 3.0, 3.0), _session("s1", 3.0, 3.0), _session("n", 3.0, 3.0),
        _session("none", 3.0, 3.0, ga_dps_session_id=None), _session("no request", 3.0, 3.0),
    )
    cells = sessions.zone_index(zones, 0.25)
    source = make("pricing_requests", *rows)
    kept = sessions.fee_requests(source, zones, cells, WINDOW, seen=sessions.sessions_seen(events), cell_size=0.25)
    # one session of three, and of 200 offers those that share one of 64 bits with the vendor seen
    assert kept.count() == 1
    assert 1 <= kept.select(F.size("vendors")).first()[0] < 20
    offers = sessions.last_fee(sessions.seen_offers(kept, events))
    assert tuples(offers, "dps_session_id", "vendor_code", "df_total") == [("ds1", "v1", 1.0)]
    # the arrays are flattened above the joins with sessions and zones
    plan = sessions.seen_offers(kept, events)._jdf.queryExecution().optimizedPlan().toString()
    flatten = plan.index("Generate explode(vendors")
    assert plan.index("bit_or") > flatten and plan.index("LeftSemi") < flatten
    # the same fees reach the sessions as without the reduction
    whole = sessions.fee_requests(source, zones, cells, WINDOW, cell_size=0.25)
    priced = [sessions.sessions_with_fee(events, f) for f in (offers, sessions.last_fee(sessions.known_offers(whole, vendors)))]
    assert tuples(priced[0], *priced[0].columns) == tuples(priced[1], *priced[1].columns)


def test_a_mask_never_drops_a_vendor_that_was_seen(make, zones, spark):
    codes = [f"v{i}" for i in range(300)]
    known = spark.createDataFrame([("E", "sg", c) for c in codes], "entity_id string, country_code string, vendor_code string")
    events = _located(make, zones, known, _session("s", 3.0, 3.0, [("shop_details.loaded", c) for c in codes]))
    menu = [(c, (1, AUTOMATIC_SCHEME), (1.0, 1.0)) for c in codes]
    cells = sessions.zone_index(zones, 0.25)
    source = make("pricing_requests", _request("ds", 1.0) | {"vendors": menu})
    kept = sessions.fee_requests(source, zones, cells, WINDOW, seen=sessions.sessions_seen(events), cell_size=0.25)
    assert sessions.seen_offers(kept, events).count() == len(codes)


def test_a_request_matches_zones_of_any_country(make, zones, vendors, spark):
    # the zone around lon 50 belongs to "my", the request to "sg"
    request = _request("s1", 1.0, lon=50.5) | {"customer": ("u", 50.5, 0.5, ("s1", AT))}
    assert _last(make, zones, vendors, request).count() == 1


def test_sessions_with_fee(make, zones, vendors):
    events = _located(
        make, zones, vendors, _session("s1", 3.0, 3.0), _session("s2", 3.0, 3.0),
        *[_session(f"n{i}", 3.0, 3.0, ga_dps_session_id=None) for i in range(5)],
    )
    fees = _last(make, zones, vendors, _request("ds1", 1.0))
    joined = sessions.sessions_with_fee(events, fees)
    assert tuples(joined, "events_ga_session_id", "df_total") == [
        *[(f"n{i}", None) for i in range(5)], ("s1", 1.0), ("s2", None),
    ]
    assert joined.columns == [*events.columns, "df_total", "scheme_id", "vendor_price_scheme_type", "dps_logs_created_at"]


def _order(code, vendor="v1", **more):
    return {
        "entity_id": "E", "country_code": "sg", "vendor_id": vendor, "platform_order_code": code, "created_date": JAN,
        "delivery_status": "completed", "is_sent": True, "assignment_id": "1", "vendor_price_scheme_type": AUTOMATIC_SCHEME,
        "exchange_rate": 2.0, "delivery_fee_local": 5.0, "is_delivery_fee_covered_by_discount": False,
        "is_delivery_fee_covered_by_voucher": False, **more,
    }


def test_vendor_orders(make, vendors):
    source = make(
        "orders_mapped", _order("a"), _order("a"), _order("b"), _order("c", "v2"), _order("d", "v9"),
        _order("e", delivery_status="cancelled"), _order("f", created_date=dt.date(2024, 2, 1)),
        # the key test takes the country as it is written
        _order("g", country_code="SG"),
    )
    found = orders.vendor_orders(source, vendors, WINDOW)
    assert tuples(found, "vendor_code", "country_code", "num_orders") == [("v1", "sg", 2), ("v2", "sg", 1)]


def test_paid_fee(spark):
    rows = [
        ("Europe", 3.0, False, False), ("Europe", None, False, False), ("Asia", None, True, None), ("Asia", None, None, None),
        ("Africa", 3.0, False, False), ("Africa", None, True, False), ("Africa", None, None, False), (None, 3.0, False, False),
    ]
    df = spark.createDataFrame(rows, "region string, ext double, d boolean, v boolean").withColumn("fee", F.lit(5.0))
    args = [F.col(c) for c in ("region", "ext", "d", "v", "fee")]
    impact = orders.paid_fee(*args, unknown_is_covered=True)
    economics = orders.paid_fee(*args, unknown_is_covered=False)
    assert [tuple(r) for r in df.select(impact, economics).collect()] == [
        (3.0, 3.0), (5.0, 5.0), (0.0, 0.0), (5.0, 5.0), (5.0, 5.0), (0.0, 0.0), (0.0, 5.0), (None, None),
    ]


def test_group_order_impact(make, spark):
    source = make(
        "orders_mapped", _order("a"), _order("b"), _order("c", exchange_rate=0.0), _order("d", assignment_id="9"),
        _order("e", vendor_price_scheme_type="Manual"), _order("f", entity_id="F"),
    )
    external = make("external_fee_orders", {"global_entity_id": "E", "code": "b", "created_date_utc": JAN, "delivery_fee_local": 1.0})
    active = spark.createDataFrame([("Asia", "E", "sg")], "region string, entity_id string, country_code string")
    groups = spark.createDataFrame([("E", "sg", 1), ("F", "sg", 1)], "entity_id string, country_code string, asa_id long")
    found = orders.group_order_impact(source, external, active, groups, WINDOW)
    assert [tuple(r) for r in found.collect()] == [("E", "sg", 1, 3, 11.0, 3.0, 3.67, 1.0)]
