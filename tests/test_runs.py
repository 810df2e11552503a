"""The whole job on nested tables, and the registered queries against SQL."""

import dataclasses
import datetime as dt
import math
from pathlib import Path

import pytest

import __spark_entry__ as entry
from conftest import tuples
from elastiq.params import Params
from elastiq.plans import job
from elastiq.plans.queries import QUERIES
from elastiq.schemas import SCHEMAS
from elastiq.sources.sinks import sink

TESTDATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
AT = dt.datetime(2024, 1, 10, 12)
OLD = dt.datetime(2023, 6, 1)
BOX = [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]]
VENDORS = {"loyal": ("Food", 1), "fickle": ("Food_LB", 2), "small": ("Food", 1), "tiny": ("Food_LB", 2)}
# visits and transactions per fee of 1 and 2
CURVES = {"loyal": ((40, 20), (40, 18)), "fickle": ((40, 30), (40, 6)), "small": ((4, 1), (4, 0)), "tiny": ((2, 0), (2, 0))}


def _write_inputs(spark, root):
    def version(name, id_):
        config = (id_ * 10, 1, 1, OLD, None, [], [])
        return (id_, name, 1, OLD, None, [config])

    sessions, requests, orders = [], [], []
    for vendor, fees in CURVES.items():
        for fee, (visits, sold) in zip((1.0, 2.0), fees):
            for i in range(visits):
                sid = f"{vendor}-{fee}-{i}"
                events = [("shop_details.loaded", vendor, None, AT + dt.timedelta(seconds=i), None, None)]
                if i < sold:
                    events.append(("transaction", vendor, None, AT + dt.timedelta(minutes=i), sid, None))
                    orders.append((sid, vendor, fee, i))
                sessions.append((sid, events))
                requests.append((sid, vendor, fee))
    tables = {
        "entities": [{"region": "Asia", "country_iso": "SG", "country_name": "n", "platforms": [("FP_SG",), ("DN_SG",)]}],
        "countries": [{"region": "Asia", "country_code": "sg", "platforms": [("FP_SG",)], "cities": [(1, "c", True, [(1, "z", True, BOX)])]}],
        "group_config_versions": [
            {"entity_id": "FP_SG", "country_code": "sg", "vendor_code": v, "dps_automatic_assignment_history": [version(*g)]}
            for v, g in VENDORS.items()
        ],
        "scheme_config_versions": [
            {
                "entity_id": "FP_SG", "country_code": "sg", "scheme_id": s, "price_scheme_history": [("s", OLD, None, 1)],
                "travel_time_config": [("c", OLD, None)], "travel_time_detail": [(10.0, 1.0, OLD, None), (None, 2.0, OLD, None)],
            }
            for s in (10, 20)
        ],
        "web_sessions": [
            {
                "created_date": AT.date(), "entity_id": "FP_SG", "country_code": "sg", "events_ga_session_id": sid,
                "ga_dps_session_id": f"d{sid}", "lon": 0.5, "lat": 0.5, "sessions": (None,) * 11, "events": events,
                "dps_zone": [(1, "c", 1, "z", "UTC")],
            }
            for sid, events in sessions
        ],
        "pricing_requests": [
            {
                "entity_id": "FP_SG", "country_code": "SG", "created_date": AT.date(), "created_at": AT, "endpoint": "singleFee",
                "customer": ("u", 0.5, 0.5, (f"d{sid}", AT)), "vendors": [(vendor, (10, "Automatic scheme"), (fee, fee))],
            }
            for sid, vendor, fee in requests
        ],
        "orders_mapped": [
            {
                "entity_id": "FP_SG", "country_code": "sg", "vendor_id": vendor, "platform_order_code": sid, "created_date": AT.date(),
                "delivery_status": "completed", "is_sent": True, "assignment_id": str(VENDORS[vendor][1]), "exchange_rate": 2.0,
                "vendor_price_scheme_type": "Automatic scheme", "delivery_fee_local": fee, "is_delivery_fee_covered_by_discount": False,
                "is_delivery_fee_covered_by_voucher": False, "dps_travel_time_fee_local": fee, "commission_local": 1.0,
                "joker_vendor_fee_local": 0.0, "gfv_local": 20.0, "dps_minimum_order_value_local": 10.0, "delivery_costs_local": 1.0,
                "gmv_local": 20.0,
            }
            for sid, vendor, fee, _ in orders
        ],
        "external_fee_orders": [],
        "order_values": [],
        "vendor_directory": [{"global_entity_id": "FP_SG", "vendor_id": v, "vertical_type": "shop"} for v in VENDORS],
    }
    from pyspark.sql import types as T

    for name, rows in tables.items():
        schema = T.StructType.fromDDL(SCHEMAS[name])
        data = [tuple(r.get(f.name) for f in schema.fields) for r in rows]
        spark.createDataFrame(data, schema).write.parquet(f"{root}/{name}")


@pytest.fixture(scope="module")
def job_output(spark, tmp_path_factory):
    root, out = tmp_path_factory.mktemp("in"), tmp_path_factory.mktemp("out")
    _write_inputs(spark, root)
    job.main(
        ["--input", str(root), "--output", str(out), "--as-of", "2024-02-15"]
        + ["--visits-thr", "0.6", "--orders-thr", "0.6", "--cvr-thr", "0.6"]
    )
    return sink(spark, str(out)).read


def test_job_labels_the_loyal_vendor(job_output):
    final = job_output("final_list")
    assert tuples(final, "vendor_code", "master_asa_id", "vendor_rank", "is_lb", "is_lb_lm") == [
        ("fickle", 3, "Top 25%", "N", "N"), ("loyal", 3, "Top 25%", "Y", "Y"),
        ("small", 3, "Bottom 75%", "N", "N"), ("tiny", 3, "Bottom 75%", "N", "N"),
    ]
    loyal = final.filter("vendor_code = 'loyal'").first()
    assert (loyal["dfs_seen_in_sessions"], loyal["vendor_cvr3_by_df"]) == ("1, 2", "0.5, 0.45")
    stamp = dt.datetime(2024, 2, 15)
    assert final.select("update_timestamp").distinct().collect() == [(stamp,)]
    assert job_output("history").select("update_timestamp").distinct().collect() == [(stamp,)]
    for kept in ("sessions", "vendor_orders", "last_fees", "priced_sessions"):
        assert job_output(kept).count() > 0


def test_every_parameter_is_an_option():
    options = {a.dest for a in job.arguments()._actions}
    assert {f.name for f in dataclasses.fields(Params)} <= options
    args = ["--input", "i", "--output", "o", "--as-of", "2024-02-15", "--no-tier-ranks", "--endpoints", "singleFee", "multipleFee"]
    args += ["--per-pair-ids", "--suffix-only", "--link-suffix", "1", "--cell-size", "0.5"]
    parsed = job.arguments().parse_args(args)
    assert (parsed.tier_ranks, parsed.endpoints, parsed.cell_size) == (False, ["singleFee", "multipleFee"], 0.5)


def test_job_elasticity(job_output):
    """Pooled groups list every fee twice and each vendor has one label row: sums double, counts do not."""
    out = job_output("tier_elasticity").filter("fee = 2 AND is_lb_lm = 'Y'")
    assert tuples(out, "order_count_vendor_cluster_tt_fee_level", "tier_elasticity_vendor_cluster_level") == [(18, pytest.approx(-0.1))]
    performance = job_output("vendor_fee_performance").filter("vendor_code = 'loyal' AND fee = 1")
    assert tuples(performance, "vendor_order_count", "df_revenue_local") == [(20, 40.0)]
    assert tuples(job_output("group_order_impact"), "asa_id", "num_orders_asa") == [(1, 39), (2, 36)]


def test_every_query_has_sql():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(QUERIES) <= set(sql) <= set(queries)


def _normal(rows):
    def value(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else repr(x + 0.0)
        return str(x)

    return sorted(tuple(value(x) for x in r) for r in rows)


@pytest.mark.skipif(not TESTDATA.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TESTDATA}/{t}.parquet'")
    df = entry.queries()[name](spark, str(TESTDATA))
    columns = sorted(df.columns)
    result = con.execute(entry.oracle_sql()[name])
    found = [c[0] for c in result.description]
    assert sorted(found) == columns
    order = [found.index(c) for c in columns]
    expected = [[row[i] for i in order] for row in result.fetchall()]
    rows = df.select(*columns).collect()
    assert rows or not expected
    assert _normal(rows) == _normal(expected)
