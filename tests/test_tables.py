"""Input tables are read by name at every depth."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from elastiq.schemas import SCHEMAS
from elastiq.sources.tables import as_declared, read_input

ROW = "entity_id string, created_at timestamp, vendors array<struct<{fee}, id: string, meta_data: struct<scheme_id: int>>>"
FEES = {
    "reordered": ("delivery_fee: struct<total: double, travel_time: double>", (9.0, 2.0)),
    "further field": ("delivery_fee: struct<surcharge: double, travel_time: double, total: double>", (5.0, 2.0, 9.0)),
    "decimals": ("delivery_fee: struct<Total: decimal(10,2), TRAVEL_TIME: decimal(8,3)>", (9, 2)),
}


def _stored(spark, kind):
    from decimal import Decimal

    fee, values = FEES[kind]
    values = tuple(Decimal(v) for v in values) if kind == "decimals" else values
    at = dt.datetime(2024, 1, 10)
    rows = [("e", at, [(values, "v1", (7,))]), ("e", at, None), ("e", at, [None, (None, "v2", None)])]
    return spark.createDataFrame(rows, ROW.format(fee=fee))


@pytest.mark.parametrize("kind", FEES)
def test_nested_fields_are_matched_by_name(spark, tmp_path, kind):
    _stored(spark, kind).withColumn("unknown", F.lit(1)).write.parquet(str(tmp_path / "pricing_requests"))
    df = read_input(spark, str(tmp_path), "pricing_requests")
    assert df.schema.simpleString() == T.StructType.fromDDL(SCHEMAS["pricing_requests"]).simpleString()
    rows = sorted((r for r in df.collect()), key=lambda r: (r.vendors is None, len(r.vendors or [])))
    offer = rows[0].vendors[0]
    assert (offer.delivery_fee.travel_time, offer.delivery_fee.total, offer.id, offer.meta_data.scheme_id) == (2.0, 9.0, "v1", 7)
    assert offer.meta_data.vendor_price_scheme_type is None and rows[0].customer is None
    assert rows[1].vendors[0] is None and rows[1].vendors[1].delivery_fee is None and rows[1].vendors[1].id == "v2"
    assert rows[2].vendors is None


def test_tables_of_a_catalog_are_matched_by_name(spark):
    got = as_declared(_stored(spark, "reordered"), "pricing_requests").filter("size(vendors) = 1").first()
    assert got.vendors[0].delivery_fee.travel_time == 2.0


def test_the_scan_reads_only_the_nested_fields_in_use(spark, tmp_path):
    _stored(spark, "further field").write.parquet(str(tmp_path / "pricing_requests"))
    df = read_input(spark, str(tmp_path), "pricing_requests").select("entity_id")
    scan = next(x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in x)
    assert "vendors" not in scan.split("ReadSchema")[1]
    nested = read_input(spark, str(tmp_path), "pricing_requests")
    assert "surcharge" not in nested._jdf.queryExecution().executedPlan().toString()
