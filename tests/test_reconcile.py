import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from conftest import tuples
from elastiq.operators.reconcile import reconcile, reconcile_counts, reconcile_nulls
from elastiq.plans import publication
from elastiq.sources.history import append_history, read_run
from elastiq.sources import files as store
from elastiq.sources.published import published_ids, read_published, write_published
from elastiq.sources.sinks import sink


@pytest.fixture
def folder(tmp_path):
    files = {
        "ae_x.gzip": ["v1", "v2"],
        "sg_xx-low-fee-v1.gzip": ["v1", "v3"],
        "sg_yy-high-v1.gzip": ["v4"],
    }
    for name, ids in files.items():
        with gzip.open(tmp_path / name, "wt") as f:
            json.dump({"vendor_ids": ids, "update_timestamp": "1668534580"}, f, indent=1)
    (tmp_path / "notes.txt").write_text("not a list")
    return str(tmp_path)


def test_published_files(spark, folder):
    ids = published_ids(read_published(spark, folder), with_cluster=True)
    assert tuples(ids, "country_code", "cluster", "vendor_ids", "update_timestamp") == [
        ("ae", "", "v1", "2022-11-15 17:49:40"), ("ae", "", "v2", "2022-11-15 17:49:40"),
        ("sg", "high", "v4", "2022-11-15 17:49:40"),
        ("sg", "low-fee", "v1", "2022-11-15 17:49:40"), ("sg", "low-fee", "v3", "2022-11-15 17:49:40"),
    ]
    assert published_ids(read_published(spark, folder)).columns == ["country_code", "update_timestamp", "vendor_ids"]


def test_times_do_not_depend_on_the_session_zone(spark, folder):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        ids = published_ids(read_published(spark, folder))
        assert ids.select("update_timestamp").distinct().collect() == [("2022-11-15 17:49:40",)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def _frames(spark):
    published = spark.createDataFrame(
        [("ae", "both", "t"), ("ae", "published", "t"), ("sg", "both", "t"), ("ae", "twice", "t"), ("ae", "twice", "t"), ("ae", None, "t")],
        "country_code string, vendor_ids string, update_timestamp string",
    )
    table = spark.createDataFrame(
        [("Asia", "ae", "both"), ("Asia", "ae", "table"), ("Asia", "sg", "both"), ("Europe", "ae", "twice"), ("Asia", "ae", None), ("Asia", "sg", "published")],
        "region string, country_code string, vendor_code string",
    )
    return published, table


def test_reconcile(spark):
    published, table = _frames(spark)
    out = reconcile(published, table)
    assert tuples(out, "country_code", "vendor_ids", "vendor_code", "status") == sorted(
        [
            ("ae", "both", "both", "both"), ("sg", "both", "both", "both"), ("ae", "twice", "twice", "both"), ("ae", "twice", "twice", "both"),
            ("ae", "published", None, "published_only"), ("ae", None, None, "published_only"),
            ("ae", None, "table", "table_only"), ("sg", None, "published", "table_only"), ("ae", None, None, "table_only"),
        ],
        key=repr,
    )
    inner = published.join(table, (published.country_code == table.country_code) & (published.vendor_ids == table.vendor_code))
    assert out.filter("status = 'both'").count() == inner.count()


def test_counts(spark):
    published, table = _frames(spark)
    both = reconcile(published, table)
    counts = reconcile_counts(published, table, both)
    assert tuples(counts, "country_code", "published", "in_table", "matched") == [("ae", 4, 3, 3), ("sg", 1, 2, 1)]
    asia = reconcile_counts(published, table, both, regions=("Asia",))
    assert tuples(asia, "country_code", "in_table") == [("ae", 2), ("sg", 2)]
    nulls = reconcile_nulls(both)
    assert tuples(nulls, "side", "is_missing", "num_rows") == [
        ("vendor_code", False, 6), ("vendor_code", True, 3), ("vendor_ids", False, 5), ("vendor_ids", True, 4),
    ]


def test_clusters_are_part_of_the_key(spark):
    published = spark.createDataFrame([("sg", "low", "v1"), ("sg", "high", "v1")], "country_code string, cluster string, vendor_ids string")
    table = spark.createDataFrame([("Asia", "sg", "v1", "low")], "region string, country_code string, vendor_id string, cluster string")
    out = reconcile(published, table, table_id="vendor_id", with_cluster=True)
    assert tuples(out, "cluster", "status") == [("high", "published_only"), ("low", "both")]
    counts = reconcile_counts(published, table, out, table_id="vendor_id", with_cluster=True)
    assert tuples(counts, "cluster", "published", "in_table", "matched") == [("high", 1, 0, 0), ("low", 1, 1, 1)]


def test_history(spark, tmp_path):
    path = str(tmp_path / "history")
    first, second = (dt.datetime(2024, m, 15, 17, 49, 40, tzinfo=dt.timezone.utc) for m in (1, 2))
    df = spark.createDataFrame([("a", "Y"), ("b", "N")], "vendor_code string, is_lb string")
    append_history(df, path, first)
    append_history(df.withColumn("is_lb", F.lit("N")), path, second)
    append_history(df, path, first)  # a retry replaces its own rows
    assert spark.read.parquet(path).count() == 4
    assert tuples(read_run(spark, path, first), "vendor_code", "is_lb") == [("a", "Y"), ("b", "N")]
    assert tuples(read_run(spark, path, second), "vendor_code", "is_lb") == [("a", "N"), ("b", "N")]


def test_publication_check(spark, folder, tmp_path_factory):
    tmp_path = tmp_path_factory.mktemp("run")
    run_ts = dt.datetime(2024, 2, 15, tzinfo=dt.timezone.utc)
    rows = [("Asia", "sg", "v1", "Y"), ("Asia", "sg", "v3", "N"), ("Asia", "sg", "v9", "Y"), ("Asia", "th", "v1", "Y")]
    final = spark.createDataFrame(rows, "region string, country_code string, vendor_code string, is_lb_lm string")
    append_history(final, str(tmp_path / "history"), run_ts)
    publication.main(
        ["--published", folder, "--history", str(tmp_path / "history"), "--run-ts", run_ts.isoformat()]
        + ["--countries", "ae,sg", "--output", str(tmp_path / "out")]
    )
    counts = sink(spark, str(tmp_path / "out")).read("counts")
    assert tuples(counts, "country_code", "published", "in_table", "matched") == [("ae", 2, 0, 0), ("sg", 3, 2, 1)]

    clusters = [("Americas", "sg", "v4", "high"), ("Americas", "sg", "v1", "high"), ("Europe", "sg", "v3", "low-fee")]
    table = spark.createDataFrame(clusters, "region string, country_code string, vendor_id string, cluster string")
    table.write.parquet(str(tmp_path / "clusters"))
    publication.main(
        ["--published", folder, "--clusters", str(tmp_path / "clusters"), "--regions", "Americas"]
        + ["--output", str(tmp_path / "out")]
    )
    counts = sink(spark, str(tmp_path / "out")).read("counts")
    assert tuples(counts.filter("country_code = 'sg'"), "cluster", "published", "in_table", "matched") == [
        ("high", 1, 2, 1), ("low-fee", 2, 0, 1),
    ]


def test_many_lists_are_published_at_once_and_replace_older_ones(spark, tmp_path, monkeypatch):
    lists = lambda n: spark.range(300).selectExpr(
        "concat('sg_xx-c', id, '-v1-a.gzip') AS file_name", f"array('{n}', cast(id AS string)) AS vendor_ids", "'1' AS update_timestamp"
    )
    single = []
    monkeypatch.setattr(store, "move", lambda *a: single.append(a))  # a move on its own waits for the one before
    for n in ("old", "new"):
        write_published(lists(n), str(tmp_path / "lists"))
    back = read_published(spark, str(tmp_path / "lists")).select("file_name", "vendor_ids", "update_timestamp")
    assert tuples(back, *back.columns) == tuples(lists("new"), *back.columns) and not single
    assert sorted(p.name for p in (tmp_path / "lists").iterdir() if not p.name.startswith(".")) == sorted(r[0] for r in lists("new").select("file_name").collect())
