"""Runs that stop half way, and sinks whose writes fail."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from conftest import tuples
from elastiq.params import Params
from elastiq.plans import job
from elastiq.sources import files
from elastiq.sources.manifest import Manifest, run_digest
from elastiq.sources.sinks import CatalogSink, FolderSink, sink
from elastiq.sources.tables import read_input
from test_runs import _write_inputs

P = Params(as_of=dt.date(2024, 2, 15), visits_thr=0.6, orders_thr=0.6, cvr_thr=0.6)
STAMP = dt.datetime(2024, 2, 15, tzinfo=dt.timezone.utc)
FIRST, SECOND = (dt.datetime(2024, m, 15, tzinfo=dt.timezone.utc) for m in (1, 2))


class Stopped(Exception):
    pass


class Watched:
    """Stop a run before its stage ``stop_at``."""

    def __init__(self, stop_at=None):
        self.stop_at, self.manifest = stop_at, None

    def __call__(self, manifest):
        self.manifest = manifest

        def keep(df, name):
            if name == self.stop_at:
                raise Stopped(name)
            return manifest(df, name)

        return keep


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("restart"))
    _write_inputs(spark, root)
    return root


def _run(spark, root, output, stop_at=None):
    watched = Watched(stop_at)
    job.run_and_publish(lambda name: read_input(spark, root, name), P, output, STAMP, watched)
    return watched.manifest


def test_second_attempt_reads_what_the_first_completed(spark, inputs, tmp_path):
    whole = _run(spark, inputs, str(tmp_path / "whole"))
    assert not whole.reused and not files.exists(spark, whole.folder)

    out, watched = str(tmp_path / "out"), Watched("vendor_points")
    with pytest.raises(Stopped):
        job.run_and_publish(lambda name: read_input(spark, inputs, name), P, out, STAMP, watched)
    done = list(watched.manifest.built)
    assert done == whole.built[: len(done)] and "sessions" in done
    assert not os.path.exists(f"{out}/sessions/_current")  # nothing is published before everything is there

    again = _run(spark, inputs, out)
    assert again.reused == done and again.built == whole.built[len(done) :]
    for name in ("final_list", "tier_elasticity", "all_metrics", "sessions"):
        one, two = (sink(spark, o).read(name) for o in (out, str(tmp_path / "whole")))
        assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty() and not one.isEmpty()
    # Results were written once: the published version is the stage.
    assert len([x for x in os.listdir(f"{out}/final_list") if x.startswith("version-")]) == 1


def test_other_inputs_parameters_or_code_are_another_run(spark, inputs, monkeypatch):
    read = lambda: [("entities", read_input(spark, inputs, "entities"))]
    first = run_digest(read(), P)
    assert first == run_digest(read(), P)
    assert first != run_digest(read(), Params(as_of=P.as_of, visits_thr=0.7))
    part = next(f for f in os.listdir(f"{inputs}/entities") if f.endswith(".parquet"))
    os.utime(f"{inputs}/entities/{part}", (1, 1))
    assert first != run_digest(read(), P)
    second = run_digest(read(), P)
    monkeypatch.setattr("elastiq.sources.manifest.code_digest", lambda: "other")
    assert second != run_digest(read(), P)


def test_stage_without_marker_or_rows_is_built_again(spark):
    first = Manifest(spark, "half-written")
    df = spark.range(5).withColumn("x", F.array("id"))
    df.write.parquet(f"{first.folder}/numbers/attempt")  # an attempt that was lost before its marker
    assert first.find("numbers") is None
    assert tuples(first(df, "numbers"), "id") == [(k,) for k in range(5)]
    second = Manifest(spark, "half-written")
    assert second(df.filter("id > 3"), "numbers").count() == 5 and second.reused == ["numbers"]
    files.delete(spark, second.path("numbers"))
    third = Manifest(spark, "half-written")
    assert third(df.filter("id > 3"), "numbers").count() == 1 and third.built == ["numbers"]
    third.clear()
    assert Manifest(spark, "half-written").find("numbers") is None


def _failing(spark):
    return spark.range(4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("bigint").alias("id"))


@pytest.fixture(params=["folder", "catalog"])
def target(request, spark, tmp_path):
    if request.param == "folder":
        yield FolderSink(spark, str(tmp_path))
    else:
        spark.sql(f"CREATE SCHEMA sinks LOCATION '{tmp_path}/schema'")
        yield CatalogSink(spark, "sinks")
        spark.sql("DROP SCHEMA sinks CASCADE")


def test_replace_swaps_versions_and_a_failed_write_leaves_the_old_one(spark, target):
    target.replace(spark.range(2), "t")
    open_before = target.read("t")
    target.replace(spark.range(3), "t")
    assert target.read("t").count() == 3 and open_before.count() == 2  # readers of the version before go on
    with pytest.raises(Exception, match="no"):
        target.replace(_failing(spark), "t")
    assert tuples(target.read("t"), "id") == [(0,), (1,), (2,)]
    target.replace(spark.range(1).select("id", F.lit("x").alias("other")), "t")
    assert [tuple(r) for r in target.read("t").collect()] == [(0, "x")]
    target.replace(spark.range(0).select("id", F.lit("x").alias("other")), "t")
    assert target.read("t").isEmpty() and target.read("t").columns == ["id", "other"]


def test_runs_are_appended_once(spark, target):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "v string, n int")
    target.append_run(rows, "history", FIRST)
    target.append_run(rows.filter("n = 2"), "history", SECOND)
    target.append_run(rows, "history", FIRST)  # a retry
    assert tuples(target.read("history"), "v", "run") == [
        ("a", "20240115T000000.000000Z"), ("b", "20240115T000000.000000Z"), ("b", "20240215T000000.000000Z"),
    ]


def test_whole_job_into_a_catalog(spark, inputs, tmp_path):
    spark.sql(f"CREATE SCHEMA results LOCATION '{tmp_path}/schema'")
    try:
        for _ in range(2):
            job.main(["--input", inputs, "--output", "catalog:results", "--as-of", "2024-02-15", "--visits-thr", "0.6", "--orders-thr", "0.6", "--cvr-thr", "0.6"])
        final = spark.table("results.final_list")
        assert tuples(final.filter("is_lb = 'Y'"), "vendor_code") == [("loyal",)]
        assert spark.table("results.history").count() == final.count() == 4
    finally:
        spark.sql("DROP SCHEMA results CASCADE")
