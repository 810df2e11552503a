import datetime as dt
import itertools
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import tuples
from elastiq.functions import skew
from elastiq.functions.checks import repeated_keys
from elastiq.functions.geo import MANY_SIDES, covering_cells, inside, point_text, points_in_zones, points_in_zones_on_sphere, zone_cells, zones_on_sphere
from elastiq.functions.numbers import plain_number, ratio
from elastiq.functions.ranks import percent_ranks, value_ranks
from elastiq.functions.skew import null_lane, salted_join, with_totals
from elastiq.params import Params
from elastiq.sources.staging import shared_folder, stage


def test_window_is_the_last_full_month():
    assert Params(as_of=dt.date(2024, 2, 15)).window == (dt.date(2024, 1, 1), dt.date(2024, 1, 31))
    assert Params(as_of=dt.date(2024, 3, 31)).window == (dt.date(2024, 2, 1), dt.date(2024, 2, 29))
    assert Params(as_of=dt.date(2024, 1, 1)).window == (dt.date(2023, 12, 1), dt.date(2023, 12, 31))


def test_numbers(spark):
    df = spark.createDataFrame([(1.0, 4.0), (1.0, 0.0), (0.00001, None), (100.0, 8.0)], "a double, b double")
    assert [r[0] for r in df.select(ratio(F.col("a"), F.col("b"), 3)).collect()] == [0.25, None, None, 12.5]
    assert [r[0] for r in df.select(plain_number(F.col("a"))).collect()] == ["1", "1", "0.00001", "100"]
    assert df.select(point_text(F.lit(5.5), F.lit(-51.0))).first()[0] == "POINT(5.5 -51)"


def _facts(spark):
    """Two thirds of all rows on one key, and rows without a key."""
    rows = [("hot", i) for i in range(200)] + [(f"k{i % 7}", i) for i in range(80)] + [(None, i) for i in range(20)]
    return spark.createDataFrame(rows, "k string, v long")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_salted_join_equals_plain_join(spark, how, broadcast):
    dim = spark.createDataFrame([("hot", 1), ("k1", 2), ("k1", 3), (None, 4)], "k string, d int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        facts = _facts(spark)
        salted = salted_join(facts, dim, ["k"], how, ["v"])
        assert tuples(salted, *salted.columns) == tuples(facts.join(dim, "k", how), *salted.columns)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
@pytest.mark.parametrize("how", ["inner", "left_semi"])
def test_lookup_join_leaves_the_choice_to_spark(spark, how, broadcast):
    dim = spark.createDataFrame([("hot", 1), ("k1", 2), ("k1", 3), (None, 4)], "k string, d int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        facts = _facts(spark)
        joined = skew.lookup_join(facts, dim, ["k"], how)
        assert tuples(joined, *joined.columns) == tuples(facts.join(dim, "k", how), *joined.columns)
        small = skew.lookup_join(facts, dim, ["k"], how, F.col("d") > F.col("v"))
        expected = facts.join(dim, "k").filter("d > v")
        if how == "left_semi":
            expected = expected.select("k", "v").distinct()
        assert tuples(small, "k", "v") == tuples(expected, "k", "v")
        assert "Hint" not in joined._jdf.queryExecution().logical().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_salts_follow_the_shuffle_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert skew.salts_of(_facts(spark)) == max(8, int(before))
    spark.conf.set("spark.sql.shuffle.partitions", "500")
    try:
        assert skew.salts_of(_facts(spark)) == 500
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("parts", [200, 2000])
def test_only_hot_keys_are_repeated(spark, parts):
    facts = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    dim = facts.select("k").distinct()
    hot = skew.hot_keys(facts, ["k"], parts)
    assert hot.collect() == facts.filter("k = -1").select(F.xxhash64("k")).distinct().collect()
    left, right = skew._salted(facts, dim.withColumnRenamed("k", "_on_k"), ["k"], hot, ["v"], parts)
    assert right.count() == dim.count() - 1 + parts  # the one hot key, repeated; all others as they are
    assert left.filter("k = -1").select("_salt").distinct().count() > parts * 0.9
    assert left.filter("k <> -1 AND _salt <> 0").isEmpty() and left.count() == facts.count()
    joined = salted_join(facts, dim.withColumn("d", F.col("k") + 1), ["k"], "inner", ["v"], salts=parts)
    assert joined.filter("d = k + 1").count() == facts.count()


def test_salted_join_can_match_nulls(spark):
    dim = spark.createDataFrame([("hot", 1), (None, 4)], "k string, d int")
    joined = salted_join(_facts(spark), dim, ["k"], "inner", ["v"], null_safe=True)
    assert tuples(joined.groupBy("k").count(), "k", "count") == [("hot", 200), (None, 20)]


def test_totals_equal_window_sums(spark):
    from pyspark.sql import Window

    facts = _facts(spark)
    totals = with_totals(facts, ["k"], [F.sum("v").alias("t")])
    window = facts.withColumn("t", F.sum("v").over(Window.partitionBy("k")))
    assert tuples(totals, "k", "v", "t") == tuples(window, "k", "v", "t")


def test_rows_without_a_key_are_spread(spark):
    lanes = _facts(spark).withColumn("lane", null_lane(["k"], ["v"]))
    assert lanes.filter("k IS NOT NULL").select("lane").distinct().collect() == [(0,)]
    spread = lanes.filter("k IS NULL").select("lane").distinct().collect()
    assert len(spread) > 10 and (0,) not in spread


def test_salts_do_not_change_between_runs(spark):
    lanes = _facts(spark).withColumn("lane", null_lane(["k"], ["v"]))
    assert tuples(lanes, "k", "v", "lane") == tuples(lanes.repartition(3), "k", "v", "lane")


def test_percent_ranks_of_five(spark):
    df = spark.createDataFrame([("a", "x", i) for i in range(1, 6)] + [("b", "x", 9)], "g string, id string, n int")
    for parts in (1, 40):
        ranked = percent_ranks(df, ["g"], {"r": "n"}, parts=parts)
        assert tuples(ranked, "g", "n", "r") == [
            ("a", 1, 0.0), ("a", 2, 0.25), ("a", 3, 0.5), ("a", 4, 0.75), ("a", 5, 1.0), ("b", 9, 0.0),
        ]


def _window_ranks(df, metrics):
    from pyspark.sql import Window

    for out, value in metrics.items():
        df = df.withColumn(out, F.round(F.percent_rank().over(Window.partitionBy("g").orderBy(value)), 4))
    return df


@settings(max_examples=6, deadline=None)
@given(
    st.lists(
        st.tuples(
            st.sampled_from(["a", "b", None]),
            st.one_of(st.integers(0, 10**6), st.sampled_from([0, 1, 5, None])),
            st.floats(-3, 3),
        ),
        min_size=1,
        max_size=60,
    ),
    st.integers(1, 30),
)
def test_ranks_equal_window_ranks(spark, rows, parts):
    data = [(g, str(i), n, round(x, 5)) for i, (g, n, x) in enumerate(rows)]
    df = spark.createDataFrame(data, "g string, id string, n long, x double")
    metrics = {"rn": "n", "rx": "x"}
    out = tuples(percent_ranks(df, ["g"], metrics, parts=parts), "id", "rn", "rx")
    assert out == tuples(_window_ranks(df, metrics), "id", "rn", "rx")


def test_a_group_with_most_rows_is_ranked_in_many_tasks(spark):
    df = spark.range(20_000).select(
        F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"),
        F.col("id").cast("string").alias("id"),
        F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 5000).alias("n"),
    )
    parts = 16
    ranks = value_ranks(df, ["g"], ["n"], parts=parts)
    # The values of the hot group lie in nearly all partitions, and none of them is twice there.
    assert ranks.filter("g = 'hot'").count() == df.filter("g = 'hot'").select("n").distinct().count()
    ranged = df.groupBy("g", "n").count().repartitionByRange(parts, "g", "n").withColumn("part", F.spark_partition_id())
    assert ranged.filter("g = 'hot'").select("part").distinct().count() > parts // 2
    metrics = {"r": "n"}
    assert tuples(percent_ranks(df, ["g"], metrics, parts=parts), "id", "r") == tuples(_window_ranks(df, metrics), "id", "r")


SQUARE = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]]
OPEN_RING = [[(10.0, 0.0), (13.0, 0.0), (10.0, 3.0)]]
WITH_HOLE = [SQUARE[0], [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0), (1.0, 1.0)]]
SHAPE = "array<array<struct<x:double,y:double>>>"


def _points_inside(spark, shapes, points, cell_size):
    zones = spark.createDataFrame([("e", s) for s in shapes], f"e string, shape {SHAPE}")
    pts = spark.createDataFrame([("e", x, y) for x, y in points], "e string, lon double, lat double")
    cells = zone_cells(zones, ["e"], "shape", cell_size)
    return tuples(points_in_zones(pts, cells, ["e"], cell_size), "lon", "lat")


@pytest.mark.parametrize("cell_size", [0.3, 1.0, 50.0])
def test_points_in_zones(spark, cell_size):
    points = [(2.0, 2.0), (0.5, 0.5), (5.0, 5.0), (0.0, 2.0), (4.0, 4.0), (11.0, 1.0), (11.5, 1.5), (12.0, 2.0), (None, 1.0)]
    assert _points_inside(spark, [SQUARE, SQUARE], points, cell_size) == [(0.5, 0.5), (2.0, 2.0)]
    assert _points_inside(spark, [WITH_HOLE], points, cell_size) == [(0.5, 0.5)]
    assert _points_inside(spark, [WITH_HOLE], [(1.0, 2.0), (3.5, 2.0)], cell_size) == [(3.5, 2.0)]
    assert _points_inside(spark, [OPEN_RING], points, cell_size) == [(11.0, 1.0)]
    assert _points_inside(spark, [[]], points, cell_size) == []


def test_grid_agrees_with_the_exact_test(spark):
    star = [[(0.0, 0.0), (5.0, 1.0), (9.0, -2.0), (7.0, 3.0), (10.0, 7.0), (5.0, 5.0), (1.0, 8.0), (3.0, 3.5)]]
    points = [(x / 3, y / 3) for x, y in itertools.product(range(-3, 33), range(-9, 27))]
    zones = spark.createDataFrame([(star,)], f"shape {SHAPE}")
    from elastiq.functions.geo import _edges

    pts = spark.createDataFrame(points, "x double, y double")
    exact = pts.crossJoin(zones.select(_edges(F.col("shape")).alias("e"))).filter(inside(F.col("e"), F.col("x"), F.col("y")))
    assert _points_inside(spark, [star], points, 0.7) == tuples(exact, "x", "y")


def test_clean_cells_carry_no_sides(spark):
    zones = spark.createDataFrame([("e", SQUARE)], f"e string, shape {SHAPE}")
    cells = zone_cells(zones, ["e"], "shape", 0.25, few_sides=0)
    area = lambda where: cells.filter(where).agg(F.sum(F.pow(F.lit(0.0625), F.lit(1)) * F.pow(F.lit(16), F.col("_level")))).first()[0]
    assert area("_edges IS NULL") == pytest.approx(14 * 14 * 0.0625)  # all but a rim of one of the smallest cells
    assert cells.filter("_edges IS NULL AND _level > 0").count() > 0
    assert cells.filter("_edges IS NOT NULL").agg(F.max("_level"), F.max(F.size("_edges"))).first() == (0, 4)
    few = zone_cells(zones, ["e"], "shape", 0.25)
    assert few.filter("_level = 0").isEmpty() and few.count() <= 25  # a square is tested as it is


def _circle(x, y, radius, corners):
    return [[(x + radius * math.cos(2 * math.pi * k / corners), y + radius * math.sin(2 * math.pi * k / corners)) for k in range(corners)]]


def test_cells_grow_with_the_border_of_a_zone_not_with_its_area(spark):
    n = {}
    for radius in (1.0, 4.0, 16.0):
        zones = spark.createDataFrame([("e", _circle(50.0, 20.0, radius, 200))], f"e string, shape {SHAPE}")
        n[radius] = zone_cells(zones, ["e"], "shape", 0.05, few_sides=2).count()
    assert n[4.0] < 6 * n[1.0] and n[16.0] < 6 * n[4.0]  # the area grows sixteenfold
    default = zone_cells(zones, ["e"], "shape", 0.05).count()
    assert default < 2000 and default < n[16.0] / 5


def test_one_zone_a_thousand_times_the_size_of_the_others(spark):
    shapes = [_circle(0.1 * k, 0.0, 0.01, 12) for k in range(20)] + [_circle(0.0, 0.0, 10.0, 400)]
    points = [(x / 4, y / 4) for x, y in itertools.product(range(-45, 46, 3), repeat=2)] + [(0.1 * k, 0.001) for k in range(20)]
    points = [p for p in points if not 9.99 < math.hypot(*p) < 10.01]
    got = _points_inside(spark, shapes, points, 0.02)
    assert got == sorted(((x, y) for x, y in points if math.hypot(x, y) < 9.99), key=repr)


def _boxes(n):
    r = random.Random(5)
    corners = [(r.uniform(0, 9), r.uniform(0, 10)) for _ in range(n)]
    return [[[(x, y), (x + 3, y), (x + 3, y + 2), (x, y + 2)]] for x, y in corners]


def test_a_cover_hardly_grows_with_the_zones_that_lie_over_each_other(spark):
    """All zones differ and none hides another; a cell still carries few sides, and the cover no more cells."""
    cells = {}
    for n in (60, 600):
        zones = spark.createDataFrame([("e", s) for s in _boxes(n)], f"e string, shape {SHAPE}")
        cover, levels = covering_cells(stage(zone_cells(zones, ["e"], "shape", 0.5), "cells"), ["e"], 0.5)
        at_cell = cover.groupBy("_level", "_gx", "_gy").agg(F.sum(F.coalesce(F.size("_edges"), F.lit(0))).alias("sides"), F.count("*").alias("n"))
        at_cell = stage(at_cell, "at_cell")
        cells[n] = at_cell.agg(F.sum("n")).first()[0]
        assert sorted(r[0] for r in at_cell.select("_level").distinct().collect()) == levels
        assert at_cell.filter(f"_level >= 0 and sides > {MANY_SIDES} and n > 1").isEmpty()
    assert cells[600] < 6 * cells[60]  # ten times the zones: only the rim of all is cut finer


def test_zones_over_each_other_agree_with_the_exact_test(spark):
    shapes = [*_boxes(150), *_boxes(40), WITH_HOLE, SQUARE, _circle(6.0, 6.0, 7.0, 90)]
    points = [(x / 7, y / 7) for x, y in itertools.product(range(-12, 100, 3), repeat=2)]
    within = lambda x, y, ring: sum(
        (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1])
    )
    expected = [(x, y) for x, y in points if any(sum(within(x, y, ring) for ring in s) % 2 for s in shapes[:-3] + shapes[-1:])]
    assert _points_inside(spark, shapes[:-3] + shapes[-1:], points, 0.5) == sorted(expected, key=repr)
    # a hole is filled by a zone over it, at any size of cells
    assert _points_inside(spark, [WITH_HOLE, SQUARE], [(2.0, 2.0), (1.0, 1.0), (4.0, 1.0)], 0.5) == [(1.0, 1.0), (2.0, 2.0)]


def test_rows_in_a_small_cover_are_kept_without_a_shuffle_and_are_the_same_by_place(spark):
    """Every row is kept once, with repeats, whichever way the cover is looked up, and at several levels of cells."""
    shapes = [*_boxes(60), WITH_HOLE, _circle(6.0, 6.0, 7.0, 90)]
    zones = spark.createDataFrame([("e", s) for s in shapes], f"e string, shape {SHAPE}")
    cells = stage(zone_cells(zones, ["e"], "shape", 0.5), "cells")
    places = [(x / 7, y / 7) for x, y in itertools.product(range(-20, 110, 5), repeat=2)] + [(None, 1.0), (1.0, None)]
    rows = [(e, n, x, y) for n, (x, y) in enumerate(places * 2) for e in ("e", "other", None)]
    points = stage(spark.createDataFrame(rows, "e string, n int, lon double, lat double"), "points")
    at_once = points_in_zones(points, cells, ["e"], 0.5)
    by_place = points_in_zones(points, cells, ["e"], 0.5, few=0)
    assert at_once.columns == points.columns and len(covering_cells(cells, ["e"], 0.5)[1]) > 1
    kept = tuples(at_once, "e", "n", "lon", "lat")
    assert kept == tuples(by_place, "e", "n", "lon", "lat") and 0 < len(kept) < len(rows) / 3
    plan = at_once._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def _winding(point, ring):
    """Turns of a ring seen from a point of the unit sphere."""

    def direction(lon, lat):
        a, b = math.radians(lon), math.radians(lat)
        return (math.cos(b) * math.cos(a), math.cos(b) * math.sin(a), math.sin(b))

    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    cross = lambda a, b: (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
    p, corners = direction(*point), [direction(*c) for c in ring]
    total = sum(math.atan2(dot(p, cross(a, b)), dot(a, b) - dot(a, p) * dot(b, p)) for a, b in zip(corners, corners[1:] + corners[:1]))
    return round(total / (2 * math.pi)) if dot(p, corners[0]) > 0 else 0


def _inside_on_sphere(spark, shapes, points, cell_size=0.01):
    zones = zones_on_sphere(spark.createDataFrame([("e", s) for s in shapes], f"e string, shape {SHAPE}"), "shape")
    cells = zone_cells(zones, ["e", "_side"], "shape", cell_size)
    pts = spark.createDataFrame([("e", x, y) for x, y in points], "e string, lon double, lat double")
    return tuples(points_in_zones_on_sphere(pts, cells, ["e"], cell_size), "lon", "lat")


ON_SPHERE = {
    "date line": [(178.0, -2.0), (-177.0, -2.0), (-177.0, 3.0), (178.0, 3.0)],
    "long northern side": [(0.0, 60.0), (28.0, 60.0), (28.0, 62.0), (0.0, 62.0)],
    "pole": [(0.0, 82.0), (90.0, 84.0), (180.0, 82.0), (-90.0, 85.0)],
    "corner of the cube": [(40.0, 30.0), (52.0, 31.0), (50.0, 40.0), (39.0, 41.0)],
}


@pytest.mark.parametrize("name", sorted(ON_SPHERE))
def test_zones_on_the_sphere(spark, name):
    ring = ON_SPHERE[name]
    r = random.Random(7)
    points = [((lon + r.uniform(-4, 4) + 540) % 360 - 180, min(90.0, lat + r.uniform(-4, 4))) for lon, lat in ring for _ in range(120)]
    points += [(r.uniform(-180, 180), r.uniform(-90, 90)) for _ in range(100)] + [(None, 1.0), (180.0, 0.0), (-180.0, 0.0), (14.0, 60.5), (14.0, 62.3)]
    known = [p for p in points if p[0] is not None]
    expected = sorted((p for p in known if _winding(p, ring)), key=repr)
    assert _inside_on_sphere(spark, [[ring]], points) == expected and expected
    if name == "long northern side":
        # A great circle between two places of one latitude runs north of it.
        assert (14.0, 60.5) not in expected and (14.0, 62.3) in expected
    if name == "date line":
        assert (180.0, 0.0) in expected and (-180.0, 0.0) in expected


def test_sphere_and_plane_agree_for_a_small_zone_and_wide_ones_are_refused(spark):
    star = [[(0.0, 0.0), (0.05, 0.01), (0.09, -0.02), (0.07, 0.03), (0.1, 0.07), (0.05, 0.05), (0.01, 0.08), (0.03, 0.035)]]
    points = [(x / 301, y / 301) for x, y in itertools.product(range(-3, 33, 2), range(-9, 27, 2))]
    assert _inside_on_sphere(spark, [star], points, 0.0001) == _points_inside(spark, [star], points, 0.005)
    with pytest.raises(Exception, match="wider than 30"):
        _inside_on_sphere(spark, [[[(0.0, 0.0), (40.0, 0.0), (0.0, 10.0)]]], points)


def test_repeated_keys(spark):
    assert tuples(repeated_keys(_facts(spark).filter("v < 2"), ["k"]), "k", "count") == [("hot", 2), (None, 2)]


def test_stage_writes_to_the_shared_folder(spark):
    staged = stage(_facts(spark), "facts")
    assert staged.count() == 300
    assert all(f.startswith("file:") and shared_folder(spark) in f for f in staged.inputFiles())


def test_zones_of_one_country_are_gridded_in_many_tasks(spark):
    """All zones in one row, as a country comes: cells come out of several tasks, none with more than half of them."""
    square = lambda x: [[(x, 0.0), (x + 1, 0.0), (x + 1, 1.0), (x, 1.0)]]
    row = spark.createDataFrame([("e", [square(float(k)) for k in range(60)])], f"e string, zones array<{SHAPE}>").coalesce(1)
    cells = zone_cells(row.select("e", F.explode("zones").alias("shape")), ["e"], "shape", 0.1, few_sides=0)
    per_task = [r["n"] for r in cells.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(per_task) > 1 and max(per_task) < 0.5 * sum(per_task) * 1.2
    assert sum(per_task) >= 60 * 40
