"""Points in polygons as an equi-join on the cells of a quadtree plus an exact test.

A shape is an array of rings, each an array of (x, y); holes and several parts follow the even-odd rule. A point on the boundary is
not inside.

Geometry is planar, which is accurate at city scale, or on the sphere. There, sides are great circles. The sphere is seen
from its centre through the six sides of a cube: on each side great circles are straight lines, and the planar test of
which side of a line a point lies is the sign of the triple product of three directions. So zones and points go to the sides of
the cube (``zones_on_sphere``, ``points_on_sphere``), and all that follows is the same.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from elastiq.functions.numbers import plain_number
from elastiq.functions.skew import lookup_join
from elastiq.sources.staging import stage

# A cell of the quadtree is cut into FANOUT x FANOUT cells of the next level; level 0 has cells of the given size.
FANOUT = 4
LEVELS = 5
# A cell that so few sides reach is not cut further: testing them costs less than more cells.
FEW_SIDES = 16
# A cell is cut further, up to FINER levels below the given size, while its zones together have more sides than this.
MANY_SIDES = 64
FINER = 3
# A cover with no more sides and whole cells than this is looked up from the rows of points themselves, a larger one by distinct places.
FEW_IN_COVER = 200_000


def point_text(lon: Column, lat: Column) -> Column:
    return F.concat(F.lit("POINT("), plain_number(lon), F.lit(" "), plain_number(lat), F.lit(")"))


def _edges(shape: Column) -> Column:
    """All sides of all rings; a ring may or may not repeat its first point at the end."""

    def sides(ring: Column) -> Column:
        def side(p: Column, i: Column) -> Column:
            q = ring[F.pmod(i + 1, F.size(ring))]
            return F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"))

        return F.transform(ring, side)

    return F.flatten(F.transform(shape, sides))


def _turn(e: Column, x: Column, y: Column) -> Column:
    """Positive if the point lies left of the directed side, 0 on its line."""
    return (e["x2"] - e["x1"]) * (y - e["y1"]) - (x - e["x1"]) * (e["y2"] - e["y1"])


def _crossed(e: Column, x: Column, y: Column) -> Column:
    """Does a ray from the point to the right cross this side?"""
    return ((e["y1"] > y) != (e["y2"] > y)) & ((_turn(e, x, y) > 0) == (e["y2"] > e["y1"]))


def _touches(e: Column, x: Column, y: Column) -> Column:
    return (
        (_turn(e, x, y) == 0)
        & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
    )


def inside(edges: Column, x: Column, y: Column) -> Column:
    odd = F.aggregate(edges, F.lit(False), lambda odd, e: odd != _crossed(e, x, y))
    return odd & ~F.exists(edges, lambda e: _touches(e, x, y))


def _size(level: Column | int, cell_size: float) -> Column:
    """Edge of a cell. All are the least one times a power of two, so cells of all levels share their borders exactly."""
    times = F.lit(float(FANOUT) ** level) if isinstance(level, int) else F.pow(F.lit(float(FANOUT)), level)
    return F.lit(float(cell_size)) * times


def _placed(cells: DataFrame, cell: Sequence[str], cell_size: float) -> DataFrame:
    """Cells with the sides beside them, without those outside; ``_cut`` marks those whose sides are still of a larger cell."""
    margin = cell_size * 1e-9
    size = _size(F.col("_level"), cell_size)
    x0, x1 = F.col("_gx") * size - margin, (F.col("_gx") + 1) * size + margin
    y0, y1 = F.col("_gy") * size - margin, (F.col("_gy") + 1) * size + margin

    def beside(e: Column) -> Column:
        return (
            (F.greatest(e["y1"], e["y2"]) >= y0)
            & (F.least(e["y1"], e["y2"]) <= y1)
            & (F.greatest(e["x1"], e["x2"]) >= x0)
        )

    near = F.exists("_edges", lambda e: beside(e) & (F.least(e["x1"], e["x2"]) <= x1))
    centre = inside(F.col("_edges"), (F.col("_gx") + 0.5) * size, (F.col("_gy") + 0.5) * size)
    kept = cells.withColumn("_edges", F.when(F.col("_cut"), F.filter("_edges", beside)).otherwise(F.col("_edges")))
    kept = kept.withColumn("_near", F.when(F.col("_cut"), near).otherwise(F.col("_near")))
    return kept.filter(~F.col("_cut") | F.col("_near") | centre).select(*cell, "_edges", "_near")


def _quartered(cells: DataFrame) -> DataFrame:
    """Cells marked ``_cut`` as FANOUT x FANOUT cells of the next level, the others as they are."""
    parts = F.when(F.col("_cut"), F.sequence(F.lit(0), F.lit(FANOUT * FANOUT - 1))).otherwise(F.array(F.lit(0)))
    at = cells.withColumn("_at", F.explode(parts))
    x, y = F.col("_gx") * FANOUT + F.floor(F.col("_at") / FANOUT), F.col("_gy") * FANOUT + F.col("_at") % FANOUT
    at = at.withColumns({"_gx": F.when(F.col("_cut"), x).otherwise(F.col("_gx")), "_gy": F.when(F.col("_cut"), y).otherwise(F.col("_gy"))})
    return at.withColumn("_level", F.col("_level") - F.col("_cut").cast("int"))


def zone_cells(zones: DataFrame, on: Sequence[str], shape: str, cell_size: float, *, few_sides: int = FEW_SIDES) -> DataFrame:
    """One row per zone and quadtree cell that covers a part of it: ``on``, _level, _gx, _gy, _edges.

    A cell that no side comes near lies wholly inside or outside: the first kind carries no sides and needs no test, the second
    is dropped. Another cell is cut into smaller ones, down to ``cell_size``, unless few sides reach it; it carries only
    the sides a ray from it can meet. So cells are small along the border and large inside, and their number grows
    with the border of a zone, not with its area.

    Zones come in few tasks, often all of a country in one row. They are dealt out by zone before the first cells are
    made, and by zone and cell before cells are cut; a cell takes along only the sides right of its edge.
    """
    parts = int(zones.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    xs, ys = F.flatten(F.col(shape))["x"], F.flatten(F.col(shape))["y"]
    size = _size(F.col("_level"), cell_size)

    def span(low: Column, high: Column) -> Column:
        return F.sequence(F.floor(low / size), F.floor(high / size))

    cell = [*on, "_zone", "_level", "_gx", "_gy"]

    # The first level is the least one at which the zone's box is some four cells wide.
    extent = F.greatest(F.array_max("_xs") - F.array_min("_xs"), F.array_max("_ys") - F.array_min("_ys"))
    first = F.lit(0)
    for k in range(1, LEVELS):
        first = F.when(extent > 4 * _size(k - 1, cell_size), F.lit(k)).otherwise(first)
    roots = (
        zones.withColumn("_zone", F.xxhash64(shape))
        .repartition(parts, *on, "_zone")
        .select(*on, "_zone", _edges(F.col(shape)).alias("_edges"), xs.alias("_xs"), ys.alias("_ys"))
        .filter(F.size("_edges") > 0)
        .withColumn("_level", first)
        .withColumn("_gx", F.explode(span(F.array_min("_xs"), F.array_max("_xs"))))
        .withColumn("_gy", F.explode(span(F.array_min("_ys"), F.array_max("_ys"))))
        .select(*cell, "_edges", F.lit(True).alias("_cut"), F.lit(None).cast("boolean").alias("_near"))
    )
    cells = _placed(roots, cell, cell_size)
    for level in range(LEVELS - 1, 0, -1):
        cut = (F.col("_level") == level) & F.col("_near") & (F.size("_edges") > few_sides)
        if level % 2 == 0:
            cells = cells.repartition(parts, *cell)
        cells = _placed(_quartered(cells.withColumn("_cut", cut)), cell, cell_size)
    return cells.select(*on, "_level", "_gx", "_gy", F.when(F.col("_near"), F.col("_edges")).alias("_edges"))


def covering_cells(cells: DataFrame, on: Sequence[str], cell_size: float, *, many_sides: int = MANY_SIDES) -> tuple[DataFrame, list[int]]:
    """The cells of all zones with the same ``on`` values as one cover, and the levels it has. ``cells`` are staged.

    A point must lie in one zone only, whichever. So a cell that lies wholly inside one zone is kept once, without sides, and all that
    other zones have in it or in cells below it goes. A cell where several zones have borders is cut further while they have more than
    ``many_sides`` sides together: most of its parts lie inside one of them or outside of all but a few. So what a point is tested
    against depends on the zones whose border is near it and on no wider zone around it, and not on the number of zones of the key.

    Levels are worked off from the largest cells to the smallest and each is staged: it is read for the cover, for
    what it hides below and for the cells cut from it.
    """
    key = [*on, "_gx", "_gy"]
    cells = cells.select(*on, "_level", "_gx", "_gy", "_edges")
    own = {r["_level"] for r in cells.select("_level").distinct().collect()}
    cover: dict[int, DataFrame] = {}
    cut = None
    at_cell = Window.partitionBy(*key)
    empty = F.col("_edges").isNull()
    for level in range(max(own, default=0), -FINER - 1, -1):
        here = cut
        if level in own:
            here = cells.filter(F.col("_level") == level)
            for above, whole in cover.items():
                up = whole.filter(empty).select(*key)
                for c in ("_gx", "_gy"):
                    here = here.withColumn(f"_up{c}", F.floor(F.col(c) / FANOUT ** (above - level)))
                up = up.withColumnsRenamed({"_gx": "_up_gx", "_gy": "_up_gy"})
                here = here.join(up, [*on, "_up_gx", "_up_gy"], "left_anti")
            here = here.select(*cells.columns)
            here = here if cut is None else here.unionByName(cut)
        if here is None:
            continue
        counted = here.distinct().withColumns({
            "_whole": F.max(empty).over(at_cell),
            "_zones": F.count(F.lit(1)).over(at_cell),
            "_sides": F.sum(F.coalesce(F.size("_edges"), F.lit(0))).over(at_cell),
        })
        crowded = ~F.col("_whole") & (F.col("_zones") > 1) & (F.col("_sides") > many_sides) & F.lit(level > -FINER)
        kept = counted.filter(~F.col("_whole") | empty).select(*cells.columns, crowded.alias("_cut"))
        kept = stage(kept, "covering_cells")
        cover[level] = kept.filter(~F.col("_cut")).drop("_cut")
        cut = None
        if not (to_cut := kept.filter("_cut")).isEmpty():
            parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            to_cut = to_cut.repartition(parts, *key, F.xxhash64("_edges")).withColumn("_near", F.lit(True))
            smaller = _placed(_quartered(to_cut), ["_level", *key], cell_size)
            cut = smaller.select(*on, "_level", "_gx", "_gy", F.when(F.col("_near"), F.col("_edges")).alias("_edges"))
    return (reduce(DataFrame.unionByName, cover.values()) if cover else cells), sorted(cover)


def points_in_zones(
    points: DataFrame,
    cells: DataFrame,
    on: Sequence[str],
    cell_size: float,
    *,
    lon: str = "lon",
    lat: str = "lat",
    few: int = FEW_IN_COVER,
) -> DataFrame:
    """The rows of ``points`` inside at least one zone with the same ``on`` values, each kept once.

    ``cells`` are the staged cells of the zones at the same ``cell_size``. If the cover made of them is small, every row is looked up in
    it, once per level that it has, and no row is shuffled. Otherwise each distinct place is looked up, at every
    level, without the other columns of its rows; then rows are kept by place.
    """
    cover, levels = covering_cells(cells, on, cell_size)
    weight = F.sum(F.coalesce(F.size("_edges"), F.lit(1)))
    if levels and (cover.agg(weight).first()[0] or 0) <= few:
        return _rows_in_cover(points, cover, levels, on, cell_size, lon, lat)
    x, y = F.col("_x"), F.col("_y")
    places = points.select(*on, F.col(lon).cast("double").alias("_x"), F.col(lat).cast("double").alias("_y"))
    places = places.filter(x.isNotNull() & y.isNotNull()).distinct().withColumn("_level", F.explode(F.array(*[F.lit(k) for k in levels])))
    size = _size(F.col("_level"), cell_size)
    gridded = places.withColumn("_gx", F.floor(x / size)).withColumn("_gy", F.floor(y / size))
    exact = F.col("_edges").isNull() | inside(F.col("_edges"), x, y)
    found = lookup_join(gridded, cover, [*on, "_level", "_gx", "_gy"], "left_semi", exact).select(*on, "_x", "_y").distinct()
    keyed = points.withColumn("_x", F.col(lon).cast("double")).withColumn("_y", F.col(lat).cast("double"))
    return lookup_join(keyed, found, [*on, "_x", "_y"], "left_semi").select(*points.columns)


def _rows_in_cover(points: DataFrame, cover: DataFrame, levels: Sequence[int], on: Sequence[str], cell_size: float, lon: str, lat: str) -> DataFrame:
    """Rows of points in a small cover. A cell is one row with the sides of its zones, so a lookup never multiplies rows."""
    cell = [*on, "_gx", "_gy"]
    grouped = stage(cover.groupBy("_level", *cell).agg(F.collect_list("_edges").alias("_zones")), "cover")
    x, y = F.col(lon).cast("double"), F.col(lat).cast("double")
    rows = points.filter(x.isNotNull() & y.isNotNull())
    for level in levels:
        size = _size(level, cell_size)
        here = grouped.filter(F.col("_level") == level).drop("_level").withColumnRenamed("_zones", f"_zones{level}")
        placed = rows.withColumns({"_gx": F.floor(x / size), "_gy": F.floor(y / size)})
        rows = lookup_join(placed, here, cell, "left").drop("_gx", "_gy")
    # All levels are tested at once after the last lookup. A cell that lies wholly inside a zone has no sides.
    zones = [F.col(f"_zones{level}") for level in levels]
    empty = reduce(or_, [F.coalesce(F.size(z) == 0, F.lit(False)) for z in zones])
    tested = F.exists(F.concat(*[F.coalesce(z, F.array()) for z in zones]), lambda edges: inside(edges, x, y))
    met = rows.filter(reduce(or_, [z.isNotNull() for z in zones]))
    return met.filter(empty | tested).select(*points.columns)


def _direction(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    a, b = F.radians(lon), F.radians(lat)
    return F.cos(b) * F.cos(a), F.cos(b) * F.sin(a), F.sin(b)


def _on_side(side: int, d: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """Height over the centre and the two coordinates on a side of the cube; sides 0 to 2 face along the axes, 3 to 5 against them."""
    axis, sign = side % 3, 1 if side < 3 else -1
    height = d[axis] * sign
    return height, d[(axis + 1) % 3] / height, d[(axis + 2) % 3] / height


# A zone must lie in the half of the sphere that a side of the cube faces, if it reaches the side at all.
WIDEST_ZONE = 30.0


def zones_on_sphere(zones: DataFrame, shape: str) -> DataFrame:
    """Each zone on each side of the cube that it may reach: ``_side``, and ``shape`` in coordinates of the side.

    Sides of the zone are great circles; the zone is the part of the sphere that is less than half of it, also across the date line or
    around a pole. A zone with a corner more than 30 degrees from its first one is an error.
    """
    def shape_on(side: int) -> Column:
        def corner(p: Column) -> Column:
            height, u, v = _on_side(side, _direction(p["x"], p["y"]))
            return F.when(height > 1e-9, F.struct(u.alias("x"), v.alias("y")))

        return F.transform(F.col(shape), lambda ring: F.transform(ring, corner))

    corners = F.flatten(F.col(shape))
    first = _direction(corners[0]["x"], corners[0]["y"])
    apart = F.exists(
        corners,
        lambda p: reduce(lambda a, b: a + b, [c * d for c, d in zip(_direction(p["x"], p["y"]), first)]) < math.cos(math.radians(WIDEST_ZONE)),
    )
    checked = F.when(apart, F.raise_error(F.lit(f"a zone is wider than {WIDEST_ZONE} degrees"))).otherwise(F.lit(True))
    sides = F.array(*[F.struct(F.lit(k).alias("side"), shape_on(k).alias("shape")) for k in range(6)])
    points = F.flatten("_s.shape")
    seen = ~F.exists(points, lambda p: p.isNull())
    edge = 1 + 1e-9
    reaches = (F.array_min(points["x"]) <= edge) & (F.array_max(points["x"]) >= -edge)
    reaches = reaches & (F.array_min(points["y"]) <= edge) & (F.array_max(points["y"]) >= -edge)
    on_sides = zones.filter(checked).withColumn("_s", F.explode(sides)).filter(seen & reaches)
    kept = [F.col("_s.shape").alias(shape) if c == shape else F.col(c) for c in zones.columns]
    return on_sides.select(*kept, F.col("_s.side").alias("_side"))


def points_on_sphere(points: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Add ``_side``, ``_u`` and ``_v``: the side of the cube that a point lies on and where; null for a point without coordinates."""
    d = _direction(F.col(lon).cast("double"), F.col(lat).cast("double"))
    farthest = F.greatest(*[F.abs(c) for c in d])
    side, u, v = F.lit(None).cast("int"), F.lit(None).cast("double"), F.lit(None).cast("double")
    for k in reversed(range(6)):
        height, a, b = _on_side(k, d)
        here = height == farthest
        side, u, v = F.when(here, k).otherwise(side), F.when(here, a).otherwise(u), F.when(here, b).otherwise(v)
    return points.withColumns({"_side": side, "_u": u, "_v": v})


def points_in_zones_on_sphere(points: DataFrame, cells: DataFrame, on: Sequence[str], cell_size: float, *, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """``points_in_zones`` for the cells of ``zones_on_sphere``, at a cell size in units of a side (about 57 degrees)."""
    placed = points_on_sphere(points, lon, lat)
    return points_in_zones(placed, cells, [*on, "_side"], cell_size, lon="_u", lat="_v").drop("_side", "_u", "_v")
