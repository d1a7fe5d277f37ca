"""Cells against polygons, without a geometry library and without a join of every cell with every edge.

Both the covered area and the clipped outline of a cell follow from the polygon's edges cut at the grid
lines.  Edges meet grid rows and columns through an equi-join on bins one spacing wide, so an edge produces
rows only for the grid lines it crosses; cells in the interior are filled in from running sums.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isohyet.operators.grid import Grid
from isohyet.operators.rings import PARTS, outline, parts_of

# Covered shares below this are rounding noise of the edge sums.
NOISE = 1e-9
# Further out than any coordinate.
FAR = 1e6
# Degrees between a line and an edge on it.
TOUCH = 1e-9


def _between(value: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(value, low), high)


def _at(a: Column, b: Column, share_of: Column, start: Column, end: Column) -> Column:
    """The point on a..b where the other coordinate, running start..end, reaches ``share_of``."""
    return (
        F.when(share_of == start, a).when(share_of == end, b).otherwise(a + (b - a) * ((share_of - start) / (end - start)))
    )


def interval_join(
    left: DataFrame, low: Column, high: Column, axis: DataFrame, name: str, width: float, start: float, end: float
) -> DataFrame:
    """Join rows with the axis intervals ``[name_lo, name_hi]`` that their ``[low, high]`` meets or touches.

    Equi-join on bins of ``width``, the mean interval, from one bin before ``start`` to one after ``end``;
    whatever lies further out counts as the outermost bin.  A pair can share several bins; it is kept in
    the first of them only.
    """
    outer = (F.lit(math.floor(start / width) - 1), F.lit(math.floor(end / width) + 1))

    def bin_of(value: Column) -> Column:
        return _between(F.floor(value / width), *outer)

    lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
    left = left.withColumns({"_first": bin_of(low), "_last": bin_of(high)})
    left = left.withColumn("_bin", F.explode(F.sequence("_first", "_last")))
    right = axis.withColumn("_start", bin_of(lo))
    right = right.withColumn("_bin", F.explode(F.sequence("_start", bin_of(hi))))
    met = (low <= hi) & (high >= lo) & (F.col("_bin") == F.greatest("_first", "_start"))
    return left.join(right, "_bin").filter(met).drop("_bin", "_first", "_last", "_start")


def _in_rows(edges: DataFrame, grid: Grid) -> DataFrame:
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    return interval_join(edges, low, high, grid.rows, "lat", grid.row_height, grid.south, grid.north)


def _in_columns(edges: DataFrame, grid: Grid, columns: DataFrame | None = None) -> DataFrame:
    low, high = F.least("ax", "bx"), F.greatest("ax", "bx")
    axis = grid.columns if columns is None else columns
    return interval_join(edges, low, high, axis, "lon", grid.col_width, grid.west, grid.east)


def _clip_to_rows(edges: DataFrame, grid: Grid) -> DataFrame:
    """Edges cut at row boundaries; level edges keep one piece in each row they lie inside of."""
    ay, by = F.col("ay"), F.col("by")
    met = _in_rows(edges, grid)
    lo, hi = F.col("lat_lo"), F.col("lat_hi")
    crossing = (F.least(ay, by) < hi) & (F.greatest(ay, by) > lo)
    ca, cb = _between(ay, lo, hi), _between(by, lo, hi)
    return met.filter(crossing).withColumns({
        "ax": _at(F.col("ax"), F.col("bx"), ca, ay, by), "bx": _at(F.col("ax"), F.col("bx"), cb, ay, by),
        "ay": ca, "by": cb,
    })


def _clip_to_columns(edges: DataFrame, grid: Grid) -> DataFrame:
    """Edges cut at column boundaries, likewise."""
    ax, bx = F.col("ax"), F.col("bx")
    met = _in_columns(edges, grid)
    lo, hi = F.col("lon_lo"), F.col("lon_hi")
    crossing = (F.least(ax, bx) < hi) & (F.greatest(ax, bx) > lo)
    ca, cb = _between(ax, lo, hi), _between(bx, lo, hi)
    return met.filter(crossing).withColumns({
        "ay": _at(F.col("ay"), F.col("by"), ca, ax, bx), "by": _at(F.col("ay"), F.col("by"), cb, ax, bx),
        "ax": ca, "bx": cb,
    })


def cell_area(grid: Grid, area_edges: DataFrame, spherical: bool = False) -> DataFrame:
    """Cells x areas -> ``cell_area(cell_id, area, weight)``.

    The weight is the intersection area in square degrees, times cos(latitude) where ``spherical``.  Cells
    that an area does not cover get no row, so an area too small for the grid has none at all.

    By Green's theorem the area inside a cell is the integral of (x - west side) dy over the polygon's
    boundary within the cell's row, x held to the cell.  Boundary inside the cell contributes directly;
    boundary further east contributes the full width.  The latter is a running sum from the east.
    """
    banded = _clip_to_rows(area_edges.select("area", "ax", "ay", "bx", "by"), grid).select(
        "area", "row", "ax", "ay", "bx", "by"
    )
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    rise = by - ay

    # The land beyond the grid's sides counts as one more column each: boundary there has no cell of its own,
    # but it bounds the cells in between.
    beyond = [(-1, -FAR, grid.west), (grid.last_col + 1, grid.east, FAR)]
    columns = grid.columns.unionByName(
        area_edges.sparkSession.createDataFrame(beyond, "col bigint, lon_lo double, lon_hi double")
    )
    lo, hi = F.col("lon_lo"), F.col("lon_hi")
    met = _in_columns(banded, grid, columns)
    ca, cb = _between(ax, lo, hi), _between(bx, lo, hi)
    upright = ax == bx
    # An upright edge on a grid line belongs to the column east of it.
    part = F.when(upright, F.when((ax >= lo) & (ax < hi), rise).otherwise(0.0)).otherwise(rise * (cb - ca) / (bx - ax))
    events = (
        met.select("area", "row", "col", part.alias("turn"), (((ca - lo) + (cb - lo)) / 2.0 * part).alias("inside"))
        .groupBy("area", "row", "col")
        .agg(F.sum("turn").alias("turn"), F.sum("inside").alias("inside"))
    )
    from_east = Window.partitionBy("area", "row").orderBy(F.col("col").desc())
    swept = events.withColumns({
        "height": F.coalesce(
            F.sum("turn").over(from_east.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)
        ),
        "next_col": F.lag("col").over(from_east),
    })
    own = F.struct(F.col("col").alias("col"), F.col("inside").alias("inside"), F.col("height").alias("height"))
    between = F.transform(
        F.when(F.col("next_col") > F.col("col") + 1, F.sequence(F.col("col") + 1, F.col("next_col") - 1)).otherwise(
            F.array().cast("array<bigint>")
        ),
        lambda c: F.struct(c.alias("col"), F.lit(0.0).alias("inside"), F.col("height").alias("height")),
    )
    covered = swept.select("area", "row", F.explode(F.concat(F.array(own), between)).alias("c")).select(
        "area", "row", "c.col", "c.inside", "c.height"
    )
    placed = grid.cells.select(
        "cell_id", "lat", "row", "col", (F.col("lat_hi") - F.col("lat_lo")).alias("tall"),
        (F.col("lon_hi") - F.col("lon_lo")).alias("wide"),
    )
    size = F.col("inside") + F.col("wide") * F.col("height")
    factor = F.cos(F.radians("lat")) if spherical else F.lit(1.0)
    return (
        covered.join(placed, ["row", "col"])
        .withColumn("size", size)
        .filter(F.col("size") > NOISE * F.col("tall") * F.col("wide"))
        .select("cell_id", "area", (F.col("size") * factor).alias("weight"))
    )


def touched_cells(grid: Grid, area_edges: DataFrame, weights: DataFrame) -> DataFrame:
    """``(cell_id, area)`` of every cell that an area covers or whose closed box its boundary meets, if only at a line.

    Edges meet rows, and what is left of them in a row meets columns, both ends included and ``TOUCH`` degrees more;
    cells inside an area are those with a weight.
    """
    edges = area_edges.select("area", "ax", "ay", "bx", "by")
    low, high = F.least("ay", "by") - TOUCH, F.greatest("ay", "by") + TOUCH
    rows = interval_join(edges, low, high, grid.rows, "lat", grid.row_height, grid.south, grid.north)
    at = [_between(F.col(c), F.col("lat_lo"), F.col("lat_hi")) for c in ("ay", "by")]
    level = F.col("ay") == F.col("by")
    ends = [F.when(level, F.col(x)).otherwise(_at(F.col("ax"), F.col("bx"), y, F.col("ay"), F.col("by"))) for x, y in zip(("ax", "bx"), at)]
    pieces = rows.select("area", "row", F.least(*ends).alias("from"), F.greatest(*ends).alias("to"))
    met = interval_join(pieces, F.col("from") - TOUCH, F.col("to") + TOUCH, grid.columns, "lon", grid.col_width, grid.west, grid.east)
    on_boundary = met.select("area", "row", "col").distinct().join(grid.cells.select("cell_id", "row", "col"), ["row", "col"])
    return on_boundary.select("cell_id", "area").unionByName(weights.select("cell_id", "area")).distinct()


def clip(obs: DataFrame, weights: DataFrame, area: str | None = None) -> DataFrame:
    """Rows of the cells that any area (or one area) covers."""
    if area is not None:
        weights = weights.filter(F.col("area") == area)
    return obs.join(weights.select("cell_id"), "cell_id", "left_semi")


def uncovered_areas(area_edges: DataFrame, weights: DataFrame) -> DataFrame:
    """Areas without a single cell; they produce no output."""
    return area_edges.select("area").distinct().join(weights.select("area").distinct(), "area", "left_anti")


def area_mean(
    values: DataFrame, weights: DataFrame, keys: tuple[str, ...] = ("index", "freq", "period"),
    nulls: str = "renormalise",
) -> DataFrame:
    """Area-weighted mean of cell values: ``values(*keys, cell_id, value)`` -> ``(*keys, area, value)``.

    ``nulls='renormalise'`` weighs the cells that have a value; ``'as_zero'`` lets a null cell add nothing
    yet keep its weight.
    """
    weight, value = F.col("weight"), F.col("value")
    denominator = F.sum(F.when(value.isNotNull(), weight) if nulls == "renormalise" else weight)
    numerator = F.sum(value * weight)
    if nulls == "as_zero":
        numerator = F.coalesce(numerator, F.lit(0.0))
    return (
        values.join(weights, "cell_id")
        .groupBy(*keys, "area")
        .agg(numerator.alias("total"), denominator.alias("weight"))
        .select(*keys, "area", F.when(F.col("weight") > 0, F.col("total") / F.col("weight")).alias("value"))
    )


def overlay(grid: Grid, area_edges: DataFrame, digits: int = 3) -> DataFrame:
    """Cells cut to areas: ``(cell_id, area, polygon, ring, points)``, counter-clockwise, holes clockwise.

    Every ring is cut into grid columns and each piece into rows.  Cutting keeps the ring's order; where it
    leaves a column and comes back, the two ends lie on the same grid line and are joined along it.  Where such
    joins run both ways along a side, or several rings of a polygon meet in a cell, the rings are rebuilt:
    parts that hang together outside the cell only become polygons of their own, with new numbers.
    """
    key = ["area", "polygon", "ring", "col"]
    strips = _clip_to_columns(area_edges, grid).select(*key, "seq", "ax", "ay", "bx", "by")
    round_trip = Window.partitionBy(*key).orderBy("seq")
    whole = round_trip.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    next_x = F.coalesce(F.lead("ax").over(round_trip), F.first("ax").over(whole))
    next_y = F.coalesce(F.lead("ay").over(round_trip), F.first("ay").over(whole))
    linked = strips.withColumns({"nx": next_x, "ny": next_y})

    def piece(order: Column, names: tuple[str, str, str, str]) -> Column:
        return F.struct(order.alias("seq"), *[F.col(c).alias(n) for c, n in zip(names, ("ax", "ay", "bx", "by"))])

    own = piece(F.col("seq") * 2, ("ax", "ay", "bx", "by"))
    link = piece(F.col("seq") * 2 + 1, ("bx", "by", "nx", "ny"))
    pieces = linked.select(*key, F.explode(F.array(own, link)).alias("p")).select(*key, "p.*")
    pieces = pieces.filter("ax != bx or ay != by")
    cut = _clip_to_rows(pieces, grid).withColumns({c: F.round(c, digits) for c in ("ax", "ay", "bx", "by")})

    point_pairs = F.array(
        F.array(F.col("ax"), F.col("ay")), F.array(F.col("bx"), F.col("by"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("seq", point_pairs.alias("ends"))))
    # One shuffle for both groupings: all rings of a polygon in a cell lie together.
    together = cut.repartition("area", "polygon", "row", "col")
    rings = together.groupBy("area", "polygon", "ring", "row", "col").agg(
        F.flatten(F.transform(ordered, lambda e: e.ends)).alias("points")
    )
    kept = F.filter(
        F.col("points"),
        lambda p, i: p != F.when(i == 0, F.try_element_at("points", F.lit(-1))).otherwise(F.get("points", i - 1)),
    )
    rings = rings.withColumn("points", kept).filter(F.size("points") >= 3)
    sides = ["lon_lo", "lat_lo", "lon_hi", "lat_hi"]
    placed = rings.join(grid.cells.select("cell_id", "row", "col", *[F.round(c, digits).alias(c) for c in sides]), ["row", "col"])
    return _rebuilt(placed.withColumn("doubtful", _runs_both_ways()), sides)


def _runs_both_ways() -> Column:
    """Whether the ring ``points`` runs along a side of its cell in both directions, or passes a point twice."""
    n = F.size("points")

    def way(i):
        a, b = F.get("points", i), F.get("points", (i + 1) % n)
        x, y, u, v = (F.get(p, F.lit(axis)) for p in (a, b) for axis in (0, 1))
        upright, level = (x == u) & x.isin(F.col("lon_lo"), F.col("lon_hi")), (y == v) & y.isin(F.col("lat_lo"), F.col("lat_hi"))
        east, north = x == F.col("lon_hi"), y == F.col("lat_hi")
        return (F.when(upright, F.when(east, 2).otherwise(1) * F.signum(v - y))
                .when(level, F.when(north, 4).otherwise(3) * F.signum(u - x)).otherwise(0.0))

    ways = F.transform(F.sequence(F.lit(0), n - 1), way)
    both = F.transform(F.array(ways), lambda w: reduce(or_, [  # an array of one, so that the ways are listed once
        F.array_contains(w, side) & F.array_contains(w, -side) for side in (1.0, 2.0, 3.0, 4.0)]))
    return F.get(both, F.lit(0)) | (F.size(F.array_distinct("points")) < n)


def _rebuilt(rings: DataFrame, sides: list[str]) -> DataFrame:
    """Rings of each polygon in a cell; doubtful ones go through ``valid_parts``."""
    shape = F.sort_array(F.collect_list(F.struct("ring", "points")))
    shapes = rings.groupBy("area", "polygon", "row", "col", "cell_id", *sides).agg(
        shape.alias("rings"), (F.max("doubtful") | (F.count("*") > 1)).alias("doubtful"))
    loops = F.transform("rings", lambda r: r["points"])
    again = F.from_json(parts_of(F.when(F.col("doubtful"), F.to_json(loops)), *sides), PARTS)
    parts = shapes.withColumn("again", again).withColumn("parts", F.coalesce("again", F.array(loops)))
    each = parts.select("cell_id", "area", "polygon", "rings", "doubtful", F.size("parts").alias("n"), F.posexplode("parts").alias("part", "loops"))
    polygon = F.when(F.col("n") > 1, F.xxhash64("polygon", "part")).otherwise(F.col("polygon"))
    numbered = each.select("cell_id", "area", polygon.alias("polygon"), "part", F.get("rings.ring", F.lit(0)).alias("first"), "doubtful",
                           F.posexplode("loops").alias("position", "points"))
    ring = F.when(F.col("doubtful"), F.xxhash64("polygon", "part", "position")).otherwise(F.col("first"))
    return numbered.select("cell_id", "area", "polygon", ring.alias("ring"), "points")


def overlay_boundary(grid: Grid, area_edges: DataFrame, digits: int = 3) -> DataFrame:
    """Cells cut to the outline of all areas together: no inner borders, one row a part of the whole."""
    return overlay(grid, outline(area_edges), digits)
