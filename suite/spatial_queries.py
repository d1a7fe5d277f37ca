"""Areas, weights, area means, clipping and overlays.

The area layer is built from the nation table: 25 quadrangles that tile the grid's extent, inner corners
moved off the regular lattice, named by nation or, five to an area, by region.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.operators import daily, grid, maps, rings, spatial, spi
from isohyet.sources import areas, sinks
from suite import cube
from suite.daily_queries import rounded_sql
from suite.registry import first_day, period_days, register, rounded, with_cube


def _corner(di: int, dj: int):
    i = F.col("i") + di
    j = F.col("j") + dj
    inner = F.when((i > 0) & (i < 5) & (j > 0) & (j < 5), 1).otherwise(0)
    x = F.lit(99.5) + (60 * i + inner * 6 * ((2 * i + 3 * j) % 5 - 2)) / F.lit(100.0)
    y = F.lit(9.5) + (40 * j + inner * 4 * ((3 * i + j) % 5 - 2)) / F.lit(100.0)
    return F.array(x, y)


def nation_rings(spark, sf_dir: str, by: str = "nation") -> DataFrame:
    nations = cube.table(spark, sf_dir, "nation").join(
        cube.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    quad = nations.withColumns({"i": F.col("n_nationkey") % 5, "j": F.floor(F.col("n_nationkey") / 5)})
    key = F.col("n_nationkey").cast("long")
    return quad.select(
        F.col("n_name" if by == "nation" else "r_name").alias("area"),
        key.alias("polygon"), key.alias("ring"), F.lit(False).alias("hole"),
        F.array(_corner(0, 0), _corner(1, 0), _corner(1, 1), _corner(0, 1)).alias("points"),
    )


def layer(spark, sf_dir: str, by: str = "nation") -> DataFrame:
    return areas.edges(nation_rings(spark, sf_dir, by))


def prepared(spark, sf_dir: str) -> grid.Grid:
    return grid.prepare(cube.grid(spark, sf_dir))


def weights(spark, sf_dir: str, by: str = "nation") -> DataFrame:
    return spatial.cell_area(prepared(spark, sf_dir), layer(spark, sf_dir, by))


LAYER = """
quads AS (
  SELECT n_name, r_name, n_nationkey, n_nationkey % 5 AS i, n_nationkey // 5 AS j
  FROM nation JOIN region ON n_regionkey = r_regionkey),
corners AS (
  SELECT n_name, r_name, n_nationkey, seq,
         99.5::DOUBLE + (60 * ci + 6 * inner_ * ((2 * ci + 3 * cj) % 5 - 2)) / 100.0::DOUBLE AS x,
         9.5::DOUBLE + (40 * cj + 4 * inner_ * ((3 * ci + cj) % 5 - 2)) / 100.0::DOUBLE AS y
  FROM (SELECT *, i + di AS ci, j + dj AS cj,
               CASE WHEN i + di > 0 AND i + di < 5 AND j + dj > 0 AND j + dj < 5 THEN 1 ELSE 0 END AS inner_
        FROM quads, (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1)) t(seq, di, dj))),
layer AS (
  SELECT a.n_name, a.r_name, a.n_nationkey AS ring, a.seq, a.x AS ax, a.y AS ay, b.x AS ex, b.y AS ey
  FROM corners a JOIN corners b ON a.n_nationkey = b.n_nationkey AND b.seq = (a.seq + 1) % 4),
boxes AS (
  SELECT cell_id, lat, lon, lat - 0.5 / k AS y0, lat + 0.5 / k AS y1, lon - 0.5 / k AS x0, lon + 0.5 / k AS x1
  FROM grid)"""


# The corners and edges of the layer without the grid's boxes.
LAYER_ONLY = LAYER[:LAYER.rindex("boxes AS")].rstrip().rstrip(",")


def weights_sql(name: str, cte: str = "cell_area") -> str:
    """Intersection areas ey the integral over x: every edge over or in the cell's column counts."""
    return f"""
{LAYER},
pieces AS (
  SELECT {name} AS area, cell_id, y0, y1, CASE WHEN ex > ax THEN -1 ELSE 1 END AS way, x0, x1,
         ax, ay, ex, ey, greatest(least(ax, ex), x0) AS lo, least(greatest(ax, ex), x1) AS hi
  FROM boxes JOIN layer ON least(ax, ex) < x1 AND greatest(ax, ex) > x0),
ends AS (
  SELECT *, ay + (ey - ay) * (lo - ax) / (ex - ax) AS ya, ay + (ey - ay) * (hi - ax) / (ex - ax) AS yb
  FROM pieces WHERE hi > lo),
terms AS (
  SELECT area, cell_id,
    CASE WHEN abs(yb - ya) < 1e-12 THEN (greatest(least(ya, y1), y0) - y0) * (hi - lo)
    ELSE (hi - lo) / (yb - ya) * (
      ((greatest(least(yb, y1), y0) - y0) ** 2 / 2 + (y1 - y0) * greatest(yb - y1, 0))
      - ((greatest(least(ya, y1), y0) - y0) ** 2 / 2 + (y1 - y0) * greatest(ya - y1, 0))) END * way AS term
  FROM ends),
{cte} AS (SELECT cell_id, area, sum(term) AS weight FROM terms GROUP BY 1, 2 HAVING sum(term) > 1e-9)"""


@register("cell_area", rounded_sql(with_cube(f"WITH {weights_sql('n_name')} SELECT * FROM cell_area"), ["weight"], 8))
def cell_area(spark, sf_dir):
    return rounded(weights(spark, sf_dir), 8)


@register(
    "cell_area_multipart",
    rounded_sql(with_cube(f"WITH {weights_sql('r_name')} SELECT * FROM cell_area"), ["weight"], 8),
)
def cell_area_multipart(spark, sf_dir):
    return rounded(weights(spark, sf_dir, "region"), 8)


@register(
    "cell_area_spherical",
    rounded_sql(with_cube(f"""
WITH {weights_sql('n_name')}
SELECT c.cell_id, area, weight * cos(radians(lat)) AS weight FROM cell_area c JOIN grid USING (cell_id)"""), ["weight"], 8),
)
def cell_area_spherical(spark, sf_dir):
    table = spatial.cell_area(prepared(spark, sf_dir), layer(spark, sf_dir), spherical=True)
    return rounded(table, 8)


@register(
    "cell_area_overview",
    rounded_sql(with_cube(f"""
WITH {weights_sql("'overview'")} SELECT * FROM cell_area"""), ["weight"], 8),
)
def cell_area_overview(spark, sf_dir):
    return rounded(spatial.cell_area(prepared(spark, sf_dir), areas.dissolve(layer(spark, sf_dir))), 8)


def yearly_total(spark, sf_dir):
    return daily.to_index_values(
        daily.daily_indices(cube.series(spark, sf_dir, "pr"), ["PRCPTOT"], "YS"), "YS"
    )


PRCPTOT_SQL = f"""
yearly AS (
  SELECT cell_id, {first_day('YS')} AS period,
         CASE WHEN count(pr) = {period_days('YS', first_day('YS'))} THEN coalesce(sum(pr) FILTER (pr >= 1), 0) END AS v
  FROM wide GROUP BY 1, 2)"""


@register(
    "area_weighted_mean",
    rounded_sql(with_cube(f"""
WITH {weights_sql('n_name')}, {PRCPTOT_SQL}
SELECT 'PRCPTOT' AS index, 'YS' AS freq, period, area, sum(v * weight) / sum(weight) AS value
FROM yearly JOIN cell_area USING (cell_id) WHERE v IS NOT NULL GROUP BY period, area"""), ["value"]),
)
def area_weighted_mean(spark, sf_dir):
    return rounded(spatial.area_mean(yearly_total(spark, sf_dir), weights(spark, sf_dir)))


@register(
    "area_weighted_mean_nulls",
    rounded_sql(with_cube(f"""
WITH {weights_sql('n_name')}, monthly AS (
  SELECT cell_id, {first_day('MS')} AS period,
         CASE WHEN count(tmax) > 0 AND count(*) - count(tmax) < 0.05::DOUBLE * count(*) THEN avg(tmax) END AS v
  FROM wide GROUP BY 1, 2)
SELECT period, area, CASE WHEN sum(weight) FILTER (v IS NOT NULL) > 0
         THEN sum(v * weight) / sum(weight) FILTER (v IS NOT NULL) END AS renormalised,
       coalesce(sum(v * weight), 0) / sum(weight) AS as_zero
FROM monthly JOIN cell_area USING (cell_id) GROUP BY period, area"""), ["renormalised", "as_zero"], 8),
)
def area_weighted_mean_nulls(spark, sf_dir):
    values, share = spi.monthly_mean(cube.series(spark, sf_dir, "tmax"), 0.05), weights(spark, sf_dir)
    tables = [
        spatial.area_mean(values, share, ("period",), nulls).withColumnRenamed("value", name)
        for nulls, name in (("renormalise", "renormalised"), ("as_zero", "as_zero"))
    ]
    return rounded(tables[0].join(tables[1], ["period", "area"]), 8)


@register(
    "clip_to_area",
    with_cube(f"""
WITH {weights_sql('n_name')}
SELECT cell_id, count(*) AS days, sum(pr) AS total FROM wide
WHERE cell_id IN (SELECT cell_id FROM cell_area WHERE area = 'NATION_7') GROUP BY cell_id"""),
)
def clip_to_area(spark, sf_dir):
    clipped = spatial.clip(cube.series(spark, sf_dir, "pr"), weights(spark, sf_dir), "NATION_7")
    return clipped.groupBy("cell_id").agg(F.count("*").alias("days"), F.sum("value").alias("total"))


@register(
    "overlay_geometry",
    rounded_sql(with_cube(f"""
WITH {weights_sql('n_name')} SELECT cell_id, area, weight AS size, 1 AS rings FROM cell_area"""), ["size"], 2),
)
def overlay_geometry(spark, sf_dir):
    """Outlines are stored on a 0.001 degree lattice; their shoelace areas agree with the weights to that."""
    rings = spatial.overlay(prepared(spark, sf_dir), layer(spark, sf_dir))
    sized = rings.groupBy("cell_id", "area").agg(
        F.sum(areas.signed_area(F.col("points"))).alias("size"), F.count("*").cast("int").alias("rings")
    )
    return rounded(sized, 2)


@register(
    "cell_bounds",
    rounded_sql(with_cube("""
SELECT cell_id, lat, lon, lat - 0.5 / k AS lat_lo, lat + 0.5 / k AS lat_hi, lon - 0.5 / k AS lon_lo,
       lon + 0.5 / k AS lon_hi FROM grid"""), ["lat", "lon", "lat_lo", "lat_hi", "lon_lo", "lon_hi"], 9),
)
def cell_bounds(spark, sf_dir):
    return rounded(grid.cell_bounds(cube.grid(spark, sf_dir)).drop("row", "col"), 9)


@register(
    "area_extent",
    rounded_sql(with_cube(f"""
WITH {LAYER}
SELECT r_name AS area, min(ax) AS west, min(ay) AS south, max(ax) AS east, max(ay) AS north FROM layer GROUP BY 1
UNION ALL SELECT 'overview', min(ax), min(ay), max(ax), max(ay) FROM layer"""), ["west", "south", "east", "north"]),
)
def area_extent(spark, sf_dir):
    edges = layer(spark, sf_dir, "region")
    whole = areas.extent(edges, "*").withColumn("area", F.lit("overview"))
    return rounded(areas.extent(edges).unionByName(whole))


@register(
    "cell_outline",
    rounded_sql(with_cube("""
SELECT cell_id, lon AS centre_lon, lat AS centre_lat, 5 AS vertices FROM grid"""), ["centre_lon", "centre_lat"], 9),
)
def cell_outline(spark, sf_dir):
    ring = grid.outline()
    lon, lat = grid.outline_centre(ring)
    bounds = grid.cell_bounds(cube.grid(spark, sf_dir))
    return rounded(bounds.select(
        "cell_id", lon.alias("centre_lon"), lat.alias("centre_lat"), F.size(ring).alias("vertices")
    ), 9)


# Combs and enclaves: one comb per region, teeth hanging across the grid row at 10.5 from a spine with a hole in
# it, and the region's enclave in the hole.  Their cells are unions of rectangles, which SQL can list.
def comb_rings(spark, sf_dir: str) -> DataFrame:
    regions = cube.table(spark, sf_dir, "region")
    left = F.lit(99.6) + F.col("r_regionkey") * 0.58

    def point(dx: float, y: float):
        return F.array(F.round(left + dx, 6), F.lit(y))

    teeth = [p for t in range(4) for p in (
        point(0.12 * t, 10.1 + 0.02 * t), point(0.12 * t + 0.06, 10.1 + 0.02 * t), point(0.12 * t + 0.06, 10.6), point(0.12 * t + 0.12, 10.6))]
    comb = F.array(*teeth[:-1], point(0.42, 10.9), point(0.0, 10.9))
    hole = F.array(point(0.1, 10.7), point(0.2, 10.7), point(0.2, 10.8), point(0.1, 10.8))
    key = F.col("r_regionkey").cast("long")

    def ring(area, polygon, number, is_hole, points):
        return F.struct(area.alias("area"), polygon.alias("polygon"), number.alias("ring"), F.lit(is_hole).alias("hole"), points.alias("points"))

    inner = F.concat(F.col("r_name"), F.lit(" enclave"))
    made = F.array(ring(F.col("r_name"), key, key, False, comb), ring(F.col("r_name"), key, key + 10, True, hole), ring(inner, key + 20, key + 20, False, hole))
    return regions.select(F.explode(made).alias("r")).select("r.*")


COMB_PARTS = """
combs AS (SELECT r_name, r_regionkey, 99.6::DOUBLE + r_regionkey * 0.58::DOUBLE AS x FROM region),
teeth AS (
  SELECT r_name, x + 0.12::DOUBLE * t AS a, x + 0.12::DOUBLE * t + 0.06::DOUBLE AS b, 10.1::DOUBLE + 0.02::DOUBLE * t AS c, 10.6::DOUBLE AS d
  FROM combs, unnest(generate_series(0, 3)) AS g(t)),
pieces AS (  -- rectangles with their sign and their place: below the spine, in it, the hole, the enclave
  SELECT r_name AS area, 1 AS way, 'tooth' AS kind, a, b, c, d FROM teeth
  UNION ALL SELECT r_name, 1, 'spine', x, x + 0.42::DOUBLE, 10.6::DOUBLE, 10.9::DOUBLE FROM combs
  UNION ALL SELECT r_name, -1, 'hole', x + 0.1::DOUBLE, x + 0.2::DOUBLE, 10.7::DOUBLE, 10.8::DOUBLE FROM combs
  UNION ALL SELECT r_name || ' enclave', 1, 'enclave', x + 0.1::DOUBLE, x + 0.2::DOUBLE, 10.7::DOUBLE, 10.8::DOUBLE FROM combs),
boxes AS (
  SELECT cell_id, lat - 0.5 / k AS y0, lat + 0.5 / k AS y1, lon - 0.5 / k AS x0, lon + 0.5 / k AS x1 FROM grid),
met AS (
  SELECT *, greatest(a, x0) AS p, least(b, x1) AS q, greatest(c, y0) AS r, least(d, y1) AS s
  FROM pieces JOIN boxes ON a < x1 - 1e-7 AND b > x0 + 1e-7 AND c < y1 - 1e-7 AND d > y0 + 1e-7),
-- Below the spine, and in the enclave, every rectangle is a part; in a cell with a piece of the spine all hangs together.
single AS (SELECT * FROM met WHERE kind = 'enclave' OR (kind = 'tooth' AND y1 <= 10.6::DOUBLE)),
joined AS (
  SELECT cell_id, area, sum(way * (q - p) * (s - r)) AS size,
         1 + count(*) FILTER (kind = 'hole' AND a > x0 + 1e-7 AND b < x1 - 1e-7 AND c > y0 + 1e-7 AND d < y1 - 1e-7) AS rings
  FROM met WHERE kind <> 'enclave' AND NOT (kind = 'tooth' AND y1 <= 10.6::DOUBLE) GROUP BY cell_id, area)"""


@register(
    "overlay_parts",
    rounded_sql(with_cube(f"""
WITH {COMB_PARTS}
SELECT cell_id, area, 1::BIGINT AS rings, (q - p) * (s - r) AS size,
       printf('%.3f %.3f,%.3f %.3f,%.3f %.3f,%.3f %.3f', p, r, p, s, q, r, q, s) AS vertices FROM single
UNION ALL SELECT cell_id, area, rings, size, NULL FROM joined"""), ["size"], 6),
)
def overlay_parts(spark, sf_dir):
    """Parts of concave areas and enclaves in each cell: their size, and the corners of those that are rectangles."""
    cut = spatial.overlay(prepared(spark, sf_dir), areas.edges(comb_rings(spark, sf_dir)), digits=9)
    corners = F.transform(F.array_sort("points"), lambda p: F.format_string("%.3f %.3f", F.get(p, F.lit(0)), F.get(p, F.lit(1))))
    parts = cut.withColumn("corners", F.array_join(corners, ",")).groupBy("cell_id", "area", "polygon").agg(
        F.count("*").alias("rings"), F.sum(areas.signed_area(F.col("points"))).alias("size"), F.max("corners").alias("corners"))
    flat = grid.cell_bounds(cube.grid(spark, sf_dir)).select("cell_id", "lat_hi")
    listed = F.col("area").endswith("enclave") | (F.col("lat_hi") <= 10.6)
    return rounded(parts.join(flat, "cell_id").select(
        "cell_id", "area", "rings", "size", F.when(listed, F.col("corners")).alias("vertices")), 6)


@register(
    "overview_outline",
    rounded_sql(f"""
WITH {LAYER_ONLY},
held AS (SELECT * FROM layer WHERE ring <> 12),
open_ AS (
  SELECT a.ax, a.ay, a.ex AS bx, a.ey AS "by" FROM held a
  WHERE NOT EXISTS (SELECT 1 FROM held b WHERE abs(a.ax - b.ex) < 1e-9 AND abs(a.ay - b.ey) < 1e-9 AND abs(a.ex - b.ax) < 1e-9 AND abs(a.ey - b.ay) < 1e-9)),
marked AS (SELECT *, ax > 99.9 AND ax < 102.1 AND ay > 9.7 AND ay < 11.3 AS hole FROM open_)
SELECT ax, ay, bx, "by", hole, count(*) OVER (PARTITION BY hole) AS ring_size, 1 AS polygons FROM marked""", ["ax", "ay", "bx", "by"], 6),
)
def overview_outline(spark, sf_dir):
    """The outline of all nations but the one in the middle: the outside, and the hole it leaves."""
    edges = areas.edges(nation_rings(spark, sf_dir).filter("ring <> 12"))
    found = rings.outline(edges)
    sizes = found.groupBy("ring").agg(F.count("*").alias("ring_size"), (F.sum(F.expr("ax * by - bx * ay")) < 0).alias("hole"))
    polygons = found.agg(F.count_distinct("polygon").cast("int")).scalar()
    return rounded(found.join(sizes, "ring").select("ax", "ay", "bx", "by", "hole", "ring_size", polygons.alias("polygons")), 6)


@register(
    "overlay_overview",
    rounded_sql(with_cube(f"""
WITH {weights_sql("'overview'")} SELECT cell_id, 1::BIGINT AS parts, weight AS size FROM cell_area"""), ["size"], 6),
)
def overlay_overview(spark, sf_dir):
    """The cells of the whole layer: one part each, however many areas share a cell."""
    cut = spatial.overlay_boundary(prepared(spark, sf_dir), layer(spark, sf_dir), digits=9)
    return rounded(cut.groupBy("cell_id").agg(
        F.count_distinct("polygon").alias("parts"), F.sum(areas.signed_area(F.col("points"))).alias("size")), 6)


@register(
    "boundary_vertices",
    rounded_sql(f"""
WITH {LAYER_ONLY}
SELECT n_name AS area, 'Polygon' AS kind, count(*) + 1 AS vertices, sum(round(ax, 3)) AS sum_x, sum(round(ay, 3)) AS sum_y,
       string_agg(printf('%.3f %.3f', round(ax, 3), round(ay, 3)), ',' ORDER BY seq) AS corners FROM layer GROUP BY n_name""", ["sum_x", "sum_y"], 6),
)
def boundary_vertices(spark, sf_dir):
    """The exported boundary read back from its JSON: every vertex on the 0.001 degree lattice, rings closed."""
    features = sinks.boundary_features(layer(spark, sf_dir))
    schema = "type string, geometry struct<type: string, coordinates: array<array<array<double>>>>"
    ring = F.get("f.geometry.coordinates", F.lit(0))
    parsed = features.select("area", F.from_json("feature", schema).alias("f")).select("area", F.col("f.geometry.type").alias("kind"), ring.alias("ring"))
    open_ring = F.when(F.element_at("ring", 1) == F.element_at("ring", -1), F.slice("ring", 1, F.size("ring") - 1))
    opened = parsed.withColumn("open", open_ring)
    add = lambda axis: F.aggregate("open", F.lit(0.0), lambda s, p: s + F.get(p, F.lit(axis)))
    text = F.transform("open", lambda p: F.format_string("%.3f %.3f", F.get(p, F.lit(0)), F.get(p, F.lit(1))))
    return rounded(opened.select(
        "area", "kind", F.size("ring").cast("long").alias("vertices"), add(0).alias("sum_x"), add(1).alias("sum_y"), F.array_join(text, ",").alias("corners")), 6)


@register(
    "cell_outline_vertices",
    rounded_sql(with_cube("""
SELECT cell_id, i AS position, CASE WHEN i IN (1, 2) THEN lon + 0.5 / k ELSE lon - 0.5 / k END AS x,
       CASE WHEN i IN (2, 3) THEN lat + 0.5 / k ELSE lat - 0.5 / k END AS y
FROM grid, (VALUES (0), (1), (2), (3), (4)) v(i)"""), ["x", "y"], 9),
)
def cell_outline_vertices(spark, sf_dir):
    bounds = grid.cell_bounds(cube.grid(spark, sf_dir))
    each = bounds.select("cell_id", F.posexplode(grid.outline()).alias("position", "p"))
    return rounded(each.select("cell_id", "position", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y")), 9)


@register(
    "touched_cells",
    with_cube("""
WITH boxes AS (
  SELECT cell_id, lat - 0.5 / k AS y0, lat + 0.5 / k AS y1, lon - 0.5 / k AS x0, lon + 0.5 / k AS x1 FROM grid),
blocks AS (  -- their west side and their north side lie on grid lines
  SELECT r_name AS area, 100.5::DOUBLE AS a, 100.8::DOUBLE + 0.1::DOUBLE * r_regionkey AS b, 9.7::DOUBLE AS c, 10.5::DOUBLE AS d FROM region)
SELECT cell_id, area, a < x1 - 1e-7 AND b > x0 + 1e-7 AND c < y1 - 1e-7 AND d > y0 + 1e-7 AS covered
FROM boxes JOIN blocks ON a <= x1 + 1e-7 AND b >= x0 - 1e-7 AND c <= y1 + 1e-7 AND d >= y0 - 1e-7"""),
)
def touched_cells(spark, sf_dir):
    """Clipping by the touch rule keeps cells that an area meets at a line; by area it does not."""
    east = F.round(F.lit(100.8) + 0.1 * F.col("r_regionkey"), 6)
    corner = lambda x, y: F.array(x if not isinstance(x, float) else F.lit(x), F.lit(y))
    key = F.col("r_regionkey").cast("long")
    blocks = cube.table(spark, sf_dir, "region").select(
        F.col("r_name").alias("area"), key.alias("polygon"), key.alias("ring"), F.lit(False).alias("hole"),
        F.array(corner(100.5, 9.7), corner(east, 9.7), corner(east, 10.5), corner(100.5, 10.5)).alias("points"))
    cells, edges = prepared(spark, sf_dir), areas.edges(blocks)
    share = spatial.cell_area(cells, edges)
    found = spatial.touched_cells(cells, edges, share)
    return found.join(share, ["cell_id", "area"], "left").select("cell_id", "area", F.col("weight").isNotNull().alias("covered"))


@register(
    "uncovered_areas",
    with_cube("SELECT n_name AS area FROM nation WHERE n_nationkey % 3 = 0"),
)
def uncovered_areas(spark, sf_dir):
    """Areas without a cell of the grid: every third nation, moved ten degrees to the east."""
    moved = F.transform("points", lambda p: F.array(F.get(p, F.lit(0)) + 10.0, F.get(p, F.lit(1))))
    ring = nation_rings(spark, sf_dir).withColumn("points", F.when(F.col("polygon") % 3 == 0, moved).otherwise(F.col("points")))
    edges = areas.edges(ring)
    return spatial.uncovered_areas(edges, spatial.cell_area(prepared(spark, sf_dir), edges))


@register(
    "sub_areas",
    """
SELECT 'regions' AS layer, r_name AS area, CAST(count(*) * 4 AS BIGINT) AS edges FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
)
def sub_areas(spark, sf_dir):
    """A layer of several areas has sub-areas, one of a single area has none."""
    edges = layer(spark, sf_dir, "region")
    layers = [("regions", edges), ("one region", edges.filter("area = 'ASIA'"))]
    rows = [areas.sub_areas(table).groupBy("area").agg(F.count("*").alias("edges")).select(F.lit(name).alias("layer"), "area", "edges")
            for name, table in layers]
    return rows[0].unionByName(rows[1])


@register(
    "area_map_features",
    rounded_sql(with_cube(f"""
WITH {weights_sql('n_name')}, {PRCPTOT_SQL},
means AS (SELECT period, area, sum(v * weight) / sum(weight) AS m FROM yearly JOIN cell_area USING (cell_id) WHERE v IS NOT NULL GROUP BY 1, 2),
mapped AS (SELECT area, round(avg(m), 2) AS value FROM means GROUP BY area)
SELECT area, area AS name, value, 5 AS vertices, round(ax, 3) AS x, round(ay, 3) AS y FROM mapped JOIN layer ON n_name = area"""), ["value", "x", "y"], 2),
)
def area_map_features(spark, sf_dir):
    """Values of areas with their polygons, read back from the features' text vertex by vertex."""
    edges = layer(spark, sf_dir)
    means = spatial.area_mean(yearly_total(spark, sf_dir), spatial.cell_area(prepared(spark, sf_dir), edges))
    features = sinks.area_features(maps.actual(means, ("area",)), edges, ["value"])
    schema = "geometry struct<coordinates: array<array<array<double>>>>, properties struct<name: string, value: double>"
    parsed = features.select("area", F.from_json("feature", schema).alias("f"))
    ring = F.get("f.geometry.coordinates", F.lit(0))
    corners = parsed.select("area", "f.properties.name", "f.properties.value", F.size(ring).alias("vertices"),
                            F.explode(F.slice(ring, 1, F.size(ring) - 1)).alias("p"))
    return rounded(corners.select("area", "name", "value", "vertices", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y")), 2)
