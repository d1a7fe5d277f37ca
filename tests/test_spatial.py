import json
import math
import random

import pytest
from pyspark.sql import functions as F

from isohyet.operators import grid, rings, spatial
from isohyet.sources import areas


def cells(spark, lats, lons):
    rows = [(i * len(lons) + j, float(lat), float(lon)) for i, lat in enumerate(lats) for j, lon in enumerate(lons)]
    return spark.createDataFrame(rows, "cell_id bigint, lat double, lon double")


def layer(spark, polygons):
    """[(area, [ring, hole, ...])] -> edges, through GeoJSON."""
    rows = [
        ({"name": area}, ("Polygon", json.dumps([list(map(list, ring)) for ring in rings]))) for area, rings in polygons
    ]
    features = spark.createDataFrame(
        rows, "properties map<string, string>, geometry struct<type: string, coordinates: string>"
    )
    return areas.edges(areas.rings(features, F.col("properties")["name"]))


def weights(spark, cell_table, polygons, **options):
    table = spatial.cell_area(grid.prepare(cell_table), layer(spark, polygons), **options)
    return {(r.area, r.cell_id): r.weight for r in table.collect()}


def clip_area(ring, box):
    """Sutherland-Hodgman and shoelace, in plain Python."""
    x0, y0, x1, y1 = box
    sides = [(0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)]
    points = list(ring)
    for axis, at, sign in sides:
        out = []
        for a, b in zip(points, points[1:] + points[:1]):
            ain, bin_ = (a[axis] - at) * sign >= 0, (b[axis] - at) * sign >= 0
            if ain != bin_:
                t = (at - a[axis]) / (b[axis] - a[axis])
                cut = [a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t]
                cut[axis] = at
                out.append(tuple(cut))
            if bin_:
                out.append(b)
        points = out
        if not points:
            return 0.0
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1]))) / 2


def star(rng, cx, cy, radius, n):
    """A simple, usually concave polygon."""
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    reach = [rng.uniform(0.3, 1) * radius for _ in turns]
    return [(cx + r * math.cos(t), cy + r * math.sin(t)) for t, r in zip(turns, reach)]


WEST = [(99.5, 9.5), (101, 9.5), (101, 11.5), (99.5, 11.5)]
EAST = [(101, 9.5), (102.5, 9.5), (102.5, 11.5), (101, 11.5)]
TRI = [(99.5, 9.5), (102.5, 9.5), (101, 11.5)]


def test_admin_layer(spark):
    grid_cells = cells(spark, [10, 11], [100, 101, 102])
    out = weights(spark, grid_cells, [("west", [WEST]), ("east", [EAST])])
    west = {k[1]: round(v, 9) for k, v in out.items() if k[0] == "west"}
    east = {k[1]: round(v, 9) for k, v in out.items() if k[0] == "east"}
    assert west == {0: 1, 1: 0.5, 3: 1, 4: 0.5}
    assert east == {1: 0.5, 2: 1, 4: 0.5, 5: 1}
    table = spatial.cell_area(grid.prepare(grid_cells), areas.dissolve(layer(spark, [("west", [WEST]), ("east", [EAST])])))
    assert [round(r.weight, 9) for r in table.orderBy("cell_id").collect()] == [1.0] * 6


def test_triangle(spark):
    out = weights(spark, cells(spark, [10, 11], [100, 101, 102]), [("tri", [TRI])])
    expected = [0.625, 1, 0.625, 1 / 24, 2 / 3, 1 / 24]
    assert [out["tri", c] for c in range(6)] == pytest.approx(expected)
    assert sum(out.values()) == pytest.approx(3)


def test_unit_box_and_weighted_mean(spark):
    grid_cells = cells(spark, [0.5, 1.5], [0.5, 1.5])
    assert weights(spark, grid_cells, [("a", [[(0, 0), (1, 0), (1, 1), (0, 1)]])]) == {("a", 0): 1.0}
    share = spatial.cell_area(grid.prepare(grid_cells), layer(spark, [("a", [[(0, 0), (1.5, 0), (1.5, 1), (0, 1)]])]))
    values = spark.createDataFrame([("t", 0, 10.0), ("t", 1, 50.0), ("t", 2, 0.0), ("t", 3, 0.0)], "k string, cell_id bigint, value double")
    row = spatial.area_mean(values, share, ("k",)).first()
    assert row.value == pytest.approx(70 / 3)
    holes = values.withColumn("value", F.when(F.col("cell_id") != 1, F.col("value")))
    assert spatial.area_mean(holes, share, ("k",)).first().value == pytest.approx(10.0)
    assert spatial.area_mean(holes, share, ("k",), "as_zero").first().value == pytest.approx(10 / 1.5)


def test_clockwise_rings_and_holes(spark):
    outer = [(0, 0), (0, 4), (4, 4), (4, 0)]  # clockwise in the file
    hole = [(1.25, 1.25), (2.75, 1.25), (2.75, 2.75), (1.25, 2.75)]  # counter-clockwise in the file
    grid_cells = cells(spark, [0.5, 1.5, 2.5, 3.5], [0.5, 1.5, 2.5, 3.5])
    out = weights(spark, grid_cells, [("ring", [outer, hole])])
    assert sum(out.values()) == pytest.approx(16 - 2.25)
    assert out["ring", 5] == pytest.approx(1 - 0.75 * 0.75)
    assert out["ring", 0] == pytest.approx(1)


def test_random_polygons_against_clipping(spark):
    rng = random.Random(7)
    lats, lons = [0.0, 0.7, 1.4, 2.1, 2.8], [10.0, 11.0, 12.0, 13.0]
    grid_cells = cells(spark, lats, lons)
    polygons = [(f"p{i}", [star(rng, rng.uniform(9, 14), rng.uniform(-1, 4), rng.uniform(0.3, 3), rng.randint(3, 12))]) for i in range(40)]
    out = weights(spark, grid_cells, polygons)
    for name, (ring,) in polygons:
        for i, lat in enumerate(lats):
            for j, lon in enumerate(lons):
                box = (lon - 0.5, lat - 0.35, lon + 0.5, lat + 0.35)
                expected = clip_area(ring, box)
                got = out.get((name, i * len(lons) + j), 0.0)
                assert got == pytest.approx(expected, abs=1e-8), (name, i, j)
                assert got <= 0.7 + 1e-9


def test_overlay_area_equals_weights(spark):
    rng = random.Random(9)
    grid_cells = cells(spark, [0.0, 1.0, 2.0], [10.0, 11.0, 12.0, 13.0])
    polygons = [(f"p{i}", [star(rng, rng.uniform(10, 13), rng.uniform(0, 2), rng.uniform(0.5, 2), rng.randint(3, 9))]) for i in range(15)]
    polygons.append(("holed", [[(9, -1), (14, -1), (14, 3), (9, 3)], [(10.2, 0.2), (11.9, 0.3), (11, 1.8)]]))
    prepared, edges = grid.prepare(grid_cells), layer(spark, polygons)
    share = {(r.area, r.cell_id): r.weight for r in spatial.cell_area(prepared, edges).collect()}
    rings = spatial.overlay(prepared, edges)
    sizes = rings.groupBy("area", "cell_id").agg(F.sum(areas.signed_area(F.col("points"))).alias("size")).collect()
    sizes = {(r.area, r.cell_id): r.size for r in sizes}
    for key in set(share) | set(sizes):
        # Vertices are on a 0.001 lattice.
        assert sizes.get(key, 0.0) == pytest.approx(share.get(key, 0.0), abs=0.01), key
    for r in rings.collect():
        assert all(round(c, 3) == c for p in r.points for c in p)


def test_too_small_and_unknown_areas(spark):
    grid_cells = cells(spark, [10, 11], [100, 101])
    edges = layer(spark, [("far", [[(0, 0), (1, 0), (1, 1)]]), ("near", [[(100, 10), (101, 10), (101, 11)]])])
    share = spatial.cell_area(grid.prepare(grid_cells), edges)
    assert [r.area for r in spatial.uncovered_areas(edges, share).collect()] == ["far"]
    rows = spark.createDataFrame([(c,) for c in range(4)], "cell_id bigint")
    assert spatial.clip(rows, share, "nowhere").count() == 0
    assert spatial.clip(rows, share, "near").count() == 3


def test_masked_and_single_cell_grids(spark):
    partial = cells(spark, [10, 11], [100, 101, 102]).filter("cell_id != 1")
    out = weights(spark, partial, [("all", [[(90, 0), (110, 0), (110, 20), (90, 20)]])])
    assert sorted(k[1] for k in out) == [0, 2, 3, 4, 5] and set(out.values()) == {1.0}
    single = cells(spark, [10], [100])
    assert weights(spark, single, [("all", [[(90, 0), (110, 0), (110, 20), (90, 20)]])]) == {("all", 0): 1.0}


def test_spherical_weight(spark):
    out = weights(spark, cells(spark, [60, 61], [0, 1]), [("all", [[(-5, 50), (5, 50), (5, 70), (-5, 70)]])], spherical=True)
    assert out["all", 0] == pytest.approx(0.5) and out["all", 2] == pytest.approx(math.cos(math.radians(61)))


def test_cell_bounds_of_an_uneven_axis(spark):
    table = grid.cell_bounds(cells(spark, [0.2, 0.9, 5.0], [359.5, 360.5])).orderBy("cell_id").collect()
    assert [r.lat_lo for r in table[::2]] == pytest.approx([-0.15, 0.55, 2.95])
    assert [r.lat_hi for r in table[::2]] == pytest.approx([0.55, 2.95, 7.05])
    assert [(r.row, r.col) for r in table] == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (2, 1)]


def test_cell_identifiers_are_distinct(spark):
    rows = [(lat / 8, lon / 8) for lat in range(-16, 16) for lon in range(-16, 16)]
    table = spark.createDataFrame(rows, "lat double, lon double").select(grid.cell_id("lat", "lon").alias("id"))
    assert table.distinct().count() == len(rows)


def test_names_and_sub_areas(spark):
    schema = "id int, adm_code string, label string, geometry string"
    columns, best = areas.name_columns(spark.createDataFrame([], schema))
    assert columns == ["adm_code", "label", "geometry"] and best == "adm_code"
    assert areas.name_columns(spark.createDataFrame([], "zip string, id int"))[1] == "zip"
    assert areas.name_columns(spark.createDataFrame([], "id int")) == ([], None)
    two = layer(spark, [("west", [WEST]), ("east", [EAST])])
    assert areas.sub_areas(two).count() == 8
    assert areas.sub_areas(layer(spark, [("west", [WEST])])).count() == 0


def test_geojson_files(spark, tmp_path):
    feature = {"type": "Feature", "properties": {"name": "x", "code": 3},
               "geometry": {"type": "MultiPolygon", "coordinates": [[WEST + WEST[:1]], [EAST + EAST[:1]]]}}
    nameless = {"type": "Feature", "properties": {"name": None}, "geometry": {"type": "Polygon", "coordinates": [WEST]}}
    whole = tmp_path / "layer.geojson"
    whole.write_text(json.dumps({"type": "FeatureCollection", "features": [feature, nameless]}, indent=1))
    lines = tmp_path / "layer.geojsonl"
    lines.write_text("\n".join(json.dumps(f) for f in (feature, nameless)))
    for path, by_line in ((whole, False), (lines, True)):
        edges = areas.read_areas(spark, str(path), "name", by_line)
        assert edges.count() == 8 and edges.select("polygon").distinct().count() == 2
        assert [r.area for r in areas.distinct_areas(edges).collect()] == ["x"]
    box = areas.extent(edges, "x").first()
    assert (box.west, box.south, box.east, box.north) == (99.5, 9.5, 102.5, 11.5)
    numbered = areas.read_areas(spark, str(whole), "code")
    assert [r.area for r in areas.distinct_areas(numbered).collect()] == ["3"]


def test_a_hot_area_is_spread(spark):
    """An area with very many vertices is cut by row and column before anything is grouped."""
    n = 4000
    ring = [(100 + 2.4 * math.cos(2 * math.pi * i / n), 10 + 2.4 * math.sin(2 * math.pi * i / n)) for i in range(n)]
    lats, lons = [8.0, 9.0, 10.0, 11.0, 12.0], [98.0, 99.0, 100.0, 101.0, 102.0]
    out = weights(spark, cells(spark, lats, lons), [("round", [ring]), ("box", [WEST])])
    total = sum(v for (a, _), v in out.items() if a == "round")
    assert total == pytest.approx(clip_area(ring, (97.5, 7.5, 102.5, 12.5)), abs=1e-7)


def test_cell_ids_of_floats_and_of_metres(spark):
    from isohyet.operators.grid import cell_id

    table = spark.createDataFrame([(10.1, 102.1), (-33.3, 179.95)], "lat double, lon double")
    single = table.select(F.col("lat").cast("float").cast("double").alias("lat"), F.col("lon").cast("float").cast("double").alias("lon"))
    assert table.unionByName(single).select(cell_id("lat", "lon").alias("c")).distinct().count() == 2
    with pytest.raises(Exception, match="not a latitude"):
        spark.createDataFrame([(4_500_000.0, 300_000.0)], "lat double, lon double").select(cell_id("lat", "lon")).collect()


def comb(teeth, x=0.0):
    """A polygon with teeth that hang down from a spine; edges are level or upright."""
    down = [p for i in range(teeth) for p in ((x + 2 * i, 0.2), (x + 2 * i + 1, 0.2), (x + 2 * i + 1, 1.3), (x + 2 * i + 2, 1.3))]
    return down[:-1] + [(x + 2 * teeth - 1, 1.8), (x, 1.8)]


def parts_by_cell(rings):
    out = {}
    for r in rings.collect():
        out.setdefault((r.area, r.cell_id), {}).setdefault(r.polygon, []).append([tuple(p) for p in r.points])
    return out


def test_overlay_separates_parts_that_meet_outside_the_cell(spark):
    grid_cells = cells(spark, [0.5, 1.5], [2.5, 7.5])  # one row under the spine, one with it
    edges = layer(spark, [("comb", [comb(4)])])
    found = parts_by_cell(spatial.overlay(grid.prepare(grid_cells), edges))
    teeth = [sorted(sorted(ring) for ring in part) for part in found["comb", 0].values()]
    assert sorted(teeth) == [[sorted([(x, 0.2), (x + 1, 0.2), (x + 1, 1.0), (x, 1.0)])] for x in (0.0, 2.0, 4.0)]
    assert len(found["comb", 1]) == 1 and len(found["comb", 2]) == 1


def test_overlay_turns_holes_at_a_side_into_notches_and_keeps_enclaves(spark):
    grid_cells = cells(spark, [0.5, 1.5], [0.5, 1.5])
    square, hole, inner = [(0, 0), (2, 0), (2, 2), (0, 2)], [(0.8, 0.2), (1.2, 0.2), (1.2, 0.4), (0.8, 0.4)], [(0.2, 1.2), (0.4, 1.2), (0.4, 1.4), (0.2, 1.4)]
    edges = layer(spark, [("land", [square, hole, inner]), ("enclave", [hole])])
    found = parts_by_cell(spatial.overlay(grid.prepare(grid_cells), edges))
    (notched,) = found["land", 0].values()
    assert [len(ring) for ring in notched] == [8]
    (holed,) = found["land", 2].values()
    assert sorted(len(ring) for ring in holed) == [4, 4]
    assert sorted(c for a, c in found if a == "enclave") == [0, 1]


def test_overlay_parts_cover_exactly_the_polygon(spark):
    rng = random.Random(31)
    lats, lons = [0.5, 1.5, 2.5], [0.5, 1.5, 2.5]
    grid_cells = cells(spark, lats, lons)
    polygons = [(f"p{i}", [star(rng, 1.5, 1.5, 2.2, 40)]) for i in range(6)]  # spikes in and out of every cell
    found = parts_by_cell(spatial.overlay(grid.prepare(grid_cells), layer(spark, polygons), digits=9))
    several = 0
    for name, (ring,) in polygons:
        for cell in range(9):
            x0, y0 = cell % 3, cell // 3
            parts = list(found.get((name, cell), {}).values())
            several += len(parts) > 1
            for _ in range(60):
                p = (x0 + rng.random(), y0 + rng.random())
                odd = [sum(rings._inside(p, loop) for loop in part) % 2 for part in parts]
                assert sum(odd) == rings._inside(p, [(float(a), float(b)) for a, b in ring]), (name, cell, p)
    assert several > 5


def test_outline_of_a_layer_has_no_inner_borders(spark):
    # two tiles with a T-junction, a third around a hole, an island in the hole, and one that touches at a corner only
    west, east_low, east_high = [(0, 0), (1, 0), (1, 2), (0, 2)], [(1, 0), (2, 0), (2, 1), (1, 1)], [(1, 1), (2, 1), (2, 2), (1, 2)]
    frame, gap, island = [(5, 0), (9, 0), (9, 4), (5, 4)], [(6, 1), (8, 1), (8, 3), (6, 3)], [(6.5, 1.5), (7, 1.5), (7, 2)]
    edges = layer(spark, [("a", [west]), ("b", [east_low]), ("c", [east_high]), ("d", [frame, gap]), ("e", [island]), ("f", [[(2, 2), (3, 2), (3, 3), (2, 3)]])])
    rows = rings.outline(edges).collect()
    loops, owner = {}, {}
    for r in sorted(rows, key=lambda r: (r.ring, r.seq)):
        loops.setdefault(r.ring, []).append((r.ax, r.ay))
        owner[r.ring] = r.polygon
    assert {r.area for r in rows} == {"overview"}
    for r in rows:  # every edge starts where the one before it ends
        loop = loops[r.ring]
        assert (r.bx, r.by) == loop[(r.seq + 1) % len(loop)]
    shapes = {k: frozenset(v) for k, v in loops.items()}
    tiles = frozenset([(0, 0), (1, 0), (2, 0), (2, 1), (2, 2), (1, 2), (0, 2)])
    assert sorted(map(sorted, shapes.values())) == sorted(map(sorted, [tiles, frozenset(frame), frozenset(gap), frozenset(island), frozenset([(2, 2), (3, 2), (3, 3), (2, 3)])]))
    by_shape = {v: k for k, v in shapes.items()}
    assert owner[by_shape[frozenset(gap)]] == by_shape[frozenset(frame)]  # the hole belongs to its polygon
    assert owner[by_shape[frozenset(island)]] == by_shape[frozenset(island)]
    cells_ = parts_by_cell(spatial.overlay_boundary(grid.prepare(cells(spark, [0.5, 1.5], [0.5, 1.5])), layer(spark, [("a", [west]), ("b", [east_low]), ("c", [east_high])])))
    assert {k: len(v) for k, v in cells_.items()} == {("overview", c): 1 for c in range(4)}


def test_touched_cells_keep_what_is_met_at_a_line_or_a_corner(spark):
    prepared = grid.prepare(cells(spark, [0.5, 1.5, 2.5], [0.5, 1.5, 2.5]))
    edges = layer(spark, [("square", [[(1, 1), (2, 1), (2, 2), (1, 2)]]), ("inside", [[(0.2, 0.2), (0.4, 0.2), (0.3, 0.4)]]),
                          ("slanted", [[(0.5, 1.5), (1.5, 2.5), (0.5, 2.5)]])])
    share = spatial.cell_area(prepared, edges)
    found = {}
    for r in spatial.touched_cells(prepared, edges, share).collect():
        found.setdefault(r.area, set()).add(r.cell_id)
    assert found == {"square": set(range(9)), "inside": {0}, "slanted": {3, 6, 7, 4}}
    assert {r.cell_id for r in share.filter("area = 'square'").collect()} == {4}
