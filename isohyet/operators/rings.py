"""Valid rings: parts of a polygon inside one cell, and the outline of a whole layer.

Inside a cell, polygons that were cut along grid lines run back and forth on the cell's sides wherever they leave the
cell and come back.  What runs both ways cancels; what is left is linked into rings again, so that every
part is a ring of its own and holes that reach the side become notches.  A cell's pieces are few, so this is a small
function.

The outline of a layer has no such bound.  Borders shared by two areas occur once in each direction and cancel in one
aggregation, after edges are split where a vertex of a neighbour lies on them; the remaining edges find their
successors by a join, and rings, with the order inside them, by pointer doubling.
"""

from __future__ import annotations

import json
import math
import sys
from collections import Counter, defaultdict

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from isohyet import model
from isohyet.session import settle

# The functions below travel to the executors by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Point = tuple[float, float]
PARTS = "array<array<array<array<double>>>>"
DIGITS = 9           # coordinates that agree so far are one vertex
ON_EDGE = 1e-9       # degrees between a vertex and an edge that it lies on


def _turn(back: Point, out: Point) -> float:
    """Clockwise angle from one direction to another, in (0, 2 pi]."""
    angle = (math.atan2(back[1], back[0]) - math.atan2(out[1], out[0])) % (2 * math.pi)
    return angle or 2 * math.pi


def _area(ring: list[Point]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2


def _inside(point: Point, ring: list[Point]) -> bool:
    x, y = point
    odd = False
    for a, b in zip(ring, ring[1:] + ring[:1]):
        if (a[1] <= y) != (b[1] <= y) and x > a[0] + (y - a[1]) / (b[1] - a[1]) * (b[0] - a[0]):
            odd = not odd
    return odd


def _net_edges(rings: list[list[Point]], box: tuple[float, float, float, float]) -> Counter:
    """Directed edges with what runs both ways taken out; on the box's sides also where only parts overlap."""
    west, south, east, north = box
    lines = {(0, west), (0, east), (1, south), (1, north)}
    on_side, edges = defaultdict(list), Counter()
    for ring in rings:
        for a, b in zip(ring, ring[1:] + ring[:1]):
            if a == b:
                continue
            side = next(((axis, a[axis]) for axis in (0, 1) if a[axis] == b[axis] and (axis, a[axis]) in lines), None)
            if side:
                on_side[side].append((a[1 - side[0]], b[1 - side[0]]))
            elif edges[b, a]:
                edges[b, a] -= 1
            else:
                edges[a, b] += 1
    for (axis, at), runs in on_side.items():
        change = Counter()
        for p, q in runs:
            change[min(p, q)] += 1 if p < q else -1
            change[max(p, q)] -= 1 if p < q else -1
        net, start = 0, None
        for place in sorted(change):
            if change[place]:
                if net:
                    ends = (start, place) if net > 0 else (place, start)
                    edges[tuple((at, v) if axis == 0 else (v, at) for v in ends)] += abs(net)
                net, start = net + change[place], place
    return +edges


def _loops(edges: Counter) -> list[list[Point]]:
    """Closed walks, always taking the sharpest left turn, cut where they pass a vertex again."""
    out = defaultdict(list)
    for (a, b), n in edges.items():
        out[a] += [b] * n
    found = []
    for start in sorted(out):
        while out[start]:
            walk, here, back = [start], out[start].pop(), None
            while here != start or (back is None):
                before = walk[-1]
                if here in walk:  # a loop closes here; the walk goes on from its beginning
                    at = walk.index(here)
                    found.append(walk[at:])
                    walk = walk[:at]
                walk.append(here)
                if here == start or not out[here]:
                    break
                back = (before[0] - here[0], before[1] - here[1])
                out[here].sort(key=lambda p: -_turn(back, (p[0] - here[0], p[1] - here[1])))
                here = out[here].pop()
            found.append(walk)
    return found


def _straightened(ring: list[Point], box: tuple[float, float, float, float]) -> list[Point]:
    """Without vertices in the middle of a side, from the smallest vertex on."""
    west, south, east, north = box

    def spare(a: Point, b: Point, c: Point) -> bool:
        return (a[0] == b[0] == c[0] and b[0] in (west, east)) or (a[1] == b[1] == c[1] and b[1] in (south, north))

    kept = [b for a, b, c in zip(ring[-1:] + ring[:-1], ring, ring[1:] + ring[:1]) if not spare(a, b, c)]
    first = kept.index(min(kept)) if kept else 0
    return kept[first:] + kept[:first]


def valid_parts(rings: list[list[Point]], box: tuple[float, float, float, float]) -> list[list[list[Point]]]:
    """Parts, each its outside ring (counter-clockwise) and its holes, of rings that were cut to a box."""
    loops = [_straightened(loop, box) for loop in _loops(_net_edges(rings, box))]
    sized = [(_area(loop), loop) for loop in loops if len(loop) > 2]
    outside = sorted(((a, loop) for a, loop in sized if a > 0), key=lambda e: e[1])
    parts = [[loop] for _, loop in outside]
    for size, hole in sorted((e for e in sized if e[0] < 0), key=lambda e: e[1]):
        middle = ((hole[0][0] + hole[1][0]) / 2, (hole[0][1] + hole[1][1]) / 2)
        around = [(a, i) for i, (a, loop) in enumerate(outside) if a > -size and _inside(middle, loop)]
        if around:
            parts[min(around)[1]].append(hole)
    return parts


@F.pandas_udf(StringType())
def parts_of(rings: pd.Series, west: pd.Series, south: pd.Series, east: pd.Series, north: pd.Series) -> pd.Series:
    """``valid_parts`` of the rows that have rings, as JSON, since nested arrays do not travel safely to and fro."""

    def row(text, *box):
        return None if text is None else json.dumps(valid_parts([[tuple(p) for p in ring] for ring in json.loads(text)], box))

    return pd.Series([row(*values) for values in zip(rings, west, south, east, north)], dtype=object)


def _rounded(name: str):
    return (F.round(name, DIGITS) + 0.0).alias(name)  # -0.0 becomes 0.0


def split_at_vertices(edges: DataFrame) -> DataFrame:
    """``edges(ax, ay, bx, by)`` cut wherever a vertex of another edge lies on them.

    Edges and vertices meet in square bins about one edge wide; an edge is only in the bins along its way.
    """
    numbered = settle(edges.select(*(_rounded(c) for c in ("ax", "ay", "bx", "by"))).filter("ax != bx or ay != by")
                      .withColumn("id", F.monotonically_increasing_id()))
    width = numbered.agg(F.avg(F.greatest(F.abs(F.expr("bx - ax")), F.abs(F.expr("by - ay"))))).first()[0]
    if width is None:
        return numbered.drop("id")
    low, high = F.least("ax", "bx"), F.greatest("ax", "bx")
    columns = numbered.withColumn("i", F.explode(F.sequence(
        F.floor((low - ON_EDGE) / width), F.floor((high + ON_EDGE) / width))))
    # Where the edge is when it enters and leaves the column of bins.
    near = F.greatest(low, F.least(high, F.col("i") * width))
    far = F.greatest(low, F.least(high, (F.col("i") + 1) * width))
    slope = F.when(F.col("bx") != F.col("ax"), (F.col("by") - F.col("ay")) / (F.col("bx") - F.col("ax")))
    at = [F.when(slope.isNull(), F.col(end)).otherwise(F.col("ay") + slope * (x - F.col("ax"))) for x, end in ((near, "ay"), (far, "by"))]
    bins = columns.withColumns({"from": F.least(*at), "to": F.greatest(*at)}).withColumn("j", F.explode(F.sequence(
        F.floor((F.col("from") - ON_EDGE) / width), F.floor((F.col("to") + ON_EDGE) / width)))).drop("from", "to")
    vertices = numbered.select(F.col("ax").alias("x"), F.col("ay").alias("y")).union(numbered.select("bx", "by")).distinct()
    placed = vertices.withColumns({"i": F.floor(F.col("x") / width), "j": F.floor(F.col("y") / width)})
    dx, dy, px, py = (F.expr(e) for e in ("bx - ax", "by - ay", "x - ax", "y - ay"))
    length2 = dx * dx + dy * dy
    along = (px * dx + py * dy) / length2
    on = (F.abs(px * dy - py * dx) <= ON_EDGE * F.sqrt(length2)) & (along > 0) & (along < 1)
    ends = ((F.col("x") == F.col("ax")) & (F.col("y") == F.col("ay"))) | ((F.col("x") == F.col("bx")) & (F.col("y") == F.col("by")))
    stops = (bins.join(placed, ["i", "j"]).filter(on & ~ends)
             .groupBy("id").agg(F.array_sort(F.collect_set(F.struct(along.alias("t"), F.col("x"), F.col("y")))).alias("stops")))
    path = F.concat(
        F.array(F.struct(F.lit(0.0).alias("t"), F.col("ax").alias("x"), F.col("ay").alias("y"))),
        F.coalesce("stops", F.array().cast("array<struct<t:double,x:double,y:double>>")),
        F.array(F.struct(F.lit(1.0).alias("t"), F.col("bx").alias("x"), F.col("by").alias("y"))))
    steps = F.transform(F.sequence(F.lit(0), F.size("path") - 2), lambda k: F.struct(
        F.get("path", k).alias("a"), F.get("path", k + 1).alias("b")))
    cut = numbered.join(stops, "id", "left").withColumn("path", path).select(F.explode(steps).alias("s"))
    return cut.select(*(F.col(f"s.{end}.{axis}").alias(f"{end}{axis}") for end in "ab" for axis in "xy"))


def net_edges(edges: DataFrame) -> DataFrame:
    """The edges of which one direction occurs more often than the other, once; inner borders are gone."""
    forward = F.struct("ax", "ay") < F.struct("bx", "by")
    names = ["ax", "ay", "bx", "by"]
    turned = [F.when(forward, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in zip(names, names[2:] + names[:2])]
    counted = edges.select(*turned, F.when(forward, 1).otherwise(-1).alias("way")).groupBy(*names).agg(F.sum("way").alias("net"))
    back = [F.when(F.col("net") > 0, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in zip(names, names[2:] + names[:2])]
    return counted.filter("net <> 0").select(*back)


def _ordered(edges: DataFrame) -> DataFrame:
    """``edges(ax, ay, bx, by)`` with ``ring``, the smallest id in it, and ``seq``, the place in the ring."""
    numbered = settle(edges.withColumn("id", F.monotonically_increasing_id()))
    follow = numbered.select(F.col("id").alias("next"), F.col("ax").alias("bx"), F.col("ay").alias("by"), F.col("bx").alias("cx"), F.col("by").alias("cy"))
    angle = F.atan2(F.expr("ay - by"), F.expr("ax - bx")) - F.atan2(F.expr("cy - by"), F.expr("cx - bx"))
    turn = F.pmod(angle, F.lit(2 * math.pi))
    state = (numbered.join(follow, ["bx", "by"])
             .groupBy("id").agg(F.min_by("next", F.when(turn > 0, turn).otherwise(2 * math.pi)).alias("jump"))
             .select("id", "jump", F.col("id").alias("least"), F.lit(0).cast("long").alias("steps")))
    state, width, moving = settle(state), 1, True
    while moving:
        ahead = state.select(F.col("id").alias("jump"), F.col("jump").alias("beyond"), F.col("least").alias("other"), F.col("steps").alias("further"))
        nearer = F.col("least") <= F.col("other")
        both = settle(state.join(ahead, "jump").select(
            "id", F.col("beyond").alias("jump"), F.least("least", "other").alias("least"),
            F.when(nearer, F.col("steps")).otherwise(F.col("further") + width).alias("steps"), (~nearer).alias("moved")))
        moving = not both.filter("moved").isEmpty()
        state, width = both.drop("moved"), 2 * width
    lengths = state.groupBy("least").agg(F.count("*").alias("n"))
    placed = state.join(lengths, "least").select("id", F.col("least").alias("ring"), F.pmod(F.col("n") - F.col("steps"), F.col("n")).alias("seq"))
    return numbered.join(placed, "id")


def outline(area_edges: DataFrame, name: str = model.OVERVIEW) -> DataFrame:
    """The outline of all areas together, as ``area_edges`` of one area: no inner borders, holes with their polygon.

    The result is stored.  Where two parts only touch at a vertex they stay two rings; a hole that touches the outside
    at a vertex becomes part of that ring.  Edges that close no ring are left out.
    """
    ordered = settle(_ordered(net_edges(split_at_vertices(area_edges))))
    doubled = F.sum(F.expr("ax * by - bx * ay"))
    sizes = ordered.groupBy("ring").agg(doubled.alias("size"))
    outside = ordered.join(sizes.filter("size > 0"), "ring")
    middle = [((F.col(a) + F.col(b)) / 2).alias(p) for a, b, p in (("ax", "bx", "px"), ("ay", "by", "py"))]
    holes = ordered.filter("id = ring").join(sizes.filter("size < 0"), "ring").select(
        F.col("ring").alias("hole"), F.col("size").alias("hole_size"), *middle)
    # A hole's point against the outside edges at its height, met in bands of latitude.
    bands = outside.withColumn("band", F.explode(F.sequence(F.floor(F.least("ay", "by") * 10), F.floor(F.greatest("ay", "by") * 10))))
    west_of = F.col("px") > F.col("ax") + (F.col("py") - F.col("ay")) / (F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax"))
    crossed = (holes.withColumn("band", F.floor(F.col("py") * 10)).join(bands, "band")
               .filter(((F.col("ay") <= F.col("py")) != (F.col("by") <= F.col("py"))) & west_of & (F.col("size") > -F.col("hole_size")))
               .groupBy("hole", "ring").agg(F.count("*").alias("n"), F.max("size").alias("size")).filter("n % 2 = 1"))
    owner = crossed.groupBy("hole").agg(F.min_by("ring", "size").alias("polygon")).withColumnRenamed("hole", "ring")
    whole = ordered.join(owner, "ring", "left")
    return settle(whole.select(
        F.lit(name).alias("area"), F.coalesce("polygon", "ring").alias("polygon"), "ring", F.col("seq").cast("int").alias("seq"),
        "ax", "ay", "bx", "by"))
