"""Area layers: polygons with a name, as directed edges.

Exterior rings run counter-clockwise and holes clockwise, so sums over edges subtract holes by themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from isohyet import model
from isohyet.functions.rounding import snap
from isohyet.operators.rings import outline

FEATURES = "type string, properties map<string, string>, geometry struct<type: string, coordinates: string>"


def read_features(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """GeoJSON in longitude/latitude -> (properties, geometry), one row per feature.

    ``lines`` reads newline-delimited features, which Spark splits among tasks; use it for large layers.
    A FeatureCollection document is one record by its nature; many documents are read in parallel.
    """
    if lines:
        return spark.read.schema(FEATURES).json(path).filter("type = 'Feature'").select("properties", "geometry")
    schema = f"type string, features array<struct<{FEATURES.replace(' string', ': string', 1).replace('properties ', 'properties: ').replace('geometry ', 'geometry: ')}>>"
    documents = spark.read.schema(schema).option("multiLine", True).json(path)
    return documents.select(F.explode("features").alias("f")).select("f.properties", "f.geometry")


def rings(features: DataFrame, area: Column) -> DataFrame:
    """Features -> (area, polygon, ring, hole, points): one row per ring.

    Rings get the orientation their role asks for, whatever the file used.  Unnamed features are dropped.
    """
    coordinates = F.col("geometry.coordinates")
    polygons = F.when(
        F.col("geometry.type") == "Polygon",
        F.array(F.from_json(coordinates, "array<array<array<double>>>")),
    ).when(
        F.col("geometry.type") == "MultiPolygon",
        F.from_json(coordinates, "array<array<array<array<double>>>>"),
    )
    exploded = (
        features.select(area.alias("area"), polygons.alias("polygons"))
        .filter(F.col("area").isNotNull())
        .select("area", F.posexplode("polygons").alias("part", "polygon"))
        .select("area", "part", "polygon", F.posexplode("polygon").alias("position", "points"))
    )
    return exploded.select(
        "area",
        F.xxhash64("area", "part", "polygon").alias("polygon"),
        F.xxhash64("area", "part", "position", "points").alias("ring"),
        (F.col("position") > 0).alias("hole"),
        "points",
    )


def signed_area(points: Column) -> Column:
    """Shoelace area of a ring; positive when counter-clockwise."""
    n = F.size(points)

    def term(i):
        a, b = F.get(points, i), F.get(points, (i + 1) % n)
        return F.get(a, F.lit(0)) * F.get(b, F.lit(1)) - F.get(b, F.lit(0)) * F.get(a, F.lit(1))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda acc, i: acc + term(i)) / 2.0


def edges(ring_table: DataFrame) -> DataFrame:
    """Rings -> ``area_edges``; rings may be open or closed."""
    points = F.col("points")
    backwards = (signed_area(points) < 0) != F.col("hole")
    oriented = ring_table.withColumn("points", F.when(backwards, F.reverse(points)).otherwise(points))
    # Each vertex is paired with the next one before the rows are made, so no row carries the whole ring.
    following = F.concat(F.slice("points", 2, F.size("points")), F.slice("points", 1, 1))
    pairs = F.arrays_zip(F.col("points").alias("a"), following.alias("b"))
    indexed = oriented.select("area", "polygon", "ring", F.posexplode(pairs).alias("seq", "e"))

    def coordinate(end: str, axis: int) -> Column:
        return F.get(F.col(f"e.{end}"), F.lit(axis))

    return indexed.select(
        "area", "polygon", "ring", "seq",
        coordinate("a", 0).alias("ax"), coordinate("a", 1).alias("ay"),
        coordinate("b", 0).alias("bx"), coordinate("b", 1).alias("by"),
    ).filter("ax != bx or ay != by")


def read_areas(spark: SparkSession, path: str, column: str, lines: bool = False) -> DataFrame:
    """Area layer -> ``area_edges``, named by a feature property."""
    return edges(rings(read_features(spark, path, lines), F.col("properties").getItem(column)))


# Substrings that mark a column as the area name.
NAME_HINTS = ["name", "nam", "prov", "adm", "dist", "changwat", "th", "en"]


def name_columns(layer: DataFrame) -> tuple[list[str], str | None]:
    """Text columns of a layer, and the first whose name hints at an area name, else the first one."""
    text = [f.name for f in layer.schema.fields if isinstance(f.dataType, StringType)]
    hinted = [c for c in text if any(h in c.lower() for h in NAME_HINTS)]
    return text, (hinted or text or [None])[0]


def distinct_areas(area_edges: DataFrame) -> DataFrame:
    return area_edges.select("area").where("area is not null").distinct()


def sub_areas(area_edges: DataFrame) -> DataFrame:
    """The edges of a layer with several areas; empty where there is at most one."""
    names = distinct_areas(area_edges).agg(F.count("*")).scalar()
    return area_edges.filter(names > 1)


def dissolve(area_edges: DataFrame, name: str = model.OVERVIEW) -> DataFrame:
    """All areas as one multi-part area, for sums over edges.

    Areas are taken not to overlap.  A border shared by two of them occurs once in each direction, so it
    cancels in every such sum and needs no removal; ``rings.outline`` removes it where geometry is shown.
    """
    return area_edges.withColumn("area", F.lit(name))


def with_overview(area_edges: DataFrame) -> DataFrame:
    """The sub-areas, where there are several, and the outline of the whole, which is found here and stored."""
    return sub_areas(area_edges).unionByName(outline(area_edges))


def extent(area_edges: DataFrame, area: str | None = None) -> DataFrame:
    """Bounding box of each area, of one area, or - for ``'*'`` - of the whole layer."""
    if area not in (None, "*"):
        area_edges = area_edges.filter(F.col("area") == area)
    box = [F.min("ax").alias("west"), F.min("ay").alias("south"), F.max("ax").alias("east"), F.max("ay").alias("north")]
    return area_edges.agg(*box) if area == "*" else area_edges.groupBy("area").agg(*box)


def polygons(area_edges: DataFrame) -> DataFrame:
    """Edges back to (area, polygon, coordinates): closed rings, outside first, snapped to 0.001 degree."""
    point = F.array(snap("ax"), snap("ay"))
    ordered = F.array_sort(F.collect_list(F.struct("seq", point.alias("p"))))
    rings_ = area_edges.groupBy("area", "polygon", "ring").agg(
        F.transform(ordered, lambda e: e["p"]).alias("points")
    )
    return as_polygons(rings_, "area", "polygon")


def as_polygons(ring_rows: DataFrame, *keys: str) -> DataFrame:
    """Rings -> one row per key with ``coordinates``; clockwise rings are holes and follow the outside."""
    closed = F.concat("points", F.slice("points", 1, 1))
    parts = ring_rows.withColumn("hole", signed_area(F.col("points")) < 0).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("hole", closed.alias("points")))).alias("parts")
    )
    return parts.select(*keys, F.transform("parts", lambda p: p["points"]).alias("coordinates"))
