"""Writers.  Every sink replaces the partitions it holds rows for and leaves the others alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.operators.grid import Grid, outline
from isohyet.sources.areas import as_polygons, polygons

# The folders users look maps and series up in.  What they belong to - the layer and the settings - comes
# right after the country, so that another layer or baseline has folders of its own.
MAP_KEYS = ["country", "layer", "setting", "area", "index", "style", "mode", "span"]
SERIES_KEYS = ["country", "layer", "setting", "area", "index"]


def balanced(table: DataFrame, *partitions: str) -> DataFrame:
    """Rows gathered by output folder, so that a folder gets few files.

    A rebalance rather than a repartition: adaptive execution splits a folder that holds a large share of
    the rows over several tasks and puts small folders together.
    """
    return table.hint("rebalance", *[F.col(c) for c in partitions])


def write_obs(obs: DataFrame, path: str) -> None:
    """Merged observations by variable and year.

    Within a file the rows of a cell lie together, from south-west to north-east, so filters on position and
    date skip row groups.
    """
    table = balanced(obs.withColumn("year", F.year("date")), "variable", "year")
    table = table.sortWithinPartitions("variable", "year", "cell_id", "date")
    (
        table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("variable", "year").parquet(path)
    )


def save_obs_table(obs: DataFrame, name: str, path: str, buckets: int) -> None:
    """Merged observations as a catalogue table bucketed by cell, partitioned by variable.

    Every later index run reads each cell's series from one bucket, so the one shuffle the indices need is
    paid once, here.  One file per bucket and variable.
    """
    (
        obs.repartition(buckets, "cell_id").sortWithinPartitions("variable", "cell_id", "date")
        .write.mode("overwrite").partitionBy("variable").bucketBy(buckets, "cell_id").sortBy("cell_id", "date")
        .option("path", path).saveAsTable(name)
    )


def write_table(table: DataFrame, path: str, *partitions: str) -> None:
    if not partitions:
        table.write.mode("overwrite").parquet(path)
        return
    writer = balanced(table, *partitions).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partitions).parquet(path)


def write_index_values(values: DataFrame, path: str, *identity: str) -> None:
    """Index values by what they belong to (``identity``), frequency and index."""
    write_table(values, path, *identity, "freq", "index")


def feature(geometry, properties: list[str]):
    """A GeoJSON feature as text; null properties are left out."""
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Polygon").alias("type"), geometry.alias("coordinates")).alias("geometry"),
        F.struct(*properties).alias("properties"),
    ))


def cell_features(values: DataFrame, grid: Grid, properties: list[str]) -> DataFrame:
    """Cell values -> rows with ``feature``, the outline of the whole cell."""
    placed = values.join(grid.cells, "cell_id")
    return placed.withColumn("feature", feature(F.array(outline()), properties)).select(*values.columns, "feature")


def cell_outlines(rings: DataFrame) -> DataFrame:
    """The overlay's rings as (cell_id, area, polygon, coordinates)."""
    return as_polygons(rings, "cell_id", "area", "polygon")


def cut_features(values: DataFrame, outlines: DataFrame, properties: list[str]) -> DataFrame:
    """Cell values -> one feature per cell, area and polygon part, cut to the area."""
    placed = values.drop("area").join(outlines, "cell_id")
    return placed.withColumn("feature", feature(F.col("coordinates"), properties)).drop("coordinates", "polygon")


def area_features(values: DataFrame, area_edges: DataFrame, properties: list[str]) -> DataFrame:
    """Area values -> one feature per polygon of the area."""
    named = values.withColumn("name", F.col("area")).join(polygons(area_edges), "area")
    return named.withColumn("feature", feature(F.col("coordinates"), ["name", *properties])).drop(
        "coordinates", "polygon", "name"
    )


def boundary_features(area_edges: DataFrame) -> DataFrame:
    """The public outline: name and geometry only."""
    outlines = polygons(area_edges).withColumn("name", F.col("area"))
    return outlines.select("area", feature(F.col("coordinates"), ["name"]).alias("feature"))


def write_boundary(area_edges: DataFrame, path: str) -> None:
    boundary_features(area_edges).select("feature").write.mode("overwrite").text(path)


def span_name(first_year: int, last_year: int, threshold: float | None = None) -> str:
    return f"{first_year}_{last_year}" + (f"_{threshold}" if threshold is not None else "")


def write_map(features: DataFrame, path: str) -> None:
    """Features as newline-delimited GeoJSON under country/layer/setting/area/index/style/mode/span."""
    (
        balanced(features.select(*MAP_KEYS, "feature"), *MAP_KEYS).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy(*MAP_KEYS).text(path)
    )


def write_metadata(metadata: DataFrame, path: str, keys: list[str]) -> None:
    """The sidecar of maps or series - unit, dates, years, method, threshold - kept by the keys of what it describes."""
    table = balanced(metadata, *keys)
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).json(path)


def write_series(series: DataFrame, path: str) -> None:
    """Chart records as JSON lines, by country, layer, setting, area and index."""
    (
        balanced(series, *SERIES_KEYS).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy(*SERIES_KEYS).json(path)
    )


def not_yet_present(requested: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Requested outputs that do not exist yet."""
    return requested.join(existing.select(*keys).distinct(), keys, "left_anti")
