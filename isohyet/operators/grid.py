"""Grid cells: identifiers, bounds, outlines and spacing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isohyet.session import settle


@dataclass(frozen=True)
class Grid:
    """The cells of a dataset with bounds and row/column numbers, and seven facts about them.

    ``cells(cell_id, lat, lon, lat_lo, lat_hi, lon_lo, lon_hi, row, col)``
    """

    cells: DataFrame
    row_height: float
    col_width: float
    south: float
    north: float
    west: float
    east: float
    last_col: int

    @property
    def rows(self) -> DataFrame:
        return self.cells.select("row", "lat_lo", "lat_hi").distinct()

    @property
    def columns(self) -> DataFrame:
        return self.cells.select("col", "lon_lo", "lon_hi").distinct()


def prepare(cells: DataFrame) -> Grid:
    """``cells(cell_id, lat, lon)`` -> Grid.  Runs two small jobs; do it once per dataset and reuse it."""
    numbered = settle(cell_bounds(cells))
    facts = numbered.agg(
        F.avg(F.col("lat_hi") - F.col("lat_lo")), F.avg(F.col("lon_hi") - F.col("lon_lo")),
        F.min("lat_lo"), F.max("lat_hi"), F.min("lon_lo"), F.max("lon_hi"), F.max("col"),
    ).first()
    if facts[0] is None:
        raise ValueError("the grid has no cells")
    return Grid(numbered, *facts)


def cell_id(lat, lon) -> Column:
    """A reversible identifier from the centre, exact to 1e-4 degree: no numbering pass is needed.

    The step is wider than the rounding of single-precision coordinates, so float and double copies of a grid
    share their cells.  Coordinates that are no degrees (metres, say) fail.
    """
    lat, lon = (F.col(c) if isinstance(c, str) else c for c in (lat, lon))
    south = F.round((lat + 90.0) * 1e4).cast("long")
    west = F.round((lon + 180.0) * 1e4).cast("long")
    message = F.concat(F.lit("not a latitude and longitude in degrees: "), lat.cast("string"), F.lit(", "), lon.cast("string"))
    fits = lat.between(-90, 90) & lon.between(-360, 360)
    return F.when(fits | lat.isNull() | lon.isNull(), south * F.lit(1_000_000_000) + west).otherwise(F.raise_error(message).cast("long"))


def neighbours(df: DataFrame, axis: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Distinct coordinates of an axis with their rank (from 0) and the next smaller and larger one.

    Coordinates are compared within whole-degree bands, and the bands - at most one per degree - among
    themselves, so that a long axis is never ordered in one task.
    """
    value = F.col(axis)
    distinct = df.select(*keys, axis).distinct().withColumn("band", F.floor(value).cast("int"))
    bands = distinct.groupBy(*keys, "band").agg(
        F.min(axis).alias("band_min"), F.max(axis).alias("band_max"), F.count("*").alias("size")
    )
    across = Window.partitionBy(*keys).orderBy("band")
    bands = bands.select(
        *keys, "band",
        F.lag("band_max").over(across).alias("band_before"),
        F.lead("band_min").over(across).alias("band_after"),
        (F.sum("size").over(across) - F.col("size")).alias("below"),
    )
    inside = Window.partitionBy(*keys, "band").orderBy(axis)
    return (
        distinct.withColumns({
            "before": F.lag(axis).over(inside),
            "after": F.lead(axis).over(inside),
            "rank": F.row_number().over(inside) - 1,
        })
        .join(bands, [*keys, "band"])
        .select(
            *keys, axis,
            (F.col("rank") + F.col("below")).alias("position"),
            F.coalesce("before", "band_before").alias("before"),
            F.coalesce("after", "band_after").alias("after"),
        )
    )


def axis_bounds(df: DataFrame, axis: str) -> DataFrame:
    """Edges halfway to the neighbours; the outermost edges mirror the inner ones.

    A one-cell axis has no spacing, and one degree is assumed.
    """
    value, before, after = F.col(axis), F.col("before"), F.col("after")
    low = F.coalesce((before + value) / 2.0, value - (after - value) / 2.0, value - 0.5)
    high = F.coalesce((value + after) / 2.0, value + (value - before) / 2.0, value + 0.5)
    return neighbours(df, axis).select(axis, "position", low.alias(f"{axis}_lo"), high.alias(f"{axis}_hi"))


def cell_bounds(cells: DataFrame) -> DataFrame:
    """``cells(cell_id, lat, lon)`` -> with bounds, row (from the south) and column (from the west)."""
    return (
        cells.join(axis_bounds(cells, "lat").withColumnRenamed("position", "row"), "lat")
        .join(axis_bounds(cells, "lon").withColumnRenamed("position", "col"), "lon")
        .select("cell_id", "lat", "lon", "lat_lo", "lat_hi", "lon_lo", "lon_hi", "row", "col")
    )


def outline() -> Column:
    """The closed box of a cell as [lon, lat] pairs, counter-clockwise from the south-west corner."""
    corners = [("lon_lo", "lat_lo"), ("lon_hi", "lat_lo"), ("lon_hi", "lat_hi"), ("lon_lo", "lat_hi"),
               ("lon_lo", "lat_lo")]
    return F.array(*[F.array(*corner) for corner in corners])


def outline_centre(ring) -> tuple[Column, Column]:
    """(lon, lat) in the middle of the bounding box of a ring."""
    ring = F.col(ring) if isinstance(ring, str) else ring

    def middle(i: int) -> Column:
        values = F.transform(ring, lambda p: F.get(p, F.lit(i)))
        return (F.array_min(values) + F.array_max(values)) / 2.0

    return middle(0), middle(1)


def spacing(df: DataFrame, axis: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per key: mean, smallest, largest and first spacing of the distinct coordinates."""
    step = F.col("after") - F.col(axis)
    summary = [
        F.avg(step).alias("mean_step"),
        F.min(step).alias("min_step"),
        F.max(step).alias("max_step"),
        F.min_by(step, F.col(axis)).alias("first_step"),
    ]
    table = neighbours(df, axis, keys)
    return table.groupBy(*keys).agg(*summary) if keys else table.agg(*summary)
