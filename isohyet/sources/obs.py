"""Reading gridded observations held as tables, one row per time and cell, one column per variable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from isohyet import model
from isohyet.operators import clean
from isohyet.operators.grid import cell_id

COORDINATES = ["time", "latitude", "longitude"]


def source_file() -> Column:
    """The file a row comes from; a folder of part files written by one job counts as one file."""
    return F.regexp_replace(F.col("_metadata.file_path"), "/part-[^/]*$", "")


def _scan(spark: SparkSession, paths: list[str], fmt: str, tolerant: bool = False, pattern: str | None = None) -> DataFrame:
    reader = spark.read
    if tolerant:
        reader = reader.option("ignoreCorruptFiles", True)
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    if fmt == "csv":
        # Everything arrives as text and is cast below, which spares the inference pass.
        reader = reader.option("header", True)
    elif fmt not in ("parquet", "orc"):
        raise ValueError(f"unsupported format '{fmt}'")
    return reader.format(fmt).load(sorted(paths))


def read_grid(
    spark: SparkSession, paths: str | list[str], units: dict[str, str], fmt: str = "parquet",
    strict: bool = True, only: list[str] | None = None, years: tuple[int | None, int | None] = (None, None),
    tolerant: bool = False, pattern: str | None = None,
) -> DataFrame:
    """Files of daily grids -> ``obs`` with canonical names and units.

    ``units`` states the unit of each variable, by its canonical name.  The file path becomes ``src``; when
    files overlap, path order decides.  A CSV file must have a ``time`` column.  ``only`` names the variables
    to read (canonical names) and ``years`` the first and last year; both reach the scan.  ``tolerant`` passes over
    files that cannot be read; compare with ``sources.attributes.list_files`` to find them.  ``pattern`` tells grid files
    from others by their name.
    """
    paths = [paths] if isinstance(paths, str) else paths
    raw = _scan(spark, paths, fmt, tolerant, pattern)
    if fmt == "csv" and "time" not in raw.columns:
        raise ValueError("a CSV grid needs a 'time' column")
    named = raw.select("*", source_file().alias("src"))
    return to_obs(named, units, strict, only, years)


def observed_columns(wide: DataFrame, only: list[str] | None = None) -> list[str]:
    """The columns that hold observations: numbers, or text as CSV files give it, under names that are not auxiliary."""
    types = {f.name: f.dataType for f in wide.schema}
    found = []
    for name, kind in types.items():
        canonical = clean.canonical_name(name)
        if name in (*COORDINATES, "src") or clean.is_auxiliary(name):
            continue
        if isinstance(kind, StringType) and canonical not in model.CANONICAL_UNITS:
            continue
        if isinstance(kind, (NumericType, StringType)) and (only is None or canonical in only):
            found.append(name)
    return found


def _within(wide: DataFrame, years: tuple[int | None, int | None]) -> DataFrame:
    """Rows of the wanted years, by a condition on the time column itself, so that it can be pushed to the files."""
    first, last = years
    if first is not None:
        wide = wide.filter(F.col("time") >= F.lit(f"{first:04d}-01-01").cast(wide.schema["time"].dataType))
    if last is not None:
        wide = wide.filter(F.col("time") < F.lit(f"{last + 1:04d}-01-01").cast(wide.schema["time"].dataType))
    return wide


def to_obs(
    wide: DataFrame, units: dict[str, str], strict: bool = True, only: list[str] | None = None,
    years: tuple[int | None, int | None] = (None, None),
) -> DataFrame:
    """A wide table with ``src`` -> long ``obs``; auxiliary variables are never read, values are converted.

    Texts of times are compared as texts, so they must be ISO dates.
    """
    wide = _within(clean.standardise_coordinates(wide, strict), years)
    variables = observed_columns(wide, only)
    if not variables:
        raise ValueError("no variable to read among the columns")
    casts = [F.col(c).cast("double").alias(c) for c in variables]
    grid = wide.select(
        F.to_date("time").alias("date"), F.col("latitude").cast("double").alias("lat"),
        F.col("longitude").cast("double").alias("lon"), "src", *casts,
    )
    long = grid.unpivot(["date", "lat", "lon", "src"], variables, "variable", "value")
    long = clean.normalise_variables(long)
    unit = clean.lookup(F.col("variable"), units) if units else F.lit(None).cast("string")
    long = clean.convert_units(long.withColumn("units", unit))
    return long.withColumn("cell_id", cell_id("lat", "lon")).select(
        "variable", "cell_id", "lat", "lon", "date", "value", "src"
    )


def read_obs(spark: SparkSession, path: str) -> DataFrame:
    """A merged dataset as stored: partitioned by variable and year, which filters on them skip."""
    return spark.read.schema(model.OBS + ", year int").parquet(path)


def cells_of(obs: DataFrame) -> DataFrame:
    return obs.select("cell_id", "lat", "lon").distinct()


def series_of(obs: DataFrame, variable: str) -> DataFrame:
    """``(cell_id, date, value)`` of one variable."""
    return obs.filter(F.col("variable") == variable).select("cell_id", "date", "value")
