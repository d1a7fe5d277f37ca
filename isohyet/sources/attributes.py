"""What is known of files besides their rows: attributes in sidecars, and which files could be read.

A grid file ``x`` may have a sidecar ``x.attributes.json``, a JSON object with any of ``calendar``, the texts
``geospatial_lat_resolution`` and ``geospatial_lon_resolution``, ``transform`` (six numbers of the affine transform:
column step, rotation, west, rotation, row step, north) and ``variables``, by name an object with ``standard_name``,
``long_name`` and ``units``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.sources.obs import source_file

SUFFIX = ".attributes.json"
FIELDS = (
    "calendar string, geospatial_lat_resolution string, geospatial_lon_resolution string, transform array<double>, "
    "variables map<string, struct<standard_name: string, long_name: string, units: string>>"
)


def read_attributes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``src, calendar, lat_text, lon_text, transform, variables``: one row per sidecar under the folders ``paths``."""
    paths = [paths] if isinstance(paths, str) else paths
    table = (spark.read.schema(FIELDS).option("multiLine", True).option("pathGlobFilter", f"*{SUFFIX}")
             .option("recursiveFileLookup", True).json(paths))
    src = F.regexp_replace(F.col("_metadata.file_path"), SUFFIX.replace(".", "\\.") + "$", "")
    return table.select(
        src.alias("src"), "calendar", F.col("geospatial_lat_resolution").alias("lat_text"),
        F.col("geospatial_lon_resolution").alias("lon_text"), "transform", "variables")


def list_files(spark: SparkSession, paths: str | list[str], pattern: str = "*.parquet") -> DataFrame:
    """``src`` of every file under ``paths``, whether or not it can be read; no file is opened."""
    paths = [paths] if isinstance(paths, str) else paths
    table = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(paths)
    return table.select(source_file().alias("src")).distinct()


def unreadable(listed: DataFrame, obs: DataFrame) -> DataFrame:
    """Listed files of which no row arrived."""
    return listed.select("src").join(obs.select("src").distinct(), "src", "left_anti")


def variables_of(attributes: DataFrame) -> DataFrame:
    """``src, variable, standard_name, long_name, units``: one row per variable that a sidecar describes."""
    return attributes.select("src", F.explode("variables").alias("variable", "v")).select("src", "variable", "v.*")
