"""What has been written: one row for every finished output, added after its data.

Outputs are identified by country, layer, setting, index and span, so a second layer or baseline is never taken for
the first; a folder that was half written has no row and is made again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.sources.sinks import not_yet_present

KEYS = ["kind", "country", "layer", "setting", "index", "span"]
SCHEMA = ", ".join(f"`{k}` string" for k in KEYS)
# Kinds of outputs; those that depend on fewer keys leave the others empty.
CELLS, VALUES, MAP, SERIES = "cells", "values", "map", "series"


def path(out: str) -> str:
    return f"{out}/manifest"


def read_if_there(spark: SparkSession, path_: str, schema: str) -> DataFrame | None:
    """A Parquet table, or None where its folder does not exist."""
    try:
        return spark.read.schema(schema).parquet(path_)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def finished(spark: SparkSession, out: str) -> DataFrame:
    """All finished outputs under ``out``; none where nothing was written yet."""
    table = read_if_there(spark, path(out), SCHEMA)
    return spark.createDataFrame([], SCHEMA) if table is None else table


def entries(rows: DataFrame, kind: str) -> DataFrame:
    """Rows with some of the keys as manifest rows."""
    known = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns}
    return rows.select(*[F.lit(kind).alias(k) if k == "kind" else known.get(k, F.lit("")).alias(k) for k in KEYS]).distinct()


def record(rows: DataFrame, kind: str, out: str) -> None:
    """Note outputs as finished.  Call it after their data are written; only rows that are new are added."""
    new = not_yet_present(entries(rows, kind), finished(rows.sparkSession, out), KEYS)
    new.coalesce(1).write.mode("append").parquet(path(out))


def lacking(requested: DataFrame, kind: str, out: str) -> DataFrame:
    """Those of the requested outputs that are not finished."""
    return not_yet_present(entries(requested, kind), finished(requested.sparkSession, out), KEYS)
