"""Daily grid observations derived from the driver's order lines.

The tables hold no climate data, so order lines are read as daily readings: suppliers fall onto the cells
of a grid over 99.5-102.5 E, 9.5-11.5 N whose resolution grows with the number of suppliers, ship days are
the days, and the day's quantities and discounts give precipitation and temperatures.  Values are held in
steps of 1/64, as packed grid archives hold them, so that sums are exact in any order.
"""

from __future__ import annotations

import datetime
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WEST, SOUTH = 99.5, 9.5
CALENDAR_ROWS = 500_000  # rows of the calendar that one task lists


# The columns in use; stating them spares a job that reads a footer per table.
SCHEMAS = {
    "lineitem": "l_suppkey bigint, l_quantity double, l_discount double, l_returnflag string, "
    "l_linestatus string, l_shipdate timestamp_ntz",
    "supplier": "s_suppkey bigint",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _scale(spark: SparkSession, sf_dir: str) -> int:
    """Cells per degree: one per 100 suppliers and square degree, at least one.  A count from the footers."""
    return max(1, math.isqrt(table(spark, sf_dir, "supplier").count() // 100))


def calendar_bounds(spark: SparkSession, sf_dir: str) -> tuple[datetime.date, datetime.date]:
    """First and last day of the whole years the order lines span: one row to the driver."""
    days = table(spark, sf_dir, "lineitem").agg(F.min("l_shipdate"), F.max("l_shipdate")).first()
    return datetime.date(days[0].year, 1, 1), datetime.date(days[1].year, 12, 31)


def _position(df: DataFrame, k: int) -> DataFrame:
    """Centre coordinates of a cell: 3k columns by 2k rows over the extent."""
    cell, width = F.col("cell_id"), 3 * k
    return df.withColumns({
        "lat": F.lit(SOUTH) + (F.floor(cell / width) + 0.5) / k,
        "lon": F.lit(WEST) + (cell % width + 0.5) / k,
    })


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, lat, lon) of every cell."""
    k = _scale(spark, sf_dir)
    suppliers = table(spark, sf_dir, "supplier")
    cells = suppliers.select((F.col("s_suppkey") % (6 * k * k)).alias("cell_id")).distinct()
    return _position(cells, k).select("cell_id", "lat", "lon")


def _lines(spark: SparkSession, sf_dir: str, keys: list[str]) -> DataFrame:
    """Order lines as (cell_id, date, quantity, cents, both, *keys)."""
    k = _scale(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % (6 * k * k)).alias("cell_id"), F.to_date("l_shipdate").alias("date"),
        F.col("l_quantity").cast("long").alias("quantity"),
        F.round(100 * F.col("l_discount")).cast("long").alias("cents"), *keys,
    )
    return lines.withColumn("both", F.col("quantity") * F.col("cents"))


def _readings(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines summed per cell, day and further keys: q, dc, qd, n."""
    return lines.groupBy("cell_id", "date", *keys).agg(
        F.sum("quantity").alias("q"), F.sum("cents").alias("dc"), F.sum("both").alias("qd"),
        F.count("quantity").alias("n"),
    )


def _variables(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "pr": F.expr("(coalesce(qd, 0) * 64 div 100) / 64D"),
        "tmax": F.expr("15D + (q * 192 div (5 * n)) / 64D"),
        "tmin": F.expr("15D + (q * 192 div (5 * n)) / 64D - (dc * 192 div n) / 64D"),
    })


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, date) of every cell and every day of the whole years of the record.

    The cells are dealt by their number of days before these are listed: by their few bytes they would all be put
    into one task, whose days would grow with the grid.
    """
    first, last = calendar_bounds(spark, sf_dir)
    rows = 6 * _scale(spark, sf_dir) ** 2 * ((last - first).days + 1)
    cells = grid(spark, sf_dir).select("cell_id").repartition(math.ceil(rows / CALENDAR_ROWS))
    return cells.select("cell_id", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("date"))


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, date, pr, tmax, tmin) for every cell and every day of the whole years of the record.

    Days without a reading have no rain and unknown temperatures.  The calendar rows are unioned into the
    aggregation rather than joined, so completing the calendar adds no shuffle of days.
    """
    days = calendar(spark, sf_dir).withColumns({c: F.lit(None).cast("long") for c in ("quantity", "cents", "both")})
    complete = _readings(_lines(spark, sf_dir, []).unionByName(days), [])
    return _variables(complete).select("cell_id", "date", "pr", "tmax", "tmin")


def series(spark: SparkSession, sf_dir: str, variable: str) -> DataFrame:
    """(cell_id, date, value) of one variable."""
    return wide(spark, sf_dir).select("cell_id", "date", F.col(variable).alias("value"))


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long observations: one row per variable, cell and day."""
    long = wide(spark, sf_dir).unpivot(["cell_id", "date"], ["pr", "tmax", "tmin"], "variable", "value")
    return long.join(grid(spark, sf_dir), "cell_id").select(
        "variable", "cell_id", "lat", "lon", "date", "value", F.lit("cube").alias("src")
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings as overlapping single-source "files", one per return flag and line status.

    (src, cell_id, date, pr, tmax, tmin), only the days each source has.
    """
    keys = ["l_returnflag", "l_linestatus"]
    parts = _variables(_readings(_lines(spark, sf_dir, keys), keys))
    return parts.select(
        F.concat_ws("_", *keys).alias("src"), "cell_id", "date", "pr", "tmax", "tmin"
    )
