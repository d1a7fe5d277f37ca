"""Series for charts: yearly and monthly values, moving averages and monthly climatologies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isohyet.functions.rounding import round_value
from isohyet.operators.clean import year_window


def yearly_series(values: DataFrame, keys: tuple[str, ...] = ("index", "area")) -> DataFrame:
    """Mean per year of an area series; rounded, years without a value left out."""
    table = values.groupBy(*keys, F.year("period").alias("year")).agg(F.avg("value").alias("value"))
    return table.withColumn("value", round_value(F.col("index"), F.col("value"))).filter("value is not null")


def yearly_series_of_cells(values: DataFrame, keys: tuple[str, ...] = ("index",)) -> DataFrame:
    """Mean per year and cell, then the unweighted mean over the cells."""
    per_cell = values.groupBy(*keys, "cell_id", F.year("period").alias("year")).agg(F.avg("value").alias("value"))
    table = per_cell.groupBy(*keys, "year").agg(F.avg("value").alias("value"))
    return table.withColumn("value", round_value(F.col("index"), F.col("value"))).filter("value is not null")


def _by_month(table: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return table.select(
        *keys, F.year("period").alias("year"), F.month("period").alias("month"),
        round_value(F.col("index"), F.col("value")).alias("value"),
    ).filter("value is not null")


def monthly_series(values: DataFrame, keys: tuple[str, ...] = ("index", "area")) -> DataFrame:
    """Year, month and rounded value of a monthly area series."""
    return _by_month(values, keys)


def monthly_series_of_cells(values: DataFrame, keys: tuple[str, ...] = ("index",)) -> DataFrame:
    """The unweighted mean over the cells, per month."""
    return _by_month(values.groupBy(*keys, "period").agg(F.avg("value").alias("value")), keys)


def moving_average(yearly: DataFrame, keys: tuple[str, ...] = ("index", "area"), window: int = 21) -> DataFrame:
    """Annual values with a centred moving average over ``window`` entries, shorter at the ends."""
    half = window // 2
    frame = Window.partitionBy(*keys).orderBy("year").rowsBetween(-half, half)
    return yearly.select(*keys, "year", F.col("value").alias("annual"), F.avg("value").over(frame).alias("year_avg"))


def monthly_climatology(
    monthly: DataFrame, keys: tuple[str, ...] = ("index", "area"), start_year: int | None = None,
    end_year: int | None = None,
) -> DataFrame:
    """Mean per calendar month over the chosen years."""
    chosen = year_window(monthly, start_year, end_year, F.col("year"))
    return chosen.groupBy(*keys, "month").agg(F.avg("value").alias("value"))
