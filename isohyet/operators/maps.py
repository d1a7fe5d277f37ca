"""Maps: one value or trend per cell or area over a span of years."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.functions.rounding import round_p, round_value
from isohyet.model import catalogue
from isohyet.operators.clean import year_window
from isohyet.operators.trend import trends


def actual(
    values: DataFrame, keys: tuple[str, ...], start_year: int | None = None, end_year: int | None = None
) -> DataFrame:
    """Mean over the periods - for event frequencies the sum - of each index and cell or area.

    Cells and areas without any value are left out.  Rounded to the stored precision.
    """
    name = F.col("index")
    chosen = year_window(values, start_year, end_year)
    table = chosen.groupBy("index", *keys).agg(F.avg("value").alias("mean"), F.sum("value").alias("total"))
    value = F.when(name.contains("Frequency"), F.col("total")).otherwise(F.col("mean"))
    return table.select("index", *keys, round_value(name, value).alias("value")).filter("value is not null")


def trend(
    values: DataFrame, keys: tuple[str, ...], start_year: int | None = None, end_year: int | None = None,
    freq: str = "YS", per_period_decade: bool = True,
) -> DataFrame:
    """Trend per index and cell or area, rounded to the stored precision."""
    table = trends(year_window(values, start_year, end_year), keys, freq, per_period_decade)
    return table.select(
        "index", *keys, round_value(F.col("index"), F.col("slope")).alias("slope"), round_p(F.col("p")).alias("p"),
        "z", "trend",
    )


def with_trend_support(values: DataFrame) -> DataFrame:
    """Leave out what has no trend map: raw variables and event frequencies."""
    without = catalogue(values.sparkSession).filter("not supports_trend").select("index")
    return values.join(F.broadcast(without), "index", "left_anti")  # 11 fixed rows


def span(values: DataFrame, keys: tuple[str, ...] = ("index",)) -> DataFrame:
    """First and last date and year of the data behind each index."""
    return values.groupBy(*keys).agg(
        F.min("period").alias("start_date"), F.max("period").alias("end_date"),
        F.year(F.min("period")).alias("first_year"), F.year(F.max("period")).alias("last_year"),
    )
