"""Standardised precipitation index.

Monthly mean rain, its W-month trailing mean, a gamma distribution per cell and calendar month fitted by
maximum likelihood with a point mass at zero, and the standard normal value of the same probability.
The mean and the mean logarithm are sufficient for the fit, so nothing but two averages and the years'
values (one per year) is held per cell and calendar month.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isohyet.functions.barrier import computed_once
from isohyet.functions.calendar import days_in_period, period_number, period_start
from isohyet.functions.special import gamma_cdf, gamma_shape, normal_quantile
from isohyet.operators.daily import enough_data

# Fixed value: the standard normal quantile of 1 - 1e-16, the largest magnitude reported.
LIMIT = 8.21


def monthly_mean(series: DataFrame, missing: str | float = "any") -> DataFrame:
    """``series(cell_id, date, value)`` -> ``(cell_id, period, value)``, null where days are missing."""
    period = period_start("date", "MS")
    valid = enough_data(F.count("value"), F.max(days_in_period(period, "MS")), missing)
    return series.groupBy("cell_id", period.alias("period")).agg(F.when(valid, F.avg("value")).alias("value"))


def trailing_mean(monthly: DataFrame, window: int, key: str = "cell_id") -> DataFrame:
    """Mean of the last ``window`` months; null unless all of them have a value."""
    frame = (
        Window.partitionBy(key).orderBy(period_number(F.col("period"), "MS")).rangeBetween(1 - window, Window.currentRow)
    )
    full = F.count("value").over(frame) == window
    return monthly.withColumn("value", F.when(full, F.avg("value").over(frame)))


def spi(monthly: DataFrame, window: int) -> DataFrame:
    """``monthly(cell_id, period, value)`` -> ``(cell_id, period, value)`` with the index of that window.

    Null for the first ``window - 1`` months, for months without data, and where a calendar month's
    values do not vary, so that no distribution can be fitted.
    """
    smooth = trailing_mean(monthly.repartition("cell_id"), window)
    x = F.col("value")
    positive = F.when(x > 0, x)
    fits = smooth.groupBy("cell_id", F.month("period").alias("month")).agg(
        F.avg(positive).alias("mean"),
        F.avg(F.log(positive)).alias("mean_log"),
        (1.0 - F.try_divide(F.count(positive), F.count(x))).alias("dry"),
        F.collect_list(F.struct("period", "value")).alias("years"),
    )
    # One step after the other, so that no expression is repeated inside the next one.
    fits = computed_once(fits, ["cell_id", "mean", "dry", "years"], spread=F.log("mean") - F.col("mean_log"))
    fits = computed_once(fits, ["cell_id", "mean", "dry", "years"], a=gamma_shape(F.col("spread")))
    rows = fits.select("cell_id", "a", (F.col("mean") / F.col("a")).alias("scale"), "dry", F.explode("years").alias("y"))
    rows = rows.select("cell_id", "y.period", "y.value", "a", "dry", (F.col("y.value") / F.col("scale")).alias("x"))
    # The point mass at zero takes the share of dry values; the gamma covers the rest.
    wet = F.col("dry") + (1.0 - F.col("dry")) * gamma_cdf(F.col("a"), F.col("x"))
    p = F.when(F.col("a").isNotNull(), F.when(F.col("value") <= 0, F.col("dry")).otherwise(wet))
    rows = computed_once(rows, ["cell_id", "period"], p=p)
    # Far tails are cut at the limit; at exactly 0 or 1 the quantile is infinite and is cut as well.
    rows = computed_once(rows, ["cell_id", "period", "p"], z=normal_quantile(F.col("p")))
    held = F.greatest(F.least("z", F.lit(LIMIT)), F.lit(-LIMIT))
    return rows.select("cell_id", "period", F.when(F.col("p").isNotNull(), held).alias("value"))


def spi_values(monthly: DataFrame, windows: list[int]) -> DataFrame:
    """``index_values`` of the base SPIs: ``SPI3``, ``SPI6``, ..."""
    tables = [
        spi(monthly, w).select(
            F.lit(f"SPI{w}").alias("index"), F.lit("MS").alias("freq"), "period", "cell_id", "value",
            F.lit("").alias("units"),
        )
        for w in windows
    ]
    return reduce(DataFrame.unionByName, tables)
