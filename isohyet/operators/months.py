"""The monthly state of a dataset: what raw values, SPI and the bounds of the record are derived from.

One row per variable, cell and month with parts that can be added up: later months are appended, states of parts are
united by ``united``, and years are rolled up from the months.  A tenth to a thirtieth of the days, read once.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.functions.calendar import days_in_period, period_start
from isohyet.operators.daily import enough_data

KEYS = ["variable", "cell_id", "period"]
# How each part of the state is made of days, and how it is combined.
PARTS = {
    "total": (lambda: F.sum("value"), F.sum), "known": (lambda: F.count("value"), F.sum), "high": (lambda: F.max("value"), F.max),
    "first": (lambda: F.min("date"), F.min), "last": (lambda: F.max("date"), F.max),
}


def monthly_state(obs: DataFrame, variables: list[str]) -> DataFrame:
    """``variable, cell_id, period, total, known, high, first, last`` of the variables, in one scan of the days."""
    days = obs.filter(F.col("variable").isin(variables)).withColumn("period", period_start("date", "MS"))
    return days.groupBy(*KEYS).agg(*[made().alias(name) for name, (made, _) in PARTS.items()])


def united(*states: DataFrame) -> DataFrame:
    """One state out of several, of other files or of later days."""
    whole = states[0]
    for state in states[1:]:
        whole = whole.unionByName(state)
    return whole.groupBy(*KEYS).agg(*[combine(name).alias(name) for name, (_, combine) in PARTS.items()])


def monthly_mean(state: DataFrame, variable: str, missing: str | float = "any") -> DataFrame:
    """``(cell_id, period, value)``: the month's mean, null where too many days are missing."""
    valid = enough_data(F.col("known"), days_in_period(F.col("period"), "MS"), missing)
    mean = F.when(valid & (F.col("known") > 0), F.col("total") / F.col("known"))
    return state.filter(F.col("variable") == variable).select("cell_id", "period", mean.alias("value"))


def resampled(state: DataFrame, variable: str, freq: str) -> DataFrame:
    """``(cell_id, period, value)``: sums of precipitation, means of other variables; null where no day is known."""
    mine = state.filter(F.col("variable") == variable).select("cell_id", period_start("period", freq).alias("period"), "total", "known")
    sums = mine.groupBy("cell_id", "period").agg(F.sum("total").alias("total"), F.sum("known").alias("known"))
    value = F.col("total") if variable == "pr" else F.when(F.col("known") > 0, F.col("total") / F.col("known"))
    return sums.select("cell_id", "period", value.alias("value"))


def records(state: DataFrame) -> dict[str, tuple[datetime.date, datetime.date]]:
    """First and last day of each variable: one row a variable to the driver."""
    bounds = state.groupBy("variable").agg(F.min("first").alias("first"), F.max("last").alias("last")).collect()
    return {r["variable"]: (r["first"], r["last"]) for r in bounds}
