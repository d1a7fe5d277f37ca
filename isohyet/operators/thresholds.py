"""Percentile climatology per cell and day of year.

The five-day window and the doy lookup are arranged so that daily rows are shuffled once, by cell, and
never multiplied: values are first listed per (cell, set of window centres) - at most a few hundred lists
of one value per year - and only those lists are copied to the five centres.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.functions.quantiles import quantile8
from isohyet.model import Baseline

HALF_WINDOW = 2
YEAR_DAYS = 365


def threshold_column(q: float) -> str:
    return f"q{round(q * 100):02d}"


Record = tuple[datetime.date, datetime.date]


def record_bounds(series: DataFrame) -> Column:
    """First and last day of the record, as a struct from one scalar subquery."""
    return series.agg(F.struct(F.min("date").alias("first"), F.max("date").alias("last"))).scalar()


def baseline_bounds(series: DataFrame, baseline: Baseline | None, record: Record | None) -> tuple[Column, Column]:
    """First and last baseline day: the whole record unless both years are given.

    A baseline outside the record, or one that holds no day of it, fails the query.  Pass the ``record``
    where it is known; otherwise the dates are scanned for it.
    """
    if record is None:
        bounds = record_bounds(series)
        first, last = bounds["first"], bounds["last"]
    else:
        first, last = F.lit(record[0]), F.lit(record[1])
    if baseline is None or not baseline.given:
        return first, last
    start = F.make_date(F.lit(baseline.start_year), F.lit(1), F.lit(1))
    end = F.make_date(F.lit(baseline.end_year), F.lit(12), F.lit(31))
    message = F.concat(
        F.lit(f"baseline {baseline.start_year}-{baseline.end_year} is empty or outside the record "),
        first.cast("string"), F.lit(" to "), last.cast("string"),
    )
    inside = (start <= end) & (end >= first) & (start <= last)
    checked = F.when(inside, F.greatest(start, first)).otherwise(F.raise_error(message).cast("date"))
    return checked, F.least(end, last)


def _fill_gaps(values: Column) -> Column:
    """Linear interpolation over nulls between known neighbours; nothing is invented beyond the ends.

    The known entries are listed once, and every two neighbours give the entries after the first one up to the
    second, so the work grows with the length of the year and not with its square.
    """
    listed = F.filter(
        F.transform(values, lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda e: e.v.isNotNull()
    )

    def up_to_next(known: Column, j: Column) -> Column:
        a, b = F.get(known, j), F.get(known, j + 1)
        width = b.i - a.i
        return F.transform(F.sequence(F.lit(1), width), lambda s: F.when(s == width, b.v).otherwise(
            a.v + (b.v - a.v) * (s / width)))

    def filled(known: Column) -> Column:
        unknown = F.lit(None).cast("double")
        first, last = F.get(known, F.lit(0)), F.get(known, F.size(known) - 1)
        between = F.when(F.size(known) > 1, F.flatten(F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(known) - 2, F.lit(0))), lambda j: up_to_next(known, j)))).otherwise(
            F.array().cast("array<double>"))
        return F.concat(F.array_repeat(unknown, first.i), F.array(first.v), between, F.array_repeat(unknown, F.size(values) - 1 - last.i))

    # An array of one, so that the list is made once however often it is mentioned.
    return F.get(F.transform(F.array(listed), lambda known: F.when(
        (F.size(known) > 0) & (F.size(known) < YEAR_DAYS), filled(known)).otherwise(values)), F.lit(0))


def _stretch(values: Column) -> Column:
    """Spread 365 values evenly over days 1..366, so that day 366 has the same sample size as the others."""

    def at(day):
        position = (day - 1.0) * (YEAR_DAYS - 1.0) / YEAR_DAYS
        low = F.floor(position).cast("int")
        lower = F.get(values, low)
        upper = F.get(values, F.least(low + 1, F.lit(YEAR_DAYS - 1)))
        fraction = position - low
        return F.when(fraction == 0, lower).otherwise(lower + (upper - lower) * fraction)

    return F.transform(F.sequence(F.lit(1), F.lit(YEAR_DAYS + 1)), at)


def doy_thresholds(
    series: DataFrame, quantiles: list[float], baseline: Baseline | None = None, wet_only: bool = False,
    record: Record | None = None, colocated: bool = False,
) -> DataFrame:
    """``series(cell_id, date, value)`` -> ``(cell_id, q90, q95, ...)``, each an array indexed by day of year.

    Wet days (>= 1 mm) only where ``wet_only``.  Type 8 quantiles; days 1..365, stretched to 366 when the
    record contains a leap day.  ``colocated``: the series is partitioned by cell already.
    """
    first, last = baseline_bounds(series, baseline, record)
    sample = F.col("value").isNotNull()
    if wet_only:
        sample = sample & (F.col("value") >= 1.0)
    doy, first_day, last_day = F.dayofyear("date"), F.col("first"), F.col("last")
    in_baseline = F.col("date").between(first_day, last_day)
    # Away from the ends of the year and of the baseline, the centres are simply the neighbouring days.
    plain = (
        doy.between(1 + HALF_WINDOW, YEAR_DAYS - HALF_WINDOW)
        & F.col("date").between(F.date_add(first_day, HALF_WINDOW), F.date_sub(last_day, HALF_WINDOW))
    )
    offsets = range(-HALF_WINDOW, HALF_WINDOW + 1)
    centres = F.array(*[
        F.when(F.date_add("date", o).between(first_day, last_day), F.dayofyear(F.date_add("date", o))) for o in offsets
    ])
    days = series.select("cell_id", "date", "value")
    by_centres = (
        (days if colocated else days.repartition("cell_id"))
        .withColumns({"first": first, "last": last})
        .withColumn("used", in_baseline & sample)
        .withColumns({
            "day": F.when(F.col("used") & plain, doy),
            "edge": F.when(F.col("used") & ~plain, F.filter(centres, lambda d: d <= YEAR_DAYS)),
        })
        .groupBy("cell_id", "day", "edge")
        .agg(F.collect_list(F.when(F.col("used"), F.col("value"))).alias("values"), F.max(doy).alias("longest"))
        .withColumn("doys", F.coalesce("edge", F.when(
            F.col("day").isNotNull(), F.array(*[F.col("day") + o for o in offsets])
        )))
    )
    # Every (cell, centre) gets its pooled values; a null list of centres only carries the year length.
    pooled = (
        by_centres.select("cell_id", "values", "longest", F.explode_outer("doys").alias("doy"))
        .groupBy("cell_id", "doy")
        .agg(F.sort_array(F.flatten(F.collect_list("values"))).alias("pool"), F.max("longest").alias("longest"))
    )
    per_doy = pooled.select(
        "cell_id", "doy", "longest", *[quantile8(F.col("pool"), q).alias(threshold_column(q)) for q in quantiles]
    )
    names = [threshold_column(q) for q in quantiles]
    collected = per_doy.groupBy("cell_id").agg(
        F.max("longest").alias("longest"),
        F.sort_array(F.collect_list(F.when(F.col("doy").isNotNull(), F.struct("doy", *names)))).alias("days"),
    )

    def by_day(name: str) -> Column:
        known = F.map_from_entries(F.transform("days", lambda e: F.struct(e["doy"], e[name])))
        every = F.sequence(F.lit(1), F.lit(YEAR_DAYS))
        return (
            F.when(F.size("days") == YEAR_DAYS, F.transform("days", lambda e: e[name]))
            .otherwise(F.transform(every, lambda d: F.try_element_at(known, d))).alias(name)
        )

    dense = collected.select("cell_id", "longest", *[by_day(n) for n in names])
    for q in quantiles:
        name = threshold_column(q)
        dense = dense.withColumn(name, _fill_gaps(F.col(name)))
    for q in quantiles:
        name = threshold_column(q)
        dense = dense.withColumn(
            name, F.when(F.col("longest") > YEAR_DAYS, _stretch(F.col(name))).otherwise(F.col(name))
        )
    return dense.drop("longest")


def attach_thresholds(series: DataFrame, thresholds: DataFrame, how: str = "left") -> DataFrame:
    """Add the day's threshold of each quantile column to the daily rows.

    One threshold row per cell: the join is on the cell alone and keeps the daily rows' partitioning, and
    the arrays are reduced to one number before anything else happens.  ``how='inner'`` is for thresholds of
    the very same series, where every cell has a row: both sides then read one and the same shuffle.
    """
    names = [c for c in thresholds.columns if c != "cell_id"]
    joined = series.join(thresholds, "cell_id", how)
    return joined.select(
        *series.columns, *[F.get(F.col(n), F.dayofyear("date") - 1).alias(n) for n in names]
    )


def threshold_table(thresholds: DataFrame, variable: str) -> DataFrame:
    """Long form ``(variable, cell_id, doy, q, value)``."""
    names = [c for c in thresholds.columns if c != "cell_id"]
    pairs = F.array(*[
        F.struct(F.lit(int(n[1:]) / 100.0).alias("q"), F.col(n).alias("values")) for n in names
    ])
    return (
        thresholds.select("cell_id", F.explode(pairs).alias("p"))
        .select("cell_id", "p.q", F.posexplode("p.values").alias("i", "value"))
        .select(F.lit(variable).alias("variable"), "cell_id", (F.col("i") + 1).alias("doy"), "q", "value")
    )
