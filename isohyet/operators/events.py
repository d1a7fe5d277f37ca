"""Droughts and floods in a monthly standardised series.

A drought begins when the value falls below -t and lasts until it is back at -t or above; a flood is the
mirror image.  Months without a value neither begin nor end an event.  Events of at least two months count,
and a whole event belongs to the calendar year it begins in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isohyet.model import EVENT_METRICS, EVENT_UNITS

MIN_MONTHS = 2


def both_kinds(threshold: float) -> Column:
    """One row per kind: its name, and the sign that turns droughts into floods."""
    t = abs(float(threshold))
    return F.explode(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.lit(sign).alias("sign"), F.lit(t).alias("limit"))
        for kind, sign in (("Drought", -1.0), ("Flood", 1.0))
    ]))


def yearly_events(spi: DataFrame, threshold: float = 1.0) -> DataFrame:
    """``spi(index, cell_id, period, value)``, months complete -> one row per index, cell, kind and year.

    Columns Frequency (0 without events; null for a cell without any value), Duration and Severity (the
    largest), Peak (the most extreme); the last three are null without events.
    """
    key = ["index", "cell_id", "kind"]
    order = Window.partitionBy(*key).orderBy("period")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Shuffled by cell before the kinds double the rows; all that follows keeps that partitioning.
    spi = spi.select("index", "cell_id", "period", "value").repartition("cell_id")
    months = spi.select("index", "cell_id", "period", "value", both_kinds(threshold).alias("k")).select(
        "index", "cell_id", "period", "k.kind", "k.sign", "k.limit", (F.col("value") * F.col("k.sign")).alias("u")
    )
    state = F.when(F.col("u").isNotNull(), F.col("u") > F.col("limit"))
    months = months.withColumns({
        "on": F.coalesce(F.last(state, ignorenulls=True).over(so_far), F.lit(False)),
        "known": F.count("u").over(everything),
    })
    begins = F.col("on") & ~F.coalesce(F.lag("on").over(order), F.lit(False))
    months = months.withColumn("begins", begins.cast("int"))
    months = months.withColumn("event", F.when(F.col("on"), F.sum("begins").over(so_far)))
    # An event may run over several years: sum it up per year first, then over the whole event.
    per_year = months.groupBy(*key, F.trunc("period", "year").alias("year"), "event").agg(
        F.count("*").alias("months"), F.min("period").alias("start"), F.max("u").alias("peak"),
        F.sum(F.when(F.col("u") > 0, F.col("u"))).alias("severity"), F.max("known").alias("known"),
        F.first("sign").alias("sign"),
    )
    whole = Window.partitionBy(*key, "event")
    per_year = per_year.withColumns({
        "duration": F.sum("months").over(whole), "first_month": F.min("start").over(whole),
        "peak": F.max("peak").over(whole), "severity": F.sum("severity").over(whole),
    })
    counts = (
        F.col("event").isNotNull() & (F.col("duration") >= MIN_MONTHS)
        & (F.trunc("first_month", "year") == F.col("year"))
    )
    return per_year.groupBy(*key, "year").agg(
        F.when(F.max("known") > 0, F.count(F.when(counts, 1)).cast("double")).alias("Frequency"),
        F.max(F.when(counts, F.col("duration").cast("double"))).alias("Duration"),
        (F.max(F.when(counts, F.col("peak"))) * F.first("sign")).alias("Peak"),
        F.max(F.when(counts, F.col("severity"))).alias("Severity"),
    ).withColumnRenamed("year", "period")


def event_values(spi: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Yearly ``index_values`` named ``SPI6_Drought_Peak`` and so on."""
    metrics = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(EVENT_UNITS[m]).alias("units"))
        for m in EVENT_METRICS
    ])
    rows = yearly_events(spi, threshold).select("index", "cell_id", "kind", "period", F.explode(metrics).alias("m"))
    return rows.select(
        F.concat_ws("_", "index", "kind", "m.metric").alias("index"), F.lit("YS").alias("freq"), "period",
        "cell_id", "m.value", "m.units",
    )


def classify_months(series: DataFrame, keys: tuple[str, ...], threshold: float = 1.0) -> DataFrame:
    """Label the months of a series drought, wet or neutral: runs of at least two beyond the threshold.

    Months without a value are left out, and the months around them count as neighbours.
    """
    t = abs(float(threshold))
    order = Window.partitionBy(*keys).orderBy("period")
    side = F.when(F.col("value") < -t, -1).when(F.col("value") > t, 1).otherwise(0)
    known = series.filter(F.col("value").isNotNull()).withColumn("side", side)
    changed = (F.col("side") != F.coalesce(F.lag("side").over(order), F.lit(9))).cast("int")
    runs = known.withColumn("changed", changed).withColumn(
        "run", F.sum("changed").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    length = F.count("*").over(Window.partitionBy(*keys, "run"))
    label = F.when((F.col("side") == -1) & (length >= MIN_MONTHS), "drought").when(
        (F.col("side") == 1) & (length >= MIN_MONTHS), "wet"
    ).otherwise("neutral")
    return runs.withColumn("label", label).select(*keys, "period", "value", "label")
