"""Daily climate indices.

Each index is a day-level measure plus a decomposable aggregate (sum, max or min), so that months are
aggregated once and years are rolled up from the months.  Spells and running sums are turned into
day-level measures by windows over one ordering, (cell, date): a family of indices costs one shuffle by
cell and one sort, however many indices are asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isohyet.functions.calendar import day_number, days_in_period, period_start
from isohyet.model import INDICES, Baseline
from isohyet.operators.thresholds import Record, attach_thresholds, doy_thresholds, threshold_column

WET = 1.0
SPELL = 6


@dataclass(frozen=True)
class Measure:
    """A day-level expression and the aggregate that combines it over days and over months."""

    day: Column
    how: str


def _value() -> Column:
    return F.col("value")


def _days(condition: Column) -> Measure:
    return Measure(F.when(condition, 1).otherwise(0).cast("long"), "sum")


def _extreme(how: str, column: Column | None = None) -> Measure:
    return Measure(_value() if column is None else column, how)


def _total(condition: Column) -> Measure:
    return Measure(F.when(condition, _value()).otherwise(F.lit(0.0)), "sum")


def _wet_threshold(q: float) -> Column:
    """A wet-day percentile never counts below 1 mm, and an unknown one is 1 mm."""
    name = F.col(threshold_column(q))
    return F.when(name > WET, name).otherwise(F.lit(WET))


def _above(q: float) -> Column:
    return _value() > F.col(threshold_column(q))


def _below(q: float) -> Column:
    return _value() < F.col(threshold_column(q))


# What each family needs: the thresholds of the percentile indices and the conditions of the spell indices.
QUANTILES = {
    "R95p": 0.95, "R95pTOT": 0.95, "R99p": 0.99, "R99pTOT": 0.99,
    "TN10p": 0.10, "TX10p": 0.10, "CSDI": 0.10, "TN90p": 0.90, "TX90p": 0.90, "WSDI": 0.90,
}
SPELLS = {
    "CDD": lambda: _value() < WET,
    "CWD": lambda: _value() >= WET,
    "WSDI": lambda: _above(0.90),
    "CSDI": lambda: _below(0.10),
}


def _spell_column(index: str, freq: str) -> str:
    return f"spell_{index}_{freq}"


def _with_spells(days: DataFrame, names: list[str], freqs: list[str]) -> DataFrame:
    """Length of the current run up to each day, 0 outside a run.

    A run is broken by a day that fails the condition, by an absent day and by the start of a period.
    """
    order = Window.partitionBy("cell_id").orderBy("day")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for name in names:
        days = days.withColumn(f"in_{name}", F.coalesce(SPELLS[name](), F.lit(False)))
    days = days.withColumn("previous_day", F.lag("day").over(order)).withColumns(
        {f"before_{name}": F.lag(f"in_{name}").over(order) for name in names}
    )
    gap = F.col("previous_day").isNull() | (F.col("previous_day") != F.col("day") - 1)
    starts = {}
    for freq in freqs:
        opening = period_start("date", freq) == F.col("date")
        for name in names:
            start = F.col(f"in_{name}") & (~F.col(f"before_{name}") | gap | opening)
            starts[_spell_column(name, freq)] = F.when(start, F.col("day"))
    days = days.withColumns(starts)
    days = days.withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in starts})
    lengths = {}
    for freq in freqs:
        for name in names:
            c = _spell_column(name, freq)
            lengths[c] = F.when(F.col(f"in_{name}"), F.col("day") - F.col(c) + 1).otherwise(F.lit(0))
    return days.withColumns(lengths).drop(
        "previous_day", *[f"in_{n}" for n in names], *[f"before_{n}" for n in names]
    )


def _with_running_sum(days: DataFrame) -> DataFrame:
    """Sum of the last five calendar days; null unless all five are present."""
    five = Window.partitionBy("cell_id").orderBy("day").rangeBetween(-4, Window.currentRow)
    full = F.count("value").over(five) == 5
    return days.withColumn("sum5", F.when(full, F.sum("value").over(five)))


def _measures(index: str, freqs: list[str]) -> dict[str, Measure]:
    """The day-level measures an index is built from.  Equal names mean equal measures."""
    v = _value()
    if index in ("CDD", "CWD"):
        return {c: Measure(F.col(c), "max") for f in freqs for c in [_spell_column(index, f)]}
    if index in ("WSDI", "CSDI"):
        # A run counts from the day it reaches six: six days then, one for each day after.
        return {
            c: Measure(F.when(F.col(c) == SPELL, SPELL).when(F.col(c) > SPELL, 1).otherwise(0).cast("long"), "sum")
            for f in freqs
            for c in [_spell_column(index, f)]
        }
    if index in ("R95p", "R99p"):
        return {index: _days(v > _wet_threshold(QUANTILES[index]))}
    if index in ("R95pTOT", "R99pTOT"):
        return {f"{index}_over": _total(v > _wet_threshold(QUANTILES[index])), "wet_above": _total(v > WET)}
    return {
        "SDII": lambda: {"wet_total": _total(v >= WET), "wet_days": _days(v >= WET)},
        "PRCPTOT": lambda: {"wet_total": _total(v >= WET)},
        "Rx1day": lambda: {"max_value": _extreme("max")},
        "TXx": lambda: {"max_value": _extreme("max")},
        "TNx": lambda: {"max_value": _extreme("max")},
        "TXn": lambda: {"min_value": _extreme("min")},
        "TNn": lambda: {"min_value": _extreme("min")},
        "Rx5day": lambda: {"max_sum5": _extreme("max", F.col("sum5"))},
        "R10mm": lambda: {"R10mm": _days(v >= 10.0)},
        "R20mm": lambda: {"R20mm": _days(v >= 20.0)},
        "FD": lambda: {"FD": _days(v < 0.0)},
        "ID": lambda: {"ID": _days(v < 0.0)},
        "SU": lambda: {"SU": _days(v > 25.0)},
        "TR": lambda: {"TR": _days(v > 20.0)},
        "TN10p": lambda: {"TN10p": _days(_below(0.10))},
        "TX10p": lambda: {"TX10p": _days(_below(0.10))},
        "TN90p": lambda: {"TN90p": _days(_above(0.90))},
        "TX90p": lambda: {"TX90p": _days(_above(0.90))},
    }[index]()


def _final(index: str, freq: str, measures: list[str]) -> Column:
    if index == "SDII":
        return F.when(F.col("wet_days") > 0, F.col("wet_total") / F.col("wet_days"))
    if index in ("R95pTOT", "R99pTOT"):
        return F.when(F.col("wet_above") > 0, F.col(f"{index}_over") / F.col("wet_above"))
    if index in SPELLS:
        return F.col(_spell_column(index, freq)).cast("double")
    return F.col(measures[0]).cast("double")


def enough_data(valid: Column, expected: Column, missing: str | float) -> Column:
    """The missing-data rule.

    ``'any'``: every calendar day of the period must have a value; ``'skip'``: at least one must;
    a number: the missing share must stay below it.
    """
    if missing == "any":
        return valid == expected
    if missing == "skip":
        return valid > 0
    return (valid > 0) & ((expected - valid) / expected < F.lit(float(missing)))


def _measured_days(
    series: DataFrame, indices: list[str], freqs: list[str], baseline: Baseline | None, record: Record | None,
    colocated: bool,
) -> tuple[DataFrame, dict[str, Measure]]:
    """The daily rows with every column the indices' measures refer to, and those measures."""
    days = series.select("cell_id", "date", F.nanvl("value", F.lit(None).cast("double")).alias("value"))
    wanted = sorted({QUANTILES[i] for i in indices if i in QUANTILES})
    spells = [i for i in indices if i in SPELLS]
    by_cell = bool(wanted or spells or "Rx5day" in indices)
    if by_cell and not colocated:
        days = days.repartition("cell_id")
    if wanted:
        wet_only = INDICES[indices[0]][0] == "pr"
        days = attach_thresholds(days, doy_thresholds(days, wanted, baseline, wet_only, record, colocated), "inner")
    days = days.withColumn("day", day_number("date"))
    if spells:
        days = _with_spells(days, spells, freqs)
    if "Rx5day" in indices:
        days = _with_running_sum(days)
    measures: dict[str, Measure] = {"valid": Measure(F.col("value").isNotNull().cast("long"), "sum")}
    for index in indices:
        measures.update(_measures(index, freqs))
    return days, measures


def _over_days(days: DataFrame, measures: dict[str, Measure], freq: str) -> DataFrame:
    aggregates = [getattr(F, m.how)(m.day).alias(name) for name, m in measures.items()]
    return days.groupBy("cell_id", period_start("date", freq).alias("period")).agg(*aggregates)


def daily_indices(
    series: DataFrame,
    indices: list[str],
    freq: str = "YS",
    baseline: Baseline | None = None,
    missing: str | float = "any",
    record: Record | None = None,
    colocated: bool = False,
) -> DataFrame:
    """Indices of one variable: ``series(cell_id, date, value)`` -> (cell_id, period, one column per index).

    ``record``: first and last day of the data, if known; it spares the percentile indices a scan.
    ``colocated``: the series comes from a table bucketed by cell, so that spells, running sums and
    percentiles need no shuffle at all.
    """
    days, measures = _measured_days(series, indices, [freq], baseline, record, colocated)
    valid = enough_data(F.col("valid"), days_in_period(F.col("period"), freq), missing)
    return _over_days(days, measures, freq).select(
        "cell_id",
        "period",
        *[F.when(valid, _final(i, freq, list(_measures(i, [freq])))).alias(i) for i in indices],
    )


def daily_index_values(
    series: DataFrame,
    indices: list[str],
    freqs: tuple[str, ...] = ("YS", "MS"),
    baseline: Baseline | None = None,
    missing: str | float = "any",
    record: Record | None = None,
    colocated: bool = False,
) -> DataFrame:
    """The same as long ``index_values``, for several frequencies in one pass over the days.

    The days are aggregated to months; the month rows, a thirtieth in number, are then assigned to every
    frequency and aggregated again.
    """
    freqs = list(freqs)
    if len(freqs) == 1:
        wide = daily_indices(series, indices, freqs[0], baseline, missing, record, colocated)
        return to_index_values(wide, freqs[0])
    days, measures = _measured_days(series, indices, freqs, baseline, record, colocated)
    targets = F.array(*[
        F.struct(F.lit(f).alias("freq"), period_start("period", f).alias("period")) for f in freqs
    ])
    assigned = _over_days(days, measures, "MS").withColumn("target", F.explode(targets))
    table = assigned.groupBy("cell_id", "target.freq", "target.period").agg(
        *[getattr(F, m.how)(name).alias(name) for name, m in measures.items()]
    )

    def by_freq(choose) -> Column:
        branches = F
        for f in freqs:
            branches = branches.when(F.col("freq") == f, choose(f))
        return branches

    expected = by_freq(lambda f: days_in_period(F.col("period"), f))
    valid = enough_data(F.col("valid"), expected, missing)
    entries = F.array(*[
        F.struct(
            F.lit(i).alias("index"),
            F.when(valid, by_freq(lambda f, i=i: _final(i, f, list(_measures(i, [f]))))).alias("value"),
            F.lit(INDICES[i][1]).alias("units"),
        )
        for i in indices
    ])
    return table.select("cell_id", "freq", "period", F.explode(entries).alias("e")).select(
        "e.index", "freq", "period", "cell_id", "e.value", "e.units"
    )


def to_index_values(wide: DataFrame, freq: str) -> DataFrame:
    """Index columns -> long ``index_values`` rows."""
    names = [c for c in wide.columns if c not in ("cell_id", "period")]
    entries = F.array(*[
        F.struct(F.lit(n).alias("index"), F.col(n).alias("value"), F.lit(INDICES[n][1]).alias("units")) for n in names
    ])
    return wide.select("cell_id", "period", F.explode(entries).alias("e")).select(
        "e.index", F.lit(freq).alias("freq"), "period", "cell_id", "e.value", "e.units"
    )


def resample(series: DataFrame, variable: str, freq: str, keys: tuple[str, ...] = ("cell_id",)) -> DataFrame:
    """Precipitation sums and other variables' means per period; nulls skipped, no value where all are null."""
    how = F.sum("value") if variable == "pr" else F.avg("value")
    return series.groupBy(*keys, period_start("date", freq).alias("period")).agg(how.alias("value"))
