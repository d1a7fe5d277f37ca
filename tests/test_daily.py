import datetime
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import daily as daily_table
from conftest import days
from isohyet.model import Baseline
from isohyet.operators import daily, months, spi, thresholds


def yearly(spark, values, index, first="2000-01-01", **options):
    table = daily.daily_indices(daily_table(spark, values, first), [index], "YS", **options)
    return {r.period.year: r[index] for r in table.collect()}


def brute_quantiles(dates, values, q, wet_only, first, last):
    """Pooled five-day windows per day of year, then gaps and leap days, with numpy."""
    known = dict(zip(dates, values))
    pools = {d: [] for d in range(1, 366)}
    day = first
    while day <= last:
        doy = day.timetuple().tm_yday
        if doy <= 365:
            for o in range(-2, 3):
                near = day + datetime.timedelta(days=o)
                v = known.get(near) if first <= near <= last else None
                if v is not None and (not wet_only or v >= 1):
                    pools[doy].append(v)
        day += datetime.timedelta(days=1)
    raw = [np.quantile(p, q, method="median_unbiased") if p else np.nan for p in pools.values()]
    x = np.arange(1.0, 366)
    ok = ~np.isnan(raw)
    filled = np.interp(x, x[ok], np.array(raw)[ok], left=np.nan, right=np.nan) if ok.any() else np.array(raw)
    return np.interp(np.arange(1, 367), np.linspace(1, 366, 365), filled)


@pytest.fixture(scope="module")
def random_series():
    rng = random.Random(11)
    dates = days("2000-01-01", 366 + 365 * 3)
    values = [None if rng.random() < 0.05 else rng.choice([0.0, 0.5, rng.uniform(0, 30)]) for _ in dates]
    # Some days are not there at all.
    kept = [i for i in range(len(dates)) if rng.random() > 0.03]
    return [dates[i] for i in kept], [values[i] for i in kept]


@pytest.mark.parametrize("q, wet_only, baseline", [(0.9, False, None), (0.95, True, None), (0.1, False, Baseline(2001, 2002))])
def test_thresholds_against_brute_force(spark, random_series, q, wet_only, baseline):
    dates, values = random_series
    series = spark.createDataFrame([(5, d, v) for d, v in zip(dates, values)], "cell_id bigint, date date, value double")
    table = thresholds.doy_thresholds(series, [q], baseline, wet_only)
    ours = table.first()[thresholds.threshold_column(q)]
    first, last = min(dates), max(dates)
    if baseline:
        first, last = datetime.date(baseline.start_year, 1, 1), datetime.date(baseline.end_year, 12, 31)
    expected = brute_quantiles(dates, values, q, wet_only, first, last)
    assert len(ours) == 366
    assert [np.nan if v is None else v for v in ours] == pytest.approx(list(expected), rel=1e-9, nan_ok=True)


def test_thresholds_on_constants(spark):
    dates = days("2000-01-01", 366 + 365 * 2)
    rain = [100.0 if i % 2 == 0 else 0.0 for i in range(len(dates))]
    table = thresholds.doy_thresholds(daily_table(spark, rain), [0.5, 0.95], Baseline(2001, 2002), wet_only=True).first()
    assert set(table["q50"]) == set(table["q95"]) == {100.0}
    cold = thresholds.doy_thresholds(daily_table(spark, [10.0] * len(dates)), [0.1]).first()
    assert set(cold["q10"]) == {10.0}


def test_no_leap_day_keeps_365(spark):
    table = thresholds.doy_thresholds(daily_table(spark, [1.0] * 365, "2001-01-01"), [0.5]).first()
    assert len(table["q50"]) == 365


@pytest.mark.parametrize("baseline", [Baseline(1990, 1995), Baseline(2002, 2000)])
def test_bad_baseline_fails(spark, baseline):
    with pytest.raises(Exception, match="outside the record"):
        thresholds.doy_thresholds(daily_table(spark, [1.0] * 1000), [0.5], baseline).collect()


def test_gap_between_known_days_is_interpolated(spark):
    # Only days 100 and 120 of a non-leap year are known, so the window covers 98-102 and 118-122.
    rows = [(1, d, {100: 10.0, 120: 30.0}.get(d.timetuple().tm_yday)) for d in days("2001-01-01", 365)]
    series = spark.createDataFrame(rows, "cell_id bigint, date date, value double")
    q = thresholds.doy_thresholds(series, [0.5]).first()["q50"]
    assert q[101] == 10.0 and q[117] == 30.0
    assert q[109] == pytest.approx(20.0)
    assert q[96] is None and q[122] is None


def test_partial_year_is_null(spark):
    values = [float(i % 7) for i in range(365 + 5)]
    assert yearly(spark, values, "Rx1day", "2023-01-01") == {2023: 6.0, 2024: None}
    assert yearly(spark, values, "Rx1day", "2023-01-01", missing="skip") == {2023: 6.0, 2024: 5.0}


def test_simple_indices(spark):
    values = [0.5] * 10 + [5.0] * 10 + [25.0] * 2 + [0.0] * 343
    expected = {"SDII": 100 / 12, "Rx1day": 25.0, "Rx5day": 25 * 2 + 15.0, "R10mm": 2, "R20mm": 2, "PRCPTOT": 100.0,
                "CDD": 343, "CWD": 12}
    for index, value in expected.items():
        assert yearly(spark, values, index, "2001-01-01")[2001] == pytest.approx(value), index


def test_temperature_indices(spark):
    values = [-5.0] * 20 + [0.0, 25.0, 20.0] + [26.0] * 30 + [10.0] * (365 - 53)
    for index, value in {"TXx": 26, "TNn": -5, "FD": 20, "ID": 20, "SU": 30, "TR": 31}.items():
        assert yearly(spark, values, index, "2001-01-01")[2001] == value, index


def test_all_dry_year(spark):
    out = {i: yearly(spark, [0.0] * 365, i, "2001-01-01")[2001] for i in ("SDII", "PRCPTOT", "CDD", "CWD", "R95pTOT")}
    assert out == {"SDII": None, "PRCPTOT": 0.0, "CDD": 365.0, "CWD": 0.0, "R95pTOT": None}


def test_runs_break_at_periods_gaps_and_nulls(spark):
    table = daily_table(spark, [0.0] * 731, "2001-01-01")
    absent = datetime.date(2001, 7, 10)
    table = table.filter(F.col("date") != F.lit(absent))
    out = daily.daily_index_values(table, ["CDD"], missing="skip").collect()
    years = {r.period.year: r.value for r in out if r.freq == "YS"}
    assert years == {2001: (absent - datetime.date(2001, 1, 1)).days, 2002: 365, 2003: 1}
    july = [r.value for r in out if r.freq == "MS" and r.period == datetime.date(2001, 7, 1)]
    assert july == [21]
    nulls = daily_table(spark, [0.0] * 3 + [None] + [0.0] * 2, "2001-01-01")
    assert daily.daily_indices(nulls, ["CDD"], "YS", missing="skip").first().CDD == 3


def test_rx5day_crosses_months_and_needs_five_days(spark):
    values = [0.0] * 59
    for i in (29, 30, 31, 32, 33):
        values[i] = 10.0
    out = daily.daily_indices(daily_table(spark, values, "2001-01-01"), ["Rx5day"], "MS", missing="skip")
    assert {r.period.month: r.Rx5day for r in out.collect()} == {1: 20.0, 2: 50.0}
    short = daily.daily_indices(daily_table(spark, [1.0] * 4, "2001-01-01"), ["Rx5day"], "MS", missing="skip")
    assert short.first().Rx5day is None


@pytest.mark.parametrize("index, q, variable_side", [("WSDI", 0.9, 1), ("CSDI", 0.1, -1), ("TX90p", 0.9, 1), ("TN10p", 0.1, -1)])
def test_percentile_indices_against_brute_force(spark, index, q, variable_side):
    rng = random.Random(5)
    dates = days("1999-01-01", 365 * 9 + 366 * 3)
    wave = set(days("2003-07-01", 9)) | set(days("2005-12-28", 8))
    values = [20 + rng.gauss(0, 1) + (9 * variable_side if d in wave else 0) for d in dates]
    limit = brute_quantiles(dates, values, q, False, dates[0], dates[-1])
    beyond = {d: (v - limit[d.timetuple().tm_yday - 1]) * variable_side > 0 for d, v in zip(dates, values)}
    expected = {}
    for year in range(1999, 2011):
        flags = [beyond[d] for d in dates if d.year == year]
        runs = [len(list(g)) for flag, g in itertools.groupby(flags) if flag]
        expected[year] = sum(r for r in runs if r >= 6) if index.endswith("SDI") else sum(runs)
    assert yearly(spark, values, index, "1999-01-01") == expected
    assert sum(expected.values()) > 0


def test_rain_percentiles(spark):
    rng = random.Random(8)
    dates = days("2001-01-01", 365 * 3)
    values = [rng.choice([0.0, 0.0, 1.0, rng.uniform(0, 40)]) for _ in dates]
    limit = brute_quantiles(dates, values, 0.95, True, dates[0], dates[-1])[:366]
    raw = thresholds.doy_thresholds(daily_table(spark, values, "2001-01-01"), [0.95], wet_only=True).first()["q95"]
    over = [v > max(raw[d.timetuple().tm_yday - 1], 1.0) for d, v in zip(dates, values)]
    r95p = yearly(spark, values, "R95p", "2001-01-01")
    share = yearly(spark, values, "R95pTOT", "2001-01-01")
    for year in (2001, 2002, 2003):
        at = [i for i, d in enumerate(dates) if d.year == year]
        assert r95p[year] == sum(over[i] for i in at)
        total = sum(values[i] for i in at if values[i] > 1)
        assert share[year] == pytest.approx(sum(values[i] for i in at if over[i]) / total)
    assert limit is not None


def test_unknown_rain_threshold_is_one_millimetre(spark):
    # No wet day in the baseline, so every threshold is unknown.
    values = [0.0] * 365 + [2.0] * 3 + [0.0] * 362
    out = yearly(spark, values, "R95p", "2001-01-01", baseline=Baseline(2001, 2001))
    assert out == {2001: 0.0, 2002: 3.0}


def test_several_frequencies_in_one_pass(spark):
    rng = random.Random(2)
    table = daily_table(spark, [rng.choice([0.0, rng.uniform(0, 40)]) for _ in range(365 * 2 + 40)], "2001-01-01")
    names = ["SDII", "Rx1day", "Rx5day", "R10mm", "PRCPTOT", "CDD", "CWD", "R95p", "R95pTOT"]
    both = {(r["index"], r.freq, r.period): r.value for r in daily.daily_index_values(table, names).collect()}
    for freq in ("YS", "MS"):
        for r in daily.daily_indices(table, names, freq).collect():
            for n in names:
                got = both.pop((n, freq, r.period))
                assert got == r[n] or got == pytest.approx(r[n], rel=1e-12), (n, freq)
    assert not both


def test_one_shuffle_by_cell_for_a_family(spark):
    """Spells, running sums and counts of one variable need one exchange by cell, whatever the number of indices."""
    table = daily_table(spark, [1.0] * 400)
    out = daily.daily_indices(table, ["CDD", "CWD", "Rx5day", "PRCPTOT", "R10mm"], "YS")
    both = daily.daily_index_values(table, ["CDD", "CWD", "Rx5day", "PRCPTOT", "R10mm"])
    for table_ in (out, both):
        plan = table_._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1


def test_resample(spark):
    table = daily_table(spark, [1.0, None, 3.0] + [None] * 40, "2001-01-01")
    sums = {r.period.month: r.value for r in daily.resample(table, "pr", "MS").collect()}
    means = {r.period.month: r.value for r in daily.resample(table, "tmax", "MS").collect()}
    assert sums == {1: 4.0, 2: None} and means == {1: 2.0, 2: None}


def test_missing_share(spark):
    table = daily_table(spark, [None] * 3 + [1.0] * 28, "2001-01-01")
    for missing, expected in (("any", None), ("skip", 1.0), (0.1, 1.0), (0.09, None)):
        assert daily.daily_indices(table, ["Rx1day"], "MS", missing=missing).first().Rx1day == expected


def test_gap_filling_is_interpolation_between_known_days(spark):
    rng = np.random.default_rng(4)
    cases = []
    for share in (0.02, 0.5, 0.98, 1.0):
        values = rng.normal(size=365)
        cases.append([float(v) if k else None for v, k in zip(values, rng.random(365) < share)])
    cases += [[None] * 365, [None] * 100 + [2.0] + [None] * 264, [1.0] + [None] * 363 + [3.0]]
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "id int, v array<double>")
    found = {r.id: r.f for r in frame.select("id", thresholds._fill_gaps(F.col("v")).alias("f")).collect()}
    for i, case in enumerate(cases):
        known = [k for k, v in enumerate(case) if v is not None]
        expected = [None] * 365
        for d in range(known[0], known[-1] + 1) if known else ():
            expected[d] = float(np.interp(d, known, [case[k] for k in known]))
        assert [v is None for v in found[i]] == [v is None for v in expected]
        assert [v for v in found[i] if v is not None] == pytest.approx([v for v in expected if v is not None], abs=1e-12)


def test_monthly_states_add_up(spark):
    rows = [("pr", c, datetime.date(2000, 1, 1) + datetime.timedelta(days=d), None if (d + c) % 11 == 0 else float(d % 7)) for c in (1, 2) for d in range(500)]
    rows += [("tmax", 1, day, v) for _, c, day, v in rows if c == 1]
    table = spark.createDataFrame(rows, "variable string, cell_id bigint, date date, value double")
    whole = months.monthly_state(table, ["pr", "tmax"])
    early, late = table.filter("date < '2000-05-17'"), table.filter("date >= '2000-05-17'")
    joined = months.united(months.monthly_state(early, ["pr", "tmax"]), months.monthly_state(late, ["pr", "tmax"]))
    assert sorted(map(str, whole.collect())) == sorted(map(str, joined.select(*whole.columns).collect()))
    series = table.filter("variable = 'pr'").select("cell_id", "date", "value")
    for freq in ("MS", "YS"):
        direct = {(r.cell_id, r.period): r.value for r in daily.resample(series, "pr", freq).collect()}
        assert direct == {(r.cell_id, r.period): r.value for r in months.resampled(joined, "pr", freq).collect()}
    for missing in ("any", "skip", 0.2):
        direct = {(r.cell_id, r.period): r.value for r in spi.monthly_mean(series, missing).collect()}
        ours = {(r.cell_id, r.period): r.value for r in months.monthly_mean(joined, "pr", missing).collect()}
        assert direct.keys() == ours.keys() and all((a is None) == (ours[k] is None) and (a is None or a == pytest.approx(ours[k])) for k, a in direct.items())
    assert months.records(whole)["pr"] == (datetime.date(2000, 1, 1), datetime.date(2001, 5, 14))
