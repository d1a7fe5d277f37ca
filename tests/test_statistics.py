import itertools
import math
import random
import statistics
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import months
from isohyet.operators import events, spi, trend

SCHEMA = "`index` string, cell_id bigint, period date, value double"


def monthly(spark, series, index="SPI3"):
    rows = [
        (index, cell, p, v) for cell, values in series.items() for p, v in zip(months(2000, len(values)), values)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def yearly_events(spark, series, threshold=1.0):
    rows = events.yearly_events(monthly(spark, series), threshold).collect()
    return {(r.cell_id, r.kind, r.period.year): (r.Frequency, r.Duration, r.Peak, r.Severity) for r in rows}


def test_drought(spark):
    values = [0.0] * 24
    values[2], values[3], values[6] = -1.2, -2.0, -1.5
    out = yearly_events(spark, {1: values})
    assert out[1, "Drought", 2000] == (1, 2, -2.0, pytest.approx(3.2))
    assert out[1, "Drought", 2001] == (0, None, None, None)
    assert out[1, "Flood", 2000] == (0, None, None, None)


def test_flood_and_negative_threshold(spark):
    values = [0.0] * 24
    values[1], values[2] = 1.5, 2.5
    assert yearly_events(spark, {1: values}, -1.0)[1, "Flood", 2000] == (1, 2, 2.5, pytest.approx(4.0))


def test_all_null_cell(spark):
    out = yearly_events(spark, {1: [None] * 24, 2: [0.0] * 24})
    assert out[1, "Drought", 2000] == (None, None, None, None)
    assert out[2, "Drought", 2000] == (0, None, None, None)


def test_grid_of_cells(spark):
    first = [-1.5, -2.5] + [0.0] * 22
    out = yearly_events(spark, {1: first, 2: [0.0] * 24, 3: [0.0] * 24, 4: [0.0] * 24})
    assert out[1, "Drought", 2000] == (1, 2, -2.5, pytest.approx(4.0))
    assert all(out[c, "Drought", y] == (0, None, None, None) for c in (2, 3, 4) for y in (2000, 2001))


def test_events_across_years_nulls_and_open_ends(spark):
    values = [0.0] * 36
    values[10:14] = [-1.5, None, -3.0, -1.1]  # November 2000 to February 2001
    values[20], values[21] = None, -1.5  # one month only
    values[34:36] = [-1.2, -1.3]  # runs into the end
    out = yearly_events(spark, {1: values})
    assert out[1, "Drought", 2000] == (1, 4, -3.0, pytest.approx(5.6))
    assert out[1, "Drought", 2001] == (0, None, None, None)
    assert out[1, "Drought", 2002] == (1, 2, -1.3, pytest.approx(2.5))


def brute_events(values, threshold):
    found, start, on = [], None, False
    for t, v in enumerate(values + [0.0]):
        if not on and v is not None and v < -threshold and t < len(values):
            on, start = True, t
        elif on and ((v is not None and v >= -threshold) or t == len(values)):
            on = False
            if t - start >= 2:
                found.append((start, t))
    return found


def test_events_against_brute_force(spark):
    rng = random.Random(4)
    series = {c: [rng.choice([None, rng.gauss(-0.5, 1.2), rng.gauss(-0.5, 1.2)]) for _ in range(72)] for c in range(12)}
    out = yearly_events(spark, series, 0.5)
    for c, values in series.items():
        by_year = {}
        for s, e in brute_events(values, 0.5):
            known = [v for v in values[s:e] if v is not None]
            by_year.setdefault(2000 + s // 12, []).append((e - s, min(known), sum(-v for v in known if v < 0)))
        for year in range(2000, 2006):
            got, want = out[c, "Drought", year], by_year.get(year, [])
            assert got[0] == len(want)
            if want:
                assert got[1:] == pytest.approx((max(w[0] for w in want), min(w[1] for w in want), max(w[2] for w in want)))


def test_event_names(spark):
    rows = events.event_values(monthly(spark, {1: [0.0] * 12}, "SPI6")).collect()
    assert {r["index"] for r in rows} == {f"SPI6_{k}_{m}" for k in ("Drought", "Flood") for m in ("Frequency", "Duration", "Peak", "Severity")}


def test_month_classes(spark):
    values = [-1.5, -1.2, 0.0, -1.4, 1.3, None, 1.6, 0.2, 1.1]
    rows = events.classify_months(monthly(spark, {1: values}), ("cell_id",), 1.0).orderBy("period").collect()
    assert [r.label for r in rows] == ["drought", "drought", "neutral", "neutral", "wet", "wet", "neutral", "neutral"]


def mann_kendall(values):
    known = [(i, v) for i, v in enumerate(values) if v is not None]
    pairs = list(itertools.combinations(known, 2))
    s = sum((b[1] > a[1]) - (b[1] < a[1]) for a, b in pairs)
    n = len(known)
    ties = [sum(1 for _, w in known if w == v) for v in {v for _, v in known}]
    variance = (n * (n - 1) * (2 * n + 5) - sum(t * (t - 1) * (2 * t + 5) for t in ties)) / 18
    z = 0.0 if s == 0 else (s - math.copysign(1, s)) / math.sqrt(variance)
    slope = statistics.median((b[1] - a[1]) / (b[0] - a[0]) for a, b in pairs)
    return s, z, math.erfc(abs(z) / math.sqrt(2)), slope


def yearly_series(spark, series, index="PRCPTOT"):
    rows = [(index, c, p, v) for c, values in series.items() for p, v in zip(months(1960, 12 * len(values))[::12], values)]
    return spark.createDataFrame(rows, SCHEMA)


def test_trend_against_brute_force(spark):
    rng = random.Random(6)
    series = {}
    for c in range(20):
        values = [round(rng.gauss(0.05 * i, 1), rng.choice([0, 1, 6])) for i in range(40)]
        for _ in range(rng.randint(0, 11)):
            values[rng.randrange(40)] = None
        series[c] = values
    rows = trend.trends(yearly_series(spark, series), ("cell_id",)).collect()
    assert len(rows) == 20
    for r in rows:
        s, z, p, slope = mann_kendall(series[r.cell_id])
        assert r.s == s and r.z == pytest.approx(z) and r.p == pytest.approx(p, abs=1e-12)
        assert r.slope == pytest.approx(slope * 10)
        assert r.trend is None


def test_reversed_series_flips_the_sign(spark):
    values = [1.0, 3.0, 2.0, 5.0, 4.0, 7.0, 6.0]
    a, b = trend.trends(yearly_series(spark, {1: values, 2: values[::-1]}), ("cell_id",)).orderBy("cell_id").collect()
    assert a.z == -b.z > 0 and a.p == b.p and a.slope == -b.slope


def test_constant_series_and_too_few_values(spark):
    rows = trend.trends(yearly_series(spark, {1: [2.0] * 10, 2: [1.0] * 6 + [None] * 4}), ("cell_id",)).collect()
    assert [(r.cell_id, r.s, r.z, r.p, r.slope) for r in rows] == [(1, 0.0, 0.0, 1.0, 0.0)]


def test_event_measures_are_zero_filled(spark):
    values = [None, None, 2.0, None, 3.0, 4.0, 5.0, 6.0]
    filled = trend.trends(yearly_series(spark, {1: values}, "SPI3_Drought_Duration"), ("cell_id",)).first()
    s, z, p, slope = mann_kendall([v or 0.0 for v in values])
    assert (filled.s, filled.slope, filled.trend) == (s, pytest.approx(slope * 10), "increasing")
    assert trend.trends(yearly_series(spark, {1: values}, "SPI3"), ("cell_id",)).count() == 0


def test_monthly_slope_is_per_decade(spark):
    table = monthly(spark, {1: [0.5 * i for i in range(24)]}, "SPI3")
    assert trend.trends(table, ("cell_id",), "MS").first().slope == pytest.approx(60.0)
    assert trend.trends(table, ("cell_id",), "MS", per_period_decade=False).first().slope == pytest.approx(5.0)


def digamma(a):
    h = 1e-5
    return (math.lgamma(a + h) - math.lgamma(a - h)) / (2 * h)


def gamma_cdf(a, x):
    total = term = 1.0
    n = 0
    while term > total * 1e-17:
        n += 1
        term *= x / (a + n)
        total += term
    return math.exp(a * math.log(x) - x - math.lgamma(a + 1)) * total


def test_spi_against_brute_force(spark):
    rng = random.Random(12)
    years, window = 20, 3
    rain = [rng.choice([0.0, rng.gammavariate(1.5, 2.0), rng.gammavariate(1.5, 2.0)]) if i % 12 < 5 else 0.0 if i % 12 < 9 else rng.gammavariate(4, 1)
            for i in range(12 * years)]
    table = spark.createDataFrame([(1, p, v) for p, v in zip(months(2000, len(rain)), rain)], "cell_id bigint, period date, value double")
    ours = [r.value for r in spi.spi(table, window).orderBy("period").collect()]
    smooth = [None] * (window - 1) + [sum(rain[i - window + 1:i + 1]) / window for i in range(window - 1, len(rain))]
    for month in range(12):
        at = [i for i in range(month, len(rain), 12) if smooth[i] is not None]
        wet = [smooth[i] for i in at if smooth[i] > 0]
        dry = 1 - len(wet) / len(at)
        spread = math.log(statistics.fmean(wet)) - statistics.fmean(map(math.log, wet)) if len(wet) > 1 else 0
        if spread <= 1e-12:
            assert all(ours[i] is None for i in at)
            continue
        low, high = 1e-3, 1e4
        for _ in range(200):
            middle = math.sqrt(low * high)
            low, high = (middle, high) if math.log(middle) - digamma(middle) > spread else (low, middle)
        for i in at:
            p = dry if smooth[i] <= 0 else dry + (1 - dry) * gamma_cdf(low, smooth[i] * low / statistics.fmean(wet))
            want = -8.21 if p <= 0 else max(-8.21, min(8.21, statistics.NormalDist().inv_cdf(p)))
            assert ours[i] == pytest.approx(want, abs=1e-5)
    assert ours[:2] == [None, None]


def test_spi_is_centred(spark):
    rng = random.Random(1)
    rows = [(c, p, rng.gammavariate(3, 2)) for c in range(3) for p in months(1960, 12 * 60)]
    table = spi.spi(spark.createDataFrame(rows, "cell_id bigint, period date, value double"), 6)
    mean, sd = table.agg(F.avg("value"), F.stddev("value")).first()
    assert abs(mean) < 0.02 and abs(sd - 1) < 0.05


def test_spi_with_missing_months(spark):
    rng = random.Random(2)
    rows = [(1, p, None if i == 30 else rng.gammavariate(3, 2)) for i, p in enumerate(months(2000, 120))]
    table = spark.createDataFrame(rows, "cell_id bigint, period date, value double")
    out = [r.value is None for r in spi.spi(table, 3).orderBy("period").collect()]
    assert [i for i, null in enumerate(out) if null] == [0, 1, 30, 31, 32]
    # An absent month is a gap as well.
    out = spi.spi(table.filter(F.col("value").isNotNull()), 3).filter("value is null").select("period").collect()
    assert len(out) == 4
    assert np.isfinite([r.value for r in spi.spi(table, 12).filter("value is not null").collect()]).all()


def test_spi_of_a_cell_without_data(spark):
    rows = [(c, p, None if c == 1 else 1.0 + i % 7) for c in (1, 2) for i, p in enumerate(months(2000, 60))]
    table = spi.spi(spark.createDataFrame(rows, "cell_id bigint, period date, value double"), 3)
    assert {r.cell_id: r[1] for r in table.groupBy("cell_id").agg(F.count("value")).collect()}[1] == 0
    out = events.yearly_events(table.withColumn("index", F.lit("SPI3"))).filter("cell_id = 1").collect()
    assert all(r.Frequency is None for r in out)


def direct(pos, value):
    i, j = np.triu_indices(len(value), 1)
    d = value[j] - value[i]
    return np.sign(d).sum(), np.median(d / (pos[j] - pos[i]))


@pytest.mark.parametrize("kind", ["normal", "rounded", "zeros", "trend", "constant", "steps"])
def test_selected_median_slope_equals_all_slopes(kind):
    rng = np.random.default_rng(1)
    n = trend.DIRECT + 900
    value = {"normal": rng.normal(size=n), "rounded": np.round(rng.normal(size=n), 2), "zeros": np.where(rng.random(n) < 0.7, 0.0, rng.random(n)),
             "trend": np.arange(n) * 0.01 + np.round(rng.normal(size=n), 1), "constant": np.ones(n), "steps": np.floor(np.arange(n) / 7)}[kind]
    for pos in (np.arange(float(n)), np.sort(rng.choice(5 * n, n, replace=False)).astype(float)):
        _, s, _, median = trend._series_statistics(pos, value)
        assert (s, median) == direct(pos, value)
    assert trend._paired_median(np.arange(300.0), value[:300], 300 * 299 // 4 - 1, 300 * 299 // 4) == direct(np.arange(300.0), value[:300])[1]


def test_long_daily_series_stay_small():
    rng = np.random.default_rng(2)
    value = np.round(rng.normal(25, 5, 24_000) + np.arange(24_000) * 1e-4, 1)
    tracemalloc.start()
    began = time.perf_counter()
    trend._series_statistics(np.arange(24_000.0), value)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert time.perf_counter() - began < 20 and peak < 400e6  # 288 million pairs would be 2.3 GB
