import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import months
from isohyet.operators import legend, maps, series
from isohyet.sources import sinks

SCHEMA = "`index` string, area string, period date, value double"


def yearly(spark, values, index="PRCPTOT", area="x"):
    return spark.createDataFrame([(index, area, p, v) for p, v in zip(months(2000, 12 * len(values))[::12], values)], SCHEMA)


def test_actual_maps(spark):
    both = yearly(spark, [1.0, None, 2.0]).unionByName(yearly(spark, [1.0, None, 2.0], "SPI3_Flood_Frequency"))
    both = both.unionByName(yearly(spark, [None, None], "TXx"))
    out = {r["index"]: r.value for r in maps.actual(both, ("area",)).collect()}
    assert out == {"PRCPTOT": 1.5, "SPI3_Flood_Frequency": 3.0}
    assert maps.actual(both, ("area",), 2002, 2002).filter("`index` = 'PRCPTOT'").first().value == 2.0


def test_trend_eligibility(spark):
    names = ["pr", "tmax", "CDD", "SPI3", "SPI3_Drought_Frequency", "SPI3_Drought_Peak"]
    table = spark.createDataFrame([(n,) for n in names], "`index` string")
    kept = {r[0] for r in maps.with_trend_support(table).collect()}
    assert kept == {"CDD", "SPI3", "SPI3_Drought_Peak"}


def test_yearly_and_monthly_series(spark):
    monthly = spark.createDataFrame([("SPI3", "x", p, v) for p, v in zip(months(2000, 4), [None, 1.0, 2.0, 2.00006])], SCHEMA)
    assert [(r.year, r.month, r.value) for r in series.monthly_series(monthly).orderBy("month").collect()] == [
        (2000, 2, 1.0), (2000, 3, 2.0), (2000, 4, 2.0001)]
    assert [(r.year, r.value) for r in series.yearly_series(monthly).collect()] == [(2000, 1.6667)]


def test_moving_average_is_shorter_at_the_ends(spark):
    table = series.yearly_series(yearly(spark, [1.0, 2.0, 3.0, 4.0, 10.0]))
    out = series.moving_average(table, window=3).orderBy("year").collect()
    assert [r.year_avg for r in out] == pytest.approx([1.5, 2.0, 3.0, 17 / 3, 7.0])
    assert [r.annual for r in out] == [1.0, 2.0, 3.0, 4.0, 10.0]


def test_monthly_climatology(spark):
    table = spark.createDataFrame([("pr", "x", 2000 + i // 12, i % 12 + 1, float(i)) for i in range(36)],
                                  "`index` string, area string, year int, month int, value double")
    out = {r.month: r.value for r in series.monthly_climatology(table, start_year=2001, end_year=2002).collect()}
    assert out[1] == 18.0 and len(out) == 12


@pytest.mark.parametrize("low, high, expected", [
    (0.0, 1.0, [i / 10 for i in range(11)]),
    (3.0, 97.0, [float(i) for i in range(10, 100, 10)]),
    (-1.0, 1.0, [-1.0, -0.8, -0.6, -0.4, -0.2, 0.0, 0.2, 0.4, 0.6, 0.8, 1.0]),
    (1234.0, 5321.0, [float(i) for i in range(1500, 5001, 500)]),
    (0.0011, 0.0042, [0.0015, 0.002, 0.0025, 0.003, 0.0035, 0.004]),
])
def test_ticks(spark, low, high, expected):
    out = spark.createDataFrame([(low, high)], "a double, b double").select(legend.ticks(F.col("a"), F.col("b"))).first()[0]
    assert out == pytest.approx(expected)


def test_legend(spark):
    table = spark.createDataFrame([("PRCPTOT", i, float(i)) for i in range(101)] + [("PRCPTOT", 999, None), ("CDD", 1, 3.0)],
                                  "`index` string, cell_id bigint, value double")
    row = legend.legend_breaks(table, "value").collect()
    assert len(row) == 1 and (row[0].low, row[0].high) == (2.0, 98.0)
    assert row[0].breaks == [float(i) for i in range(10, 91, 10)]
    own = legend.legend_breaks(table, "value", low=0, high=50).first()
    assert (own.low, own.high) == (0.0, 50.0)
    around = legend.legend_breaks(table, "value", symmetric=True).first()
    assert (around.low, around.high) == (-98.0, 98.0)
    classes = spark.createDataFrame([(v, row[0].breaks) for v in (0.0, 20.0, 19.9, 85.0, 500.0, None)], "v double, b array<double>")
    out = [r[0] for r in classes.select(legend.legend_class(F.col("v"), F.col("b"))).collect()]
    assert out == [0, 1, 0, 7, 7, None]


def test_symmetric_axis(spark):
    out = legend.symmetric_axis(yearly(spark, [1.0, -2.0, None])).first()
    assert out.ticks == pytest.approx([-2.2, -1.1, 0.0, 1.1, 2.2])
    assert legend.symmetric_axis(yearly(spark, [0.0])).first().limit == 1.0


def test_skip_present(spark):
    keys = ["area", "index"]
    wanted = spark.createDataFrame([("a", "x"), ("b", "x"), ("a", "y")], "area string, `index` string")
    present = spark.createDataFrame([("a", "x"), ("a", "x"), ("c", "y")], "area string, `index` string")
    left = {tuple(r) for r in sinks.not_yet_present(wanted, present, keys).select(*keys).collect()}
    assert left == {("b", "x"), ("a", "y")}


def test_observations_are_stored_by_variable_and_year(spark, tmp_path):
    from isohyet.sources import obs

    schema = "variable string, cell_id bigint, lat double, lon double, date date, value double, src string"
    rows = [(v, c, 1.0, 2.0, p, 1.0, "f") for v in ("pr", "tmax") for c in range(20) for p in months(2000, 24)]
    path = str(tmp_path / "obs")
    sinks.write_obs(spark.createDataFrame(rows, schema), path)
    again = [("pr", 1, 1.0, 2.0, months(2001, 1)[0], 9.0, "g")]
    sinks.write_obs(spark.createDataFrame(again, schema), path)
    table = obs.read_obs(spark, path)
    assert table.filter("variable = 'pr' and year = 2001").count() == 1
    assert table.filter("variable = 'pr' and year = 2000").count() == 240
    assert table.filter("variable = 'tmax'").count() == 480


def test_features_are_valid_json(spark):
    table = spark.createDataFrame([("x", 1.5, None)], "area string, value double, trend string")
    ring = F.array(F.array(F.array(F.lit(1.0), F.lit(2.0))))
    text = table.select(sinks.feature(ring, ["value", "trend"])).first()[0]
    assert json.loads(text) == {
        "type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[1.0, 2.0]]]}, "properties": {"value": 1.5}}


def test_indices_of_a_bucketed_table_need_no_shuffle(spark, tmp_path):
    from conftest import days
    from isohyet.operators import daily

    schema = "variable string, cell_id bigint, lat double, lon double, date date, value double, src string"
    rows = [("pr", c, 1.0, 2.0, d, float((i * 7 + c) % 30), "f") for c in range(5) for i, d in enumerate(days("2000-01-01", 731))]
    table = spark.createDataFrame(rows, schema)
    sinks.save_obs_table(table, "bucketed_obs", str(tmp_path / "bucketed"), 4)
    series_ = spark.table("bucketed_obs").filter("variable = 'pr'").select("cell_id", "date", "value")
    names = ["CDD", "CWD", "Rx5day", "PRCPTOT", "R95p", "R99pTOT"]
    record = (days("2000-01-01", 1)[0], days("2001-12-31", 1)[0])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = daily.daily_indices(series_, names, "YS", record=record, colocated=True)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        got = out.orderBy("cell_id", "period").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = daily.daily_indices(table.select("cell_id", "date", "value"), names, "YS")
    assert got == want.orderBy("cell_id", "period").collect()
    spark.sql("drop table bucketed_obs")


def test_writers_rebalance_by_folder(spark):
    table = spark.range(100).select((F.col("id") % 3).alias("freq"), "id")
    plan = sinks.balanced(table, "freq")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(freq" in plan and "REBALANCE_PARTITIONS_BY_COL" in plan


@pytest.mark.parametrize("kind", ["even", "outlier", "same", "two"])
def test_selected_ranks_equal_percentiles(spark, kind):
    rng = random.Random(5)
    values = {"even": [rng.uniform(-3, 9) for _ in range(3000)], "outlier": [rng.gauss(0, 1e-6) for _ in range(2000)] + [1e9, -1e9],
              "same": [4.25] * 7, "two": [1.0, 2.0]}[kind]
    table = spark.createDataFrame([("a", v) for v in values] + [(None, 1.0), (None, 3.0), ("b", None)], "index string, v double")
    by_ranks = {r["index"]: (r.low, r.high) for r in legend.colour_range(table, "v", largest=0).collect()}
    gathered = {r["index"]: (r.low, r.high) for r in legend.colour_range(table, "v").collect()}
    assert set(by_ranks) == {"a", None}
    for key, pair in by_ranks.items():
        assert pair == pytest.approx(gathered[key], rel=1e-12)
    assert by_ranks["a"] == pytest.approx(tuple(np.quantile(values, [0.02, 0.98])), rel=1e-12)
