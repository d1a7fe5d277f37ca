import datetime

import pytest
from pyspark.sql import functions as F

from conftest import explain
from isohyet.model import Scope, combine_selections, expand_selection, display_order, in_display_order, spi_window
from isohyet.operators import clean


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("given, expected", [
    ("precip", "pr"), ("T2M", "tas"), ("tasmax", "tmax"), ("MN2T", "tmin"), ("wind", "wind"),
])
def test_aliases(spark, given, expected):
    assert one(spark, clean.canonical_variable(F.lit(given))) == expected


def test_coordinates(spark):
    df = spark.createDataFrame([(1, 2, 3)], "lat int, nav_lon int, Times int")
    assert clean.standardise_coordinates(df).columns == ["latitude", "longitude", "time"]
    both = spark.createDataFrame([(1, 2)], "lat int, latitude int")
    assert clean.standardise_coordinates(both).columns == ["lat", "latitude"]
    with pytest.raises(KeyError):
        clean.standardise_coordinates(both, strict=True)


@pytest.mark.parametrize("value, unit, expected", [
    (1.0, "mm/s", 86400.0), (1.0, "M", 1000.0), (1.0, " mm/day ", 1.0), (2.0, "kg m-2 s-1", 172800.0), (3.0, "mm", 3.0),
])
def test_precipitation_units(spark, value, unit, expected):
    assert one(spark, clean.precipitation_mm_per_day(F.lit(value), F.lit(unit))) == expected


def test_temperature_units(spark):
    assert one(spark, clean.temperature_celsius(F.lit(273.15), F.lit("K"))) == 0.0
    assert one(spark, clean.temperature_celsius(F.lit(20.0), F.lit("degC"))) == 20.0
    assert one(spark, clean.kelvin_to_celsius(F.lit(300.15), F.lit("kelvin"))) == pytest.approx(27.0)
    assert one(spark, clean.kelvin_to_celsius(F.lit(5.0), F.lit("days"))) == 5.0


@pytest.mark.parametrize("convert, unit", [
    (clean.precipitation_mm_per_day, "inch"), (clean.temperature_celsius, "fahrenheit"), (clean.temperature_celsius, None),
])
def test_unknown_units_fail(spark, convert, unit):
    with pytest.raises(Exception, match="unknown unit"):
        one(spark, convert(F.lit(1.0), F.lit(unit).cast("string")))


def test_not_a_number_becomes_null(spark):
    df = spark.createDataFrame([("pr", float("nan"), "mm"), ("pr", 1.0, "mm")], "variable string, value double, units string")
    assert [r.value for r in clean.convert_units(df).collect()] == [None, 1.0]


def test_display_name(spark):
    def name(a, b):
        return one(spark, clean.display_name(F.lit(a).cast("string"), F.lit(b).cast("string"), F.lit("pr")))

    assert name("rain_flux", "x") == "rain_flux"
    assert name(" Unknown ", "Rain") == "Rain"
    assert name(None, "n/a") == "pr"


def test_scope(spark):
    rows = [(float(x), 0.0, datetime.date(2000 + x // 10, 12, 31), x) for x in range(0, 31)]
    df = spark.createDataFrame(rows, "lat double, lon double, date date, id int")
    kept = clean.apply_scope(df, Scope(min_lat=5, max_lat=25)).select("id").collect()
    assert sorted(r.id for r in kept) == list(range(5, 26))
    kept = clean.apply_scope(df, Scope(start_year=2001, end_year=2001)).collect()
    assert sorted(r.id for r in kept) == list(range(10, 20))
    assert clean.apply_scope(df, Scope()).count() == 31


def test_scope_reaches_the_scan(spark, tmp_path):
    from isohyet.sources import obs, sinks

    rows = [("pr", 1, 0.0, 0.0, datetime.date(y, 1, 1), 1.0, "f") for y in range(1990, 2000)]
    table = spark.createDataFrame(rows, "variable string, cell_id bigint, lat double, lon double, date date, value double, src string")
    path = str(tmp_path / "obs")
    sinks.write_obs(table, path)
    scoped = clean.apply_scope(obs.read_obs(spark, path), Scope(1995, 1996, min_lat=-1)).filter("variable = 'pr'")
    plan = explain(scoped)
    partition = next(line for line in plan.splitlines() if line.startswith("PartitionFilters"))
    pushed = next(line for line in plan.splitlines() if line.startswith("PushedFilters"))
    assert "year#" in partition and "variable#" in partition
    assert "GreaterThanOrEqual(lat" in pushed and "GreaterThanOrEqual(date" in pushed
    assert scoped.count() == 2


def test_clamp_years(spark):
    def clamp(a, b):
        lo, hi = clean.clamp_years(F.lit(a), F.lit(b), F.lit(1960), F.lit(2024))
        return spark.range(1).select(lo.alias("a"), hi.alias("b")).first()

    assert tuple(clamp(1950, 2030)) == (1960, 2024)
    assert tuple(clamp(1970, 1980)) == (1970, 1980)
    with pytest.raises(Exception, match="after end year"):
        clamp(1990, 1980)


def test_selection():
    assert expand_selection(["SPI6", "CDD", "SPI6"]) == [
        "SPI6", "SPI6_Drought_Frequency", "SPI6_Drought_Duration", "SPI6_Drought_Peak", "SPI6_Drought_Severity",
        "SPI6_Flood_Frequency", "SPI6_Flood_Duration", "SPI6_Flood_Peak", "SPI6_Flood_Severity", "CDD",
    ]
    assert len(display_order()) == len(set(display_order())) == 62
    assert [spi_window(n) for n in ("SPI6", "SPI12_Flood_Peak", "SPI7", "SPIX", "CDD")] == [6, 12, None, None, None]


def test_combined_selections():
    assert combine_selections(["CDD", "zzz"], ["SPI3", "CDD"]) == ["SPI3", "CDD", "zzz"]


def test_display_order(spark):
    names = spark.createDataFrame([("zzz",), ("CDD",), ("SPI3",)], "`index` string")
    rows = in_display_order(names, spark).orderBy("position").collect()
    assert [r["index"] for r in rows] == ["SPI3", "CDD", "zzz"]
    assert rows[-1]["position"] == 999


def test_country_names():
    assert clean.country_names("Timor-Leste") == ["Timor-Leste", "Timor Leste", "East Timor"]
    assert clean.country_names("Laos") == ["Laos"]
