import datetime

import pytest
from pyspark.sql import functions as F

from isohyet.operators import merge, profile

SCHEMA = "variable string, cell_id bigint, lat double, lon double, date date, value double, src string"
CELLS = [(0, 10.0, 100.0), (1, 10.0, 102.5), (2, 12.5, 100.0), (3, 12.5, 102.5)]


def day(text):
    return datetime.date.fromisoformat(text)


def file(src, variable, dates, value=1.0):
    return [(variable, c, lat, lon, day(d), value, src) for d in dates for c, lat, lon in CELLS]


def table(spark, *files):
    return spark.createDataFrame([row for f in files for row in f], SCHEMA)


def wide(spark, *files, **options):
    merged = merge.merge(table(spark, *files), **options)
    rows = merge.to_wide(merged, ["pr", "tmax"]).filter("cell_id = 3").orderBy("date").collect()
    return [(r.date.isoformat(), r.pr, r.tmax) for r in rows]


def test_outer_merge(spark):
    out = wide(spark, file("a", "tmax", ["2023-01-01", "2023-01-03"], 30.0), file("b", "pr", ["2023-01-02", "2023-01-03"], 5.0))
    assert out == [("2023-01-01", None, 30.0), ("2023-01-02", 5.0, None), ("2023-01-03", 5.0, 30.0)]


def test_same_gap_in_both(spark):
    dates = ["2023-01-01", "2023-01-03"]
    out = wide(spark, file("a", "tmax", dates), file("b", "pr", dates))
    assert out == [("2023-01-01", 1.0, 1.0), ("2023-01-02", None, None), ("2023-01-03", 1.0, 1.0)]


@pytest.mark.parametrize("dates, expected", [
    (["2023-12-31", "2025-01-01"], 368),
    ([f"2023-01-{d:02d}" for d in range(1, 32)] + [f"2024-01-{d:02d}" for d in range(1, 32)], 396),
    (["2023-01-01", "2023-01-02", "2023-01-03"], 3),
])
def test_long_gaps(spark, dates, expected):
    merged = merge.merge(table(spark, file("a", "pr", dates)))
    assert merged.count() == expected * len(CELLS)
    assert merged.filter("value is not null").count() == len(dates) * len(CELLS)


def test_monthly_data_keeps_its_step(spark):
    dates = ["2023-01-01", "2023-02-01", "2023-03-01", "2023-05-01", "2023-06-01"]
    monthly = table(spark, file("a", "pr", dates))
    assert merge.infer_step(monthly) == "MS"
    assert merge.merge(monthly).count() == 6 * len(CELLS)
    assert merge.merge(monthly, step="D").count() == 152 * len(CELLS)


def test_first_file_wins(spark):
    obs = table(spark, file("b", "pr", ["2023-01-01", "2023-01-02"], 2.0), file("a", "pr", ["2023-01-02"], 1.0))
    rows = merge.merge(obs).filter("cell_id = 0").orderBy("date").collect()
    assert [(r.value, r.src) for r in rows] == [(2.0, "b"), (1.0, "a")]


def test_hot_point_is_reduced_before_the_shuffle(spark):
    """A third of all rows being copies of one point must not meet in one task."""
    copies = spark.range(20000).select(
        F.lit("pr").alias("variable"), F.lit(0).cast("long").alias("cell_id"), F.lit(10.0).alias("lat"),
        F.lit(100.0).alias("lon"), F.lit(day("2023-01-01")).alias("date"), F.col("id").cast("double").alias("value"),
        F.concat(F.lit("f"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("src"),
    )
    merged = merge.merge(copies.unionByName(table(spark, file("z", "pr", ["2023-01-01"]))), fill=False)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan
    assert merged.filter("cell_id = 0").first().value == 0.0
    assert merged.count() == 4


def test_mixed_files(spark):
    out = wide(
        spark, file("a", "tmax", ["2023-01-01", "2023-01-02"]), file("b", "tmax", ["2023-01-03", "2023-01-04"]),
        file("c", "pr", ["2023-01-01", "2023-01-02"]), file("d", "pr", ["2023-01-04"]),
    )
    assert out == [("2023-01-01", 1.0, 1.0), ("2023-01-02", 1.0, 1.0), ("2023-01-03", None, 1.0), ("2023-01-04", 1.0, 1.0)]


@pytest.mark.parametrize("files, mode", [
    ([["tmax", "pr"], ["pr", "tmax"]], "time"),
    ([["pr"]], "time"),
    ([["tmax"], ["pr"]], "attribute"),
    ([["tmax"], ["tmax", "pr"]], "mixed"),
    ([["a", "b"], ["b", "c"], ["c", "d"]], "mixed"),
    ([["tmax"], ["tmax"], ["pr"]], "mixed"),
    ([["tmax", "pr"], ["tmin"]], "attribute"),
])
def test_modes(spark, files, mode):
    rows = [(str(i), variables) for i, variables in enumerate(files)]
    row = merge.detect_mode(spark.createDataFrame(rows, "src string, variables array<string>")).first()
    assert row.mode == mode and row.files == len(files)
    assert row.variables == sorted({v for f in files for v in f})


def profiles(spark, rows):
    return spark.createDataFrame(rows, "src string, error string, calendar string, lat_res double, lon_res double")


@pytest.mark.parametrize("rows, errors", [
    ([("a", None, "standard", 0.25, 0.25), ("b", None, "standard", 0.25000001, 0.25)], []),
    ([("a", None, "standard", 0.25, 0.25), ("b", "broken", None, None, None)], ["unreadable file"]),
    ([("a", None, "standard", 0.25, 0.25), ("b", None, "noleap", 0.25, 0.25)], ["different calendars"]),
    ([("a", None, "standard", 0.25, 0.25), ("b", None, "standard", 0.25, 0.5)], ["different resolutions"]),
    ([("a", None, "x", 0.25, 0.25), ("b", None, "y", 0.5, 0.5)], ["different calendars", "different resolutions"]),
    ([("a", None, "standard", None, None), ("b", None, "standard", 0.5, 0.5)], []),
    ([], ["no files"]),
])
def test_compatibility(spark, rows, errors):
    row = merge.check_compatibility(profiles(spark, rows)).first()
    assert row.errors == errors and row.ok == (not errors)


def test_resolution(spark):
    rows = [("pr", 0, lat, lon, day("2023-01-01"), 1.0, "f") for lat in (10.0, 12.5, 15.0) for lon in (100.0, 100.5)]
    rows += [("pr", 0, 1.0, 1.0, day("2023-01-01"), 1.0, "point")]
    obs = spark.createDataFrame(rows, SCHEMA)
    out = {r.src: (r.lat_res, r.lon_res) for r in profile.file_resolution(obs).collect()}
    assert out == {"f": (2.5, 0.5), "point": (None, None)}
    stated = spark.createDataFrame([("f", "0.1 degrees", "0.1")], "src string, lat_text string, lon_text string")
    out = {r.src: (r.lat_res, r.lon_res) for r in profile.file_resolution(obs, stated).collect()}
    assert out == {"f": (0.1, 0.1), "point": (None, None)}


def test_number_in_text(spark):
    texts = spark.createDataFrame([("0.25 degrees",), ("10 km",), ("-.5",), ("fine",), (None,)], "t string")
    assert [r[0] for r in texts.select(profile.number_in(F.col("t"))).collect()] == [0.25, None, 0.5, None, None]


def test_profile_of_an_uneven_grid(spark):
    rows = [("tmax", 0, lat, lon, day(d), 1.0, "f") for lat in (1.0, 2.0, 4.0) for lon in (5.0, 6.0)
            for d in ("2020-12-31", "2021-01-01", "2023-01-01")]
    row = profile.dataset_profile(spark.createDataFrame(rows, SCHEMA)).first()
    assert row.spatial_resolution == "~1.500° x 1.000°"
    assert (row.n_time, row.n_lat, row.n_lon, row.time_years) == (3, 3, 2, 3)
    assert (row.time_start, row.time_end) == (day("2020-12-31"), day("2023-01-01"))


def test_profile_of_a_file(spark):
    obs = table(spark, file("a", "pr", ["2020-01-01", "2021-12-31"]), file("a", "tmax", ["2020-01-01"]))
    row = profile.file_profile(obs).first()
    assert row.variables == ["pr", "tmax"] and row.time_years == 2.0
    assert row.spatial_resolution == "2.500° x 2.500°"


def test_variable_files(spark):
    obs = table(spark, file("a", "pr", ["2020-01-01"]), file("b", "pr", ["2020-01-01"]), file("b", "tmax", ["2020-01-01"]))
    assert {tuple(r) for r in merge.variable_files(obs).collect()} == {("pr", "a"), ("pr", "b"), ("tmax", "b")}
    assert {r.src: r.variables for r in merge.file_variables(obs).collect()} == {"a": ["pr"], "b": ["pr", "tmax"]}


@pytest.mark.parametrize("step, expected, first, rows", [
    ("interval 1 year", "YS", "2000-07-01", 10), ("interval 5 day", "5D", "2000-02-20", 20), ("interval 1 month", "MS", "2000-01-15", 12),
    ("interval 1 month", "MS", "2000-01-31", 14), ("interval 1 day", "D", "1999-12-20", 30)])
def test_steps_are_inferred_and_filled(spark, step, expected, first, rows):
    dates = spark.range(1).select(F.explode(F.expr(f"sequence(date'{first}', date'{first}' + {rows - 1} * {step}, {step})")).alias("date"))
    table = dates.select(F.lit("pr").alias("variable"), F.lit(1).cast("long").alias("cell_id"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"),
                         "date", F.lit(1.0).alias("value"), F.lit("a").alias("src"))
    gap = table.orderBy("date").offset(3).limit(1)
    holed = table.join(gap.select("date"), "date", "left_anti")
    assert merge.infer_step(holed) == expected
    filled = merge.merge(holed)
    assert filled.count() == rows and filled.filter("value is null").count() == 1


def test_steps_that_cannot_be_told(spark):
    from datetime import date

    def table(*days):
        return spark.createDataFrame([("pr", 1, 1.0, 2.0, d, 1.0, "a") for d in days],
                                     "variable string, cell_id long, lat double, lon double, date date, value double, src string")

    with pytest.raises(ValueError, match="single date"):
        merge.infer_step(table(date(2000, 1, 1)))
    with pytest.raises(ValueError, match="do not follow"):
        merge.infer_step(table(date(2000, 1, 1), date(2000, 1, 6), date(2000, 1, 13)))
