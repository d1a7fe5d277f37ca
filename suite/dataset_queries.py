"""Cleaning, merging, profiles, maps, series and legends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet import model
from isohyet.model import Scope
from isohyet.operators import clean, legend, maps, merge, profile, runner, series, spatial
from isohyet.plans import jobs
from isohyet.sources import areas, sinks
from suite import cube
from suite.daily_queries import rounded_sql
from suite.registry import first_day, period_days, register, rounded, with_cube
from suite.spatial_queries import LAYER, PRCPTOT_SQL, layer, prepared, weights, weights_sql, yearly_total
from suite.statistics_queries import (
    AREA_YEARS, CELL_YEARS, LIKE_SQL, area_yearly, events_sql, like_events, monthly_rain, spi_like, trend_sql,
)

# Spellings and units under which the "files" deliver their variables.
SPELLING = {"pr": "Precip", "tmax": "TASMAX", "tmin": "mn2t"}


def file_obs(spark, sf_dir: str) -> DataFrame:
    """The overlapping files as long observations with positions."""
    long = cube.files(spark, sf_dir).unpivot(["src", "cell_id", "date"], ["pr", "tmax", "tmin"], "variable", "value")
    return long.join(cube.grid(spark, sf_dir), "cell_id").select(
        "variable", "cell_id", "lat", "lon", "date", "value", "src"
    )


FILES = """
per_file AS (
  SELECT src, cell_id, date, CAST(sum(quantity) AS BIGINT) AS q, CAST(sum(cents) AS BIGINT) AS dc,
         CAST(sum(quantity * cents) AS BIGINT) AS qd, count(*) AS n
  FROM readings GROUP BY src, cell_id, date),
files AS (
  SELECT src, cell_id, date, (qd * 64 // 100) / 64.0::DOUBLE AS pr,
         15.0::DOUBLE + (q * 192 // (5 * n)) / 64.0::DOUBLE AS tmax,
         15.0::DOUBLE + (q * 192 // (5 * n)) / 64.0::DOUBLE - (dc * 192 // n) / 64.0::DOUBLE AS tmin
  FROM per_file)"""

FIRST_WINS = f"""{FILES},
kept AS (
  SELECT * EXCLUDE (r) FROM (
    SELECT *, row_number() OVER (PARTITION BY cell_id, date ORDER BY src) AS r FROM files) WHERE r = 1)"""


@register(
    "merge_outer_first_wins",
    with_cube(f"WITH {FIRST_WINS} SELECT cell_id, date, src, pr, tmax, tmin FROM kept"),
)
def merge_outer_first_wins(spark, sf_dir):
    merged = merge.merge(file_obs(spark, sf_dir), fill=False)
    wide = merge.to_wide(merged, ["pr", "tmax", "tmin"])
    src = merged.filter("variable = 'pr'").select("cell_id", "date", "src")
    return wide.join(src, ["cell_id", "date"]).select("cell_id", "date", "src", "pr", "tmax", "tmin")


@register(
    "gap_fill",
    with_cube(f"""
WITH {FIRST_WINS}, span AS (
  SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM files)
SELECT 'tmax' AS variable, c.cell_id, s.date, k.tmax AS value
FROM (SELECT DISTINCT cell_id FROM files) c CROSS JOIN span s
LEFT JOIN kept k ON k.cell_id = c.cell_id AND k.date = s.date"""),
)
def gap_fill(spark, sf_dir):
    merged = merge.merge(file_obs(spark, sf_dir).filter("variable = 'tmax'"), fill=True)
    return merged.select("variable", "cell_id", "date", "value")


def _stepped(spark, sf_dir: str, month: str, day: int, dropped: str) -> DataFrame:
    """The highest reading of each period at one date in it, with periods left out by a rule."""
    year = F.year("date")
    readings = cube.obs(spark, sf_dir).filter("variable = 'tmax'").withColumn("at", F.make_date(year, F.expr(month), F.lit(day)))
    periods = readings.groupBy("variable", "cell_id", "lat", "lon", "at").agg(F.max("value").alias("value"))
    return periods.withColumnRenamed("at", "date").filter(dropped).withColumn("src", F.lit("a"))


def _stepped_sql(unit: str, at: str, dropped: str) -> str:
    return with_cube(f"""
WITH periods AS (
  SELECT cell_id, {at} AS date, max(tmax) AS value FROM wide GROUP BY ALL),
held AS (SELECT * FROM periods WHERE {dropped}),
span AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 {unit})) AS DATE) AS date FROM held)
SELECT 'tmax' AS variable, c.cell_id, s.date, h.value
FROM (SELECT DISTINCT cell_id FROM held) c CROSS JOIN span s LEFT JOIN held h ON h.cell_id = c.cell_id AND h.date = s.date""")


@register("gap_fill_monthly", _stepped_sql(
    "MONTH", "make_date(year(date), month(date), 15)", "(year(date) * 12 + month(date) + cell_id) % 5 <> 0 AND month(date) <> 9"))
def gap_fill_monthly(spark, sf_dir):
    held = _stepped(spark, sf_dir, "month(date)", 15, "(year(date) * 12 + month(date) + cell_id) % 5 <> 0 and month(date) <> 9")
    return merge.merge(held).select("variable", "cell_id", "date", "value")


@register("gap_fill_yearly", _stepped_sql("YEAR", "make_date(year(date), 7, 1)", "(year(date) + cell_id) % 4 <> 0 AND year(date) <> 1998"))
def gap_fill_yearly(spark, sf_dir):
    held = _stepped(spark, sf_dir, "7", 1, "(year(date) + cell_id) % 4 <> 0 and year(date) <> 1998")
    return merge.merge(held).select("variable", "cell_id", "date", "value")


@register(
    "merge_mixed",
    with_cube(f"""
WITH {FILES}, long AS (
  SELECT * FROM (SELECT src, cell_id, date, unnest(['pr', 'tmax', 'tmin']) AS variable, unnest([pr, tmax, tmin]) AS v FROM files)
  WHERE NOT (variable = 'pr' AND src LIKE 'A%') AND NOT (variable = 'tmin' AND src LIKE '%O')),
kept AS (SELECT *, row_number() OVER (PARTITION BY variable, cell_id, date ORDER BY src) AS r FROM long)
SELECT variable, cell_id, date, src, v AS value FROM kept WHERE r = 1"""),
)
def merge_mixed(spark, sf_dir):
    """Files that hold different sets of variables."""
    some = file_obs(spark, sf_dir).filter(
        "not (variable = 'pr' and src like 'A%') and not (variable = 'tmin' and src like '%O')"
    )
    return merge.merge(some, fill=False).select("variable", "cell_id", "date", "src", "value")


@register(
    "detect_mode",
    with_cube("""
SELECT * FROM (VALUES
  ('by_file', 'time', (SELECT count(DISTINCT src) FROM readings), 3),
  ('by_variable', 'attribute', 3, 3),
  ('by_both', 'mixed', (SELECT count(DISTINCT src) FROM readings) + 1, 3)) t(layout, mode, files, variables)"""),
)
def detect_mode(spark, sf_dir):
    obs = file_obs(spark, sf_dir)
    extra = obs.filter("variable = 'pr'").withColumn("src", F.lit("rain"))
    layouts = {
        "by_file": obs,
        "by_variable": obs.withColumn("src", F.col("variable")),
        "by_both": obs.unionByName(extra),
    }
    rows = [
        merge.detect_mode(merge.file_variables(table)).select(
            F.lit(name).alias("layout"), "mode", "files", F.size("variables").alias("variables")
        )
        for name, table in layouts.items()
    ]
    return reduce(DataFrame.unionByName, rows)


@register(
    "variable_files",
    with_cube("""
SELECT v AS variable, src FROM (VALUES ('pr'), ('tmax'), ('tmin')) t(v), (SELECT DISTINCT src FROM readings)"""),
)
def variable_files(spark, sf_dir):
    return merge.variable_files(file_obs(spark, sf_dir))


@register(
    "dataset_profile",
    with_cube("""
SELECT 'pr,tmax,tmin' AS variables, 'mm/day,C,C' AS units, count(DISTINCT date) AS n_time, count(DISTINCT lat) AS n_lat,
       count(DISTINCT lon) AS n_lon, round(min(lat), 4) AS lat_min, round(max(lat), 4) AS lat_max,
       round(min(lon), 4) AS lon_min, round(max(lon), 4) AS lon_max, min(date) AS time_start, max(date) AS time_end,
       count(DISTINCT year(date)) AS time_years,
       printf('%.3f° x %.3f°', (max(lat) - min(lat)) / (count(DISTINCT lat) - 1),
              (max(lon) - min(lon)) / (count(DISTINCT lon) - 1)) AS spatial_resolution, 'standard' AS calendar
FROM wide JOIN grid USING (cell_id)"""),
)
def dataset_profile(spark, sf_dir):
    table = profile.dataset_profile(cube.obs(spark, sf_dir))
    return table.withColumns({c: F.concat_ws(",", c) for c in ("variables", "units")})


@register(
    "file_profile",
    rounded_sql(with_cube(f"""
WITH {FILES}, axes AS (
  SELECT (max(lat) - min(lat)) / (count(DISTINCT lat) - 1) AS lat_res, (max(lon) - min(lon)) / (count(DISTINCT lon) - 1) AS lon_res
  FROM grid)
SELECT src, 'pr,tmax,tmin' AS variables, min(lat) AS lat_min, max(lat) AS lat_max, min(lon) AS lon_min,
       max(lon) AS lon_max, min(date) AS time_start, max(date) AS time_end,
       round(date_diff('day', min(date), max(date)) / 365.25::DOUBLE, 2) AS time_years, any_value(lat_res) AS lat_res,
       any_value(lon_res) AS lon_res, printf('%.3f° x %.3f°', any_value(lat_res), any_value(lon_res)) AS spatial_resolution
FROM files JOIN grid USING (cell_id), axes GROUP BY src"""), ["lat_min", "lat_max", "lon_min", "lon_max", "lat_res", "lon_res"], 9),
)
def file_profile(spark, sf_dir):
    table = profile.file_profile(file_obs(spark, sf_dir)).drop("calendar", "error")
    return rounded(table.withColumn("variables", F.concat_ws(",", "variables")), 9)


@register(
    "compatibility_check",
    "SELECT * FROM (VALUES ('alike', true, ''), ('coarser', false, 'different resolutions')) t(files, ok, errors)",
)
def compatibility_check(spark, sf_dir):
    """All files share the grid; taking two degrees for one in the sources of flag R makes them disagree."""
    obs = file_obs(spark, sf_dir)
    wider = obs.withColumns({c: F.when(F.col("src").startswith("R"), F.col(c) * 2).otherwise(F.col(c)) for c in ("lat", "lon")})
    rows = [
        merge.check_compatibility(profile.file_profile(table)).select(
            F.lit(name).alias("files"), "ok", F.concat_ws(",", "errors").alias("errors")
        )
        for name, table in (("alike", obs), ("coarser", wider))
    ]
    return rows[0].unionByName(rows[1])


@register(
    "year_bbox_filter",
    with_cube("""
SELECT cell_id, count(*) AS days, sum(pr) AS total FROM wide JOIN grid USING (cell_id)
WHERE year(date) BETWEEN 1996 AND 1998 AND lat >= 9.8 AND lat <= 10.6 AND lon <= 101.2 GROUP BY cell_id"""),
)
def year_bbox_filter(spark, sf_dir):
    scope = Scope(1996, 1998, min_lat=9.8, max_lat=10.6, max_lon=101.2)
    obs = cube.obs(spark, sf_dir).filter("variable = 'pr'")
    return clean.apply_scope(obs, scope).groupBy("cell_id").agg(F.count("*").alias("days"), F.sum("value").alias("total"))


def delivered(spark, sf_dir: str) -> DataFrame:
    """The files' rows under foreign names and units: rain in m, mm/s or mm/day, temperatures in K or C."""
    obs = file_obs(spark, sf_dir)
    rain, flag = F.col("variable") == "pr", F.substring("src", 1, 1)
    units = (
        F.when(rain & (flag == "A"), "M").when(rain & (flag == "N"), " mm/s ").when(rain, "mm/day")
        .when(flag == "A", "Kelvin").otherwise("°C")
    )
    return obs.withColumns({"units": units, "variable": clean.lookup(F.col("variable"), SPELLING)})


@register(
    "alias_normalise",
    with_cube(f"""
WITH {FILES}
SELECT v AS variable, a AS delivered, (SELECT count(*) FROM files) AS n
FROM (VALUES ('pr', 'Precip'), ('tmax', 'TASMAX'), ('tmin', 'mn2t')) t(v, a)"""),
)
def alias_normalise(spark, sf_dir):
    table = delivered(spark, sf_dir).withColumn("delivered", F.col("variable"))
    return clean.normalise_variables(table).groupBy("variable", "delivered").agg(F.count("*").alias("n"))


@register(
    "unit_convert",
    rounded_sql(with_cube(f"""
WITH {FILES}
SELECT src, cell_id, date, 'pr' AS variable, 'mm/day' AS units,
       pr * CASE substr(src, 1, 1) WHEN 'A' THEN 1000 WHEN 'N' THEN 86400 ELSE 1 END AS value FROM files
UNION ALL
SELECT src, cell_id, date, 'tmax', 'C', CASE WHEN src LIKE 'A%' THEN tmax - 273.15::DOUBLE ELSE tmax END FROM files
UNION ALL
SELECT src, cell_id, date, 'tmin', 'C', CASE WHEN src LIKE 'A%' THEN tmin - 273.15::DOUBLE ELSE tmin END FROM files"""),
        ["value"], 7),
)
def unit_convert(spark, sf_dir):
    table = clean.convert_units(clean.normalise_variables(delivered(spark, sf_dir)))
    return rounded(table.select("src", "cell_id", "date", "variable", "units", "value"), 7)


@register(
    "variable_filter",
    with_cube(f"""
WITH {FILES} SELECT v AS variable, (SELECT count(*) FROM files) AS n FROM (VALUES ('pr'), ('tmax'), ('tmin')) t(v)"""),
)
def variable_filter(spark, sf_dir):
    """Bounds, auxiliary and unknown variables go; the three known ones stay."""
    obs = file_obs(spark, sf_dir)
    extra = [obs.filter("variable = 'pr'").withColumn("variable", F.lit(n)) for n in ("time_bnds", "height", "x_bounds", "wind")]
    table = clean.keep_allowed(clean.drop_bounds_variables(reduce(DataFrame.unionByName, extra, obs)))
    return table.groupBy("variable").agg(F.count("*").alias("n"))


# Maps ---------------------------------------------------------------------------------------------


@register(
    "map_actual_grid",
    with_cube(f"""
WITH {CELL_YEARS}
SELECT 'PRCPTOT' AS index, cell_id, round(avg(v), 2) AS value FROM years WHERE pos BETWEEN 1996 AND 2000
GROUP BY cell_id HAVING avg(v) IS NOT NULL"""),
)
def map_actual_grid(spark, sf_dir):
    return maps.actual(yearly_total(spark, sf_dir), ("cell_id",), 1996, 2000)


@register(
    "map_frequency",
    with_cube(f"""
WITH {LIKE_SQL}, {events_sql('like_', 1)}
SELECT 'SPI3_' || kind || '_Frequency' AS index, cell_id, round(sum("Frequency"), 2) AS value FROM yearly
GROUP BY kind, cell_id HAVING sum("Frequency") IS NOT NULL"""),
)
def map_frequency(spark, sf_dir):
    table = like_events(spark, sf_dir).filter(F.col("index").endswith("Frequency"))
    return maps.actual(table, ("cell_id",))


@register(
    "map_actual_area",
    with_cube(f"""
WITH {AREA_YEARS} SELECT 'SDII' AS index, area, round(avg(v), 2) AS value FROM years GROUP BY area"""),
)
def map_actual_area(spark, sf_dir):
    return maps.actual(area_yearly(spark, sf_dir), ("area",))


@register(
    "geojson_features",
    rounded_sql(with_cube(f"""
WITH {weights_sql('n_name')}, {CELL_YEARS}, m AS (SELECT cell_id, round(avg(v), 2) AS value FROM years GROUP BY 1)
SELECT area, c.cell_id, 'Feature' AS type, value, 1 AS outlines FROM cell_area c JOIN m USING (cell_id)"""), ["value"], 2),
)
def geojson_features(spark, sf_dir):
    """Map features, read back from their JSON text."""
    values = maps.actual(yearly_total(spark, sf_dir), ("cell_id",))
    rings = spatial.overlay(prepared(spark, sf_dir), layer(spark, sf_dir))
    features = sinks.cut_features(values, sinks.cell_outlines(rings), ["value"])
    schema = "type string, geometry struct<type: string, coordinates: array<array<array<double>>>>, properties struct<value: double>"
    parsed = features.select("area", "cell_id", F.from_json("feature", schema).alias("f"))
    return parsed.select(
        "area", "cell_id", "f.type", "f.properties.value", F.size("f.geometry.coordinates").alias("outlines")
    )


@register(
    "boundary_export",
    with_cube(f"""
WITH {LAYER}
SELECT DISTINCT n_name AS area, 'Feature' AS type, 5 AS vertices FROM layer"""),
)
def boundary_export(spark, sf_dir):
    features = sinks.boundary_features(layer(spark, sf_dir))
    schema = "type string, geometry struct<coordinates: array<array<array<double>>>>"
    parsed = features.select("area", F.from_json("feature", schema).alias("f"))
    return parsed.select("area", "f.type", F.size(F.get("f.geometry.coordinates", F.lit(0))).alias("vertices"))


@register("distinct_areas", "SELECT r_name AS area FROM region")
def distinct_areas(spark, sf_dir):
    return areas.distinct_areas(layer(spark, sf_dir, "region"))


@register(
    "skip_present",
    "SELECT n_name AS area, 'PRCPTOT' AS index FROM nation WHERE n_regionkey <> 1",
)
def skip_present(spark, sf_dir):
    """Of a map per nation, those of region 1 exist already."""
    nations = cube.table(spark, sf_dir, "nation").select(F.col("n_name").alias("area"), "n_regionkey", F.lit("PRCPTOT").alias("index"))
    existing = nations.filter("n_regionkey = 1")
    return sinks.not_yet_present(nations, existing, ["area", "index"]).select("area", "index")


# Series -------------------------------------------------------------------------------------------


@register(
    "yearly_series",
    with_cube(f"""
WITH {AREA_YEARS} SELECT 'SDII' AS index, area, pos AS year, round(v, 2) AS value FROM years WHERE v IS NOT NULL"""),
)
def yearly_series(spark, sf_dir):
    return series.yearly_series(area_yearly(spark, sf_dir)).withColumn("year", F.col("year").cast("long"))


def monthly_totals(spark, sf_dir) -> DataFrame:
    return runner.raw_values(cube.obs(spark, sf_dir), "pr", "MS")


MONTHS_SQL = f"""
monthly AS (SELECT cell_id, {first_day('MS')} AS period, sum(pr) AS v FROM wide GROUP BY 1, 2)"""


@register(
    "monthly_series_of_cells",
    rounded_sql(with_cube(f"""
WITH {MONTHS_SQL}
SELECT 'pr' AS index, year(period) AS year, month(period) AS month, avg(v) AS value FROM monthly GROUP BY period"""), ["value"], 2),
)
def monthly_series_of_cells(spark, sf_dir):
    return series.monthly_series_of_cells(monthly_totals(spark, sf_dir))


@register(
    "yearly_series_of_cells",
    rounded_sql(with_cube(f"""
WITH {MONTHS_SQL}, per_cell AS (SELECT cell_id, year(period) AS year, avg(v) AS v FROM monthly GROUP BY 1, 2)
SELECT 'pr' AS index, year, avg(v) AS value FROM per_cell GROUP BY year"""), ["value"], 2),
)
def yearly_series_of_cells(spark, sf_dir):
    return series.yearly_series_of_cells(monthly_totals(spark, sf_dir))


@register(
    "moving_average",
    rounded_sql(with_cube(f"""
WITH {AREA_YEARS}, r AS (SELECT area, pos AS year, round(v, 2) AS annual FROM years)
SELECT 'SDII' AS index, area, year, annual, avg(annual) OVER (
  PARTITION BY area ORDER BY year ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS year_avg FROM r"""), ["year_avg"]),
)
def moving_average(spark, sf_dir):
    yearly = series.yearly_series(area_yearly(spark, sf_dir)).withColumn("year", F.col("year").cast("long"))
    return rounded(series.moving_average(yearly, window=5))


AREA_MONTHS = f"""{weights_sql('r_name')}, {MONTHS_SQL},
area_months AS (
  SELECT area, period, sum(v * weight) / sum(weight) AS v FROM monthly JOIN cell_area USING (cell_id) GROUP BY 1, 2)"""


def area_monthly(spark, sf_dir) -> DataFrame:
    return spatial.area_mean(monthly_totals(spark, sf_dir), weights(spark, sf_dir, "region"))


@register(
    "monthly_climatology",
    rounded_sql(with_cube(f"""
WITH {AREA_MONTHS}
SELECT 'pr' AS index, area, month(period) AS month, avg(round(v, 2)) AS value FROM area_months
WHERE year(period) BETWEEN 1996 AND 2000 GROUP BY 2, 3"""), ["value"], 4),
)
def monthly_climatology(spark, sf_dir):
    monthly = series.monthly_series(area_monthly(spark, sf_dir))
    return rounded(series.monthly_climatology(monthly, start_year=1996, end_year=2000), 4)


# Legends ------------------------------------------------------------------------------------------

TICKS = """
steps AS (
  SELECT *, (hi - lo) / 9 AS raw, floor(log10((hi - lo) / 9)) AS pw FROM ranges WHERE lo < hi),
scaled AS (
  SELECT *, pow(10, pw) * CASE WHEN raw / pow(10, pw) >= sqrt(50) THEN 10 WHEN raw / pow(10, pw) >= sqrt(10) THEN 5
    WHEN raw / pow(10, pw) >= sqrt(2) THEN 2 ELSE 1 END AS step FROM steps)"""


@register(
    "legend_breaks",
    rounded_sql(with_cube(f"""
WITH {CELL_YEARS}, mapped AS (SELECT cell_id, round(avg(v), 2) AS value FROM years GROUP BY 1),
ranges AS (SELECT quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM mapped), {TICKS}
SELECT 'PRCPTOT' AS index, lo AS low, hi AS high, unnest(generate_series(CAST(ceil(lo / step) AS BIGINT),
       CAST(floor(hi / step) AS BIGINT))) * step AS tick FROM scaled"""), ["low", "high", "tick"]),
)
def legend_breaks(spark, sf_dir):
    table = legend.legend_breaks(maps.actual(yearly_total(spark, sf_dir), ("cell_id",)), "value")
    return rounded(table.select("index", "low", "high", F.explode("breaks").alias("tick")))


@register(
    "legend_range_selected",
    rounded_sql(with_cube("""
SELECT v AS variable, quantile_cont(value, 0.02) AS low, quantile_cont(value, 0.98) AS high FROM (
  SELECT unnest(['pr', 'tmax', 'tmin']) AS v, unnest([pr, tmax, tmin]) AS value FROM wide) WHERE value IS NOT NULL GROUP BY v"""),
        ["low", "high"], 9),
)
def legend_range_selected(spark, sf_dir):
    """Colour ranges of all daily values, by selecting ranks instead of gathering histograms."""
    return rounded(legend.colour_range(cube.obs(spark, sf_dir), "value", ("variable",), largest=0), 9)


@register(
    "legend_breaks_trend",
    rounded_sql(with_cube(f"""
WITH {CELL_YEARS}, {trend_sql('years', 'cell_id')}, mapped AS (SELECT round(slope, 2) AS slope FROM trends),
q AS (SELECT greatest(abs(quantile_cont(slope, 0.02)), abs(quantile_cont(slope, 0.98))) AS reach FROM mapped),
ranges AS (SELECT -reach AS lo, reach AS hi FROM q), {TICKS}
SELECT 'PRCPTOT' AS index, lo AS low, hi AS high, unnest(generate_series(CAST(ceil(lo / step) AS BIGINT),
       CAST(floor(hi / step) AS BIGINT))) * step AS tick FROM scaled"""), ["low", "high", "tick"]),
)
def legend_breaks_trend(spark, sf_dir):
    table = legend.legend_breaks(maps.trend(yearly_total(spark, sf_dir), ("cell_id",)), "slope", symmetric=True)
    return rounded(table.select("index", "low", "high", F.explode("breaks").alias("tick")))


@register(
    "legend_class",
    with_cube(f"""
WITH {CELL_YEARS}, mapped AS (SELECT cell_id, round(avg(v), 2) AS value FROM years GROUP BY 1),
ranges AS (SELECT quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM mapped), {TICKS},
bounds AS (SELECT step, ceil(lo / step) AS first_, floor(hi / step) AS last_ FROM scaled)
SELECT 'PRCPTOT' AS index, cell_id, value, CAST((
  SELECT count(*) FROM (SELECT unnest(generate_series(CAST(first_ AS BIGINT) + 1, CAST(last_ AS BIGINT) - 1)) * step AS b FROM bounds)
  WHERE b <= value) AS INT) AS class
FROM mapped"""),
)
def legend_class(spark, sf_dir):
    mapped = maps.actual(yearly_total(spark, sf_dir), ("cell_id",))
    breaks = legend.legend_breaks(mapped, "value").select("index", "breaks")
    return mapped.join(breaks, "index").select(
        "index", "cell_id", "value", legend.legend_class(F.col("value"), F.col("breaks")).alias("class")
    )


@register(
    "symmetric_axis",
    rounded_sql(with_cube(f"""
WITH {LIKE_SQL}, clim AS (SELECT cell_id, month(period) AS month, avg(v) AS v FROM like_ GROUP BY 1, 2),
lim AS (SELECT cell_id, CASE WHEN max(abs(coalesce(v, 0))) = 0 THEN 1 ELSE 1.1::DOUBLE * max(abs(coalesce(v, 0))) END AS m FROM clim GROUP BY 1)
SELECT 'SPI3' AS index, cell_id, m AS top, -m / 2 AS second FROM lim"""), ["top", "second"]),
)
def symmetric_axis(spark, sf_dir):
    monthly = spi_like(spark, sf_dir).withColumn("month", F.month("period")).groupBy("index", "cell_id", "month").agg(F.avg("value").alias("value"))
    axis = legend.symmetric_axis(monthly, ("index", "cell_id"))
    return rounded(axis.select(
        "index", "cell_id", F.get("ticks", F.lit(4)).alias("top"), F.get("ticks", F.lit(1)).alias("second")
    ))


# Runner -------------------------------------------------------------------------------------------


@register(
    "index_run",
    rounded_sql(with_cube(f"""
WITH base AS (
  SELECT cell_id, {first_day('YS')} AS period, unnest(['PRCPTOT', 'Rx1day', 'R10mm', 'pr']) AS index,
         unnest(['mm', 'mm/day', 'days', 'mm/day']) AS units,
         unnest([coalesce(sum(pr) FILTER (pr >= 1), 0), max(pr), CAST(count(*) FILTER (pr >= 10) AS DOUBLE), sum(pr)]) AS value
  FROM wide GROUP BY 1, 2)
SELECT index, 'YS' AS freq, period, cell_id, value, units FROM base"""), ["value"]),
)
def index_run(spark, sf_dir):
    return rounded(runner.compute_indices(cube.obs(spark, sf_dir), ["PRCPTOT", "Rx1day", "R10mm", "pr"], ("YS",)))


@register(
    "catalogue_order",
    with_cube(f"""
WITH {LIKE_SQL}, found AS (SELECT 'SPI3' AS index, count(*) AS cells FROM grid UNION ALL SELECT 'CDD', count(*) FROM grid
  UNION ALL SELECT 'other', count(*) FROM grid)
SELECT index, cells, CASE index WHEN 'SPI3' THEN 0 WHEN 'CDD' THEN 10 ELSE 999 END AS position FROM found"""),
)
def catalogue_order(spark, sf_dir):
    cells = cube.grid(spark, sf_dir).select(F.explode(F.array(F.lit("SPI3"), F.lit("CDD"), F.lit("other"))).alias("index"))
    counted = cells.groupBy("index").agg(F.count("*").alias("cells"))
    return model.in_display_order(counted, spark)


@register(
    "data_span",
    with_cube("""
SELECT 'PRCPTOT' AS index, CAST(date_trunc('year', min(date)) AS DATE) AS start_date,
       CAST(date_trunc('year', max(date)) AS DATE) AS end_date, year(min(date)) AS first_year, year(max(date)) AS last_year
FROM wide"""),
)
def data_span(spark, sf_dir):
    return maps.span(yearly_total(spark, sf_dir)).withColumns(
        {c: F.col(c).cast("long") for c in ("first_year", "last_year")}
    )


@register(
    "display_names",
    """
SELECT n_name AS variable, CASE n_nationkey % 3 WHEN 0 THEN lower(n_name) WHEN 1 THEN r_name ELSE n_name END AS name,
       CASE WHEN n_nationkey % 2 = 0 THEN 'mm' ELSE 'unknown' END AS units
FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def display_names(spark, sf_dir):
    """Nations stand in for variables: some have a standard name, some only a long one, some neither."""
    nations = cube.table(spark, sf_dir, "nation").join(
        cube.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    kind = F.col("n_nationkey") % 3
    attributes = nations.select(
        F.col("n_name").alias("variable"),
        F.when(kind == 0, F.lower("n_name")).when(kind == 1, F.lit(" Unspecified ")).alias("standard_name"),
        F.when(kind == 2, F.lit("N/A")).otherwise(F.col("r_name")).alias("long_name"),
        F.when(F.col("n_nationkey") % 2 == 0, "mm").alias("units"),
    )
    return profile.describe_variables(attributes)


@register(
    "resolution_text",
    """
SELECT n_name AS src, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_nationkey / 8.0::DOUBLE END AS resolution FROM nation""",
)
def resolution_text(spark, sf_dir):
    key = F.col("n_nationkey")
    text = F.when(key % 4 == 0, "coarse").otherwise(F.concat((key / 8).cast("string"), F.lit(" degrees")))
    return cube.table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("src"), profile.number_in(text).alias("resolution")
    )


@register(
    "clamp_years",
    with_cube("""
SELECT n_name AS request, greatest(1990 + n_nationkey % 9, f) AS start_year,
       least(1999 + n_nationkey % 7, l) AS end_year
FROM nation, (SELECT year(min(date)) AS f, year(max(date)) AS l FROM wide)"""),
)
def clamp_years(spark, sf_dir):
    """Requested years moved into the years of the data."""
    first, last = (F.lit(day.year) for day in cube.calendar_bounds(spark, sf_dir))
    key = F.col("n_nationkey")
    start, end = clean.clamp_years(1990 + key % 9, 1999 + key % 7, first, last)
    return cube.table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("request"), start.cast("long").alias("start_year"), end.cast("long").alias("end_year")
    )


@register(
    "dashboard_months",
    with_cube(f"""
WITH {LIKE_SQL}, known AS (
  SELECT cell_id, period, v, CASE WHEN v < -1 THEN -1 WHEN v > 1 THEN 1 ELSE 0 END AS side FROM like_ WHERE v IS NOT NULL),
runs AS (
  SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY period)
          - row_number() OVER (PARTITION BY cell_id, side ORDER BY period) AS run FROM known),
labelled AS (
  SELECT cell_id, period, v AS value, CASE WHEN count(*) OVER (PARTITION BY cell_id, side, run) < 2 THEN 'neutral'
  WHEN side = -1 THEN 'drought' WHEN side = 1 THEN 'wet' ELSE 'neutral' END AS label FROM runs)
SELECT 'SPI3' AS index, 'cell 3' AS area, period, label FROM labelled
WHERE cell_id = 3 AND year(period) BETWEEN 1997 AND 1999"""),
)
def dashboard_months(spark, sf_dir):
    table = spi_like(spark, sf_dir).select(
        "index", F.lit("MS").alias("freq"), "period", F.concat(F.lit("cell "), F.col("cell_id").cast("string")).alias("area"), "value"
    )
    return jobs.dashboard(table, "SPI3", "cell 3", 1997, 1999)["months"].select("index", "area", "period", "label")


# Attributes of files -------------------------------------------------------------------------------

def attribute_table(spark, sf_dir: str):
    """What sidecars of the files would say: calendars by return flag, resolutions as text or as a transform."""
    sources = cube.table(spark, sf_dir, "lineitem").select(F.concat_ws("_", "l_returnflag", "l_linestatus").alias("src")).distinct()
    flag = F.substring("src", 1, 1)
    return sources.select(
        "src", F.when(flag == "R", "noleap").otherwise("standard").alias("calendar"),
        F.when(flag == "A", "0.5 degrees").alias("lat_text"), F.when(flag == "A", "2.5e-1°").alias("lon_text"),
        F.when(flag == "N", F.array(*map(F.lit, (0.75, 0.0, 99.5, 0.0, -1.5, 11.5)))).alias("transform"))


@register(
    "file_attributes",
    rounded_sql(with_cube(f"""
WITH {FILES}, axes AS (
  SELECT (max(lat) - min(lat)) / (count(DISTINCT lat) - 1) AS lat_res, (max(lon) - min(lon)) / (count(DISTINCT lon) - 1) AS lon_res
  FROM grid),
sources AS (SELECT DISTINCT src FROM files)
SELECT src, CASE substr(src, 1, 1) WHEN 'R' THEN 'noleap' ELSE 'standard' END AS calendar,
       CASE substr(src, 1, 1) WHEN 'N' THEN 1.5::DOUBLE WHEN 'A' THEN 0.5::DOUBLE ELSE lat_res END AS lat_res,
       CASE substr(src, 1, 1) WHEN 'N' THEN 0.75::DOUBLE WHEN 'A' THEN 0.25::DOUBLE ELSE lon_res END AS lon_res, NULL AS error
FROM sources, axes
UNION ALL SELECT 'broken', NULL, NULL, NULL, 'no row could be read'"""), ["lat_res", "lon_res"], 9),
)
def file_attributes(spark, sf_dir):
    """Calendars and resolutions as files state them - transform, then text, then spacing - and a file without rows."""
    known = attribute_table(spark, sf_dir)
    listed = known.select("src").unionByName(spark.range(1).select(F.lit("broken").alias("src")))
    table = profile.file_profile(file_obs(spark, sf_dir), known, listed=listed)
    return rounded(table.select("src", "calendar", "lat_res", "lon_res", "error"), 9)


@register(
    "compatibility_of_files",
    with_cube(f"""
WITH {FILES}, sources AS (
  SELECT DISTINCT src, CASE substr(src, 1, 1) WHEN 'R' THEN 'noleap' ELSE 'standard' END AS calendar,
         CASE substr(src, 1, 1) WHEN 'N' THEN 1.5 WHEN 'A' THEN 0.5 ELSE 1.0 END AS step FROM files),
verdicts AS (
  SELECT 'plain' AS layout, CASE WHEN count(*) = 0 THEN 'no files' END AS error FROM sources
  UNION ALL SELECT 'calendars', CASE WHEN count(DISTINCT calendar) > 1 THEN 'different calendars' END FROM sources
  UNION ALL SELECT 'resolutions', CASE WHEN count(DISTINCT step) > 1 THEN 'different resolutions' END FROM sources
  UNION ALL SELECT 'unreadable', CASE WHEN count(*) < (SELECT count(*) + 1 FROM sources) THEN 'unreadable file' END FROM sources)
SELECT layout, error IS NULL AS ok, coalesce(error, '') AS errors FROM verdicts"""),
)
def compatibility_of_files(spark, sf_dir):
    """Each reason why files cannot be merged, from their attributes and the list of files."""
    obs, known = file_obs(spark, sf_dir), attribute_table(spark, sf_dir)
    none = {c: F.lit(None).cast(t) for c, t in known.dtypes if c in ("lat_text", "lon_text", "transform")}
    listed = known.select("src").unionByName(spark.range(1).select(F.lit("broken").alias("src")))
    layouts = {
        "plain": profile.file_profile(obs),
        "calendars": profile.file_profile(obs, known.withColumns(none)),
        "resolutions": profile.file_profile(obs, known.withColumn("calendar", F.lit("standard"))),
        "unreadable": profile.file_profile(obs, listed=listed),
    }
    rows = [
        merge.check_compatibility(table).select(F.lit(name).alias("layout"), "ok", F.concat_ws(",", "errors").alias("errors"))
        for name, table in layouts.items()
    ]
    return reduce(DataFrame.unionByName, rows)


@register(
    "dataset_names",
    with_cube("""
SELECT unnest(['pr', 'tmax', 'tmin']) AS variable, unnest(['precipitation_flux', 'Highest of the day', 'tmin']) AS name, count(DISTINCT date) AS n_time
FROM wide"""),
)
def dataset_names(spark, sf_dir):
    """The dataset's profile with names: standard name, else long name, else the variable itself."""
    described = spark.createDataFrame(
        [("pr", "precipitation_flux", "Rain", "mm/day"), ("tmax", "unknown", "Highest of the day", "C"), ("tmin", " ", None, None)],
        "variable string, standard_name string, long_name string, units string")
    table = profile.dataset_profile(cube.obs(spark, sf_dir), described=described)
    return table.select(F.explode(F.arrays_zip("variables", "names")).alias("v"), "n_time").select(
        F.col("v.variables").alias("variable"), F.col("v.names").alias("name"), "n_time")
