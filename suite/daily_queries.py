"""Daily indices (yearly and monthly), resampling, percentile climatology."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from isohyet.model import INDICES, Baseline
from isohyet.operators import daily, thresholds
from suite import cube
from suite.registry import first_day, period_days, register, rounded, with_cube

# Rain is known on every day, so its queries use the strict missing rule; temperatures are unknown on days
# without a reading and their queries skip them.
RULE = {"pr": "any", "tmax": "skip", "tmin": "skip"}

SIMPLE = {
    "SDII": "sum(v) FILTER (v >= 1) / nullif(count(*) FILTER (v >= 1), 0)",
    "Rx1day": "max(v)",
    "R10mm": "CAST(count(*) FILTER (v >= 10) AS DOUBLE)",
    "R20mm": "CAST(count(*) FILTER (v >= 20) AS DOUBLE)",
    "PRCPTOT": "coalesce(sum(v) FILTER (v >= 1), 0)",
    "TXx": "max(v)",
    "TXn": "min(v)",
    "TNx": "max(v)",
    "TNn": "min(v)",
    "FD": "CAST(count(*) FILTER (v < 0) AS DOUBLE)",
    "SU": "CAST(count(*) FILTER (v > 25) AS DOUBLE)",
    "ID": "CAST(count(*) FILTER (v < 0) AS DOUBLE)",
    "TR": "CAST(count(*) FILTER (v > 20) AS DOUBLE)",
    "R95p": "CAST(count(*) FILTER (v > greatest(coalesce(q95, 1), 1)) AS DOUBLE)",
    "R99p": "CAST(count(*) FILTER (v > greatest(coalesce(q99, 1), 1)) AS DOUBLE)",
    "R95pTOT": "coalesce(sum(v) FILTER (v > greatest(coalesce(q95, 1), 1)), 0) / nullif(sum(v) FILTER (v > 1), 0)",
    "R99pTOT": "coalesce(sum(v) FILTER (v > greatest(coalesce(q99, 1), 1)), 0) / nullif(sum(v) FILTER (v > 1), 0)",
    "TN10p": "CAST(count(*) FILTER (v < q10) AS DOUBLE)",
    "TX10p": "CAST(count(*) FILTER (v < q10) AS DOUBLE)",
    "TN90p": "CAST(count(*) FILTER (v > q90) AS DOUBLE)",
    "TX90p": "CAST(count(*) FILTER (v > q90) AS DOUBLE)",
}
SPELLS = {
    "CDD": ("v < 1", "coalesce(max(len), 0)"),
    "CWD": ("v >= 1", "coalesce(max(len), 0)"),
    "WSDI": ("v > q90", "coalesce(sum(len) FILTER (len >= 6), 0)"),
    "CSDI": ("v < q10", "coalesce(sum(len) FILTER (len >= 6), 0)"),
}


def thresholds_sql(q: float, wet_only: bool, start: int | None = None, end: int | None = None) -> str:
    """CTEs ending in thr(cell_id, doy, q), from a CTE s(cell_id, date, v)."""
    base = "s" if start is None else f"(SELECT * FROM s WHERE year(date) BETWEEN {start} AND {end})"
    wet = "AND v >= 1" if wet_only else ""
    return f"""
base AS (SELECT * FROM {base} b),
span AS (SELECT min(date) AS lo, max(date) AS hi FROM base),
pool AS (
  SELECT cell_id, dayofyear(date + o) AS doy, v
  FROM base, (VALUES (-2), (-1), (0), (1), (2)) t(o), span
  WHERE v IS NOT NULL {wet} AND date + o BETWEEN lo AND hi),
ranked AS (
  SELECT cell_id, doy, v, row_number() OVER (PARTITION BY cell_id, doy ORDER BY v) - 1 AS r,
         count(*) OVER (PARTITION BY cell_id, doy) AS n
  FROM pool WHERE doy <= 365),
place AS (
  SELECT *, least(greatest(n * {q}::DOUBLE + {(1.0 + q) / 3.0!r}::DOUBLE - 1.0::DOUBLE, 0), n - 1) AS h FROM ranked),
quant AS (
  SELECT cell_id, doy,
         max(v) FILTER (r = floor(h)) AS lo_v, max(v) FILTER (r = least(floor(h) + 1, n - 1)) AS hi_v, max(h) AS h
  FROM place GROUP BY cell_id, doy),
known AS (SELECT cell_id, doy, lo_v + (hi_v - lo_v) * (h - floor(h)) AS q FROM quant),
every_day AS (
  SELECT c.cell_id, CAST(d AS BIGINT) AS doy, k.q,
         last_value(k.doy IGNORE NULLS) OVER before AS doy0, last_value(k.q IGNORE NULLS) OVER before AS q0,
         first_value(k.doy IGNORE NULLS) OVER behind AS doy1, first_value(k.q IGNORE NULLS) OVER behind AS q1
  FROM (SELECT DISTINCT cell_id FROM s) c CROSS JOIN generate_series(1, 365) g(d)
  LEFT JOIN known k ON k.cell_id = c.cell_id AND k.doy = d
  WINDOW before AS (PARTITION BY c.cell_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         behind AS (PARTITION BY c.cell_id ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (
  SELECT cell_id, doy, coalesce(q, q0 + (q1 - q0) * ((doy - doy0) / (doy1 - doy0)::DOUBLE)) AS q FROM every_day),
stretched AS (
  SELECT CAST(d AS BIGINT) AS doy, (d - 1.0::DOUBLE) * 364.0::DOUBLE / 365 AS x FROM generate_series(1, 366) g(d)),
thr AS (
  SELECT a.cell_id, s.doy,
         CASE WHEN x = floor(x) THEN a.q ELSE a.q + (b.q - a.q) * (x - floor(x)) END AS q
  FROM stretched s JOIN filled a ON a.doy = floor(x) + 1
  JOIN filled b ON b.cell_id = a.cell_id AND b.doy = least(floor(x) + 2, 365))"""


def series_sql(variable: str) -> str:
    return f"s AS (SELECT cell_id, date, {variable} AS v FROM wide)"


# A month's running mean, so that warm and cold days come in spells, shifted so that it passes through zero.
MONTH_AROUND = 15
PERSISTENT = "avg({0}) OVER (PARTITION BY cell_id ORDER BY date ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) - 30.0"


def persistent_sql(variable: str) -> str:
    return f"s AS (SELECT cell_id, date, {PERSISTENT.format(variable)} AS v FROM wide)"


def persistent(spark, sf_dir, variable: str):
    around = Window.partitionBy("cell_id").orderBy("date").rowsBetween(-MONTH_AROUND, MONTH_AROUND)
    series = cube.series(spark, sf_dir, variable)
    return series.select("cell_id", "date", (F.avg("value").over(around) - 30.0).alias("value"))


def index_sql(index: str, freq: str, start: int | None = None, end: int | None = None, source: str | None = None) -> str:
    variable = INDICES[index][0]
    q = daily.QUANTILES.get(index)
    ctes = source or series_sql(variable)
    days = "SELECT *, " + first_day(freq) + " AS period FROM s"
    if q is not None:
        ctes += "," + thresholds_sql(q, variable == "pr", start, end)
        days = (
            f"SELECT s.*, thr.q AS {thresholds.threshold_column(q)}, {first_day(freq, 's.date')} AS period "
            "FROM s LEFT JOIN thr ON thr.cell_id = s.cell_id AND thr.doy = dayofyear(s.date)"
        )
    ok = f"count(v) = {period_days(freq)}" if RULE[variable] == "any" else "count(v) > 0"
    if index in SPELLS:
        condition, combine = SPELLS[index]
        body = f"""
WITH {ctes}, d AS ({days}),
hit AS (
  SELECT cell_id, period, date - CAST(row_number() OVER (PARTITION BY cell_id, period ORDER BY date) AS INT) AS run
  FROM d WHERE {condition}),
runs AS (SELECT cell_id, period, count(*) AS len FROM hit GROUP BY cell_id, period, run),
best AS (SELECT cell_id, period, CAST({combine} AS DOUBLE) AS best FROM runs GROUP BY cell_id, period),
checked AS (SELECT cell_id, period, {ok} AS ok FROM d GROUP BY cell_id, period)
SELECT cell_id, period, CASE WHEN ok THEN coalesce(best, 0) END AS {index}
FROM checked LEFT JOIN best USING (cell_id, period)"""
    elif index == "Rx5day":
        body = f"""
WITH {ctes}, d AS ({days}),
five AS (
  SELECT cell_id, period, v, CASE WHEN count(v) OVER w = 5 THEN sum(v) OVER w END AS s5 FROM d
  WINDOW w AS (PARTITION BY cell_id ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT cell_id, period, CASE WHEN {ok} THEN max(s5) END AS {index} FROM five GROUP BY cell_id, period"""
    else:
        body = f"""
WITH {ctes}, d AS ({days})
SELECT cell_id, period, CASE WHEN {ok} THEN {SIMPLE[index]} END AS {index} FROM d GROUP BY cell_id, period"""
    return with_cube(body.replace(f"AS {index} ", f'AS "{index}" '))


def rounded_sql(sql: str, columns: list[str], digits: int = 6) -> str:
    """Wrap a statement, rounding the named columns."""
    replaced = ", ".join(f'round("{c}", {digits}) AS "{c}"' for c in columns)
    return f"SELECT * REPLACE ({replaced}) FROM ({sql})"


def _register_index(index: str, freq: str) -> None:
    variable = INDICES[index][0]
    name = index.lower() + ("" if freq == "YS" else "_monthly")

    @register(name, rounded_sql(index_sql(index, freq), [index]))
    def query(spark, sf_dir):
        table = daily.daily_indices(
            cube.series(spark, sf_dir, variable), [index], freq, missing=RULE[variable],
            record=cube.calendar_bounds(spark, sf_dir) if index in daily.QUANTILES else None,
        )
        return rounded(table)


for _index in INDICES:
    _register_index(_index, "YS")
for _index in ("PRCPTOT", "Rx5day", "CDD", "R95pTOT", "TX90p", "WSDI"):
    _register_index(_index, "MS")


@register("r95p_baseline", rounded_sql(index_sql("R95p", "YS", 1996, 1999), ["R95p"]))
def r95p_baseline(spark, sf_dir):
    series = cube.series(spark, sf_dir, "pr")
    return rounded(daily.daily_indices(series, ["R95p"], "YS", Baseline(1996, 1999)))


def _register_baseline(index: str) -> None:
    """Thresholds from part of the record, so that the rest can go beyond them."""
    @register(f"{index.lower()}_baseline", rounded_sql(index_sql(index, "YS", 1996, 1999), [index]))
    def query(spark, sf_dir):
        return rounded(daily.daily_indices(cube.series(spark, sf_dir, "pr"), [index], "YS", Baseline(1996, 1999)))


def _register_persistent(index: str, freq: str) -> None:
    variable = INDICES[index][0]
    name = f"{index.lower()}_persistent" + ("" if freq == "YS" else "_monthly")

    @register(name, rounded_sql(index_sql(index, freq, source=persistent_sql(variable)), [index]))
    def query(spark, sf_dir):
        table = daily.daily_indices(
            persistent(spark, sf_dir, variable), [index], freq, missing="skip",
            record=cube.calendar_bounds(spark, sf_dir) if index in daily.QUANTILES else None,
        )
        return rounded(table)


for _index in ("R99p", "R99pTOT"):
    _register_baseline(_index)
for _index in ("ID", "FD", "WSDI", "CSDI"):
    _register_persistent(_index, "YS")
_register_persistent("WSDI", "MS")


RAIN_FAMILY = ["PRCPTOT", "Rx5day", "CDD", "R95p"]


@register(
    "index_values_years_and_months",
    rounded_sql(" UNION ALL ".join(
        f"""SELECT '{i}' AS index, '{f}' AS freq, period, cell_id, "{i}" AS value, '{INDICES[i][1]}' AS units
        FROM ({index_sql(i, f)})"""
        for i in RAIN_FAMILY for f in ("YS", "MS")
    ), ["value"]),
)
def index_values_years_and_months(spark, sf_dir):
    """A family of indices for both frequencies, in one pass over the days."""
    bounds = cube.calendar_bounds(spark, sf_dir)
    return rounded(daily.daily_index_values(cube.series(spark, sf_dir, "pr"), RAIN_FAMILY, record=bounds))


@register(
    "missing_rules",
    with_cube(f"""
SELECT cell_id, {first_day('MS')} AS period, max(tmax) AS skip_value,
       CASE WHEN count(tmax) = {period_days('MS', first_day('MS'))} THEN max(tmax) END AS any_value,
       CASE WHEN count(tmax) > 0 AND count(*) - count(tmax) < 0.1::DOUBLE * count(*) THEN max(tmax) END AS share_value
FROM wide GROUP BY 1, 2"""),
)
def missing_rules(spark, sf_dir):
    series = cube.series(spark, sf_dir, "tmax")
    tables = [
        daily.daily_indices(series, ["TXx"], "MS", missing=rule).withColumnRenamed("TXx", f"{name}_value")
        for name, rule in (("skip", "skip"), ("any", "any"), ("share", 0.1))
    ]
    keys = ["cell_id", "period"]
    return tables[0].join(tables[1], keys).join(tables[2], keys)


def _resample_sql(freq: str) -> str:
    return with_cube(f"""
SELECT variable, cell_id, {first_day(freq)} AS period,
       CASE WHEN variable = 'pr' THEN sum(v) ELSE avg(v) END AS value
FROM (SELECT cell_id, date, unnest(['pr', 'tmax', 'tmin']) AS variable, unnest([pr, tmax, tmin]) AS v FROM wide)
GROUP BY 1, 2, 3""")


def _resampled(spark, sf_dir, freq):
    from functools import reduce

    from pyspark.sql import DataFrame
    from pyspark.sql import functions as F

    tables = [
        daily.resample(cube.series(spark, sf_dir, v), v, freq).withColumn("variable", F.lit(v))
        for v in ("pr", "tmax", "tmin")
    ]
    return reduce(DataFrame.unionByName, tables).select("variable", "cell_id", "period", "value")


@register("annual_resample", _resample_sql("YS"))
def annual_resample(spark, sf_dir):
    return _resampled(spark, sf_dir, "YS")


@register("monthly_resample", _resample_sql("MS"))
def monthly_resample(spark, sf_dir):
    return _resampled(spark, sf_dir, "MS")


def _doy_sql(variable: str, q: float) -> str:
    return rounded_sql(with_cube(f"""
WITH {series_sql(variable)}, {thresholds_sql(q, variable == 'pr')}
SELECT '{variable}' AS variable, cell_id, doy, {q}::DOUBLE AS q, q AS value FROM thr"""), ["value"])


def _doy(spark, sf_dir, variable, q):
    series = cube.series(spark, sf_dir, variable)
    bounds = cube.calendar_bounds(spark, sf_dir)
    table = thresholds.doy_thresholds(series, [q], wet_only=variable == "pr", record=bounds)
    out = thresholds.threshold_table(table, variable)
    return rounded(out.withColumn("doy", out.doy.cast("long")))


@register("doy_percentiles", _doy_sql("tmax", 0.9))
def doy_percentiles(spark, sf_dir):
    return _doy(spark, sf_dir, "tmax", 0.9)


@register("doy_percentiles_wet", _doy_sql("pr", 0.95))
def doy_percentiles_wet(spark, sf_dir):
    return _doy(spark, sf_dir, "pr", 0.95)
