"""SPI, drought and flood events, trends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.functions import special
from isohyet.functions.calendar import period_start
from isohyet.model import SPI_WINDOWS
from isohyet.operators import daily, events, maps, spatial, spi, trend
from suite import cube
from suite.daily_queries import rounded_sql
from suite.registry import first_day, period_days, register, rounded, with_cube
from suite.spatial_queries import PRCPTOT_SQL, weights, weights_sql, yearly_total


def _poly_sql(coefficients: list[float], x: str) -> str:
    text = f"{coefficients[-1]!r}::DOUBLE"
    for c in reversed(coefficients[:-1]):
        text = f"({text} * {x} + {c!r}::DOUBLE)"
    return text


def _ratio_sql(pair, x: str) -> str:
    return f"({_poly_sql(pair[0], x)} / {_poly_sql(pair[1], x)})"


def spi_sql(window: int, source: str = "wide") -> str:
    """CTEs ending in spi(cell_id, period, v); sums of the gamma series term by term with lgamma."""
    z = "(a + 20)"
    psi = (
        f"(ln({z}) - 0.5 / {z} - 1 / (12 * {z} ** 2) + 1 / (120 * {z} ** 4) - 1 / (252 * {z} ** 6)"
        f" - list_sum(list_transform(range(20), lambda j: 1 / (a + j))))"
    )
    psi1 = (
        f"(1 / {z} + 0.5 / {z} ** 2 + 1 / (6 * {z} ** 3) - 1 / (30 * {z} ** 5) + 1 / (42 * {z} ** 7)"
        f" + list_sum(list_transform(range(20), lambda j: 1 / (a + j) ** 2)))"
    )
    return f"""
mon AS (
  SELECT cell_id, {first_day('MS')} AS period,
         CASE WHEN count(pr) = {period_days('MS', first_day('MS'))} THEN avg(pr) END AS v
  FROM {source} GROUP BY 1, 2),
smooth AS (
  SELECT cell_id, period, CASE WHEN count(v) OVER w = {window} THEN avg(v) OVER w END AS x FROM mon
  WINDOW w AS (PARTITION BY cell_id ORDER BY period ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)),
fits AS (
  SELECT cell_id, month(period) AS month, avg(x) FILTER (x > 0) AS m,
         ln(avg(x) FILTER (x > 0)) - avg(ln(x)) FILTER (x > 0) AS s,
         1 - count(*) FILTER (x > 0) / nullif(count(x), 0)::DOUBLE AS dry
  FROM (SELECT cell_id, period, CASE WHEN x > 0 THEN x WHEN x = 0 THEN 0 END AS x FROM smooth)
  GROUP BY 1, 2),
shapes AS (
  SELECT *, CASE WHEN s > 1e-12 THEN list_reduce(
      list_concat([(1 + sqrt(1 + 4 * s / 3)) / (4 * s)], list_transform(range(15), lambda j: 0::DOUBLE)),
      lambda a, unused: greatest(a - (ln(a) - {psi} - s) / (1 / a - {psi1}), a / 4)) END AS shape
  FROM fits),
placed AS (
  SELECT cell_id, period, x, shape AS a, dry, x * shape / m AS y FROM smooth JOIN shapes
  USING (cell_id) WHERE shapes.month = month(period)),
probs AS (
  SELECT cell_id, period, CASE WHEN x IS NULL OR a IS NULL THEN NULL WHEN x <= 0 THEN dry
    ELSE dry + (1 - dry) * least(1, list_sum(list_transform(
      range(CAST(100 + greatest(y - a, 0) * 2 + 15 * sqrt(y) AS BIGINT)),
      lambda j: exp((a + j) * ln(y) - y - lgamma(a + j + 1))))) END AS p
  FROM placed),
parts AS (SELECT *, p - 0.5 AS q, sqrt(-ln(least(p, 1 - p))) AS r FROM probs WHERE p > 0 AND p < 1),
normal AS (
  SELECT cell_id, period, CASE WHEN abs(q) <= 0.425 THEN q * {_ratio_sql(special.PPND_CENTRE, '(0.180625 - q * q)')}
    WHEN r <= 5 THEN sign(q) * {_ratio_sql(special.PPND_MIDDLE, '(r - 1.6)')}
    ELSE sign(q) * {_ratio_sql(special.PPND_TAIL, '(r - 5)')} END AS v
  FROM parts),
spi AS (
  SELECT cell_id, period, CASE WHEN p IS NULL THEN NULL WHEN p <= 0 THEN -8.21 WHEN p >= 1 THEN 8.21
         ELSE least(greatest(v, -8.21), 8.21) END AS v
  FROM probs LEFT JOIN normal USING (cell_id, period))"""


def monthly_rain(spark, sf_dir) -> DataFrame:
    return spi.monthly_mean(cube.series(spark, sf_dir, "pr"))


def _register_spi(window: int) -> None:
    sql = with_cube(f"WITH {spi_sql(window)} SELECT cell_id, period, v AS value FROM spi")

    @register(f"spi{window}", rounded_sql(sql, ["value"], 4))
    def query(spark, sf_dir):
        return rounded(spi.spi(monthly_rain(spark, sf_dir), window), 4)


for _window in SPI_WINDOWS:
    _register_spi(_window)


def spi_like(spark, sf_dir) -> DataFrame:
    """A standardised-looking monthly series: rain's departure from the cell's mean, with unknown months."""
    month = period_start("date", "MS")
    totals = cube.wide(spark, sf_dir).groupBy("cell_id", month.alias("period")).agg(
        F.sum("pr").alias("total"), F.count("tmax").alias("known"), F.count("*").alias("days")
    )
    means = totals.groupBy("cell_id").agg(F.avg("total").alias("mean"))
    value = F.when(F.col("known") * 100 >= F.col("days") * 93, (F.col("total") - F.col("mean")) / 8.0)
    return totals.join(means, "cell_id").select(F.lit("SPI3").alias("index"), "cell_id", "period", value.alias("value"))


LIKE_SQL = f"""
totals AS (
  SELECT cell_id, {first_day('MS')} AS period, sum(pr) AS total, count(tmax) AS known, count(*) AS days
  FROM wide GROUP BY 1, 2),
like_ AS (
  SELECT cell_id, period, CASE WHEN known * 100 >= days * 93
         THEN (total - avg(total) OVER (PARTITION BY cell_id)) / 8 END AS v FROM totals)"""


def events_sql(source: str, threshold: float) -> str:
    """CTEs ending in yearly(cell_id, kind, period, Frequency, Duration, Peak, Severity)."""
    return f"""
signed AS (
  SELECT cell_id, kind, sign_, period, v * sign_ AS u FROM {source}, (VALUES ('Drought', -1), ('Flood', 1)) k(kind, sign_)),
held AS (
  SELECT *, coalesce(last_value(CASE WHEN u IS NOT NULL THEN u > {threshold} END IGNORE NULLS) OVER (
    PARTITION BY cell_id, kind ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS on_
  FROM signed),
runs AS (
  SELECT *, row_number() OVER (PARTITION BY cell_id, kind ORDER BY period)
          - row_number() OVER (PARTITION BY cell_id, kind, on_ ORDER BY period) AS run FROM held),
found AS (
  SELECT cell_id, kind, date_trunc('year', min(period)) AS year_, count(*) AS months, max(u) * max(sign_) AS peak,
         sum(u) FILTER (u > 0) AS severity, max(sign_) AS sign_
  FROM runs WHERE on_ GROUP BY cell_id, kind, run HAVING count(*) >= 2),
best AS (
  SELECT cell_id, kind, CAST(year_ AS DATE) AS period, count(*) AS n, max(months) AS months,
         max(peak * sign_) * max(sign_) AS peak, max(severity) AS severity FROM found GROUP BY 1, 2, 3),
every_ AS (SELECT DISTINCT cell_id, kind, {first_day('YS', 'period')} AS period FROM signed),
alive AS (SELECT cell_id, kind, count(u) AS known FROM signed GROUP BY 1, 2),
yearly AS (
  SELECT cell_id, kind, period, CASE WHEN known > 0 THEN CAST(coalesce(n, 0) AS DOUBLE) END AS "Frequency",
         CAST(months AS DOUBLE) AS "Duration", peak AS "Peak", severity AS "Severity"
  FROM every_ LEFT JOIN best USING (cell_id, kind, period) JOIN alive USING (cell_id, kind))"""


METRICS = ["Frequency", "Duration", "Peak", "Severity"]


def _register_events(kind: str) -> None:
    sql = with_cube(f"""
WITH {LIKE_SQL}, {events_sql('like_', 1)}
SELECT cell_id, kind, period, "Frequency", "Duration", "Peak", "Severity" FROM yearly WHERE kind = '{kind}'""")

    @register(f"events_{kind.lower()}", rounded_sql(sql, METRICS))
    def query(spark, sf_dir):
        table = events.yearly_events(spi_like(spark, sf_dir), 1.0).filter(F.col("kind") == kind)
        return rounded(table.select("cell_id", "kind", "period", *METRICS))


_register_events("Drought")
_register_events("Flood")


@register(
    "spi_events",
    rounded_sql(with_cube(f"""
WITH {spi_sql(3)}, {events_sql('spi', 0.5)},
named AS (UNPIVOT (SELECT cell_id, kind, period, "Frequency", "Duration", "Peak", "Severity" FROM yearly)
          ON "Frequency", "Duration", "Peak", "Severity" INTO NAME metric VALUE value)
SELECT 'SPI3_' || y.kind || '_' || m.metric AS index, 'YS' AS freq, y.period, y.cell_id, n.value,
       CASE m.metric WHEN 'Frequency' THEN 'events' WHEN 'Duration' THEN 'months' ELSE '' END AS units
FROM yearly y CROSS JOIN (VALUES ('Frequency'), ('Duration'), ('Peak'), ('Severity')) m(metric)
LEFT JOIN named n ON n.cell_id = y.cell_id AND n.kind = y.kind AND n.period = y.period AND n.metric = m.metric"""),
        ["value"], 4),
)
def spi_events(spark, sf_dir):
    return rounded(events.event_values(spi.spi_values(monthly_rain(spark, sf_dir), [3]), 0.5), 4)


@register(
    "event_classes",
    rounded_sql(with_cube(f"""
WITH {LIKE_SQL}, known AS (
  SELECT cell_id, period, v, CASE WHEN v < -1 THEN -1 WHEN v > 1 THEN 1 ELSE 0 END AS side FROM like_ WHERE v IS NOT NULL),
runs AS (
  SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY period)
          - row_number() OVER (PARTITION BY cell_id, side ORDER BY period) AS run FROM known)
SELECT cell_id, period, v AS value, CASE WHEN count(*) OVER (PARTITION BY cell_id, side, run) < 2 THEN 'neutral'
  WHEN side = -1 THEN 'drought' WHEN side = 1 THEN 'wet' ELSE 'neutral' END AS label FROM runs"""), ["value"]),
)
def event_classes(spark, sf_dir):
    return rounded(events.classify_months(spi_like(spark, sf_dir), ("cell_id",), 1.0))


P_SQL = """CASE WHEN z = 0 THEN 1 ELSE greatest(0, 1 - list_sum(list_transform(range(200),
  lambda j: exp((j + 0.5) * ln(z * z / 2) - z * z / 2 - lgamma(j + 1.5))))) END"""


def trend_sql(source: str, key: str) -> str:
    """CTEs ending in trends(key, s, z, p, slope) from source(key, pos, v)."""
    return f"""
pairs AS (
  SELECT a.{key}, sign(b.v - a.v) AS sg, (b.v - a.v) / (b.pos - a.pos) AS slope
  FROM {source} a JOIN {source} b ON a.{key} = b.{key} AND a.pos < b.pos WHERE a.v IS NOT NULL AND b.v IS NOT NULL),
ties AS (
  SELECT {key}, sum(t * (t - 1) * (2 * t + 5)) AS ties
  FROM (SELECT {key}, v, count(*) AS t FROM {source} WHERE v IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
sizes AS (SELECT {key}, count(v) AS n FROM {source} GROUP BY 1 HAVING count(v) >= 0.7 * count(*)),
scores AS (
  SELECT {key}, CAST(sum(sg) AS DOUBLE) AS s, median(slope) * 10 AS slope FROM pairs GROUP BY 1),
tested AS (
  SELECT {key}, s, slope, CASE WHEN s = 0 THEN 0 ELSE (s - sign(s)) / sqrt((n * (n - 1) * (2 * n + 5) - ties) / 18.0::DOUBLE) END AS z
  FROM scores JOIN ties USING ({key}) JOIN sizes USING ({key})),
trends AS (SELECT {key}, s, z, slope, {P_SQL} AS p FROM tested)"""


CELL_YEARS = f"{PRCPTOT_SQL}, years AS (SELECT cell_id, year(period) AS pos, v FROM yearly)"


@register(
    "mann_kendall",
    rounded_sql(with_cube(f"WITH {CELL_YEARS}, {trend_sql('years', 'cell_id')} SELECT cell_id, s, z, p FROM trends"),
                ["z", "p"]),
)
def mann_kendall(spark, sf_dir):
    return rounded(trend.trends(yearly_total(spark, sf_dir), ("cell_id",)).select("cell_id", "s", "z", "p"))


@register(
    "sen_slope",
    rounded_sql(with_cube(f"WITH {CELL_YEARS}, {trend_sql('years', 'cell_id')} SELECT cell_id, slope FROM trends"),
                ["slope"]),
)
def sen_slope(spark, sf_dir):
    return rounded(trend.trends(yearly_total(spark, sf_dir), ("cell_id",)).select("cell_id", "slope"))


def monthly_extreme(spark, sf_dir) -> DataFrame:
    table = daily.daily_indices(cube.series(spark, sf_dir, "tmax"), ["TXx"], "MS", missing=0.05)
    return daily.to_index_values(table, "MS")


@register(
    "trend_monthly",
    rounded_sql(with_cube(f"""
WITH years AS (
  SELECT cell_id, year(date) * 12 + month(date) - 1 AS pos,
         CASE WHEN count(tmax) > 0 AND count(*) - count(tmax) < 0.05::DOUBLE * count(*) THEN max(tmax) END AS v
  FROM wide GROUP BY 1, 2), {trend_sql('years', 'cell_id')}
SELECT cell_id, s, z, p, slope * 12 AS slope FROM trends"""), ["z", "p", "slope"]),
)
def trend_monthly(spark, sf_dir):
    table = trend.trends(monthly_extreme(spark, sf_dir), ("cell_id",), "MS")
    return rounded(table.select("cell_id", "s", "z", "p", "slope"))


def like_events(spark, sf_dir) -> DataFrame:
    return events.event_values(spi_like(spark, sf_dir), 1.0)


@register(
    "trend_direction",
    with_cube(f"""
WITH {LIKE_SQL}, {events_sql('like_', 1)},
years AS (SELECT kind || cell_id AS id, kind, cell_id, year(period) AS pos, coalesce("Duration", 0) AS v FROM yearly),
{trend_sql('years', 'id')}
SELECT 'SPI3_' || kind || '_Duration' AS index, cell_id, s,
       CASE WHEN z > 0 THEN 'increasing' WHEN z < 0 THEN 'decreasing' ELSE 'no trend' END AS trend
FROM trends JOIN (SELECT DISTINCT id, kind, cell_id FROM years) USING (id)"""),
)
def trend_direction(spark, sf_dir):
    durations = like_events(spark, sf_dir).filter(F.col("index").endswith("Duration"))
    return trend.trends(durations, ("cell_id",)).select("index", "cell_id", "s", "trend")


# Area means are taken of SDII: its values are ratios, which do not fall on rounding boundaries.
SDII_SQL = f"""
yearly AS (
  SELECT cell_id, {first_day('YS')} AS period,
         CASE WHEN count(pr) = {period_days('YS', first_day('YS'))}
              THEN sum(pr) FILTER (pr >= 1) / nullif(count(*) FILTER (pr >= 1), 0) END AS v
  FROM wide GROUP BY 1, 2)"""
AREA_YEARS = f"""{weights_sql('n_name')}, {SDII_SQL},
years AS (
  SELECT area, year(period) AS pos, sum(v * weight) / sum(weight) AS v
  FROM yearly JOIN cell_area USING (cell_id) WHERE v IS NOT NULL GROUP BY 1, 2)"""


def area_yearly(spark, sf_dir) -> DataFrame:
    intensity = daily.daily_indices(cube.series(spark, sf_dir, "pr"), ["SDII"], "YS")
    return spatial.area_mean(daily.to_index_values(intensity, "YS"), weights(spark, sf_dir))


@register(
    "trend_area",
    with_cube(f"""
WITH {AREA_YEARS}, {trend_sql('years', 'area')}
SELECT 'SDII' AS index, area, round(slope, 2) AS slope, round(p, 3) AS p FROM trends"""),
)
def trend_area(spark, sf_dir):
    return maps.trend(area_yearly(spark, sf_dir), ("area",)).select("index", "area", "slope", "p")


@register(
    "trend_grid",
    with_cube(f"""
WITH {CELL_YEARS}, chosen AS (SELECT * FROM years WHERE pos BETWEEN 1996 AND 2001), {trend_sql('chosen', 'cell_id')}
SELECT 'PRCPTOT' AS index, cell_id, round(slope, 2) AS slope, round(p, 3) AS p FROM trends"""),
)
def trend_grid(spark, sf_dir):
    table = maps.trend(yearly_total(spark, sf_dir), ("cell_id",), 1996, 2001)
    return table.select("index", "cell_id", "slope", "p")


@register(
    "significant_cells",
    rounded_sql(with_cube(f"""
WITH years AS (
  SELECT cell_id, year(date) * 12 + month(date) - 1 AS pos,
         CASE WHEN count(tmax) > 0 AND count(*) - count(tmax) < 0.05::DOUBLE * count(*) THEN max(tmax) END AS v
  FROM wide GROUP BY 1, 2), {trend_sql('years', 'cell_id')}
SELECT cell_id, p FROM trends WHERE p < 0.5"""), ["p"]),
)
def significant_cells(spark, sf_dir):
    """The level is 0.5 here, so that the synthetic series leave something to show."""
    table = trend.trends(monthly_extreme(spark, sf_dir), ("cell_id",), "MS")
    return rounded(trend.significant(table, 0.5).select("cell_id", "p"))
