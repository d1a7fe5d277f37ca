"""Registration of a Spark query together with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
TWINS: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = query
        if sql is not None:
            TWINS[name] = sql
        return query

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison across engines, whose sums may differ in the last bits."""
    columns = [
        F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes
    ]
    return df.select(*columns)


# The derived cube, in SQL: the same rule as suite.cube.
CUBE = """
scale AS (SELECT greatest(1, CAST(floor(sqrt(count(*) / 100.0)) AS BIGINT)) AS k FROM supplier),
grid AS (
  SELECT DISTINCT s_suppkey % (6 * k * k) AS cell_id, k,
         9.5 + (((s_suppkey % (6 * k * k)) // (3 * k)) + 0.5::DOUBLE) / k AS lat,
         99.5 + (((s_suppkey % (6 * k * k)) % (3 * k)) + 0.5::DOUBLE) / k AS lon
  FROM supplier, scale),
readings AS (
  SELECT l_suppkey % (6 * k * k) AS cell_id, CAST(l_shipdate AS DATE) AS date,
         l_returnflag || '_' || l_linestatus AS src,
         CAST(l_quantity AS BIGINT) AS quantity, CAST(round(100 * l_discount) AS BIGINT) AS cents
  FROM lineitem, scale),
days AS (
  SELECT CAST(unnest(generate_series(date_trunc('year', min(l_shipdate)),
              date_trunc('year', max(l_shipdate)) + INTERVAL 1 YEAR - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS date
  FROM lineitem),
daily AS (
  SELECT cell_id, date, CAST(sum(quantity) AS BIGINT) AS q, CAST(sum(cents) AS BIGINT) AS dc,
         CAST(sum(quantity * cents) AS BIGINT) AS qd, count(*) AS n
  FROM readings GROUP BY cell_id, date),
wide AS (
  SELECT g.cell_id, d.date,
         (coalesce(qd, 0) * 64 // 100) / 64.0::DOUBLE AS pr,
         15.0::DOUBLE + (q * 192 // (5 * n)) / 64.0::DOUBLE AS tmax,
         15.0::DOUBLE + (q * 192 // (5 * n)) / 64.0::DOUBLE - (dc * 192 // n) / 64.0::DOUBLE AS tmin
  FROM grid g CROSS JOIN days d LEFT JOIN daily r ON r.cell_id = g.cell_id AND r.date = d.date)
"""


def with_cube(body: str) -> str:
    """Prefix a query, possibly with CTEs of its own, with the cube."""
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {CUBE.strip()},\n{body[5:]}"
    return f"WITH {CUBE.strip()}\n{body}"


def first_day(freq: str, date: str = "date") -> str:
    return f"CAST(date_trunc('{'year' if freq == 'YS' else 'month'}', {date}) AS DATE)"


def period_days(freq: str, period: str = "period") -> str:
    unit = "YEAR" if freq == "YS" else "MONTH"
    return f"date_diff('day', {period}, CAST({period} + INTERVAL 1 {unit} AS DATE))"
