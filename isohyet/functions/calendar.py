"""Period arithmetic.  A frequency is ``'YS'`` (years) or ``'MS'`` (months)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = {"YS": "year", "MS": "month"}
MONTHS = {"YS": 12, "MS": 1}


def period_start(date, freq: str) -> Column:
    return F.trunc(date, UNIT[freq])


def days_in_period(period, freq: str) -> Column:
    """Calendar length of the period that starts at ``period``."""
    return F.datediff(F.add_months(period, MONTHS[freq]), period)


def day_number(date) -> Column:
    return F.unix_date(date)


def period_number(period, freq: str) -> Column:
    """Consecutive integers for consecutive periods."""
    year, month = F.year(period), F.month(period)
    return year if freq == "YS" else year * 12 + month - 1
