"""Order-statistic expressions over sorted arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantile8(values: Column, q: float) -> Column:
    """Hyndman-Fan type 8 quantile (alpha = beta = 1/3) of an ascending array without nulls."""
    n = F.size(values)
    position = n * F.lit(q) + F.lit((1.0 + q) / 3.0) - 1.0
    position = F.least(F.greatest(position, F.lit(0.0)), n - F.lit(1.0))
    low = F.floor(position).cast("int")
    lower = F.get(values, low)
    upper = F.get(values, F.least(low + 1, n - 1))
    return F.when(n > 0, lower + (upper - lower) * (position - low))


def median_of_sorted(values: Column) -> Column:
    n = F.size(values)
    middle = F.floor(n / 2).cast("int")
    return F.when(
        n > 0,
        F.when(n % 2 == 1, F.get(values, middle)).otherwise(
            (F.get(values, middle - 1) + F.get(values, middle)) / 2.0
        ),
    )
