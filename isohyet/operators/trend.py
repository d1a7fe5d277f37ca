"""Mann-Kendall test and Sen slope of yearly (or monthly) series.

A series is one value per period, so it is packed into one array per key - bounded by the number of
periods - and tested by a vectorised function.  Pairs of periods never become rows, and only short series are paired
at all.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from isohyet.functions.barrier import computed_once
from isohyet.functions.calendar import period_number
from isohyet.functions.special import normal_two_sided

# The function below travels to the executors by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ENOUGH = 0.7
DECADE = {"YS": 10, "MS": 120}


STATISTICS = StructType([StructField(name, DoubleType()) for name in ("n", "s", "ties", "median")])
DIRECT = 1024        # points up to which all slopes are listed
SAMPLE = 1 << 20     # slopes that bracket the median of longer series
LISTED = 1 << 23     # slopes between the brackets that may be listed
NARROW = 32          # width of blocks that are compared as a whole


def _blocks(values: np.ndarray) -> np.ndarray:
    """Values padded to a power of two with infinity, which is below nothing."""
    size = 1 << max(len(values) - 1, 1).bit_length()
    return np.concatenate((values, np.full(size - len(values), np.inf)))


def pairs_below(values: np.ndarray, margin: float = 0.0) -> int:
    """Pairs i < j with value j below value i by more than ``margin``, counted while merging sorted blocks."""
    sorted_, width, total = _blocks(np.asarray(values, np.float64)), 1, 0
    while width < len(sorted_):
        halves = sorted_.reshape(-1, 2, width)
        left, right = halves[:, 0], halves[:, 1] + margin
        if width <= NARROW:
            total += int(np.count_nonzero(left[:, :, None] > right[:, None, :]))
        else:
            total += sum(width * width - int(np.searchsorted(a, b, side="right").sum()) for a, b in zip(left, right))
        width *= 2
        sorted_ = np.sort(sorted_.reshape(-1, width), axis=1).ravel()
    return total


def _inversions(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places p < q with value p above value q; only the pairs themselves are held."""
    padded = _blocks(values)
    order, width, found = np.arange(len(padded)), 1, []
    while width < len(padded):
        halves = order.reshape(-1, 2, width)
        for a, b in zip(halves[:, 0], halves[:, 1]) if width > NARROW else ():
            start = np.searchsorted(padded[a], padded[b], side="right")
            many = width - start
            at = np.repeat(start - np.cumsum(many) + many, many) + np.arange(many.sum())
            found.append((a[at], np.repeat(b, many)))
        if width <= NARROW:
            block, i, j = np.nonzero(padded[halves[:, 0]][:, :, None] > padded[halves[:, 1]][:, None, :])
            found.append((halves[block, 0, i], halves[block, 1, j]))
        width *= 2
        order = order.reshape(-1, width)
        order = np.take_along_axis(order, np.argsort(padded[order], axis=1, kind="stable"), axis=1).ravel()
    return tuple(np.concatenate(x) for x in zip(*found))


def _middle(slopes: np.ndarray, first: int, last: int) -> float:
    low, high = np.partition(slopes, [first, last])[[first, last]]
    return float(low + (high - low) / 2 if low != high else low)


def median_slope(pos: np.ndarray, value: np.ndarray) -> float:
    """The median of the slopes between all pairs of points, in order of ``pos``.

    Long series are not paired.  For a slope q, the pairs with a smaller one are those whose order in value - q pos is
    reversed, which merging counts.  A sample brackets the median; where counts confirm the brackets, the slopes
    between them are the pairs that change their order from one bracket to the other, and are listed.
    """
    n = len(value)
    pairs = n * (n - 1) // 2
    first, last = (pairs - 1) // 2, pairs // 2
    if n <= DIRECT:
        i, j = np.triu_indices(n, 1)
        return _middle((value[j] - value[i]) / (pos[j] - pos[i]), first, last)
    pos = pos - pos[0]
    scale, reach = float(np.abs(value).max()), float(pos[-1])

    def below(q: float) -> tuple[int, int]:
        """Pairs with a slope below q for certain, and those that rounding leaves possible."""
        turned = value - q * pos
        margin = 8 * np.finfo(float).eps * (scale + abs(q) * reach)
        return pairs_below(turned, margin), pairs_below(turned, -margin)

    rng = np.random.default_rng(17)
    i = rng.integers(0, n, SAMPLE)
    j = (i + rng.integers(1, n, SAMPLE)) % n
    slopes = np.sort((value[j] - value[i]) / (pos[j] - pos[i]))
    centre, spread = slopes[SAMPLE // 2], int(4 * SAMPLE ** 0.5 / 2)
    certain, possible = below(centre)
    if certain <= first and possible > last:  # so many slopes are this one
        return float(centre) + 0.0
    while spread < SAMPLE // 2:
        a, b = slopes[SAMPLE // 2 - spread], slopes[SAMPLE // 2 + spread]
        under, over = slopes[:np.searchsorted(slopes, a)], slopes[np.searchsorted(slopes, b, side="right"):]
        if len(under) and len(over):
            low, high = (under[-1] + a) / 2, (b + over[0]) / 2
            (low_certain, low_possible), (high_certain, high_possible) = below(low), below(high)
            clear = low_certain == low_possible and high_certain == high_possible
            if clear and low_certain <= first and high_certain > last and high_certain - low_certain <= LISTED:
                order = np.argsort(value - low * pos, kind="stable")
                p, q = _inversions((value - high * pos)[order])
                i, j = order[p], order[q]
                return _middle((value[j] - value[i]) / (pos[j] - pos[i]), first - low_certain, last - low_certain)
        spread *= 2
    return _paired_median(pos, value, first, last)


def _paired_median(pos: np.ndarray, value: np.ndarray, first: int, last: int) -> float:
    """Order statistics of all slopes by halving the range of doubles: time grows with the pairs, memory does not."""

    def count(q: float) -> int:
        return sum(int(np.count_nonzero((value[i + 1:] - value[i]) / (pos[i + 1:] - pos[i]) <= q)) for i in range(len(value) - 1))

    def at(rank: int) -> float:
        # Doubles in order are whole numbers in order once the sign is taken care of.
        low, high = -(2**63), 2**63 - 1
        while low < high:
            middle = (low + high) // 2
            bits = middle if middle >= 0 else -(middle + 1) - 2**63
            q = np.array(bits, np.int64).view(np.float64)
            if np.isnan(q):
                low, high = (middle + 1, high) if middle < 0 else (low, middle)
            elif count(float(q)) > rank:
                high = middle
            else:
                low = middle + 1
        bits = low if low >= 0 else -(low + 1) - 2**63
        return float(np.array(bits, np.int64).view(np.float64))

    low, high = at(first), at(last)
    return low + (high - low) / 2 if low != high else low


def _series_statistics(pos: np.ndarray, value: np.ndarray) -> tuple[float, float, float, float]:
    """Length, sum of signs of all later-minus-earlier differences, tie term, median of all slopes."""
    value = value + 0.0  # -0.0 and 0.0 are one value
    _, t = np.unique(value, return_counts=True)
    ties = float((t * (t - 1.0) * (2.0 * t + 5.0)).sum())
    signs = pairs_below(-value) - pairs_below(value)
    return float(len(value)), float(signs), ties, median_slope(pos, value)


@F.pandas_udf(STATISTICS)
def series_statistics(pos: pd.Series, value: pd.Series) -> pd.DataFrame:
    """Statistics of packed series; the only arithmetic outside Spark's expressions."""
    rows = [_series_statistics(np.asarray(p, np.float64), np.asarray(v, np.float64)) for p, v in zip(pos, value)]
    return pd.DataFrame(rows, columns=["n", "s", "ties", "median"], dtype="float64")


def trends(
    values: DataFrame, keys: tuple[str, ...], freq: str = "YS", per_period_decade: bool = True
) -> DataFrame:
    """``values(index, *keys, period, value)`` -> ``(index, *keys, s, z, p, slope, trend)``.

    Null event measures count as 0.  Series with less than 70 % of values are left out.  The slope is per
    decade; ``per_period_decade=False`` multiplies by ten whatever the period.  ``trend`` names the direction
    by the sign of z, for SPI events only.
    """
    name = F.col("index")
    is_event = name.contains("SPI") & (name.contains("_Drought_") | name.contains("_Flood_"))
    zero_filled = is_event & (name.contains("Duration") | name.contains("Peak") | name.contains("Severity"))
    value = F.when(zero_filled, F.coalesce("value", F.lit(0.0))).otherwise(F.col("value"))
    packed = (
        values.select("index", *keys, period_number(F.col("period"), freq).alias("pos"), value.alias("value"))
        .groupBy("index", *keys)
        .agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("series"))
        .withColumn("points", F.filter("series", lambda p: p["value"].isNotNull()))
        .filter((F.size("points") >= ENOUGH * F.size("series")) & (F.size("points") > 1))
    )
    # A function outside the expressions is evaluated once by itself.
    statistics = series_statistics(
        F.transform("points", lambda p: p["pos"].cast("double")), F.transform("points", lambda p: p["value"])
    )
    tested = packed.select("index", *keys, statistics.alias("t")).select("index", *keys, "t.*")
    n, s = F.col("n"), F.col("s")
    variance = (n * (n - 1.0) * (2.0 * n + 5.0) - F.col("ties")) / 18.0
    z = F.when(s == 0, F.lit(0.0)).otherwise((s - F.signum(s)) / F.sqrt(variance))
    scored = computed_once(
        tested, ["index", *keys, "s"],
        z=z, slope=F.col("median") * (DECADE[freq] if per_period_decade else 10),
    )
    direction = F.when(F.col("z") > 0, "increasing").when(F.col("z") < 0, "decreasing").otherwise("no trend")
    return computed_once(
        scored, ["index", *keys, "s", "z", "slope"],
        p=normal_two_sided(F.col("z")), trend=F.when(is_event, direction),
    ).select("index", *keys, "s", "z", "p", "slope", "trend")


def significant(trend_table: DataFrame, level: float = 0.05) -> DataFrame:
    return trend_table.filter(F.col("p") < level)
