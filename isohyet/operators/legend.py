"""Numbers behind map legends and chart axes."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isohyet.session import settle

BINS = 9
SHARES = (0.02, 0.98)
HISTOGRAM = 100_000       # values of a map that one task may hold
PARTS = 1024              # bins of a range of values
BROADCAST_RANKS = 50_000  # ranks that are sent to all tasks; more of them are joined by map


def ticks(low: Column, high: Column, count: int = BINS) -> Column:
    """About ``count`` round values - 1, 2 or 5 times a power of ten apart - within [low, high]."""
    raw = (high - low) / float(count)
    power = F.floor(F.log10(raw))
    error = raw / F.pow(F.lit(10.0), power)
    factor = (
        F.when(error >= math.sqrt(50), 10.0).when(error >= math.sqrt(10), 5.0).when(error >= math.sqrt(2), 2.0).otherwise(1.0)
    )
    # Fractions are counted as whole divisions of one, so that the ticks come out exact.
    step = F.pow(F.lit(10.0), power) * factor
    per_unit = F.pow(F.lit(10.0), -power) / factor
    coarse = F.transform(F.sequence(F.ceil(low / step), F.floor(high / step)), lambda i: i * step)
    fine = F.transform(F.sequence(F.ceil(low * per_unit), F.floor(high * per_unit)), lambda i: i / per_unit)
    return F.when(low < high, F.when(power < 0, fine).otherwise(coarse))


def _ranks(counted: DataFrame, column: str, keys: tuple[str, ...], shares: list[float]) -> DataFrame:
    """``(*keys, share, fraction, rank, low, high, before)``: the two order statistics around each quantile."""
    facts = counted.groupBy(*keys).agg(F.sum("n").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
    place = (F.col("n") - 1) * F.col("share")
    around = F.array(F.floor(place).alias("a"), F.ceil(place).alias("b"))
    split = facts.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumns({"fraction": place - F.floor(place), "around": around})
    return split.select(*keys, "share", "fraction", F.posexplode("around").alias("end", "rank"), "low", "high", F.lit(0).cast("long").alias("before"))


def select_ranks(counted: DataFrame, column: str, keys: tuple[str, ...], shares: list[float]) -> DataFrame:
    """``(*keys, share, value)``: quantiles of counted values ``(*keys, column, n)``, which every round reads, interpolated as ``quantile_cont`` does.

    Every rank is looked for in a range of values, at first all of them.  The range is cut into ``PARTS`` bins that
    are counted with partial sums, and the bin that holds the rank is the next range, until it is one value: two
    or three rounds for values of a few decimals.  No task gathers the values of a map.
    """
    ranks = settle(_ranks(counted, column, keys, shares))
    few = ranks.count() <= BROADCAST_RANKS
    while not ranks.filter("low < high").isEmpty():
        known = ranks.select(*[F.col(k).alias(f"_{k}") for k in keys], "share", "fraction", "end", "rank", "low", "high", "before")
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.lit(True))
        inside = same & F.col(column).between(F.col("low"), F.col("high"))
        bin_ = F.when(F.col("high") > F.col("low"), F.least(
            F.floor((F.col(column) - F.col("low")) / (F.col("high") - F.col("low")) * PARTS), F.lit(PARTS - 1))).otherwise(0)
        names = [f"_{k}" for k in keys] + ["share", "fraction", "end", "rank", "before"]
        bins = (counted.join(F.broadcast(known) if few else known, inside).groupBy(*names, bin_.alias("bin"))
                .agg(F.sum("n").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")))
        # At most PARTS rows a rank.
        up = Window.partitionBy(*[f"_{k}" for k in keys], "share", "end").orderBy("bin")
        placed = bins.withColumn("below", F.col("before") + F.sum("n").over(up) - F.col("n"))
        chosen = placed.filter((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("n")))
        ranks = settle(chosen.select(*[F.col(f"_{k}").alias(k) for k in keys], "share", "fraction", "end", "rank", "low", "high",
                                     F.col("below").alias("before")))
    lower, upper = (F.max(F.when(F.col("end") == end, F.col("low"))) for end in (0, 1))
    return (ranks.groupBy(*keys, "share", "fraction").agg(lower.alias("a"), upper.alias("b"))
            .select(*keys, "share", (F.col("a") + (F.col("b") - F.col("a")) * F.col("fraction")).alias("value")))


def colour_range(maps: DataFrame, column: str, keys: tuple[str, ...] = ("index",), largest: int = HISTOGRAM) -> DataFrame:
    """2 % and 98 % quantiles per map.

    Stored values are rounded, so they are counted first.  A map of at most ``largest`` different values is one
    histogram; if any has more, ranks are selected by counting instead, and no task sees a whole map.
    """
    counted = settle(maps.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("n")))
    low, high = SHARES
    different = counted.groupBy(*keys).agg(F.count("*").alias("d")).agg(F.max("d")).first()[0] or 0
    if different > largest:
        found = select_ranks(counted, column, keys, [low, high])
        at = lambda share: F.max(F.when(F.col("share") == share, F.col("value")))
        return found.groupBy(*keys).agg(at(low).alias("low"), at(high).alias("high"))
    bounds = F.percentile(column, [low, high], F.col("n"))
    return counted.groupBy(*keys).agg(bounds.alias("q")).select(
        *keys, F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high")
    )


def legend_breaks(
    maps: DataFrame, column: str, keys: tuple[str, ...] = ("index",), symmetric: bool = False,
    low: float | None = None, high: float | None = None, largest: int = HISTOGRAM,
) -> DataFrame:
    """Legend ticks per map: over the colour range or the user's, around zero for trends."""
    table = colour_range(maps, column, keys, largest)
    table = table.withColumns({
        "low": F.col("low") if low is None else F.lit(float(low)),
        "high": F.col("high") if high is None else F.lit(float(high)),
    })
    table = table.filter("low < high")
    if symmetric:
        reach = F.greatest(F.abs("low"), F.abs("high"))
        table = table.withColumn("reach", reach).select(
            *keys, (-F.col("reach")).alias("low"), F.col("reach").alias("high")
        )
    return table.select(*keys, "low", "high", ticks(F.col("low"), F.col("high")).alias("breaks"))


def legend_class(value: Column, breaks: Column) -> Column:
    """Number of inner breaks at or below the value; null for a null value."""
    inner = F.slice(breaks, 2, F.greatest(F.size(breaks) - 2, F.lit(0)))
    return F.when(value.isNotNull(), F.size(F.filter(inner, lambda b: b <= value)))


def symmetric_axis(series: DataFrame, keys: tuple[str, ...] = ("index", "area")) -> DataFrame:
    """Axis limit 10 % beyond the largest magnitude (1 if all are zero) and its five ticks."""
    largest = F.max(F.abs(F.coalesce("value", F.lit(0.0))))
    limits = series.groupBy(*keys).agg(largest.alias("largest"))
    limit = F.when(F.col("largest") == 0, F.lit(1.0)).otherwise(F.col("largest") * 1.1)
    return limits.select(*keys, limit.alias("limit")).withColumn(
        "ticks", F.transform(F.array(*[F.lit(x) for x in (-1.0, -0.5, 0.0, 0.5, 1.0)]), lambda f: f * F.col("limit"))
    )
