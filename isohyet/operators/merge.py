"""Merging files of observations: which kind of merge, compatibility, first file wins, complete calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isohyet.operators.summary import cells_and_dates
from isohyet.session import settle

POINT = ["variable", "cell_id", "lat", "lon", "date"]


def infer_step(obs: DataFrame) -> str:
    """The spacing of the distinct dates: ``'D'``, ``'5D'``, ``'MS'`` (a month, on any day), ``'YS'`` (a year).

    The smallest spacing counts, as gaps only widen it; two dates alone are taken for days.  Dates that do not lie on such a calendar fail, and so
    does a spacing that cannot be told from a single date.  One row to the driver.
    """
    return step_of(settle(obs.select("date").distinct()))


def step_of(dates: DataFrame) -> str:
    """``infer_step`` of the distinct dates, which it reads several times: store them first."""
    inside = Window.partitionBy(F.year("date")).orderBy("date")  # a calendar year holds few dates
    steps = dates.select("date", F.datediff("date", F.lag("date").over(inside)).alias("step"))
    years = dates.groupBy(F.year("date").alias("year")).agg(F.min("date").alias("first"), F.max("date").alias("last"))
    over_years = Window.orderBy("year")  # one row a year
    borders = years.select(F.datediff("first", F.lag("last").over(over_years)).alias("step"))
    least = steps.select("step").unionByName(borders).agg(F.min("step"), F.count("step")).first()
    least, known = least
    if least is None:
        raise ValueError("a single date has no spacing; state the step")
    if least == 1 or known < 2:
        return "D"
    if 28 <= least <= 31:
        step = "MS"
    elif least in (365, 366):
        step = "YS"
    else:
        step = f"{least}D"
    bounds = dates.agg(F.min("date").alias("first"), F.max("date").alias("last"))
    calendar = bounds.select(F.explode(F.sequence("first", "last", interval(step))).alias("date"))
    if not dates.join(calendar, "date", "left_anti").isEmpty():
        raise ValueError(f"the dates do not follow a step of {step}; state the step")
    return step


def interval(step: str) -> Column:
    """``'D'``, ``'5D'``, ``'MS'`` or ``'YS'`` as a calendar interval."""
    if step in ("MS", "YS"):
        return F.expr("interval 1 month" if step == "MS" else "interval 1 year")
    if step.endswith("D") and (step[:-1] or "1").isdigit():
        return F.expr(f"interval {int(step[:-1] or 1)} day")
    raise ValueError(f"unknown step '{step}'")


def calendar_rows(cells: DataFrame, dates: DataFrame, step: str) -> DataFrame:
    """A row without a value for every step between the first and the last date, per variable and cell."""
    bounds = dates.agg(F.struct(F.min("date").alias("first"), F.max("date").alias("last"))).scalar()
    cells = cells.withColumn("b", bounds)
    days = F.sequence(F.col("b.first"), F.col("b.last"), interval(step))
    return cells.select("variable", "cell_id", "lat", "lon", F.explode(days).alias("date"))


def merge(obs: DataFrame, fill: bool = True, step: str | None = None) -> DataFrame:
    """Union of all files: one row per variable, cell and date.

    Where files overlap, the row of the first file (in name order) is kept, whatever its value.  With
    ``fill`` the calendar between the first and the last date is completed; ``step`` is ``'D'``,
    ``'5D'`` (any number of days), ``'MS'`` or ``'YS'`` and is inferred when not given.  Choosing and completing are one aggregation, so copies are
    reduced before the shuffle and no key ever holds more than one row per file after it.  With ``fill`` the input is
    read twice: for its cells and dates, and for its rows.
    """
    rows = obs.select(*POINT, "value", "src", F.lit(0).alias("filler"))
    if fill:
        cells, dates = cells_and_dates(obs)
        calendar = calendar_rows(cells, dates, step or step_of(dates))
        rows = rows.unionByName(calendar.select(
            *POINT, F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("src"),
            F.lit(1).alias("filler"),
        ))
    chosen = rows.groupBy(*POINT).agg(F.min(F.struct("filler", "src", "value")).alias("kept"))
    return chosen.select(*POINT, F.col("kept.value").alias("value"), F.col("kept.src").alias("src"))


def to_wide(obs: DataFrame, variables: list[str]) -> DataFrame:
    """One column per variable: the outer join of the variables on cell and date."""
    columns = [F.max(F.when(F.col("variable") == v, F.col("value"))).alias(v) for v in variables]
    return obs.groupBy("cell_id", "lat", "lon", "date").agg(*columns)


def variable_files(obs: DataFrame) -> DataFrame:
    """(variable, src): the files that hold each variable, one row each, as there may be very many."""
    return obs.select("variable", "src").distinct()


def file_variables(obs: DataFrame) -> DataFrame:
    """(src, variables): a file's few variables as a sorted list."""
    return variable_files(obs).groupBy("src").agg(F.array_sort(F.collect_list("variable")).alias("variables"))


def detect_mode(files: DataFrame) -> DataFrame:
    """``files(src, variables)`` -> one row: mode, number of files, variables.

    ``time``: every file holds the same variables; ``attribute``: no variable occurs twice; else ``mixed``.
    Equal files are counted per distinct list first.
    """
    lists = files.select(F.array_sort("variables").alias("variables")).groupBy("variables").agg(
        F.count("*").alias("files")
    )
    names = lists.select(F.explode("variables").alias("variable"), "files").groupBy("variable").agg(
        F.sum("files").alias("files")
    )
    shared = names.agg(F.coalesce(F.max("files"), F.lit(0))).scalar()
    found = names.agg(F.array_sort(F.collect_list("variable"))).scalar()
    summary = lists.agg(F.count("*").alias("kinds"), F.sum("files").alias("files"))
    mode = F.when(F.col("kinds") == 1, "time").when(F.col("shared") <= 1, "attribute").otherwise("mixed")
    return (
        summary.withColumns({"shared": shared, "variables": found})
        .select(mode.alias("mode"), "files", "variables")
    )


RELATIVE, ABSOLUTE = 1e-5, 1e-8


def _differs(low: Column, high: Column, base: Column) -> Column:
    tolerance = ABSOLUTE + RELATIVE * F.abs(base)
    return (high - base > tolerance) | (base - low > tolerance)


def check_compatibility(profiles: DataFrame) -> DataFrame:
    """``profiles(src, error, calendar, lat_res, lon_res)`` -> one row: ok, errors.

    Every file must be readable, calendars must agree, and resolutions must equal the first file's.
    """
    known = F.col("lat_res").isNotNull() & F.col("lon_res").isNotNull()
    facts = profiles.agg(
        F.count("*").alias("files"),
        F.count("error").alias("unreadable"),
        F.count_distinct(F.coalesce("calendar", F.lit("unknown"))).alias("calendars"),
        *[
            how.alias(f"{axis}_{name}")
            for axis in ("lat", "lon")
            for name, how in (
                ("low", F.min(F.when(known, F.col(f"{axis}_res")))),
                ("high", F.max(F.when(known, F.col(f"{axis}_res")))),
                ("base", F.min_by(F.when(known, F.col(f"{axis}_res")), F.when(known, F.col("src")))),
            )
        ],
    )
    readable = F.col("unreadable") == 0
    resolution = F.lit(False)
    for axis in ("lat", "lon"):
        resolution = resolution | _differs(*[F.col(f"{axis}_{n}") for n in ("low", "high", "base")])
    errors = F.array_compact(F.array(
        F.when(F.col("files") == 0, "no files"),
        F.when(~readable, "unreadable file"),
        F.when(readable & (F.col("calendars") > 1), "different calendars"),
        F.when(readable & resolution, "different resolutions"),
    ))
    return facts.select((F.size(errors) == 0).alias("ok"), errors.alias("errors"))
