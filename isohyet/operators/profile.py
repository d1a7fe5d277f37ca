"""Descriptions of a dataset and of its files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.model import CANONICAL_UNITS
from isohyet.operators.clean import display_name, lookup
from isohyet.operators.grid import neighbours, spacing
from isohyet.operators.summary import summarise

IRREGULAR = 1e-3


NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
DEGREES = r"(?:°|deg|degs|degree|degrees|degree_north|degree_east|degrees_north|degrees_east)"


def number_in(text) -> Column:
    """A number of degrees such as "0.25", "0.25 degrees" or "2.5e-1°"; null for other units and for no number."""
    found = F.regexp_extract(F.trim(F.lower(text)), rf"^({NUMBER})\s*{DEGREES}?$", 1)
    return F.when(found != "", F.abs(found.cast("double")))


def _axis_facts(obs: DataFrame, axis: str) -> Column:
    """Size, bounds and spacing of one axis, as a struct from a scalar subquery."""
    table = neighbours(obs.filter(F.col(axis).isNotNull()), axis)
    step = F.col("after") - F.col(axis)
    return table.agg(F.struct(
        F.count("*").alias("size"), F.min(axis).alias("low"), F.max(axis).alias("high"),
        F.avg(step).alias("step"), (F.max(step) - F.min(step) > IRREGULAR).alias("irregular"),
    )).scalar()


def _step_text(axis: str) -> Column:
    mark = F.when(F.col(f"{axis}.irregular"), "~").otherwise("")
    return F.concat(mark, F.format_string("%.3f°", F.col(f"{axis}.step")))


def dataset_profile(obs: DataFrame, calendar: str = "standard", described: DataFrame | None = None) -> DataFrame:
    """One row: variables and units (and names, where ``described(variable, standard_name, long_name, units)`` is given), sizes, bounds (4 decimals), first and last date, years, resolution, calendar.

    The observations are read once, for the distinct values of each column, which are few; all facts are
    derived from those.
    """
    obs = summarise(obs)
    dates = obs.select("date").filter("date is not null").distinct()
    times = dates.agg(F.struct(
        F.count("*").alias("size"), F.min("date").alias("first"), F.max("date").alias("last"),
        F.count_distinct(F.year("date")).alias("years"),
    )).scalar()
    variables = obs.select("variable").filter("variable is not null").distinct()
    facts = variables.agg(F.array_sort(F.collect_list("variable")).alias("variables")).withColumns({
        "lat": _axis_facts(obs, "lat"), "lon": _axis_facts(obs, "lon"), "time": times,
    })
    unit = F.transform("variables", lambda v: F.coalesce(lookup(v, CANONICAL_UNITS), F.lit("unknown")))
    named = []
    if described is not None:
        # A few variables; files may describe the same one differently, the first name in order counts.
        names = describe_variables(described).groupBy("variable").agg(F.min("name").alias("name"))
        known = names.agg(F.map_from_entries(F.collect_list(F.struct("variable", "name")))).scalar()
        facts = facts.withColumn("known", known)
        named = [F.transform("variables", lambda v: F.coalesce(F.try_element_at("known", v), v)).alias("names")]
    return facts.select(
        "variables", *named, unit.alias("units"),
        F.col("time.size").alias("n_time"), F.col("lat.size").alias("n_lat"), F.col("lon.size").alias("n_lon"),
        *[
            F.round(F.col(f"{axis}.{field}"), 4).alias(f"{axis}_{name}")
            for axis in ("lat", "lon")
            for field, name in (("low", "min"), ("high", "max"))
        ],
        F.col("time.first").alias("time_start"), F.col("time.last").alias("time_end"),
        F.col("time.years").alias("time_years"),
        F.when(
            (F.col("lat.size") > 1) & (F.col("lon.size") > 1),
            F.concat(_step_text("lat"), F.lit(" x "), _step_text("lon")),
        ).alias("spatial_resolution"),
        F.lit(calendar).alias("calendar"),
    )


def describe_variables(attributes: DataFrame) -> DataFrame:
    """``attributes(variable, standard_name, long_name, units)`` -> (variable, name, units)."""
    name = display_name(F.col("standard_name"), F.col("long_name"), F.col("variable"))
    return attributes.select("variable", name.alias("name"), F.coalesce("units", F.lit("unknown")).alias("units"))


def _stated_resolution() -> Column:
    """Of a file's attributes: the steps of its transform, else the numbers in its texts; null without both axes."""

    def pair(lat: Column, lon: Column) -> Column:
        usable = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & (lat != 0) & (lon != 0)
        return F.when(usable, F.struct(F.abs(lat).alias("lat_res"), F.abs(lon).alias("lon_res")))

    step = [F.get("transform", F.lit(i)) for i in (4, 0)]
    return F.coalesce(pair(*step), pair(number_in(F.col("lat_text")), number_in(F.col("lon_text"))))


def file_resolution(obs: DataFrame, attributes: DataFrame | None = None) -> DataFrame:
    """(src, lat_res, lon_res): the steps of the file's transform, else what its attributes state, else the first
    spacing of both axes.

    ``attributes(src, lat_text, lon_text[, transform])``.  Null where an axis has a single coordinate.
    """
    steps = [
        spacing(obs.filter(F.col(axis).isNotNull()), axis, ("src",)).select("src", F.abs("first_step").alias(f"{axis}_res"))
        for axis in ("lat", "lon")
    ]
    table = steps[0].join(steps[1], "src")
    known = F.col("lat_res").isNotNull() & F.col("lon_res").isNotNull()
    measured = F.when(known, F.struct("lat_res", "lon_res"))
    pair = measured
    if attributes is not None:
        if "transform" not in attributes.columns:
            attributes = attributes.withColumn("transform", F.lit(None).cast("array<double>"))
        table = table.join(attributes.select("src", "lat_text", "lon_text", "transform"), "src", "left")
        pair = F.coalesce(_stated_resolution(), measured)
    return table.select("src", pair.alias("r")).select("src", "r.lat_res", "r.lon_res")


def file_profile(
    obs: DataFrame, attributes: DataFrame | None = None, calendar: str = "standard", listed: DataFrame | None = None
) -> DataFrame:
    """One row per file: variables, bounds, time span in years, resolution, calendar, error.

    ``attributes`` (see ``sources.attributes``) give resolution and calendar where they state them; ``calendar`` is that
    of files which state none.  Files in ``listed(src)`` of which no row was read have an error and nothing else.
    The observations are read once.
    """
    obs = summarise(obs)
    facts = obs.groupBy("src").agg(
        F.array_sort(F.collect_set("variable")).alias("variables"),
        F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"),
        F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"),
        F.min("date").alias("time_start"), F.max("date").alias("time_end"),
    )
    years = F.round(F.datediff("time_end", "time_start") / 365.25, 2)
    text = F.format_string("%.3f° x %.3f°", F.col("lat_res"), F.col("lon_res"))
    stated = F.lit(None).cast("string")
    if attributes is not None:
        facts = facts.join(attributes.select("src", F.col("calendar").alias("stated")), "src", "left")
        stated = F.col("stated")
    error = F.lit(None).cast("string")
    if listed is not None:
        facts = facts.withColumn("read", F.lit(True)).join(listed.select("src").distinct(), "src", "full")
        error = F.when(F.col("read").isNull(), "no row could be read")
    return facts.join(file_resolution(obs, attributes), "src", "left").select(
        "src", "variables", "lat_min", "lat_max", "lon_min", "lon_max", "time_start", "time_end",
        years.alias("time_years"), "lat_res", "lon_res",
        F.when(F.col("lat_res").isNotNull(), text).alias("spatial_resolution"),
        F.when(error.isNull(), F.coalesce(stated, F.lit(calendar))).alias("calendar"), error.alias("error"),
    )
