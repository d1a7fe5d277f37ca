"""Names, units and scope of incoming observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet import model
from isohyet.model import Scope


def lookup(key: Column, table: dict) -> Column:
    """A fixed dictionary as a map expression; null for an absent key."""
    entries = [F.lit(part) for pair in table.items() for part in pair]
    return F.try_element_at(F.create_map(*entries), key)


def _alias_table() -> dict[str, str]:
    return {a: std for std, names in model.VARIABLE_ALIASES.items() for a in names}


def canonical_name(name: str) -> str:
    """``canonical_variable`` of a name known when the job is planned."""
    return _alias_table().get(name.lower(), name)


def canonical_variable(name) -> Column:
    """Case-insensitive alias -> canonical name; an unknown name is returned unchanged."""
    name = F.col(name) if isinstance(name, str) else name
    return F.coalesce(lookup(F.lower(name), _alias_table()), name)


def normalise_variables(obs: DataFrame) -> DataFrame:
    return obs.withColumn("variable", canonical_variable("variable"))


def standardise_coordinates(df: DataFrame, strict: bool = False) -> DataFrame:
    """Rename the first matching alias of each coordinate unless its standard name is there already."""
    renames = {}
    for standard, aliases in model.COORDINATE_ALIASES.items():
        if standard in df.columns:
            continue
        found = next((a for a in aliases if a in df.columns), None)
        if found:
            renames[found] = standard
        elif strict:
            raise KeyError(f"No column for coordinate '{standard}' among {df.columns}")
    return df.withColumnsRenamed(renames)


def _checked(known: Column, units: Column, converted: Column) -> Column:
    message = F.concat(F.lit("unknown unit '"), F.coalesce(units, F.lit("")), F.lit("'"))
    return F.when(known.isNotNull(), converted).otherwise(F.raise_error(message).cast("double"))


def precipitation_mm_per_day(value: Column, units: Column) -> Column:
    key = F.lower(F.trim(units))
    factor = lookup(key, model.PRECIPITATION_UNITS)
    return _checked(factor, units, value * factor)


def temperature_celsius(value: Column, units: Column) -> Column:
    key = F.lower(F.trim(units))
    offset = lookup(key, model.TEMPERATURE_UNITS)
    return _checked(offset, units, value + offset)


def kelvin_to_celsius(value: Column, units: Column) -> Column:
    """Shift by the offset of a temperature unit; values in any other unit have none and stay."""
    return value + F.coalesce(lookup(F.lower(F.trim(units)), model.TEMPERATURE_UNITS), F.lit(0.0))


def convert_units(obs: DataFrame) -> DataFrame:
    """Bring ``value`` to mm/day or degrees Celsius by the row's ``units``; unknown units fail the job.

    Variables without a canonical unit pass through.
    """
    variable, value, units = F.col("variable"), F.col("value").cast("double"), F.col("units")
    value = F.nanvl(value, F.lit(None).cast("double"))
    converted = (
        F.when(variable == "pr", precipitation_mm_per_day(value, units))
        .when(variable.isin("tas", "tmax", "tmin"), temperature_celsius(value, units))
        .otherwise(value)
    )
    target = F.coalesce(lookup(variable, model.CANONICAL_UNITS), units)
    return obs.withColumn("value", converted).withColumn("units", target)


# Auxiliary variables that carry no observations.
AUXILIARY = ["time_bnds", "lat_bnds", "lon_bnds", "height", "crs"]


def is_auxiliary(name: str) -> bool:
    return "bnds" in name or "bounds" in name or name in AUXILIARY


def drop_bounds_variables(obs: DataFrame) -> DataFrame:
    name = F.col("variable")
    return obs.filter(~name.contains("bnds") & ~name.contains("bounds") & ~name.isin(AUXILIARY))


def keep_allowed(obs: DataFrame) -> DataFrame:
    return obs.filter(F.col("variable").isin(model.ALLOWED_VARIABLES))


def apply_scope(obs: DataFrame, scope: Scope) -> DataFrame:
    """Inclusive year range and box.  Plain comparisons, so they reach the scan; a stored ``year``
    partition column is used to skip whole directories."""
    if scope.start_year is not None:
        obs = obs.filter(F.col("date") >= F.make_date(F.lit(scope.start_year), F.lit(1), F.lit(1)))
    if scope.end_year is not None:
        obs = obs.filter(F.col("date") <= F.make_date(F.lit(scope.end_year), F.lit(12), F.lit(31)))
    if "year" in obs.columns:
        obs = year_window(obs, scope.start_year, scope.end_year, F.col("year"))
    for column, low, high in (("lat", scope.min_lat, scope.max_lat), ("lon", scope.min_lon, scope.max_lon)):
        if low is not None:
            obs = obs.filter(F.col(column) >= float(low))
        if high is not None:
            obs = obs.filter(F.col(column) <= float(high))
    return obs


def year_window(df: DataFrame, start: int | None, end: int | None, year: Column | None = None) -> DataFrame:
    """Inclusive window on the year of ``period`` (or a given year column)."""
    year = F.year("period") if year is None else year
    if start is not None:
        df = df.filter(year >= start)
    if end is not None:
        df = df.filter(year <= end)
    return df


def clamp_years(start: Column, end: Column, first: Column, last: Column) -> tuple[Column, Column]:
    """Requested years moved into the data's range; a start after the end fails."""
    lo, hi = F.greatest(start, first), F.least(end, last)
    checked = F.when(start <= end, lo).otherwise(F.raise_error(F.lit("start year is after end year")).cast("int"))
    return checked, hi


# Text that stands for "no name".
BLANK_NAMES = ["unknown", "unspecified", "n/a", "na", ""]


def display_name(standard_name: Column, long_name: Column, variable: Column) -> Column:
    """The standard name, else the long name, else the variable; blank or unknown-like text is passed over."""

    def valid(name: Column) -> Column:
        return F.when(~F.lower(F.trim(name)).isin(BLANK_NAMES), name)

    return F.coalesce(valid(standard_name), valid(long_name), variable)


def country_names(name: str) -> list[str]:
    return [name] + model.COUNTRY_ALIASES.get(name, [])
