"""What profiles, modes and steps need to know of observations, gathered in one scan and stored.

The distinct variables, coordinates and dates of each file are few; they come from one aggregation over grouping sets
with partial sums, and summaries of parts can be united and summarised again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.session import settle

FACTS = ["variable", "lat", "lon", "date"]


def summarise(obs: DataFrame) -> DataFrame:
    """``src, variable, lat, lon, date``: one row per file and distinct value of each of the four, the others null."""
    grouped = obs.select("src", *FACTS).groupingSets([["src", fact] for fact in FACTS], "src", *FACTS)
    return settle(grouped.agg(F.count("*").alias("rows")).drop("rows"))


def cells_and_dates(obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct ``variable, cell_id, lat, lon`` and the distinct ``date`` of observations, in one scan."""
    place = ["variable", "cell_id", "lat", "lon"]
    grouped = obs.select(*place, "date").groupingSets([place, ["date"]], *place, "date")
    both = settle(grouped.agg(F.grouping("date").alias("is_cell")))
    return both.filter("is_cell = 1").select(*place), both.filter("is_cell = 0").select("date")
