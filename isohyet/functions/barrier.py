"""Keeping costly expressions from being copied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``df`` with the columns ``keep`` and the given ones, each evaluated once per row.

    A filter on a column is pushed below the projection that defines it by writing the definition into the
    filter, once per use: a test on a p-value would repeat the whole trend computation.  Passing the row
    through an explode of one element stops that.
    """
    row = F.struct(*[expression.alias(name) for name, expression in columns.items()])
    exploded = df.select(*keep, F.explode(F.array(row)).alias("_row"))
    return exploded.select(*keep, *[F.col(f"_row.{name}").alias(name) for name in columns])
