"""Stored precision of outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_value(index: Column, value: Column) -> Column:
    """Two decimals, except base SPI and its peak and severity, which keep four."""
    fine = index.contains("SPI") & ~index.contains("Frequency") & ~index.contains("Duration")
    return F.when(fine, F.round(value, 4)).otherwise(F.round(value, 2))


def round_p(p: Column) -> Column:
    return F.round(p, 3)


def snap(coordinate) -> Column:
    """Map vertices are stored on a 0.001 degree lattice."""
    return F.round(coordinate, 3)
