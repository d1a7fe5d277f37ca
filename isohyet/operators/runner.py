"""Computing a selection of indices from observations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet import model
from isohyet.model import INDICES, Baseline
from isohyet.operators import daily, events, months, spi
from isohyet.operators.thresholds import Record
from isohyet.session import settle
from isohyet.sources.obs import series_of


def plan_selection(selected: list[str] | None) -> tuple[dict[str, list[str]], list[int], list[str]]:
    """Selection -> daily indices by variable, SPI windows, raw variables.

    ``None`` selects every index.  Unknown names and unknown windows are passed over.  An event name alone
    brings its window along.
    """
    names = model.display_order() if selected is None else model.expand_selection(selected)
    by_variable: dict[str, list[str]] = {}
    for name in names:
        if name in INDICES:
            by_variable.setdefault(INDICES[name][0], []).append(name)
    windows = sorted({w for w in map(model.spi_window, names) if w})
    raw = [n for n in names if n in model.ALLOWED_VARIABLES or n == "tas"]
    return by_variable, windows, raw


def check_inputs(obs: DataFrame, by_variable: dict[str, list[str]], windows: list[int], raw: list[str]) -> None:
    """Name the first index whose variable is missing.  Reads the few distinct variable names."""
    present = {r[0] for r in obs.select("variable").distinct().collect()}
    needed = [(i, v) for v, names in by_variable.items() for i in names]
    needed += [(f"SPI{w}", "pr") for w in windows] + [(v, v) for v in raw]
    for index, variable in needed:
        if variable not in present:
            raise ValueError(f"{index} needs '{variable}', which the data lack")


def raw_values(obs: DataFrame, variable: str, freq: str) -> DataFrame:
    """A raw variable as an index: sums of precipitation, means of temperatures."""
    return _raw(daily.resample(series_of(obs, variable), variable, freq), variable, freq)


def _raw(table: DataFrame, variable: str, freq: str) -> DataFrame:
    return table.select(
        F.lit(variable).alias("index"), F.lit(freq).alias("freq"), "period", "cell_id", "value",
        F.lit(model.CANONICAL_UNITS[variable]).alias("units"),
    )


def compute_indices(
    obs: DataFrame,
    selected: list[str] | None = None,
    freqs: tuple[str, ...] = ("YS", "MS"),
    baseline: Baseline | None = None,
    spi_threshold: float = 1.0,
    missing: str | float = "any",
    record: Record | None = None,
    colocated: bool = False,
    with_events: bool = True,
) -> DataFrame:
    """``obs`` -> ``index_values`` for the selection: one pass per variable for the daily indices, and one of all for
    the monthly state, which is stored and gives raw values, SPI and the bounds of the record.

    SPI is monthly; its yearly drought and flood events come with the yearly pass.  ``with_events=False``
    leaves them out, for callers that store the SPI first and derive the events from the stored values.
    """
    by_variable, windows, raw = plan_selection(selected)
    known = {v: record for v in by_variable} if record is not None else {}
    bounded = [v for v, names in by_variable.items() if v not in known and any(n in daily.QUANTILES for n in names)]
    monthly = sorted({*(["pr"] if windows else []), *raw, *bounded})
    if monthly:
        # Read once for all windows, raw variables and frequencies, and for the bounds that percentiles need.
        state = settle(months.monthly_state(obs, monthly))
        if bounded:
            known |= months.records(state)
    tables = []
    for variable, names in by_variable.items():
        tables.append(daily.daily_index_values(
            series_of(obs, variable), names, freqs, baseline, missing, known.get(variable), colocated
        ))
    if windows:
        standardised = spi.spi_values(months.monthly_mean(state, "pr", missing), windows)
        tables.append(standardised)
        if "YS" in freqs and with_events:
            tables.append(events.event_values(standardised, spi_threshold))
    tables += [_raw(months.resampled(state, v, freq), v, freq) for v in raw for freq in freqs]
    if not tables:
        raise ValueError(f"no known index among {selected}")
    return reduce(DataFrame.unionByName, tables)
