"""Jobs a user runs: clip and clean, merge, full index run, one map on demand, preview of raw variables.

A job reads tables and writes tables.  What several outputs share - merged observations, index values, area
weights - is written once and read back, so a lost executor never costs more than the step at hand.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet import model
from isohyet.model import Baseline, Scope
from isohyet.operators import clean, events, grid, legend, maps, merge, profile, runner, series, spatial
from isohyet.operators.grid import Grid
from isohyet.sources import areas, attributes, manifest, obs as obs_source, sinks


CELL_OUTLINES = "cell_id bigint, area string, polygon bigint, coordinates array<array<array<double>>>"
KEYED = ", country string, layer string"
RUN = KEYED + ", setting string"
AREA_VALUES = "`index` string, freq string, period date, area string, value double"


@dataclass(frozen=True)
class Workspace:
    """What an index run needs to know besides the data."""

    country: str
    selected: list[str] | None = None
    baseline: Baseline | None = None
    spi_threshold: float = 1.0
    missing: str | float = "any"
    span: tuple[int, int] | None = None
    all_touched: bool = False  # also cells that an area meets at a line only


def layer_id(area_edges: DataFrame) -> str:
    """A name for the contents of an area layer, whatever their order.  One row to the driver."""
    sums = area_edges.agg(F.count("*"), F.sum(F.xxhash64(*sorted(area_edges.columns)).cast("decimal(38,0)"))).first()
    return f"{sums[0]}_{int(sums[1] or 0) % 2**64:016x}"


def setting(work: Workspace) -> Column:
    """What, besides country and layer, the values of ``index`` depend on: missing rule, baseline, threshold of events."""
    baseline = work.baseline
    years = "record" if baseline is None else f"{baseline.start_year}_{baseline.end_year}"
    text = F.concat(F.lit(f"missing_{work.missing}" + ("_touched" if work.all_touched else "")), F.when(
        F.col("index").isin([n for n, (_, _, needs) in model.INDICES.items() if needs]), F.lit(f"_baseline_{years}")
    ).otherwise(""))
    is_event = F.col("index").rlike("_(Drought|Flood)_")
    return F.concat(text, F.when(is_event, F.lit(f"_threshold_{float(work.spi_threshold)}")).otherwise(""))


def stored_values(spark: SparkSession, out: str, work: Workspace, layer: str, selected: list[str] | None) -> DataFrame:
    """The stored index values that belong to this country, layer, selection and settings; no others."""
    by_variable, windows, raw = runner.plan_selection(selected)
    names = {n for group in by_variable.values() for n in group} | set(raw) | {f"SPI{w}" for w in windows}
    names |= {e for w in windows for e in model.event_names(f"SPI{w}")}
    stored = _read(spark, f"{out}/index_values", model.INDEX_VALUES + RUN)
    own = (F.col("country") == work.country) & (F.col("layer") == layer) & (F.col("setting") == setting(work))
    return stored.filter(own & F.col("index").isin(sorted(names))).drop("country", "layer", "setting")


def _keyed(table: DataFrame, work: Workspace, layer: str) -> DataFrame:
    return table.withColumns({"country": F.lit(work.country), "layer": F.lit(layer)})


def clip_and_clean(
    spark: SparkSession, paths: str | list[str], units: dict[str, str], scope: Scope = Scope(), fmt: str = "parquet",
    described: str | list[str] | None = None, pattern: str | None = None,
) -> DataFrame:
    """Raw files -> cleaned observations within the scope.  Incompatible files fail the job.

    Every file under ``paths`` whose name fits the ``pattern`` (by default the format's extension) must be readable,
    whatever its years.  Folders ``described`` hold the files' attributes as sidecars; calendars and resolutions stated
    there count.
    """
    pattern = pattern or f"*.{fmt}"
    raw = obs_source.read_grid(
        spark, paths, units, fmt, only=list(model.ALLOWED_VARIABLES), tolerant=True, pattern=pattern
    )
    known = attributes.read_attributes(spark, described) if described else None
    listed = attributes.list_files(spark, paths, pattern)
    verdict = merge.check_compatibility(profile.file_profile(raw, known, listed=listed)).first()
    if not verdict["ok"]:
        raise ValueError(f"files cannot be merged: {', '.join(verdict['errors'])}")
    wanted = obs_source.read_grid(
        spark, paths, units, fmt, only=list(model.ALLOWED_VARIABLES), years=(scope.start_year, scope.end_year), pattern=pattern
    )
    return clean.apply_scope(clean.keep_allowed(wanted), scope)


def merge_files(
    obs: DataFrame, path: str, step: str | None = None, table: str | None = None, buckets: int = 200
) -> DataFrame:
    """Cleaned observations -> the merged dataset at ``path``, calendar complete.  Returns its mode row.

    With ``table``, the dataset becomes a catalogue table of that name, bucketed by cell; choose ``buckets``
    so that one bucket of one variable is a convenient file.
    """
    mode = merge.detect_mode(merge.file_variables(obs))
    merged = merge.merge(obs, fill=True, step=step)
    if table is None:
        sinks.write_obs(merged, path)
    else:
        sinks.save_obs_table(merged, table, path, buckets)
    return mode


def open_obs(spark: SparkSession, source: str, bucketed: bool) -> DataFrame:
    return spark.table(source) if bucketed else obs_source.read_obs(spark, source)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def index_run(
    spark: SparkSession, source: str, area_edges: DataFrame, out: str, work: Workspace, bucketed: bool = False
) -> None:
    """Everything for one country: outline, indices, area means, maps, series.

    ``source`` is the path of the merged dataset, or with ``bucketed`` the name of its table.  On a bucketed
    table neither the clip to the areas nor the indices shuffle the observations.

    Written under ``out``: boundary, cell_area, cell_outlines, uncovered_areas, index_values, area_values, maps,
    maps_metadata, series and series_metadata, and the manifest of what is finished.  All but the boundary are kept by
    country and layer, values, maps and series also by their settings, and a run writes and reads only its own, so runs
    for other countries, layers, selections, baselines or thresholds stay as they are.
    """
    observed = open_obs(spark, source, bucketed)
    by_variable, windows, raw = runner.plan_selection(work.selected)
    runner.check_inputs(observed, by_variable, windows, raw)

    sinks.write_boundary(area_edges, f"{out}/boundary")
    layer, name = areas.with_overview(area_edges), layer_id(area_edges)
    cells = grid.prepare(obs_source.cells_of(observed))
    place_cells(cells, layer, out, work, name)
    clipped = _clipped(observed, layer, out, work, name, cells)
    values = runner.compute_indices(
        clipped, work.selected, ("YS", "MS"), work.baseline, missing=work.missing, colocated=bucketed,
        with_events=False,
    )
    write_values(values, out, work, name)
    if windows:
        # Events are found in the stored SPI rather than in a second computation of it.
        stored = stored_values(spark, out, work, name, [f"SPI{w}" for w in windows])
        base = stored.filter((F.col("freq") == "MS") & F.col("index").isin([f"SPI{w}" for w in windows]))
        write_values(events.event_values(base, work.spi_threshold), out, work, name)
    record_values(spark, out, work, name, work.selected)
    write_outputs(spark, layer, out, work, name)


def _clipped(observed: DataFrame, layer: DataFrame, out: str, work: Workspace, name: str, cells: Grid | None = None) -> DataFrame:
    """The observations of the cells that belong to the whole layer by the run's rule."""
    held = _placed(observed.sparkSession, f"{out}/cell_area", model.CELL_AREA, work, name)
    if work.all_touched:
        cells = cells or grid.prepare(obs_source.cells_of(observed))
        held = spatial.touched_cells(cells, layer.filter(F.col("area") == model.OVERVIEW), held.filter(F.col("area") == model.OVERVIEW))
    return spatial.clip(observed, held, model.OVERVIEW)


def write_values(values: DataFrame, out: str, work: Workspace, layer: str) -> None:
    keyed = _keyed(values, work, layer).withColumn("setting", setting(work))
    sinks.write_index_values(keyed, f"{out}/index_values", "country", "layer", "setting")


def record_values(spark: SparkSession, out: str, work: Workspace, layer: str, selected: list[str] | None) -> None:
    """Notes which of the selected indices are stored, and at which frequency."""
    there = stored_values(spark, out, work, layer, selected).select("index", F.col("freq").alias("span")).distinct()
    manifest.record(_keyed(there, work, layer).withColumn("setting", setting(work)), manifest.VALUES, out)


def place_cells(cells: Grid, layer: DataFrame, out: str, work: Workspace, name: str) -> None:
    """Area weights and cut outlines of the cells, once for all indices and maps."""
    sinks.write_table(_keyed(spatial.cell_area(cells, layer), work, name), f"{out}/cell_area", "country", "layer")
    # A cell that only touches an area, or lies in a hole of it, has an outline but no share.
    covered = _placed(layer.sparkSession, f"{out}/cell_area", model.CELL_AREA, work, name).select("cell_id", "area")
    outlines = sinks.cell_outlines(spatial.overlay(cells, layer)).join(covered, ["cell_id", "area"], "left_semi")
    sinks.write_table(_keyed(outlines, work, name), f"{out}/cell_outlines", "country", "layer")
    # Areas too small for the grid have no output; they are listed instead.
    without = spatial.uncovered_areas(layer, covered)
    sinks.write_table(_keyed(without, work, name), f"{out}/uncovered_areas", "country", "layer")
    manifest.record(_own(layer.sparkSession, work, name), manifest.CELLS, out)


def _own(spark: SparkSession, work: Workspace, layer: str, *indices: str) -> DataFrame:
    """What this run calls its own: country and layer, and for each index its setting."""
    table = _keyed(spark.createDataFrame([(i,) for i in indices] or [("",)], "`index` string"), work, layer)
    return table.withColumn("setting", setting(work)) if indices else table


def _placed(spark: SparkSession, path: str, schema: str, work: Workspace, layer: str) -> DataFrame:
    own = (F.col("country") == work.country) & (F.col("layer") == layer)
    return _read(spark, path, schema + KEYED).filter(own).drop("country", "layer")


def write_outputs(spark: SparkSession, layer: DataFrame, out: str, work: Workspace, name: str) -> None:
    """Maps and series from this run's stored index values and weights."""
    values = stored_values(spark, out, work, name, work.selected)
    weights = _placed(spark, f"{out}/cell_area", model.CELL_AREA, work, name)
    means = _keyed(spatial.area_mean(values, weights), work, name).withColumn("setting", setting(work))
    sinks.write_table(means, f"{out}/area_values", "country", "layer", "setting", "freq", "index")
    own = (F.col("country") == work.country) & (F.col("layer") == name) & (F.col("setting") == setting(work))
    selected = [r[0] for r in values.select("index").distinct().collect()]  # names out of the catalogue
    means = _read(spark, f"{out}/area_values", AREA_VALUES + RUN).filter(own & F.col("index").isin(selected))
    means = means.drop("country", "layer", "setting")

    write_maps(spark, values, means, layer, out, work, name)
    owner = [F.lit(work.country).alias("country"), F.lit(name).alias("layer"), setting(work).alias("setting")]
    chartable = ~F.col("index").rlike("_(Drought|Flood)_")
    yearly = means.filter(chartable & (F.col("freq") == "YS"))
    # SPI exists monthly only; its yearly series is the mean of its months.
    spi = means.filter(chartable & (F.col("freq") == "MS") & F.col("index").startswith("SPI"))
    sinks.write_series(series.yearly_series(yearly.unionByName(spi)).select("*", *owner), f"{out}/series/annual")
    monthly = means.filter(chartable & (F.col("freq") == "MS"))
    sinks.write_series(series.monthly_series(monthly).select("*", *owner), f"{out}/series/seasonal")
    units = F.broadcast(model.catalogue(spark).select("index", "units"))  # 65 fixed rows
    methods = F.when(F.col("freq") == "YS", "annual mean").otherwise("seasonal cycle")
    metadata = maps.span(means.filter(chartable), ("area", "index", "freq")).join(units, "index", "left").select(
        *owner, "area", "index", "freq", "units", methods.alias("method"), "start_date", "end_date",
        F.array("first_year", "last_year").alias("years"),
    )
    sinks.write_metadata(metadata, f"{out}/series_metadata", [*sinks.SERIES_KEYS, "freq"])
    manifest.record(_own(spark, work, name, *selected), manifest.SERIES, out)


def _spanned(table: DataFrame, years: DataFrame, work: Workspace) -> DataFrame:
    """Attach the span of years that names a map, with the threshold for events."""
    threshold = F.when(
        F.col("index").rlike("_(Drought|Flood)_"), F.lit(f"_{float(work.spi_threshold)}")
    ).otherwise("")
    if work.span is not None:
        return table.withColumn("span", F.concat(F.lit(sinks.span_name(*work.span)), threshold))
    named = years.select(
        "index", F.concat_ws("_", F.col("first_year"), F.col("last_year")).alias("years")
    )
    return table.join(named, "index").withColumn("span", F.concat("years", threshold)).drop("years")


def write_maps(
    spark: SparkSession, values: DataFrame, means: DataFrame, layer: DataFrame, out: str, work: Workspace, name: str
) -> None:
    """Actual and trend maps of cells (cut to their area) and of areas, with a metadata sidecar."""
    first, last = work.span or (None, None)

    def mappable(table: DataFrame) -> DataFrame:
        """Yearly values, and the monthly SPI that has no yearly form."""
        monthly_spi = (F.col("freq") == "MS") & F.col("index").rlike(r"^SPI\d+$")
        return clean.year_window(table.filter((F.col("freq") == "YS") | monthly_spi), first, last)

    def trend_table(table: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        eligible = maps.with_trend_support(table)
        parts = [
            maps.trend(eligible.filter(F.col("freq") == freq), keys, freq=freq) for freq in ("YS", "MS")
        ]
        return reduce(DataFrame.unionByName, parts)

    cell_values, area_values = mappable(values), mappable(means)
    years = maps.span(cell_values)
    outlines = _placed(spark, f"{out}/cell_outlines", CELL_OUTLINES, work, name)
    owner = [F.lit(work.country).alias("country"), F.lit(name).alias("layer"), setting(work).alias("setting")]

    def cell_map(table: DataFrame, mode: str, properties: list[str]) -> DataFrame:
        cut = sinks.cut_features(table, outlines, properties)
        return _spanned(cut, years, work).select(
            *owner, "area", "index", F.lit("maps_grid").alias("style"), F.lit(mode).alias("mode"), "span", "feature"
        )

    def area_map(table: DataFrame, mode: str, properties: list[str]) -> DataFrame:
        table = table.filter(F.col("area") != model.OVERVIEW)
        drawn = sinks.area_features(table, layer, properties)
        return _spanned(drawn, years, work).select(
            *owner, F.lit(model.OVERVIEW).alias("area"), "index", F.lit("maps_shp").alias("style"),
            F.lit(mode).alias("mode"), "span", "feature",
        )

    trend_properties = ["slope", "p", "trend"]
    features = [
        cell_map(maps.actual(cell_values, ("cell_id",)), "actual", ["value"]),
        cell_map(trend_table(cell_values, ("cell_id",)), "trend", trend_properties),
        area_map(maps.actual(area_values, ("area",)), "actual", ["value"]),
        area_map(trend_table(area_values, ("area",)), "trend", trend_properties),
    ]
    sinks.write_map(reduce(DataFrame.unionByName, features), f"{out}/maps")
    units = F.broadcast(model.catalogue(spark).select("index", "units"))  # 65 fixed rows
    is_event = F.col("index").rlike("_(Drought|Flood)_")
    # One row for each map: grid maps of every area, shape maps of the whole, trends where the index allows them.
    has_trend = model.catalogue(spark).filter("supports_trend").select(F.col("index").alias("trended"))
    modes = years.join(F.broadcast(has_trend), F.col("index") == F.col("trended"), "left").withColumn(
        "mode", F.explode(F.when(F.col("trended").isNull(), F.array(F.lit("actual"))).otherwise(
            F.array(F.lit("actual"), F.lit("trend"))))).drop("trended")
    drawn = area_values.select("index", "area").distinct().withColumn("style", F.explode(F.when(
        F.col("area") == model.OVERVIEW, F.array(F.lit("maps_grid"), F.lit("maps_shp"))).otherwise(F.array(F.lit("maps_grid")))))
    metadata = _spanned(modes.join(drawn, "index").join(units, "index", "left"), years, work).select(
        *owner, "area", "index", "style", "mode", "span", "units", "start_date", "end_date",
        F.array("first_year", "last_year").alias("years"),
        F.when(F.col("mode") == "trend", F.lit("Mann-Kendall")).alias("trend_method"),
        F.when(is_event, F.lit(float(work.spi_threshold))).alias("spi_threshold"),
        F.lit(None if work.baseline is None else f"{work.baseline.start_year}-{work.baseline.end_year}").cast("string").alias("baseline"),
    )
    sinks.write_metadata(metadata, f"{out}/maps_metadata", sinks.MAP_KEYS)
    manifest.record(_spanned(years, years, work).select(*owner, "index", "span"), manifest.MAP, out)


def on_demand_map(
    spark: SparkSession, source: str, area_edges: DataFrame, out: str, index: str, span: tuple[int, int],
    work: Workspace, bucketed: bool = False,
) -> bool:
    """The maps of one index over a span of years; nothing is done when they are already there.

    Values that an index run has stored under the same country, layer and settings are used as they are.
    """
    name = layer_id(area_edges)
    if _lacking_maps(spark, out, [index], span, work, name).isEmpty():
        return False
    layer = areas.with_overview(area_edges)
    if not manifest.lacking(_own(spark, work, name), manifest.CELLS, out).isEmpty():
        observed = open_obs(spark, source, bucketed)
        place_cells(grid.prepare(obs_source.cells_of(observed)), layer, out, work, name)
    weights = _placed(spark, f"{out}/cell_area", model.CELL_AREA, work, name)

    # Base SPI has monthly values only.
    freq = "MS" if model.spi_window(index) is not None and "_" not in index else "YS"
    if not manifest.lacking(_own(spark, work, name, index).withColumn("span", F.lit(freq)), manifest.VALUES, out).isEmpty():
        clipped = _clipped(open_obs(spark, source, bucketed), layer, out, work, name)
        values = runner.compute_indices(
            clipped, [index], ("YS",), work.baseline, work.spi_threshold, work.missing, colocated=bucketed
        ).filter(F.col("index") == index)
        write_values(values, out, work, name)
        record_values(spark, out, work, name, [index])
    mine = stored_values(spark, out, work, name, [index]).filter(F.col("index") == index)
    stored = mine.filter((F.col("freq") == "YS") | F.col("index").rlike(r"^SPI\d+$"))
    write_maps(spark, stored, spatial.area_mean(stored, weights), layer, out, replace(work, span=span), name)
    return True


def _lacking_maps(
    spark: SparkSession, out: str, indices: list[str], span: tuple[int, int], work: Workspace, layer: str
) -> DataFrame:
    """Those of the indices whose maps of this span, country, layer and setting are not finished."""
    wanted = _own(spark, work, layer, *indices)
    return manifest.lacking(_spanned(wanted, wanted, replace(work, span=span)), manifest.MAP, out)


def preview(
    spark: SparkSession, source: str, area_edges: DataFrame, out: str, work: Workspace, bucketed: bool = False
) -> bool:
    """Maps and series of the raw variables; a variable whose maps of all years are finished is left out."""
    observed = open_obs(spark, source, bucketed)
    facts = observed.groupBy("variable").agg(F.min(F.year("date")).alias("first"), F.max(F.year("date")).alias("last")).collect()
    ends = {r["variable"]: (r["first"], r["last"]) for r in facts}  # a few variables
    span = work.span or (min((a for a, _ in ends.values()), default=0), max((b for _, b in ends.values()), default=0))
    there = [v for v in model.ALLOWED_VARIABLES if v in ends]
    lacking = {r["index"] for r in _lacking_maps(spark, out, there, span, work, layer_id(area_edges)).collect()} if there else set()
    if not lacking:
        return False
    index_run(spark, source, area_edges, out, replace(work, selected=[v for v in there if v in lacking]), bucketed)
    return True


def dashboard(
    area_values: DataFrame, index: str, area: str, start_year: int, end_year: int, window: int = 21,
    threshold: float = 1.0,
) -> dict[str, DataFrame]:
    """What a chart page of one index and area shows: annual values with their moving average, the monthly
    climatology with its axis, and for a base SPI the months labelled drought, wet or neutral."""
    chosen = area_values.filter((F.col("index") == index) & (F.col("area") == area))
    is_spi = model.spi_window(index) is not None
    yearly = series.yearly_series(chosen.filter(F.col("freq") == ("MS" if is_spi else "YS")))
    monthly = series.monthly_series(chosen.filter(F.col("freq") == "MS"))
    climatology = series.monthly_climatology(monthly, start_year=start_year, end_year=end_year)
    windowed = clean.year_window(yearly, start_year, end_year, F.col("year"))
    views = {"annual": series.moving_average(windowed, window=window), "climatology": climatology}
    if is_spi:
        views["axis"] = legend.symmetric_axis(climatology)
        # Runs are found in the whole record first; the years shown are cut out afterwards.
        labelled = events.classify_months(chosen.filter(F.col("freq") == "MS"), ("index", "area"), threshold)
        views["months"] = clean.year_window(labelled, start_year, end_year)
    return views
