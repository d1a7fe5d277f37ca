import datetime
import json
import math
import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from isohyet.model import Baseline, Scope
from isohyet.operators import clean, merge, profile, runner, spatial, summary
from isohyet.plans import jobs
from isohyet.sources import areas, attributes, manifest, obs
from conftest import explain
from isohyet.streaming.ingest import ingest_new_files, merge_new_files

UNITS = {"pr": "mm/s", "tmax": "K", "tmin": "K"}


def raw(spark, first, last, lats=(10.0, 11.0), lons=(100.0, 101.0, 102.0)):
    """Daily grids as a provider might deliver them."""
    axes = spark.range(1).select(F.explode(F.expr(f"sequence(date'{first}', date'{last}')")).alias("d"))
    cells = spark.createDataFrame([(lat, lon) for lat in lats for lon in lons], "lat double, lon double")
    n = F.dayofyear("d") * 7 + F.col("lat") * 3 + F.col("lon") + F.year("d")
    wave = F.sin(n)
    return axes.join(cells).select(
        F.date_format("d", "yyyy-MM-dd 12:00:00").alias("valid_time"), "lat", "lon",
        (F.greatest(wave * 20, F.lit(0.0)) / 86400).alias("tp"), (wave * 8 + 298.15).alias("tasmax"),
        (wave * 8 + 288.15).alias("TASMIN"), F.lit(2.0).alias("height"),
    )


LAYER = {"type": "FeatureCollection", "features": [
    {"type": "Feature", "properties": {"name": name}, "geometry": {"type": "Polygon", "coordinates": [ring]}}
    for name, ring in (
        ("west", [[99.5, 9.5], [101, 9.5], [101, 11.5], [99.5, 11.5], [99.5, 9.5]]),
        ("east", [[101, 9.5], [102.0, 9.5], [102.0, 11.5], [101, 11.5], [101, 9.5]]),
        ("far", [[0, 0], [1, 0], [1, 1], [0, 0]]),
    )
]}


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    for first, last in (("2000-01-01", "2001-12-31"), ("2002-01-01", "2003-12-31")):
        raw(spark, first, last).write.parquet(str(folder / f"grid_{first[:4]}.parquet"))
    layer = folder / "layer.geojson"
    layer.write_text(json.dumps(LAYER))
    return folder


@pytest.fixture(scope="module")
def merged(spark, files):
    paths = [str(files / f"grid_{y}.parquet") for y in (2000, 2002)]
    cleaned = jobs.clip_and_clean(spark, paths, UNITS, Scope(2000, 2003))
    out = str(files / "merged")
    mode = jobs.merge_files(cleaned, out).first()
    assert mode.mode == "time" and mode.variables == ["pr", "tmax", "tmin"]
    return out


def test_cleaned_and_merged(spark, merged):
    table = obs.read_obs(spark, merged)
    assert table.groupBy("variable").count().collect().__len__() == 3
    assert table.count() == 3 * 6 * 1461
    hot = table.filter("variable = 'tmax'").agg(F.max("value"), F.min("value")).first()
    assert 32.9 < hot[0] <= 33.0 and 17.0 <= hot[1] < 17.1
    assert table.select("cell_id").distinct().count() == 6


def test_csv_grid(spark, files, tmp_path):
    path = str(tmp_path / "csv")
    raw(spark, "2000-01-01", "2000-01-10").withColumnRenamed("valid_time", "time").coalesce(1).write.option("header", True).csv(path)
    table = obs.read_grid(spark, path, UNITS, "csv")
    assert table.filter("variable = 'pr'").count() == 60
    assert table.filter("variable = 'pr'").agg(F.max("value")).first()[0] == pytest.approx(20, abs=0.5)
    bad = str(tmp_path / "bad")
    raw(spark, "2000-01-01", "2000-01-02").write.option("header", True).csv(bad)
    with pytest.raises(ValueError, match="time"):
        obs.read_grid(spark, bad, UNITS, "csv")
    with pytest.raises(ValueError, match="unsupported"):
        obs.read_grid(spark, bad, UNITS, "grib")


def test_incompatible_files_are_refused(spark, files, tmp_path):
    path = str(tmp_path / "coarse.parquet")
    raw(spark, "2000-01-01", "2000-01-02", lats=(10.0, 12.0)).write.parquet(path)
    with pytest.raises(ValueError, match="different resolutions"):
        jobs.clip_and_clean(spark, [str(files / "grid_2000.parquet"), path], UNITS)


@pytest.fixture(scope="module")
def run(spark, merged, files):
    out = str(files / "out")
    edges = areas.read_areas(spark, str(files / "layer.geojson"), "name")
    work = jobs.Workspace("Testland", ["PRCPTOT", "TXx", "TX90p", "CDD", "SPI3"], Baseline(2000, 2002), 0.5)
    jobs.index_run(spark, merged, edges, out, work)
    return out, edges, work


def test_index_run_tables(spark, run):
    out, _, _ = run
    values = spark.read.parquet(f"{out}/index_values")
    names = {r[0] for r in values.select("index").distinct().collect()}
    assert {"PRCPTOT", "TXx", "TX90p", "CDD", "SPI3", "SPI3_Drought_Peak", "SPI3_Flood_Frequency"} <= names
    assert values.filter("`index` = 'TXx' and freq = 'MS'").count() == 6 * 48
    means = spark.read.parquet(f"{out}/area_values")
    assert {r[0] for r in means.select("area").distinct().collect()} == {"west", "east", "overview"}
    joined = means.filter("freq = 'YS' and `index` = 'TXx'").groupBy("period").pivot("area").agg(F.first("value"))
    # west covers 3 square degrees, east 2; the whole is their weighted mean.
    for r in joined.collect():
        assert r.overview == pytest.approx((3 * r.west + 2 * r.east) / 5)


def read_features(spark, out):
    table = spark.read.option("pathGlobFilter", "*.txt").text(f"{out}/maps")
    return [(r.area, r["index"], r["style"], r["mode"], str(r["span"]), json.loads(r["value"])) for r in table.collect()]


def test_index_run_maps(spark, run):
    out, _, _ = run
    features = read_features(spark, out)
    spans = {f[4] for f in features if f[1] == "PRCPTOT"}
    assert spans == {"2000_2003"}
    assert {f[4] for f in features if f[1] == "SPI3_Flood_Peak"} == {"2000_2003_0.5"}
    actual = [f for f in features if f[1:4] == ("PRCPTOT", "maps_grid", "actual")]
    assert {f[0] for f in actual} == {"west", "east", "overview"}
    for f in actual:
        ring = f[5]["geometry"]["coordinates"][0]
        assert ring[0] == ring[-1] and all(99.5 <= x <= 102.0 and 9.5 <= y <= 11.5 for x, y in ring)
    assert len([f for f in actual if f[0] == "west"]) == 4
    # No trend maps of event frequencies; trends carry slope and p, events a direction.
    assert not [f for f in features if f[1].endswith("Frequency") and f[3] == "trend"]
    trends = [f[5]["properties"] for f in features if f[3] == "trend" and f[1] == "TXx"]
    assert trends and all({"slope", "p"} <= set(p) and "trend" not in p for p in trends)
    shapes = [f for f in features if f[2] == "maps_shp" and f[1] == "TXx" and f[3] == "actual"]
    assert {f[5]["properties"]["name"] for f in shapes} == {"west", "east"}


def test_index_run_series_and_metadata(spark, run):
    out, _, _ = run
    annual = spark.read.json(f"{out}/series/annual")
    assert {r[0] for r in annual.select("index").distinct().collect()} == {"PRCPTOT", "TXx", "TX90p", "CDD", "SPI3"}
    assert annual.filter("area = 'overview' and `index` = 'CDD'").count() == 4
    seasonal = spark.read.json(f"{out}/series/seasonal")
    assert seasonal.filter("area = 'west' and `index` = 'SPI3'").count() == 46
    meta = spark.read.json(f"{out}/maps_metadata").filter("`index` = 'TXx'").first()
    assert meta.units == "C" and meta.years == [2000, 2003] and meta.start_date == "2000-01-01"


def test_boundary_and_series_metadata(spark, run):
    out, _, _ = run
    outline = [json.loads(r.value) for r in spark.read.text(f"{out}/boundary").collect()]
    assert {f["properties"]["name"] for f in outline} == {"west", "east", "far"}
    meta = {(r["index"], r.method) for r in spark.read.json(f"{out}/series_metadata").collect()}
    assert ("TXx", "annual mean") in meta and ("SPI3", "seasonal cycle") in meta


def test_dashboard(spark, run):
    out, _, _ = run
    means = spark.read.parquet(f"{out}/area_values")
    views = jobs.dashboard(means, "SPI3", "west", 2001, 2002, 3, 0.5)
    assert views["months"].count() == 24 and views["annual"].count() == 2
    assert views["climatology"].count() == 12 and views["axis"].count() == 1
    plain = jobs.dashboard(means, "CDD", "overview", 2000, 2003, 3)
    assert set(plain) == {"annual", "climatology"} and plain["annual"].count() == 4


def test_index_run_on_a_bucketed_table(spark, merged, files, run):
    """The same values, and no shuffle of the observations on the way to a spell index."""
    out, edges, work = run
    cleaned = obs.read_obs(spark, merged).drop("year")
    jobs.merge_files(cleaned, str(files / "bucketed"), "D", "merged_obs", 4)
    again = str(files / "out_bucketed")
    jobs.index_run(spark, "merged_obs", edges, again, work, bucketed=True)
    keys = ["index", "freq", "period", "cell_id", "value"]
    one, two = (spark.read.parquet(f"{o}/index_values").select(*keys) for o in (out, again))
    rounded = [t.withColumn("value", F.round("value", 9)) for t in (one, two)]
    assert rounded[0].exceptAll(rounded[1]).isEmpty() and rounded[1].exceptAll(rounded[0]).isEmpty()

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        weights = spark.read.parquet(f"{out}/cell_area")
        clipped = spatial.clip(jobs.open_obs(spark, "merged_obs", True), weights, "overview")
        values = runner.compute_indices(clipped, ["CDD", "Rx5day"], ("YS", "MS"), colocated=True)
        plan = values._jdf.queryExecution().executedPlan().toString()
        # The weights are shuffled to the buckets; the observations stay where they are.
        assert plan.count("Exchange") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.sql("drop table merged_obs")


def test_on_demand_map_is_made_once(spark, merged, run):
    out, edges, work = run
    assert jobs.on_demand_map(spark, merged, edges, out, "TXx", (2001, 2003), work)
    spans = {f[4] for f in read_features(spark, out) if f[1] == "TXx"}
    assert spans == {"2000_2003", "2001_2003"}
    assert not jobs.on_demand_map(spark, merged, edges, out, "TXx", (2001, 2003), work)
    # An event can be asked for by its own name.
    assert jobs.on_demand_map(spark, merged, edges, out, "SPI3_Flood_Peak", (2000, 2001), work)


def test_another_baseline_or_layer_gets_maps_of_its_own(spark, merged, run):
    out, edges, work = run
    span = (2001, 2002)
    assert jobs.on_demand_map(spark, merged, edges, out, "TX90p", span, work)
    assert not jobs.on_demand_map(spark, merged, edges, out, "TX90p", span, work)
    other = replace(work, baseline=Baseline(2001, 2003))
    assert jobs.on_demand_map(spark, merged, edges, out, "TX90p", span, other)
    west = edges.filter("area = 'west'")
    assert jobs.on_demand_map(spark, merged, west, out, "TX90p", span, work)
    assert not jobs.on_demand_map(spark, merged, west, out, "TX90p", span, work)
    # An index without a baseline has the same setting under both, and its map is there.
    assert jobs.on_demand_map(spark, merged, edges, out, "CDD", span, work)
    assert not jobs.on_demand_map(spark, merged, edges, out, "CDD", span, other)
    maps = spark.read.text(f"{out}/maps").filter("`index` = 'TX90p' and span = '2001_2002' and style = 'maps_grid' and mode = 'actual' and area = 'overview'")
    per_map = {(r.layer, r.setting): r.n for r in maps.groupBy("layer", "setting").agg(F.count("*").alias("n")).collect()}
    assert len(per_map) == 3 and sorted(per_map.values()) == [4, 6, 6]


def test_a_map_that_was_not_finished_is_made_again(spark, merged, run, tmp_path):
    out, edges, work = str(tmp_path / "half"), run[1].filter("area = 'west'"), run[2]
    assert jobs.on_demand_map(spark, merged, edges, out, "TXx", (2001, 2002), work)
    before = read_features(spark, out)
    noted = spark.read.parquet(manifest.path(out)).filter("kind <> 'map'").collect()
    elsewhere = manifest.path(str(tmp_path / "kept"))
    spark.createDataFrame(noted, manifest.SCHEMA).write.parquet(elsewhere)  # as if the job had died before it was done
    spark.read.parquet(elsewhere).write.mode("overwrite").parquet(manifest.path(out))
    assert jobs.on_demand_map(spark, merged, edges, out, "TXx", (2001, 2002), work)
    assert not jobs.on_demand_map(spark, merged, edges, out, "TXx", (2001, 2002), work)
    assert sorted(map(str, read_features(spark, out))) == sorted(map(str, before))


def test_small_areas_are_reported_and_series_belong_to_a_layer(spark, run):
    out, edges, work = run
    assert [r.area for r in spark.read.parquet(f"{out}/uncovered_areas").collect()] == ["far"]
    annual = spark.read.json(f"{out}/series/annual").filter("`index` = 'CDD'")
    assert {(r.layer, r.setting) for r in annual.select("layer", "setting").distinct().collect()} == {(jobs.layer_id(edges), "missing_any")}


def test_metadata_survives_an_on_demand_map(spark, run):
    out, _, _ = run
    meta = spark.read.json(f"{out}/maps_metadata").filter("`index` = 'TXx' and area = 'overview' and mode = 'actual'")
    assert {r.span for r in meta.collect()} == {"2000_2003", "2001_2003"}
    assert spark.read.json(f"{out}/maps_metadata").filter("`index` = 'PRCPTOT'").count() > 0


def test_runs_do_not_touch_each_other(spark, merged, files):
    """Another threshold, another selection and another layer leave what is stored as it is."""
    out = str(files / "several")
    edges = areas.read_areas(spark, str(files / "layer.geojson"), "name")
    first = jobs.Workspace("Testland", ["SPI3"], spi_threshold=1.0)
    jobs.index_run(spark, merged, edges.filter("area <> 'far'"), out, first)

    def durations(span):
        features = read_features(spark, out)
        found = [f[5]["properties"] for f in features if f[1] == "SPI3_Flood_Duration" and f[4] == span and f[3] == "actual" and f[2] == "maps_grid"]
        return sorted(str(p) for p in found)

    before = durations("2000_2003_1.0")
    jobs.index_run(spark, merged, edges.filter("area = 'west'"), out, jobs.Workspace("Westland", ["CDD", "SPI3"], spi_threshold=0.5))
    assert before and durations("2000_2003_1.0") == before
    low = durations("2000_2003_0.5")
    fresh = str(files / "fresh")
    jobs.index_run(spark, merged, edges.filter("area = 'west'"), fresh, jobs.Workspace("Westland", ["SPI3"], spi_threshold=0.5))
    alone = [f[5]["properties"] for f in read_features(spark, fresh) if f[1] == "SPI3_Flood_Duration" and f[3] == "actual" and f[2] == "maps_grid"]
    assert low == sorted(str(p) for p in alone)
    areas_of = lambda country: {r.area for r in spark.read.json(f"{out}/series/annual").filter(F.col("country") == country).select("area").distinct().collect()}
    assert areas_of("Testland") == {"west", "east", "overview"} and areas_of("Westland") == {"overview"}
    # A map on demand for the second country uses its own layer.
    assert jobs.on_demand_map(spark, merged, edges.filter("area = 'west'"), out, "CDD", (2001, 2002), jobs.Workspace("Westland"))
    maps = spark.read.text(f"{out}/maps").filter("country = 'Westland' and `index` = 'CDD'")
    assert {r.area for r in maps.select("area").distinct().collect()} == {"overview"}


def test_reader_leaves_auxiliary_columns_alone(spark, tmp_path):
    path = str(tmp_path / "odd")
    table = raw(spark, "2000-01-01", "2001-12-31").select(
        "*", F.lit("EPSG:4326").alias("crs"), F.array(F.lit(1.0), F.lit(2.0)).alias("time_bnds"), F.lit(3.0).alias("wind"))
    table.write.parquet(path)
    read = obs.read_grid(spark, path, UNITS, only=["pr", "tmax"], years=(2001, 2001))
    assert read.count() == 2 * 6 * 365
    schema = [line for line in explain(read).splitlines() if "ReadSchema" in line]
    assert schema and all(name not in line for line in schema for name in ("height", "wind", "crs", "time_bnds", "TASMIN"))
    assert any("GreaterThanOrEqual(valid_time,2001" in line for line in explain(read).splitlines() if "PushedFilters" in line)


def test_preview(spark, merged, files):
    out = str(files / "preview")
    edges = areas.read_areas(spark, str(files / "layer.geojson"), "name").filter("area = 'west'")
    assert jobs.preview(spark, merged, edges, out, jobs.Workspace("Testland"))
    assert not jobs.preview(spark, merged, edges, out, jobs.Workspace("Testland"))
    features = read_features(spark, out)
    assert {f[1] for f in features} == {"pr", "tmax", "tmin"} and {f[3] for f in features} == {"actual"}
    # A single area brings no sub-area outputs.
    assert {f[0] for f in features} == {"overview"}


def test_runner_names_the_index_that_lacks_its_variable(spark, merged):
    table = obs.read_obs(spark, merged).filter("variable = 'pr'")
    by_variable, windows, raw_names = runner.plan_selection(["CDD", "TXx"])
    with pytest.raises(ValueError, match="TXx needs"):
        runner.check_inputs(table, by_variable, windows, raw_names)
    with pytest.raises(ValueError, match="no known index"):
        runner.compute_indices(table, ["SPI7", "nothing"])


def test_runner_computes_everything(spark, merged):
    table = obs.read_obs(spark, merged)
    values = runner.compute_indices(table, None, ("YS",))
    names = [r[0] for r in values.select("index").distinct().collect()]
    assert len(names) == 62
    rows = values.filter("`index` in ('TXx', 'Rx1day')").select("value").collect()
    assert all(math.isfinite(r.value) for r in rows)


def test_files_arriving_later_are_ingested_once(spark, files, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "landed"), str(tmp_path / "state")
    os.makedirs(folder)
    schema = "valid_time string, lat double, lon double, tp double, tasmax double, TASMIN double, height double"
    for year in (2000, 2001):
        raw(spark, f"{year}-01-01", f"{year}-01-05").coalesce(1).write.mode("append").parquet(str(folder))
        for _ in range(2):
            ingest_new_files(spark, str(folder), schema, UNITS, out, state).awaitTermination()
        landed = spark.read.parquet(out)
        assert landed.count() == 3 * 6 * 5 * (year - 1999)
    assert landed.agg(F.min("date")).first()[0] == datetime.date(2000, 1, 1)


def test_new_files_are_merged_into_touched_partitions_only(spark, tmp_path):
    """Late and overlapping files, in any order of arrival: the result is that of merging all files at once."""
    folder, out, state = tmp_path / "in", str(tmp_path / "merged"), str(tmp_path / "state")
    os.makedirs(folder)
    schema = "valid_time string, lat double, lon double, tp double, tasmax double, TASMIN double, height double"

    def arrive(name, first, last, shift):
        table = raw(spark, first, last).withColumn("tasmax", F.col("tasmax") + shift).toPandas()
        table.to_parquet(str(folder / name))

    def stamps():
        return {str(p): p.stat().st_mtime_ns for p in (tmp_path / "merged").rglob("*.parquet")}

    arrive("m.parquet", "2000-12-25", "2001-01-05", 0.0)
    for _ in range(2):
        merge_new_files(spark, str(folder), schema, UNITS, out, state).awaitTermination()
    before = stamps()
    arrive("a.parquet", "2001-01-03", "2001-01-08", 1.0)  # late, and first in name order
    arrive("z.parquet", "2001-01-07", "2002-01-02", 2.0)
    merge_new_files(spark, str(folder), schema, UNITS, out, state).awaitTermination()
    kept = {p for p, t in stamps().items() if before.get(p) == t}
    assert kept and all("year=2000" in p for p in kept)
    point = ["variable", "cell_id", "date", "value", "src"]
    whole = merge.merge(clean.keep_allowed(obs.read_grid(spark, str(folder), UNITS)), fill=False).select(*point)
    ours = obs.read_obs(spark, out).select(*point)
    assert ours.exceptAll(whole).isEmpty() and whole.exceptAll(ours).isEmpty()
    assert ours.filter("variable = 'tmax' and date = '2001-01-04'").select(F.regexp_extract("src", "[^/]*$", 0)).distinct().first()[0] == "a.parquet"


def test_attributes_and_unreadable_files(spark, files, tmp_path):
    folder = tmp_path / "grids"
    os.makedirs(folder)
    for name in ("one", "two"):
        raw(spark, "2000-01-01", "2000-01-03").toPandas().to_parquet(str(folder / f"{name}.parquet"))
    side = lambda name, **a: (folder / f"{name}.parquet.attributes.json").write_text(json.dumps(a, indent=1))
    side("one", calendar="standard", transform=[1.0, 0, 99.5, 0, -1.0, 11.5], variables={"pr": {"standard_name": "rain", "units": "mm/s"}})
    side("two", calendar="standard", geospatial_lat_resolution="1 degree", geospatial_lon_resolution="1.0")
    paths = str(folder)
    assert jobs.clip_and_clean(spark, paths, UNITS, described=paths).count() == 2 * 3 * 6 * 3
    assert {(r.variable, r.standard_name) for r in attributes.variables_of(attributes.read_attributes(spark, paths)).collect()} == {("pr", "rain")}
    side("two", calendar="noleap")
    with pytest.raises(ValueError, match="different calendars"):
        jobs.clip_and_clean(spark, paths, UNITS, described=paths)
    side("two", calendar="standard", transform=[0.5, 0, 99.5, 0, -0.5, 11.5])
    with pytest.raises(ValueError, match="different resolutions"):
        jobs.clip_and_clean(spark, paths, UNITS, described=paths)
    (folder / "three.parquet").write_bytes(b"PAR1 this is no table PAR1")
    with pytest.raises(ValueError, match="unreadable file"):
        jobs.clip_and_clean(spark, paths, UNITS)


def scans(df):
    return len([line for line in explain(df).splitlines() if line.startswith("(") and "Scan parquet" in line])


def test_profiles_and_merge_read_the_input_once_and_twice(spark, merged, monkeypatch):
    table = obs.read_obs(spark, merged).drop("year")
    stored = []
    for module in (summary, merge):
        real = module.settle
        monkeypatch.setattr(module, "settle", lambda df, real=real: (stored.append(scans(df)), real(df))[1])
    assert scans(profile.dataset_profile(table)) == 0 and scans(profile.file_profile(table)) == 0
    assert stored == [1, 1]
    assert scans(merge.merge(table)) == 1 and stored == [1, 1, 1]


def test_runner_reads_the_rain_twice_at_most(spark, merged, monkeypatch):
    table = obs.read_obs(spark, merged).drop("year")
    stored, real = [], runner.settle
    monkeypatch.setattr(runner, "settle", lambda df: (stored.append(scans(df)), real(df))[1])
    values = runner.compute_indices(table, ["PRCPTOT", "R95p", "SPI3", "SPI6", "SPI9", "SPI12", "pr"], with_events=False)
    values.count()
    plan = values._jdf.queryExecution().executedPlan().toString()
    final = plan.split("+- == Initial Plan ==")[0]
    read = final.count("FileScan parquet")
    assert stored == [1] and read <= 2  # the daily family's thresholds and days share one shuffle
