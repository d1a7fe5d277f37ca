"""Ingest of newly arrived grid files.

Each batch of new files is cleaned and either appended to a landing table, which the merge job reads as a whole, or
merged at once into the partitions that it touches.  The file source remembers what it has seen, so a restart neither
skips nor repeats a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from isohyet import model
from isohyet.operators import clean, merge
from isohyet.session import settle
from isohyet.sources import manifest, sinks
from isohyet.sources.obs import source_file, to_obs


def _arriving(spark: SparkSession, folder: str, schema: str, units: dict[str, str], fmt: str) -> DataFrame:
    source = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        source = source.option("header", True)
    return clean.keep_allowed(to_obs(source.load(folder).select("*", source_file().alias("src")), units))


def ingest_new_files(
    spark: SparkSession, folder: str, schema: str, units: dict[str, str], out: str, checkpoint: str,
    fmt: str = "parquet",
) -> StreamingQuery:
    """Process all files not seen before, then stop.  Rows land partitioned by variable and year."""
    obs = _arriving(spark, folder, schema, units, fmt).withColumn("year", F.year("date"))
    return (
        obs.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .partitionBy("variable", "year").trigger(availableNow=True).start()
    )


def merge_batch(batch: DataFrame, path: str) -> None:
    """Merge observations into the dataset at ``path``, first file wins; only (variable, year) partitions they touch are
    rewritten.

    The choice is a minimum over file names, so it does not matter in which batch a file came, nor that a batch is
    repeated after a failure.  Gaps of the calendar are not filled: they change with every later file, so
    ``merge.merge`` fills them when the dataset is complete.
    """
    spark = batch.sparkSession
    batch = settle(batch.select(*merge.POINT, "value", "src"))
    # Few: years of the calendar times variables of the catalogue.
    touched = [(r[0], r[1]) for r in batch.select("variable", F.year("date").alias("year")).distinct().collect()]
    if not touched:
        return
    stored = manifest.read_if_there(spark, path, model.OBS + ", year int")
    rows = batch
    if stored is not None:
        by_variable: dict[str, list[int]] = {}
        for variable, year in touched:
            by_variable.setdefault(variable, []).append(year)
        there = F.lit(False)
        for variable, years in by_variable.items():
            there = there | ((F.col("variable") == variable) & F.col("year").isin(years))
        rows = batch.unionByName(stored.filter(there).select(*batch.columns))
    # Stored before it replaces what it was read from.
    sinks.write_obs(settle(merge.merge(rows, fill=False)), path)


def merge_new_files(
    spark: SparkSession, folder: str, schema: str, units: dict[str, str], path: str, checkpoint: str,
    fmt: str = "parquet",
) -> StreamingQuery:
    """Merge all files not seen before into the dataset at ``path``, then stop."""
    return (
        _arriving(spark, folder, schema, units, fmt).writeStream.foreachBatch(lambda batch, _: merge_batch(batch, path))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
