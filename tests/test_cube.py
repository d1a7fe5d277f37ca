"""The cube that the queries derive from order lines."""

import datetime

from pyspark.sql import functions as F

from suite import cube


def _tables(spark, folder, suppliers: int):
    spark.range(suppliers).select(F.col("id").alias("s_suppkey")).write.parquet(f"{folder}/supplier.parquet")
    rows = [(3, 40.0, 0.05, "A", "F", datetime.datetime(1999, 2, 1)), (3, 20.0, 0.0, "A", "F", datetime.datetime(1999, 2, 1)),
            (7, 50.0, 0.1, "N", "O", datetime.datetime(2000, 12, 30))]
    spark.createDataFrame(rows, cube.SCHEMAS["lineitem"]).write.parquet(f"{folder}/lineitem.parquet")


def test_calendar_is_listed_in_bounded_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cube, "CALENDAR_ROWS", 10_000, raising=False)
    _tables(spark, tmp_path, 1000)
    listed = cube.calendar(spark, str(tmp_path))
    sizes = [r["count"] for r in listed.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 54 * 731  # all cells of a 9 x 6 grid, 1999 and 2000
    assert len(sizes) == 4 and max(sizes) <= 20_000  # as many as the test's shuffle partitions, too


def test_every_cell_has_every_day_once(spark, tmp_path):
    _tables(spark, tmp_path, 1000)
    table = cube.wide(spark, str(tmp_path))
    facts = table.agg(F.count("*"), F.countDistinct("cell_id", "date"), F.count("tmax"), F.sum("pr")).first()
    assert tuple(facts) == (54 * 731, 54 * 731, 2, (200 * 64 // 100 + 500 * 64 // 100) / 64)
