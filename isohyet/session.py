"""Session defaults.  Every setting is a plain Spark option and can be overridden by the cluster."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    # Dates are calendar days of the data, so they must not depend on where a task runs.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    # Recording the Python call site of every column expression doubles the time to build a plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A written map replaces only the partitions it contains.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Lists are collected per cell and calendar day, some 370 keys per cell: keep hashing them
    # instead of falling back to a sort after the default 128 keys.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
}


def build_session(app: str = "isohyet", master: str | None = None, **options) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **options}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small reference table that many plans read, with a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``.  Only a local session without that
    setting gets a folder of its own.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="isohyet-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint()
