"""Small helpers that several operators share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as named in ``spark.checkpoint.dir``; only a local session may do without."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="isohyet-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@contextlib.contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go with its end, not with some later garbage collection of the driver."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a result once to the shared folder and go on from there: lineage ends, lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with passing_shuffles(spark):  # nothing else reads the shuffles of this one write
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(table: DataFrame) -> None:
    """Frees the space of a stored table that nothing reads any more: its files are replaced by an empty one."""
    files = table.inputFiles()
    if files:
        table.sparkSession.createDataFrame([], table.schema).coalesce(1).write.mode("overwrite").parquet(files[0].rsplit("/", 1)[0])


def remainder(key: str, divisor: int) -> Column:
    """crc32 of a key written as text, modulo a divisor; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % divisor


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, although ``use`` mentions it often or inside a lambda."""
    return F.transform(F.array(value), use)[0]


def shielded(documents: DataFrame, *names: str) -> DataFrame:
    """All columns but ``names`` under names that nothing else uses."""
    return documents.select(*(F.col(f"`{c}`") if c in names else F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(documents.columns)))


def unshielded(rows: DataFrame, documents: DataFrame, *names: str) -> DataFrame:
    """The columns of ``documents`` again."""
    return rows.select(*(F.col(f"`{c}`") if c in names else F.col(f"__c{i}").alias(c) for i, c in enumerate(documents.columns)))


def joined(rows: DataFrame, lookup: DataFrame, keys: list[str], copies: str, share: int = 256) -> DataFrame:
    """Inner join of ``rows`` with ``lookup``, which has one row a key and says in ``copies`` how many rows have the key.

    A key with over 1/``share`` of all rows would fill one task; there are fewer than ``share`` of those, so their part
    of ``lookup`` is broadcast.  All other keys meet in a shuffle.
    """
    total = lookup.agg(F.sum(copies)).first()[0] or 0
    frequent = F.col(copies) * share > F.lit(total)
    few = F.broadcast(lookup.filter(frequent))
    rest = rows.join(few.select(*keys), keys, "left_anti").join(lookup.filter(~frequent), keys)
    return rows.join(few, keys).unionByName(rest)


def slices(texts, limit: int = 2_000_000, rows: int = 1000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters and at most ``rows`` texts, so that working arrays stay small."""
    a = size = 0
    for i, text in enumerate(texts):
        size += len(text) if text is not None else 0
        if size >= limit or i + 1 - a == rows:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def pieces(batches, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows, so that only a part's texts become Python strings."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with equal values side by side in one partition, for ``runs``; not coalesced, as the work is not in bytes."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *columns).sortWithinPartitions(*columns)


def runs(batches, columns: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal values, over batch limits; only the run at hand is held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            batches_here = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch])
        else:
            batches_here = pa.Table.from_batches([batch])
        shift = 1 if held else 0
        new = None
        for name in columns:
            values = batches_here[name].combine_chunks()
            differs = pc.not_equal(values.slice(1), values.slice(0, len(values) - 1))
            new = differs if new is None else pc.or_(new, differs)
        cuts = [i + 1 - shift for i in pc.indices_nonzero(new).to_pylist()]
        at = 0
        for cut in cuts:
            if cut > at:
                held.append(batch.slice(at, cut - at))
            yield pa.Table.from_batches(held)
            held, at = [], cut
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)
