"""Shuffle files of a stored step go with it, and near_dedup shuffles neither keys nor texts twice."""

import random
import time

import pytest
from pyspark.sql import functions as F

from isohyet.llm import common, minhash

from .conftest import prose


@pytest.fixture
def shuffled_joins(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def _exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def _shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "shuffle_" in f}


def test_a_stored_step_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    steps = [common.stored(spark.range(10_000).groupBy((F.col("id") % (k + 7)).alias("k")).count(), "step") for k in range(3)]
    end = time.time() + 10  # they are removed by a thread of its own
    while _shuffle_files(spark) - before and time.time() < end:
        time.sleep(0.1)
    assert not _shuffle_files(spark) - before
    assert [s.count() for s in steps] == [7, 8, 9] == [s.count() for s in steps]


@pytest.mark.parametrize("value", [None, "false", "true"])
def test_the_setting_of_the_session_comes_back(spark, value):
    if value is not None:
        spark.conf.set(common.CLEANUP, value)
    try:
        common.stored(spark.range(5), "step")
        with pytest.raises(ValueError, match="no table"), common.passing_shuffles(spark):
            raise ValueError("no table")
        assert spark.conf.get(common.CLEANUP, None) == value
    finally:
        spark.conf.unset(common.CLEANUP)


def test_keys_and_sketches_are_shuffled_once(spark, shuffled_joins):
    described = spark.createDataFrame(
        [(d, h, h, 3, [h], b"s") for d, h in ((1, 5), (2, 5), (1, 5), (1, 5), (3, 6), (None, 6), (3, 7))],
        "doc_id long, h1 long, h2 long, n_shingles long, keys array<long>, sketch binary")
    classes = described.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"))
    nodes = minhash._nodes(described, common.stored(classes, "classes"))
    assert _exchanges(nodes) == 2  # one a side of the join
    assert sorted((r["node"], r["keys"][0]) for r in nodes.collect()) == [(1, 5), (3, 6), (3, 7)]


def test_texts_meet_the_kept_ids_in_one_shuffle(spark, shuffled_joins, monkeypatch):
    rng = random.Random(21)
    texts = [prose(rng, 40, 10**6) for _ in range(4)]
    rows = [(1, texts[0]), (2, texts[0]), (1, texts[0]), (3, texts[1]), (3, texts[2]), (3, texts[2]), (None, texts[3]), (None, texts[3]), (None, texts[0]), (0, None), (0, None), (None, None)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    found = minhash.deduplicate(documents)
    assert sorted(found.collect(), key=str) == sorted({*rows} - {(2, texts[0]), (None, texts[0])}, key=str)
    near = common.stored(minhash.near_duplicates(documents), "near")
    monkeypatch.setattr(minhash, "near_duplicates", lambda _: near)
    assert _exchanges(minhash.deduplicate(documents)) == 2  # texts, and the kept ids as they are made distinct
