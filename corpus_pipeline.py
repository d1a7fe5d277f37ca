"""The corpus pipeline: five stages, each written as Parquet and read again by the next one.

Each stage works on all documents that its predecessor kept, and its decisions take effect: rejected, duplicate and
contaminated documents are gone, secrets are replaced by a mark, and the last stage returns token ids.  All stages but
the last return the columns of documents.  Null texts count as empty; repeated rows become one in ``near_dedup``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from isohyet.llm import decontaminate, minhash, quality, secrets, sentencepiece
from isohyet.llm.common import remainder, stored


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the nearest labelled neighbours call bad; labels of the held-out fifth are not learned from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(remainder("doc_id", 5) != 0)
    return quality.accepted(docs, labels)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest doc_id."""
    return minhash.deduplicate(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which at least one word in 20 lies in a window of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; n_chars follows."""
    return secrets.redact(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of each text, checked by decoding them."""
    return sentencepiece.encoded_and_checked(docs)


STAGES = [
    ("quality_filter", quality_filter),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_redaction", secret_redaction),
    ("token_ids", token_ids),
]

# The first stage learns a projection from labels, which SQL cannot express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
