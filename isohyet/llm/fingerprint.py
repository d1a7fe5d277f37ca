"""Bottom-k sketches of five-word shingles, as Column expressions only.

A sketch is the sorted array of the ``K`` smallest shingle hashes (the first 16 hexadecimal digits of MD5, so other
engines can make the same sketch); its string form joins them with commas.  Sketches of parts merge into the sketch
of the whole.  Below K distinct shingles a sketch holds them all and every estimate is exact.

Defined cases: words are runs of anything but white space after lower-casing A-Z; fewer than five words are one
shingle; null and empty texts have the empty sketch.  Two empty sketches are alike (1.0), an empty one and another
are not (0.0).  Equal texts have equal sketches whatever the other columns hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isohyet.llm.common import once

K, WIDTH = 128, 5
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
IDS = 128       # documents per bucket of neighbours, on average
GROUP = 1024    # buckets per group of buckets


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL)
    return F.filter(F.split(lowered, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def sketch(tokens: Column, k: int = K) -> Column:
    """The sketch of an array of words."""
    def of(t):
        starts = F.when(F.size(t) > 0, F.sequence(F.lit(1), F.greatest(F.size(t) - WIDTH + 1, F.lit(1)))).otherwise(
            F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(F.md5(F.array_join(F.slice(t, i, WIDTH), " ")), 1, 16))

    return F.slice(F.sort_array(F.array_distinct(once(tokens, of))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two parts."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_parts(parts: DataFrame, keys: list[str], column: str, k: int = K) -> DataFrame:
    """One sketch for each key from any number of parts: hashes are deduplicated and ranked before they are listed."""
    hashes = parts.select(*keys, F.explode(column).alias("__hash")).distinct()
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("__hash"))
    least = hashes.withColumn("__rank", rank).filter(F.col("__rank") <= k)
    merged = least.groupBy(*keys).agg(F.sort_array(F.collect_list("__hash")).alias(column))
    empty = parts.select(*keys).distinct().join(merged, keys, "left")
    return empty.withColumn(column, F.coalesce(column, F.array().cast("array<string>")))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated |A and B| / |A or B|: the share of the union's sketch that both hold."""
    return once(merge(a, b, k), lambda union: F.when(F.size(union) == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(union, F.array_intersect(a, b))).cast("double") / F.size(union)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    top = F.conv(F.substring(F.element_at(a, F.lit(k)), 1, 13), 16, 10).cast("double") / float(16 ** 13)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / top)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of A's shingles that B has too, from resemblance and the distinct counts of A and the union."""
    shared = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def _entries(rows: DataFrame, start: int) -> DataFrame:
    """For each bucket, ``entry``: the text of the first row of the next bucket that has rows; after the last comes ``start``."""
    firsts = rows.groupBy("bucket").agg(F.min(F.struct("doc_id", "text")).alias("first"))
    # Over two levels, so that no task orders more than a small part of the buckets.
    buckets = rows.select("bucket").distinct().withColumn("group", F.floor(F.col("bucket") / GROUP))
    inside = buckets.withColumn("follows", F.lead("bucket").over(W.partitionBy("group").orderBy("bucket")))
    groups = buckets.groupBy("group").agg(F.min("bucket").alias("least"))
    after = groups.select("group", F.lead("least").over(W.orderBy("group")).alias("after"))
    follows = inside.join(after, "group").select("bucket", F.coalesce("follows", "after", F.lit(start)).alias("follows"))
    first = firsts.select(F.col("bucket").alias("follows"), F.col("first.text").alias("entry"))
    return follows.join(first, "follows").select("bucket", "entry")


def with_next(documents: DataFrame) -> DataFrame:
    """``doc_id, text, sketch, next_text, next_sketch``: each row with the row that follows it by doc_id.

    Rows are dealt to buckets of neighbouring ids, so that texts are shuffled once and sketches are made once; the
    first rows of the buckets, one in a hundred or so, tell the last rows what follows.  Rows without doc_id come
    first; equal ids go by their texts; the last row is followed by the first.
    """
    ids = F.col("doc_id").cast("decimal(20,0)")
    limits = documents.agg(F.min(ids).alias("low"), F.max(ids).alias("high"), F.count("doc_id").alias("n"),
                           F.count_if(F.col("doc_id").isNull()).alias("nameless")).first()
    low, high = int(limits["low"] or 0), int(limits["high"] or 0)
    width = max(1, (high - low + 1) * IDS // max(limits["n"], 1))
    place = F.floor((ids - F.lit(low)) / F.lit(width)).cast("long")
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(place, F.lit(-1)).alias("bucket"))
    order = W.partitionBy("bucket").orderBy("doc_id", "text")
    chained = (rows.withColumn("next_text", F.lead("text").over(order))
               .withColumn("sketch", sketch(words(F.col("text"))))
               .withColumn("next_sketch", F.lead("sketch").over(order)))
    entries = _entries(rows, -1 if limits["nameless"] else 0).select(F.col("bucket").alias("from"), "entry", sketch(words(F.col("entry"))).alias("entry_sketch"))
    last = (F.col("bucket") == F.col("from")) & F.col("next_text").isNull()
    return chained.join(entries, last, "left").select(
        "doc_id", "text", "sketch", F.coalesce("next_text", "entry").alias("next_text"),
        F.coalesce("next_sketch", "entry_sketch").alias("next_sketch"))


def edited_pairs(documents: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text (the last quarter replaced by the start of the next document),
    and the likeness of the first to the second and to that of the next document, taken from the fingerprints alone."""
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    pairs = with_next(documents).withColumn("edited", edited).withColumn("edited_sketch", sketch(words(F.col("edited"))))
    own, other = F.col("sketch"), F.col("edited_sketch")
    return pairs.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.array_join(own, ",").alias("fingerprint"), F.array_join(other, ",").alias("edited_fingerprint"),
        resemblance(own, other).alias("near_edited"), resemblance(own, F.col("next_sketch")).alias("near_next"),
        F.round(distinct_shingles(own)).cast("long").alias("n_distinct"))
