"""Language identification by rank-order profiles of character n-grams.

A profile lists the 300 most frequent n-grams (n = 1 to 3, words lower-cased and padded with a space) by rank.  A
document's own profile is compared with each language's by the out-of-place distance: the difference of ranks, or 300
for an n-gram that the language's profile lacks.  Language profiles count the n-grams of all learning texts; counts
are combined in each task before they are shuffled, and only 300 n-grams of each language reach the driver.

Defined cases: null texts and texts without a letter are ``und`` with score 0, and so is everything when there is
nothing to learn from.  Ties go to the language that sorts first.  Texts without ``lang`` are not learned from.
Repeated rows count as often as they occur.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TOP = 300
SPACE = 32


def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngrams(text: str | None, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text as numbers (21 bits a character) and their counts."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes = np.where(letters[codes], codes, SPACE)
    codes = np.concatenate(([SPACE], codes, [SPACE]))
    codes = codes[np.concatenate(([True], (codes[1:] != SPACE) | (codes[:-1] != SPACE)))]  # one space between words
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    two = (codes[:-1] << 21) | codes[1:]
    three = (two[:-1] << 21) | codes[2:]
    one = codes[codes != SPACE]
    return np.unique(np.concatenate((one, two, three[codes[1:-1] != SPACE])), return_counts=True)


def _count(batches):
    """n-gram counts of each language in one task's texts."""
    letters, totals = _letters(), {}

    def merged(parts):
        grams, counts = (np.concatenate(x) for x in zip(*parts))
        distinct, place = np.unique(grams, return_inverse=True)
        return distinct, np.bincount(place, weights=counts).astype(np.int64)

    for batch in batches:
        for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist()):
            parts = totals.setdefault(lang, [])
            parts.append(ngrams(text, letters))
            if len(parts) == 256:
                totals[lang] = [merged(parts)]
    for lang, parts in totals.items():
        grams, counts = merged(parts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], ["lang", "gram", "n"])


def profiles(documents: DataFrame) -> dict[str, list[int]]:
    """The most frequent n-grams of each language, in order of rank."""
    texts = documents.filter("lang is not null and text is not null").select("text", F.col("lang").cast("string").alias("lang"))
    counts = texts.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("rank", rank).filter(F.col("rank") <= TOP).orderBy("lang", "rank")
    out: dict[str, list[int]] = {}
    for row in top.select("lang", "gram").collect():  # 300 rows a language
        out.setdefault(row["lang"], []).append(row["gram"])
    return out


def _predictor(known: dict[str, list[int]]):
    langs = sorted(known)
    grams = np.unique(np.concatenate([np.array(known[x], np.int64) for x in langs])) if langs else np.zeros(0, np.int64)
    ranks = np.full((len(grams) + 1, len(langs)), -1, np.int64)  # the last row is for n-grams that no profile has
    for j, lang in enumerate(langs):
        ranks[np.searchsorted(grams, known[lang]), j] = np.arange(len(known[lang]))

    def one(text, letters):
        own, counts = ngrams(text, letters)
        if not len(own) or not langs:
            return "und", 0.0
        own = own[np.lexsort((own, -counts))[:TOP]]
        place = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
        at = ranks[np.where(grams[place] == own, place, len(grams))]
        away = np.where(at < 0, TOP, np.abs(at - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(np.argmin(away))
        return langs[best], 1 - float(away[best]) / (TOP * len(own))

    def run(batches):
        letters = _letters()
        for batch in batches:
            found = [one(t, letters) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                [*batch.schema.names, "lang_pred", "score"])

    return run


def predict(documents: DataFrame, known: dict[str, list[int]]) -> DataFrame:
    """``documents`` with ``lang_pred`` and ``score`` (1: its n-grams have the same ranks; 0: none is in the profile);
    columns of these names are replaced."""
    documents = documents.drop("lang_pred", "score")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    return documents.mapInArrow(_predictor(known), f"{schema}, lang_pred string, score double")


def learn_and_predict(documents: DataFrame, learn: Column) -> DataFrame:
    """Profiles of the rows where ``learn`` holds, applied to every text."""
    known = profiles(documents.filter(learn))
    return predict(documents.select("doc_id", "text"), known).drop("text")
