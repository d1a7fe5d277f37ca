"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are the shapes of its words (runs of capitals, small letters, digits and each punctuation mark, one
sign a run), pairs of neighbouring shapes, and a mark for a word that repeats the one before it; shapes and pairs go
to a fixed number of bins.  TF-IDF weights and a truncated singular value decomposition, made from a bounded sample of
labelled texts (``SAMPLE`` rows a class, chosen by a hash of doc_id), give the latent vectors.  The labelled vectors
are broadcast (2 x SAMPLE x LATENT numbers) and every text's cosine with all of them is computed in blocks; the K
nearest vote, weighted by similarity and by how much more frequent their class is among all labels than in the sample.

Defined cases: a text without words has no direction; its score is the share of label 1.  Without any label, or with
one class only, scores are that share too (0.5 without labels).  Null labels are no labels.  Equal similarities go by
the order of the sample.  Repeated rows and other columns make no difference.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.llm.common import shielded, slices, unshielded
from isohyet.llm.words import Words, mix64

SAMPLE, BINS, LATENT, K = 1500, 512, 32, 15
SHARPNESS = 8   # power of the similarity that weighs a vote
LIMIT = 0.3     # label 1 from this score on

_SHAPES = np.arange(256, dtype=np.uint8)
_SHAPES[ord("a"):ord("z") + 1] = ord("a")
_SHAPES[0x80:] = ord("a")  # parts of letters outside ASCII
_SHAPES[ord("A"):ord("Z") + 1] = ord("Z")
_SHAPES[ord("0"):ord("9") + 1] = ord("9")


def terms(texts: list) -> np.ndarray:
    """Counts of the terms, texts x (2 x BINS + 1)."""
    width = 2 * BINS + 1
    shapes = []
    for text in texts:
        signs = _SHAPES[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
        signs = signs[np.concatenate(([True], signs[1:] != signs[:-1]))] if len(signs) else signs
        shapes.append(signs.tobytes().decode("ascii", "replace").replace("Z", "@"))  # not lower-cased as a letter
    form, plain = Words(shapes), Words(texts)
    h = form.hashes()
    single = form.text * width + (h % np.uint64(BINS)).astype(np.int64)
    next_to = np.flatnonzero(form.text[1:] == form.text[:-1]) if len(h) else np.zeros(0, np.int64)
    pair = form.text[next_to] * width + BINS + (mix64(h[next_to] * np.uint64(31) + h[next_to + 1]) % np.uint64(BINS)).astype(np.int64)
    w = plain.hashes()
    again = np.flatnonzero((w[1:] == w[:-1]) & (plain.text[1:] == plain.text[:-1])) if len(w) else np.zeros(0, np.int64)
    mark = plain.text[again] * width + 2 * BINS
    return np.bincount(np.concatenate((single, pair, mark)), minlength=len(texts) * width).reshape(len(texts), width)


def _weights(counts: np.ndarray) -> np.ndarray:
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _sparse_terms(batches):
    for batch in batches:
        texts = batch["text"].to_pylist()
        for a, b in slices(texts):
            counts = terms(texts[a:b])
            places = [np.flatnonzero(row) for row in counts]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].slice(a, b - a), batch["label"].slice(a, b - a), pa.array(places, pa.list_(pa.int64())),
                 pa.array([row[p] for row, p in zip(counts, places)], pa.list_(pa.int64()))],
                ["doc_id", "label", "places", "counts"])


def sample(labels: DataFrame, label: str, size: int) -> tuple[DataFrame, dict[int, int]]:
    """Up to ``size`` labelled doc_ids of each class, by a hash of doc_id; and the number of labels of each class."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)").distinct()
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    parts = [known.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size) for c in (0, 1)]
    return parts[0].unionByName(parts[1]), counts


class Model:
    def __init__(self, rows: list, totals: dict[int, int]):
        self.share = totals.get(1, 0) / sum(totals.values()) if totals else 0.5
        counts = np.zeros((len(rows), 2 * BINS + 1), np.int64)
        for i, r in enumerate(rows):
            counts[i, r["places"]] = r["counts"]
        labels = np.array([r["label"] for r in rows], np.int64)
        self.ready = len(set(labels.tolist())) == 2
        if not self.ready:
            return
        self.idf = np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))) + 1
        x = _unit(_weights(counts) * self.idf)
        values, vectors = np.linalg.eigh(x.T @ x)
        self.basis = vectors[:, ::-1][:, :LATENT]
        self.vectors = _unit(x @ self.basis).astype(np.float32)
        self.labels = labels
        own = np.bincount(labels, minlength=2)
        self.votes = np.array([(1 - self.share) / own[0], self.share / own[1]])[labels]

    def score(self, counts: np.ndarray) -> np.ndarray:
        out = np.full(len(counts), self.share)
        has = np.flatnonzero(counts.sum(axis=1))
        if not self.ready or not len(has):
            return out
        latent = _unit(_weights(counts[has]) * self.idf @ self.basis).astype(np.float32)
        for a in range(0, len(has), 512):
            cosine = latent[a:a + 512] @ self.vectors.T
            near = np.argsort(-cosine, axis=1, kind="stable")[:, :K] if cosine.shape[1] <= K else np.argpartition(-cosine, K, axis=1)[:, :K]
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 1e-6).astype(np.float64) ** SHARPNESS * self.votes[near]
            out[has[a:a + 512]] = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        return out


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    chosen, totals = sample(labels, "quality", SAMPLE)
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # 2 x SAMPLE ids
    rows = texts.mapInArrow(_sparse_terms, "doc_id long, label int, places array<long>, counts array<long>")
    return Model(sorted(rows.collect(), key=lambda r: (r["doc_id"], r["label"], r["places"], r["counts"])), totals)


def _scorer(model: Model):
    def run(batches):
        for batch in batches:
            texts = batch["text"].to_pylist()
            for a, b in slices(texts):
                part = batch.slice(a, b - a)
                scores = np.clip(model.score(terms(texts[a:b])), 0, 1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], [*part.schema.names, "score"])

    return run


def score(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` with ``score`` and ``predicted``; columns of these names are replaced."""
    documents = documents.drop("score", "predicted")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    scored = documents.mapInArrow(_scorer(model), f"{schema}, score double")
    return scored.withColumn("predicted", (F.col("score") >= LIMIT).cast("int"))


def accepted(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject."""
    kept = score(shielded(documents, "text"), fit(documents, labels)).filter("predicted = 1")
    return unshielded(kept, documents, "text")
