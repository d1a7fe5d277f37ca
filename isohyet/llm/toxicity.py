"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, found in a block-max inverted index.

Terms are the words of a text and the starts and ends (4 to 6 bytes) of its words.  From a bounded sample of labelled
texts (``SAMPLE`` rows a class, chosen by a hash of doc_id) the ``TERMS`` terms that depend most on the label by the
chi-squared statistic (``CHI2`` at least) are weighted by TF-IDF.  The index holds the examples in blocks; for every
block it keeps the largest weight of each term.  A query's bound for a block is its product with these maxima; blocks
are visited by falling bound and skipped once the bound is below the K-th best cosine so far, so the K nearest
examples are exact.  They vote with weight 1 / (distance + 0.05); votes are calibrated by isotonic regression on the
sample, each example voted on without itself and weighted so that the classes have their shares among all labels.
``evidence`` lists the nearest examples.

Defined cases: a text without any of the terms (null and empty ones too) has no neighbour and the vote 0, which is
calibrated like other votes.  Without labels of both classes, or without a term that
depends on the label, every score is the share of label 1 (0.5 without labels).
Equal cosines go by the order of the index.  Repeated rows and other columns make no difference.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.llm.common import slices
from isohyet.llm.quality import sample
from isohyet.llm.words import PUNCTUATION, Words

SAMPLE, TERMS, CHI2, K, BLOCK = 2500, 4096, 60.0, 10, 64
LIMIT = 0.5


def hashed_terms(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of every occurrence of a term."""
    words = Words(texts, PUNCTUATION)
    size = words.end - words.start
    owner, out = [words.text], [words.hashes()]
    for part in (4, 5, 6):
        long = np.flatnonzero(size > part)
        out.append(words.hashes(words.start[long], words.start[long] + part))
        out.append(words.hashes(words.end[long] - part, words.end[long]) ^ np.uint64(1))  # an end is not a start
        owner += [words.text[long]] * 2
    return np.concatenate(owner), np.concatenate(out)


class Vocabulary:
    """Places of the chosen terms; a bit table answers most questions about other terms."""

    def __init__(self, terms):
        self.terms = np.sort(np.asarray(terms, np.uint64))
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.terms & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def counts(self, texts: list) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places and counts of the chosen terms in each text."""
        owner, terms = hashed_terms(texts)
        if not len(self.terms) or not len(terms):
            return [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(texts)
        maybe = np.flatnonzero(self.table[(terms & np.uint64(0xFFFFF)).astype(np.int64)])
        owner, terms = owner[maybe], terms[maybe]
        place = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        known = self.terms[place] == terms
        pairs, n = np.unique(owner[known] * len(self.terms) + place[known], return_counts=True)
        limits = np.searchsorted(pairs, np.arange(len(texts) + 1) * len(self.terms))
        return [(pairs[a:b] % len(self.terms), n[a:b]) for a, b in zip(limits[:-1], limits[1:])]


def _distinct_terms(batches):
    for batch in batches:
        texts = batch["text"].to_pylist()
        labels = np.array(batch["label"].to_pylist(), np.int64)
        for a, b in slices(texts):
            owner, terms = hashed_terms(texts[a:b])
            order = np.lexsort((terms, owner))
            owner, terms = owner[order], terms[order]
            new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (terms[1:] != terms[:-1]))) if len(terms) else np.zeros(0, bool)
            owner, terms = owner[new], terms[new]
            distinct, place = np.unique(terms, return_inverse=True)
            n1 = np.bincount(place, weights=labels[a:b][owner], minlength=len(distinct)).astype(np.int64)
            n = np.bincount(place, minlength=len(distinct))
            yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(n), pa.array(n1)], ["term", "n", "n1"])


def _counted(terms: list[int]):
    def run(batches):
        vocabulary = Vocabulary(np.array(terms, np.int64).view(np.uint64))
        for batch in batches:
            texts = batch["text"].to_pylist()
            for a, b in slices(texts):
                found = vocabulary.counts(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(a, b - a), batch["label"].slice(a, b - a),
                     pa.array([p for p, _ in found], pa.list_(pa.int64())), pa.array([n for _, n in found], pa.list_(pa.int64()))],
                    ["doc_id", "label", "places", "counts"])

    return run


class Index:
    """Unit TF-IDF vectors of the examples in blocks of neighbours; each block's own terms and largest weights."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, ids: np.ndarray):
        # Examples with the same strongest term side by side, so that few blocks hold a term and maxima are tight.
        order = np.lexsort((ids, -vectors.max(axis=1), vectors.argmax(axis=1))) if len(ids) else np.zeros(0, np.int64)
        self.labels, self.ids = labels[order], ids[order]
        self.blocks = []
        most = []
        for a in range(0, len(order), BLOCK):
            rows = vectors[order[a:a + BLOCK]]
            terms = np.flatnonzero(rows.any(axis=0))
            self.blocks.append((a, terms, np.ascontiguousarray(rows[:, terms].T)))  # postings by term
            most.append(rows.max(axis=0))
        self.most = np.array(most).T if most else np.zeros((vectors.shape[1], 0))

    def nearest(self, queries: np.ndarray, k: int = K, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and places of the k nearest examples of each query (-1: fewer with a common term)."""
        n = len(queries)
        best, place = np.zeros((n, k)), np.full((n, k), -1)
        if not self.blocks:
            return best, place
        bounds = queries @ self.most
        order = np.argsort(-bounds, axis=1, kind="stable")
        for step in range(order.shape[1]):
            block = order[:, step]
            bound = bounds[np.arange(n), block]
            active = np.flatnonzero((bound > best[:, -1] - 1e-9) & (bound > 0))
            if not len(active):
                break  # bounds only fall from here on
            for b in np.unique(block[active]):
                rows = active[block[active] == b]
                first, terms, postings = self.blocks[b]
                cosine = queries[np.ix_(rows, terms)] @ postings
                here = first + np.arange(postings.shape[1])
                if skip is not None:
                    cosine[skip[rows][:, None] == self.ids[here][None, :]] = 0
                all_cos = np.concatenate((best[rows], cosine), 1)
                all_place = np.concatenate((place[rows], np.broadcast_to(here, cosine.shape)), 1)
                key = np.lexsort((np.where(all_place < 0, 1 << 60, all_place), -all_cos), axis=1)[:, :k]
                best[rows] = np.take_along_axis(all_cos, key, 1)
                place[rows] = np.where(best[rows] > 0, np.take_along_axis(all_place, key, 1), -1)
        return best, place

    def votes(self, best: np.ndarray, place: np.ndarray) -> np.ndarray:
        weight = np.where(place >= 0, best / (1 - np.minimum(best, 1) + 0.05), 0)
        total = weight.sum(axis=1)
        label = np.where(place >= 0, self.labels[np.maximum(place, 0)] if len(self.labels) else 0, 0)
        return np.where(total > 0, (weight * label).sum(axis=1) / np.maximum(total, 1e-12), 0)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best non-decreasing fit of y by x: one knot for each level, by pooling neighbours that violate the order."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for xi, yi, wi in zip(x[order], y[order], weight[order]):
        if pools and pools[-1][3] == xi:  # equal x have one value
            pool = pools[-1]
            pool[0], pool[1] = pool[0] + yi * wi, pool[1] + wi
        else:
            pools.append([yi * wi, wi, xi, xi])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
    knots = np.array([v for p in pools for v in (p[2], p[3])])
    return knots, np.array([p[0] / p[1] for p in pools for _ in (0, 1)])


class Model:
    def __init__(self, terms: list[int], rows: list, totals: dict[int, int]):
        self.terms = terms
        self.share = totals.get(1, 0) / sum(totals.values()) if totals else 0.5
        labels = np.array([r["label"] for r in rows], np.int64)
        self.ready = len(set(labels.tolist())) == 2 and len(terms) > 0
        if not self.ready:
            return
        counts = [(np.array(r["places"], np.int64), np.array(r["counts"], np.int64)) for r in rows]
        present = np.bincount(np.concatenate([p for p, _ in counts]), minlength=len(terms))
        self.idf = np.log((1 + len(rows)) / (1 + present)) + 1
        vectors, ids = self.vectors(counts), np.array([r["doc_id"] for r in rows], np.int64)
        self.index = Index(vectors, labels, ids)
        votes = np.concatenate([self.index.votes(*self.index.nearest(vectors[a:a + 512], skip=ids[a:a + 512]))
                                for a in range(0, len(ids), 512)])
        own = np.bincount(labels, minlength=2)
        weight = np.array([(1 - self.share) / own[0], self.share / own[1]])[labels]
        self.knots, self.values = isotonic(votes, labels.astype(float), weight)

    def vectors(self, counts: list) -> np.ndarray:
        out = np.zeros((len(counts), len(self.terms)), np.float32)
        for i, (place, n) in enumerate(counts):
            if len(place):
                w = (1 + np.log(n)) * self.idf[place]
                out[i, place] = w / np.sqrt((w * w).sum())
        return out

    def score(self, counts: list) -> tuple[np.ndarray, list]:
        if not self.ready:
            return np.full(len(counts), self.share), [[] for _ in counts]
        scores, evidence = [], []
        for a in range(0, len(counts), 256):
            best, place = self.index.nearest(self.vectors(counts[a:a + 256]))
            scores.append(np.interp(self.index.votes(best, place), self.knots, self.values))
            evidence.extend(self.index.ids[p[p >= 0]].tolist() for p in place)
        return np.concatenate(scores), evidence


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    chosen, totals = sample(labels, "toxic", SAMPLE)
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # 2 x SAMPLE ids
    own = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    n0, n1 = float(own.get(0, 0)), float(own.get(1, 0))
    if not n0 or not n1:
        return Model([], [], totals)
    terms = texts.mapInArrow(_distinct_terms, "term long, n long, n1 long").groupBy("term").agg(
        F.sum("n").cast("double").alias("n"), F.sum("n1").cast("double").alias("n1")).filter("n >= 3")
    a, b = F.col("n1"), F.col("n") - F.col("n1")
    chi2 = ((n0 + n1) * F.pow(a * (n0 - b) - b * (n1 - a), F.lit(2.0))
            / F.greatest(F.lit(1.0), F.col("n") * (n0 + n1 - F.col("n")) * n0 * n1))
    best = terms.withColumn("chi2", chi2).filter(F.col("chi2") >= CHI2).orderBy(F.desc("chi2"), "term").limit(TERMS)
    words = sorted((r["term"] for r in best.collect()), key=lambda t: t % 2**64)  # as unsigned numbers, as in Vocabulary
    rows = texts.mapInArrow(_counted(words), "doc_id long, label int, places array<long>, counts array<long>").collect()
    return Model(words, sorted(rows, key=lambda r: (r["doc_id"], r["label"], r["places"], r["counts"])), totals)


def _scorer(model: Model):
    def run(batches):
        vocabulary = Vocabulary(np.array(model.terms, np.int64).view(np.uint64))
        for batch in batches:
            texts = batch["text"].to_pylist()
            for a, b in slices(texts):
                part = batch.slice(a, b - a)
                scores, evidence = model.score(vocabulary.counts(texts[a:b]))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(np.clip(scores, 0, 1)), pa.array(evidence, pa.list_(pa.int64()))],
                    [*part.schema.names, "score", "evidence"])

    return run


def score(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` with ``score``, ``evidence`` (doc_ids of the nearest examples) and ``predicted``; columns of these names are replaced."""
    documents = documents.drop("score", "evidence", "predicted")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    scored = documents.mapInArrow(_scorer(model), f"{schema}, score double, evidence array<long>")
    return scored.withColumn("predicted", (F.col("score") >= LIMIT).cast("int"))
