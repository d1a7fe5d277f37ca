"""Whitening of embeddings by their weighted multiplicity covariance.

Entries become whole numbers first, x = floor(1024 c) + 100000.  Equal vectors are one row with a count; that count (or
one, for ``weights="one"``) is the weight of the vector in every sum.  Three passes over the distinct vectors follow:
sums by dimension, exact; the covariance as one matrix product of centred vectors a batch, summed over tasks; and the
projection, once for each distinct vector, which is joined back to the rows.  Only d sums and a d x d matrix reach the
driver.

Defined cases.  Rows without a vector, and with a null, NaN, infinite or unrepresentable entry (2^52 and beyond), are
dropped.  Vectors of another length than most (the longer of equally frequent ones) cannot share a covariance with them and are dropped too.  Repeated rows
count as often as they occur and are all returned, also without ``vec_id``.  A component without variance (its
eigenvalue is lost in rounding: d 2^-52 of the largest) has no scale: ``whitened`` is null, ``explained`` is 0 and it is
left out of ``identity_error``, which is null if no component is left.  ``deviation`` is null where it exceeds 63 bits.
An empty table gives an empty result.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.llm.common import joined, stored

SCALE, SHIFT = 1024, 100_000
LARGEST = 2.0**52


@dataclass(frozen=True)
class Whitening:
    """Weight and exact sums of the fitted vectors, unit eigenvectors (columns, falling eigenvalues) and the trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def scaled(self) -> np.ndarray:
        """Projection to whitened components; columns without variance are NaN."""
        real = self.values > len(self.sums) * np.finfo(float).eps * max(self.values.max(initial=0.0), 0.0)
        return self.vectors / np.sqrt(np.where(real, self.values, np.nan))


def whole(embeddings: DataFrame) -> DataFrame:
    """``vec_id, x`` of every usable row."""
    entries = F.col("embedding").cast("array<double>")
    usable = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    x = F.transform(entries, lambda c: F.floor(c * SCALE).cast("long") + F.lit(SHIFT).cast("long"))
    return embeddings.filter(F.col("embedding").isNotNull() & usable).select("vec_id", x.alias("x"))


def distinct(rows: DataFrame) -> DataFrame:
    """``x, copies``: vectors of the most frequent length, each once; copies are counted before the shuffle."""
    counted = stored(rows.groupBy("x").agg(F.count("*").alias("copies")), "vectors")
    lengths = counted.groupBy(F.size("x").alias("d")).agg(F.sum("copies").alias("m"))
    most = lengths.orderBy(F.desc("m"), F.desc("d")).first()
    return counted.filter(F.size("x") == (most["d"] if most else 0))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return pc.list_flatten(batch["x"]).to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _safe(*factors) -> bool:
    """Whether a product of these sizes stays within 62 bits."""
    product = 1
    for f in factors:
        product *= int(f)
    return product < 2**62


def _sums(batches):
    """Of each task: weight and exact sums by dimension; dimension -1 is the weight itself."""
    total = None
    for batch in batches:
        if batch.num_rows:
            x, w = _matrix(batch), batch["weight"].to_numpy()
            if not _safe(np.abs(x).max(initial=1), w.max(), len(w)):
                x, w = x.astype(object), w.astype(object)
            part = [int(w.sum()), *map(int, (x * w[:, None]).sum(axis=0))]
            total = part if total is None else [a + b for a, b in zip(total, part)]
    if total is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(-1, len(total) - 1), pa.int32()), pa.array([Decimal(s) for s in total], pa.decimal128(38, 0))],
            ["dimension", "total"])


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, in whole numbers."""
    if _safe(n, 2 * max(np.abs(x).max(initial=1), 1)):
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _products(n: int, sums: list[int]):
    def task(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                centred = _centred(_matrix(batch), n, sums).astype(np.float64) / n
                part = (centred * batch["weight"].to_numpy()[:, None]).T @ centred
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    return task


def fit(vectors: DataFrame, weights: str = "counts") -> Whitening | None:
    """The whitening of distinct ``vectors(x, copies)``; None without any."""
    if weights not in ("counts", "one"):
        raise ValueError("weights are 'counts' or 'one'")
    weight = F.col("copies") if weights == "counts" else F.lit(1).cast("long")
    weighted = vectors.select("x", weight.alias("weight"))
    totals = weighted.mapInArrow(_sums, "dimension int, total decimal(38,0)").groupBy("dimension").agg(F.sum("total").alias("total"))
    by_dimension = {r["dimension"]: int(r["total"]) for r in totals.collect()}
    if len(by_dimension) < 2:
        return None
    n, d = by_dimension.pop(-1), len(by_dimension)
    sums = [by_dimension[j] for j in range(d)]
    parts = weighted.mapInArrow(_products(n, sums), "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    covariance = np.zeros((d, d))
    for i, j, v in parts.groupBy("i", "j").agg(F.sum("v")).toPandas().itertuples(index=False):
        covariance[i, j] = v / n
    values, columns = np.linalg.eigh((covariance + covariance.T) / 2)
    columns = columns[:, ::-1]
    largest = np.abs(columns).argmax(axis=0)  # the sign of an eigenvector is free: its largest entry is positive
    return Whitening(n, sums, columns * np.sign(columns[largest, range(d)]), values[::-1], float(np.trace(covariance)))


def _project(model: Whitening, components: int):
    n, sums, to = model.n, model.sums, model.scaled[:, :components]

    def task(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            centred = _centred(_matrix(batch), n, sums)
            if centred.dtype == object or not _safe(centred.shape[1], np.abs(centred).max(initial=1), np.abs(centred).max(initial=1)):
                far = [sum(int(v) ** 2 for v in row) for row in centred]
                deviation = pa.array([v if v < 2**63 else None for v in far], pa.int64())
            else:
                deviation = pa.array((centred * centred).sum(axis=1), pa.int64())
            whitened = (centred.astype(np.float64) / n) @ to
            yield pa.RecordBatch.from_arrays(
                [batch["x"], batch["copies"], deviation, pa.array(list(whitened), pa.list_(pa.float64()))],
                ["x", "copies", "deviation", "whitened"])

    return task


def _identity_error(vectors: DataFrame, real: list[int], weight: Column, n: int) -> float | None:
    """Largest absolute entry of the covariance of the whitened vectors minus the identity."""
    if not real:
        return None
    entry = {i: F.col("whitened")[i] for i in real}
    mean = vectors.agg(*(F.sum(weight * entry[i]) for i in real)).first()
    centre = {i: entry[i] - m / n for i, m in zip(real, mean)}
    pairs = [(i, j) for i in real for j in real if i <= j]
    sums = vectors.agg(*(F.sum(weight * centre[i] * centre[j]) for i, j in pairs)).first()
    return max(abs(s / n - (i == j)) for (i, j), s in zip(pairs, sums))


def whiten(embeddings: DataFrame, components: int = 8, weights: str = "counts") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for every usable row of
    ``embeddings(vec_id, embedding)`` and each of its first components, numbered from 1 by falling eigenvalue."""
    rows = whole(embeddings)
    vectors = distinct(rows)
    model = fit(vectors, weights)
    if model is None:
        schema = ("component int, n long, deviation long, whitened double, explained double, identity_error double")
        return embeddings.sparkSession.createDataFrame([], f"vec_id {dict(embeddings.dtypes)['vec_id']}, {schema}")
    components = min(components, len(model.sums))
    done = stored(vectors.mapInArrow(_project(model, components), "x array<long>, copies long, deviation long, whitened array<double>"), "whitened")
    real = [i for i in range(components) if not np.isnan(model.scaled[0, i])]
    weight = F.col("copies") if weights == "counts" else F.lit(1)
    error = _identity_error(done, real, weight, model.n)
    explained = [float(model.values[i] / model.trace) if i in real else 0.0 for i in range(components)]
    each = joined(rows, done, ["x"], "copies").select("vec_id", "deviation", F.posexplode("whitened").alias("at", "z"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        F.when(~F.isnan("z"), F.col("z")).alias("whitened"),
        F.element_at(F.array(*map(F.lit, explained)), F.col("at") + 1).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"))
