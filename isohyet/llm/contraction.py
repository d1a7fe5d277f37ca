"""Connected components that shrink the edges inside tasks before any shuffle.

Each task replaces the edges it reads by a star forest with the same components.  What is left goes through large and
small stars until it is stable, or until it fits one task (``EDGES``, 16 bytes each), which finishes it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.llm.common import stored
from isohyet.llm.components import _large_star, _small_star

EDGES = 1 << 21      # edges that one task may finish
HELD = 1 << 20       # edges that a task holds before it shrinks them

SCHEMA = "a long, b long"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges that are not the smallest of their component, and that smallest one."""
    nodes, places = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = places[:len(a)], places[len(a):]
    root = np.arange(len(nodes))
    while True:
        x, y = root[u], root[v]
        open_ = x != y
        if not open_.any():
            break
        u, v, x, y = u[open_], v[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _shrunk(batches):
    a, b, size = [], [], 0

    def out(pair):
        return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["a", "b"])

    for batch in batches:
        a.append(batch["a"].to_numpy())
        b.append(batch["b"].to_numpy())
        size += batch.num_rows
        if size > HELD:
            pair = forest(np.concatenate(a), np.concatenate(b))
            a, b, size = [pair[0]], [pair[1]], len(pair[0])
            if size > HELD // 2:
                yield out(pair)
                a, b, size = [], [], 0
    if size:
        yield out(forest(np.concatenate(a), np.concatenate(b)))


def _finished(batches):
    pairs = [(batch["a"].to_numpy(), batch["b"].to_numpy()) for batch in batches if batch.num_rows]
    if pairs:
        a, b = forest(*map(np.concatenate, zip(*pairs)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; the component is its smallest node."""
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    edges, state = stored(edges.mapInArrow(_shrunk, SCHEMA), "edges"), None
    while True:
        facts = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if facts[0] <= EDGES:
            edges = stored(edges.repartition(1).mapInArrow(_finished, SCHEMA), "forest")
            break
        if facts == state:
            break
        state = facts
        edges = stored(_small_star(_large_star(edges)).distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
