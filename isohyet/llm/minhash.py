"""Near-duplicates of five-word shingle sets by circulant MinHash, banding and exact verification.

Circulant MinHash needs two permutations only: ``sigma`` scatters the shingles over the 32-bit circle, and signature
coordinate k is the smallest value of ``pi`` shifted by k along that circle.  595 coordinates in 85 bands of 7 miss a
pair of likeness 0.75 with a probability of 5e-6.  Every link is confirmed on the full shingle sets.

Groups never turn into all pairs.  Equal sets are one class before banding.  Each bucket first links its members to
its smallest member only; components of these links are found; and only buckets that still hold several components
are looked at again, in blocks of bounded size: 256 one-byte signature values sort out pairs that are far from the
limit (six standard deviations), the rest is compared inside the block, which returns the links it found, not the
pairs it tried.

Defined cases: null and empty texts, and texts without words, have the empty set and no link.  Equal rows are linked.
Rows that share a doc_id count as one document for links through it.  A row without doc_id joins the class of equal
texts only.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.llm.common import dealt, released, runs, shielded, slices, stored, unshielded
from isohyet.llm.contraction import components
from isohyet.llm.words import mix64, shingle_sets

BANDS, ROWS = 85, 7
SKETCH = 256          # signature coordinates of which one byte is kept
BLOCK = 2048          # members of a bucket that are compared in one task
LIKENESS = 75         # per cent


def _pi(x: np.ndarray, spare: np.ndarray) -> None:
    """A fixed permutation of 32-bit numbers, in place."""
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        np.multiply(x, np.uint32(factor), out=x)
    np.right_shift(x, np.uint32(16), out=spare)
    np.bitwise_xor(x, spare, out=x)


def signatures(sets: np.ndarray, offsets: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """``size`` x texts; the sets must not be empty."""
    # sigma: the hashes are already spread over 64 bits, the upper half of another mixing is the place on the circle.
    places = (mix64(sets + np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    n = len(offsets) - 1
    out = np.empty((size, n), np.uint32)
    a = 0
    while a < n:  # pieces that stay in the processor's cache
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + 65536, side="right")) - 1)
        x = places[offsets[a]:offsets[b]]
        y, spare = np.empty_like(x), np.empty_like(x)
        for k in range(size):
            np.add(x, np.uint32(k), out=y)
            _pi(y, spare)
            out[k, a:b] = np.minimum.reduceat(y, offsets[a:b] - offsets[a])
        a = b
    return out


def _describe(batches):
    """Of each document: 128-bit hash of its set, size, band keys and sketch."""
    for batch in batches:
        texts, ids = batch["text"].to_pylist(), batch["doc_id"]
        for a, b in slices(texts):
            sets, offsets = shingle_sets(texts[a:b])
            n, part = np.diff(offsets), ids.slice(a, b - a)
            # An empty set is a class of its own.
            h1 = pc.fill_null(part, 0).to_numpy(zero_copy_only=False).view(np.uint64).copy()
            h2 = np.where(pc.is_null(part).to_numpy(zero_copy_only=False), 2, 0).astype(np.uint64)
            has = np.flatnonzero(n)
            keys, sketch = [None] * (b - a), [None] * (b - a)
            if len(has):
                starts = np.append(offsets[:-1][has], offsets[-1])
                h1[has] = mix64(np.add.reduceat(mix64(sets), starts[:-1]) + n[has].astype(np.uint64))
                h2[has] = mix64(np.add.reduceat(mix64(sets ^ np.uint64(0xA5A5A5A5)), starts[:-1])) | np.uint64(1)
                signature = signatures(sets, starts)
                band = np.empty((BANDS, len(has)), np.uint64)
                for i in range(BANDS):
                    key = np.full(len(has), np.uint64(i), np.uint64)
                    for row in signature[i * ROWS:(i + 1) * ROWS]:
                        key = mix64(key + row)
                    band[i] = key
                low = (signature[:SKETCH] & np.uint32(255)).astype(np.uint8).T.copy()
                for at, k, s in zip(has, band.T.copy().view(np.int64), low):
                    keys[at], sketch[at] = k, s.tobytes()
            yield pa.RecordBatch.from_arrays(
                [part, batch["text_key"].slice(a, b - a), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(n.astype(np.int64)),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                ["doc_id", "text_key", "h1", "h2", "n_shingles", "keys", "sketch"])


def _verify(batches):
    """Keeps the pairs whose full sets reach the limit."""
    for frame in batches:
        left, right = frame["ta"].tolist(), frame["tb"].tolist()
        for a, b in slices([x + y for x, y in zip(left, right)]):
            sets, offsets = shingle_sets(left[a:b] + right[a:b])
            m, n = b - a, np.diff(offsets)
            pair = np.repeat(np.concatenate((np.arange(m), np.arange(m))), n)
            order = np.lexsort((sets, pair))
            p, s = pair[order], sets[order]
            same = np.bincount(p[1:][(p[1:] == p[:-1]) & (s[1:] == s[:-1])], minlength=m) if len(p) else np.zeros(m)
            union = n[:m] + n[m:] - same
            ok = (union > 0) & (100 * same >= LIKENESS * union)
            yield frame[["a", "b"]].iloc[a:b][ok]


def verified(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` of doc_ids that are near-duplicates by their full shingle sets."""
    texts = documents.select("doc_id", "text").filter("doc_id is not null and text is not null")
    left = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInPandas(_verify, "a long, b long")


def _plausible(sketches: np.ndarray, sizes: np.ndarray, comps: np.ndarray, i: int, right: np.ndarray) -> np.ndarray:
    """Members of ``right`` in another component whose size and sketch are within reach of member i."""
    j = right[(comps[right] != comps[i])
              & (100 * np.minimum(sizes[right], sizes[i]) >= LIKENESS * np.maximum(sizes[right], sizes[i]))]
    for width in (SKETCH // 4, SKETCH):
        if not len(j):
            break
        same = np.count_nonzero(sketches[j, :width] == sketches[i, :width], axis=1)
        j = j[same >= width * (0.75 - 6 * (0.75 * 0.25 / width) ** 0.5)]
    return j


def _members(table: pa.Table):
    sketches = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(table.num_rows, -1)
    sizes, comps, part = (table[c].to_numpy() for c in ("n_shingles", "comp", "part"))
    left = np.flatnonzero(part == table["first"][0].as_py())
    right = np.flatnonzero(part == table["second"][0].as_py())
    one = table["first"][0] == table["second"][0]
    return sketches, sizes, comps, left, right, one


def _promising(batches):
    """The members of each block that have a plausible partner in it."""
    for table in runs(batches, ["key", "first", "second"]):
        sketches, sizes, comps, left, right, one = _members(table)
        marked = np.zeros(table.num_rows, bool)
        for at, i in enumerate(left):
            j = _plausible(sketches, sizes, comps, i, right[at + 1:] if one else right)
            if len(j):
                marked[i] = marked[j] = True
        if marked.any():
            yield from table.filter(pa.array(marked)).combine_chunks().to_batches()


def _confirmed(batches):
    """Links of each block that join its components, verified on full sets; a pair is tested in its first band only."""
    for table in runs(batches, ["key", "first", "second"]):
        sketches, sizes, comps, left, right, one = _members(table)
        comps = comps.copy()
        texts, nodes = table["text"].to_pylist(), table["node"].to_numpy()
        keys = np.array(table["keys"].to_pylist(), np.int64)
        key = table["key"][0].as_py()
        sets: dict[int, np.ndarray] = {}
        found = []

        def members_set(i):
            if i not in sets:
                sets[i] = shingle_sets([texts[i]])[0]
            return sets[i]

        for at, i in enumerate(left):
            for j in _plausible(sketches, sizes, comps, i, right[at + 1:] if one else right):
                if comps[i] == comps[j] or keys[i][np.argmax(keys[i] == keys[j])] != key:
                    continue
                x, y = members_set(i), members_set(j)
                both = np.sort(np.concatenate((x, y)), kind="stable")
                same = np.count_nonzero(both[1:] == both[:-1])
                if 100 * same >= LIKENESS * (len(both) - same):
                    found.append((nodes[i], nodes[j]))
                    comps[comps == comps[j]] = comps[i]
        if found:
            a, b = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _residual(bands: DataFrame, nodes: DataFrame, labels: DataFrame, documents: DataFrame) -> DataFrame:
    """Links between different components that share a bucket."""
    placed = (bands.join(labels, "node", "left")
              .select("key", "node", F.coalesce("component", "node").alias("comp")))
    split = (placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("m"))
             .filter("low < high").select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("parts")))
    members = (placed.join(split, "key")
               .join(nodes.select("node", "n_shingles", "sketch"), "node")
               .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int"))
               .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
               .withColumn("first", F.least("part", "other")).withColumn("second", F.greatest("part", "other"))
               .select("key", "first", "second", "node", "comp", "part", "n_shingles", "sketch"))
    block = ["key", "first", "second"]
    promising = stored(dealt(members, *block).mapInArrow(_promising, members.schema), "promising")
    texts = (documents.filter("doc_id is not null and text is not null")
             .select(F.col("doc_id").alias("node"), "text"))
    whole = promising.join(nodes.select("node", "keys"), "node").join(texts, "node")
    return dealt(whole, *block).mapInArrow(_confirmed, "a long, b long").distinct()


def _nodes(described: DataFrame, classes: DataFrame) -> DataFrame:
    """One described row of each class, that of its node.

    Spark joins by the document's id too, as it must equal the node; with it among the keys, copies of the row lie
    together already and the keys and sketches are shuffled once.
    """
    return (described.filter("n_shingles > 0 and doc_id is not null")
            .join(classes, ["h1", "h2"]).filter("doc_id = node")
            .dropDuplicates(["h1", "h2", "doc_id"])
            .select("node", "n_shingles", "keys", "sketch"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, text_key, kept`` for every row of ``documents(doc_id, text)``."""
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                                 F.xxhash64("text").alias("text_key"))
    described = stored(documents.mapInArrow(
        _describe, "doc_id long, text_key long, h1 long, h2 long, n_shingles long, keys array<long>, sketch binary"), "described")
    rows = stored(described.select("doc_id", "text_key", "h1", "h2", "n_shingles"), "rows")
    classes = stored(rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("node")), "classes")
    nodes = stored(_nodes(described, classes), "nodes")
    released(described)  # the keys and sketches that are needed from here on are those of the nodes
    banded = nodes.select("node", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("m")).filter("m > 1").drop("m")
    bands = stored(banded.join(shared, "key"), "bands")  # only buckets of two and more
    stars = bands.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    links = stored(verified(stars, documents), "links")
    labels = stored(components(links), "labels")
    more = stored(_residual(bands.select("key", "node"), nodes, labels, documents), "links")
    released(bands)
    released(nodes)
    # A doc_id with several sets is in all their classes.
    several = (rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min("h1").alias("low"), F.max("h1").alias("high"))
               .filter("low < high").select("doc_id"))
    same = rows.join(several, "doc_id").join(classes, ["h1", "h2"]).select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    final = components(more.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
                       .unionByName(links).unionByName(same))
    return (rows
            .join(classes, ["h1", "h2"])
            .join(final, "node", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"), "text_key")
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def deduplicate(documents: DataFrame) -> DataFrame:
    """One document of each group stays, that of the smallest doc_id; repeated rows of it become one.

    Documents without doc_id stay unless their text is that of another row.
    """
    named = shielded(documents, "doc_id", "text").withColumns(_identity(F.col("doc_id").cast("long"), F.xxhash64("text")))
    kept = near_duplicates(documents).filter("kept").select(*(v.alias(k) for k, v in _identity(F.col("doc_id"), F.col("text_key")).items())).distinct()
    keys = kept.columns
    # The keys of the join are among those of the copies, so that these lie together already.
    return unshielded(named.join(kept, keys, "left_semi").dropDuplicates(["doc_id", *keys]), documents, "doc_id", "text")


def _identity(doc_id: Column, text_key: Column) -> dict[str, Column]:
    """An id, null or not, and a text as columns that are equal as they are."""
    return {"__none": doc_id.isNull(), "__id": F.coalesce(doc_id, F.lit(0)), "__key": text_key}
