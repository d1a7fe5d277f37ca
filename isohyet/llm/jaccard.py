"""Self-join of documents on the Jaccard likeness of their word shingles, by T-occurrence search.

A query of n shingles needs T = ceil(likeness n) occurrences in the inverted lists of its shingles.  DivideSkip takes the
L longest lists aside, merges the short ones with a heap that skips ids which cannot reach T - L any more, and probes
the long lists for the ids that do, by binary search; the exact overlap decides.

What is searched together comes from the pigeonhole principle, without loss.  Documents whose sizes can be within the
likeness share a group (each is in two); a group cuts the universe of shingles into more segments than linked sets
can differ in, so linked documents agree on whole segments.  Equal segments chain documents into candidate clusters
(segments of one or two shingles say little and are left out where enough others must agree); a cluster is one block,
or parts of bounded size.  Inside a block, pivots first gather the documents around them, and only documents of
different components are searched again, the heap skipping the rest of a component once it is linked.  Parts of a
large cluster all hold its first document; where several components remain, the documents outside the largest
are searched in all other parts.  Equal sets are one document throughout, so copies never meet.

Shingles are 64-bit hashes, equal sets are known by 128 bits.  Defined cases: null and empty texts and texts without
words have the empty set and no link.  Rows that share a doc_id count as one document for links through it, whatever
their texts; equal rows are linked.  A row without doc_id joins the class of equal sets only and is null in
``component_id`` if the class has no doc_id.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from heapq import heapify, heappop, heappush
from math import log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.llm.common import dealt, joined, runs, slices, stored
from isohyet.llm.contraction import components
from isohyet.llm.words import mix64, shingle_sets

WIDTH, LIKENESS = 3, 90     # words a shingle, per cent
MEMBERS = 512               # documents and
SHINGLES = 4_000_000        # shingles of a part
HELD = 1 << 20              # segment keys that are linked inside a task before the shuffle
WEAK = 2                    # shingles of a segment that says little
MU = 0.0001                 # DivideSkip's balance between merging and probing
PROBED = 64                 # ids that are probed in the long lists at a time


def limits(most: int, likeness: int) -> np.ndarray:
    """Smallest sizes of the bands up to size ``most``: linked sets are in one band or in two neighbouring ones."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * 100 // likeness + 1)
    return np.array(out + [out[-1] * 100 // likeness + 1], np.int64)


def segment_keys(sets: np.ndarray, offsets: np.ndarray, likeness: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and the text of each: linked texts that differ have a key in common."""
    n = np.diff(offsets)
    bounds = limits(int(n.max(initial=1)), likeness)
    band = np.searchsorted(bounds, n, side="right") - 1
    place, value = mix64(sets + np.uint64(0x6A09E667F3BCC909)) >> np.uint64(32), mix64(sets ^ np.uint64(0xBB67AE8584CAA73B))
    keys, owners = [], []
    for group in (band, band + 1):  # with the band below, and as the band below
        upper = bounds[np.minimum(group + 1, len(bounds) - 1)]
        upper = np.where(group + 1 < len(bounds), upper, bounds[-1] * 100 // likeness + 1)
        differ = 2 * (upper - 1) * (100 - likeness) // (100 + likeness)
        slack = np.where(differ > 0, differ // 32 + 1, 0)
        segments = np.where((differ > 0) & (n > 0), differ + 1 + slack, 0)
        first = np.concatenate(([0], np.cumsum(segments)))
        text = np.repeat(np.arange(len(n)), n)
        used = segments[text] > 0
        at = first[text] + ((place * segments[text].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        sums, count = np.zeros(first[-1], np.uint64), np.bincount(at[used], minlength=first[-1])
        np.add.at(sums, at[used], value[used])
        owner = np.repeat(np.arange(len(n)), segments)
        index = np.arange(first[-1]) - first[owner]
        weak = count <= WEAK
        kept = ~weak | (np.bincount(owner[weak], minlength=len(n)) > slack)[owner]
        names = mix64(group[owner].astype(np.uint64) << np.uint64(32) | index.astype(np.uint64))
        keys.append(mix64(sums + names)[kept])
        owners.append(owner[kept])
    return np.concatenate(keys), np.concatenate(owners)


def _describe(width: int, likeness: int):
    def task(batches):
        for batch in batches:
            texts, ids = batch["text"].to_pylist(), batch["doc_id"]
            for a, b in slices(texts):
                sets, offsets = shingle_sets(texts[a:b], width)
                n, part = np.diff(offsets), ids.slice(a, b - a)
                # An empty set is a class of its own.
                h1 = pc.fill_null(part, 0).to_numpy(zero_copy_only=False).view(np.uint64).copy()
                h2 = np.where(pc.is_null(part).to_numpy(zero_copy_only=False), 2, 0).astype(np.uint64)
                has = np.flatnonzero(n)
                if len(has):
                    h1[has] = mix64(np.add.reduceat(mix64(sets), offsets[:-1][has]) + n[has].astype(np.uint64))
                    h2[has] = mix64(np.add.reduceat(mix64(sets ^ np.uint64(0xA5A5A5A5)), offsets[:-1][has])) | np.uint64(1)
                keys, owner = segment_keys(sets, offsets, likeness)
                order = np.argsort(owner, kind="stable")
                ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(n)))))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[order].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part, batch["text_key"].slice(a, b - a), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)),
                     pa.array(n.astype(np.int64)), lists], ["doc_id", "text_key", "h1", "h2", "n_shingles", "keys"])

    return task


def _linked_here(batches):
    """Sets with a key in common are linked to the first one inside the task; only that one goes on with the key.

    Rows are ``key, a`` for keys that go on and ``key, a, b`` for links, which are dealt out by ``a``."""
    keys, sets, size = [], [], 0

    def flush():
        key, node = np.concatenate(keys), np.concatenate(sets)
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        first = node[np.flatnonzero(new)[np.cumsum(new) - 1]]
        pairs = np.unique(np.stack((node[node != first], first[node != first])), axis=1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((key[new], pairs[0]))), pa.array(np.concatenate((node[new], pairs[0]))),
             pa.concat_arrays([pa.nulls(int(new.sum()), pa.int64()), pa.array(pairs[1])])], ["key", "a", "b"])

    for batch in batches:
        lists = batch["keys"]
        keys.append(pc.list_flatten(lists).to_numpy(zero_copy_only=False))
        sets.append(np.repeat(batch["h1"].to_numpy(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
        size += len(keys[-1])
        if size > HELD:
            yield from flush()
            keys, sets, size = [], [], 0
    if size:
        yield from flush()


def _linked(batches):
    """Links of the keys' runs to the first set of the run, next to the links that came along."""
    key = first = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, a, b = (batch[c].to_numpy(zero_copy_only=False) for c in ("key", "a", "b"))
        came = pc.is_valid(batch["b"]).to_numpy(zero_copy_only=False)
        there = np.stack((a[came], pc.drop_null(batch["b"]).to_numpy(zero_copy_only=False)))
        keys, a = keys[~came], a[~came]
        if len(keys):
            new = np.concatenate(([keys[0] != key], keys[1:] != keys[:-1]))
            starts = np.flatnonzero(new)
            run = np.cumsum(new) - 1
            firsts = np.where(run >= 0, a[starts[np.maximum(run, 0)]] if len(starts) else first, 0 if first is None else first)
            there = np.concatenate((there, np.stack((a, firsts))[:, a != firsts]), axis=1)
            key, first = keys[-1], firsts[-1]
        if there.shape[1]:
            there = np.unique(there, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(there[0]), pa.array(there[1])], ["a", "b"])


def candidate_clusters(described: DataFrame) -> DataFrame:
    """``h1, cluster`` of all sets that agree with another on a segment, directly or in a chain."""
    here = described.select("h1", "keys").mapInArrow(_linked_here, "key long, a long, b long")
    n = int(described.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = here.repartition(n, "key").sortWithinPartitions("key", "a").mapInArrow(_linked, "a long, b long")
    return components(edges).select(F.col("node").alias("h1"), F.col("component").alias("cluster"))


class Index:
    """Inverted lists of the sets in a block; ids are places in it."""

    def __init__(self, sets: np.ndarray, offsets: np.ndarray, likeness: int):
        self.likeness, self.lengths, self.m = likeness, np.diff(offsets), len(offsets) - 1
        self.sizes = self.lengths.tolist()
        owner = np.repeat(np.arange(self.m), np.diff(offsets))
        order = np.argsort(sets, kind="stable")  # ids ascend inside a list
        new = np.concatenate((np.ones(min(len(sets), 1), bool), sets[order][1:] != sets[order][:-1]))
        number = np.empty(len(sets), np.int64)
        number[order] = np.cumsum(new) - 1
        self.shingles, self.ends = sets[order][new], np.append(np.flatnonzero(new)[1:], len(sets))
        self.postings = owner[order]
        self.places = number[order] * self.m + self.postings  # ascending: one binary search probes a list
        self.of = [number[a:b] for a, b in zip(offsets[:-1], offsets[1:])]

    def lists(self, shingles: np.ndarray) -> np.ndarray:
        """The lists of a foreign set."""
        if not len(self.shingles):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.shingles, shingles), len(self.shingles) - 1)
        return at[self.shingles[at] == shingles]

    def search(self, lists: np.ndarray, size: int, after: int, skip):
        """Ids from ``after`` on that a set of ``size`` shingles, in ``lists``, is linked with.

        ``skip(id)`` gives the next id of interest; above ``id``, it is not looked at."""
        need = -(-self.likeness * size // 100)
        low, high = np.searchsorted(self.places, lists * self.m + after), self.ends[lists]
        live = low < high
        if np.count_nonzero(live) < need or not need:
            return
        lists, low, high = lists[live], low[live], high[live]
        order = np.argsort(low - high, kind="stable")  # longest first
        longest = int((high - low).max())
        aside = min(need - 1, int(need / (MU * log2(longest) + 1)))
        probed, short, least = lists[order[:aside]], order[aside:], need - aside
        values = [self.postings[a:b].tolist() for a, b in zip(low[short], high[short])]
        heap = [(v[0], i) for i, v in enumerate(values)]
        heapify(heap)
        at = [0] * len(values)
        waiting: list[int] = []   # ids that reached T - L, with their counts; probed together
        counts: list[int] = []
        while len(heap) >= least:
            found, out = heap[0][0], []
            while heap and heap[0][0] == found:
                out.append(heappop(heap)[1])
            if len(out) >= least:
                go = skip(found)
                if go == found:
                    waiting.append(found)
                    counts.append(len(out))
                    go = found + 1
                    if len(waiting) == PROBED:
                        yield from self._reached(waiting, counts, probed, size, skip)
                        waiting, counts = [], []
                        go = max(skip(found), go)
            else:
                while heap and len(out) < least - 1:
                    out.append(heappop(heap)[1])
                if not heap:
                    break
                go = heap[0][0]
            for i in out:
                place = bisect_left(values[i], go, at[i])
                if place < len(values[i]):
                    at[i] = place
                    heappush(heap, (values[i][place], i))
        if waiting:
            yield from self._reached(waiting, counts, probed, size, skip)

    def _reached(self, ids: list[int], counts: list[int], probed: np.ndarray, size: int, skip):
        """Those of the ids that reach the overlap with the long lists, unless they became uninteresting meanwhile."""
        who = np.array(ids, np.int64)
        places = (probed[:, None] * self.m + who[None, :]).ravel()
        at = np.minimum(np.searchsorted(self.places, places), len(self.places) - 1)
        both = np.array(counts) + (self.places[at] == places).reshape(len(probed), len(who)).sum(axis=0)
        linked = 100 * both >= self.likeness * (size + self.lengths[who] - both)
        for found in who[linked].tolist():
            if skip(found) == found:
                yield found


class _Groups:
    """Union-find over small numbers."""

    def __init__(self, m: int):
        self.up = list(range(m))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _arranged(sets: np.ndarray, offsets: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pieces = [sets[offsets[i]:offsets[i + 1]] for i in order]
    return np.concatenate(pieces), np.concatenate(([0], np.cumsum([len(p) for p in pieces])))


def links(sets: np.ndarray, offsets: np.ndarray, likeness: int) -> list[tuple[int, int]]:
    """Links between the sets that hold their components together; no component is missed or too large."""
    index, m = Index(sets, offsets, likeness), len(offsets) - 1
    groups, found, free, pivots = _Groups(m), [], [True] * m, [False] * m
    for pivot in range(m):
        if free[pivot]:
            free[pivot], pivots[pivot] = False, True
            # Pivots before this one have searched it already.
            for other in index.search(index.of[pivot], index.sizes[pivot], 0,
                                      lambda i: i + 1 if pivots[i] or groups.find(i) == groups.find(pivot) else i):
                free[other] = False
                groups.join(pivot, other)
                found.append((pivot, other))
    # Whatever links are left are between documents that are no pivots, in different components.
    rest = np.flatnonzero(~np.array(pivots))
    label = np.array([groups.find(i) for i in rest], np.int64)
    kinds, kind, size = np.unique(label, return_inverse=True, return_counts=True)
    if len(kinds) < 2:
        return found
    # Components side by side, the largest last: its members need not search.
    by_size = np.lexsort((rest, kind, size[kind]))
    order, kind = rest[by_size], kind[by_size].tolist()
    index = Index(*_arranged(sets, offsets, order), likeness)
    end = {k: i + 1 for i, k in enumerate(kind)}
    groups = _Groups(len(kinds))
    for query in range(len(order)):
        for other in index.search(index.of[query], index.sizes[query], end[kind[query]],
                                  lambda i: i if groups.find(kind[i]) != groups.find(kind[query]) else end[kind[i]]):
            groups.join(kind[query], kind[other])
            found.append((int(order[query]), int(order[other])))
    return found


def _pairs(a, b):
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _inside(width: int, likeness: int):
    def task(batches):
        for table in runs(batches, ["cluster", "part"]):
            if table.num_rows > 1:
                nodes = table["node"].to_numpy()
                found = links(*shingle_sets(table["text"].to_pylist(), width), likeness)
                if found:
                    a, b = zip(*found)
                    yield _pairs(nodes[list(a)], nodes[list(b)])

    return task


def _across(width: int, likeness: int):
    """Members of other parts (``own`` >= 0) searched in a part (``own`` = -1, which comes first)."""

    def task(batches):
        index = at = nodes = kinds = None
        for table in runs(batches, ["cluster", "part", "own"]):
            key = table["cluster"][0].as_py(), table["part"][0].as_py()
            sets, offsets = shingle_sets(table["text"].to_pylist(), width)
            if table["own"][0].as_py() < 0:
                kind = table["component"].to_numpy()
                order = np.argsort(kind, kind="stable")
                index, at = Index(*_arranged(sets, offsets, order), likeness), key
                nodes, kinds = table["node"].to_numpy()[order], kind[order]
                end = {k: i + 1 for i, k in enumerate(kinds.tolist())}
            elif at == key:
                known: set[tuple[int, int]] = set()
                found = []
                for node, kind, a, b in zip(table["node"].to_pylist(), table["component"].to_pylist(), offsets[:-1], offsets[1:]):
                    def skip(i):
                        other = int(kinds[i])
                        return end[other] if other == kind or (kind, other) in known else i

                    for i in index.search(index.lists(sets[a:b]), int(b - a), 0, skip):
                        known.add((kind, int(kinds[i])))
                        found.append((node, int(nodes[i])))
                if found:
                    yield _pairs(*zip(*found))

    return task


def _first_copies(batches):
    """Repeated rows of a batch once, before they are shuffled."""
    for batch in batches:
        if batch.num_rows:
            keys = np.stack((batch["doc_id"].to_numpy(), batch["text_key"].to_numpy()))
            yield batch.take(pa.array(np.unique(keys, axis=1, return_index=True)[1]))


def _one_a_node(batches):
    """One row of each member; rows come sorted, and only the last one is remembered."""
    last = None
    for batch in batches:
        if batch.num_rows:
            keys = np.stack([batch[c].to_numpy() for c in ("node", "h1", "h2", "part")], axis=1)
            new = np.concatenate(([last is None or bool((keys[0] != last).any())], (keys[1:] != keys[:-1]).any(axis=1)))
            last = keys[-1]
            yield batch.filter(pa.array(new))


def _cluster_links(documents: DataFrame, members: DataFrame, width: int, likeness: int) -> DataFrame:
    """Links of ``members(node, text_key, h1, h2, n_shingles, cluster)`` that hold their components together."""
    sizes = (members.groupBy("cluster").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("n"), F.min(F.struct("node", "h1", "h2")).alias("pivot"))
             .filter("m > 1")
             .select("cluster", F.col("m").alias("copies"), "pivot",
                     F.ceil(F.greatest(F.col("m") / MEMBERS, F.col("n") / SHINGLES)).cast("int").alias("parts")))
    sizes = stored(sizes, "clusters")
    own = F.pmod(F.xxhash64("node", "h1", "h2"), F.col("parts").cast("long")).cast("int")
    is_pivot = F.struct("node", "h1", "h2") == F.col("pivot")
    placed = (joined(members, sizes, ["cluster"], "copies")
              .withColumn("part", F.explode(F.when(is_pivot, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own)))))
    texts = (documents.filter("doc_id is not null and text is not null").mapInArrow(_first_copies, documents.schema)
             .withColumnsRenamed({"doc_id": "node"}))
    whole = placed.drop("copies", "pivot", "n_shingles").join(texts, ["node", "text_key"])
    wanted = ["cluster", "part", "node", "h1", "h2", "parts", "text"]
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = stored(whole.select(*wanted).repartition(n, "cluster", "part").sortWithinPartitions("cluster", "part", "node", "h1", "h2")
                    .mapInArrow(_one_a_node, whole.select(*wanted).schema), "blocks")
    found = stored(dealt(blocks.select("cluster", "part", "node", "text"), "cluster", "part").mapInArrow(_inside(width, likeness), "a long, b long"), "links")
    # Clusters of several parts that are not one component yet.
    several = blocks.filter("parts > 1")
    if several.isEmpty():
        return found
    labels = stored(components(found), "labels")
    placed = (several.withColumn("own", own).filter("part = own").drop("own")
              .join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")))
    counted = stored(placed.groupBy("cluster", "component").agg(F.count("*").alias("m")), "components")
    split = (counted.groupBy("cluster").agg(F.max(F.struct("m", "component")).alias("largest"), F.count("*").alias("k"), F.sum("m").alias("copies"))
             .filter("k > 1").select("cluster", "copies", F.col("largest.component").alias("largest")))
    open_ = joined(placed, stored(split, "open"), ["cluster"], "copies")
    columns = ["cluster", "part", "own", "node", "component", "text"]
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: p != F.col("own"))
    queries = (open_.filter("component <> largest").withColumnRenamed("part", "own").withColumn("part", F.explode(others)))
    both = open_.withColumn("own", F.lit(-1)).select(*columns).unionByName(queries.select(*columns))
    more = both.repartition(n, "cluster", "part").sortWithinPartitions("cluster", "part", "own").mapInArrow(_across(width, likeness), "a long, b long")
    return found.unionByName(stored(more, "links"))


def join(documents: DataFrame, width: int = WIDTH, likeness: int = LIKENESS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``documents(doc_id, text)``."""
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_key"))
    described = stored(documents.mapInArrow(
        _describe(width, likeness), "doc_id long, text_key long, h1 long, h2 long, n_shingles long, keys array<long>"), "described")
    rows = described.select("doc_id", "text_key", "h1", "h2", "n_shingles")
    first = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_key"))
    classes = stored(rows.groupBy("h1", "h2", "n_shingles").agg(F.min(first).alias("first"), F.count("*").alias("copies"))
                     .withColumn("node", F.col("first.doc_id")).withColumn("text_key", F.col("first.text_key")).drop("first"), "classes")
    members = (classes.filter("node is not null and n_shingles > 0").drop("copies").join(candidate_clusters(described), "h1"))
    found = _cluster_links(documents, stored(members, "members"), width, likeness)
    # A doc_id with several sets is in all their classes.
    several = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min("h1").alias("low"), F.max("h1").alias("high"), F.count("*").alias("copies")).filter("low < high").select("doc_id", "copies")
    shared = joined(rows, several, ["doc_id"], "copies").join(classes.select("h1", "h2", "node"), ["h1", "h2"])
    final = components(found.unionByName(shared.select(F.col("doc_id").alias("a"), F.col("node").alias("b"))))
    labelled = classes.join(final, "node", "left").select("h1", "h2", "copies", F.coalesce("component", "node").alias("component_id"))
    return joined(rows, stored(labelled, "labelled"), ["h1", "h2"], "copies").select("doc_id", "n_shingles", "component_id")
