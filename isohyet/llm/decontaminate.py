"""Benchmark decontamination by Wu-Manber search over words.

The strings searched for are windows of 13 consecutive words of the benchmark items (an item of fewer words is one
window).  Windows of one length share tables: the shift table says for each block of two words how far the search may
move on, and windows whose last block is the one at hand are found under its hash; they are then compared word by
word.  All texts of a batch are searched in step, one array position per stretch of text, so the scan runs in numpy.

The windows travel to the tasks in blocks of bounded size (``BLOCK`` characters of item text); a larger benchmark is
searched block by block over the stored intermediate hits.

Defined cases: words are runs outside ASCII other than letters and digits, after lower-casing A-Z.  Null and empty
texts have no words and no hit.  Repeated items count once by their id; items without id mark words but are not
listed.  Repeated rows and rows without doc_id are judged like others.  Other columns are ignored or carried along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.llm.common import shielded, slices, stored, unshielded
from isohyet.llm.words import PUNCTUATION, Words

WINDOW = 13
BLOCK = 16_000_000   # characters of item text in one task's tables
SHARE = 20           # contaminated: at least one word in 20 is hit
STRETCH = 256        # words that one array position walks over


class Patterns:
    """Windows of some items, ready for the search."""

    def __init__(self, items: list[tuple]):
        words = Words([text for _, text in items], PUNCTUATION)
        windows: dict[tuple[bytes, ...], set] = {}
        for t, (item, _) in enumerate(items):
            own = [words.word(i) for i in range(words.first[t], words.first[t + 1])]
            for i in range(max(len(own) - WINDOW, 0) + 1 if own else 0):
                windows.setdefault(tuple(own[i:i + WINDOW]), set()).add(None if item is None else str(item))
        self.windows = list(windows)
        self.items = [sorted(x for x in windows[w] if x is not None) for w in self.windows]
        hashes = words.hashes()
        self.vocabulary, place = np.unique(hashes, return_index=True)
        self.spelling = [words.word(i) for i in place]
        code = {w: i for i, w in enumerate(self.spelling)}
        self.tables = [self._table(m, code) for m in sorted({len(w) for w in self.windows})]

    def _table(self, m: int, code: dict) -> tuple:
        chosen = [i for i, w in enumerate(self.windows) if len(w) == m]
        matrix = np.array([[code[x] for x in self.windows[i]] for i in chosen], np.int64)
        width = min(2, m)  # words of a block
        blocks = np.stack([self._block(matrix, j, width) for j in range(width - 1, m)], 1)
        shift = np.full(1 << 16, m - width + 1, np.int64)
        for j in range(blocks.shape[1]):
            np.minimum.at(shift, blocks[:, j] & 0xFFFF, blocks.shape[1] - 1 - j)
        order = np.argsort(blocks[:, -1], kind="stable")
        return m, width, shift, blocks[order, -1], matrix[order], np.array(chosen)[order]

    @staticmethod
    def _block(codes: np.ndarray, j, width: int) -> np.ndarray:
        """Hash of the block that ends at column j."""
        last = codes[:, j]
        return last if width == 1 else codes[:, j - 1] * 0x9E3779B1 + last * 0x85EBCA77 + (last >> 3)

    def search(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences: first word, one past the last word, window."""
        hashes = words.hashes()
        codes = np.full(len(hashes), -1, np.int64)
        if len(hashes) and len(self.vocabulary):
            place = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
            known = self.vocabulary[place] == hashes
            codes[known] = place[known]
        found = [self._search(table, codes, words) for table in self.tables]
        return tuple(np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else ((), (), ())))

    def _search(self, table: tuple, codes: np.ndarray, words: Words) -> tuple:
        m, width, shift, suffix, matrix, window = table
        far = m - width + 1
        # Stretches of the places where a window may end.
        low, high = words.first[:-1] + m - 1, words.first[1:]
        n = np.maximum(-(-(high - low) // STRETCH), 0)
        text = np.repeat(np.arange(len(n)), n)
        at = low[text] + STRETCH * (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n))
        limit = np.minimum(at + STRETCH, high[text])
        hits = []
        while len(at):
            last = codes[at]
            known = last >= 0
            if width == 2:
                before = codes[at - 1]
                known &= before >= 0
                block = before * 0x9E3779B1 + last * 0x85EBCA77 + (last >> 3)
            else:
                block = last
            step = np.where(known, shift[block & 0xFFFF], far)
            here = np.flatnonzero(step == 0)
            if len(here):
                hits.append(self._compare(at[here], block[here], codes, m, suffix, matrix, window))
            at = at + np.maximum(step, 1)
            keep = at < limit
            at, limit = at[keep], limit[keep]
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        end, which = (np.concatenate(x) for x in zip(*hits))
        # Direct comparison of the spellings: equal codes came from 64-bit hashes.
        ok = np.fromiter((all(words.word(e - m + 1 + i) == w for i, w in enumerate(self.windows[p]))
                          for e, p in zip(end, which)), bool, len(end))
        return end[ok] - m + 1, end[ok] + 1, which[ok]

    @staticmethod
    def _compare(end, block, codes, m, suffix, matrix, window):
        """Windows under the block's hash whose words all agree with those before ``end``."""
        a, b = np.searchsorted(suffix, block, "left"), np.searchsorted(suffix, block, "right")
        where = np.repeat(np.arange(len(end)), b - a)
        candidate = np.repeat(a, b - a) + np.arange(len(where)) - np.repeat(np.cumsum(b - a) - (b - a), b - a)
        for j in range(m - 1, -1, -1):  # from the last word on, fewer and fewer candidates
            ok = codes[end[where] - (m - 1 - j)] == matrix[candidate, j]
            where, candidate = where[ok], candidate[ok]
        return end[where], window[candidate]


def _kernel(items: list[tuple]):
    def run(batches):
        patterns = Patterns(items)
        for batch in batches:
            texts = batch["text"].to_pylist()
            for a, b in slices(texts):
                words = Words(texts[a:b], PUNCTUATION)
                first, past, which = patterns.search(words)
                owner = words.text[first] if len(first) else first
                hits, found = [[] for _ in range(b - a)], [[] for _ in range(b - a)]
                for t in np.unique(owner):
                    mine = owner == t
                    places = np.concatenate([np.arange(x, y) for x, y in zip(first[mine], past[mine])])
                    hits[t] = np.unique(places - words.first[t]).tolist()
                    found[t] = sorted({i for p in set(which[mine].tolist()) for i in patterns.items[p]})
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(words.n), pa.array(hits, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))],
                    [*part.schema.names, "n_words", "hits", "items"])

    return run


def _searched(documents: DataFrame, items: list[tuple]) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    return documents.mapInArrow(_kernel(items), f"{schema}, n_words long, hits array<int>, items array<string>")


def _rows(benchmark: DataFrame) -> list[tuple]:
    return [(r["item_id"], r["text"]) for r in benchmark.collect()]  # one block: at most BLOCK characters or one item


def hits(documents: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """``documents`` with ``n_words``, ``hits`` (places of hit words) and ``items`` (ids of items with occurring windows);
    columns of these names are replaced."""
    documents = documents.drop("n_words", "hits", "items")
    items = benchmark.select("item_id", "text").filter("text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()[0]
    blocks = int(-(-size // block)) or 1
    if blocks == 1:
        return _searched(documents, _rows(items))
    # Each block adds its hits by row key; equal keys are equal texts, so repeated rows need no place of their own.
    named = documents.withColumn("__key", F.xxhash64("text"))
    texts = stored(named.select("__key", "text").dropDuplicates(["__key"]), "texts")
    total = None
    for i in range(blocks):
        part = _rows(items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == i))
        found = _searched(texts, part).drop("text")
        total = stored(found if total is None else found.unionByName(total).groupBy("__key").agg(
            F.max("n_words").alias("n_words"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")), "hits")
    return named.join(total, "__key").drop("__key")


def judged(found: DataFrame) -> DataFrame:
    n_hit = F.size("hits").cast("long")
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", (n_hit > 0) & (SHARE * n_hit >= F.col("n_words")))


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated."""
    kept = judged(hits(shielded(documents, "text"), benchmark)).filter(~F.col("contaminated"))
    return unshielded(kept, documents, "text")
