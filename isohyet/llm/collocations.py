"""Phrases whose words occur together more often than apart, by Apriori levels over broadcast double-array tries.

Words are counted first; those that are frequent in their language get numbers, and texts are stored once as runs of
such numbers.  Level k then counts candidate phrases of k words.  They go out as double-array tries, ``BLOCK`` phrases
at a time, a word being one step a digit of its number; in each task numpy moves the states of all text positions one word further at a time, a bincount over the
accepting states gives the shard's counts, and Spark sums the shards.  The same scan finds the next level's
candidates: a position that accepted phrase p hands on (p, next word) with a count, if the k words from its second one
on are a candidate too (tested in a bit table of fixed size, which may let more through but never less).  Before that,
a scan counts the pairs by hash in a table of fixed size, and pairs whose counter stays below the limit are not handed
on at all.  Pairs whose sum reaches the limit are the next candidates.  At level 1 a frequent word is its own state.

Words are known by two independent 64-bit hashes.  A broadcast holds at most ``WORDS`` words or ``BLOCK`` phrases; more
of them need more scans, one after the other.

Defined cases: null texts are empty; a null language is ``und``; repeated rows and rows without doc_id count like any
other; texts without words and empty tables add nothing; ties are ordered by phrase.  Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isohyet.llm.common import dealt, slices, stored
from isohyet.llm.trie import DoubleArray, build, digits
from isohyet.llm.words import Words, hashed, mix64

LEAST, LONGEST, TOP = 100, 5, 2000
WORDS = 1 << 21      # words and
BLOCK = 1 << 18      # phrases in one broadcast
BITS = 24            # the bit table has 2**BITS bits
COUNTERS = 23        # 2**COUNTERS one-byte counters of hashed continuations, summed in
PIECE = 1 << 16      # pieces of so many
HELD = 1 << 20       # counts that a task holds before it adds them up
NEXT = 1 << 32       # a continuation is phrase * NEXT + word; 0 in place of the word is the phrase itself

_BREAKS = np.zeros(256, bool)  # end a piece
_BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_APART = _BREAKS.copy()        # end a word
_APART[[0x20, 0x09]] = True
_SECOND = np.random.default_rng(11).permutation(256).astype(np.uint8)


def _language_hash(lang: str) -> int:
    data = np.frombuffer(lang.encode("utf-8", "surrogatepass") + b"\x00", np.uint8)
    return int(hashed(data, np.array([0]), np.array([len(data)]))[0])


class Pieces(Words):
    """Words of texts; ``linked[i]`` tells whether word i + 1 follows in the same piece, ``key`` and ``proof`` are two
    hashes of the word in its language."""

    def __init__(self, texts, langs):
        super().__init__(texts, _APART)
        self.linked = np.zeros(len(self.start), bool)
        if len(self.start):
            breaks = np.flatnonzero(_BREAKS[self.raw])
            self.linked[:-1] = ((self.text[1:] == self.text[:-1])
                                & (np.searchsorted(breaks, self.start[1:]) == np.searchsorted(breaks, self.end[:-1])))
        language = np.array([_language_hash(x) for x in langs], np.uint64)[self.text]
        self.key = mix64(self.hashes() + language)
        self.proof = hashed(_SECOND[self.raw], self.start, self.end) + language if len(self.start) else self.key

    def spelled(self, which: np.ndarray) -> pa.Array:
        """Some of the words, as an Arrow array."""
        size = self.end[which] - self.start[which]
        ends = np.concatenate(([0], np.cumsum(size)))
        raw = self.raw[np.repeat(self.start[which] - ends[:-1], size) + np.arange(ends[-1])]
        return pa.Array.from_buffers(pa.string(), len(which), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])


def _texts(batches):
    for batch in batches:
        texts, langs = batch["text"].to_pylist(), batch["lang"].to_pylist()
        for a, b in slices(texts):
            yield Pieces(texts[a:b], langs[a:b]), langs[a:b], batch.slice(a, b - a)


def _count_words(batches):
    """``lang, word, key, proof, f`` of each task's words, added up as long as they fit."""
    held, size = [], 0

    def flush():
        whole = pa.concat_tables(held).combine_chunks()
        key, proof = (whole[c].to_numpy() for c in ("key", "proof"))
        order = np.lexsort((proof, key))
        new = np.flatnonzero(np.concatenate(([True], (key[order][1:] != key[order][:-1]) | (proof[order][1:] != proof[order][:-1]))))
        out = whole.take(pa.array(order[new]))
        return out.set_column(out.schema.get_field_index("f"), "f", pa.array(np.add.reduceat(whole["f"].to_numpy()[order], new)))

    for pieces, langs, _ in _texts(batches):
        if not len(pieces.key):
            continue
        order = np.lexsort((pieces.proof, pieces.key))
        key, proof = pieces.key[order], pieces.proof[order]
        new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (proof[1:] != proof[:-1]))))
        which = order[new]
        held.append(pa.table({
            "lang": pa.array(langs, pa.string()).take(pa.array(pieces.text[which])), "word": pieces.spelled(which),
            "key": pa.array(key[new].view(np.int64)), "proof": pa.array(proof[new].view(np.int64)),
            "f": pa.array(np.diff(np.append(new, len(key))).astype(np.int64))}))
        size += len(which)
        if size > HELD // 4:
            held = [flush()]
            size = held[0].num_rows
            if size > HELD // 8:
                yield from held[0].to_batches()
                held, size = [], 0
    if held:
        yield from flush().to_batches()


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """Stored rows with a number from 1 on, without gaps; only the sizes of the partitions reach the driver."""
    low = F.lit((1 << 33) - 1).cast("long")
    placed = stored(rows.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(low)}), "numbered")
    sizes = sorted(placed.groupBy("_part").agg(F.count("*").alias("n")).collect())
    before = np.concatenate(([0], np.cumsum([n for _, n in sizes])))
    starts = rows.sparkSession.createDataFrame([(p, int(b)) for (p, _), b in zip(sizes, before)], "_part int, _before long")
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


@dataclass(frozen=True)
class Vocabulary:
    """Words of one broadcast by their hashes, ascending, with their codes."""

    key: np.ndarray
    proof: np.ndarray
    code: np.ndarray
    most: int            # words of one key

    def codes(self, pieces: Pieces) -> np.ndarray:
        out = np.zeros(len(pieces.key), np.int32)
        if len(self.key):
            at = np.searchsorted(self.key, pieces.key)
            for shift in range(self.most):
                here = np.minimum(at + shift, len(self.key) - 1)
                same = (self.key[here] == pieces.key) & (self.proof[here] == pieces.proof)
                out[same] = self.code[here[same]]
        return out


def _vocabulary(rows: pa.Table) -> Vocabulary:
    key, proof = (rows[c].to_numpy().view(np.uint64) for c in ("key", "proof"))
    order = np.lexsort((proof, key))
    key = key[order]
    runs = np.diff(np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))) if len(key) else np.ones(1, int)
    return Vocabulary(key, proof[order], rows["code"].to_numpy()[order].astype(np.int32), int(runs.max()))


def _runs_of_codes(codes: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """Codes of linked frequent words, in order; 0 between runs, words on their own are left out."""
    joins = linked & (codes > 0)
    joins[:-1] &= codes[1:] > 0
    joins[-1:] = False
    after = np.concatenate(([False], joins[:-1]))
    inside = joins | after
    ends = inside & ~joins
    out = np.zeros((2, len(codes)), np.int32)
    out[0] = codes
    used = np.stack((inside, ends))
    return out.T[used.T]


def _encode(shared, last: bool):
    """Adds the codes of one block of words to those found before; the last block's pass leaves runs of codes only."""

    def task(batches):
        for pieces, _, batch in _texts(batches):
            codes = shared.value.codes(pieces)
            if "codes" in batch.schema.names:
                codes += np.frombuffer(b"".join(batch["codes"].to_pylist()), np.int32)
            if last:
                runs = _runs_of_codes(codes, pieces.linked)
                if len(runs):
                    yield pa.RecordBatch.from_arrays([pa.array([runs.tobytes()], pa.binary())], ["codes"])
            else:
                parts = [codes[a:b].tobytes() for a, b in zip(pieces.first[:-1], pieces.first[1:])]
                yield pa.RecordBatch.from_arrays([batch["lang"], batch["text"], pa.array(parts, pa.binary())], ["lang", "text", "codes"])

    return task


def _blocks(table: DataFrame, size: int, key: str, columns: list[str]):
    """The table in parts of about ``size`` rows, collected one at a time."""
    n = -(-table.count() // size)
    for i in range(n):
        yield i == n - 1, table.filter(F.pmod(F.xxhash64(key), F.lit(n)) == i).select(*columns).toArrow()


def _coded(texts: DataFrame, words: DataFrame) -> DataFrame | None:
    """``codes``: the texts as runs of the numbers of frequent words; None without any."""
    table = None
    for last, rows in _blocks(words, WORDS, "code", ["key", "proof", "code"]):
        shared = texts.sparkSession.sparkContext.broadcast(_vocabulary(rows))
        table = texts if table is None else table
        table = stored(table.mapInArrow(_encode(shared, last), "codes binary" if last else "lang string, text string, codes binary"), "codes")
        shared.destroy()
    return table


@dataclass(frozen=True)
class Block:
    """A trie of phrases of ``width`` words, each word one step a digit of its place in ``words``; ``ids`` belong to
    accepting states."""

    width: int
    words: np.ndarray        # codes, ascending
    digits: np.ndarray       # a row for each of them; the first row is for all others and leads nowhere
    trie: DoubleArray
    ids: np.ndarray
    bits: np.ndarray         # of the windows that are candidates, in any block

    def step(self, state: np.ndarray, at: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States and positions that are alive after one more word (its place in ``words`` from 1 on, 0 for others)."""
        codes = self.digits[word]
        for k in range(codes.shape[1]):
            state = self.trie.step(state, codes[:, k])
            alive = state >= 0
            state, at, codes = state[alive], at[alive], codes[alive]
        return state, at


def _paths(rows: pa.Table) -> np.ndarray:
    return np.array(rows["path"].combine_chunks().flatten()).reshape(rows.num_rows, -1).astype(np.int64)


def _block(rows: pa.Table, bits: np.ndarray) -> Block:
    paths = _paths(rows)
    words, local = np.unique(paths, return_inverse=True)
    table = digits(np.arange(len(words)), len(words))
    trie, ends = build(table[local.reshape(paths.shape)].reshape(len(paths), -1), 256)
    ids = np.full(trie.states, -1, np.int32)
    ids[ends] = rows["pid"].to_numpy()
    return Block(paths.shape[1], words.astype(np.int32), np.concatenate((np.zeros_like(table[:1]), table)).astype(np.int16), trie, ids, bits)


def _places(windows: list[np.ndarray]) -> np.ndarray:
    """Places in the bit table of windows, given word by word."""
    out = np.zeros(len(windows[0]), np.uint64)
    for word in windows:
        out = mix64(out + word.astype(np.uint64))
    return (out >> np.uint64(64 - BITS)).astype(np.int64)


def _mark(bits: np.ndarray, rows: pa.Table) -> None:
    place = _places(list(_paths(rows).T))
    np.bitwise_or.at(bits, place >> 3, np.uint8(1) << (place & 7).astype(np.uint8))


class _Counts:
    """Counts by key, added up whenever twice as many are held as there were keys."""

    def __init__(self):
        self.keys, self.counts, self.size, self.limit = [], [], 0, HELD

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size > self.limit:
            self._shrink()
            self.limit = max(HELD, 2 * self.size)

    def _shrink(self) -> None:
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        new = np.flatnonzero(np.concatenate((np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1])))
        self.keys, self.counts, self.size = [keys[new]], [np.add.reduceat(counts, new) if len(new) else counts], len(new)

    @property
    def full(self) -> bool:
        return self.size > HELD // 2 and len(self.keys) == 1

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        """All keys, ascending, with their counts; nothing is held afterwards."""
        out = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.keys:
            self._shrink()
            out = self.keys[0], self.counts[0]
        self.__init__()
        return out


def _packed(counts: _Counts, parts: int):
    """A shard's counts as arrays, one row for each part that the keys are dealt to."""
    keys, m = counts.taken()
    part = (mix64(keys.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    rows = [(p, keys[order[a:b]].tobytes(), m[order[a:b]].tobytes()) for p, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if b > a]
    if rows:
        part, keys, m = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(keys, pa.binary()), pa.array(m, pa.binary())], ["part", "keys", "counts"])


def _summed_parts(least: int):
    """Sums of the shards' arrays, part by part; those that reach the limit as rows."""

    def task(batches):
        at, held = None, _Counts()

        def out():
            keys, m = held.taken()
            kept = m >= least
            return pa.RecordBatch.from_arrays([pa.array(keys[kept]), pa.array(m[kept])], ["key", "m"])

        for batch in batches:
            for part, keys, counts in zip(batch["part"].to_pylist(), batch["keys"], batch["counts"]):
                if part != at and at is not None:
                    yield out()
                at = part
                held.add(np.frombuffer(keys.as_buffer(), np.int64), np.frombuffer(counts.as_buffer(), np.int64))
        if at is not None:
            yield out()

    return task


def _code_arrays(batches):
    for batch in batches:
        for codes in batch["codes"]:
            yield np.frombuffer(codes.as_buffer(), np.int32)


def _walk(codes: np.ndarray, block: Block | None, extend: bool) -> tuple[np.ndarray, np.ndarray]:
    """Accepting states of all positions of a text, and the keys of their continuations; without a block, of single words."""
    nothing = np.zeros(0, np.int64)
    if block is None:
        keys = codes[:-1].astype(np.int64) * NEXT + codes[1:]
        return nothing, keys[(codes[:-1] > 0) & (codes[1:] > 0)]
    at = np.minimum(np.searchsorted(block.words, codes), len(block.words) - 1)
    local = np.where(block.words[at] == codes, at + 1, 0)  # 0: a break, or a word of no phrase of the block
    at = np.flatnonzero(local)
    at = at[at + block.width <= len(codes)]
    state = np.zeros(len(at), np.int64)
    for step in range(block.width):
        state, at = block.step(state, at, local[at + step])
    if not extend:
        return state, nothing
    going = at + block.width < len(codes)
    at, ended = at[going], state[going]
    following = codes[at + block.width]
    at, ended, following = (x[following > 0] for x in (at, ended, following))
    place = _places([codes[at + t] for t in range(1, block.width + 1)])
    known = (block.bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
    return state, block.ids[ended[known]].astype(np.int64) * NEXT + following[known]


def _bucket(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys.view(np.uint64)) >> np.uint64(64 - COUNTERS)).astype(np.int64)


def _bucket_counts(shared):
    """A shard's continuations counted by hash, up to 255 a counter, in pieces of the table that hold any."""

    def task(batches):
        table = np.zeros(1 << COUNTERS, np.uint8)
        for codes in _code_arrays(batches):
            which, m = np.unique(_bucket(_walk(codes, shared.value, True)[1]), return_counts=True)
            table[which] = np.minimum(table[which] + m, 255)
        for piece, part in enumerate(table.reshape(-1, PIECE)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["piece", "counts"])

    return task


def _heavy_bits(least: int):
    """Sums of the pieces of all shards, as bits for the counters that reach the limit (or 255, past which none counts)."""

    def task(batches):
        at, total = None, None

        def out():
            bits = np.packbits(total >= min(least, 255), bitorder="little")
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["piece", "bits"])

        for batch in batches:
            for piece, counts in zip(batch["piece"].to_pylist(), batch["counts"]):
                if piece != at:
                    if at is not None:
                        yield out()
                    at, total = piece, np.zeros(PIECE, np.int64)
                total = np.minimum(total + np.frombuffer(counts.as_buffer(), np.uint8), 1 << 40)
        if at is not None:
            yield out()

    return task


def _heavy(coded: DataFrame, shared, least: int) -> np.ndarray:
    """Bits of the counters that a continuation must hit to reach the limit: a table of fixed size, 1 MB."""
    pieces = coded.mapInArrow(_bucket_counts(shared), "piece int, counts binary")
    sums = dealt(pieces, "piece").mapInArrow(_heavy_bits(least), "piece int, bits binary")
    bits = np.zeros((1 << COUNTERS) // 8, np.uint8).reshape(-1, PIECE // 8)
    for piece, part in sums.collect():
        bits[piece] = np.frombuffer(part, np.uint8)
    return bits.ravel()


def _scan(shared, extend: bool, parts: int):
    """Counts of a block's phrases and of their continuations that may reach the limit."""

    def task(batches):
        block, heavy = shared.value
        accepted, counts = np.zeros(block.trie.states if block else 0, np.int64), _Counts()
        for codes in _code_arrays(batches):
            state, keys = _walk(codes, block, extend)
            accepted += np.bincount(state, minlength=len(accepted))
            if extend:
                place = _bucket(keys)
                keys, m = np.unique(keys[(heavy[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1], return_counts=True)
                counts.add(keys, m.astype(np.int64))
                if counts.full:
                    yield from _packed(counts, parts)
        if block:
            seen = np.flatnonzero(accepted)
            counts.add(block.ids[seen].astype(np.int64) * NEXT, accepted[seen])
        yield from _packed(counts, parts)

    return task


def _scanned(coded: DataFrame, block: Block | None, least: int, extend: bool) -> DataFrame:
    """Sums of at least ``least`` for a block, or for the pairs of single words."""
    context, heavy = coded.sparkSession.sparkContext, None
    if extend:
        shared = context.broadcast(block)
        heavy = _heavy(coded, shared, least)
        shared.destroy()
    shared = context.broadcast((block, heavy))
    parts = int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done = _summed(coded.mapInArrow(_scan(shared, extend, parts), "part int, keys binary, counts binary"), least)
    shared.destroy()
    return done


def _summed(counts: DataFrame, least: int) -> DataFrame:
    """``pid, next, m`` of at least ``least``; ``next`` is 0 for the phrase itself."""
    sums = dealt(counts, "part").mapInArrow(_summed_parts(least), "key long, m long")
    return stored(sums.select(F.shiftright("key", 32).alias("pid"), F.col("key").bitwiseAND(F.lit(NEXT - 1)).alias("next"), "m"), "sums")


def _counted(coded: DataFrame, candidates: DataFrame, least: int, extend: bool) -> DataFrame | None:
    """Counts of candidates ``(pid, path)`` and their continuations."""
    bits = np.zeros(1 << (BITS - 3), np.uint8)
    if extend:
        for _, rows in _blocks(candidates, BLOCK, "pid", ["path"]):
            if rows.num_rows:
                _mark(bits, rows)
    parts = None
    for _, rows in _blocks(candidates, BLOCK, "pid", ["pid", "path"]):  # one block at a time in the driver and in each worker
        if rows.num_rows:
            done = _scanned(coded, _block(rows, bits), least, extend)
            parts = done if parts is None else parts.unionByName(done)
    return parts


def frequent_phrases(documents: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, k, f`` of all phrases of up to ``longest`` words with ``least`` occurrences, and ``lang, n``."""
    texts = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words = stored(texts.mapInArrow(_count_words, "lang string, word string, key long, proof long, f long")
                   .groupBy("lang", "word", "key", "proof").agg(F.sum("f").alias("f")), "words")
    totals = stored(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    known = numbered(words.filter(F.col("f") >= least), "code")
    found = known.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("k"), "f")
    spelled = known.select(F.col("code").alias("next"), "lang", "word")
    candidates = spelled.select(F.col("next").alias("pid"), F.array("next").alias("path"), "lang", F.col("word").alias("phrase"))
    coded = _coded(texts, known) if longest > 1 else None
    for width in range(1, longest + 1):
        if coded is None:
            break
        if width == 1:
            sums = _scanned(coded, None, least, True)
        else:
            sums = _counted(coded, candidates, least, width < longest)
            if sums is None:
                break
            found = found.unionByName(sums.filter("next = 0").join(candidates, "pid")
                                      .select("lang", "phrase", F.lit(width).alias("k"), F.col("m").alias("f")))
        longer = (sums.filter("next > 0").join(candidates, "pid").join(spelled.drop("lang"), "next")
                  .select(F.concat("path", F.array("next")).alias("path"), "lang", F.concat_ws(" ", "phrase", "word").alias("phrase")))
        candidates = numbered(longer, "pid") if width < longest else None
    return stored(found, "phrases"), totals


def collocations(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of each language.

    The score of a phrase is that of its weakest cut into two parts, floor(1000 a n / (l r)); phrases inside a longer
    one that occurs as often are left out.
    """
    phrases, totals = frequent_phrases(documents, least, longest)
    longer = phrases.filter("k > 1").withColumnRenamed("f", "a")
    cuts = (longer.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
            .withColumn("head", F.expr("substring_index(phrase, ' ', cut)"))
            .withColumn("tail", F.expr("substring_index(phrase, ' ', cut - k)")))
    parts = phrases.select("lang", F.col("phrase"), "f")
    scored = (cuts.join(parts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
              .join(parts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
              .join(totals, "lang")
              .withColumn("score", F.expr("(1000BD * cast(a as decimal(19,0)) * cast(n as decimal(15,0))) div "
                                          "(cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")))
    weakest = scored.groupBy("lang", "phrase", "k", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("w"))
    inside = (longer.filter("k > 2").withColumn("words", F.split("phrase", " "))
              .withColumn("m", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
              .withColumn("first", F.explode(F.expr("sequence(1, k - m + 1)")))
              .select("lang", F.expr("array_join(slice(words, first, m), ' ')").alias("phrase"), "a")
              .groupBy("lang", "phrase").agg(F.max("a").alias("covered")))
    kept = weakest.join(inside, ["lang", "phrase"], "left").filter("covered is null or covered < a")
    order = Window.partitionBy("lang").orderBy(F.desc("w.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "w.l", "w.r", "n", "w.score")
