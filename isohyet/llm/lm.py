"""A log-bilinear language model, trained by noise-contrastive estimation, and an add-one unigram base beside it.

Symbols.  The most frequent words are symbols of their own (``OWN``), all other words fall into ``CLASSES`` classes by
a hash of their last three bytes, and the end of a text is a symbol.  The log-bilinear part predicts the symbol from
the two before it: its vector is the sum of one vector for each place of the context, the score its product with the
symbol's vector plus a bias.  Given its class, a word has probability (c + 1) / (n + v + 1), where c is its count, n
all counts and v the distinct words of the class, so that all words, the unknown one included, share exactly 1.

Training.  All learning texts are used: counts of all words, and one pass of noise-contrastive estimation in
``ROUNDS`` parts; in each part every task trains on its own texts from the same start and the parameters (SYMBOLS rows)
are averaged by tokens.  A task with few texts goes over them again until it has made ``STEPS`` steps.

Scoring.  Normalisers of all contexts come from batched matrix products once (SYMBOLS squared numbers).  Counts of the
``NEAR`` most frequent words travel with the task; the counts of all others are joined by word hash.  Words are known
by 64-bit hashes: two words in 10**9 distinct ones share a hash with a chance of about 3 %, and would add their counts.

Defined cases: null and empty texts are just the end.  With nothing to learn from, every count is 0 and the model is
uniform over its symbols.  Repeated rows are learned from and scored as often as they occur; rows without doc_id have
the remainder of the empty key.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.llm.common import slices, stored
from isohyet.llm.words import Words

OWN, CLASSES = 319, 192
SYMBOLS = 1 + OWN + CLASSES   # the first is the end
WIDTH, NOISE, BATCH, RATE = 16, 32, 4096, 0.15
ROUNDS, STEPS = 3, 200
NEAR = 1 << 18
FLUSH = 1 << 22               # distinct words that a task holds before it hands its counts on


def _tails(words: Words) -> np.ndarray:
    return (words.hashes(np.maximum(words.start, words.end - 3), words.end) % np.uint64(CLASSES)).astype(np.int64)


def _count(batches):
    """Counts of the distinct words of one task; word 0 counts the texts (their ends)."""
    held, size = [], 0

    def merged():
        h, c, n = (np.concatenate(x) for x in zip(*held))
        distinct, first, place = np.unique(h, return_index=True, return_inverse=True)
        return distinct, c[first], np.bincount(place, weights=n).astype(np.int64)

    def batch_of(h, c, n):
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int32)), pa.array(n)], ["word", "tail", "n"])

    ends = 0
    for batch in batches:
        texts = batch["text"].to_pylist()
        ends += len(texts)
        for a, b in slices(texts):
            words = Words(texts[a:b])
            distinct, first, n = np.unique(words.hashes(), return_index=True, return_counts=True)
            held.append((distinct, _tails(words)[first], n))
            size += len(distinct)
        if len(held) > 16:
            held = [merged()]
            size = len(held[0][0])
        if size > FLUSH:
            yield batch_of(*merged())
            held, size = [], 0
    if held:
        yield batch_of(*merged())
    if ends:
        yield batch_of(np.zeros(1, np.uint64), np.full(1, -1), np.array([ends]))


class Counts:
    """What all tasks know: sizes, the frequent words, the classes."""

    def __init__(self, counts: DataFrame):
        ends = counts.filter("tail < 0").agg(F.sum("n")).first()[0] or 0
        words = counts.filter("tail >= 0")
        sums = words.agg(F.sum("n"), F.count("*")).first()
        self.tokens, self.distinct = (sums[0] or 0) + ends, sums[1] + (ends > 0)
        self.ends = ends
        # Classes of counts tell from which count on there are at most NEAR words; only these are fetched.
        level = F.floor(F.log("n") * 256)
        least, rows = None, 0
        for r in words.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # some thousand rows
            rows += r["count"]
            if rows > NEAR:
                break
            least = r["level"]
        near = words.filter(level >= least if least is not None else F.lit(False)).toPandas()
        near = near.sort_values(["n", "word"], ascending=[False, True])
        self.near, order = np.unique(near["word"].to_numpy(np.int64).view(np.uint64), return_index=True)
        n = near["n"].to_numpy(np.int64)
        self.near_n = n[order]
        own = np.arange(min(OWN, len(n)))
        self.near_symbol = np.where(order < OWN, 1 + order, -1)  # -1: by its tail
        self.class_n, self.class_v = np.zeros(CLASSES), np.zeros(CLASSES)
        for r in words.groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
            self.class_n[r["tail"]], self.class_v[r["tail"]] = r["n"], r["v"]
        tails = near["tail"].to_numpy(np.int64)[own]
        np.subtract.at(self.class_n, tails, n[own])
        np.subtract.at(self.class_v, tails, 1)
        totals = np.concatenate(([ends], n[own], np.zeros(OWN - len(own)), self.class_n))
        self.unigram = (totals + 0.5) / (totals + 0.5).sum()

    def symbols(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every word: its symbol, its tail, and its count if it is frequent (else -1)."""
        h, tails = words.hashes(), _tails(words)
        count, symbol = np.full(len(h), -1, np.int64), 1 + OWN + tails
        if len(self.near):
            place = np.minimum(np.searchsorted(self.near, h), len(self.near) - 1)
            known = self.near[place] == h
            count[known] = self.near_n[place[known]]
            own = known & (self.near_symbol[place] >= 0)
            symbol[own] = self.near_symbol[place[own]]
        return symbol, tails, count


def sequence(words: Words, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts with an end after each; the two symbols before each (the end stands before a text)."""
    n = words.n + 1
    last = np.cumsum(n)
    out = np.zeros(last[-1] if len(n) else 0, np.int64)
    inside = np.ones(len(out), bool)
    inside[last - 1] = False
    out[inside] = symbol
    place = np.arange(len(out)) - np.repeat(last - n, n)
    before = np.where(place > 0, np.roll(out, 1), 0)
    before2 = np.where(place > 1, np.roll(out, 2), 0)
    return out, before, before2


def start(unigram: np.ndarray) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(3)
    small = lambda: rng.normal(0, 0.1, (SYMBOLS, WIDTH))
    return {"target": small(), "one": small(), "two": small(), "bias": np.log(unigram)[:, None]}


def _scatter(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.stack([np.bincount(rows, weights=values[:, j], minlength=SYMBOLS) for j in range(values.shape[1])], 1)


def train(params: dict, unigram: np.ndarray, target: np.ndarray, one: np.ndarray, two: np.ndarray, seed: int) -> dict:
    """Noise-contrastive estimation with AdaGrad: each target is told from NOISE symbols drawn from the unigram."""
    params = {k: v.copy() for k, v in params.items()}
    power = {k: np.full_like(v, 1e-2) for k, v in params.items()}
    rng = np.random.default_rng(seed)
    log_noise = np.log(NOISE * unigram)
    batches = max(1, -(-len(target) // BATCH))
    for step in range(max(batches, STEPS)):
        if step % batches == 0:
            order = rng.permutation(len(target))
        i = order[(step % batches) * BATCH:(step % batches + 1) * BATCH]
        t, a, b = target[i], one[i], two[i]
        noise = rng.choice(SYMBOLS, NOISE, p=unigram)
        vector = params["one"][a] + params["two"][b]
        own = params["target"][t]
        s = (vector * own).sum(1) + params["bias"][t, 0] - log_noise[t]
        r = vector @ params["target"][noise].T + params["bias"][noise, 0] - log_noise[noise]
        up = 1 / (1 + np.exp(np.clip(s, -30, 30)))          # 1 - P(data)
        down = 1 / (1 + np.exp(-np.clip(r, -30, 30)))       # P(data) of the noise
        back = up[:, None] * own - down @ params["target"][noise]
        gradient = {"target": _scatter(t, up[:, None] * vector), "one": _scatter(a, back), "two": _scatter(b, back),
                    "bias": np.bincount(t, weights=up, minlength=SYMBOLS)[:, None]}
        np.add.at(gradient["target"], noise, -(down.T @ vector))
        np.add.at(gradient["bias"], noise, -down.sum(0)[:, None])
        for k, g in gradient.items():
            g /= len(i)
            power[k] += g * g
            params[k] += RATE * g / np.sqrt(power[k])
    return params


def _trainer(params: dict, counts: Counts, part: int):
    def run(batches):
        pieces = []
        for batch in batches:
            texts = batch["text"].to_pylist()
            for a, b in slices(texts):
                words = Words(texts[a:b])
                symbol, _, _ = counts.symbols(words)
                pieces.append([x.astype(np.int16) for x in sequence(words, symbol)])
        if not pieces:
            return
        target, one, two = (np.concatenate(x).astype(np.int64) for x in zip(*pieces))
        trained = train(params, counts.unigram, target, one, two, seed=part * 1000 + TaskContext.get().partitionId())
        flat = np.concatenate([trained[k] for k in ("target", "one", "two", "bias")], axis=1) * len(target)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(SYMBOLS)), pa.array(list(flat), pa.list_(pa.float64())), pa.array(np.full(SYMBOLS, len(target)))],
            ["symbol", "row", "weight"])

    return run


def _averaged(rows: DataFrame) -> dict[str, np.ndarray] | None:
    """Mean of the tasks' parameters by their tokens; the sums are made in Spark, SYMBOLS rows come back."""
    long = rows.select("symbol", "weight", F.posexplode("row").alias("j", "x"))
    sums = long.groupBy("symbol", "j").agg((F.sum("x") / F.sum("weight")).alias("x")).toPandas()
    if not len(sums):
        return None
    flat = np.zeros((SYMBOLS, 3 * WIDTH + 1))
    flat[sums["symbol"].to_numpy(), sums["j"].to_numpy()] = sums["x"].to_numpy()
    return {"target": flat[:, :WIDTH], "one": flat[:, WIDTH:2 * WIDTH], "two": flat[:, 2 * WIDTH:3 * WIDTH], "bias": flat[:, 3 * WIDTH:]}


class Model:
    """Parameters and the logarithm of the normaliser of every context."""

    def __init__(self, params: dict, counts: Counts):
        self.params, self.counts = params, counts
        self.normaliser = np.empty((SYMBOLS, SYMBOLS))
        for two in range(SYMBOLS):  # one batch for each second-last symbol
            scores = (params["one"] + params["two"][two]) @ params["target"].T + params["bias"][:, 0]
            most = scores.max(axis=1)
            self.normaliser[:, two] = most + np.log(np.exp(scores - most[:, None]).sum(axis=1))

    def log10(self, target: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        p = self.params
        score = ((p["one"][one] + p["two"][two]) * p["target"][target]).sum(1) + p["bias"][target, 0]
        return (score - self.normaliser[one, two]) / np.log(10)


def fit(documents: DataFrame) -> tuple[Model, DataFrame]:
    """The model and the stored counts of all words."""
    texts = documents.select(F.coalesce("text", F.lit("")).alias("text"))
    table = stored(texts.mapInArrow(_count, "word long, tail int, n long").groupBy("word", "tail").agg(F.sum("n").alias("n")), "counts")
    counts = Counts(table)
    params = start(counts.unigram)
    for part in range(ROUNDS):
        own = texts.filter(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == part)
        params = _averaged(own.mapInArrow(_trainer(params, counts, part), "symbol long, row array<double>, weight long")) or params
    return Model(params, counts), table


def _scorer(model: Model):
    def run(batches):
        counts, task, row = model.counts, TaskContext.get().partitionId(), 0
        all_log = np.log10(counts.tokens + counts.distinct + 1)
        class_log = np.log10(counts.class_n + counts.class_v + 1)
        for batch in batches:
            texts = batch["text"].to_pylist()
            for a, b in slices(texts):
                words = Words(texts[a:b])
                symbol, tails, count = counts.symbols(words)
                target, one, two = sequence(words, symbol)
                text = np.repeat(np.arange(b - a), words.n + 1)
                score = np.bincount(text, weights=model.log10(target, one, two), minlength=b - a)
                known = np.where(count >= 0, np.log10(np.maximum(count, 0) + 1), 0)
                by_class = symbol > OWN
                score += np.bincount(words.text, weights=np.where(by_class, known - class_log[tails], 0), minlength=b - a)
                base = np.bincount(words.text, weights=known, minlength=b - a) + np.log10(counts.ends + 1) - all_log * (words.n + 1)
                n_known = np.bincount(words.text, weights=count > 0, minlength=b - a).astype(np.int64) + (counts.ends > 0)
                rare = np.flatnonzero(count < 0)
                h = words.hashes()[rare].view(np.int64)
                limits = np.searchsorted(words.text[rare], np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(a, b - a), pa.array((task << 40) + row + np.arange(b - a)), pa.array(words.n + 1),
                     pa.array(n_known), pa.array(base), pa.array(score), pa.ListArray.from_arrays(pa.array(limits, pa.int32()), pa.array(h))],
                    ["doc_id", "row", "n_tokens", "n_known", "base_score", "score", "rare"])
                row += b - a

    return run


def score(documents: DataFrame, model: Model, table: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every text."""
    rows = stored(documents.select("doc_id", "text").mapInArrow(
        _scorer(model), "doc_id long, row long, n_tokens long, n_known long, base_score double, score double, rare array<long>"), "scored")
    # A rare word adds log10(c + 1) to either score; what divides it is in both scores already.
    rare = rows.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count("*").alias("m"))
    sums = (rare.join(table.filter("tail >= 0").select("word", "n"), "word")
            .groupBy("row").agg(F.sum(F.col("m") * F.log10(F.col("n") + 1)).alias("more"), F.sum("m").alias("known")))
    more = F.coalesce("more", F.lit(0.0))
    return rows.join(sums, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(int(model.counts.tokens)).cast("long").alias("train_tokens"),
        (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score"))


def learn_and_score(documents: DataFrame, learn: Column) -> DataFrame:
    model, table = fit(documents.filter(learn))
    return score(documents, model, table)
