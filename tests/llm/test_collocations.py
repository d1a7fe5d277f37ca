import random
import re
from collections import Counter

import numpy as np
import pytest

from isohyet.llm import collocations as c
from isohyet.llm.trie import build

from .conftest import STRANGE

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, longest=5, top=2000):
    """All counts in one dictionary."""
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, longest + 1):
                counts.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    found = {key: f for key, f in counts.items() if f >= least}
    out = []
    for (lang, p), a in found.items():
        if len(p) == 1 or any(g == lang and f >= a and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))
                              for (g, q), f in found.items()):
            continue
        score, cut = min((1000 * a * totals[lang] // (found[lang, p[:k]] * found[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), found[lang, p[:cut]], found[lang, p[cut:]], totals[lang]))
    ranked, place = [], Counter()
    for lang, score, a, phrase, l, r, n in sorted(out):
        place[lang] += 1
        if place[lang] <= top:
            ranked.append((lang, place[lang], phrase.decode(), -a, l, r, n, -score))
    return ranked


def some(seed=2, n=120):
    rng = random.Random(seed)
    stock = ["New  York City", "of\tthe", "the state of the art", "a a a a a a", "été naïve ÉTÉ", "x-y 'z' (q)", "日本 語", "to be or not to be"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(stock) if rng.random() < 0.5 else rng.choice("abcdefgh") for _ in range(rng.randrange(0, 40))]
        rows.append((rng.choice(["en", "de", None]), "".join(p + rng.choice([" ", " ", " ", "\t", ". ", "\n", "!"]) for p in parts)))
    return rows


def ours(spark, rows, **options):
    frame = spark.createDataFrame([(i, *r, 1) for i, r in enumerate(rows)], "doc_id long, lang string, text string, phrase int").repartition(3)
    return sorted(tuple(r) for r in c.collocations(frame, **options).collect())


def test_equals_a_dictionary_of_all_phrases(spark):
    rows = some()
    assert brute(rows, 12) and ours(spark, rows, least=12) == brute(rows, 12)
    assert ours(spark, rows, least=12, top=3, longest=3) == brute(rows, 12, 3, 3)


def test_many_blocks_a_full_bit_table_and_small_buffers(spark, monkeypatch):
    monkeypatch.setattr(c, "BLOCK", 5)
    monkeypatch.setattr(c, "BITS", 4)
    monkeypatch.setattr(c, "WORDS", 7)
    monkeypatch.setattr(c, "COUNTERS", 16)
    monkeypatch.setattr(c, "HELD", 16)
    rows = some(5, 60)
    assert ours(spark, rows, least=20) == brute(rows, 20)


def test_one_hot_word_and_strange_rows(spark, strange, nothing):
    rows = [(None if k % 2 == 0 else "lang", t) for k, (_, t) in enumerate(STRANGE)]
    assert ours(spark, rows, least=2) == brute(rows, 2)
    assert sorted(tuple(r) for r in c.collocations(strange, least=2).collect()) == brute(rows, 2)
    assert c.collocations(nothing).collect() == [] and c.collocations(strange.filter("text is null")).collect() == []


def test_scores_past_64_bits(spark):
    # a n is beyond 2^63 only for huge tables; the expression itself is checked on such numbers
    a, n, l, r = 9 * 10**12, 10**14, 2 * 10**13, 3 * 10**13
    row = spark.sql(f"SELECT (1000BD * cast({a}L as decimal(19,0)) * cast({n}L as decimal(15,0))) div "
                    f"(cast({l}L as decimal(19,0)) * cast({r}L as decimal(19,0))) AS s").first()
    assert row["s"] == 1000 * a * n // (l * r)


@pytest.mark.parametrize("seed", range(4))
def test_double_array_holds_exactly_its_paths(seed):
    rng = np.random.default_rng(seed)
    paths = rng.zipf(1.4, size=(4000, 3)) % 300 + 1
    trie, ends = build(paths, 300)
    known = {tuple(p): e for p, e in zip(paths.tolist(), ends)}
    assert len(set(known.values())) == len(known)
    tried = np.concatenate((paths, rng.integers(0, 301, (4000, 3))))
    state = np.zeros(len(tried), np.int64)
    for step in range(3):
        live = state >= 0
        state[live] = trie.step(state[live], tried[live, step])
    assert [known.get(tuple(p), -1) for p in tried.tolist()] == state.tolist()
