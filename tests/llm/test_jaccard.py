import random
import re

import numpy as np
import pytest

from isohyet.llm import jaccard
from isohyet.llm.words import shingle_sets

from .conftest import STRANGE, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def set_of(text, width=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + width]) for i in range(max(len(w) - width + 1, 1))) if w else frozenset()


def like(x, y, likeness=90):
    both = len(x & y)
    return both and 100 * both >= likeness * len(x | y)


def brute(rows, likeness=90):
    """All pairs of rows; rows with the same doc_id are one document."""
    sets = [(i, set_of(t)) for i, t in rows if i is not None]
    label = {i: i for i, _ in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[k + 1:]:
            if like(x, y, likeness):
                low, high = sorted((find(a), find(b)))
                label[high] = low
    named = {s: find(i) for i, s in sets if s}
    return sorted(((i, len(set_of(t)), find(i) if i is not None else named.get(set_of(t))) for i, t in rows), key=repr)


def ours(spark, rows, **options):
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string").repartition(5)
    return sorted(map(tuple, jaccard.join(frame, **options).collect()), key=repr)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = "n%d" % rng.randrange(10**6)
    return words


def chains(rng):
    """Groups in which edits pile up, copies, documents that share a long passage, and sizes near every limit."""
    rows = []
    for size in [3, 4, 9, 10, 11, 12, 13, 20, 40, 41, 80, 150, 400, 900]:
        words = prose(rng, size, 5000).split()
        for _ in range(rng.choice([3, 8, 14])):
            words = edited(rng, words, rng.randrange(0, max(2, size // 50)))
            cut = words[: len(words) - rng.randrange(0, max(1, size // 12))] if rng.random() < 0.4 else words
            rows.append(" ".join(cut))
    common = prose(rng, 60)
    rows += [common + " " + prose(rng, rng.choice([2, 6, 12]), 10**6) for _ in range(50)]
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("likeness", [90, 60])
def test_equals_all_pairs(spark, likeness):
    rows = chains(random.Random(likeness))
    assert ours(spark, rows, likeness=likeness) == brute(rows, likeness)


def test_large_clusters_are_cut_and_lose_no_link(spark, monkeypatch):
    # copies of one text with separate edits: all near the base, many far from each other, one outsider
    rng = random.Random(8)
    base = prose(rng, 300, 10**6).split()
    rows = [(k, " ".join(edited(rng, base, rng.choice([1, 4, 6])))) for k in range(70)]
    rows += [(100 + k, t) for k, (_, t) in enumerate(rows[:10])] + [(500, " ".join(edited(rng, base, 40)))]
    monkeypatch.setattr(jaccard, "MEMBERS", 6)
    monkeypatch.setattr(jaccard, "HELD", 50)
    expected = brute(rows)
    assert len({c for *_, c in expected}) > 3 and ours(spark, rows) == expected


def test_repeated_ids_null_ids_and_strange_rows(spark, nothing):
    rng = random.Random(3)
    a, b = prose(rng, 100, 10**6).split(), prose(rng, 50, 10**6).split()
    rows = [(7, " ".join(a)), (7, " ".join(b)), (7, ""), (3, " ".join(edited(rng, a, 1))), (5, " ".join(edited(rng, b, 0))), (None, " ".join(a)),
            (None, "of no document at all"), (9, " ".join(a)), (9, " ".join(a)), (8, " ".join(b + ["x"]))] + [(None if i is None else i + 100, t) for i, t in STRANGE]
    assert ours(spark, rows) == brute(rows)
    assert jaccard.join(nothing).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_search_finds_all_members_that_reach_the_overlap(seed):
    rng = random.Random(seed)
    universe = [rng.getrandbits(63) for _ in range(60)]
    sets = []
    for _ in range(40):
        near = set(rng.choice(sets)) if sets and rng.random() < 0.7 else set(rng.sample(universe, 30))
        near ^= set(rng.sample(universe, rng.randrange(0, 4)))
        sets.append(near)
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in arrays])))
    index = jaccard.Index(np.concatenate(arrays), offsets, 80)
    for q, s in enumerate(sets):
        expected = [j for j, t in enumerate(sets) if j > q and like(s, t, 80)]
        assert list(index.search(index.of[q], len(s), q + 1, lambda i: i)) == expected
        everywhere = [j for j, t in enumerate(sets) if like(s, t, 80)]
        assert list(index.search(index.lists(arrays[q]), len(s), 0, lambda i: i)) == everywhere


def test_linked_sets_share_a_segment():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.choice([9, 10, 12, 19, 30, 57, 100, 400, 1500])
        words = prose(rng, n + 2, 10**6).split()
        other = edited(rng, words, 1)[: len(words) - rng.randrange(0, 1 + n // 12)]
        x, y = set_of(" ".join(words)), set_of(" ".join(other))
        if like(x, y) and x != y:
            keys, owner = jaccard.segment_keys(*shingle_sets([" ".join(words), " ".join(other)], 3), 90)
            assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())


@pytest.mark.parametrize("limit", [1 << 21, 20])
def test_components_by_contraction(spark, monkeypatch, limit):
    from isohyet.llm import contraction

    rng = random.Random(limit)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(60)]
    monkeypatch.setattr(contraction, "EDGES", limit)
    monkeypatch.setattr(contraction, "HELD", 16)
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    frame = spark.createDataFrame(edges, "a long, b long").repartition(4)
    loops = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    found = {r["node"]: r["component"] for r in contraction.components(frame).collect()}
    assert found == {k: v for k, v in label.items() if k not in loops}
    assert contraction.components(frame.filter("a < 0")).collect() == []
