"""The encoder's work: pieces are found by one step a character, words in use are segmented once."""

import random

from isohyet.llm import sentencepiece


def test_automaton_names_all_pieces_that_end_at_a_position():
    rng = random.Random(5)
    pieces = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(40)}
    root = sentencepiece._automaton(pieces)
    text = "".join(rng.choice("abcd") for _ in range(500))
    node = root
    for i, c in enumerate(text, 1):
        while node is not None and c not in node[0]:
            node = node[1]
        node = root if node is None else node[0][c]
        assert [p for _, p in node[2]] == sorted((p for p in pieces if text[:i].endswith(p)), key=len, reverse=True)


def test_words_in_use_are_segmented_once(monkeypatch):
    monkeypatch.setattr(sentencepiece, "REMEMBERED", 100)
    codec = sentencepiece.Codec(sentencepiece.read_model())
    learn, learned = codec.learn, []
    codec.learn = lambda words: (learned.extend(words), learn(words))
    first, _ = codec.encode(["some common words"])
    for i in range(20):
        ids, offsets = codec.encode(["some common words", " ".join(f"rare{i}x{j}" for j in range(40))])
        assert ids[:offsets[1]].tolist() == first.tolist()
    assert len(codec.words) + len(codec.older) <= 100 + 2 * 43
    assert learned.count("▁common") == 1
