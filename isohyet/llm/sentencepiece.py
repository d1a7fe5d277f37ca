"""SentencePiece encoding and decoding with a forward pass shared by common prefixes.

A text is marked (a mark for each space and one in front) and cut into marked words, which no piece crosses.  The
distinct words of a batch are sorted, which is a depth-first walk of their trie: the forward states of the prefix that
a word shares with the one before it are kept, only the rest is computed.  An Aho-Corasick automaton of the pieces,
kept in the states too, names the pieces that end at a position, the longest first.

For a unigram model the forward state of a position is the best sum of piece scores up to it (Viterbi).  For a BPE
model the score of a path is 0 if every two neighbouring pieces stay apart when the merges run on just these two, and
minus infinity otherwise.  One path has the score 0, and it is what the merges make of the whole word: up to the first
merge over a border, each piece goes through its own merges in the order it has alone, so a merge over the border of
two neighbours happens in the word exactly if it happens in the pair.  Whether two pieces stay apart follows from
replaying their merges side by side, and is remembered.

The model file is read once, where the job is planned, from a path that is a parameter; the piece table travels to the
tasks.  Supported are models without normalisation rules, with a mark in front, without removal of white space.

Defined cases: null and empty texts have no ids and decode to the empty text.  Characters without a piece become bytes
(or the unknown piece if the model has no bytes).  A text that itself holds the mark U+2581 decodes with a space there.
Repeated rows and other columns make no difference.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.llm.common import pieces, slices
from isohyet.llm.words import hashed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
REMEMBERED = 300_000  # words, and pairs of pieces, that a task keeps
CHARACTERS = 500_000  # that are encoded at a time: the index arrays take some 60 bytes a character


def read_model(path: str = MODEL) -> dict:
    """The piece table of a model file: kind, pieces with scores, bytes and the unknown piece."""
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    rules = model.normalizer_spec
    if rules.precompiled_charsmap or not rules.add_dummy_prefix or rules.remove_extra_whitespaces:
        raise ValueError(f"{path}: only models without normalisation and with a mark in front are supported")
    if model.trainer_spec.model_type not in (1, 2):
        raise ValueError(f"{path}: only unigram and BPE models are supported")
    pieces = SentencePieceProcessor(model_proto=model.SerializeToString())
    out = {"kind": "unigram" if model.trainer_spec.model_type == 1 else "bpe", "pieces": {}, "scores": {}, "bytes": {}, "unknown": pieces.unk_id()}
    for i in range(pieces.get_piece_size()):
        if pieces.is_byte(i):
            out["bytes"][int(pieces.id_to_piece(i)[3:-1], 16)] = i
        elif not (pieces.is_control(i) or pieces.is_unknown(i) or pieces.is_unused(i)):
            out["pieces"][pieces.id_to_piece(i)] = i
            out["scores"][pieces.id_to_piece(i)] = pieces.get_score(i)
    return out


def _automaton(pieces) -> list:
    """Root of the Aho-Corasick automaton: children by character, the node of the longest proper suffix (none for the
    root), and size and spelling of all pieces that end here, the longest first."""
    root: list = [{}, None, ()]
    for piece in pieces:
        node = root
        for c in piece:
            node = node[0].setdefault(c, [{}, root, ()])
        node[2] = ((len(piece), piece),)
    level = list(root[0].values())
    while level:
        below = []
        for node in level:
            for c, child in node[0].items():
                suffix = node[1]
                while suffix is not None and c not in suffix[0]:
                    suffix = suffix[1]
                child[1] = root if suffix is None else suffix[0][c]
                child[2] += child[1][2]
                below.append(child)
        level = below
    return root


class Codec:
    def __init__(self, model: dict):
        self.ids, self.scores, self.bytes, self.unknown = model["pieces"], model["scores"], model["bytes"], model["unknown"]
        self.bpe = model["kind"] == "bpe"
        self.root = _automaton(self.ids)
        self.whole = any(MARK in p.lstrip(MARK) for p in self.ids)  # pieces cross words: texts are not cut
        self.lowest = min(self.scores.values(), default=0) - 10
        self.apart: dict = {}   # piece -> piece after it -> whether they stay apart
        self.opening: dict = {}  # piece at the start of a word -> whether merges make it
        self.pairs = 0
        self.merges: dict = {}
        self.words: dict = {}   # marked word, as bytes -> its ids, as bytes of an int32 array
        self.older: dict = {}   # those of before the last turnover
        # What each id stands for, as bytes in one array.
        spelled = {i: p.replace(MARK, " ").encode("utf-8") for p, i in self.ids.items()}
        spelled |= {i: bytes([b]) for b, i in self.bytes.items()}
        spelled[self.unknown] = " ⁇ ".encode("utf-8")
        table = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
        self.spelling = np.frombuffer(b"".join(table), np.uint8)
        self.spelling_ends = np.cumsum([len(x) for x in table])
        self.spelling_sizes = np.array([len(x) for x in table])

    def _merges(self, piece: str) -> list | None:
        """The merges that make a piece from its characters, in order: score, place, first and last symbol after it."""
        if piece not in self.merges:
            symbols, steps = list(piece), []
            while len(symbols) > 1:
                best, at, place = None, -1, 0
                for i in range(len(symbols) - 1):
                    s = self.scores.get(symbols[i] + symbols[i + 1])
                    if s is not None and (best is None or s > best):
                        best, at = s, i
                if best is None:
                    break
                place = sum(map(len, symbols[:at]))
                symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
                steps.append((best, place, symbols[0], symbols[-1]))
            self.merges[piece] = steps if len(symbols) == 1 else None
        return self.merges[piece]

    def _stay_apart(self, a: str, b: str) -> bool:
        """Whether the merges on a + b end in these two pieces."""
        left, right = self._merges(a), self._merges(b)
        if left is None or right is None:
            return False
        x, y, i, j = a[-1], b[0], 0, 0
        while True:
            border = self.scores.get(x + y)
            mine = left[i] if i < len(left) else None
            other = right[j] if j < len(right) else None
            # The highest score goes first, the leftmost place among equals: left piece, border, right piece.
            if mine and (not other or mine[0] >= other[0]) and (border is None or mine[0] >= border):
                x, i = mine[3], i + 1
            elif border is not None and (not mine or border > mine[0]) and (not other or border >= other[0]):
                return False
            elif other:
                y, j = other[2], j + 1
            else:
                return True

    def _node(self, node: list, c: str) -> list:
        """The automaton's node after one more character."""
        while c not in node[0]:
            node = node[1]
            if node is None:
                return self.root
        return node[0][c]

    def _best(self, word: str, states: list, done: int) -> None:
        """Appends the Viterbi states after ``done`` characters: start and piece of the best last piece, the score, the node;
        the longer piece among equals.  A character without a piece stands for itself."""
        node = states[done][3]
        for position in range(done + 1, len(word) + 1):
            c = word[position - 1]
            node = self._node(node, c)
            ending = node[2] if node[2] and node[2][-1][0] == 1 else (*node[2], (1, c))
            best = None
            for size, piece in ending:
                score = states[position - size][2] + self.scores.get(piece, self.lowest)
                if best is None or score > best[2]:
                    best = position - size, piece, score, node
            states.append(best)

    def _only(self, word: str, states: list, done: int) -> None:
        """Appends the states after ``done`` characters of the path that merges allow: start, piece, what is known of pieces
        after it, the node.  A character without a piece stands for itself."""
        node, root = states[done][3], self.root
        for position in range(done + 1, len(word) + 1):
            c = word[position - 1]
            following = node[0].get(c)
            while following is None:  # as in _node, without a call for each character
                node = node[1]
                following = root if node is None else node[0].get(c)
            node = following
            for size, piece in node[2]:
                apart = states[position - size][2].get(piece)
                if apart is None:
                    apart = self._allowed(states[position - size], piece)
                if apart:
                    break
            else:
                size, piece = 1, c
                if (node[2] and node[2][-1][0] == 1) or not self._allowed(states[position - 1], c):
                    raise AssertionError(f"no segmentation of {word[:position]!r}")
            follow = self.apart.get(piece)
            if follow is None:
                follow = self.apart[piece] = {}
            states.append((position - size, piece, follow, node))

    def _allowed(self, state: tuple, piece: str) -> bool:
        """Whether a piece may follow the last piece of a state (none at the start), remembered in the state."""
        _, last, after, _ = state
        if piece not in after:
            if last:
                self.pairs += 1
            after[piece] = self._stay_apart(last, piece) if last else self._merges(piece) is not None
        return after[piece]

    def _spelled(self, piece: str) -> list[int]:
        if piece in self.ids:
            return [self.ids[piece]]
        if self.bytes:
            return [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]
        return [self.unknown]

    def learn(self, words: dict) -> None:
        """Segments words (spelled with marks -> as bytes) that are not remembered yet, in sorted order."""
        if self.pairs > REMEMBERED:
            self.apart, self.pairs = {}, 0
        states, previous = [(0, "", self.opening if self.bpe else 0.0, self.root)], ""
        extend, numbers = self._only if self.bpe else self._best, self.ids
        for word in sorted(words):
            shared, most = 0, min(len(previous), len(word))
            while shared < most and previous[shared] == word[shared]:
                shared += 1
            del states[shared + 1:]
            extend(word, states, shared)
            path, at = [], len(word)
            while at:
                at, piece, _, _ = states[at]
                path.append(piece)
            ids = array("i")
            for piece in reversed(path):
                number = numbers.get(piece)
                if number is None:
                    ids.extend(self._spelled(piece))
                else:
                    ids.append(number)
            self.words[words[word]] = ids.tobytes()
            previous = word

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the offsets of each text in them."""
        data = [(" " + t.replace(MARK, " ")).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        joined = b"".join(data)
        raw = np.frombuffer(joined, np.uint8)
        limits = np.concatenate(([0], np.cumsum([len(d) for d in data]))).astype(np.int64)
        # A marked word goes from the first of a run of spaces to the next one.
        space = raw == 32
        begins = space & ~np.concatenate(([False], space[:-1])) if not self.whole else np.zeros(len(raw), bool)
        begins[limits[:-1][np.diff(limits) > 0]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(raw))
        _, first, which = np.unique(hashed(raw, starts, ends), return_index=True, return_inverse=True)
        distinct = [joined[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist())]
        if len(self.words) > REMEMBERED // 2:  # the words in use stay, moved over as they come again
            self.older, self.words = self.words, {}
        missing = [w for w in distinct if w not in self.words]
        self.words.update((w, self.older[w]) for w in missing if w in self.older)
        self.learn({w.decode("utf-8", "surrogatepass").replace(" ", MARK): w for w in missing if w not in self.older})
        known = [self.words[w] for w in distinct]
        sizes = np.array([len(k) for k in known], np.int64) // 4
        flat = np.frombuffer(b"".join(known), np.int32)
        n = sizes[which]
        place = np.cumsum(n)
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[which] - (place - n), n) + np.arange(n.sum())]
        total = np.concatenate(([0], place))
        return ids, total[np.searchsorted(starts, limits)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of ids; the mark in front is dropped."""
        n = self.spelling_sizes[ids]
        place = np.cumsum(n)
        data = self.spelling[np.repeat((self.spelling_ends - self.spelling_sizes)[ids] - (place - n), n) + np.arange(n.sum())].tobytes()
        limits = np.concatenate(([0], place))[offsets].tolist()
        return [data[a + (data[a:a + 1] == b" "):b].decode("utf-8", "replace") if b > a else "" for a, b in zip(limits[:-1], limits[1:])]


def _kernel(model: dict, check: bool):
    def run(batches):
        codec = Codec(model)
        for batch in pieces(batches):
            texts = batch["text"].to_pylist()
            for a, b in slices(texts, CHARACTERS):
                ids, offsets = codec.encode(texts[a:b])
                part = batch.slice(a, b - a)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
                columns, names = [*part.columns, lists], [*part.schema.names, "ids"]
                if check:
                    columns.append(pa.array(codec.decode(ids, offsets), pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode(documents: DataFrame, path: str = MODEL, decoded: bool = False) -> DataFrame:
    """``documents`` with ``ids``, and on request with ``decoded``, the text made from them again; columns of these names are replaced."""
    documents = documents.drop("ids", "decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    return documents.mapInArrow(_kernel(read_model(path), decoded), f"{schema}, ids array<int>" + ", decoded string" * decoded)


def decode(tokens: DataFrame, path: str = MODEL) -> DataFrame:
    """``tokens`` with ``text`` made from ``ids``; a column of this name is replaced."""
    tokens = tokens.drop("text")
    model = read_model(path)

    def run(batches):
        codec = Codec(model)
        for batch in batches:
            lists = [i or [] for i in batch["ids"].to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(i) for i in lists]))).astype(np.int64)
            texts = codec.decode(np.array([x for i in lists for x in i], np.int64), offsets)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema)
    return tokens.mapInArrow(run, f"{schema}, text string")


def encoded_and_checked(documents: DataFrame, path: str = MODEL) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256, round_trip`` of every text."""
    rows = encode(documents.select("doc_id", "text"), path, decoded=True)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"),
                       (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))
