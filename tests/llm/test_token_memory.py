"""Encoding works on parts of a batch, whatever the size of the batch."""

import tracemalloc

import pyarrow as pa

from isohyet.llm import sentencepiece
from isohyet.llm.common import pieces


def test_pieces_keep_all_rows_in_order():
    batches = [pa.RecordBatch.from_pydict({"x": list(range(a, b))}) for a, b in ((0, 5), (5, 5), (5, 12))]
    parts = [p["x"].to_pylist() for p in pieces(batches, 3)]
    assert sum(parts, []) == list(range(12)) and max(map(len, parts)) == 3


def test_memory_of_encoding_is_bounded():
    texts = [f"word{i % 50} and some more plain words " * 25 for i in range(5000)] + [None, "", "ä" * 10]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    run = sentencepiece._kernel(sentencepiece.read_model(), True)
    tracemalloc.start()
    rows = 0
    for out in run([batch]):
        assert out["decoded"].to_pylist() == [t or "" for t in texts[rows:rows + out.num_rows]]
        rows += out.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(texts)
    assert peak < 60e6, f"{peak / 1e6:.0f} MB for {batch.nbytes / 1e6:.0f} MB of text"
