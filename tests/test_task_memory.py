"""What a task holds does not grow with the number of words or the length of a batch's texts."""

import pyarrow as pa

from lexloom import session
from lexloom.operators import tokenize


def test_known_words_are_bounded(monkeypatch):
    monkeypatch.setattr(tokenize, "KNOWN", 100)
    v = tokenize.Vocabulary([(0, "<unk>", 0.0, "special"), *((i + 1, c, -float(i), "learned") for i, c in enumerate("▁abc0123456789"))], "bpe")
    for i in range(500):
        assert v.pieces(f"a{i}") == ["▁", "a", *str(i)]
        assert sum(map(len, v.known)) <= 100 and v.pieces(f"a{i}") == ["▁", "a", *str(i)]
    assert v.pieces("b" * 300) == ["▁"] + ["b"] * 300


def test_slices():
    texts = ["a" * 10, None, "b" * 95, "", "c" * 300, "d", "é" * 50]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts, pa.string())], names=["id", "text"])
    parts = list(session.slices(iter([batch, batch.slice(0, 0)]), 1, 100))
    assert [t for p in parts for t in p.column(1).to_pylist()] == texts and [i for p in parts for i in p.column(0).to_pylist()] == list(range(7))
    assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column(1).to_pylist()) <= 100 for p in parts) and len(parts) > 3
