"""Array words, lines and hashes against plain Python."""

import numpy as np
import pyarrow as pa
from forecourt.llm.words import hash_spans, line_table, row_of, slices, text_bytes, unique, word_spans, words
from helpers import FOLD, WHITE
from helpers import words as plain_words
from hypothesis import given, settings
from hypothesis import strategies as st

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ É\n\t\x0b\x0c\r ß漢\U0001f600x", max_size=30)), max_size=8)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_words(texts):
    column = pa.array(texts, pa.string())
    hashes, first = words(column)
    expected = [plain_words(t) for t in texts]
    assert np.diff(first).tolist() == [len(w) for w in expected]
    flat = [w for ws in expected for w in ws]
    seen = {}
    for w, h in zip(flat, hashes.tolist(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert row_of(first).tolist() == [i for i, ws in enumerate(expected) for _ in ws]


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_lines(texts):
    lines = line_table(pa.array(texts, pa.string()))
    expected = [(i, line.strip(WHITE).translate(FOLD)) for i, t in enumerate(texts) for line in (t or "").split("\n")]
    assert lines["row"].tolist() == [i for i, _ in expected]
    assert lines["points"].tolist() == [len(k) for _, k in expected]
    keys = {}
    for (_, k), a, b in zip(expected, lines["h1"].tolist(), lines["h2"].tolist(), strict=True):
        assert keys.setdefault(k, (a, b)) == (a, b)
    assert len(set(keys.values())) == len(keys)


def test_blocks_give_the_same_hashes(monkeypatch):
    import forecourt.llm.words as module

    text = " ".join(f"word{i}" * (1 + i % 7) for i in range(3000))
    data, offsets = text_bytes(pa.array([text, text]))
    starts, ends, _ = word_spans(data, offsets)
    whole = hash_spans(data, starts, ends)
    monkeypatch.setattr(module, "BLOCK_BYTES", 64)
    assert (hash_spans(data, starts, ends) == whole).all()
    assert (whole[: len(whole) // 2] == whole[len(whole) // 2 :]).all()


def test_slices_keep_rows_and_offsets():
    texts = ["a" * n for n in (5, 0, 100, 3, 3, 3)] + [None, "b"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]).slice(1)
    parts = list(slices(iter([batch]), "text", 10))
    assert [x for p in parts for x in p.column("text").to_pylist()] == texts[1:]
    assert max(sum(len(x or "") for x in p.column("text").to_pylist()) for p in parts if p.num_rows > 1) <= 10


def test_unique():
    values = np.array([3, 1, 3, 2, 1], np.uint64)
    assert unique(values).tolist() == [1, 2, 3] and not len(unique(values[:0]))
