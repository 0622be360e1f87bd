"""Alignment against plain loops over both libraries."""

import hashlib
import re
from collections import Counter

import public_tokenizers
import pytest
from forecourt.llm import token_align
from forecourt.llm.token_align import alignment
from helpers import rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

JSON, MODEL = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
A = Tokenizer.from_file(JSON)
A.encode_special_tokens = True
B = SentencePieceProcessor(model_file=MODEL)
SIGNS = token_align.byte_signs()
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def spans(parts):
    at, out = 0, []
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def piece_bytes(i):
    piece = B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()


def one(text):
    """n_a, n_b, groups, links of a text, or None."""
    text = text or ""
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    x, y = [bytes(SIGNS[c] for c in A.id_to_token(i)) for i in a], [piece_bytes(i) for i in b]
    if not text or b"".join(x) != b"".join(y) or b"".join(x) != (" " + text).encode():
        return None
    x, y = spans(x), spans(y)
    links = [(i, j) for i, (s, e) in zip(a, x, strict=True) for j, (u, v) in zip(b, y, strict=True) if s < v and u < e]
    groups, low = [], 0
    for cut in sorted({e for _, e in x} & {e for _, e in y}):
        groups.append("|".join(",".join(str(i) for i, (_, e) in zip(ids, sp, strict=True) if low < e <= cut) for ids, sp in ((a, x), (b, y))))
        low = cut
    return len(a), len(b), groups, links


def expected(rows):
    cut = [one(t) for _, t in rows]
    held = Counter(pair for c in cut if c for pair in set(c[3]))
    top = {}
    for (a, _), n in held.items():
        top[a] = max(top.get(a, 0), n)
    return sorted(((d, c[0], c[1], len(c[2]), len(c[3]), sum(held[p] == top[p[0]] for p in c[3]), sum(held[p] for p in c[3]),
                    hashlib.sha256(";".join(c[2]).encode()).hexdigest()) if c else (d, 0, 0, 0, 0, 0, 0, "")
                   for (d, _), c in zip(rows, cut, strict=True)), key=str)


ODD = [(1, None), (2, ""), (3, " "), (4, "\n\n  \t"), (5, "▁"), (6, "a▁b"), (7, "<|endoftext|> <s></s><unk><0x41>"), (8, "Straße ΣΑΣ İ é 漢字 🙂"), (9, "\x00a\x00"),
       (None, "hello hello world"), (10, "hello hello world"), (10, "hello hello world"), (11, "hello there, other  worlds"), (12, "don't I'LL 12 345   x"), (13, "ab" * 3000),
       (14, "the cat " * 500), (15, "�́"), (16, "the other cat")]


@pytest.mark.parametrize("max_sent", [1 << 20, 40, 3, 0])
def test_odd_rows(spark, max_sent):
    """Few pairs sent: the others are joined, with the same numbers."""
    df = spark.createDataFrame([(*r, 7, "x") for r in ODD], "doc_id long, text string, pair int, row string").repartition(3)
    got = alignment(df, JSON, MODEL, max_sent)
    assert got.columns == COLUMNS
    assert rows_of(got) == expected(ODD)
    assert alignment(df.limit(0), JSON, MODEL, max_sent).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=4))
def test_any_text(texts):
    t = token_align.tokenizers(JSON, MODEL)
    x = token_align.align(t, texts)
    described, groups = token_align.group_texts(t, x, len(texts))
    for i, text in enumerate(texts):
        want = one(text)
        links = sorted((int(x.a[p]), int(x.b[q])) for p, q in zip(*x.links, strict=True) if x.a_row[p] == i)
        assert (described[i].decode(), groups[i], links) == ((";".join(want[2]), len(want[2]), sorted(want[3])) if want else ("", 0, []))


def test_parts_of_texts(monkeypatch):
    """Asking for distinct parts gives the library's ids, whatever counts as white space."""
    t = token_align.tokenizers(JSON, MODEL)
    odd = [chr(c) for c in (*range(0x21), 0x7F, 0x85, 0xA0, 0xAD, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF, 0x1F600)]
    texts = [a + x + b + y + c for x in odd for y in [" ", "\n", *odd[::7]] for a, b, c in (("a", "", "b"), ("", "'s", ""), ("1.", "é", "  x"))]
    want = [A.encode(" " + x, add_special_tokens=False).ids for x in texts]
    for size in (1, 3, 4000):
        monkeypatch.setattr(token_align, "ASKED", size)
        ids, counts = t.a_ids(texts)
        cuts = [0, *counts.cumsum().tolist()]
        t.place.clear()  # the next size asks anew
        t.ids, t.begins, t.ends = t.ids[:0], t.begins[:0], t.ends[:0]
        assert [ids[i:j].tolist() for i, j in zip(cuts, cuts[1:], strict=False)] == want


@pytest.mark.parametrize("kept", [0, 5, 300_000])
def test_parts_are_remembered(monkeypatch, kept):
    monkeypatch.setattr(token_align, "KEPT", kept)
    t = token_align.Tokenizers(JSON, MODEL)
    for texts in (["one two one", ""], ["two three  ", "one"], ["one two one", "four\u3000 five"], [], ["  ", "five six"]):
        ids, counts = t.a_ids(texts)
        cuts = [0, *counts.cumsum().tolist()]
        assert [ids[i:j].tolist() for i, j in zip(cuts, cuts[1:], strict=False)] == [A.encode(" " + x, add_special_tokens=False).ids for x in texts]
        assert len(t.place) <= kept + 8


def test_task_hands_counts_on(spark, monkeypatch):
    """Pairs of the same document never count twice, also when a task's table is full."""
    monkeypatch.setattr(token_align, "GATHERED", 3)
    rows = [(i, f"word{i % 5} and other words") for i in range(30)]
    assert rows_of(alignment(spark.createDataFrame(rows, "doc_id long, text string"), JSON, MODEL)) == expected(rows)


def test_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    short = df.where("length(text) < 3000")
    assert rows_of(alignment(short, JSON, MODEL)) == expected([(r["doc_id"], r["text"]) for r in short.collect()])
