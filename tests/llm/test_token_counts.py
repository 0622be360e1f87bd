"""Token counts against the vocabulary's own library."""

import random

import public_tokenizers
from forecourt.llm import token_counts as module
from forecourt.llm.token_counts import Counter, count_words, load, token_counts
from helpers import rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
VOCABULARY = load(PATH)


def expected(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert Counter(VOCABULARY).counts([text]) == [expected(text)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "don't", "I'LL", "aaaa", "12", " ", "\n", "Straße", "ΣΑΣ", "İ", "é", "!!!", "漢字", "\xa0", "\x1c", "<|", "\u0378", "\U0002fffe", "a\u0e7fb"]), max_size=12))
def test_pieces(parts):
    text = "".join(parts)
    assert Counter(VOCABULARY).counts([text]) == [expected(text)]


def test_runs_and_long_words(monkeypatch):
    rng = random.Random(3)
    texts = ["a" * n for n in (1, 2, 3, 7, 64, 999, 1001, 5000)] + ["".join(rng.choice("abcde") for _ in range(n)) for n in (50, 500, 1500, 4000)] + ["=" * 3000]
    want = [expected(t) for t in texts]
    assert Counter(VOCABULARY).counts(texts) == want
    monkeypatch.setattr(module, "LONG", 10**9)
    assert Counter(VOCABULARY).counts(texts) == want
    monkeypatch.setattr(module, "LONG", 0)
    assert count_words(VOCABULARY, ["hello", "a", "aaaaab"]) == [expected(t) for t in ("hello", "a", "aaaaab")]


def test_kept_counts_are_bounded(monkeypatch):
    monkeypatch.setattr(module, "KEPT", 10)
    counter = Counter(VOCABULARY)
    texts = [" ".join(f"word{chr(97 + i % 26)}{chr(97 + j)}" for j in range(20)) for i in range(30)]
    assert [counter.counts([t])[0] for t in texts] == [expected(t) for t in texts]
    assert len(counter.kept) <= 10 + 40


def test_table(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (None, "Hello"), (4, "x y z " * 70_000), (4, "x y z " * 70_000)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_tokens int")
    got = rows_of(token_counts(df, PATH))
    assert got == sorted(((d, len((t or "").encode()), expected(t), expected(t) > 2048) for d, t in rows), key=str)
    assert token_counts(df.limit(0), PATH).collect() == []


def test_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(df, PATH).collect()}
    assert got == {r["doc_id"]: expected(r["text"]) for r in df.collect()}
