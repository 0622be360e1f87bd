"""Token counts of a word-end BPE by rank-synchronous merging of ragged arrays.

Each batch's new pre-tokens lie one after the other in one array of symbols. In a round, every sequence finds its pair
of lowest rank and merges all its occurrences at once (from the left where they overlap); sequences without a known
pair leave. Since a merged symbol only takes part in pairs of higher rank, this gives the merges that one-by-one merging
gives. Sequences too long for rounds are merged one by one with a heap. Counts of pre-tokens are kept between batches,
in a table of bounded size.

Splitting follows the vocabulary file: special strings stand for one token, then composed form, white space as blanks,
lower case, and runs of letters, single digits or runs of other signs. Null and empty texts have no token.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from forecourt.llm.common import Shared, map_batches
from forecourt.llm.words import slices, text_bytes

LONG = 1_000
KEPT = 400_000
NONE = np.int32(2**31 - 1)

# Fixed value: the splitting pattern of the vocabulary file, with white space written as a property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"


@dataclass(frozen=True)
class Vocabulary:
    inner: np.ndarray  # symbol of a byte
    final: np.ndarray  # symbol of a word's last byte
    pairs: np.ndarray  # left * 2^32 + right, sorted
    ranks: np.ndarray
    merged: np.ndarray  # symbol by rank
    specials: tuple[str, ...]
    spec: str  # the vocabulary file


def _byte_signs() -> list[str]:
    """The printable sign that stands for each byte: itself where printable, else the next free code point from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


def load(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as file:
        source = file.read()
    spec = json.loads(source)
    ids, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
    signs = _byte_signs()
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    keys = np.array([(ids[a] << 32) | ids[b] for a, b in merges], np.int64)
    order = np.argsort(keys, kind="stable")
    return Vocabulary(
        np.array([ids[s] for s in signs], np.int32), np.array([ids[s + end] for s in signs], np.int32), keys[order],
        order.astype(np.int32), np.array([ids[a + b] for a, b in merges], np.int32), tuple(t["content"] for t in spec["added_tokens"]), source,
    )


def _ranks(v: Vocabulary, symbols: np.ndarray) -> np.ndarray:
    """Rank of each symbol with its right neighbour."""
    keys = (symbols[:-1].astype(np.int64) << 32) | symbols[1:]
    at = np.minimum(np.searchsorted(v.pairs, keys), len(v.pairs) - 1)
    return np.where(v.pairs[at] == keys, v.ranks[at], NONE)


def merge_together(v: Vocabulary, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Symbols left of each sequence; ``symbols`` holds the sequences one after the other, none empty."""
    left = lengths.copy()
    live = np.arange(len(lengths))
    while len(live):
        starts = np.cumsum(lengths) - lengths
        ranks = np.append(_ranks(v, symbols), NONE)
        ranks[starts + lengths - 1] = NONE
        best = np.minimum.reduceat(ranks, starts)
        going = best != NONE
        left[live[~going]] = lengths[~going]
        stay = np.repeat(going, lengths)
        symbols, ranks = symbols[stay], ranks[stay]
        live, lengths, best = live[going], lengths[going], best[going]
        if not len(live):
            break
        hit = ranks == np.repeat(best, lengths)
        at = np.flatnonzero(hit)
        run = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + 1]))
        place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
        at = at[place % 2 == 0]
        symbols[at] = v.merged[ranks[at]]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        owner = np.repeat(np.arange(len(live)), lengths)
        symbols, lengths = symbols[keep], np.bincount(owner[keep], minlength=len(live))
    return left


def merge_long(v: Vocabulary, symbols: np.ndarray) -> int:
    """Symbols left of one long sequence, merged one by one in order of rank and place."""
    n = len(symbols)
    value, after, before = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
    ranks = _ranks(v, symbols)
    heap = [(int(r), i, value[i], value[i + 1]) for i, r in enumerate(ranks) if r != NONE]
    heapq.heapify(heap)
    known = dict(zip(v.pairs.tolist(), v.ranks.tolist(), strict=True))
    left = n
    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = after[i] if value[i] == a else n
        if j >= n or value[j] != b:
            continue
        value[i], value[j] = int(v.merged[rank]), -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        left -= 1
        for p, q in ((before[i], i), (i, after[i])):
            if p >= 0 and q < n and (r := known.get((value[p] << 32) | value[q])) is not None:
                heapq.heappush(heap, (r, p, value[p], value[q]))
    return left


def count_words(v: Vocabulary, pieces: list[str]) -> list[int]:
    """Tokens of each pre-token."""
    data = [p.encode() for p in pieces]
    lengths = np.array([len(d) for d in data], np.int64)
    raw = np.frombuffer(b"".join(data), np.uint8)
    symbols = v.inner[raw]
    ends = np.cumsum(lengths)
    symbols[ends - 1] = v.final[raw[ends - 1]]
    long = lengths > LONG
    counts = np.zeros(len(pieces), np.int64)
    counts[~long] = merge_together(v, symbols[np.repeat(~long, lengths)], lengths[~long])
    for k in np.flatnonzero(long):
        counts[k] = merge_long(v, symbols[ends[k] - lengths[k] : ends[k]])
    return counts.tolist()


def _normal(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


@cache
def _library(spec: str) -> Tokenizer:
    return Tokenizer.from_str(spec)


@cache
def _unassigned() -> np.ndarray:
    """Which code points this Python knows nothing of; other tables may know them."""
    return np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)), bool, 0x110000)


def _has_unassigned(text: str) -> bool:
    return bool(_unassigned()[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any())


class Counter:
    """Counts texts' tokens; remembers pre-tokens, but no more than ``KEPT`` between batches."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.find = regex.compile(PATTERN).findall
        self.specials = regex.compile("|".join(map(regex.escape, sorted(vocabulary.specials, key=len, reverse=True))) or r"(?!)")
        self.kept: dict[str, int] = {}

    def split(self, text: str) -> list[str]:
        """Pre-tokens; of texts with code points unknown to this Python, as the library's own tables cut them."""
        if text.isascii() or not _has_unassigned(text):
            return self.find(_normal(text))
        library = _library(self.vocabulary.spec)
        text = library.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]

    def counts(self, texts: list[str]) -> list[int]:
        if len(self.kept) > KEPT:
            self.kept.clear()
        pieces, extra = [], []
        for text in texts:
            special = 0
            if "<|" in text or not all(s.startswith("<|") for s in self.vocabulary.specials):
                parts = self.specials.split(text)
                special = len(parts) - 1
                pieces.append([p for part in parts for p in self.split(part)])
            else:
                pieces.append(self.split(text))
            extra.append(special)
        new = list(set().union(*pieces).difference(self.kept))
        if new:
            self.kept.update(zip(new, count_words(self.vocabulary, new), strict=True))
        get = self.kept.__getitem__
        return [sum(map(get, p)) + s for p, s in zip(pieces, extra, strict=True)]


def _counter(vocabulary: Shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary.value())
        for batch in slices(batches, "text", 2 << 20):
            column = batch.column("text").fill_null("")
            _, offsets = text_bytes(column)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(counter.counts(column.to_pylist()), pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row; ``vocabulary`` is the path of the vocabulary file."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = map_batches(rows, _counter(Shared(docs.sparkSession, load(vocabulary))), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
