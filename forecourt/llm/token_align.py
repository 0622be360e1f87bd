"""Alignment of two tokenizers' tokens over the same bytes.

Every text is cut by a byte-level BPE (A, asked for space+text) and by a piece model (B, which adds that space itself).
Within a batch, keyed by document, ``pandas.merge_asof`` finds for each token start the token of the other side that
covers it; both directions together give every overlapping pair (a *link*) once. Offsets where both sides end cut the
tokens into *groups*.

Two passes over the corpus. The first writes one row a document to the shared folder: its counts, the digest of its
groups, and its distinct linked id pairs with their number of occurrences. The second adds up how many documents hold each
pair and looks the documents' pairs up in that table. Of the table, the pairs held by most documents are broadcast, as
many as ``max_sent`` allows (at least down to a power of two of documents); all others are held by fewer documents than
that and are joined, so no joined key is hot. Both ways give the same numbers.

Null and empty texts, and texts whose joined tokens are not the bytes of space+text (a model may replace signs), have no
tokens: zeros and an empty digest. Every row is a document of its own, also with a repeated or null ``doc_id``. Ties for
an A id's highest count all count as best. A text is never cut, however long; its memory grows with it. An empty table gives no rows.
Columns besides ``doc_id`` and ``text`` play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forecourt.llm.common import Shared, arrow_schema, map_batches, shared_folder
from forecourt.llm.words import row_of, slices, text_bytes

MAX_SENT = 4 << 20  # pairs, at 12 bytes, that each worker holds
GATHERED = 1 << 21  # pairs that a task holds before it hands their counts on
SLICE = 2 << 20
KEPT, KEPT_CHARS = 300_000, 8 << 20  # parts of texts whose ids a process remembers, besides those of one batch
ASKED = 4_000  # parts that make one text for the library
PARTS = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+").findall
OTHER_WHITE = re.compile(r"[^\S \t-\r]").search

ALIGNED = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "pairs binary, occurrences binary")


def byte_signs() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return {chr(b) if b in own else chr(next(free)): b for b in range(256)}


@dataclass(frozen=True)
class Entries:
    """The bytes of a vocabulary's entries, and how many each has."""

    data: list[bytes]
    lengths: np.ndarray

    @classmethod
    def of(cls, entries: list[bytes]) -> Entries:
        return cls(entries, np.array([len(e) for e in entries], np.int64))

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.data.__getitem__, ids))


def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The digits of every number under ``n``, set right, and which of them are leading zeros."""
    width = len(str(n))
    digits = np.arange(n)[:, None] // 10 ** np.arange(width - 1, -1, -1)
    shown = digits > 0
    shown[:, -1] = True
    return (digits % 10 + ord("0")).astype(np.uint8), shown


class Tokenizers:
    """Both tokenizers as one process uses them."""

    def __init__(self, json_path: str, model_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(json_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=model_path)
        with open(json_path, encoding="utf-8") as file:
            spec = json.load(file)
        ids = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        signs = byte_signs()
        added = {t["content"] for t in spec["added_tokens"]}
        entries = [b""] * (max(ids.values()) + 1)
        for entry, i in ids.items():
            entries[i] = entry.encode() if entry in added else bytes(signs[c] for c in entry)
        self.a_entries = Entries.of(entries)
        self.b_entries = Entries.of([
            bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in enumerate(self.b.id_to_piece(list(range(self.b.get_piece_size()))))
        ])
        self.sizes = (len(self.a_entries.lengths), len(self.b_entries.lengths))
        self.digits, self.shown = _decimals(max(self.sizes))
        self.width = self.shown.sum(axis=1)
        # Parts of texts seen so far: their number, and where their ids lie.
        self.held, self.place = 0, dict[str, int]()
        self.ids, self.begins, self.ends = np.zeros((3, 0), np.int64)

    def a_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of space+text of all texts, and how many each has.

        No pre-token reaches from a sign to the white space behind it, so texts fall into parts that begin there, and
        the new parts of a batch, one after the other, are one text to the library. Parts that end in white space, or hold
        other white space than ASCII's, are asked for alone. Parts are remembered until they are ``KEPT`` or hold
        ``KEPT_CHARS``."""
        parts = [[" " + t] if OTHER_WHITE(t) else PARTS(" " + t) for t in texts]
        if len(self.place) > KEPT or self.held > KEPT_CHARS:
            self.held, self.place = 0, {}
            self.ids, self.begins, self.ends = np.zeros((3, 0), np.int64)
        apart = {p[-1] for p in parts if len(p) == 1 or p[-1][-1].isspace()}
        new = set(chain.from_iterable(parts)).difference(self.place)
        joint, single = list(new - apart), list(new & apart)
        asked = ["".join(joint[i : i + ASKED]) for i in range(0, len(joint), ASKED)] + single
        answers = [e.ids for e in self.a.encode_batch_fast(asked, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(answers), np.int64, sum(map(len, answers)))
        ordered = joint + single
        self.held += sum(map(len, ordered))
        ends = np.searchsorted(np.cumsum(self.a_entries.lengths[ids]), np.cumsum([len(p.encode()) for p in ordered])) + 1
        self.place.update(zip(ordered, range(len(self.place), len(self.place) + len(ordered)), strict=True))
        self.begins = np.concatenate([self.begins, len(self.ids) + np.append(0, ends)[: len(ends)]])
        self.ends = np.concatenate([self.ends, len(self.ids) + ends])
        self.ids = np.concatenate([self.ids, ids])
        which = np.fromiter(map(self.place.__getitem__, chain.from_iterable(parts)), np.int64, sum(map(len, parts)))
        begins = self.begins[which]
        size = self.ends[which] - begins
        of_parts = np.append(0, np.cumsum(size))
        flat = self.ids[np.arange(of_parts[-1]) + np.repeat(begins - of_parts[:-1], size)]
        return flat, np.diff(of_parts[np.cumsum([0, *map(len, parts)])])

    def b_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = self.b.encode(texts, num_threads=1)
        lengths = np.array([len(x) for x in lists], np.int64)
        return np.fromiter(chain.from_iterable(lists), np.int64, int(lengths.sum())), lengths


@cache
def tokenizers(json_path: str, model_path: str) -> Tokenizers:
    return Tokenizers(json_path, model_path)


def _bare(entries: Entries, ids: np.ndarray, counts: np.ndarray, texts: list[str]) -> np.ndarray:
    """Which texts' joined entries are not the bytes of space+text."""
    cuts = np.append(0, np.cumsum(counts)).tolist()
    values = ids.tolist()
    return np.array([entries.joined(values[i:j]) != f" {t}".encode() for i, j, t in zip(cuts, cuts[1:], texts, strict=False)], bool)


@dataclass
class Alignment:
    """Tokens, groups and links of the rows of one batch; rows without tokens have none."""

    a: np.ndarray
    b: np.ndarray
    a_row: np.ndarray
    b_row: np.ndarray
    a_last: np.ndarray  # whether the other side ends where the token ends
    b_last: np.ndarray
    links: tuple[np.ndarray, np.ndarray]  # places in a and in b


def align(t: Tokenizers, texts: list[str]) -> Alignment:
    (a, n_a), (b, n_b) = t.a_ids(texts), t.b_ids(texts)
    none = np.array([not text for text in texts], bool) | _bare(t.a_entries, a, n_a, texts) | _bare(t.b_entries, b, n_b, texts)
    a_row, b_row = (np.repeat(np.arange(len(texts)), n) for n in (n_a, n_b))
    if none.any():
        (a, a_row), (b, b_row) = ((ids[~none[row]], row[~none[row]]) for ids, row in ((a, a_row), (b, b_row)))
    a_end, b_end = np.cumsum(t.a_entries.lengths[a]), np.cumsum(t.b_entries.lengths[b])
    marks = np.zeros((2, int(a_end[-1]) + 1 if len(a) else 1), bool)
    marks[0, a_end] = marks[1, b_end] = True
    a_start, b_start = a_end - t.a_entries.lengths[a], b_end - t.b_entries.lengths[b]
    if not len(a):
        return Alignment(a, b, a_row, b_row, marks[1, a_end], marks[0, b_end], (a, b))
    a_side = pd.DataFrame({"doc": a_row, "start": a_start, "a": np.arange(len(a))})
    b_side = pd.DataFrame({"doc": b_row, "start": b_start, "b": np.arange(len(b))})
    covering_b = pd.merge_asof(a_side, b_side, on="start", by="doc")["b"].to_numpy()
    covering_a = pd.merge_asof(b_side, a_side, on="start", by="doc")["a"].to_numpy()
    more = np.flatnonzero(a_start[covering_a] != b_start)  # equal starts were found from the other side
    links = np.concatenate([np.arange(len(a)), covering_a[more]]), np.concatenate([covering_b, more])
    return Alignment(a, b, a_row, b_row, marks[1, a_end], marks[0, b_end], links)


def group_texts(t: Tokenizers, x: Alignment, rows: int) -> tuple[list[bytes], np.ndarray]:
    """``a1,a2|b1;a3|b2,b3`` of every row, and its number of groups."""
    groups = np.bincount(x.a_row[x.a_last], minlength=rows)
    if not len(x.a):
        return [b""] * rows, groups
    # A token stands behind all tokens of earlier groups, and B's behind those of A in its own.
    a_cuts, b_cuts = np.flatnonzero(x.a_last) + 1, np.flatnonzero(x.b_last) + 1
    a_at = np.arange(len(x.a)) + np.append(0, b_cuts)[np.cumsum(x.a_last) - x.a_last]
    b_at = np.arange(len(x.b)) + a_cuts[np.cumsum(x.b_last) - x.b_last]
    n, width = len(x.a) + len(x.b), t.digits.shape[1]
    cells, shown, size = np.empty((n, width + 1), np.uint8), np.ones((n, width + 1), bool), np.empty(n, np.int64)
    final = np.flatnonzero(np.append(x.b_row[1:] != x.b_row[:-1], True))
    for ids, at, last, sign in ((x.a, a_at, x.a_last, b"|"), (x.b, b_at, x.b_last, b";")):
        cells[at, :width], shown[at, :width], size[at] = t.digits[ids], t.shown[ids], t.width[ids] + 1
        cells[at, width] = np.where(last, sign[0], ord(","))
    shown[b_at[final], width] = False
    size[b_at[final]] -= 1
    text = cells[shown].tobytes()
    ends = np.zeros(rows, np.int64)
    ends[x.b_row[final]] = np.cumsum(size)[b_at[final]]
    ends = np.maximum.accumulate(ends)
    return [text[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)], groups


def _pair_type(sizes: tuple[int, int]) -> type:
    return np.uint32 if sizes[0] * sizes[1] <= 1 << 32 else np.uint64


def _blobs(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """One binary value a row."""
    data = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.large_binary(), len(first) - 1,
                                 [None, pa.py_buffer((first * data.itemsize).astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def _aligner(json_path: str, model_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(json_path, model_path)
        kind = _pair_type(t.sizes)
        number = TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text", SLICE):
            texts, rows = batch.column("text").fill_null("").to_pylist(), batch.num_rows
            x = align(t, texts)
            described, groups = group_texts(t, x, rows)
            n_a, n_b = np.bincount(x.a_row, minlength=rows), np.bincount(x.b_row, minlength=rows)
            row = x.a_row[x.links[0]].astype(np.uint64)
            pair = (x.a[x.links[0]] * t.sizes[1] + x.b[x.links[1]]).astype(np.uint64)
            # Pairs by row: sorted and counted row by row where one number cannot hold both.
            order = np.lexsort((pair, row)) if kind is np.uint64 else None
            if order is None:
                both, times = np.unique((row << np.uint64(32)) | pair, return_counts=True)
                row_in, pair = (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(kind)
            else:
                r, p = row[order], pair[order]
                new = np.append(True, (r[1:] != r[:-1]) | (p[1:] != p[:-1])) if len(r) else np.zeros(0, bool)
                at = np.flatnonzero(new)
                row_in, pair, times = r[at].astype(np.int64), p[at], np.diff(np.append(at, len(r)))
            first = np.searchsorted(row_in, np.arange(rows + 1))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(number, number + rows)), batch.column("doc_id"), pa.array(n_a), pa.array(n_b), pa.array(groups),
                pa.array(np.bincount(row.astype(np.int64), minlength=rows)),
                pa.array([hashlib.sha256(d).hexdigest() if n else "" for d, n in zip(described, n_a, strict=True)], pa.string()),
                _blobs(pair, first), _blobs(times.astype(np.uint32), first),
            ], schema=arrow_schema(ALIGNED))
            number += rows

    return run


def _column(batch: pa.RecordBatch, name: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a binary column, and the index of each row's first one."""
    raw, offsets = text_bytes(batch.column(name))
    return np.frombuffer(raw.tobytes(), kind), offsets // np.dtype(kind).itemsize


def _sum_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, values = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values, first) if len(first) else values


def _holders(kind: type):
    """How many of the task's documents hold each pair; never more than some millions of pairs at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            keys, counts = held.pop()
            for i in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 16)].astype(np.int64)), pa.array(counts[i : i + (1 << 16)])], names=["pair", "n"])

        for batch in batches:
            keys, counts = np.unique(_column(batch, "pairs", kind)[0], return_counts=True)
            held = [_sum_up([*held, (keys, counts.astype(np.int64))])]
            if len(held[0][0]) > GATHERED:
                yield from out()
        if held:
            yield from out()

    return run


def _looked_up(table: Shared, kind: type, b_size: int, rest: bool):
    """Sums over each document's links. ``rest``: instead the pairs that the table doesn't hold, as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, least, highest = table.value()
        for batch in batches:
            (pairs, first), (times, _) = _column(batch, "pairs", kind), _column(batch, "occurrences", np.uint32)
            times, row = times.astype(np.int64), row_of(first)
            at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
            found = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            n = np.where(found, counts[at] if len(known) else 0, 1 if least <= 2 else 0)
            if rest:
                away = ~found if least > 2 else np.zeros(len(pairs), bool)
                yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(row[away])), pa.array(pairs[away].astype(np.int64)), pa.array(times[away])],
                                                 names=["row", "pair", "times"])
                continue
            best = n == highest[(pairs // kind(b_size)).astype(np.int64)]
            rows = batch.num_rows
            sums = [np.zeros(rows, np.int64) for _ in range(2)]
            np.add.at(sums[0], row[best], times[best])
            np.add.at(sums[1], row, times * n)
            kept = [batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links")]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, sums), batch.column("groups_sha256")], schema=arrow_schema(LOOKED_UP))

    return run


LOOKED_UP = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def aligned(docs: DataFrame, json_path: str, model_path: str) -> DataFrame:
    """One row a document: counts, digest of its groups, and its distinct linked pairs (a * size of B + b) with occurrences.

    Written to the shared folder and read again, so that the texts are cut once and row numbers stay."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    folder = f"{shared_folder(spark)}/aligned-{uuid.uuid4().hex}"
    map_batches(rows, _aligner(json_path, model_path), ALIGNED).write.option("compression", "zstd").parquet(folder)
    return spark.read.parquet(folder)


def pair_counts(rows: DataFrame, sizes: tuple[int, int]) -> DataFrame:
    """(pair, n): how many documents hold each linked pair."""
    parts = map_batches(rows.select("pairs"), _holders(_pair_type(sizes)), "pair long, n long")
    return parts.groupBy("pair").agg(F.sum("n").alias("n"))


def alignment(docs: DataFrame, json_path: str, model_path: str, max_sent: int = MAX_SENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``docs``."""
    spark = docs.sparkSession
    sizes = tokenizers(json_path, model_path).sizes
    kind = _pair_type(sizes)
    rows = aligned(docs, json_path, model_path)
    folder = f"{shared_folder(spark)}/pair-counts-{uuid.uuid4().hex}"
    pair_counts(rows, sizes).write.parquet(folder)
    counts = spark.read.parquet(folder)
    a_id = F.expr(f"pair div {sizes[1]}")
    tops = counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("top"))
    # Pairs by the power of two of their documents: some forty rows.
    sized = counts.groupBy(F.floor(F.log2("n") + 1e-12).cast("int").alias("power")).count().collect()
    sized = {r["power"]: r["count"] for r in sized}
    power, room = max(sized, default=0) + 1, max_sent
    while power > 1 and room >= sized.get(power - 1, 0):
        power -= 1
        room -= sized.get(power, 0)
    least = 1 << power
    sent = counts.where(F.col("n") >= least).toArrow()
    known = sent["pair"].to_numpy()
    order = np.argsort(known)
    highest = np.zeros(sizes[0], np.int64)
    top_rows = tops.toArrow()  # a row for each A id at most
    highest[top_rows["a"].to_numpy()] = top_rows["top"].to_numpy()
    table = Shared(spark, (known[order].astype(kind), sent["n"].to_numpy()[order], least, highest))
    summed = map_batches(rows, _looked_up(table, kind, sizes[1], False), LOOKED_UP)
    columns = [c.split()[0] for c in LOOKED_UP.split(", ") if c != "row long"]
    if least <= 2:
        return summed.select(*columns)
    rest = map_batches(rows.select("row", "pairs", "occurrences"), _looked_up(table, kind, sizes[1], True), "row long, pair long, times long")
    rare = rest.join(counts.where(F.col("n") < least), "pair").withColumn("a", a_id).join(F.broadcast(tops), "a")  # a row for each A id at most
    more = rare.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("top"), F.col("times"))).alias("best"), F.sum(F.col("times") * F.col("n")).alias("total"))
    joined = summed.join(more, "row", "left")
    changed = {"n_best": F.col("n_best") + F.coalesce("best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("total", F.lit(0))}
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in columns])
