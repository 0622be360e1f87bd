"""Line dedup: a line that another document has before stays there only; documents get keep bitmaps, not new texts.

Lines become 128-bit hashes of their keys, dealt by range over (hash, document, row, place) and sorted within each
range, so that a line held by a third of all documents spreads over many ranges. A stream over each range sees every
hash's documents in order. The only thing a range must know of others is the first document of a hash that began in an
earlier one; one row a range tells that.

A line's key is the line without white space at both ends, A-Z in lower case; keys under ``least`` code points always
stay. A null text is one empty line. A null doc_id comes after all others; rows with one doc_id are one document,
and equal rows get equal bitmaps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forecourt.llm.common import arrow_schema, cut_lineage, map_batches
from forecourt.llm.words import line_table, slices

LINES = "h1 long, h2 long, late int, doc long, row long, place int, n_lines int"
EDGES = "part int, f1 long, f2 long, first_late int, first_doc long, l1 long, l2 long, last_late int, last_doc long"
DROPPED = "late int, doc long, row long, place int, n_lines int"
ORDER = ["h1", "h2", "late", "doc", "row", "place"]


def _keyed(docs: DataFrame) -> DataFrame:
    """A row's key besides its doc_id, which need not be unique."""
    return docs.withColumn("row", F.xxhash64(F.col("doc_id").cast("long"), F.col("text")))


def _hashes(least: int):
    schema = arrow_schema(LINES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            lines = line_table(batch.column("text"))
            row = lines["row"]
            counts = np.bincount(row, minlength=batch.num_rows)
            place = np.arange(len(row)) - np.concatenate([[0], np.cumsum(counts)])[row]
            keep = lines["points"] >= least
            row, at = row[keep], pa.array(row[keep])
            ids = batch.column("doc_id").take(at)
            yield pa.RecordBatch.from_arrays([
                pa.array(lines["h1"][keep].view(np.int64)), pa.array(lines["h2"][keep].view(np.int64)),
                ids.is_null().cast(pa.int32()), ids.fill_null(0).cast(pa.int64()), batch.column("row").take(at),
                pa.array(place[keep].astype(np.int32)), pa.array(counts[row].astype(np.int32)),
            ], schema=schema)

    return run


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one range, its first row and the first document of its last hash."""
    from pyspark import TaskContext

    first = last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, late, doc = (batch.column(c).to_numpy() for c in ("h1", "h2", "late", "doc"))
        own = np.flatnonzero((h1 == h1[-1]) & (h2 == h2[-1]))[0]
        if first is None:
            first = (h1[0], h2[0], late[0], doc[0])
        if last is None or own > 0 or last[:2] != (h1[-1], h2[-1]):
            last = (h1[own], h2[own], late[own], doc[own])
    if first is not None:
        row = (TaskContext.get().partitionId(), *map(int, first), *map(int, last))
        schema = arrow_schema(EDGES)
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)


def _carried(edges: list) -> dict[int, tuple[int, int, int, int]]:
    """For each range, the hash that is open where it begins, and that hash's first document."""
    carry, open_ = {}, None
    for e in sorted(edges, key=lambda e: e["part"]):
        if open_ is not None:
            carry[e["part"]] = open_
        if open_ is None or open_[:2] != (e["l1"], e["l2"]):
            open_ = (e["l1"], e["l2"], e["last_late"], e["last_doc"])
    return carry


def _later(carry: dict[int, tuple[int, int, int, int]]):
    """Rows whose hash has an earlier document."""
    schema = arrow_schema(DROPPED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        open_ = carry.get(TaskContext.get().partitionId())
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, late, doc = (batch.column(c).to_numpy() for c in ("h1", "h2", "late", "doc"))
            starts = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]))
            run_of = np.cumsum(np.isin(np.arange(len(h1)), starts)) - 1
            first_late, first_doc = late[starts].copy(), doc[starts].copy()
            if open_ is not None and open_[:2] == (h1[0], h2[0]):
                first_late[0], first_doc[0] = open_[2:]
            open_ = (int(h1[-1]), int(h2[-1]), int(first_late[-1]), int(first_doc[-1]))
            dropped = (late != first_late[run_of]) | (doc != first_doc[run_of])
            at = pa.array(np.flatnonzero(dropped))
            yield pa.RecordBatch.from_arrays([batch.column(f.name).take(at) for f in schema], schema=schema)

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for places, n in zip(batch.column("places"), batch.column("n_lines").to_pylist(), strict=True):
            bits = np.ones(n, np.uint8)
            bits[places.values.to_numpy()] = 0
            maps.append(zlib.compress(np.packbits(bits).tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column("late"), batch.column("doc"), batch.column("row"), batch.column("n_lines"), pa.array(maps, pa.binary())],
                                         names=["late", "doc", "row", "n_lines", "keep"])


def keep_bitmaps(docs: DataFrame, least: int = 10) -> DataFrame:
    """(late, doc, row, n_lines, keep) for rows that lose lines: ``keep`` is a packed bit a line, compressed."""
    spark = docs.sparkSession
    docs = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    lines = cut_lineage(map_batches(docs, _hashes(least), LINES))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = cut_lineage(lines.repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER))
    carry = _carried(map_batches(ranges, _edges, EDGES).collect())
    dropped = map_batches(ranges, _later(carry), DROPPED)
    grouped = dropped.groupBy("late", "doc", "row").agg(F.collect_set("place").alias("places"), F.max("n_lines").alias("n_lines"))
    return map_batches(grouped, _pack, "late int, doc long, row long, n_lines int, keep binary")


KEPT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
KEPT_ARROW = pa.struct([("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])


def _kept(text: str | None, keep: bytes | None) -> dict:
    if keep is None:
        return {"text": text, "n_lines": 1 + (text or "").count("\n"), "n_dropped": 0}
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    kept = [x for x, b in zip(lines, bits, strict=True) if b]
    return {"text": "\n".join(kept), "n_lines": len(lines), "n_dropped": len(lines) - len(kept)}


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        kept = [_kept(t, k) for t, k in zip(batch.column("text").to_pylist(), batch.column("keep").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(kept, KEPT_ARROW)], names=["doc", "kept"])


def dedup_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """``doc``: each row as it was; ``kept``: its text without the lines that earlier documents have, and line counts."""
    maps = keep_bitmaps(docs, least).select("late", "doc", "row", "keep")
    whole = docs.select(F.struct("*").alias("whole"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("row"),
                        F.col("doc_id").isNull().cast("int").alias("late"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc"))
    joined = whole.join(maps, ["row", "late", "doc"], "left").select(F.col("whole").alias("doc"), F.col("whole.text").cast("string").alias("text"), "keep")
    return map_batches(joined, _apply, T.StructType([T.StructField("doc", docs.schema), T.StructField("kept", KEPT)]))
