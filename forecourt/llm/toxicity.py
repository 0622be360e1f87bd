"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, word pairs and pairs with one or two words between. The model
learns from a bounded sample of labelled rows: the ``max_rows`` with the least hash of their doc_id, so it is the same
on every run. Every coordinate has its own rate; the L1 term leaves few weights, sorted by feature, which are all that
is sent to the tasks that score. Only the text is ever an input of a score.

Null and empty texts have no feature and score as the prior. Labels that are null are no labels; a doc_id labelled more
than once counts as toxic if any row says so, and of repeated documents one teaches. Without any label of both kinds
nothing is known and every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forecourt.llm.common import Shared, arrow_schema, map_batches
from forecourt.llm.words import U64, chain, mix, row_of, slices, unique, words

FEATURE_BITS = 30
COUNT_BITS = 24
WEIGHTS = "features binary, weights binary, intercept double"


@dataclass(frozen=True)
class Settings:
    """``max_rows`` bounds the labelled sample; the rest are the usual FTRL terms."""

    max_rows: int = 16_000
    min_docs: int = 3
    epochs: int = 4
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 5.0
    l2: float = 1.0


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(feature, row) of every n-gram and skip-gram, repeats included."""
    hashes, first = words(column)
    rows = row_of(first)
    out, of = [hashes], [rows]
    for gap in (1, 2, 3):
        if len(hashes) > gap:
            near = rows[:-gap] == rows[gap:]
            out.append(chain(hashes[:-gap] + U64(gap), hashes[gap:])[near])
            of.append(rows[:-gap][near])
    return (np.concatenate(out) >> U64(64 - FEATURE_BITS)).astype(np.uint32), np.concatenate(of)


def distinct(feature: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each feature of a row once, by row."""
    key = unique((row.astype(U64) << U64(FEATURE_BITS)) | feature.astype(U64))
    return (key & U64((1 << FEATURE_BITS) - 1)).astype(np.uint32), (key >> U64(FEATURE_BITS)).astype(np.int64)


def train(texts: pa.Array, labels: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, float]:
    """Sorted features, their weights, and the intercept."""
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    counts = np.zeros(1 << COUNT_BITS, np.uint16)
    shift = FEATURE_BITS - COUNT_BITS
    for part in slices(iter([batch]), "text"):
        cells, times = np.unique(distinct(*features(part.column("text")))[0] >> shift, return_counts=True)
        counts[cells] = np.minimum(counts[cells].astype(np.int64) + times, 60_000)
    kept = []
    for part in slices(iter([batch]), "text"):
        feature, row = distinct(*features(part.column("text")))
        often = counts[feature >> shift] >= settings.min_docs
        feature, row = feature[often], row[often]
        edges = np.searchsorted(row, np.arange(part.num_rows + 1))
        kept += [feature[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    known = unique(np.concatenate(kept)) if kept else np.zeros(0, np.uint32)
    places = [np.searchsorted(known, k).astype(np.int32) for k in kept]
    share = labels.mean()
    intercept = float(np.log(share / (1 - share)))
    z, n = np.zeros(len(known)), np.zeros(len(known))

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= settings.l1, 0.0, (np.sign(zi) * settings.l1 - zi) / ((settings.beta + np.sqrt(ni)) / settings.alpha + settings.l2))

    for epoch in range(settings.epochs):
        for i in np.argsort(mix(np.arange(len(places), dtype=U64) + U64(epoch << 32))):
            at = places[i]
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            g = 1 / (1 + np.exp(-np.clip(intercept + w.sum(), -35, 35))) - labels[i]
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / settings.alpha * w
            n[at] = ni + g * g
    w = weights(z, n)
    return known[w != 0], w[w != 0].astype(np.float32), intercept


def _trainer(settings: Settings):
    schema = arrow_schema(WEIGHTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if rows is None:
            return
        ids = rows.column("doc_id").to_numpy()
        order = np.lexsort((ids, mix(ids.view(U64))))
        labels = rows.column("toxic").to_numpy()[order].astype(float)
        if labels.min() == labels.max():
            return
        texts = rows.column("text").combine_chunks().take(pa.array(order))
        known, weights, intercept = train(texts, labels, settings)
        yield pa.RecordBatch.from_arrays([pa.array([known.tobytes()], pa.binary()), pa.array([weights.tobytes()], pa.binary()), pa.array([intercept])], schema=schema)

    return run


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> tuple[np.ndarray, np.ndarray, float] | None:
    """The model learnt from labelled rows that are not held out; None where nothing can be learnt."""
    labelled = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    labelled = labelled.where("doc_id is not null and toxic in (0, 1)").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    found = map_batches(rows.repartition(1), _trainer(settings), WEIGHTS).collect()
    return (np.frombuffer(found[0][0], np.uint32), np.frombuffer(found[0][1], np.float32), found[0][2]) if found else None


def held_out(column: str):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))


def _scorer(model: Shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights, intercept = model.value()
        table = np.zeros(1 << 20, bool)
        table[known >> (FEATURE_BITS - 20)] = True
        for batch in slices(batches, "text"):
            feature, row = features(batch.column("text"))
            maybe = table[feature >> (FEATURE_BITS - 20)]
            feature, row = distinct(feature[maybe], row[maybe])
            at = np.minimum(np.searchsorted(known, feature), max(len(known) - 1, 0))
            hit = known[at] == feature if len(known) else np.zeros(0, bool)
            total = intercept + np.bincount(row[hit], weights=weights[at[hit]].astype(float), minlength=batch.num_rows)
            score = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], names=[*batch.schema.names[:-1], "score"])

    return run


def scores(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, score) for every row of ``docs``."""
    model = fit(docs, labels, settings)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"))
    return map_batches(rows, _scorer(Shared(docs.sparkSession, model)), "doc_id long, score double")


def without_toxic(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), threshold: float = 0.5) -> DataFrame:
    """The rows whose score is under ``threshold``, with all their columns."""
    model = fit(docs, labels, settings)
    if model is None:
        return docs
    names = docs.columns
    shared = Shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            only = pa.RecordBatch.from_arrays([batch.column("text")], names=["text"])
            score = np.concatenate([b.column("score").to_numpy() for b in _scorer(shared)(iter([only]))])
            yield batch.filter(pa.array(score < threshold)).select(names)

    return map_batches(docs, run, docs.schema)
