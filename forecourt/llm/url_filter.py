"""URL filters: a Bloom filter cascade gives exact membership of listed keys, without a join.

A key is a host suffix with a path prefix. The universe is every key that any url of the corpus has, of the lengths that
are listed. The first level encodes the listed keys; the second the other keys of the universe that the first lets
through; the third the listed keys that the second lets through; and so on until a level lets nothing wrong through. A
key's answer is read from the number of levels it passes, and is exact for every key of the universe.

Its size is known before it is built and must stay under ``MAX_BYTES``, as it is sent to every task.

A null url, or one without ``://``, has an empty host and path, which no rule fits. Equal urls get equal answers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt.llm.common import Shared, cut_lineage, map_batches
from forecourt.llm.words import U64, mix, unique

MAX_BYTES = 256 << 20
KEYS_PER_TASK = 1_000_000
SEGMENT = 16  # bits of a place within a filter segment
SEGMENTS_PER_TASK = 64  # at most 16 MB of places
UPPER, FOLDED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    found = F.instr(url, "://")
    rest = F.when(found > 0, F.substring(url, found + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, FOLDED)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def keys_of(host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys of a url, the longest first, a longer host before a shorter one; ``lengths`` are those of the listed paths."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(path))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(fitting, lambda n: F.struct(
        (-F.length(s) - n).alias("order"), (-F.length(s)).alias("tie"), F.concat(s, F.substring(path, 1, n)).alias("key")))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.array_sort(keys), lambda k: k["key"]))


@dataclass(frozen=True)
class Level:
    bits: np.ndarray  # packed
    size: int
    probes: int

    def places(self, keys: np.ndarray, salt: int) -> np.ndarray:
        return _places(keys, self.size, self.probes, salt)

    def has(self, keys: np.ndarray, salt: int) -> np.ndarray:
        places = self.places(keys, salt)
        return ((self.bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(axis=0) if len(keys) else np.zeros(0, bool)


def _places(keys: np.ndarray, size: int, probes: int, salt: int) -> np.ndarray:
    first = mix(keys + U64((2 * salt + 1) * 0x9E3779B97F4A7C15 % 2**64))
    second = mix(first) | U64(1)
    return np.stack([((first + U64(i) * second) % U64(size)).astype(np.int64) for i in range(probes)])


def passes(levels: list[Level], keys: np.ndarray) -> np.ndarray:
    """Whether each key of the universe is listed: it is if the levels it passes in a row are odd in number."""
    depth = np.zeros(len(keys), np.int64)
    open_ = np.arange(len(keys))
    for i, level in enumerate(levels):
        open_ = open_[level.has(keys[open_], i)]
        depth[open_] += 1
    return depth % 2 == 1


def _filter(keys: DataFrame, count: int, rate: float, salt: int) -> Level:
    """A level for ``count`` keys that lets other keys through at ``rate``; its segments are built by tasks."""
    size = max(64, math.ceil(count * math.log2(1 / rate) / math.log(2)))
    if size > 8 * MAX_BYTES:
        raise ValueError(f"a filter of {size >> 23} MB is over the bound of {MAX_BYTES >> 20} MB")
    probes = max(1, round(math.log2(1 / rate)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = unique(_places(batch.column("key").to_numpy().view(U64), size, probes, salt).ravel())
            yield pa.RecordBatch.from_arrays([pa.array(places >> SEGMENT), pa.array((places & ((1 << SEGMENT) - 1)).astype(np.int32))], names=["segment", "place"])

    bits = np.zeros((size >> 3) + 1, np.uint8)
    placed = map_batches(keys, run, "segment long, place int").groupBy("segment").agg(F.collect_set("place").alias("places"))
    placed = placed.coalesce(-(-size // (SEGMENTS_PER_TASK << SEGMENT)))  # the iterator below runs a job for each partition
    for segment, places in placed.toLocalIterator():
        at = (segment << SEGMENT) + np.array(places, np.int64)
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return Level(bits, size, probes)


def _kept(keys: DataFrame, shared: Shared, salt: int) -> DataFrame:
    """Keys that the last level lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value()
        for batch in batches:
            yield batch.filter(pa.array(level.has(batch.column("key").to_numpy().view(U64), salt)))

    return map_batches(keys, run, "key long")


def _dealt(keys: DataFrame, count: int) -> DataFrame:
    """Keys in tasks by their number, as a shuffle of a small list may leave hundreds of empty ones."""
    return keys.coalesce(-(-count // KEYS_PER_TASK) or 1)


def build_cascade(listed: DataFrame, universe: DataFrame) -> list[Level]:
    """Levels for the listed keys among the universe (both: key long, distinct; listed keys outside it are allowed)."""
    inside, outside = cut_lineage(listed), cut_lineage(universe.join(listed, "key", "left_anti"))
    n, others = inside.count(), outside.count()
    inside, outside = _dealt(inside, n), _dealt(outside, others)
    levels: list[Level] = []
    rate = min(0.5, math.sqrt(0.5) * n / others) if others and n else 0.5
    while n:
        levels.append(level := _filter(inside, n, rate, len(levels)))
        inside, outside = cut_lineage(_kept(outside, Shared(listed.sparkSession, level), len(levels) - 1)), inside
        n, rate = inside.count(), 0.5
    return levels


@dataclass(frozen=True)
class Rules:
    """``verdicts``: rule (host with path) -> allow or block; ``listed``: hosts with paths that the list itself blocks."""

    verdicts: tuple[tuple[str, str, str], ...]
    listed: tuple[tuple[str, str], ...] = ()


def judge(pages: DataFrame, rules: Rules) -> DataFrame:
    """Every row of ``pages`` (page_id, url) with host, path, the longest rule that fits and the verdict."""
    spark = pages.sparkSession
    lengths = sorted({len(p) for _, p, _ in rules.verdicts} | {len(p) for _, p in rules.listed}) or [0]
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path)
    keyed = rows.withColumn("keys", keys_of(F.col("host"), F.col("path"), lengths))
    universe = cut_lineage(keyed.select(F.explode(F.transform("keys", lambda k: F.xxhash64(k))).alias("key")).distinct())
    universe = _dealt(universe, universe.count())

    def cascade(keys: list[str]) -> list[Level]:
        return build_cascade(spark.createDataFrame([(k,) for k in keys], "k string").coalesce(1).select(F.xxhash64("k").alias("key")).distinct(), universe)

    lists = [[h + p for h, p, v in rules.verdicts if v == "block"], [h + p for h, p, v in rules.verdicts if v == "allow"], [h + p for h, p in rules.listed]]
    shared = Shared(spark, [cascade(keys) for keys in lists])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, allows, listed = shared.value()
        for batch in batches:
            hashes = batch.column("hashes")
            flat = hashes.flatten().to_numpy().view(U64)
            kind = np.select([passes(blocks, flat), passes(allows, flat)], [1, 2], 0).astype(np.int32)
            kinds = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(hashes.value_lengths().to_numpy())).astype(np.int32)), pa.array(kind))
            on_list = pa.ListArray.from_arrays(kinds.offsets, pa.array(passes(listed, flat)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], kinds, on_list], names=[*batch.schema.names[:-1], "kinds", "listed"])

    probed = map_batches(keyed.select("page_id", "url", "host", "path", "keys", F.transform("keys", lambda k: F.xxhash64(k)).alias("hashes")), run,
                         f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, host string, path string, keys array<string>, kinds array<int>, listed array<boolean>")
    fits = F.filter(F.arrays_zip("keys", "kinds"), lambda x: x["kinds"] > 0)
    best = F.get(fits, F.lit(0))
    verdict = F.when(best["kinds"] == 1, "block").when(best["kinds"] == 2, "allow").when(F.array_contains("listed", True), "block").otherwise("allow")
    return probed.select("page_id", "url", "host", "path", best["keys"].alias("rule"), verdict.alias("verdict"))
