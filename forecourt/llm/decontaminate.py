"""Benchmark decontamination: SimHash fingerprints of item-sized windows, found by multi-index Hamming blocks.

Everything here is DataFrame operations. A benchmark item of m words is looked for in windows of m words, and three
overlapping halves of it (the first, the middle and the last) in windows of their own size, so a passage of which a
quarter is cut off, or whose parts changed places, still shows a half that nobody touched.

1. *Windows* are cut where a document's shingle meets one of a piece (an item or a half) in its place, and get a 64-bit
   SimHash of their words and word pairs.
2. *Candidates* come from the fingerprints alone: these are split into five blocks of 12 or 13 bits, and the pieces' blocks
   are listed with every change of up to two bits. Two fingerprints at most 14 bits apart agree with one of these in some
   block, so every pair within the radius is found. What lies further apart is no candidate.
3. *Verification* is exact: of a document and an item that are candidates, the window of m words that holds most of the
   item's shingles by weight, over the weight of all of them; shingles of many items weigh less.

Words are lower-case and split at ``[\\x20\\x09-\\x0D]``; items of fewer than ``width`` words are one shingle. Null or
empty items match nothing, null texts hold nothing; empty tables give no rows. Texts of any length are looked through
whole. Equal items are found each; equal rows give the same hits; of windows equally good the first is told. Other columns
are left alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt.llm.common import cut_lineage

WHITE = " \t\n\x0b\x0c\r"
BLOCK_BITS, CHANGED = (13, 13, 13, 13, 12), 2
MASKS = [x for x in range(1 << max(BLOCK_BITS)) if x.bit_count() <= CHANGED]
RADIUS = len(BLOCK_BITS) * (CHANGED + 1) - 1
BROADCAST_ROWS = 4_000_000  # seeds of about 32 bytes, or flagged rows of 16
LISTED_ROWS = 1_000_000  # blocks of pieces, of about 40 bytes
FINGERPRINT = """aggregate(sequence(0, 63), 0L, (all, b) -> all | shiftleft(
    if(2 * aggregate(features, 0, (n, h) -> n + cast(shiftright(h, b) & 1L as int)) > size(features), 1L, 0L), b))"""


def words_of(text: Column) -> Column:
    trimmed = F.btrim(F.lower(text.cast("string")), F.lit(WHITE))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def _shingle(words: Column, at: Column, width: int) -> Column:
    return F.xxhash64(*[F.get(words, at + k) for k in range(width)])


def _shingles(words: Column, width: int) -> Column:
    whole = F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: _shingle(words, i, width))
    return F.when(F.size(words) >= width, F.array_distinct(whole)).otherwise(F.array().cast("array<bigint>"))


def _fingerprint(rows: DataFrame) -> DataFrame:
    pairs = F.when(F.size("words") > 1, F.transform(F.sequence(F.lit(0), F.size("words") - 2), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1))))
    rows = rows.withColumn("features", F.concat(F.transform("words", lambda w: F.xxhash64(w)), F.coalesce(pairs, F.array().cast("array<bigint>"))))
    return rows.withColumn("fingerprint", F.expr(FINGERPRINT)).drop("features")


def _blocks(name: str) -> Column:
    """Number and value of each block of a fingerprint."""
    shifts = [sum(BLOCK_BITS[:k]) for k in range(len(BLOCK_BITS))]
    cut = [F.shiftrightunsigned(name, s).bitwiseAND(F.lit((1 << bits) - 1).cast("long")) for s, bits in zip(shifts, BLOCK_BITS, strict=True)]
    return F.array(*[F.struct(F.lit(k).alias("block"), value.alias("value")) for k, value in enumerate(cut)])


def items_of(benchmark: DataFrame, width: int) -> DataFrame:
    """(item, item_id, words, m, span, fingerprint): the items that have words; ``item`` is their own key."""
    rows = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    rows = rows.withColumn("item", F.xxhash64("item_id", "words"))
    return _fingerprint(rows).withColumn("m", F.size("words")).withColumn("span", F.least(F.col("m"), F.lit(width)))


def pieces_of(items: DataFrame, width: int) -> DataFrame:
    """(item, m, span, words, fingerprint): each item and, where it has more than ``width`` words, its halves; ``m`` is the piece's."""
    half = F.greatest(F.lit(width), F.ceil(F.col("m") / 2).cast("int"))
    spare = F.col("m") - half
    places = F.array(F.struct(F.lit(0).alias("at"), F.col("m").alias("size")), *[
        F.struct(at.cast("int").alias("at"), half.alias("size")) for at in (F.lit(0), F.floor(spare / 2), spare)])
    places = F.when(F.col("m") > width, F.array_distinct(places)).otherwise(F.slice(places, 1, 1))
    rows = items.select("item", "span", "words", F.explode(places).alias("p"))
    rows = rows.select("item", "span", F.col("p.size").alias("m"), F.slice("words", F.col("p.at") + 1, F.col("p.size")).alias("words"))
    return _fingerprint(rows)


def _seeds(pieces: DataFrame, width: int) -> DataFrame:
    """(m, span, place, shingle): where pieces of this width have which shingle."""
    every = F.transform(F.sequence(F.lit(0), F.col("m") - width), lambda i: _shingle(F.col("words"), i, width))
    return pieces.where(F.col("span") == width).select("m", "span", F.posexplode(every).alias("place", "shingle"))


def _split(docs: DataFrame, width: int) -> DataFrame:
    """(row, words): the rows that have words enough."""
    rows = docs.select(F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("row"), words_of(F.col("text")).alias("words"))
    return rows.where(F.size("words") >= width)


def _placed(split: DataFrame, width: int, *more: str) -> DataFrame:
    """(row, n, at, shingle) and ``more`` columns: every shingle in its place."""
    placed = split.select("row", "words", F.size("words").alias("n"), F.explode(F.sequence(F.lit(0), F.size("words") - width)).alias("at"))
    return placed.select("row", "n", "at", _shingle(F.col("words"), F.col("at"), width).alias("shingle"), *more)


def windows_of(docs: DataFrame, seeds: DataFrame, width: int, few: bool) -> DataFrame:
    """(row, m, start, words): windows of documents where a shingle meets a piece's in its place."""
    split = _split(docs, width)
    right = seeds.where(F.col("span") == width).select("shingle", "m", "place")
    start = F.greatest(F.lit(0), F.least(F.col("at") - F.col("place"), F.col("n") - F.col("m"))).alias("start")
    window = F.slice("words", F.col("start") + 1, F.col("m")).alias("words")
    if few:  # the words never leave the task before they are cut
        hits = _placed(split, width, "words").join(F.broadcast(right), "shingle").select("row", "m", "words", start).select("row", "m", "start", window)
        return hits.groupBy("row", "m", "start").agg(F.first("words").alias("words"))
    hits = _placed(split, width).join(right, "shingle").select("row", "m", start).distinct()
    return hits.join(split.dropDuplicates(["row"]), "row").select("row", "m", "start", window)


def candidates(docs: DataFrame, pieces: DataFrame, spans: list[int]) -> DataFrame:
    """(row, item): where a window's fingerprint is within the radius of one of the item's pieces."""
    seeds = reduce(DataFrame.unionByName, [_seeds(pieces, w) for w in spans])
    seeds = cut_lineage(seeds.distinct())
    few = seeds.count() <= BROADCAST_ROWS
    windows = _fingerprint(reduce(DataFrame.unionByName, [windows_of(docs, seeds, w, few) for w in spans]))
    windows = windows.select("row", "m", "fingerprint").distinct()

    masks = F.filter(F.lit(MASKS).cast("array<bigint>"), lambda x: x < F.element_at(F.array(*[F.lit(1 << bits) for bits in BLOCK_BITS]), F.col("b.block") + 1))
    listed = pieces.select("item", "m", F.col("fingerprint").alias("of_piece"), F.explode(_blocks("fingerprint")).alias("b"))
    listed = listed.select("item", "m", "of_piece", "b.block", "b.value", F.explode(masks).alias("mask"))
    listed = listed.select("item", "m", "of_piece", "block", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
    asked = windows.select("row", "m", "fingerprint", F.explode(_blocks("fingerprint")).alias("b")).select("row", "m", "fingerprint", "b.block", "b.value")
    # The planner cannot see how many rows the masks make, so the count decides.
    listed = F.broadcast(listed) if pieces.count() * len(BLOCK_BITS) * len(MASKS) <= LISTED_ROWS else listed.hint("merge")
    met = asked.join(listed, ["m", "block", "value"]).where(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("of_piece"))) <= RADIUS)
    return met.select("row", "item").distinct()


def _best_windows(docs: DataFrame, asked: DataFrame | None, held: DataFrame, spans: list[int], weights: DataFrame, whole: DataFrame, similarity: float) -> DataFrame:
    """(row, doc_id, item_id, start, n_words, distance, similarity): the best window of every asked (row, item) that holds the item's weight.

    Without ``asked`` every row is looked through for every item.
    """
    shingled = held.select("item", "span", F.explode("shingles").alias("shingle")).join(weights, "shingle")
    few = asked is not None and asked.count() <= BROADCAST_ROWS
    hits = None
    for w in spans:
        split = _split(docs, w)
        if asked is not None:
            named = asked.select("row").distinct()
            split = split.join(F.broadcast(named) if few else named, "row", "left_semi")
        right = shingled.where(F.col("span") == w).drop("span")
        met = _placed(split, w).join(F.broadcast(right) if right.count() <= BROADCAST_ROWS else right, "shingle")
        if asked is not None:
            met = met.join(F.broadcast(asked) if few else asked, ["row", "item"], "left_semi")
        hits = met if hits is None else hits.unionByName(met)
    # First the weight of all shingles that a row and an item share; few reach what a window must hold.
    once = hits.groupBy("row", "item", "shingle").agg(F.first("weight").alias("weight"), F.collect_set("at").alias("places"), F.max("n").alias("n"))
    enough = once.groupBy("row", "item").agg(F.sum("weight").alias("most"), F.max("n").alias("n"), F.flatten(F.collect_list(
        F.transform("places", lambda at: F.struct(at.alias("at"), F.col("shingle"), F.col("weight"))))).alias("hits"))
    enough = enough.join(whole.select("item", "whole"), "item").where(F.col("most") >= (similarity - 1e-9) * F.col("whole"))
    enough = enough.join(held.select("item", "item_id", "m", "span", F.col("fingerprint").alias("of_item")), "item").withColumn("hits", F.array_sort("hits"))
    room = F.col("m") - F.col("span") + 1  # places of a window

    def window(hit: Column, i: Column) -> Column:
        inside = F.filter(F.slice(F.col("hits"), i + 1, room), lambda x: x["at"] < hit["at"] + room)
        own = F.array_distinct(F.transform(inside, lambda x: F.struct(x["shingle"], x["weight"])))
        return F.struct(F.aggregate(own, F.lit(0.0), lambda s, x: s + x["weight"]).alias("held"), (-hit["at"]).alias("before"))

    best = enough.withColumn("best", F.array_max(F.transform("hits", window))).withColumn("similarity", F.col("best.held") / F.col("whole"))
    best = best.where(F.col("similarity") >= similarity - 1e-9)
    start = F.greatest(F.lit(0), F.least(-F.col("best.before"), F.col("n") - F.col("m")))
    best = cut_lineage(best.select("row", "item", "item_id", "m", "of_item", "similarity", start.alias("start")))
    right = F.broadcast(best) if best.count() <= BROADCAST_ROWS else best
    texts = docs.select(F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = texts.join(right, "row").withColumn("words", F.slice(words_of(F.col("text")), F.col("start") + 1, F.col("m"))).drop("text")
    found = _fingerprint(found)
    distance = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("of_item"))).alias("distance")
    return found.select("row", "doc_id", "item_id", "start", F.size("words").alias("n_words"), distance, "similarity").distinct()


def find(docs: DataFrame, benchmark: DataFrame, width: int = 5, similarity: float = 0.75, fingerprints: bool = True) -> DataFrame:
    """(row, doc_id, item_id, start, n_words, distance, similarity): each row's best window for each item it holds.

    Without ``fingerprints`` every row is verified against every item: the measure of what the fingerprints find.
    """
    items = cut_lineage(items_of(benchmark, width))
    spans = [r[0] for r in items.select("span").distinct().orderBy("span").collect()] or [width]  # at most ``width`` numbers
    cases = F.coalesce(*[F.when(F.col("span") == w, _shingles(F.col("words"), w)) for w in spans])
    held = items.select("item", "item_id", "m", "span", "fingerprint", cases.alias("shingles"))
    terms = held.select("item", F.explode("shingles").alias("shingle"))
    total = items.count()
    weights = terms.groupBy("shingle").agg(F.count("*").alias("holders")).select("shingle", F.log1p(F.lit(total) / F.col("holders")).alias("weight"))
    weights = cut_lineage(weights)
    whole = terms.join(weights, "shingle").groupBy("item").agg(F.sum("weight").alias("whole"))
    asked = cut_lineage(candidates(docs, cut_lineage(pieces_of(items, width)), spans)) if fingerprints else None
    found = _best_windows(docs, asked, held, spans, weights, whole, similarity)
    # The same item_id may name several texts.
    best = F.max(F.struct("similarity", (-F.col("distance")).alias("nearness"), (-F.col("start")).alias("before"), "n_words")).alias("best")
    found = found.groupBy("row", "doc_id", "item_id").agg(best)
    return found.select("row", "doc_id", "item_id", (-F.col("best.before")).alias("start"), F.col("best.n_words").alias("n_words"), (-F.col("best.nearness")).alias("distance"), F.col("best.similarity").alias("similarity"))


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 5, similarity: float = 0.75) -> DataFrame:
    """(doc_id, item_id, start, n_words, distance, similarity): the documents that hold an item, one row for each item."""
    return find(docs, benchmark, width, similarity).drop("row").distinct()


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 5, similarity: float = 0.75) -> DataFrame:
    """The rows that hold no item, with all their columns."""
    flagged = cut_lineage(find(docs, benchmark, width, similarity).select("row", F.col("doc_id").alias("id")).distinct())
    right = F.broadcast(flagged) if flagged.count() <= BROADCAST_ROWS else flagged
    mark = F.xxhash64(docs["doc_id"].cast("long"), docs["text"])
    return docs.join(right, (mark == right["row"]) & docs["doc_id"].cast("long").eqNullSafe(right["id"]), "left_anti")
