"""N-gram Jaccard join: documents linked when their word shingle sets are alike, by filtering under several global orders.

Two sets with a similarity of at least t share a token among the first ``n - ceil(t * n) + 1`` of each, under *any*
order of all tokens. So a pair that fails under one order is no link, and a pair must pass under all of them:

1. *Unshared first.* Under an order that puts tokens of one document only in front, a document whose prefix holds
   nothing else can have no partner. Shingles are counted in buckets of their hash; a map task sends each of its
   distinct shingles once, so a shingle in a third of all documents costs one entry a task.
2. *Rare first*, ties by token: documents that share a prefix token become candidates.
3. *Rare first by powers of two*, ties by another hash, twice: candidates must overlap in these prefixes as well.

What is left is verified over the whole sets. Links only matter for what they connect, so groups are never expanded
into all pairs: every document is first compared with the least document under each of its prefix tokens; after that
only pairs whose documents do not hang together yet are compared, all of them.

Nulls, empty texts and texts without words have an empty set and link with nothing. Repeated rows and repeated
doc_ids are rows of their own. A null doc_id takes part but never names a component, unless all its members are null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forecourt.llm.common import arrow_schema, cut_lineage, map_batches, power_of_two
from forecourt.llm.components import components
from forecourt.llm.words import CHUNK_BYTES, U64, chain, mix, row_of, slices, words

CHUNK = "key long, batch long, kind int, tokens binary, docs binary, sizes binary"
SHARED = "batch long, kind int, tokens binary, docs binary, sizes binary"
SETS = "uid long, doc_id long, row long, n long, tokens array<long>, same1 long, same2 long"
BROADCAST_ROWS = 4_000_000  # of 16 bytes
CLASS = 1.1  # ratio of sizes within a class
ANNOUNCED = 0xFFFF
ROWS_PER_BUCKET = 1_000  # documents for each bucket of shingle hashes: some hundred thousand shingles


def shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every distinct shingle of every row, sorted by hash, then row."""
    hashes, first = words(column)
    count = np.diff(first)
    rows = row_of(first)
    whole = np.zeros(0, U64), np.zeros(0, np.int64)
    if len(hashes) >= width:
        windows = chain(*[hashes[k : len(hashes) - width + 1 + k] for k in range(width)])
        at = np.flatnonzero(rows[: len(windows)] == rows[width - 1 :])
        whole = windows[at], rows[at]
    brief = [np.flatnonzero(count == k) for k in range(1, width)]
    short = np.concatenate([np.zeros(0, np.int64), *brief])
    few = np.concatenate([np.zeros(0, U64), *[mix(chain(*[hashes[first[r] + i] for i in range(k)]) + U64(k)) for k, r in enumerate(brief, 1)]])
    hashes, rows = np.concatenate([whole[0], few]), np.concatenate([whole[1], short])
    order = np.lexsort((rows, hashes)) if len(short) else np.argsort(hashes, kind="stable")
    hashes, rows = hashes[order], rows[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[fresh], rows[fresh]


def run_lengths(hashes: np.ndarray) -> np.ndarray:
    """How often each item's value occurs, for sorted values."""
    starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(starts, len(hashes)))
    return np.repeat(lengths, lengths)


def pack(tokens: np.ndarray) -> bytes:
    """The lower seven bytes of each token; the bucket knows the first."""
    return tokens.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 1:].tobytes()


def unpack(data: bytes, top: int) -> np.ndarray:
    out = np.empty((len(data) // 7, 8), np.uint8)
    out[:, 0] = top
    out[:, 1:] = np.frombuffer(data, np.uint8).reshape(-1, 7)
    return out.reshape(-1).view(">u8").astype(U64)


def _from_texts(width: int):
    """Parts of a task's rows with their shingles: (uid, doc_id, row), sizes, tokens and their rows."""

    def run(part: int, batches: Iterator[pa.RecordBatch]):
        for i, batch in enumerate(slices(batches, "text", CHUNK_BYTES)):
            tokens, rows = shingles(batch.column("text"), width)
            uid = np.arange(batch.num_rows) + (((part << 20) + i) << 16)
            yield pa.array(uid), batch.column("doc_id"), batch.column("row"), np.bincount(rows, minlength=batch.num_rows), tokens, rows

    return run


def _from_sets(part: int, batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for a in range(0, batch.num_rows, 4_000):
            own = batch.slice(a, 4_000)
            lists = own.column("tokens")
            tokens, rows = lists.flatten().to_numpy().view(U64), np.repeat(np.arange(own.num_rows), lists.value_lengths().to_numpy())
            order = np.lexsort((rows, tokens))
            yield own.column("uid"), own.column("doc_id"), own.column("row"), own.column("n").to_numpy(), tokens[order], rows[order]


def _chunks(parts, bits: int):
    """Rows for the buckets (kind 0), and what needs no question (kind 1: shared in the batch, kind 2: its documents)."""
    schema = arrow_schema(CHUNK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for i, (uid, ids, marks, sizes, tokens, rows) in enumerate(parts(part, batches)):
            number = (part << 20) + i
            often = run_lengths(tokens) > 1
            first = np.ones(len(tokens), bool)
            first[1:] = tokens[1:] != tokens[:-1]
            asked, asked_docs = tokens[first], np.where(often, ANNOUNCED, rows).astype(np.uint16)[first]
            bucket = (asked >> U64(64 - bits)).astype(np.int64)
            edges = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else [], len(bucket)).astype(np.int64)
            home = -1 - int(mix(np.array([number], U64))[0] >> U64(64 - bits))
            head = np.concatenate([uid.to_numpy(), ids.fill_null(0).to_numpy(zero_copy_only=False), marks.to_numpy()])
            out = [(home, number, 2, head.astype(np.int64).tobytes(), ids.is_null().to_numpy(zero_copy_only=False).tobytes(), sizes.astype(np.int64).tobytes())]
            out.append((home, number, 1, tokens[often].tobytes(), rows[often].astype(np.uint16).tobytes(), b""))
            out += [(int(bucket[a]), number, 0, pack(asked[a:b]), asked_docs[a:b].tobytes(), b"") for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def _answer(bits: int):
    """Of one bucket, each batch's shingles that another batch holds too. Rows that ask nothing pass."""
    schema = arrow_schema(SHARED)

    def run(group: pa.Table) -> pa.Table:
        if group.column("kind")[0].as_py():
            return group.select(schema.names).cast(schema)
        top = group.column("key")[0].as_py() >> (bits - 8)
        batches = group.column("batch").to_numpy()
        parts = [unpack(x.as_buffer(), top) for x in group.column("tokens")]
        docs = np.concatenate([np.frombuffer(x.as_buffer(), np.uint16) for x in group.column("docs")])
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        tokens = np.concatenate(parts)
        order = np.argsort(tokens, kind="stable")
        found = np.zeros(len(tokens), bool)
        found[order] = run_lengths(tokens[order]) > 1
        found &= docs != ANNOUNCED
        tokens, docs, owner = tokens[found], docs[found], owner[found]
        edges = np.searchsorted(owner, np.arange(len(parts) + 1))
        out = [(int(batches[k]), 0, tokens[a:b].tobytes(), docs[a:b].tobytes(), b"") for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
        return pa.table([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return run


def _gather(percent: int):
    """Documents of one batch, with their shared shingles where these are enough for a partner."""
    schema = arrow_schema(SETS)

    def run(group: pa.Table) -> pa.Table:
        kinds = group.column("kind").to_numpy()
        head = int(np.flatnonzero(kinds == 2)[0])
        uid, ids, marks = np.frombuffer(group.column("tokens")[head].as_buffer(), np.int64).reshape(3, -1)
        null = np.frombuffer(group.column("docs")[head].as_buffer(), bool)
        sizes = np.frombuffer(group.column("sizes")[head].as_buffer(), np.int64)
        rest = np.flatnonzero(kinds != 2)
        tokens = np.concatenate([np.frombuffer(group.column("tokens")[int(k)].as_buffer(), U64) for k in rest])
        docs = np.concatenate([np.frombuffer(group.column("docs")[int(k)].as_buffer(), np.uint16) for k in rest])
        shared = np.bincount(docs, minlength=len(ids))
        keep = (shared > 0) & (100 * shared >= percent * sizes)
        inside = keep[docs]
        tokens, docs = tokens[inside], docs[inside]
        order = np.lexsort((tokens, docs))
        lengths = np.where(keep, shared, 0)
        lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(lengths)).astype(np.int32), pa.array(tokens[order].view(np.int64)))
        # Where all shingles are shared, two sums over them tell equal sets.
        whole = keep & (shared == sizes)
        sums = [np.zeros(len(ids), U64) for _ in range(2)]
        for k in range(2):
            np.add.at(sums[k], docs, mix(tokens + U64(k + 1)))
        same = [pa.array(x.view(np.int64), mask=~whole) for x in sums]
        return pa.table([pa.array(uid), pa.array(ids, mask=null), pa.array(marks), pa.array(sizes), lists.cast(schema.field("tokens").type), *same], schema=schema)

    return run


def _mark(docs: DataFrame) -> Column:
    """A row's key besides its doc_id, which need not be unique."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string")).alias("row")


def _shared(chunks: DataFrame, bits: int, percent: int) -> DataFrame:
    answers = chunks.groupBy("key").applyInArrow(_answer(bits), SHARED)
    return answers.groupBy("batch").applyInArrow(_gather(percent), SETS)


def _bits(rows: int) -> int:
    return max(8, power_of_two(rows / ROWS_PER_BUCKET, 256).bit_length() - 1)


def shared_sets(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """(uid, doc_id, row, n, tokens, same1, same2): each row's set size and, if it can have a partner at all, its shared shingles."""
    bits = _bits(docs.count())
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _mark(docs))
    return _shared(map_batches(docs, _chunks(_from_texts(width), bits), CHUNK), bits, percent)


def _needed(n: Column, other: Column, percent: int) -> Column:
    """How many shingles two linked sets of these sizes have in common at least."""
    return F.ceil((n + other) * percent / F.lit(100 + percent))


def _first_of(terms: Column, percent: int) -> Column:
    """Tokens of the prefix: unshared ones stand first and are not listed, so they only use it up."""
    length = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1 - (F.col("n") - F.size(terms))
    return F.transform(F.slice(F.array_sort(terms), F.lit(1), F.greatest(length, F.lit(0)).cast("int")), lambda x: x["token"])


def _by_powers(seed: int) -> Column:
    """Terms that sort by the power of two of how often they are held, then by a hash."""

    def term(x: Column) -> Column:
        return F.struct(F.floor(F.log2(x["held"])).alias("power"), F.xxhash64(F.lit(seed), x["token"]).alias("hash"), x["token"].alias("token"))

    return F.transform("terms", term)


def _alike(percent: int) -> Column:
    both = F.size(F.array_intersect("x.tokens", "y.tokens"))
    return both * 100 >= (F.col("x.n") + F.col("y.n") - both) * percent


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that pass under the other orders, by the prefixes that their two sizes ask for, then over their whole sets."""
    needed = _needed(F.col("x.n"), F.col("y.n"), percent)

    def prefix(side: str, name: str) -> Column:
        return F.slice(f"{side}.{name}", F.lit(1), F.greatest(F.size(f"{side}.tokens") - needed + 1, F.lit(0)).cast("int"))

    joined = pairs.join(sets.select(F.col("uid").alias("a"), F.struct("n", "tokens", "second", "third").alias("x")), "a")
    joined = joined.join(sets.select(F.col("uid").alias("b"), F.struct("n", "tokens", "second", "third").alias("y")), "b")
    joined = joined.where(F.least(F.size("x.tokens"), F.size("y.tokens")) >= needed)
    joined = joined.where(F.arrays_overlap(prefix("x", "second"), prefix("y", "second"))).where(F.arrays_overlap(prefix("x", "third"), prefix("y", "third")))
    return joined.where(_alike(percent)).select("a", "b")


def links(sets: DataFrame, percent: int = 75) -> DataFrame:
    """Links (a, b) that connect what belongs together among distinct sets (uid, n, tokens): not all, but enough."""
    terms = sets.select("uid", "n", F.explode("tokens").alias("token"))
    often = terms.groupBy("token").agg(F.count("*").alias("held"))
    ranked = terms.join(often, "token").groupBy("uid", "n").agg(F.collect_list(F.struct("held", "token")).alias("terms"))
    ranked = ranked.select(
        "uid", "n", F.transform("terms", lambda x: x["token"]).alias("tokens"), _first_of(F.col("terms"), percent).alias("first"),
        _first_of(_by_powers(1), percent).alias("second"), _first_of(_by_powers(2), percent).alias("third"),
    )
    sets = cut_lineage(ranked)
    alone = (1 - F.size("tokens") / F.col("n")).alias("alone")
    shared = F.size("tokens").alias("shared")
    held = sets.select("uid", "n", shared, alone, F.posexplode("first").alias("at", "token"))
    leaders = held.groupBy("token").agg(F.min(F.struct("alone", "uid", "n")).alias("m")).select("token", F.col("m.uid").alias("a"), F.col("m.n").alias("a_n"))
    fits = lambda p, q: (F.least(p, q) * 100 >= F.greatest(p, q) * percent)
    stars = held.join(leaders, "token").where(F.col("uid") != F.col("a")).where(fits(F.col("n"), F.col("a_n"))).select("a", F.col("uid").alias("b")).distinct()
    star_links = cut_lineage(_verified(stars, sets, percent))

    # What hangs together already needs no more comparisons.
    up = components(star_links).withColumnRenamed("node", "uid")
    placed = held.join(up, "uid", "left").select("token", "uid", "n", (F.col("shared") - F.col("at")).alias("rest"), F.coalesce("root", "uid").alias("root"))
    mixed = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("token")
    placed = cut_lineage(placed.join(mixed, "token"))
    # Sets meet by classes of size, each in the prefix that the sizes of the two classes ask for.
    steps = math.floor(math.log(100 / percent) / math.log(CLASS)) + 1
    own = F.floor(F.log("n") / math.log(CLASS) + 1e-9).cast("int")
    placed = placed.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    least_size = lambda c: F.floor(F.pow(F.lit(CLASS), c) + 1e-6)
    small = placed.withColumn("c", own).withColumn("d", F.col("c") + F.col("step")).withColumn("other_n", F.greatest(F.col("n"), least_size(F.col("d"))))
    large = placed.withColumn("d", own).withColumn("c", F.col("d") - F.col("step")).withColumn("other_n", least_size(F.col("c")))
    enough = F.col("rest") >= _needed(F.col("n"), F.col("other_n"), percent)
    key = ["token", "c", "d"]
    small = small.where(enough).select(*key, "root", F.col("uid").alias("a"), F.col("n").alias("a_n"), F.col("rest").alias("a_rest"))
    large = large.where(enough).select(*key, F.col("root").alias("other"), F.col("uid").alias("b"), F.col("n").alias("b_n"), F.col("rest").alias("b_rest"))
    fit = F.least("a_rest", "b_rest") >= _needed(F.col("a_n"), F.col("b_n"), percent)
    left = small.groupBy(*key, "root", "a_n").agg(F.max("a_rest").alias("a_rest"))
    right = large.groupBy(*key, "other", "b_n").agg(F.max("b_rest").alias("b_rest"))
    meeting = left.join(right, key).where("root <> other and a_n <= b_n").where(fit).drop("a_rest", "b_rest")
    pairs = meeting.join(small, [*key, "root", "a_n"]).join(large, [*key, "other", "b_n"])
    pairs = pairs.where(F.struct("a_n", "a") < F.struct("b_n", "b")).where(fit)
    pairs = pairs.select("a", "b").distinct()
    rest = _verified(pairs, sets, percent)
    return star_links.unionByName(rest)


def classes(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, row, uid, n, root, linked): each row's class."""
    sets = cut_lineage(shared_sets(docs, width, percent))
    able = sets.where(F.size("tokens") > 0)
    # Equal sets first: all their shingles are shared. Only one of each goes on, and must share its shingles with others.
    whole = able.where("same1 is not null").select("uid", "n", "same1", "same2")
    least = whole.groupBy("n", "same1", "same2").agg(F.min("uid").alias("rep"))
    copies = cut_lineage(whole.join(least, ["n", "same1", "same2"]).where("uid <> rep").select("uid", "rep"))
    spare = copies.select("uid")
    if copies.count() <= BROADCAST_ROWS:
        reps = able.join(F.broadcast(spare), "uid", "left_anti")
    else:  # a shuffled join may give another order when a task runs again, and batches are numbered by place
        reps = cut_lineage(able.join(spare, "uid", "left_anti"))
    bits = _bits(docs.count())
    reps = _shared(map_batches(reps, _chunks(_from_sets, bits), CHUNK), bits, percent).where(F.size("tokens") > 0).select("uid", "n", "tokens")
    roots = components(links(reps, percent)).withColumnRenamed("node", "rep")
    placed = able.select("uid").join(copies, "uid", "left").select("uid", F.coalesce("rep", "uid").alias("rep"))
    placed = placed.join(roots, "rep", "left").select("uid", F.coalesce("root", "rep").alias("root"))
    return sets.select("uid", "doc_id", "row", "n").join(placed, "uid", "left").select(
        "doc_id", "row", "uid", "n", F.coalesce("root", "uid").alias("root"), F.col("root").isNotNull().alias("linked")
    )


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text; other columns are left alone)."""
    named = cut_lineage(classes(docs, width, percent))
    least = named.where("linked").groupBy("root").agg(F.min("doc_id").alias("least"))
    return named.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` with one row of each component, that of the least doc_id (null last); of rows equal to it, any one."""
    named = cut_lineage(classes(docs, width, percent).where("linked"))
    least = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row")).alias("least"))
    named = named.join(least, "root").withColumn("stays", (F.col("row") == F.col("least.row")) & F.col("doc_id").eqNullSafe(F.col("least.doc_id")))
    marks = cut_lineage(named.groupBy(F.col("row").alias("mark"), F.col("doc_id").alias("id")).agg(F.max("stays").alias("stays"), F.count("*").alias("times")))
    out = _without(docs, marks.where("not stays or times > 1"))
    again = marks.where("stays and times > 1")
    if again.isEmpty():
        return out
    repeated = docs.join(again, _marked(docs, again), "left_semi")
    kept = repeated.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), _mark(repeated)).dropDuplicates(["row"])
    return out.unionByName(kept.select("doc.*"))


def _marked(docs: DataFrame, marks: DataFrame) -> Column:
    return (_mark(docs) == marks["mark"]) & docs["doc_id"].cast("long").eqNullSafe(marks["id"])


def _without(docs: DataFrame, marks: DataFrame) -> DataFrame:
    right = F.broadcast(marks) if marks.count() <= BROADCAST_ROWS else marks
    return docs.join(right, _marked(docs, marks), "left_anti")
