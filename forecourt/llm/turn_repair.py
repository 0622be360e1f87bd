"""Repair of conversations: the cheapest edits that make the roles alternate.

A conversation is right when the initials of its rows' roles read ``(s?(ua)+)?``. Rows are kept (K, 0), given the role
user or assistant (R, 3), deleted (D, 4; a must for blank and repeated rows), and empty rows are inserted (I, 3); a
truncated row that stays adds 3. Every way through this is a path of a graph over (rows used, state of the pattern), and a
path's weight is one whole number: its cost in the high digits, below it the letters of its edits in a fixed number of
places, three bits each, the first letter highest, with zeros after the last one. A letter put before a path moves
the others one place down. So the least number is the least cost and, of that, the ASCII-least edits, and plain ``min``
decides everything. Conversations longer than ``BLOCK`` rows are passed block by block: a block's best ways
from state to state are weights of their own, moved behind each other in the same way.

Spark gathers nothing of the texts: rows travel as a key, flags and a count of equal rows, sorted by conversation, and a task
keeps one letter a row of the conversation it is reading (the audit holds as many). Then each conversation's edits
travel ahead of its rows, and a task passes over the rows in order, one batch at a time.

Nulls stand for one space where a text is needed; a null turn comes before all others, a null ``conv_id`` is a
conversation of its own. Rows of one turn are ordered by role, then text (its first 64 code points, then its digest);
equal rows are duplicates of each other. Very long texts pass as they are. An empty table gives no rows; a conversation
whose rows are all lost has no edits. Columns besides ``conv_id, turn, role, text`` play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt.llm.common import map_batches

BLOCK = 128
SENT = 4 << 20  # bytes of repaired text that are handed on at once

WHITE = r"[\x20\x09-\x0D]"
SOLID = r"[^\x20\x09-\x0D]"

# The pattern's states: nothing yet, after s, after u, after a. What each initial leads to:
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEXT = (2, 2, 3, 2)  # the only state that an inserted or renamed row can lead to
ACCEPT = (0, 3)
COSTS = {"D": 4, "I": 3, "K": 0, "R": 3}
DIGITS = {"D": 1, "I": 2, "K": 3, "R": 4}  # in the order of ASCII; zero is the padding
TRUNCATED = 3
MUST_GO = "x"


class Weights:
    """Arithmetic of path weights with room for ``places`` letters."""

    def __init__(self, places: int) -> None:
        self.bits = 3 * places
        self.low = (1 << self.bits) - 1
        self.never = 1 << (self.bits + 64)

    def before(self, letter: str, extra: int, weight: int) -> int:
        """The path with one more edit in front."""
        if weight >= self.never:
            return self.never
        cost = (weight >> self.bits) + COSTS[letter] + extra
        return (cost << self.bits) | (DIGITS[letter] << (self.bits - 3)) | ((weight & self.low) >> 3)

    def chain(self, cost: int, letters: int, n: int, weight: int) -> int:
        """The path behind a piece of ``n`` letters."""
        if weight >= self.never:
            return self.never
        return ((cost + (weight >> self.bits)) << self.bits) | (letters << (self.bits - 3 * n)) | ((weight & self.low) >> (3 * n))

    def read(self, weight: int) -> tuple[int, str]:
        """Cost and letters of a path."""
        text = "".join(" DIKR"[(int(c, 8))] for c in f"{weight & self.low:0{self.bits // 3}o}") if self.bits else ""
        return weight >> self.bits, text.rstrip()

    def inserted(self, after: list[int]) -> list[int]:
        """Least weights when rows may be inserted first. A third one would only lead back."""
        once = [self.before("I", 0, after[NEXT[q]]) for q in range(4)]
        twice = [self.before("I", 0, once[NEXT[q]]) for q in range(4)]
        return [min(w) for w in zip(after, once, twice, strict=True)]

    def row(self, code: str, after: list[int]) -> list[int]:
        """Least weights from the place before a row, given those behind it."""
        if code == MUST_GO:
            return self.inserted([self.before("D", 0, w) for w in after])
        extra = TRUNCATED if code.isupper() else 0
        out = []
        for q in range(4):
            ways = [self.before("D", 0, after[q]), self.before("R", extra, after[NEXT[q]])]
            if (kept := STEPS[q].get(code.lower())) is not None:
                ways.append(self.before("K", extra, after[kept]))
            out.append(min(ways))
        return self.inserted(out)


@lru_cache(50_000)
def _short(codes: str) -> tuple[int, str]:
    w = Weights(3 * len(codes) + 2)
    after = w.inserted([0 if q in ACCEPT else w.never for q in range(4)])
    for code in reversed(codes):
        after = w.row(code, after)
    return w.read(after[0])


@lru_cache(2_000)
def _block(codes: str) -> list[list[tuple[int, int, int] | None]]:
    """Cost, letters and their number of the best way from each state to each state; inserted rows stand before a row."""
    w = Weights(3 * len(codes))
    out: list[list[tuple[int, int, int] | None]] = [[None] * 4 for _ in range(4)]
    for end in range(4):
        after = [0 if q == end else w.never for q in range(4)]
        for code in reversed(codes):
            after = w.row(code, after)
        for start, weight in enumerate(after):
            if weight < w.never:
                cost, text = w.read(weight)
                out[start][end] = (cost, (weight & w.low) >> (w.bits - 3 * len(text)), len(text))
    return out


def decide(codes: str) -> tuple[int, str]:
    """Cost and letters of the best edits. A code a row: the role's initial (o: another one), large where truncated; x: must go."""
    if len(codes) <= BLOCK:
        return _short(codes)
    w = Weights(3 * len(codes) + 2)
    after = w.inserted([0 if q in ACCEPT else w.never for q in range(4)])
    for i in reversed(range(0, len(codes), BLOCK)):
        ways = _block(codes[i : i + BLOCK])
        after = [min([w.chain(*way, after[end]) for end, way in enumerate(ways[start]) if way] or [w.never]) for start in range(4)]
    return w.read(after[0])


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): the rows as damage leaves them, ``n`` times each; dropped ones have no text and n = 0."""
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    kind = F.crc32(F.concat(conv, F.lit(":"), turn)) % 20
    lost = kind == 0
    return rows.select(
        "conv_id", F.when(~lost, F.col("turn")).cast("long").alias("turn"),
        F.when(lost, "").when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(lost | (kind == 1), "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(lost, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def _order() -> list[Column]:
    return [F.substring("text", 1, 64).alias("lead"), F.md5("text").alias("digest")]


def marked(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, lead, digest, n, blank, truncated, first): distinct rows without their texts, and how many of each.

    ``first``: no row with the same role and text comes earlier."""
    blank = ~F.col("text").rlike(SOLID)
    narrow = rows.select(
        "conv_id", "turn", "role", *_order(), "n", blank.alias("blank"),
        (~blank & ~F.col("text").rlike(rf"[.!?]{WHITE}*\z")).alias("truncated"),
    ).groupBy("conv_id", "turn", "role", "lead", "digest", "blank", "truncated").agg(F.sum("n").alias("n"))
    earliest = narrow.where("n > 0").groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("at"))
    earliest = earliest.select(*[F.col(c).alias(f"e_{c}") for c in ("conv_id", "role", "digest")], F.col("at.turn").alias("e_turn"))
    same = [F.col(c).eqNullSafe(F.col(f"e_{c}")) for c in ("conv_id", "role", "digest", "turn")]
    joined = narrow.join(earliest, same[0] & same[1] & same[2] & same[3], "left")
    return joined.select(*narrow.columns, F.col("e_digest").isNotNull().alias("first"))


DECIDED = "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _legal(before: str, after: str) -> bool:
    return before + after in ("su", "ua", "au")


class _Conversation:
    """What is kept of the conversation that a task is reading."""

    def __init__(self, key: object) -> None:
        self.key = key
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.least = self.most = self.initial = None
        self.codes: list[str] = []

    def add(self, turn: int | None, role: str, n: int, blank: bool, truncated: bool, first: bool) -> None:
        if turn is not None and n:
            self.turns += turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn
        initial = role[:1]
        if n and self.initial is not None:
            self.illegal += not _legal(self.initial, initial)
        if n:
            self.illegal += (n - 1) * (not _legal(initial, initial))
            self.initial = initial
        if blank:
            self.blank += n
            self.codes.append(MUST_GO * n)
        elif n:
            self.duplicate += n - first
            self.truncated += truncated and first
            code = initial if initial in ("s", "u", "a") else "o"
            self.codes.append((code.upper() if truncated else code) * first + MUST_GO * (n - first))

    def row(self) -> tuple:
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.turns
        cost, audit = decide("".join(self.codes))
        return self.key, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def _decisions(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, done = None, []
        for batch in batches:
            for key, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if current is None or key != current.key:
                    done += [current.row()] if current else []
                    current = _Conversation(key)
                current.add(*row)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
                done = []
        if current:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(current.row(), schema, strict=True)], schema=schema)

    return run


def _id_type(df: DataFrame) -> tuple[str, pa.DataType]:
    return ("string", pa.string()) if df.schema["conv_id"].dataType.simpleString() == "string" else ("long", pa.int64())


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("conv_id", F.col("conv_id").cast(_id_type(rows)[0]))


def decisions(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation; ``rows`` as ``damaged`` gives them."""
    kind, arrow = _id_type(rows)
    ordered = marked(_keyed(rows)).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "lead", "digest")
    schema = pa.schema([("conv_id", arrow), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())])
    return map_batches(ordered.select("conv_id", "turn", "role", "n", "blank", "truncated", "first"), _decisions(schema), DECIDED.format(id=kind))


class _Repair:
    """Passes over a conversation's rows with its edits in hand."""

    def __init__(self, key: object, audit: str) -> None:
        self.key, self.audit, self.at, self.state, self.place = key, audit, 0, 0, 0

    def _made(self, role: str | None, text: str, edit: str) -> tuple:
        """A row of the result; no role: the one that the pattern asks for."""
        initial = {2: "u", 3: "a"}[NEXT[self.state]] if role is None else role[:1]
        role = {"u": "user", "a": "assistant"}[initial] if role is None else role
        self.state = STEPS[self.state][initial]
        self.place += 1
        return self.key, self.place, role, text, edit

    def inserts(self) -> Iterator[tuple]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._made(None, "", "I")

    def row(self, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self._made(role if edit == "K" else None, text, edit)


def _repaired_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple] | None]]:
    """(conversation, rows) piece by piece in order; (conversation, None) where it ends."""
    current = None
    for batch in batches:
        for key, audit, role, text, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if audit is not None:
                if current:
                    yield current.key, list(current.inserts())
                    yield current.key, None
                current = _Repair(key, audit)
                continue
            for _ in range(n):
                yield key, list(current.row(role, text))
    if current:
        yield current.key, list(current.inserts())
        yield current.key, None


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _row_writer(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, rows in _repaired_rows(batches):
            held += rows or []
            size += sum(len(r[3]) + 64 for r in rows or [])
            if size > SENT:
                yield _batch(held, schema)
                held, size = [], 0
        if held:
            yield _batch(held, schema)

    return run


def _digest_writer(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, begun, done = hashlib.sha256(), False, []
        for key, rows in _repaired_rows(batches):
            if rows is None:
                done.append((key, digest.hexdigest()))
                digest, begun = hashlib.sha256(), False
            for _, _, role, text, _ in rows or []:
                digest.update(f"{chr(10) if begun else ''}{role}:{text}".encode())
                begun = True
            if len(done) >= 10_000:
                yield _batch(done, schema)
                done = []
        if done:
            yield _batch(done, schema)

    return run


def _ahead(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """Each conversation's edits, then its rows in order, in one task."""
    heads = decided.select("conv_id", "audit")
    none = {c: F.lit(None) for c in ("turn", "role", "text", "n")}
    both = heads.withColumns(none).unionByName(_keyed(rows).where("n > 0").withColumn("audit", F.lit(None).cast("string")))
    lead, digest = _order()
    placed = both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), "turn", "role", lead, digest)
    return placed.select("conv_id", "audit", "role", "text", "n")


def repaired(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, edit): the rows of the repaired conversations; place from 1, edit K, R or I."""
    kind, arrow = _id_type(rows)
    schema = pa.schema([("conv_id", arrow), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
    return map_batches(_ahead(rows, decided), _row_writer(schema), f"conv_id {kind}, place long, role string, text string, edit string")


def digests(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of every conversation: its repaired rows as ``role:text``, joined by newlines."""
    kind, arrow = _id_type(rows)
    schema = pa.schema([("conv_id", arrow), ("repaired_sha256", pa.string())])
    return map_batches(_ahead(rows, decided), _digest_writer(schema), f"conv_id {kind}, repaired_sha256 string")
