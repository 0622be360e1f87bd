"""Quality rules as weak supervision: rules vote or abstain, and their agreement says how far each can be trusted.

Every rule gives a document one of three votes: good, bad, or nothing. No label is used. Documents with the same votes are one
pattern; with ``len(RULES)`` rules there are at most 3 to that power of them, so the table of patterns, counted over
the whole corpus, is bounded whatever its size. Expectation-maximisation over the counted patterns estimates the share of
good documents and each rule's accuracy on good and on bad ones; an abstention says nothing. A document is kept when its posterior probability of being good is at least one half, instead of when it passes every rule. The start (rules mostly right) names the classes;
each estimate leans on ``PRIOR`` imagined documents, so a rule without votes says nothing. A document that no rule
has a vote about is kept.

Facts are counted from the bytes of whole texts, in slices of bounded size (a longer text alone). Words are
``[^\\x20\\x09-\\x0D]+``; a null text has none. Repeated rows count as documents of their own, ties do not arise (one row a
document, equal votes give equal verdicts), an empty table gives no rows. Columns besides ``doc_id`` and ``text``
play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt.llm.common import arrow_schema, map_batches
from forecourt.llm.words import chain, hash_spans, row_of, slices, text_bytes, word_spans

FACTS = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_letters long, "
         "n_digits long, n_symbol_words long, n_lines long, n_ended_lines long, n_distinct_words long")
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
DIGITS = np.zeros(256, bool)
DIGITS[48:58] = True
LETTERS = np.zeros(256, bool)  # ASCII letters, and what begins a longer character
LETTERS[65:91] = LETTERS[97:123] = LETTERS[0xC2:0xF5] = True
ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".!?:;\"')"]] = True

PRIOR = 2.0
ROUNDS = 200
BEGIN = 0.8  # how often a voting rule is right at first


def _repeated(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which items have an equal one in the same row."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.lexsort((keys, rows))
    k, r = keys[order], rows[order]
    same = np.append(False, (k[1:] == k[:-1]) & (r[1:] == r[:-1]))
    out = np.empty(len(k), bool)
    out[order] = same | np.append(same[1:], False)
    return out


def _later(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which items have an equal one before them in the same row."""
    order = np.lexsort((np.arange(len(keys)), keys, rows))
    k, r = keys[order], rows[order]
    out = np.zeros(len(k), bool)
    out[order[1:]] = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    return out


def facts_of(column: pa.Array) -> dict[str, np.ndarray]:
    """What the rules ask about every text of a column."""
    data, offsets = text_bytes(column)
    rows = len(offsets) - 1
    owner = row_of(offsets)
    begins = (data & 0xC0) != 0x80

    def count(at: np.ndarray) -> np.ndarray:
        return np.bincount(owner[at], minlength=rows)

    starts, ends, first = word_spans(data, offsets)
    word_row = row_of(first)
    points, marks = (np.append(0, np.cumsum(x)) for x in (begins, SYMBOLS[data]))
    words = hash_spans(data, starts, ends)
    # Windows of three words within a row; every word of a window that occurs again counts, once.
    again = np.zeros(len(words), bool)
    if len(words) > 2:
        whole = np.flatnonzero(word_row[2:] == word_row[:-2])
        windows = chain(words[whole], words[whole + 1], words[whole + 2])
        hit = whole[_repeated(windows, word_row[whole])]
        for k in range(3):
            again[hit + k] = True
    # Lines: cut by newlines, and at the ends of texts.
    cuts = np.flatnonzero(data == 10)
    line_row = np.concatenate([np.arange(rows), owner[cuts]])
    line_start = np.concatenate([offsets[:-1], cuts + 1])
    order = np.lexsort((line_start, line_row))
    line_row, line_start = line_row[order], line_start[order]
    line_end = np.append(line_start[1:] - 1, 0)
    final = np.append(line_row[1:] != line_row[:-1], True) if rows else np.zeros(0, bool)
    line_end = line_end[: len(line_row)]
    line_end[final] = offsets[1:]
    first_word, last_word = np.searchsorted(starts, line_start), np.searchsorted(starts, line_end)
    full = last_word > first_word
    line_row, line_start, line_end, last_word = line_row[full], line_start[full], line_end[full], last_word[full]
    lines = hash_spans(data, line_start, line_end)
    return {
        "n_words": np.diff(first), "word_chars": np.bincount(word_row, points[ends] - points[starts], rows).astype(np.int64),
        "n_symbols": count(SYMBOLS[data]), "n_dup_lines": np.bincount(line_row[_later(lines, line_row)], minlength=rows),
        "n_repeat_words": np.bincount(word_row[again], minlength=rows), "n_letters": count(LETTERS[data]),
        "n_digits": count(DIGITS[data]), "n_symbol_words": np.bincount(word_row[marks[ends] > marks[starts]], minlength=rows), "n_lines": np.bincount(line_row, minlength=rows),
        "n_ended_lines": np.bincount(line_row[ENDS[data[ends[last_word - 1] - 1]]], minlength=rows),
        "n_distinct_words": np.bincount(word_row[~_later(words, word_row)], minlength=rows),
    }


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        found = facts_of(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(v.astype(np.int64)) for v in found.values()]], schema=arrow_schema(FACTS))


def facts(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, _facts, FACTS)


@dataclass(frozen=True)
class Rule:
    """Good from where ``good`` holds, bad where ``bad`` does, else no vote."""

    name: str
    good: Column
    bad: Column


def rules() -> list[Rule]:
    """Each rule is sure at both ends and says nothing between; on short texts most have nothing to go by."""
    words, solid, lines = F.col("n_words"), F.col("word_chars"), F.col("n_lines")
    enough, rows = words >= 20, lines >= 4

    def share(part: str, whole: Column, least: int, most: int) -> Column:
        """Whether a part is between two hundredths of the whole."""
        return (100 * F.col(part) >= least * whole) & (100 * F.col(part) <= most * whole)

    return [
        Rule("length", words >= 50, words < 20),
        Rule("word_length", enough & share("word_chars", words, 300, 1000), enough & ~share("word_chars", words, 200, 1500)),
        Rule("symbols", enough & share("n_symbols", words, 0, 2), ~share("n_symbols", words, 0, 10)),
        Rule("symbol_words", enough & share("n_symbol_words", words, 0, 2), ~share("n_symbol_words", words, 0, 20)),
        Rule("letters", enough & share("n_letters", solid, 85, 100), ~share("n_letters", solid, 70, 100)),
        Rule("digits", enough & share("n_digits", solid, 0, 5), ~share("n_digits", solid, 0, 20)),
        Rule("dup_lines", rows & share("n_dup_lines", lines, 0, 5), rows & ~share("n_dup_lines", lines, 0, 30)),
        Rule("repeats", enough & share("n_repeat_words", words, 0, 10), enough & ~share("n_repeat_words", words, 0, 40)),
        Rule("distinct_words", enough & share("n_distinct_words", words, 30, 100) & (words < 1000), enough & ~share("n_distinct_words", words, 15, 100) & (words < 1000)),
        Rule("endings", rows & share("n_ended_lines", lines, 70, 100), rows & ~share("n_ended_lines", lines, 10, 100)),
    ]


def base_failed() -> Column:
    """The all-or-nothing floor below which no vote is asked for."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def pattern(given: list[Rule]) -> Column:
    """The votes as one number in base three: 0 none, 1 good, 2 bad."""
    votes = [F.when(r.bad, 2).when(r.good, 1).otherwise(0) for r in given]
    return reduce(lambda number, vote: number * 3 + vote, votes, F.lit(0).cast("int"))


@dataclass(frozen=True)
class Model:
    """Share of good documents, and log odds of good for every vote of every rule."""

    share: float
    odds: np.ndarray  # rule, vote
    accuracy: np.ndarray  # rule, class: share of right votes among those given

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        votes = _votes(patterns, len(self.odds))
        total = np.log(self.share / (1 - self.share)) + self.odds[np.arange(len(self.odds)), votes].sum(axis=1)
        out = 1 / (1 + np.exp(-np.clip(total, -500, 500)))
        return np.where((votes == 0).all(axis=1), 1.0, out)


def _votes(patterns: np.ndarray, n: int) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(n - 1, -1, -1) % 3


def estimate(patterns: np.ndarray, counts: np.ndarray, n: int) -> Model:
    """Expectation-maximisation over counted patterns: share of good documents, and by class how often a vote given is good."""
    votes = _votes(patterns, n)
    good, bad = votes == 1, votes == 2
    says_good = np.stack([np.full(n, BEGIN), np.full(n, 1 - BEGIN)])  # class, rule
    share, before = 0.5, np.inf
    for _ in range(ROUNDS):
        log = good @ np.log(says_good).T + bad @ np.log(1 - says_good).T + np.log([share, 1 - share])
        top = log.max(axis=1, keepdims=True)
        weight = np.exp(log - top)
        total = weight.sum(axis=1, keepdims=True)
        weight *= counts[:, None] / total
        likelihood = float((counts * (np.log(total) + top)[:, 0]).sum())
        yes, no = weight.T @ good, weight.T @ bad
        mass = weight.sum(axis=0)
        begin = PRIOR * np.array([[BEGIN], [1 - BEGIN]])
        says_good = (yes + begin) / (yes + no + PRIOR)
        share = float((mass[0] + 1) / (mass.sum() + 2))
        if abs(likelihood - before) <= 1e-9 * max(1.0, abs(likelihood)):
            break
        before = likelihood
    odds = np.stack([np.zeros(n), np.log(says_good[0] / says_good[1]), np.log((1 - says_good[0]) / (1 - says_good[1]))], axis=1)
    return Model(share, odds, np.stack([says_good[0], 1 - says_good[1]], axis=1))


def fit(described: DataFrame, given: list[Rule] | None = None) -> Model:
    """The model of a corpus, from ``facts`` of all its documents."""
    given = given or rules()
    found = described.groupBy(pattern(given).alias("pattern")).count().toArrow()  # at most 3 to the power of the rules
    order = np.argsort(found["pattern"].to_numpy())
    return estimate(found["pattern"].to_numpy()[order].astype(np.int64), found["count"].to_numpy()[order].astype(float), len(given))


def judged(described: DataFrame, model: Model, given: list[Rule] | None = None) -> DataFrame:
    """``described`` with base_failed, posterior and kept. The log odds are added up by Spark expressions."""
    given = given or rules()
    total, silent = F.lit(float(np.log(model.share / (1 - model.share)))), F.lit(True)
    for rule, odds in zip(given, model.odds, strict=True):
        total = total + F.when(rule.bad, float(odds[2])).when(rule.good, float(odds[1])).otherwise(float(odds[0]))
        silent = silent & ~F.coalesce(rule.bad | rule.good, F.lit(False))
    posterior = F.when(silent, 1.0).otherwise(1 / (1 + F.exp(-total)))
    rows = described.withColumn("base_failed", base_failed()).withColumn("posterior", posterior)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


def filtered(docs: DataFrame) -> DataFrame:
    """Facts, floor, posterior and verdict of every document; the texts are read once for the model and once for the verdicts."""
    described = facts(docs)
    return judged(described, fit(described))
