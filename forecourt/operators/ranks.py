"""Exact order statistics without sorting the table or gathering it in one task."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY = 10_000
MAX_SORTED = 1_000


@dataclass
class _Search:
    """The value at one rank of one column, known to lie between ``low`` and ``high``."""

    column: str
    rank: int
    inside: int
    low: Any
    high: Any
    below: int = 0
    found: Any = None
    stuck: bool = False

    def value(self) -> Column:
        return F.when(F.col(self.column).between(self.low, self.high), F.col(self.column))

    def middle(self) -> Any:
        half = (self.low + self.high) / 2 if isinstance(self.low, float) else type(self.low)((self.low + self.high) // 2)
        return half if half < self.high else self.low


def _one_row(df: DataFrame, columns: list[Column]) -> list:
    return list(df.agg(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()) if columns else []


def select_ranks(
    df: DataFrame, ranks: dict[str, list[int]], max_sorted: int = MAX_SORTED, accuracy: int = ACCURACY
) -> dict[str, list]:
    """Values at the given 0-based ranks of the non-null values of numeric columns, ascending.

    All ranks of all columns are found in the same passes, each a partially aggregated scan that returns one row. A
    quantile sketch brackets the wanted rank and a counting pass places the bracket exactly, again and again inside
    the bracket; where a sketch does not narrow it, the middle of its values does. The last ``max_sorted`` values
    are sorted.
    """
    names = list(ranks)
    head = _one_row(df, [f(F.col(c)) for c in names for f in (F.count, F.min, F.max)])
    searches = [
        _Search(c, rank, *head[3 * i : 3 * i + 3]) for i, c in enumerate(names) for rank in ranks[c]
    ]
    while True:
        for s in searches:
            s.found = s.low if s.low == s.high else s.found
        left = [s for s in searches if s.found is None and s.low is not None]
        if not left:
            return {c: [s.found for s in searches if s.column == c] for c in names}
        few = [s for s in left if s.inside <= max_sorted]
        for s, values in zip(few, _one_row(df, [F.sort_array(F.collect_list(s.value())) for s in few])):
            s.found = values[s.rank - s.below]
        many = [s for s in left if s.inside > max_sorted]
        _by_sketch(df, [s for s in many if not s.stuck], accuracy)
        _by_middle(df, [s for s in many if s.stuck])


def _by_sketch(df: DataFrame, searches: list[_Search], accuracy: int) -> None:
    margin = 2.0 / accuracy
    around = lambda s: (s.rank - s.below + 0.5) / s.inside
    cuts = _one_row(df, [
        F.percentile_approx(s.value(), [max(0.0, around(s) - margin), min(1.0, around(s) + margin)], accuracy) for s in searches
    ])
    counts = _one_row(df, [
        f for s, (a, b) in zip(searches, cuts) for f in (F.count_if(s.value() < a), F.count_if(s.value().between(a, b)))
    ])
    for i, (s, (low, high)) in enumerate(zip(searches, cuts)):
        lower, within = counts[2 * i : 2 * i + 2]
        if s.below + lower <= s.rank < s.below + lower + within and within < s.inside:
            s.below, s.inside, s.low, s.high = s.below + lower, within, low, high
        else:
            s.stuck = True


def _by_middle(df: DataFrame, searches: list[_Search]) -> None:
    halves = [s.middle() for s in searches]
    counts = _one_row(df, [
        f for s, half in zip(searches, halves)
        for f in (F.count_if(s.value() <= half), F.max(F.when(s.value() <= half, s.value())), F.min(F.when(s.value() > half, s.value())))
    ])
    for i, s in enumerate(searches):
        lower, highest, lowest = counts[3 * i : 3 * i + 3]
        if s.rank < s.below + lower:
            s.inside, s.high = lower, highest
        else:
            s.below, s.inside, s.low = s.below + lower, s.inside - lower, lowest
        s.stuck = False


def exact_medians(df: DataFrame, columns: list[str], max_sorted: int = MAX_SORTED) -> dict[str, float | None]:
    """Median of each column, the mean of the two middle values for an even count; None without values."""
    counts = dict(zip(columns, _one_row(df, [F.count(c) for c in columns])))
    middles = {c: sorted({(n - 1) // 2, n // 2}) for c, n in counts.items() if n}
    found = select_ranks(df, middles, max_sorted) if middles else {}
    return {c: (float(found[c][0]) + float(found[c][-1])) / 2 if c in found else None for c in columns}


def exact_median(df: DataFrame, column: str, max_sorted: int = MAX_SORTED) -> float | None:
    return exact_medians(df, [column], max_sorted)[column]
