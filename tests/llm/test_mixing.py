"""Mixing against a sort of all tickets."""

import random

import pytest
from forecourt.llm import mixing
from forecourt.llm.mixing import mix, ticket
from helpers import rows_of
from helpers import words as plain_words
from pyspark.sql import functions as F


def fill(sizes, weights=(5, 2, 1), ceiling=3):
    """Shares by weight; what is over the ceiling goes to the others again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > ceiling * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = float(ceiling * sizes[s])
        open_ -= set(over)
        left = sum(sizes.values()) - sum(target.values())
    return target


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    tickets = {r[0]: r[1] for r in df.select("doc_id", ticket(F.col("doc_id"))).collect()}
    got = rows_of(mix(df), "doc_id", "source", "size", "source_size", "target", "copies", "taken")
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(plain_words(t))
    target = fill(sizes)
    assert len(got) == len(rows)
    for d, s, size, source_size, goal, copies, taken in got:
        assert (source_size, taken) == (sizes[s], copies * size) and goal == pytest.approx(target[s]) and 0 <= copies <= 3
    for s in sizes:
        own = [g for g in got if g[1] == s]
        times = int(target[s] // sizes[s]) if sizes[s] else 0
        rest, until = target[s] - times * sizes[s], 0
        for value in sorted({tickets[g[0]] for g in own}):
            same = [g for g in own if tickets[g[0]] == value]
            held = sum(g[2] for g in same)
            until += held
            assert {g[5] - times for g in same if g[2]} <= {int(until - held / 2 <= rest + 1e-6)}
        largest = max([sum(g[2] for g in own if tickets[g[0]] == t) for t in {tickets[g[0]] for g in own}])
        assert abs(sum(g[6] for g in own) - target[s]) <= largest / 2 + 1e-6


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_sources(spark, seed):
    rng = random.Random(seed)
    rows = [(i, "w " * rng.randrange(40), rng.choice(["a", "b", "c", "d", "é", None] + ["hot"] * 6)) for i in range(500)]
    check(spark, rows)


def test_ceiling_is_reshared(spark):
    check(spark, [(i, "w " * 10, "z" if i < 300 else "a" if i < 303 else "b") for i in range(310)])


def test_odd_rows(spark):
    check(spark, [(1, None, "a"), (2, "", "a"), (3, "x", "a"), (3, "x", "a"), (None, "y z", "b"), (None, "y", "b"), (5, "w " * 100_000, None), (6, "q", None)])
    check(spark, [(1, None, "a"), (2, "", None)])
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


def test_names_reruns_and_many_sources(spark, monkeypatch):
    df = spark.createDataFrame([(i, "w " * (i % 9), f"s{i % 4}", i, i) for i in range(200)], "doc_id long, text string, source string, size long, target long")
    first = rows_of(mix(df))
    assert first == rows_of(mix(df.repartition(7)))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert first == rows_of(mix(df))
