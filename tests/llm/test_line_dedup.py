"""Line dedup against a plain loop."""

import random

import pytest
from forecourt.llm.line_dedup import dedup_lines
from helpers import FOLD, WHITE, rows_of


def key(line):
    return line.strip(WHITE).translate(FOLD)


def brute_force(rows, least=10):
    order = lambda d: (d is None, d or 0)
    first = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            k = key(line)
            if len(k) >= least:
                first[k] = min(first.get(k, order(d)), order(d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or first[key(x)] == order(d)]
        out.append((d, None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return rows_of(dedup_lines(df).select("doc.doc_id", "kept.text", "kept.n_lines", "kept.n_dropped"))


@pytest.mark.parametrize("seed", [1, 2])
def test_random_lines(spark, seed):
    rng = random.Random(seed)
    pool = [f"line number {i} of the pool" for i in range(60)] + ["short", "", "  ", "exactly10!", "exactly 9"]
    hot = "This line stands in nearly every document"
    rows = []
    for i in rng.sample(range(5000), 400):
        lines = [rng.choice(pool) for _ in range(rng.randrange(12))]
        lines += [hot, "  " + hot.upper() + "\t"] if rng.random() < 0.6 else []
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    assert run(spark, rows) == brute_force(rows)


def test_odd_rows(spark):
    long = "\n".join(f"a long line with the number {i % 700}" for i in range(20_000))
    rows = [(1, None), (2, ""), (None, "a line that null has too"), (3, "a line that null has too\n\nx"), (None, "only null rows have this"), (None, "only null rows have this"),
            (4, "the same row twice here"), (4, "the same row twice here"), (5, "the same row twice here\r\nÄ line of ten\n"), (6, "ä line of ten\n\n"), (7, long), (8, long + "\nend of it")]
    assert run(spark, rows) == brute_force(rows)


def test_empty_table_and_clashing_names(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(1, "a line of some length", 7, "k"), (2, "A line of some length", 8, "m")], "doc_id long, text string, row int, keep string")
    got = rows_of(dedup_lines(df).select("doc.doc_id", "doc.row", "doc.keep", "kept.text"))
    assert got == [(1, 7, "k", "a line of some length"), (2, 8, "m", "")]
