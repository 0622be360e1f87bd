"""N-gram Jaccard join against all pairs."""

import random
import re

import pytest
from forecourt.llm import ngram_join
from forecourt.llm.components import components
from forecourt.llm.ngram_join import near_duplicates, one_of_each

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    words = WORD.findall((text or "").translate(FOLD))
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_force(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in holders[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i), d)) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def run(spark, rows, extra=""):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in near_duplicates(df.repartition(5)).collect()), key=str)


def family(rng, size, words, edits):
    base = [f"w{rng.randrange(900)}" for _ in range(words)]
    out = []
    for _ in range(size):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def test_groups_of_near_copies(spark):
    rng = random.Random(5)
    texts = [t for size, words, edits in ((60, 120, 6), (40, 60, 5), (25, 9, 1), (30, 200, 14), (1, 50, 0)) for t in family(rng, size, words, edits)]
    line = "the same long line of words stands in very many of these texts here"
    texts += [line + "\n" + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 40))) for _ in range(120)]
    texts += [line] * 30 + [line.upper()] * 3
    rng.shuffle(texts)
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    assert run(spark, rows) == brute_force(rows)


def test_chain_of_links(spark):
    words = [f"c{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 3 : i * 3 + 60])) for i in range(60)]
    assert run(spark, rows) == brute_force(rows)


def test_copies_joined_instead_of_sent(spark, monkeypatch):
    rng = random.Random(8)
    texts = family(rng, 12, 60, 3) + family(rng, 1, 40, 0) * 8
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, None), (101, ""), (102, "x")]
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", -1)
    assert run(spark, rows) == brute_force(rows)


def test_odd_rows(spark):
    long = " ".join(f"v{i % 977}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "A b c"), (5, "a B\tc"), (6, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"),
            (None, "a b c"), (None, None), (8, long), (9, long + " end"), (10, "É é"), (11, "é É"), (12, "a b c d e f g"), (13, "x" * 3_000_000)]
    assert run(spark, rows) == brute_force(rows)


def test_empty_table_and_extra_columns(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(1, "a b c d e f", 5, 9, "k")], "doc_id long, text string, n int, uid int, component_id string")
    assert [tuple(r) for r in near_duplicates(df).collect()] == [(1, 2, 1)]


def test_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in near_duplicates(df).collect()), key=str) == brute_force(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    expected = {i: find(i) for e in edges for i in e if e[0] != e[1]}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == expected


def test_one_of_each(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    rows = [(5, base, "a"), (3, base + " more", "b"), (3, base + " more", "b"), (9, "alone in the world of texts", "c"), (None, base, "d"),
            (7, None, "e"), (8, None, "f"), (8, None, "f"), (11, "x y", "g"), (12, "X  y", "h"), (None, "n o", "i"), (None, "n o", "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `mark` string")
    got = sorted([tuple(r) for r in one_of_each(df).collect()], key=str)
    expected = [(3, base + " more", "b"), (9, "alone in the world of texts", "c"), (7, None, "e"), (8, None, "f"), (8, None, "f"), (11, "x y", "g"), (None, "n o", "i")]
    assert got == sorted(expected, key=str)
