"""Benchmark decontamination against all windows of all documents."""

import math
import random

import pytest

from forecourt.llm import decontaminate
from forecourt.llm.decontaminate import clean, contaminated, find
from helpers import WHITE, rows_of


def plain(text):
    return [w for w in "".join(" " if c in WHITE else c for c in (text or "").lower()).split(" ") if w]


def shingles(words, width=5):
    span = min(width, len(words))
    return {tuple(words[i : i + span]) for i in range(len(words) - span + 1)} if words else set()


def brute_force(docs, items, least=0.75, width=5):
    sets = {i: (len(plain(t)), shingles(plain(t))) for i, t in items if plain(t)}
    holders = {}
    for m, s in sets.values():
        for x in s:
            holders[x] = holders.get(x, 0) + 1
    weight = {x: math.log1p(len(sets) / n) for x, n in holders.items()}
    out = set()
    for d, t in docs:
        words = plain(t)
        whole = {tuple(words[a : a + k]) for k in {min(width, m) for m, _ in sets.values()} for a in range(len(words) - k + 1)}
        for i, (m, s) in sets.items():
            if sum(weight[x] for x in s & whole) < least * sum(weight[x] for x in s) - 1e-9:
                continue  # no window holds more than the whole text
            for a in range(max(1, len(words) - m + 1)):
                own = {tuple(words[a + k : a + k + min(width, m)]) for k in range(len(words[a : a + m]) - min(width, m) + 1)}
                if sum(weight[x] for x in s & own) >= least * sum(weight[x] for x in s) - 1e-9:
                    out.add((d, i))
                    break
    return sorted(out, key=str)


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")


def data(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(2000)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([14, 20, 37, 50])))) for i in range(25)]
    docs = []
    for i in range(150):
        body = [word() for _ in range(rng.randrange(5, 300))]
        if i % 3 == 0:
            passage = plain(rng.choice(items)[1])
            if i % 2:
                passage = [w.upper() for w in passage]
            if i % 4 == 0 and len(passage) > 30:
                passage[rng.randrange(len(passage))] = "changed"
            if i % 9 == 0:
                passage = passage[: len(passage) // 2]
            at = rng.randrange(len(body))
            body[at:at] = passage
        docs.append((i, " ".join(body).replace(" w1", "\n w1")))
    return docs, items


def test_planted_passages(spark):
    for seed in (1, 2):
        docs, items = data(seed)
        d, b = frames(spark, docs, items)
        got = contaminated(d, b)
        assert rows_of(got, "doc_id", "item_id") == brute_force(docs, items)
        assert all(r["similarity"] <= 1 + 1e-9 for r in got.collect())
        kept = {r["doc_id"] for r in clean(d, b).collect()}
        assert kept == {i for i, _ in docs} - {r["doc_id"] for r in got.collect()}


def damaged(rng, passage, kind):
    m = len(passage)
    if kind == "cut":
        size = math.ceil(m * rng.uniform(0.76, 0.99))
        at = rng.choice([0, m - size, rng.randrange(m - size + 1)])
        return passage[at : at + size]
    if kind == "turned":
        at = rng.randrange(8, m - 8)
        return passage[at:] + passage[:at]
    if kind == "moved":
        a, b = sorted(rng.sample(range(6, m - 6), 2))
        return passage[a:b] + passage[:a] + passage[b:]
    out = list(passage)
    for k in rng.sample(range(m), rng.choice([1, 2])):
        out[k] = f"y{rng.randrange(5000)}"
    return out


@pytest.mark.parametrize("kind", ["cut", "turned", "moved", "changed"])
def test_recall_of_the_fingerprints(spark, kind):
    """Candidates come from the fingerprints alone; nearly all that verifies must be among them."""
    rng = random.Random(12)
    items = [(i, " ".join(f"w{rng.randrange(2000)}" for _ in range(rng.choice([20, 30, 40, 60, 100])))) for i in range(40)]
    docs = []
    for i in range(200):
        passage = damaged(rng, plain(items[i % 40][1]), kind)
        fill = [f"x{rng.randrange(5000)}" for _ in range(300)]
        docs.append((i, " ".join(fill[:100] + passage + fill[100 : rng.choice([100, 300])])))
    want = brute_force(docs, items)
    d, b = frames(spark, docs, items)
    assert rows_of(find(d, b, fingerprints=False), "doc_id", "item_id") == want
    got = rows_of(contaminated(d, b), "doc_id", "item_id")
    print(kind, len(want), len(got))
    assert set(got) <= set(want) and len(want) > 60 and len(got) >= 0.97 * len(want)


def test_without_a_near_fingerprint_nothing_is_found(spark, monkeypatch):
    docs, items = data(1)
    monkeypatch.setattr(decontaminate, "RADIUS", -1)
    assert contaminated(*frames(spark, docs, items)).collect() == []


def test_odd_rows(spark):
    items = [(1, None), (2, ""), (3, "two words"), (4, "one two three four five six"), (4, "one two three four five six"), (None, "null item has six words here"), (5, "\x0b x \x0c")]
    docs = [(1, None), (2, ""), (3, "say TWO  words now"), (4, "zero one two three four five six"), (None, "so null item has six words here ok"), (5, "one two three"), (6, "x"), (6, "x"),
            (7, "y " * 200_000 + "one two three four five six")]
    d, b = frames(spark, docs, items)
    got = contaminated(d, b)
    assert rows_of(got, "doc_id", "item_id") == brute_force(docs, items)
    assert {r["doc_id"] for r in clean(d, b).collect()} == {1, 2, 5}
    wide = d.selectExpr("doc_id", "text", "1 as row", "2 as words", "3 as id", "4 as m")
    assert clean(wide, b).columns == wide.columns and clean(wide, b).count() == 3
    assert contaminated(d.limit(0), b).collect() == [] and contaminated(d, b.limit(0)).collect() == []
    assert clean(d, b.limit(0)).count() == len(docs)


def test_large_benchmarks_join_without_broadcast(spark, monkeypatch):
    docs, items = data(5)
    d, b = frames(spark, docs, items)
    want = rows_of(contaminated(d, b))
    kept = rows_of(clean(d, b))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(decontaminate, "LISTED_ROWS", -1)
    assert rows_of(contaminated(d, b)) == want and rows_of(clean(d, b)) == kept


def test_every_fingerprint_within_the_radius_meets(spark):
    rng = random.Random(9)
    pairs = []
    for k in range(60):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), decontaminate.RADIUS if k % 2 else rng.randrange(decontaminate.RADIUS)):
            b ^= 1 << bit
        pairs.append((k, a - 2**63, b - 2**63))
    df = spark.createDataFrame(pairs, "k long, a long, b long")
    left = df.select("k", decontaminate.F.explode(decontaminate._blocks("a")).alias("x"))
    right = df.select("k", decontaminate.F.explode(decontaminate._blocks("b")).alias("y"))
    near = left.join(right, "k").where("x.block = y.block and bit_count(x.value ^ y.value) <= 2").select("k").distinct()
    assert near.count() == len(pairs)


def test_plan_is_native(spark):
    docs, items = data(6)
    plan = contaminated(*frames(spark, docs, items))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
