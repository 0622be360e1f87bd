"""Repairs against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from forecourt.llm import turn_repair
from forecourt.llm.turn_repair import damaged, decide, decisions, digests, repaired
from helpers import WHITE, rows_of

STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NAMES = {"u": "user", "a": "assistant"}


def search(items):
    """Cost, letters and rows of the best edits of (role, text, fault): paths in order of (cost, letters)."""
    paths, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, letters, i, q, out = heapq.heappop(paths)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == len(items) and q in (0, 3):
            return cost, letters, out
        for r in "ua":
            if r in STEPS[q]:
                heapq.heappush(paths, (cost + 3, letters + "I", i, STEPS[q][r], (*out, (NAMES[r], ""))))
        if i < len(items):
            role, text, fault = items[i]
            heapq.heappush(paths, (cost + 4, letters + "D", i + 1, q, out))
            if fault in ("", "truncated"):
                more = 3 * (fault == "truncated")
                if role[:1] in STEPS[q]:
                    heapq.heappush(paths, (cost + more, letters + "K", i + 1, STEPS[q][role[:1]], (*out, (role, text))))
                for r in "ua":
                    if r in STEPS[q]:
                        heapq.heappush(paths, (cost + more + 3, letters + "R", i + 1, STEPS[q][r], (*out, (NAMES[r], text))))


def expected(rows):
    out = []
    for conv in {r[0] for r in rows}:
        left = []
        for turn, role, text in sorted([r[1:] for r in rows if r[0] == conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1] or " ", r[2] or " ")):
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            left += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        items, seen = [], set()
        for _, role, text in left:
            bare = text.strip(WHITE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            items.append((role, text, fault))
        turns = {t for t, _, _ in left if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(left, left[1:], strict=False))
        cost, letters, final = search(items)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in final).encode()).hexdigest()
        out.append((conv, gaps, *(sum(f == k for *_, f in items) for k in ("blank", "duplicate", "truncated")), illegal, cost, letters, digest))
    return sorted(out, key=str)


def summary(df):
    rows = damaged(df)
    decided = decisions(rows)
    both = decided.join(digests(rows, decided).withColumnRenamed("conv_id", "key"), decided["conv_id"].eqNullSafe(turn_repair.F.col("key"))).drop("key")
    return rows_of(both)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, True) for r in rows], "conv_id long, turn long, role string, text string, n int, first boolean").repartition(3)


def made(seed, n):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User", "superuser"]
    texts = ["Yes.", "No!", "Well", "a b?", " \n", "", None, "One. Two", "ok. \t"]
    out = []
    for conv in range(n):
        for turn in range(rng.randint(1, 9)):
            out.append((conv if conv % 17 else None, turn if rng.random() > 0.1 else rng.choice([None, 2, 30]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"line {rng.random()}."))
    return out


@pytest.mark.parametrize("block", [128, 3])
def test_random_conversations(spark, monkeypatch, block):
    monkeypatch.setattr(turn_repair, "BLOCK", block)
    rows = made(5, 120)
    assert summary(frame(spark, rows)) == expected(rows)


def test_decide_in_blocks(monkeypatch):
    """Any split into blocks gives the same edits, and they are those of the search."""
    rng = random.Random(8)
    for _ in range(300):
        codes = "".join(rng.choice("suaoSUAOxua") for _ in range(rng.randint(0, 14)))
        names = {"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "user"}
        want = search([(names[c.lower()], "t", "blank" if c == "x" else "truncated" if c.isupper() else "") for c in codes])[:2]
        for block in (128, 1, 2, 5):
            monkeypatch.setattr(turn_repair, "BLOCK", block)
            assert decide(codes) == want, codes


def test_long_conversation(spark):
    """Thousands of rows, thousands of equal ones, and a text of many megabytes."""
    rows = [(1, t, "user" if t % 3 else "assistant", f"Sentence {t}.") for t in range(3000)] + [(1, 5000, "user", "Same.")] * 2000 + [(2, 0, "user", "x" * 5_000_000 + ".")]
    assert summary(frame(spark, rows)) == expected(rows)


def test_lost_and_empty(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hello.")]
    assert summary(frame(spark, rows)) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert summary(frame(spark, rows).limit(0)) == []


def test_repaired_rows(spark):
    rows = made(9, 40)
    left = damaged(frame(spark, rows))
    decided = decisions(left).cache()
    got = {}
    for conv, place, role, text, edit in sorted((tuple(r) for r in repaired(left, decided).collect()), key=lambda r: (str(r[0]), r[1])):
        got.setdefault(conv, []).append((role, text, edit))
        assert len(got[conv]) == place
    for r in decided.collect():
        out = got.get(r["conv_id"], [])
        assert "".join(e for *_, e in out) == r["audit"].replace("D", "")
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for role, *_ in out))


def test_given_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert summary(df) == expected([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
