"""Toxicity: held-out accuracy, exact features, and odd input."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from forecourt.llm import toxicity
from forecourt.llm.toxicity import Settings, features, held_out, scores, train, without_toxic
from helpers import rows_of

BAD = ["grumble", "snarl", "hiss", "growl"]


def corpus(seed, n):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [f"word{int(rng.expovariate(0.01))}" for _ in range(rng.randrange(20, 200))]
        toxic = int(rng.random() < 0.2)
        for _ in range(rng.randrange(2, 6) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(1, 1500)
    d, l = frames(spark, docs, labels)
    got = {r["doc_id"]: r["score"] for r in scores(d, l).collect()}
    out = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0]
    truth = {i: t for i, _, t in labels}
    right = sum((got[i] >= 0.5) == (truth[i] == 1) for i in out) / len(out)
    assert len(got) == len(docs) and right > 0.97
    kept = {r["doc_id"] for r in without_toxic(d, l).collect()}
    assert kept == {i for i in got if got[i] < 0.5}
    assert rows_of(scores(d.repartition(5), l)) == rows_of(scores(d, l))


def test_held_out_labels_teach_nothing(spark):
    docs, labels = corpus(2, 400)
    d, l = frames(spark, docs, labels)
    _, turned = frames(spark, docs, [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels])
    assert rows_of(scores(d, l)) == rows_of(scores(d, turned))


def test_held_out_rows(spark):
    df = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long")
    assert [r[0] for r in df.select(held_out("doc_id")).collect()] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)] + [False]


def test_features():
    feature, row = features(pa.array(["a b c d e", None, "A  b\n", ""]))
    first = feature[row == 0]
    assert np.bincount(row, minlength=4).tolist() == [5 + 4 + 3 + 2, 0, 3, 0]
    assert set(feature[row == 2]) <= set(first) and len(set(first)) == 14


def test_weights_are_few():
    docs, labels = corpus(3, 800)
    known, weights, intercept = train(pa.array([t for _, t in docs]), np.array([t for _, _, t in labels], float), Settings())
    mark = {f: w for f, w in zip(known.tolist(), weights.tolist(), strict=True)}
    assert intercept < 0 and len(known) < 500
    for word in BAD:
        assert mark[int(features(pa.array([word]))[0][0])] > 0.5


@pytest.mark.parametrize("labels", [[], [(1, 1, None)], [(1, 0, 0), (2, 0, 0)], [(None, 1, 1)], [(1, 1, 1), (999, 0, 0)]])
def test_nothing_to_learn(spark, labels):
    d, l = frames(spark, [(1, "a b"), (2, None), (None, "")], labels)
    assert rows_of(scores(d, l)) == [(1, 0.0), (2, 0.0), (None, 0.0)]
    assert without_toxic(d, l).count() == 3


def test_odd_rows(spark, monkeypatch):
    docs, labels = corpus(4, 300)
    more = [(1000, None), (1001, ""), (None, "grumble snarl"), (1002, "w " * 300_000), (3, docs[3][1]), (3, "other text")]
    d, l = frames(spark, docs + more, labels + [(3, 0, 1), (3, 0, None), (4, 0, 1), (4, 0, 0)])
    got = rows_of(scores(d, l))
    assert len(got) == 306 and all(0 <= s <= 1 for _, s in got)
    empty = {s for i, s in got if i in (1000, 1001)}
    assert len(empty) == 1 and empty.pop() < 0.5
    wide = d.selectExpr("doc_id", "text", "1 as score", "2 as toxic", "3 as features")
    assert without_toxic(wide, l).columns == wide.columns
    assert scores(d.limit(0), l).collect() == []
    few = Settings(max_rows=50)
    assert len(rows_of(scores(d, l, few))) == 306
