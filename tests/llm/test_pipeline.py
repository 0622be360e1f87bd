"""The pipeline's stages on a small corpus, each against its brute-force version."""

import random
import zlib

import corpus_pipeline
import pytest
import test_decontaminate
import test_line_dedup
import test_mixing
import test_ngram_join
import test_toxicity
from forecourt.llm.queries import ORACLES, QUERIES
from helpers import words as plain_words

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    """documents, labels and benchmark with toxic texts, repeated lines, copies, near copies and benchmark passages."""
    rng = random.Random(11)
    texts, labels = test_toxicity.corpus(7, 500)
    items = [(i, " ".join(f"b{rng.randrange(3000)}" for _ in range(30))) for i in range(6)]
    texts = [t for _, t in texts]
    for i in range(0, 120, 3):
        texts[i] += "\nThis line is in many documents of this corpus"
    for i in range(200, 230):
        texts[i] = texts[199] + f" tail{i}" if i % 2 else texts[198]
        labels[i] = (i, 1, labels[199 if i % 2 else 198][2])
    for i in range(300, 310):
        texts[i] += " " + items[i % 6][1]
    rows = [(i, t, "en", f"s{i % 5}" if i % 3 else "hot", len(t)) for i, t in enumerate(texts)]
    rows += [(600, None, None, None, None), (601, "", "en", "s1", 0), (None, "a text without an id has these words", None, "s2", 36), (5, texts[5], "en", "s0", len(texts[5]))]
    return rows, labels, items


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpus"))
    rows, labels, items = corpus
    spark.createDataFrame(rows, COLUMNS).repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def key(row):
    return tuple(str(x) for x in row)


def test_stages(spark, corpus, folder):
    rows, labels, items = corpus
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing"]

    def step(name, docs):
        out = stages[name](spark, docs, folder)
        assert name == "source_mixing" or out.dtypes == docs.dtypes
        path = f"{folder}/step-{name}"
        out.write.parquet(path)
        out = spark.read.parquet(path)
        return out, sorted((tuple(r) for r in out.collect()), key=key)

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs, kept = step("toxicity", docs)
    truth = {d: t for d, _, t in labels}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0]
    ids = {r[0] for r in kept}
    assert sum((d not in ids) == (truth[d] == 1) for d in held) / len(held) > 0.95
    assert set(map(key, kept)) <= set(map(key, rows)) and {600, 601, None} <= ids

    docs, lines = step("line_dedup", docs)
    want = test_line_dedup.brute_force([(r[0], r[1]) for r in kept])
    assert sorted(((r[0], r[1]) for r in lines), key=str) == sorted(((d, t) for d, t, _, _ in want), key=str)
    assert all(r[4] == len(r[1]) for r in lines if r[1] is not None)

    docs, alone = step("ngram_jaccard_join", docs)
    groups = {}
    for (d, t), (_, n, c) in zip(sorted(((r[0], r[1]) for r in lines), key=str), test_ngram_join.brute_force(sorted(((r[0], r[1]) for r in lines), key=str)), strict=True):
        groups.setdefault((c, n > 0, None if n else t, None if n else d), []).append(d)
    assert {r[0] for r in alone} == {r[0] for r in lines if r[0] is None} | {min(x for x in g if x is not None) for g in groups.values() if any(x is not None for x in g)}

    docs, clean = step("benchmark_decontamination", docs)
    bad = {d for d, _ in test_decontaminate.brute_force([(r[0], r[1]) for r in alone], items)}
    assert [r[0] for r in clean] == [r[0] for r in alone if r[0] not in bad] and bad

    _, mixed = step("source_mixing", docs)
    assert [r[0] for r in mixed].sort(key=str) == [r[0] for r in clean].sort(key=str)
    sizes = {}
    for r in clean:
        sizes[r[3]] = sizes.get(r[3], 0) + len(plain_words(r[1]))
    target = test_mixing.fill(sizes)
    for source in sizes:
        taken = sum(r[6] for r in mixed if r[1] == source)
        assert abs(taken - target[source]) <= max([r[2] for r in mixed if r[1] == source])

    whole = sorted((tuple(r) for r in corpus_pipeline.run(spark, folder).collect()), key=key)
    assert whole == mixed


def test_queries_are_registered():
    numbers = sorted(int(q[2:].split("_")[0]) for q in QUERIES)
    assert numbers == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
    assert corpus_pipeline.QUERIES["pipeline"] is corpus_pipeline.run


def test_empty_documents(spark, folder, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, oracle, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    columns = sorted(df.columns)
    plain = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    relation = oracle.execute(ORACLES[name])
    names = [c[0] for c in relation.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in relation.fetchall())
