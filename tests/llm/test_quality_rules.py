"""Facts against plain loops, estimates against planted truth, verdicts against a plain sum."""

import math
import re
from collections import Counter

import numpy as np
from forecourt.llm import quality_rules
from forecourt.llm.quality_rules import estimate, facts, filtered, fit, judged
from helpers import WORD, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow as pa


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {i + k for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(hit), "n_letters": sum(c.isascii() and c.isalpha() or ord(c) >= 0x80 for c in text), "n_digits": sum(c in "0123456789" for c in text),
        "n_symbol_words": sum(bool(re.search(r"[#*$%&|<>]", w)) for w in words), "n_lines": len(lines),
        "n_ended_lines": sum(WORD.findall(x)[-1][-1] in ".!?:;\"')" for x in lines), "n_distinct_words": len(set(words)),
    }


TEXTS = [None, "", " \n", "a", "a b c a b c", "a a a a", "x\ny\nx\n x\nx", "\n\nend.\n", "## a|b <c> 12 é漢   z", "one two three\none two three\nend!", "a\tb\x0bc\x1cd"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(TEXTS), st.text("ab \n.#1é", max_size=40)), max_size=6))
def test_facts(texts):
    got = quality_rules.facts_of(pa.array(texts, pa.string()))
    assert {k: v.tolist() for k, v in got.items()} == {k: [plain(t)[k] for t in texts] for k in plain("")}


def test_odd_rows(spark):
    long = "many words here and there. " * 100_000
    rows = [*enumerate(TEXTS), (None, "a b"), (3, "a"), (3, "a"), (50, long)]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, n_words int, posterior double").repartition(3)
    got = rows_of(filtered(df), "doc_id", *plain(""))
    assert got == sorted(((d, *plain(t).values()) for d, t in rows), key=str)
    assert filtered(df.limit(0)).collect() == []


def votes_of(rng, truth, right, spoken):
    """Votes of rules with known accuracy; 0 where a rule abstains."""
    votes = np.zeros((len(truth), len(right)), int)
    for r, (a, s) in enumerate(zip(right, spoken, strict=True)):
        says = np.where(rng.random(len(truth)) < a, truth, 1 - truth)
        votes[:, r] = np.where(rng.random(len(truth)) < s, 2 - says, 0)
    return votes


def test_estimates_planted_accuracies():
    rng = np.random.default_rng(1)
    truth = (rng.random(60_000) < 0.8).astype(int)
    right, spoken = [0.95, 0.9, 0.8, 0.7, 0.5], [0.9, 0.7, 1.0, 0.6, 0.8]
    votes = votes_of(rng, truth, right, spoken)
    patterns = votes @ 3 ** np.arange(4, -1, -1)
    seen, counts = np.unique(patterns, return_counts=True)
    model = estimate(seen, counts.astype(float), 5)
    assert abs(model.share - 0.8) < 0.02
    assert np.abs(model.accuracy - np.array(right)[:, None]).max() < 0.04
    verdicts = model.posterior(patterns) >= 0.5
    majority = (votes == 1).sum(axis=1) >= (votes == 2).sum(axis=1)
    assert (verdicts == truth).mean() > (majority == truth).mean()


def test_estimate_equals_documents_one_by_one():
    """Counted patterns give what plain loops over documents give."""
    rng = np.random.default_rng(2)
    votes = votes_of(rng, (rng.random(300) < 0.7).astype(int), [0.9, 0.8, 0.7], [1.0, 0.8, 0.6])
    good, share = [[0.8] * 3, [0.2] * 3], 0.5
    for _ in range(quality_rules.ROUNDS):
        weights = []
        for v in votes:
            p = [s * math.prod(g if x == 1 else 1 - g if x == 2 else 1 for g, x in zip(c, v, strict=True)) for s, c in zip((share, 1 - share), good, strict=True)]
            weights.append((p[0] / sum(p), p[1] / sum(p)))
        for c, begin in enumerate((0.8, 0.2)):
            for r in range(3):
                yes, no = (sum(w[c] for w, v in zip(weights, votes, strict=True) if v[r] == k) for k in (1, 2))
                good[c][r] = (yes + 2 * begin) / (yes + no + 2)
        share = (sum(w[0] for w in weights) + 1) / (len(votes) + 2)
    seen, counts = np.unique(votes @ 3 ** np.arange(2, -1, -1), return_counts=True)
    model = estimate(seen, counts.astype(float), 3)
    assert abs(model.share - share) < 1e-3
    assert np.abs(model.accuracy - np.array([good[0], [1 - g for g in good[1]]]).T).max() < 1e-2


def test_verdicts_are_the_models(spark):
    described = facts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).cache()
    model = fit(described)
    rows = judged(described, model).withColumn("pattern", quality_rules.pattern(quality_rules.rules())).toPandas()
    posterior = model.posterior(rows["pattern"].to_numpy())
    assert np.allclose(rows["posterior"], posterior)
    failed = (rows["n_words"] < 50) | (100 * rows["n_repeat_words"] > 50 * rows["n_words"])
    assert (rows["base_failed"] == failed).all()
    assert (rows["kept"] == (~failed & (rows["posterior"] >= 0.5))).all()


def test_given_labels(spark):
    """No label is used, yet what passes the floor is judged as the labels judge it; clean documents stay."""
    rows = filtered(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("not base_failed").toPandas()
    assert (rows["kept"] == (rows["quality"] == 1)).mean() > 0.97
    assert rows[rows["quality"] == 1]["kept"].all()
