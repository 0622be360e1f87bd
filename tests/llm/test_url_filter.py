"""URL filters against rules tried one by one, and the cascade's exactness."""

import random

import numpy as np
import pytest
from forecourt.llm import url_filter
from forecourt.llm.url_filter import Rules, build_cascade, judge, passes
from helpers import FOLD, rows_of

RULES = Rules((("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("b.org", "/fr/x", "block")),
              (("spam.org", "/"),))


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:]
    return rest[:end].translate(FOLD), path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def expected(url, rules=RULES):
    host, path = parts(url)
    fits = lambda h, p: (host == h or host.endswith("." + h)) and path.startswith(p)
    best = max(((len(h + p), len(h), h + p, v) for h, p, v in rules.verdicts if fits(h, p)), default=None)
    verdict = best[3] if best else "block" if any(fits(*x) for x in rules.listed) else "allow"
    return host, path, best[2] if best else None, verdict


URLS = ["http://a.NET/", "http://a.net", "http://a.net?x", "http://example.net/en/1", "http://www.example.net/en", "http://notexample.net/en/2", "https://x.example.com/de/",
        "https://example.com/DE/", "http://b.org/fr/xy?q=/fr/", "http://c.b.org/fr/", "http://spam.org/a", "http://spam.org", "http://nospam.org/a", "http://org/fr/",
        "no scheme", "", None, "://", "http:///net/", "http://a.net/#://b.org/fr/", "ftp://x.net/a b\nc", "http://net/", "http://..net/", "http://example.net/en/" + "x" * 100_000]


def test_rules(spark):
    rows = [(i, u, "k") for i, u in enumerate(URLS)] + [(None, "http://a.net/", "k")] * 2
    got = rows_of(judge(spark.createDataFrame(rows, "page_id long, url string, host string").repartition(3), RULES))
    assert got == sorted(((i, u, *expected(u)) for i, u, _ in rows), key=str)


def test_no_rows_and_no_rules(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert judge(empty, RULES).collect() == []
    df = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert rows_of(judge(df, Rules(())), "rule", "verdict") == [(None, "allow")]


@pytest.mark.parametrize("listed", [0, 1, 50, 3000])
def test_cascade_is_exact(spark, listed):
    rng = random.Random(listed)
    keys = [rng.randrange(-(2**63), 2**63) for _ in range(20_000)]
    universe = spark.createDataFrame([(k,) for k in keys], "key long")
    chosen = spark.createDataFrame([(k,) for k in keys[:listed]] + [(7,)] * bool(listed), "key long")
    levels = build_cascade(chosen, universe)
    assert passes(levels, np.array(keys, np.int64).view(np.uint64)).tolist() == [i < listed for i in range(len(keys))]


def test_size_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_BYTES", 4)
    with pytest.raises(ValueError, match="bound"):
        build_cascade(spark.range(100).withColumnRenamed("id", "key"), spark.range(2000).withColumnRenamed("id", "key"))


def test_jobs_do_not_follow_shuffle_partitions(spark):
    """A small list runs the same few tasks however many partitions a shuffle has and keeps."""
    from forecourt.llm.url_filter import build_cascade
    from pyspark.sql import functions as F

    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    context = spark.sparkContext
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "37")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        context.setJobGroup("cascade", "cascade")
        universe = spark.range(500).select(F.xxhash64("id").alias("key")).distinct()
        levels = build_cascade(spark.range(20).select(F.xxhash64("id").alias("key")).distinct(), universe)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        context.setLocalProperty("spark.job.description", None)
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert levels and len(context.statusTracker().getJobIdsForGroup("cascade")) < 37
