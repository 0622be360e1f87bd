"""Range join of listings and configurations against all pairs."""

import random

import pytest

from forecourt.operators.configured import bins_of, configured, cover_of
from pyspark.sql import functions as F

CONFIG = "job string, min_price double, max_price double, year_from int, year_to int, exclude_keywords array<string>"


def passes(ad, config):
    _, title, price, year = ad
    _, low, high, first, last, words = config
    inside = all(bound is None or (value is not None and (value >= bound if lower else value <= bound))
                 for value, bound, lower in ((price, low, True), (price, high, False), (year, first, True), (year, last, False)))
    return inside and not any(w is not None and w.lower() in (title or "").lower() for w in words or [])


@pytest.mark.parametrize("broadcast_bins", [200_000, 0])
def test_equals_all_pairs(spark, broadcast_bins):
    rng = random.Random(2)
    maybe = lambda value, share=0.2: None if rng.random() < share else value
    ads = [(i, maybe(rng.choice(["Old car", "new CAR", "bolt 100%", ""])), maybe(rng.choice([0.0, -5.0, 999.99, 1e9, float(rng.randint(0, 60_000))]), 0.1), maybe(rng.randint(1990, 2000), 0.1)) for i in range(300)]
    configs = []
    for i in range(120):
        low = float(rng.randint(0, 50_000))
        configs.append((f"j{i}", maybe(low), maybe(low + rng.choice([-1, 0, 10, 5_000, 1e9])), maybe(rng.randint(1990, 2000)), maybe(rng.randint(1990, 2000)),
                        maybe([maybe(w, 0.1) for w in rng.sample(["old", "CAR", "%", "bolt"], rng.randint(0, 2))])))
    found = configured(spark.createDataFrame(ads, "id int, title string, price double, year int").repartition(3), spark.createDataFrame(configs, CONFIG), broadcast_bins=broadcast_bins)
    got = sorted((r["job"], r["id"]) for r in found.collect())
    assert len(got) > 500 and got == sorted((c[0], a[0]) for c in configs for a in ads if passes(a, c))


@pytest.mark.parametrize("rows_per_cell", [100_000, 40, 3])
def test_totals_equal_all_pairs(spark, rows_per_cell):
    """Jobs, listings and prices that repeat or are missing, ranges in one cell, over many and the wrong way round."""
    rng = random.Random(4)
    maybe = lambda value, share=0.2: None if rng.random() < share else value
    odd = [0.0, -0.0, -5.0, 999.99, 999.99, float("inf")]
    ads = [(maybe(f"id{rng.randint(0, 250)}", 0.05), maybe(rng.choice(["Old car", "new CAR", "bolt 100%", ""])),
            maybe(rng.choice([*odd, *[float(rng.randint(0, 60_000)) for _ in odd]]), 0.1), maybe(rng.randint(1990, 1994), 0.1)) for _ in range(300)]
    configs = []
    for i in range(150):
        low = rng.choice([0.0, 999.99, float(rng.randint(0, 50_000)), float(rng.randint(0, 50_000))])
        configs.append((maybe(f"j{i % 90}", 0.05), maybe(low), maybe(low + rng.choice([-1, 0, 10, 5_000, 1e9])), maybe(rng.randint(1990, 1994), 0.4), maybe(rng.randint(1990, 1994), 0.4),
                        maybe([maybe(w, 0.1) for w in rng.sample(["old", "CAR", "%", "bolt", ""], rng.randint(0, 2))])))
    found = configured(spark.createDataFrame(ads, "id string, title string, price double, year int").repartition(3), spark.createDataFrame(configs, CONFIG),
                       totals_of="id", rows_per_cell=rows_per_cell)
    got = found.groupBy("job").agg(F.sum("n"), F.min("first"), F.max("last"), F.round(F.sum("total"), 2)).collect()
    expected = {}
    for c in configs:
        for a in ads:
            if passes(a, c):
                expected.setdefault(c[0], []).append(a)

    def summary(job, hits):
        ids, prices = [a[0] for a in hits if a[0] is not None], [a[2] for a in hits if a[2] is not None]
        return (job, len(hits), min(ids, default=None), max(ids, default=None), round(sum(prices), 2) if prices else None)

    rows = sorted((summary(j, hits) for j, hits in expected.items()), key=str)
    assert len(rows) > 50 and sorted(map(tuple, got), key=str) == rows


def test_totals_make_no_pairs(spark):
    """Every configuration finds every listing: 4 * 10^9 pairs, added up in seconds."""
    ads = spark.range(20_000).selectExpr("id", "'a' as title", "cast(id as double) as price", "1990 as year")
    configs = spark.range(200_000).selectExpr("id as job", "0D as min_price", "1e9D as max_price", "1990 as year_from", "1990 as year_to", "array('x') as exclude_keywords")
    found = configured(ads, configs, totals_of="id").groupBy("job").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    assert found.filter("n = 20000 and total = 199990000").count() == 200_000


def test_one_bin_in_common(spark):
    """A price inside a range shares exactly one bin with it, and no range has many bins."""
    rng = random.Random(3)
    rows = []
    for _ in range(500):
        low, high = sorted(rng.uniform(0, 80_000) for _ in range(2))
        rows.append((low, high, rng.uniform(0, 80_000)))
    df = spark.createDataFrame(rows, "low double, high double, price double").select(
        "*", cover_of(F.col("low"), F.col("high")).alias("cover"), bins_of(F.col("price")).alias("bins"))
    for r in df.collect():
        common = set(r["cover"]) & set(r["bins"])
        assert len(r["cover"]) == len(set(r["cover"])) <= 18 and len(common) <= 1
        assert len(common) == 1 or not r["low"] <= r["price"] <= r["high"]


def test_empty(spark):
    none = spark.createDataFrame([], CONFIG)
    assert configured(spark.createDataFrame([(1, "a", 1.0, 2000)], "id int, title string, price double, year int"), none).collect() == []
