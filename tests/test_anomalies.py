import pytest

from pyspark.sql import functions as F

from forecourt.operators import anomalies

SCHEMA = ("id long, source_id string, year int, make string, model string, price double, mileage int, dealer_name string, "
          "dealer_type string, title string, image_urls array<string>, local_image_paths array<string>, raw_data string")


def ad(i, year=2020, price=50000.0, mileage=50000, dealer="BMW Dealer", kind="dealer", title="car", urls=2, text=None, model="M5"):
    raw = None if text is None else '{"text_content": "%s"}' % text
    return (i, f"s{i}", year, "BMW", model, price, mileage, dealer, kind, title, [f"u{n}" for n in range(urls)], [], raw)


def detect(spark, rows, **options):
    out = anomalies.detect_anomalies(spark.createDataFrame(rows, SCHEMA), **options)
    return {r.ad_id: r for r in out.collect()}, out


def test_two_sample_ads(spark):
    found, out = detect(spark, [
        ad(1, price=80000.0, title="BMW M5 2020 - Excellent Condition"),
        ad(2, price=20000.0, mileage=1000, dealer="Quick Sale Motors", urls=0,
           title="URGENT SALE - BMW M5 - CASH ONLY - NO QUESTIONS"),
    ])
    assert list(found) == [2]
    assert found[2].anomaly_reasons == ["No images provided", "Suspicious keywords: urgent, cash only, no questions"]
    assert found[2].anomaly_score == pytest.approx(0.5) and found[2].confidence == pytest.approx(0.4)
    summary = anomalies.anomaly_summary(out).first()
    assert (summary.total_anomalies, summary.anomaly_rate, summary.risk_level) == (1, 0.01, "medium")


@pytest.mark.parametrize("others, z, score", [(11, 3.3166, 0.33166), (10, 3.1623, 0.31623), (5, 2.2361, 0.1118), (4, 2.0, None)])
@pytest.mark.parametrize("rows_per_split", [1_000_000, 1])
def test_price_outlier(spark, others, z, score, rows_per_split):
    rows = [ad(i) for i in range(others)] + [ad(99, price=100000.0), ad(100, price=None), ad(101, price=0.0)]
    scored = anomalies.with_price_zscore(spark.createDataFrame(rows, SCHEMA), rows_per_split)
    assert scored.count() == others + 3
    last = scored.filter("id = 99").select("price_z", anomalies.price_rule()["score"].alias("s")).first()
    assert last.price_z == pytest.approx(z, abs=1e-4)
    assert (last.s is None) if score is None else last.s == pytest.approx(score, abs=1e-5)
    assert scored.filter("id >= 100 and price_z is not null").count() == 0


def test_no_deviation(spark):
    scored = anomalies.with_price_zscore(spark.createDataFrame([ad(i) for i in range(3)], SCHEMA))
    assert {r.price_z for r in scored.collect()} == {0.0}


@pytest.mark.parametrize("changes, score", [
    ({"mileage": 999, "year": 2022}, 0.3), ({"mileage": 45000 * 4 + 1}, 0.2), ({"mileage": 45000 * 4}, None),
    ({"year": 2025, "mileage": None}, 0.5), ({"year": 1989, "mileage": None}, 0.2), ({"year": 1990, "mileage": None}, None),
    ({"year": 2024, "mileage": 5}, 0.2), ({"dealer": None}, 0.1), ({"dealer": "Latest Cars"}, 0.4), ({"urls": 21}, 0.1),
    ({"text": " ".join(["w"] * 11 + [f"x{i}" for i in range(90)])}, 0.2),
    ({"text": " ".join(["w"] * 10 + [f"x{i}" for i in range(91)])}, None), ({"title": None}, None),
])
def test_rule_edges(spark, changes, score):
    found, _ = detect(spark, [ad(1, **changes)])
    assert (1 not in found) if score is None else found[1].anomaly_score == pytest.approx(score)


def test_score_is_capped_and_reasons_keep_order(spark):
    found, out = detect(spark, [ad(1, year=2030, mileage=5, dealer="fake", urls=0, title="urgent must sell as is")])
    row = found[1]
    assert [r.split()[0] for r in row.anomaly_reasons] == ["Very", "Future", "Suspicious", "No", "Suspicious"]
    assert row.anomaly_score == 1.0 and row.confidence == pytest.approx(0.9)
    assert anomalies.reason_counts(out).first().reason == row.anomaly_reasons[0]


@pytest.mark.parametrize("broadcast_cohorts", [200_000, 0])
def test_cohorts_sent_or_joined(spark, broadcast_cohorts):
    """Null keys are a cohort like others, an ad without a price has none, and rows that come twice stay two."""
    rows = [ad(i, model=None, price=float(p)) for i, p in enumerate([1, 2, 6])] + [ad(7, price=None), ad(8, price=0.0)] + [ad(9)] * 2
    scored = anomalies.with_price_zscore(spark.createDataFrame(rows, SCHEMA), broadcast_cohorts=broadcast_cohorts)
    got = sorted((r.id, r.cohort_n, r.price_z) for r in scored.select("id", "cohort_n", F.round("price_z", 4).alias("price_z")).collect())
    assert sorted(got, key=str) == sorted([(0, 3, 0.9258), (1, 3, 0.4629), (2, 3, 1.3887), (7, None, None), (8, None, None), (9, 2, None), (9, 2, None)], key=str)


def test_ads_are_made_once_and_travel_short(spark):
    """Each ad is made once for the whole report, and its addresses are no part of any kept or moved row."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = [ad(i, urls=21) for i in range(10)]
    found = anomalies.detect_anomalies(spark.createDataFrame(rows, SCHEMA).mapInArrow(count, SCHEMA).repartition(2))
    assert found.count() == 10 and made.value == 10
    assert "image_urls" not in found._jdf.queryExecution().optimizedPlan().toString()
