import random

import pytest
from pyspark.sql import functions as F

from forecourt.operators import listings, market, pricing, ranks
from forecourt.operators.split import train_val_split

ROWS = [
    (80000.0, 2020, 50000, "dealer"), (70000.0, 2019, 80000, "dealer"), (60000.0, 2019, 10000, "private"),
    (90000.0, 2021, 30000, "dealer"), (40000.0, 2015, 210000, "private"), (None, 2020, 5, "dealer"),
]


@pytest.fixture(scope="module")
def ads(spark):
    return spark.createDataFrame(ROWS, "price double, year int, mileage int, dealer_type string")


@pytest.mark.parametrize("max_sorted", [1_000_000, 1])
def test_overview(ads, max_sorted):
    row = market.market_overview(ads, max_sorted).first()
    assert (row.total_listings, row.average_price, row.median_price, row.min_price, row.max_price) == (5, 68000, 70000, 40000, 90000)
    assert row.price_std == pytest.approx(19235.384061671346)


def test_by_year(ads):
    found = {r.year: (r.avg_price, r.listing_count) for r in market.price_by_year(ads).collect()}
    assert found == {2015: (40000, 1), 2019: (65000, 2), 2020: (80000, 1), 2021: (90000, 1)}


def test_by_bucket(ads):
    found = [r.avg_price for r in market.price_by_mileage_bucket(ads).orderBy("bucket").collect()]
    assert found == [pytest.approx(76666.6667, abs=1e-3), 70000, None, None, 40000]


def test_equal_mileage_is_medium(spark):
    rows = spark.createDataFrame([(1.0, 5), (2.0, 5)], "price double, mileage int")
    assert [r.avg_price for r in market.price_by_mileage_bucket(rows).orderBy("bucket").collect()] == [None, None, 1.5, None, None]


def test_dealers(ads):
    found = {r.dealer_type: (r.avg_price, r.listing_count, r.price_volatility) for r in market.dealer_stats(ads).collect()}
    assert found == {"dealer": (80000, 3, 10000), "private": (50000, 2, pytest.approx(14142.13562373095))}


def test_high_mileage_and_report(ads):
    assert market.high_mileage_impact(ads).first().high_mileage_impact == pytest.approx(0.4117647058823529)
    report = market.market_report(ads).first()
    assert report.recommendations == ["Consider older models for better value"]
    assert [b.mileage_bucket for b in report.by_mileage] == ["Very Low", "Low", "Medium", "High", "Very High"]


def test_empty_report(ads):
    report = market.market_report(ads.filter("price is null")).first()
    assert report.error == "No price data available" and report.median_price is None


def test_future_year_counts_as_high_mileage(spark):
    rows = spark.createDataFrame([(1.0, 2025, 10), (3.0, 2025, 0), (5.0, 2020, 10)], "price double, year int, mileage int")
    assert market.high_mileage_impact(rows).first().high_mileage_count == 1


@pytest.mark.parametrize("values", [
    [random.Random(1).gauss(0, 1e5) for _ in range(5001)],
    [7.0] * 3000 + [random.Random(2).random() for _ in range(1000)],
    [10.0 ** random.Random(3 + i).randint(-200, 200) for i in range(800)],
])
def test_ranks_equal_a_sort(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(7)
    wanted = [0, 1, len(values) // 3, len(values) // 2, len(values) - 1]
    assert ranks.select_ranks(df, {"v": wanted}, max_sorted=20, accuracy=50)["v"] == [sorted(values)[k] for k in wanted]


@pytest.mark.parametrize("n, ratio", [(1000, 0.9), (37, 0.8), (1, 0.9), (5, 1.0)])
def test_split_sizes(spark, n, ratio):
    rows = spark.range(n).withColumnRenamed("id", "k")
    split = {p: {r.k: r.split for r in train_val_split(rows.repartition(p), "k", ratio, max_sorted=50).collect()} for p in (1, 32)}
    assert split[1] == split[32] and len(split[1]) == n
    assert sum(s == "train" for s in split[1].values()) == int(n * ratio)


NODE_WALK = """with recursive walk as (select r.id, r.features, n.tree, n.feature, n.threshold, n."left", n."right", n.value from rows r, nodes n where n.node = 0
  union all select w.id, w.features, n.tree, n.feature, n.threshold, n."left", n."right", n.value from walk w join nodes n on w.value is null and n.tree = w.tree
    and n.node = case when w.features[w.feature + 1] <= w.threshold then w."left" else w."right" end)
select id, avg(value) from walk where value is not null group by id"""


def test_forest_as_a_table(spark, tmp_path):
    """A fitted and saved forest, read back as rows, says what the model says: by the table here and by plain SQL."""
    import duckdb

    ads = spark.range(400).selectExpr(
        "id", "cast(id as string) as source_id", "1000.0 + id * 7 % 5000 + (id % 13) * 300 as price", "cast(2000 + id % 20 as int) as year", "cast(id * 977 % 90000 as int) as mileage",
        "cast(100 + id % 50 as int) as engine_power", "1.0 + id % 4 as engine_displacement", "if(id % 3 = 0, 'a', 'b') as fuel_type", "'m' as transmission",
        "if(id % 9 = 0, null, 'x') as body_type", "'c' as color", "'d' as dealer_type",
    )
    path = pricing.trained_model(ads, str(tmp_path), trees=12, depth=6)
    assert pricing.trained_model(ads.repartition(3), str(tmp_path), trees=12, depth=6) == path  # equal rows: the same model, not fitted again
    assert pricing.trained_model(ads.limit(399), str(tmp_path), trees=3, depth=2) != path
    model = pricing.load_model(f"{path}/model")
    rows = pricing.encoded(model, pricing.prepare_training_data(ads), ("id",)).cache()
    nodes = pricing.forest_nodes(spark, f"{path}/model").cache()
    assert nodes.select("tree").distinct().count() == 12 and nodes.filter("value is null and left is null").isEmpty()
    want = {r.id: r.predicted_price for r in model.transform(pricing.prepare_training_data(ads)).select("id", "predicted_price").collect()}
    got = {r.id: r.predicted_price for r in pricing.score_forest(rows.select("id", "features"), nodes).collect()}
    db = duckdb.connect()
    db.register("rows", rows.select("id", "features").toArrow())
    db.register("nodes", nodes.toArrow())
    plain = dict(db.execute(NODE_WALK).fetchall())
    assert len(want) == 400 and got == pytest.approx(want) and plain == pytest.approx(want)
    scored = ads.join(spark.createDataFrame(list(want.items()), "id long, predicted_price double"), "id")
    row = pricing.quality(scored).first()
    from pyspark.ml.evaluation import RegressionEvaluator

    for name, value in (("mae", row.mae), ("r2", row.r2_score)):
        assert value == pytest.approx(RegressionEvaluator(labelCol="price", predictionCol="predicted_price", metricName=name).evaluate(scored))
    info = pricing.saved_info(spark, path).first()
    assert (info.is_trained, info.status, info.model_path) == (True, "ready", path)
    assert pricing.saved_info(spark, f"{path}/nothing").first().status == "needs_training"


def test_price_model(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, f"s{i}", 90000.0 - 2000 * (i % 20) + rng.random(), 2024 - i % 20, 1000 * (i % 50), None, 3.0, "Petrol",
             "Manual" if i % 2 else None, "SUV", "red", "dealer") for i in range(300)]
    ads = spark.createDataFrame(rows, "id long, source_id string, price double, year int, mileage int, engine_power int, "
                                "engine_displacement double, fuel_type string, transmission string, body_type string, color string, dealer_type string")
    trained = pricing.train_price_model(ads, trees=10, depth=5)
    assert (trained.training_samples, trained.test_samples) == (240, 60) and trained.r2_score > 0.9
    assert sum(trained.feature_importance.values()) == pytest.approx(1)
    pricing.save_model(trained.model, str(tmp_path / "model"))
    unseen = ads.limit(1).withColumns({"fuel_type": F.lit("Coal"), "year": F.lit(None).cast("int"), "price": F.lit(None).cast("double")})
    row = pricing.predict_prices(pricing.load_model(str(tmp_path / "model")), unseen).first()
    assert row.predicted_price > 0 and row.is_good_deal is None
    assert pricing.model_info(spark, trained).first().is_trained
    with pytest.raises(ValueError):
        pricing.train_price_model(ads.limit(9))


def test_confidence_and_holds(spark):
    rows = spark.createDataFrame([(1, None, 0.0), (None, None, 2.0)], "a int, b int, c double")
    out = rows.select(pricing.completeness(["a", "b", "c"]).alias("k"), listings.holds("c").alias("h")).collect()
    assert [r.k for r in out] == [pytest.approx(0.8 * 2 / 3), pytest.approx(0.8 / 3)] and [r.h for r in out] == [False, True]


def test_training_rows_are_dealt_to_tasks(spark, monkeypatch):
    """However few files they come from; and a forest walks once a row, whatever reads its price."""
    ads = spark.range(300, numPartitions=1).selectExpr(
        "id", "cast(id as string) as source_id", "cast(1000 + id % 7 * 100 as double) as price", "cast(2000 + id % 7 as int) as year", "cast(id as int) as mileage",
        "100 as engine_power", "2.0 as engine_displacement", "'a' as fuel_type", "'m' as transmission", "'x' as body_type", "'c' as color", "'d' as dealer_type",
    )
    made, dealt = pricing.price_pipeline, []

    class Watched:
        def __init__(self, *settings):
            self.pipeline = made(*settings)

        def fit(self, train):
            dealt.append(train.rdd.getNumPartitions())
            return self.pipeline.fit(train)

    monkeypatch.setattr(pricing, "price_pipeline", Watched)
    trained = pricing.train_price_model(ads, trees=2, depth=2, rows_per_task=100)
    assert dealt == [3] and (trained.training_samples, trained.test_samples) == (240, 60)
    pricing.train_price_model(ads, trees=2, depth=2)
    assert dealt == [3, 1]
    deals = pricing.predict_prices(trained.model, ads).filter("is_good_deal")
    plan = deals._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(array(predicted_price" in plan and "Filter" in plan.split("Generate explode(array(predicted_price")[0]


def test_rows_are_made_once(spark):
    """Medians and reports pass over their ads several times, over what made them once."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    ads = spark.range(3000).selectExpr(
        "cast(1000 + id % 977 as double) as price", "cast(2000 + id % 7 as int) as year", "cast(id as int) as mileage", "100 as engine_power",
        "2.0D as engine_displacement", "'d' as dealer_type",
    )
    ads = ads.mapInPandas(counted, ads.schema)
    assert pricing.feature_medians(ads, 10)["mileage"] == 1499.5 and read.value == 3000
    assert market.market_report(ads, 2024, 10).first().total_listings == 3000 and read.value == 6000
