"""Price model queries."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from forecourt.functions import fixed
from forecourt.operators import pricing
from forecourt.plans.bindings import ads_sql, ads_view, table
from forecourt.plans.registry import query
from forecourt.session import cut_lineage, shared_folder

COLUMNS = ("id", "source_id", "price", "year", "mileage", "engine_power", "engine_displacement", "fuel_type",
           "transmission", "body_type", "color", "dealer_type")


def _ads(spark, sf_dir, wide=False):
    return ads_view(spark, sf_dir, *COLUMNS, wide=wide)


def _model(spark, sf_dir):
    """Path of the saved model of a folder's listings."""
    return pricing.trained_model(_ads(spark, sf_dir), shared_folder(spark))


@query()
def price_model_train(spark, sf_dir):
    report = spark.read.parquet(f"{_model(spark, sf_dir)}/report")
    return report.select("status", "training_samples", "test_samples", "mae", "r2_score", F.explode("feature_importance").alias("feature", "importance"))


@query(f"""select 'trained' as status, cast(floor(count(*) * 0.8) as bigint) as training_samples, count(*) - cast(floor(count(*) * 0.8) as bigint) as test_samples,
  '{",".join(sorted(pricing.FEATURES))}' as features, 1.0::double as importance, true as errors_known from lineitem""")
def price_model_report(spark, sf_dir):
    """What is certain of the report of a fitted model: sizes, features, and importances that add up to one."""
    rows = price_model_train(spark, sf_dir).groupBy("status", "training_samples", "test_samples", "mae", "r2_score").agg(
        F.array_join(F.sort_array(F.collect_list("feature")), ",").alias("features"), F.round(F.sum("importance"), 6).alias("importance")
    )
    return rows.withColumn("errors_known", (F.col("mae") >= 0) & (F.col("r2_score") <= 1)).drop("mae", "r2_score")


@query(f"""select count(*) > 0 as is_trained, 'ready' as status, '{",".join(pricing.FEATURES)}' as feature_columns, 'RandomForestRegressor' as model_type, true as is_saved from lineitem""")
def price_model_info(spark, sf_dir):
    """State of the model that was saved to the shared folder and loaded from there."""
    path = _model(spark, sf_dir)
    info = pricing.saved_info(spark, path)
    return info.select("is_trained", "status", F.array_join("feature_columns", ",").alias("feature_columns"), "model_type", (F.col("model_path") == path).alias("is_saved"))


@query()
def price_model_predict(spark, sf_dir):
    return pricing.predict_prices(pricing.load_model(f"{_model(spark, sf_dir)}/model"), _ads(spark, sf_dir, wide=True))


@query()
def good_deals(spark, sf_dir):
    return price_model_predict(spark, sf_dir).filter("is_good_deal")


# Listings with gaps, for filling and coding.
GAPPY = f"""select id, price, case when right(id, 1) = '1' then null else year end as year, mileage, case when mileage % 7 = 0 then null else engine_power end as engine_power,
  engine_displacement, case when mileage % 11 = 0 then null else fuel_type end as fuel_type, transmission, body_type, color, case when year = 1995 then null else dealer_type end as dealer_type
from {{ads}}"""
CODES = ("fuel_type", "transmission", "body_type", "color", "dealer_type")
FILLED = f"""gaps as ({GAPPY.format(ads="(" + ads_sql(*COLUMNS) + ") a")}),
medians as (select median(year) as year, median(mileage) as mileage, median(engine_power) as engine_power, median(engine_displacement) as engine_displacement from gaps),
filled as (select id, price, coalesce(g.year, m.year) as year, coalesce(g.mileage, m.mileage) as mileage, coalesce(g.engine_power, m.engine_power) as engine_power,
  coalesce(g.engine_displacement, m.engine_displacement) as engine_displacement, {", ".join(f"coalesce({c}, '{fixed.MISSING_CATEGORY}') as {c}" for c in CODES)} from gaps g, medians m),
coded as (select id, price, year, mileage, engine_power, engine_displacement, {", ".join(f"cast(dense_rank() over (order by {c}) - 1 as double) as i_{c}" for c in CODES)} from filled),
scaled as (select id, price, {", ".join(f"i_{c}" for c in CODES)}, {", ".join(f"({c} - avg({c}) over ()) / stddev_samp({c}) over () as s{i}" for i, c in enumerate((*fixed.NUMERIC_FEATURES, *[f"i_{c}" for c in CODES])))} from coded)"""


def _encoded(spark, sf_dir):
    # The rows are kept before their gaps are filled: medians, codes and scores all read them, and joins run once.
    ads = cut_lineage(spark.sql(GAPPY, ads=_ads(spark, sf_dir)))
    prepared = pricing.prepare_training_data(ads)
    coder = Pipeline(stages=pricing.encoding_stages()).fit(prepared)
    return pricing.encoded(coder, prepared, ("id", "price"))


@query(f"""with {FILLED} select id, {", ".join(f"i_{c}" for c in CODES)}, {", ".join(f"round(s{i}, 6) as s{i}" for i in range(9))} from scaled""")
def encoded_features(spark, sf_dir):
    """Gaps filled by medians and a word of their own, words as alphabetic codes, all features scaled."""
    rows = _encoded(spark, sf_dir)
    return rows.select("id", *[f"i_{c}" for c in CODES], *[F.round(F.col("features")[i], 6).alias(f"s{i}") for i in range(9)])


# A forest whose trees follow from the regions: every tree asks two features on each way, or one on the short way of odd trees.
FOREST = """select cast(r_regionkey as int) as tree, cast(n as int) as node,
  case when leaf then null else cast((r_regionkey * 2 + n) % 9 as int) end as feature, case when leaf then null else (r_regionkey - n) / 4.0 + 0.1 end as threshold,
  case when leaf then null when n = 0 then 1 else cast(2 * n + 1 as int) end as left, case when leaf then null when n = 0 then 2 else cast(2 * n + 2 as int) end as right,
  case when leaf then cast(length(r_name) * 7000 + 1000 * n as double) end as value
from (select *, n > 2 or (n = 2 and r_regionkey % 2 = 1) as leaf from {places}) x
where not (r_regionkey % 2 = 1 and n > 4)"""
SCORED = f"""{FILLED}, nodes as ({FOREST.format(places="region, (values (0), (1), (2), (3), (4), (5), (6)) v(n)")}),
walk0 as (select id, price, [{", ".join(f"s{i}" for i in range(9))}] as s, n.* from scaled, nodes n where n.node = 0),
walk1 as (select w.id, w.price, w.s, n.* from walk0 w join nodes n on n.tree = w.tree and n.node = case when w.s[w.feature + 1] <= w.threshold then w.left else w.right end),
walk2 as (select id, price, tree, value from walk1 where value is not null
  union all select w.id, w.price, w.tree, n.value from walk1 w join nodes n on w.value is null and n.tree = w.tree and n.node = case when w.s[w.feature + 1] <= w.threshold then w.left else w.right end),
scored as (select id, price, avg(value) as predicted_price from walk2 group by id, price)"""


def _scored(spark, sf_dir):
    places = table(spark, sf_dir, "region").withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(6))))
    nodes = spark.sql(FOREST, places=places)
    return pricing.score_forest(_encoded(spark, sf_dir).select("id", "price", "features"), nodes)


@query(f"""with {SCORED} select id, round(predicted_price, 4) as predicted_price, round(price - predicted_price, 4) as price_difference, price < predicted_price * 0.9 as is_good_deal from scored""")
def forest_scores(spark, sf_dir):
    """Prices that a table of trees predicts from encoded features, and the deals by them."""
    rows = pricing.with_deal(_scored(spark, sf_dir))
    return rows.select("id", F.round("predicted_price", 4).alias("predicted_price"), F.round("price_difference", 4).alias("price_difference"), "is_good_deal")


@query(f"""with {SCORED} select count(*) as n, round(avg(abs(price - predicted_price)), 4) as mae,
  round(1 - sum(power(price - predicted_price, 2)) / (var_pop(price) * count(*)), 6) as r2_score from scored""")
def forest_quality(spark, sf_dir):
    """Mean absolute error and explained variance of those predictions."""
    out = pricing.quality(_scored(spark, sf_dir))
    return out.select("n", F.round("mae", 4).alias("mae"), F.round("r2_score", 6).alias("r2_score"))


@query(f"""select id, price - price * 1.2 * ((mileage % 7) / 5.0) as price_difference, price < price * 1.2 * ((mileage % 7) / 5.0) * 0.9 as is_good_deal from ({ads_sql("id", "price", "mileage")}) a""")
def deal_flags(spark, sf_dir):
    ads = ads_view(spark, sf_dir, "id", "price", "mileage").withColumn("predicted_price", F.col("price") * 1.2 * ((F.col("mileage") % 7) / 5.0))
    return pricing.with_deal(ads).select("id", "price_difference", "is_good_deal")


@query("""select median(year(o_orderdate)) as year, median(cast(l_quantity * 900 as int)) as mileage, median(100 + p_size * 10) as engine_power,
  median(1 + p_size / 10.0) as engine_displacement from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey""")
def feature_medians(spark, sf_dir):
    found = pricing.feature_medians(_ads(spark, sf_dir).select(*fixed.NUMERIC_FEATURES))
    return spark.range(1).select(*[F.lit(v).cast("double").alias(c) for c, v in found.items()])


@query(f"""with a as ({ads_sql("id", "price", "mileage", "year", "engine_power")}),
g as (select id, case when mileage > 20000 then mileage end as mileage, case when year > 1997 then year end as year, case when engine_power > 300 then engine_power end as engine_power from a)
select id, least(0.9, ((mileage is not null)::int + (year is not null)::int + (engine_power is not null)::int) * 0.8 / 3) as confidence from g""")
def prediction_confidence(spark, sf_dir):
    ads = ads_view(spark, sf_dir, "id", "mileage", "year", "engine_power").select(
        "id", F.when(F.col("mileage") > 20000, F.col("mileage")).alias("mileage"), F.when(F.col("year") > 1997, F.col("year")).alias("year"),
        F.when(F.col("engine_power") > 300, F.col("engine_power")).alias("engine_power"),
    )
    return ads.select("id", pricing.completeness(["mileage", "year", "engine_power"]).alias("confidence"))
