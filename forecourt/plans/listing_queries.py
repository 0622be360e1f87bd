"""Listing lookups, filters, paging and summary counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from forecourt.operators import listings
from forecourt.plans.bindings import (
    LINE_ID,
    ads_sql, ads_view, enriched_sql, enriched_view, full_ads, spec_texts, spec_texts_sql, table, with_images,
)
from forecourt.plans.registry import query

PAGE = ("id", "source_site", "title", "price", "currency", "year", "make", "model", "scraped_at", "is_active")
SHOWN = "id, source_site, title, price, currency, year, make, model, cast(cast(scraped_at as date) as string) as scraped_on"


def _shown(df):
    return df.selectExpr(*SHOWN.replace("cast(cast(scraped_at as date) as string) as scraped_on", "").split(", ")[:-1],
                         "cast(cast(scraped_at as date) as string) as scraped_on")


@query(f"""with ads as ({ads_sql("id", "price", "model", "is_active", "is_processed")}), enriched as ({enriched_sql()})
select count(*) as total_ads, count(*) filter (where is_active) as active_ads,
  count(*) filter (where is_processed) as processed_ads, (select count(*) from enriched) as enriched_ads,
  round((select count(*) from enriched) * 100.0 / count(*), 2) as enrichment_rate from ads""")
def stats_summary(spark, sf_dir):
    return listings.stats_summary(
        ads_view(spark, sf_dir, "is_active", "is_processed"), enriched_view(spark, sf_dir)
    )


@query(f"""with ads as ({ads_sql(*PAGE)})
select {SHOWN} from ads where is_active and lower(make) like '%brand#1%' and lower(model) like '%eco%' and year = 1998
order by scraped_at desc, id desc, price desc limit 20 offset 10""")
def list_listings(spark, sf_dir):
    ads = ads_view(spark, sf_dir, *PAGE)
    return _shown(listings.list_ads(ads, 10, 20, ("price",), make="BRAND#1", model="eco", year=1998))


@query(f"""with ads as ({ads_sql(*PAGE)})
select {SHOWN} from ads where is_active order by scraped_at desc, id desc limit 200""")
def latest_listings(spark, sf_dir):
    return _shown(listings.latest_active(ads_view(spark, sf_dir, *PAGE), 200))


@query(f"""with ads as ({ads_sql(*PAGE)}) select {SHOWN} from ads where id = (select max(id) from ads)""")
def listing_by_id(spark, sf_dir):
    ads = ads_view(spark, sf_dir, *PAGE)
    newest = ads_view(spark, sf_dir, "id").agg(F.max("id").alias("id")).scalar()
    return _shown(listings.get_ad(ads, newest))


@query(f"""with ads as ({ads_sql("id", "price", "model", "is_processed")}), enriched as ({enriched_sql()})
select id, raw_ad_id, detected_color, detected_color_confidence from enriched where raw_ad_id = (select max(raw_ad_id) from enriched)""")
def enriched_by_ad(spark, sf_dir):
    enriched = enriched_view(spark, sf_dir)
    last = enriched.agg(F.max("raw_ad_id").alias("id")).scalar()
    return listings.get_enriched(enriched, last).drop("body_type")


@query(f"""with ads as ({ads_sql("id", "price", "model", "is_processed")}), enriched as ({enriched_sql()})
select id, raw_ad_id, detected_color, detected_color_confidence from enriched order by id desc limit 10""")
def latest_enriched(spark, sf_dir):
    return listings.latest_enriched(enriched_view(spark, sf_dir), 10)


@query(f"""with ads as ({ads_sql("id", "title", "price", "year")})
select id, title, price, year from ads where price >= 50000 and price <= 200000 and year >= 1998
and not (contains(title, 'old') or contains(title, 'bolt') or contains(title, 'anvil'))""")
def config_filter(spark, sf_dir):
    return listings.matches_config(
        ads_view(spark, sf_dir, "id", "title", "price", "year"), 50000, 200000, ("old", "Bolt", "anvil"), 1998
    )


@query(f"""with ads as ({ads_sql("id", "price", "year", "is_active", "image_count", "is_processed")})
select count(*) as ads, count(*) filter (where is_active and price is not null) as training_ads,
  count(*) filter (where image_count <> 0) as counted_images from ads""")
def usable_listings(spark, sf_dir):
    ads = ads_view(spark, sf_dir, "id", "price", "year", "is_active", "image_count")
    training = listings.training_ads(ads).agg(F.count(F.lit(1)).alias("n")).scalar()
    return ads.agg(
        F.count(F.lit(1)).alias("ads"), F.max(training).alias("training_ads"),
        F.count_if(listings.holds("image_count")).alias("counted_images"),
    )


@query(f"""with ads as ({ads_sql("id", "image_path", "is_processed")}) select id, image_path from ads where is_processed""")
def first_local_images(spark, sf_dir):
    ads = with_images(ads_view(spark, sf_dir, "id", "image_path", "image_count", "is_processed"))
    return listings.first_local_image(ads.drop("image_path")).select("id", "image_path")


@query(f"""with ads as ({ads_sql("id", "title", "price", "model", "is_processed")}), enriched as ({enriched_sql()})
select a.id, a.title, a.price, e.detected_color, e.detected_color_confidence, e.body_type as enriched_body_type
from ads a left join enriched e on a.id = e.raw_ad_id""")
def listings_with_enrichment(spark, sf_dir):
    ads = ads_view(spark, sf_dir, "id", "title", "price")
    return listings.with_enrichment(ads, enriched_view(spark, sf_dir))


@query(f"""with ads as ({ads_sql("id", "title", "mileage", "year")})
select id, title, (mileage < 1000 and 2001 - year > 1) or mileage > (2001 - year) * 45000 as is_anomaly from ads""")
def flagged_listings(spark, sf_dir):
    from forecourt.operators.anomalies import mileage_rule

    ads = ads_view(spark, sf_dir, "id", "title", "mileage", "year")
    anomalies = ads.filter(mileage_rule(2001).isNotNull()).select(F.col("id").alias("ad_id"))
    return listings.flag_anomalies(ads, anomalies).select("id", "title", "is_anomaly")


@query(f"""with ads as ({ads_sql("id", "title", "mileage", "year")})
select id, title from ads where (mileage < 1000 and 2001 - year > 1) or mileage > (2001 - year) * 45000""")
def only_flagged_listings(spark, sf_dir):
    from forecourt.operators.anomalies import mileage_rule

    ads = ads_view(spark, sf_dir, "id", "title", "mileage", "year")
    anomalies = ads.filter(mileage_rule(2001).isNotNull()).select(F.col("id").alias("ad_id"))
    return listings.flag_anomalies(ads, anomalies, only=True).select("id", "title")


OWNED = f"""select id, case when l_returnflag <> 'A' then l_orderkey end as ad_id,
  case when l_returnflag = 'A' then l_partkey end as variant_id,
  case when l_linestatus = 'O' then l_suppkey end as unique_car_id
from (select {LINE_ID} as id, * from {{lineitem}})"""


@query(f"""select id, ad_id, variant_id, unique_car_id from ({OWNED.format(lineitem="lineitem")}) x
where (ad_id is not null)::int + (variant_id is not null)::int + (unique_car_id is not null)::int = 1""")
def images_with_one_owner(spark, sf_dir):
    images = spark.sql(OWNED, lineitem=table(spark, sf_dir, "lineitem"))
    return listings.one_owner(images)


UNIT_SPECS = """select p_partkey as version_id, 60 + p_size as power_kw, 80 + p_size as power_hp, 140 + p_size * 10 as torque_nm,
  100 + p_size as torque_lb_ft, 4000 + p_size * 30 as length_mm, cast(150 + p_size as double) as length_in, p_size % 2 = 0 as metric from {part}"""


@query(f"""select version_id, power_hp, torque_nm, length_mm from ({UNIT_SPECS.format(part="part")}) s
where power_hp > 100 and torque_nm > 400 and length_mm > 5000""")
def powerful_versions(spark, sf_dir):
    specs = spark.sql(UNIT_SPECS, part=table(spark, sf_dir, "part"))
    return listings.specs_over(specs, power_hp=100, torque_nm=400, length_mm=5000).select(
        "version_id", "power_hp", "torque_nm", "length_mm"
    )


@query(f"""select version_id, cast(case when metric then power_kw else power_hp end as double) as power,
  cast(case when metric then torque_nm else torque_lb_ft end as double) as torque,
  cast(case when metric then length_mm else length_in end as double) as length from ({UNIT_SPECS.format(part="part")}) s""")
def unit_system(spark, sf_dir):
    specs = spark.sql(UNIT_SPECS, part=table(spark, sf_dir, "part"))
    return listings.in_unit_system(specs, F.col("metric")).select("version_id", "power", "torque", "length")


FEATURES = ("id", "price", "year", "mileage", "engine_power", "engine_displacement", "fuel_type", "transmission", "body_type", "color", "dealer_type")


@query(f"""select id, year, mileage, engine_power, engine_displacement, fuel_type, transmission, body_type, color, dealer_type, price
from (select a.*, row_number() over (order by id, price) as n from ({ads_sql(*FEATURES, "is_active")}) a where is_active) x where n <= 100""")
def feature_sample(spark, sf_dir):
    """What the price model reads of the first hundred active ads."""
    ads = ads_view(spark, sf_dir, *FEATURES, "is_active")
    return listings.feature_columns(listings.sample_active(ads, 100, ("price",)), ("id",))


@query(f"""select id, source_id, year, make, model, price, mileage, dealer_name, dealer_type, title,
  case when image_count % 3 = 0 then 0 else least(image_count, 2) end as n_urls, 0 as n_paths, case when mileage % 2 = 0 then '{{}}' else title end as raw_data
from ({ads_sql("id", "source_id", "year", "make", "model", "price", "mileage", "dealer_name", "dealer_type", "title", "image_count")}) a""")
def anomaly_inputs(spark, sf_dir):
    """What the anomaly rules read; missing addresses, paths and payloads become empty."""
    ads = ads_view(spark, sf_dir, "id", "source_id", "year", "make", "model", "price", "mileage", "dealer_name", "dealer_type", "title", "image_count")
    numbers = F.sequence(F.lit(1), F.least("image_count", F.lit(2))).cast("array<string>")
    gaps = ads.withColumns({
        "image_urls": F.when(F.col("image_count") % 3 != 0, numbers), "local_image_paths": F.lit(None).cast("array<string>"),
        "raw_data": F.when(F.col("mileage") % 2 != 0, F.col("title")),
    })
    rows = listings.anomaly_columns(gaps)
    return rows.withColumns({"n_urls": F.size("image_urls"), "n_paths": F.size("local_image_paths")}).drop("image_urls", "local_image_paths")
