"""Market statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from forecourt.operators import market
from forecourt.plans.bindings import ads_sql, ads_view
from forecourt.plans.registry import query

REF_YEAR = 2001


def _rounded(df, *names, digits=4):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("""select count(*) as total_listings, round(avg(l_extendedprice), 4) as average_price,
  round(median(l_extendedprice), 4) as median_price, min(l_extendedprice) as min_price,
  max(l_extendedprice) as max_price, round(stddev_samp(l_extendedprice), 4) as price_std from lineitem""")
def market_overview(spark, sf_dir):
    out = market.market_overview(ads_view(spark, sf_dir, "price"))
    return _rounded(out, "average_price", "median_price", "price_std")


@query(f"""select year, round(avg(price), 4) as avg_price, count(*) as listing_count
from ({ads_sql("year", "price")}) a where year is not null group by year""")
def price_by_year(spark, sf_dir):
    return _rounded(market.price_by_year(ads_view(spark, sf_dir, "year", "price")), "avg_price")


BUCKETS = f"""with a as ({ads_sql("price", "mileage")}), s as (select min(mileage) as lo, max(mileage) as hi from a),
b as (select price, least(5, greatest(1, cast(ceil((mileage - lo) / ((hi - lo) / 5.0)) as int))) as bucket from a, s)
select n.bucket, n.mileage_bucket, round(avg(price), 4) as avg_price
from (values (1, 'Very Low'), (2, 'Low'), (3, 'Medium'), (4, 'High'), (5, 'Very High')) n(bucket, mileage_bucket)
left join b using (bucket) group by 1, 2"""


@query(BUCKETS)
def price_by_mileage_bucket(spark, sf_dir):
    return _rounded(market.price_by_mileage_bucket(ads_view(spark, sf_dir, "price", "mileage")), "avg_price")


@query(f"""select dealer_type, round(avg(price), 4) as avg_price, count(*) as listing_count,
  round(coalesce(stddev_samp(price), 0), 4) as price_volatility
from ({ads_sql("dealer_type", "price")}) a where dealer_type is not null group by dealer_type""")
def dealer_stats(spark, sf_dir):
    out = market.dealer_stats(ads_view(spark, sf_dir, "dealer_type", "price"))
    return _rounded(out, "avg_price", "price_volatility")


@query(f"""with a as ({ads_sql("price", "year", "mileage")}),
h as (select price, mileage / ({REF_YEAR} - year + 1.0) > 20000 as high from a)
select count(*) filter (where high) as high_mileage_count,
  round((avg(price) - avg(price) filter (where high)) / avg(price), 6) as high_mileage_impact,
  'High mileage reduces value' as condition_factor from h""")
def high_mileage_impact(spark, sf_dir):
    out = market.high_mileage_impact(ads_view(spark, sf_dir, "price", "year", "mileage"), REF_YEAR)
    return _rounded(out, "high_mileage_impact", digits=6)


@query(f"""with a as ({ads_sql("price", "year", "mileage", "dealer_type")}),
b as ({BUCKETS.replace(ads_sql("price", "mileage"), "select price, mileage from (" + ads_sql("price", "mileage") + ") z")}),
h as (select price, mileage / ({REF_YEAR} - year + 1.0) > 20000 as high from a)
select count(*) as total_listings, round(avg(price), 4) as average_price, round(median(price), 4) as median_price,
  min(price) as min_price, max(price) as max_price, round(stddev_samp(price), 4) as price_std,
  (select string_agg(year || ':' || cents || ':' || n, '|' order by year) from (select year, cast(round(avg(price) * 100) as bigint) as cents, count(*) as n from a where year is not null group by year)) as by_year,
  (select string_agg(mileage_bucket || ':' || coalesce(cast(cast(round(avg_price * 100) as bigint) as varchar), ''), '|' order by bucket) from b) as by_mileage,
  (select string_agg(dealer_type || ':' || cents || ':' || n || ':' || deviation, '|' order by dealer_type) from (select dealer_type, cast(round(avg(price) * 100) as bigint) as cents,
    count(*) as n, cast(round(coalesce(stddev_samp(price), 0) * 100) as bigint) as deviation from a where dealer_type is not null group by dealer_type)) as dealers,
  (select round((avg(price) - avg(price) filter (where high)) / avg(price), 6) from h) as high_mileage_impact,
  concat_ws(' | ',
    case when stddev_samp(price) > avg(price) * 0.3 then 'High price volatility - good time for negotiations' end,
    case when max(year) - min(year) > 2 then 'Consider older models for better value' end,
    case when (select max(avg_price) from b where bucket = 2) < 0.8 * (select max(avg_price) from b where bucket = 4)
      then 'Low mileage cars offer good value' end) as recommendations from a""")
def market_report(spark, sf_dir):
    out = market.market_report(ads_view(spark, sf_dir, "price", "year", "mileage", "dealer_type"), REF_YEAR)
    cents = lambda x: F.round(x * 100).cast("bigint").cast("string")
    lines = lambda column, *parts: F.array_join(F.transform(column, lambda e: F.concat_ws(":", *[p(e) for p in parts])), "|")
    return out.select(
        "total_listings", F.round("average_price", 4).alias("average_price"), F.round("median_price", 4).alias("median_price"),
        "min_price", "max_price", F.round("price_std", 4).alias("price_std"),
        lines("by_year", lambda e: e["year"].cast("string"), lambda e: cents(e["avg_price"]), lambda e: e["listing_count"].cast("string")).alias("by_year"),
        lines("by_mileage", lambda e: e["mileage_bucket"], lambda e: F.coalesce(cents(e["avg_price"]), F.lit(""))).alias("by_mileage"),
        lines("dealers", lambda e: e["dealer_type"], lambda e: cents(e["avg_price"]), lambda e: e["listing_count"].cast("string"), lambda e: cents(e["price_volatility"])).alias("dealers"),
        F.round("high_mileage_impact", 6).alias("high_mileage_impact"), F.concat_ws(" | ", "recommendations").alias("recommendations"),
    )
