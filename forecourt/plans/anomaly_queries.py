"""Anomaly rules, reports and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from forecourt.functions import fixed
from forecourt.operators import anomalies
from forecourt.operators.once import once
from forecourt.plans.bindings import DOCUMENT_ADS, ads_sql, ads_view, dealt_table, document_ads, full_ads, table, with_images, words_sql
from forecourt.plans.registry import query

REF_YEAR = 2001

ZSCORES = """cohorts as (select year, make, model, count(*) as n, avg(price) as mean, stddev_pop(price) as std from a
  where coalesce(price, 0) <> 0 group by year, make, model),
z as (select a.*, n, case when n >= 3 then case when std > 0 then abs(price - mean) / std else 0 end end as z
  from a left join cohorts c on a.year is not distinct from c.year and a.make is not distinct from c.make
    and a.model is not distinct from c.model and coalesce(a.price, 0) <> 0)"""


@query(f"""with a as ({ads_sql("id", "price", "year", "make", "model")}), {ZSCORES}
select id, n as cohort_n, round(z, 6) as price_z,
  round(case when z > 3 then least(0.4, z * 0.1) when z > 2 then least(0.2, z * 0.05) end, 6) as price_score from z""")
def price_zscore(spark, sf_dir):
    ads = ads_view(spark, sf_dir, "id", "price", "year", "make", "model")
    return anomalies.with_price_zscore(ads).select(
        "id", "cohort_n", F.round("price_z", 6).alias("price_z"),
        F.round(anomalies.price_rule()["score"], 6).alias("price_score"),
    )


def _rule(ads, rule):
    return ads.select("id", rule.alias("found")).filter("found is not null").select(
        "id", "found.reason", "found.score"
    )


MILEAGE_SQL = """case when coalesce(mileage, 0) <> 0 and coalesce(year, 0) <> 0 then
  case when mileage < 1000 and {ref} - year > 1 then 'Extremely low mileage (' || format('{{:,}}', mileage) || ' km) for ' || ({ref} - year) || '-year-old car'
       when mileage > ({ref} - year) * 45000 then 'Very high mileage (' || format('{{:,}}', mileage) || ' km) for ' || ({ref} - year) || '-year-old car' end end"""
YEAR_SQL = """case when coalesce(year, 0) <> 0 then case when year > {ref} then 'Future year (' || year || ') - likely data error'
  when year < 1990 then 'Very old car (' || year || ') in modern listing' end end"""
DEALER_SQL = """case when coalesce(dealer_name, '') = '' and dealer_type = 'dealer' then 'Dealer listing without dealer name'
  when regexp_matches(lower(coalesce(dealer_name, '')), 'test|demo|fake|scam|fraud') then 'Suspicious dealer name: ' || dealer_name end"""
SCORE_SQL = """case when {r} like 'Extremely%' then 0.3 when {r} like 'Very high%' then 0.2 when {r} like 'Future%' then 0.5
  when {r} like 'Very old%' then 0.2 when {r} like 'Dealer%' then 0.1 when {r} like 'Suspicious dealer%' then 0.4
  when {r} like 'No images%' then 0.2 when {r} like 'Unusually%' then 0.1 when {r} like 'Suspicious keywords%' then 0.3
  when {r} like 'Excessive%' then 0.2 else 0 end"""


def _rule_sql(columns, expression, ref=REF_YEAR):
    return f"""with a as ({ads_sql(*columns)}), r as (select id, {expression.format(ref=ref)} as reason from a)
select id, reason, cast({SCORE_SQL.format(r="reason")} as double) as score from r where reason is not null"""


@query(_rule_sql(("id", "mileage", "year"), MILEAGE_SQL))
def rule_mileage(spark, sf_dir):
    return _rule(ads_view(spark, sf_dir, "id", "mileage", "year"), anomalies.mileage_rule(REF_YEAR))


@query(_rule_sql(("id", "year"), YEAR_SQL, 1999))
def rule_year(spark, sf_dir):
    return _rule(ads_view(spark, sf_dir, "id", "year"), anomalies.year_rule(1999))


@query(f"""with a as ({DOCUMENT_ADS}), r as (select id, {DEALER_SQL} as reason from a)
select id, reason, cast({SCORE_SQL.format(r="reason")} as double) as score from r where reason is not null""")
def rule_dealer(spark, sf_dir):
    return _rule(document_ads(spark, sf_dir), anomalies.dealer_rule())


IMAGES_SQL = """case when image_count = 0 {and_no_files} then 'No images provided'
  when image_count > 20 then 'Unusually high number of images (' || image_count || ')' end"""


@query(_rule_sql(("id", "image_count", "is_processed"), IMAGES_SQL.format(and_no_files="and not is_processed")))
def rule_images(spark, sf_dir):
    return _rule(with_images(ads_view(spark, sf_dir, "id", "image_count", "image_path", "is_processed", wide=True)), anomalies.image_rule())


WORD_COUNTS = f"""words as (select id, unnest({words_sql("text")}) as w from a),
counts as (select id, w, count(*) as n from words group by id, w),
tops as (select id, sum(n) as n_words, max(n) as top from counts group by id)"""


@query(f"""with a as (select doc_id as id, text from documents), {WORD_COUNTS}
select id as doc_id, cast(n_words as bigint) as n_words, cast(top as bigint) as top_count, n_words > 100 and top > n_words * 0.1 as repetitive from tops""")
def text_repetition(spark, sf_dir):
    docs = dealt_table(spark, sf_dir, "documents", "doc_id", "text")
    rows = once(docs, "words", anomalies.words_of(F.col("text"))).filter(F.size("words") > 0)
    counted = once(rows, "top", anomalies.top_word_count(F.col("words")))
    n = F.size("words")
    return counted.select(
        "doc_id", n.cast("bigint").alias("n_words"), F.col("top").cast("bigint").alias("top_count"),
        ((n > 100) & (F.col("top") > n * 0.1)).alias("repetitive"),
    )


KEYWORDS_SQL = "list_filter([" + ", ".join(f"'{w}'" for w in fixed.SUSPICIOUS_TEXT_WORDS) + "], lambda k: contains(lower({text}), k))"


@query(f"""select conv_id, turn, array_to_string({KEYWORDS_SQL.format(text="text")}, ', ') as keywords,
  cast(len({KEYWORDS_SQL.format(text="text")}) as bigint) as n_keywords from conversations""")
def text_keywords(spark, sf_dir):
    found = anomalies.found_keywords(F.col("text"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.array_join(found, ", ").alias("keywords"), F.size(found).cast("bigint").alias("n_keywords")
    )


def _report_sql(ads, ref, images, text):
    text_parts = (
        f", {WORD_COUNTS}, t as (select z.*, n_words, top from z left join tops using (id))" if text
        else ", t as (select *, 0 as n_words, 0 as top from z)"
    )
    described = "coalesce(title, '') || ' ' || " + ("text" if text else "''")
    return f"""with a as (select * from ({ads}) x where is_active), {ZSCORES}{text_parts},
r as (select id, source_id, z,
  [case when z > 2 then 'Price ' || format('{{:.1f}}', z) || ' standard deviations from similar cars' end,
   {MILEAGE_SQL.format(ref=ref)}, {YEAR_SQL.format(ref=ref)}, {DEALER_SQL}, {images},
   case when len({KEYWORDS_SQL.format(text=described)}) > 2 then 'Suspicious keywords: ' || array_to_string({KEYWORDS_SQL.format(text=described)}, ', ')
        when n_words > 100 and top > n_words * 0.1 then 'Excessive word repetition in description' end] as all_reasons
  from t),
f as (select id, source_id, z, list_filter(all_reasons, lambda x: x is not null) as reasons from r),
report as (select id as ad_id, source_id, reasons,
  least(1.0, list_sum(list_transform(reasons, lambda x: {SCORE_SQL.format(r="x")}))
    + case when z > 3 then least(0.4, z * 0.1) when z > 2 then least(0.2, z * 0.05) else 0 end) as score,
  least(0.9, len(reasons) * 0.2) as confidence from f where len(reasons) > 0)"""


AD_FIELDS = ("id", "source_id", "title", "price", "year", "make", "model", "mileage", "dealer_name", "dealer_type",
             "image_count", "is_active", "is_processed")
ADS_REPORT = _report_sql(ads_sql(*AD_FIELDS), REF_YEAR, IMAGES_SQL.format(and_no_files="and not is_processed"), False)
DOCS_REPORT = _report_sql(DOCUMENT_ADS, 2024, IMAGES_SQL.format(and_no_files=""), True)
REPORT_COLUMNS = """select ad_id, source_id, round(score, 6) as anomaly_score, array_to_string(reasons, ' | ') as reasons,
  round(confidence, 4) as confidence from report"""


def _shown(report):
    return report.select(
        "ad_id", "source_id", F.round("anomaly_score", 6).alias("anomaly_score"),
        F.array_join("anomaly_reasons", " | ").alias("reasons"), F.round("confidence", 4).alias("confidence"),
    )


def _ads_report(spark, sf_dir):
    return anomalies.anomaly_report(full_ads(spark, sf_dir), None, ref_year=REF_YEAR)


def _documents_report(spark, sf_dir):
    return anomalies.anomaly_report(document_ads(spark, sf_dir), None)


@query(f"{ADS_REPORT} {REPORT_COLUMNS}")
def anomaly_report(spark, sf_dir):
    return _shown(_ads_report(spark, sf_dir))


SAMPLE = f"(select * from ({ads_sql(*AD_FIELDS)}) a where is_active order by id, price limit 50)"
SAMPLE_REPORT = _report_sql(f"select * from {SAMPLE} s", REF_YEAR, IMAGES_SQL.format(and_no_files="and not is_processed"), False)


@query(f"{SAMPLE_REPORT} {REPORT_COLUMNS}")
def anomaly_report_sample(spark, sf_dir):
    """The report over the first fifty active ads, as it is by default."""
    return _shown(anomalies.anomaly_report(full_ads(spark, sf_dir), tie_break=("price",), ref_year=REF_YEAR))


@query(f"{DOCS_REPORT} {REPORT_COLUMNS}")
def anomaly_report_documents(spark, sf_dir):
    return _shown(_documents_report(spark, sf_dir))


@query(f"""{ADS_REPORT}, e as (select ad_id, unnest(reasons) as reason, generate_subscripts(reasons, 1) as pos from report)
select reason, count(*) as ads from e group by reason order by count(*) desc, min((ad_id, pos)) limit 5""")
def anomaly_reasons_top5(spark, sf_dir):
    return anomalies.reason_counts(_ads_report(spark, sf_dir), 5)


@query(f"""{DOCS_REPORT} select count(*) as total_anomalies, round(count(*) / 100.0, 4) as anomaly_rate,
  round(avg(score), 6) as average_anomaly_score,
  case when avg(score) > 0.5 then 'high' when avg(score) > 0.3 then 'medium' else 'low' end as risk_level from report""")
def anomaly_summary(spark, sf_dir):
    out = anomalies.anomaly_summary(_documents_report(spark, sf_dir))
    return out.withColumns({"anomaly_rate": F.round("anomaly_rate", 4), "average_anomaly_score": F.round("average_anomaly_score", 6)})
