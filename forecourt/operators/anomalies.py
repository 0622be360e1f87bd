"""Rules that flag suspicious listings, and summaries of what they flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt.functions import fixed
from forecourt.operators.listings import anomaly_columns, holds, sample_active
from forecourt.operators.once import once
from forecourt.operators.skew import ROWS_PER_SPLIT, hot_keys, spread_join
from forecourt.session import cut_lineage

COHORT = ["year", "make", "model"]
BROADCAST_COHORTS = 200_000  # some twenty megabytes
# Characters that separate words: everything Unicode and ASCII call white space. Fixed value.
SPACE = r"[\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def finding(condition: Column, reason: Column, score: Column) -> Column:
    return F.when(condition, F.struct(reason.alias("reason"), score.cast("double").alias("score")))


def with_price_zscore(ads: DataFrame, rows_per_split: int = ROWS_PER_SPLIT, broadcast_cohorts: int = BROADCAST_COHORTS) -> DataFrame:
    """Distance of the price from its cohort (same year, make and model) in population deviations.

    Cohort figures are aggregated before the shuffle, kept, and joined back, so a cohort that holds a large share of all
    ads is never gathered in one task as a window would. Few cohorts are sent to the ads, which then stay where they are.
    """
    counted = holds("price")
    cohorts = cut_lineage(ads.filter(counted).groupBy(*COHORT).agg(
        F.count("price").alias("cohort_n"),
        F.avg("price").alias("cohort_mean"),
        F.stddev_pop("price").alias("cohort_std"),
    ))
    if cohorts.limit(broadcast_cohorts + 1).count() <= broadcast_cohorts:
        small = F.broadcast(cohorts.withColumnsRenamed({k: f"__g_{k}" for k in COHORT}))
        same = counted
        for key in COHORT:
            same = same & F.col(key).eqNullSafe(F.col(f"__g_{key}"))
        joined = ads.join(small, same, "left").drop(*[f"__g_{k}" for k in COHORT])
    else:
        hot = hot_keys(cohorts, COHORT, "cohort_n", rows_per_split=rows_per_split)
        joined = spread_join(ads, cohorts, COHORT, hot, ["id"], "left", wanted=counted)
    distance = F.abs(F.col("price") - F.col("cohort_mean"))
    z = F.when(F.col("cohort_std") > 0, distance / F.col("cohort_std")).otherwise(F.lit(0.0))
    return joined.withColumn("price_z", F.when(counted & (F.col("cohort_n") >= 3), z))


def price_rule() -> Column:
    z = F.col("price_z")
    score = F.when(z > 3, F.least(F.lit(0.4), z * 0.1)).otherwise(F.least(F.lit(0.2), z * 0.05))
    return finding(z > 2, F.format_string("Price %.1f standard deviations from similar cars", z), score)


def mileage_rule(ref_year: int = fixed.REFERENCE_YEAR) -> Column:
    mileage, age = F.col("mileage"), F.lit(ref_year) - F.col("year")
    known = holds("mileage") & holds("year")
    km = F.format_number(mileage, 0)
    low = known & (mileage < 1000) & (age > 1)
    high = known & (mileage.cast("bigint") > age.cast("bigint") * fixed.KM_PER_YEAR * 3)
    return F.coalesce(
        finding(low, F.format_string("Extremely low mileage (%s km) for %d-year-old car", km, age), F.lit(0.3)),
        finding(high, F.format_string("Very high mileage (%s km) for %d-year-old car", km, age), F.lit(0.2)),
    )


def year_rule(ref_year: int = fixed.REFERENCE_YEAR) -> Column:
    year, known = F.col("year"), holds("year")
    return F.coalesce(
        finding(known & (year > ref_year), F.format_string("Future year (%d) - likely data error", year), F.lit(0.5)),
        finding(known & (year < 1990), F.format_string("Very old car (%d) in modern listing", year), F.lit(0.2)),
    )


def dealer_rule() -> Column:
    name = F.coalesce("dealer_name", F.lit(""))
    suspicious = F.rlike(F.lower(name), F.lit("|".join(fixed.SUSPICIOUS_DEALER_WORDS)))
    return F.coalesce(
        finding((name == "") & (F.col("dealer_type") == "dealer"), F.lit("Dealer listing without dealer name"), F.lit(0.1)),
        finding(suspicious, F.concat(F.lit("Suspicious dealer name: "), name), F.lit(0.4)),
    )


def image_rule() -> Column:
    urls = F.coalesce(F.size("image_urls"), F.lit(0))
    files = F.coalesce(F.size("local_image_paths"), F.lit(0))
    return F.coalesce(
        finding((urls <= 0) & (files <= 0), F.lit("No images provided"), F.lit(0.2)),
        finding(urls > 20, F.format_string("Unusually high number of images (%d)", urls), F.lit(0.1)),
    )


def words_of(text: Column) -> Column:
    """The words of a text, split at runs of any white space."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def top_word_count(words: Column) -> Column:
    """How often the most frequent word occurs; the longest run in the sorted words, within the row."""
    start = F.struct(
        F.lit(None).cast("string").alias("word"), F.lit(0).alias("run"), F.lit(0).alias("best")
    )

    def step(state: Column, word: Column) -> Column:
        run = F.when(word == state["word"], state["run"] + 1).otherwise(F.lit(1))
        return F.struct(
            word.alias("word"), run.alias("run"), F.greatest(state["best"], run).alias("best")
        )

    return F.aggregate(F.sort_array(words), start, step, lambda state: state["best"])


def found_keywords(text: Column) -> Column:
    lowered = F.lower(text)
    listed = F.array(*[F.when(F.contains(lowered, F.lit(w)), F.lit(w)) for w in fixed.SUSPICIOUS_TEXT_WORDS])
    return F.filter(listed, lambda w: w.isNotNull())


def text_of(raw_data: str = "raw_data") -> Column:
    return F.coalesce(F.get_json_object(raw_data, "$.text_content"), F.lit(""))


def described(ads: DataFrame, text: Column) -> DataFrame:
    """Ads with the columns the text rule reads: the text, its words and how often the top one occurs.

    Only a text with more than 100 words is split; it has more than 200 characters.
    """
    none = F.array().cast("array<string>")
    return (
        ads.withColumn("__text", text)
        .withColumn("__words", F.when(F.length("__text") > 200, words_of(F.col("__text"))).otherwise(none))
        .withColumn("__top", F.when(F.size("__words") > 100, top_word_count(F.col("__words"))).otherwise(F.lit(0)))
        .withColumn("__keywords", found_keywords(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.col("__text"))))
    )


def text_rule() -> Column:
    keywords = F.col("__keywords")
    return F.coalesce(
        finding(F.size(keywords) > 2, F.concat(F.lit("Suspicious keywords: "), F.array_join(keywords, ", ")), F.lit(0.3)),
        finding(
            (F.size("__words") > 100) & (F.col("__top") > F.size("__words") * F.lit(0.1)),
            F.lit("Excessive word repetition in description"), F.lit(0.2),
        ),
    )


def with_own_findings(ads: DataFrame, ref_year: int = fixed.REFERENCE_YEAR, text: Column | None = None) -> DataFrame:
    """Ads with ``__own``: what the rules find that look at nothing but the ad, in the order mileage, year, dealer, images, text."""
    rows = described(ads, text_of() if text is None else text)
    found = F.array(mileage_rule(ref_year), year_rule(ref_year), dealer_rule(), image_rule(), text_rule())
    return once(rows, "__own", F.filter(found, lambda f: f.isNotNull())).drop("__text", "__words", "__top", "__keywords")


def with_scores(rows: DataFrame, rows_per_split: int = ROWS_PER_SPLIT) -> DataFrame:
    """Ads and their own findings with the price's finding in front, and what follows from all."""
    rows = with_price_zscore(rows, rows_per_split)
    found = F.concat(F.filter(F.array(price_rule()), lambda f: f.isNotNull()), F.col("__own"))
    rows = once(rows, "findings", found).drop("__own")
    total = F.aggregate("findings", F.lit(0.0), lambda acc, f: acc + f["score"])
    return rows.withColumns({
        "is_anomaly": F.size("findings") > 0,
        "anomaly_score": F.least(F.lit(1.0), total),
        "anomaly_reasons": F.transform("findings", lambda f: f["reason"]),
        "confidence": F.least(F.lit(0.9), F.size("findings") * F.lit(0.2)),
    })


def score_ads(
    ads: DataFrame,
    ref_year: int = fixed.REFERENCE_YEAR,
    text: Column | None = None,
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """All findings of every ad, flagged or not, in the order price, mileage, year, dealer, images, text."""
    return with_scores(with_own_findings(ads, ref_year, text), rows_per_split)


def detect_anomalies(
    ads: DataFrame,
    ref_year: int = fixed.REFERENCE_YEAR,
    text: Column | None = None,
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """Flagged ads only.

    Addresses, paths and texts are looked at where the ads are made. The short rows with what was found there are kept,
    so that what made the ads runs once for the cohorts and the scores.
    """
    own = with_own_findings(ads, ref_year, text).select("id", F.coalesce("source_id", F.lit("unknown")).alias("source_id"), *COHORT, "price", "__own")
    return with_scores(cut_lineage(own), rows_per_split).filter("is_anomaly").select(
        F.col("id").alias("ad_id"), "source_id", "anomaly_score", "anomaly_reasons", "confidence",
    )


def anomaly_report(
    ads: DataFrame, limit: int | None = 50, tie_break: tuple[str, ...] = (), **options
) -> DataFrame:
    """Flagged ads among the first ``limit`` active ones (all active ones when None)."""
    return detect_anomalies(anomaly_columns(sample_active(ads, limit, tie_break)), **options)


def reason_counts(anomalies: DataFrame, limit: int | None = 5) -> DataFrame:
    """Most frequent reasons; equal counts keep the order of first appearance (by ad id, then position)."""
    counts = (
        anomalies.select("ad_id", F.posexplode("anomaly_reasons").alias("pos", "reason"))
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("ads"), F.min(F.struct("ad_id", "pos")).alias("first_seen"))
    )
    if limit is None:
        return counts.drop("first_seen")
    return counts.orderBy(F.desc("ads"), "first_seen").limit(limit).drop("first_seen")


def anomaly_summary(anomalies: DataFrame, assumed_total: int = 100) -> DataFrame:
    """Count, rate per ``assumed_total`` listings, mean score and risk level."""
    mean = F.avg("anomaly_score")
    return anomalies.agg(
        F.count(F.lit(1)).alias("total_anomalies"),
        (F.count(F.lit(1)) / F.lit(float(assumed_total))).alias("anomaly_rate"),
        mean.alias("average_anomaly_score"),
        F.when(mean > 0.5, F.lit("high")).when(mean > 0.3, F.lit("medium")).otherwise(F.lit("low")).alias("risk_level"),
    )
