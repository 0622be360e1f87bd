"""Listing queries: filters, lookups, paging, summary counts, joins to enrichment and anomaly flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt.functions import fixed

MAX_PAGE = 100


def holds(column: Column | str) -> Column:
    """True for a value that counts as given: not null and neither 0 nor empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(0)) != 0


def contains_ignoring_case(column: str, part: str) -> Column:
    return F.contains(F.lower(column), F.lower(F.lit(part)))


def filter_ads(
    ads: DataFrame,
    make: str | None = None,
    model: str | None = None,
    year: int | None = None,
    is_active: bool = True,
) -> DataFrame:
    """Ads by activity and optional make, model (part of the name, any case) and year."""
    out = ads.filter(F.col("is_active") == is_active)
    if make:
        out = out.filter(contains_ignoring_case("make", make))
    if model:
        out = out.filter(contains_ignoring_case("model", model))
    if year:
        out = out.filter(F.col("year") == year)
    return out


def page_of(ads: DataFrame, skip: int = 0, limit: int = 20, tie_break: tuple[str, ...] = ()) -> DataFrame:
    """One page, newest first; ``tie_break`` orders rows that share time and id."""
    if skip < 0 or not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"skip must be >= 0 and limit within 1..{MAX_PAGE}")
    order = [F.desc("scraped_at"), F.desc("id"), *[F.desc(c) for c in tie_break]]
    return ads.orderBy(*order).offset(skip).limit(limit)


def list_ads(ads: DataFrame, skip: int = 0, limit: int = 20, tie_break: tuple[str, ...] = (), **filters) -> DataFrame:
    return page_of(filter_ads(ads, **filters), skip, limit, tie_break)


def latest_active(ads: DataFrame, limit: int = 200) -> DataFrame:
    return ads.filter("is_active").orderBy(F.desc("scraped_at"), F.desc("id")).limit(limit)


def sample_active(ads: DataFrame, limit: int | None = 50, tie_break: tuple[str, ...] = ()) -> DataFrame:
    """The first ``limit`` active ads by id; all of them when the limit is None."""
    active = ads.filter("is_active")
    return active if limit is None else active.orderBy("id", *tie_break).limit(limit)


def latest_enriched(enriched: DataFrame, limit: int = 10) -> DataFrame:
    return enriched.orderBy(F.desc("id")).limit(limit).select(
        "id", "raw_ad_id", "detected_color", "detected_color_confidence"
    )


def get_ad(ads: DataFrame, ad_id: int) -> DataFrame:
    return ads.filter(F.col("id") == ad_id).limit(1)


def get_enriched(enriched: DataFrame, ad_id: int) -> DataFrame:
    return enriched.filter(F.col("raw_ad_id") == ad_id).limit(1)


def training_ads(ads: DataFrame) -> DataFrame:
    return ads.filter(F.col("is_active") & F.col("price").isNotNull())


def priced(ads: DataFrame) -> DataFrame:
    return ads.dropna(subset=["price"])


def feature_columns(ads: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns the price model and the market report read."""
    return ads.select(*keep, *fixed.NUMERIC_FEATURES, *fixed.CATEGORY_FEATURES, "price")


def anomaly_columns(ads: DataFrame) -> DataFrame:
    """Columns the anomaly rules read; missing arrays become empty, missing payloads an empty object."""
    none = F.array().cast("array<string>")
    return ads.select(
        "id", "source_id", "year", "make", "model", "price", "mileage", "dealer_name", "dealer_type",
        "title",
        F.coalesce("image_urls", none).alias("image_urls"),
        F.coalesce("local_image_paths", none).alias("local_image_paths"),
        F.coalesce("raw_data", F.lit("{}")).alias("raw_data"),
    )


def matches_config(
    ads: DataFrame,
    min_price: float | None = None,
    max_price: float | None = None,
    exclude_keywords: tuple[str, ...] = (),
    year_from: int | None = None,
    year_to: int | None = None,
    text_column: str = "title",
) -> DataFrame:
    """The filter block of a scrape configuration; unset bounds are open."""
    out = ads
    for column, low, high in (("price", min_price, max_price), ("year", year_from, year_to)):
        if low is not None:
            out = out.filter(F.col(column) >= low)
        if high is not None:
            out = out.filter(F.col(column) <= high)
    text = F.lower(F.coalesce(text_column, F.lit("")))
    for word in exclude_keywords:
        out = out.filter(~F.contains(text, F.lower(F.lit(word))))
    return out


def acceptable_listing(keyword: str = "BMW", text_column: str = "text_content") -> Column:
    """A listing is kept when it has a price or a year, or its text names the keyword."""
    return (
        holds("price") | holds("year")
        | F.contains(F.coalesce(text_column, F.lit("")), F.lit(keyword))
    )


def with_local_image(ads: DataFrame) -> DataFrame:
    return ads.filter(F.coalesce(F.size("local_image_paths"), F.lit(0)) > 0)


def first_local_image(ads: DataFrame) -> DataFrame:
    return with_local_image(ads).withColumn("image_path", F.get("local_image_paths", F.lit(0)))


def one_owner(images: DataFrame) -> DataFrame:
    """Images that belong to exactly one of an ad, a variant or a car."""
    owners = [F.col(c).isNotNull().cast("int") for c in ("ad_id", "variant_id", "unique_car_id")]
    return images.filter(owners[0] + owners[1] + owners[2] == 1)


def stats_summary(ads: DataFrame, enriched: DataFrame) -> DataFrame:
    """Counts of all, active, processed and enriched ads and the enrichment rate in percent."""
    n_enriched = enriched.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        ads.agg(
            F.count(F.lit(1)).alias("total_ads"),
            F.count_if("is_active").alias("active_ads"),
            F.count_if("is_processed").alias("processed_ads"),
        )
        .withColumn("enriched_ads", n_enriched)
        .withColumn(
            "enrichment_rate",
            F.coalesce(
                F.round(F.try_divide(F.col("enriched_ads") * F.lit(100.0), F.col("total_ads")), 2), F.lit(0.0)
            ),
        )
    )


def flag_anomalies(ads: DataFrame, anomalies: DataFrame, only: bool = False) -> DataFrame:
    """Mark ads that have an anomaly row, or keep only those."""
    flagged = anomalies.select(F.col("ad_id").alias("id")).distinct()
    if only:
        return ads.join(flagged, "id", "left_semi").withColumn("is_anomaly", F.lit(True))
    return ads.join(flagged.withColumn("is_anomaly", F.lit(True)), "id", "left").withColumn(
        "is_anomaly", F.coalesce("is_anomaly", F.lit(False))
    )


def with_enrichment(ads: DataFrame, enriched: DataFrame) -> DataFrame:
    """Listings with the colour and body style found for them, where there is any."""
    extra = enriched.select(
        F.col("raw_ad_id").alias("id"), "detected_color", "detected_color_confidence",
        F.col("body_type").alias("enriched_body_type"),
    )
    return ads.join(extra, "id", "left")


def specs_over(specs: DataFrame, **minimum: float) -> DataFrame:
    """Specs above a bound in each named unit column, e.g. ``specs_over(specs, power_hp=600)``."""
    out = specs
    for column, bound in minimum.items():
        out = out.filter(F.col(column) > bound)
    return out


def in_unit_system(specs: DataFrame, metric: Column | bool) -> DataFrame:
    """Power, torque and length in the reader's unit system."""
    prefers_metric = F.lit(metric) if isinstance(metric, bool) else metric
    pick = lambda a, b: F.when(prefers_metric, F.col(a).cast("double")).otherwise(F.col(b).cast("double"))
    return specs.withColumns({
        "power": pick("power_kw", "power_hp"),
        "torque": pick("torque_nm", "torque_lb_ft"),
        "length": pick("length_mm", "length_in"),
    })
