"""Market statistics over priced listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt.functions import fixed
from forecourt.operators.listings import priced
from forecourt.operators.ranks import MAX_SORTED, exact_median
from forecourt.session import cut_lineage

HIGH_KM_PER_YEAR = 20_000


def market_overview(ads: DataFrame, max_sorted: int = MAX_SORTED) -> DataFrame:
    """Count, mean, exact median, range and sample deviation of the price."""
    rows = priced(ads)
    return rows.agg(
        F.count("price").alias("total_listings"),
        F.avg("price").alias("average_price"),
        F.lit(exact_median(rows, "price", max_sorted)).cast("double").alias("median_price"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        F.stddev_samp("price").alias("price_std"),
    )


def price_by_year(ads: DataFrame) -> DataFrame:
    return (
        priced(ads).filter(F.col("year").isNotNull()).groupBy("year")
        .agg(F.avg("price").alias("avg_price"), F.count("price").alias("listing_count"))
    )


def equal_width_bucket(value: Column, low: Column, high: Column, bins: int) -> Column:
    """1-based right-closed bucket of ``bins`` equal widths between low and high; the low edge is in bucket 1."""
    width = (high - low) / F.lit(float(bins))
    found = F.least(F.lit(bins), F.greatest(F.lit(1), F.ceil(F.try_divide(value - low, width)).cast("int")))
    middle = F.lit(bins // 2 + 1)
    return F.when(value.isNull(), F.lit(None).cast("int")).when(high == low, middle).otherwise(found)


def price_by_mileage_bucket(ads: DataFrame) -> DataFrame:
    """Mean price per mileage bucket; all five labels appear, empty ones without a price."""
    rows = priced(ads).select("price", F.col("mileage").cast("double").alias("mileage"))
    span = rows.agg(F.min("mileage").alias("low"), F.max("mileage").alias("high"))
    labels = fixed.MILEAGE_LABELS
    bucket = equal_width_bucket(
        F.col("mileage"), span.select("low").scalar(), span.select("high").scalar(), len(labels)
    )
    means = (
        rows.filter(F.col("mileage").isNotNull()).select("price", bucket.alias("bucket"))
        .groupBy("bucket").agg(F.avg("price").alias("avg_price"))
    )
    names = rows.sparkSession.createDataFrame(
        [(i + 1, label) for i, label in enumerate(labels)], "bucket int, mileage_bucket string"
    )
    return names.join(means, "bucket", "left").select("bucket", "mileage_bucket", "avg_price")


def dealer_stats(ads: DataFrame) -> DataFrame:
    """Mean, count and sample deviation per dealer type; a single listing has volatility 0."""
    return (
        priced(ads).filter(F.col("dealer_type").isNotNull()).groupBy("dealer_type")
        .agg(
            F.avg("price").alias("avg_price"),
            F.count("price").alias("listing_count"),
            F.coalesce(F.stddev_samp("price"), F.lit(0.0)).alias("price_volatility"),
        )
    )


def car_age(ref_year: int = fixed.REFERENCE_YEAR) -> Column:
    return F.lit(ref_year) - F.col("year")


def km_per_year(ref_year: int = fixed.REFERENCE_YEAR) -> Column:
    """Kilometres per year of use, counting the first year; null where that count is zero."""
    return F.try_divide(F.col("mileage").cast("double"), (car_age(ref_year) + 1).cast("double"))


def is_high_mileage(ref_year: int = fixed.REFERENCE_YEAR) -> Column:
    unbounded = (car_age(ref_year) + 1 == 0) & (F.col("mileage") > 0)
    return F.coalesce(unbounded | (km_per_year(ref_year) > HIGH_KM_PER_YEAR), F.lit(False))


def high_mileage_impact(ads: DataFrame, ref_year: int = fixed.REFERENCE_YEAR) -> DataFrame:
    """Share of the mean price that heavily used cars lose, 0 without any."""
    high = is_high_mileage(ref_year)
    mean, high_mean = F.avg("price"), F.avg(F.when(high, F.col("price")))
    return priced(ads).agg(
        F.count_if(high).alias("high_mileage_count"),
        F.coalesce(F.try_divide(mean - high_mean, mean), F.lit(0.0)).alias("high_mileage_impact"),
        F.when(F.count_if(high) > 0, F.lit(fixed.HIGH_MILEAGE_FACTOR)).alias("condition_factor"),
    )


def market_report(
    ads: DataFrame, ref_year: int = fixed.REFERENCE_YEAR, max_sorted: int = MAX_SORTED
) -> DataFrame:
    """Every market figure in one row: overview, by year, by mileage, by dealer, condition and advice.

    The nested arrays hold one entry per year, per label and per dealer type.
    """
    def gathered(df: DataFrame, order: str) -> Column:
        first = F.col(order)
        entry = F.struct(first, *[F.col(c) for c in df.columns if c != order])
        return df.agg(F.sort_array(F.collect_list(entry)).alias("entries")).scalar()

    # Six figures and the median's passes read it: what joins made the ads runs once.
    ads = cut_lineage(ads.select("price", "year", "mileage", "dealer_type"))
    condition = high_mileage_impact(ads, ref_year)
    out = market_overview(ads, max_sorted).withColumns({
        "by_year": gathered(price_by_year(ads), "year"),
        "by_mileage": gathered(price_by_mileage_bucket(ads), "bucket"),
        "dealers": gathered(dealer_stats(ads), "dealer_type"),
        "high_mileage_impact": condition.select("high_mileage_impact").scalar(),
        "condition_factor": condition.select("condition_factor").scalar(),
    })
    return out.withColumns({
        "recommendations": recommendations(),
        "error": F.when(F.col("total_listings") == 0, F.lit("No price data available")),
    })


def recommendations() -> Column:
    """Advice texts that apply to a market report row, in fixed order."""
    years = F.col("by_year")
    mean_of = lambda label: F.get(
        F.filter("by_mileage", lambda b: b["mileage_bucket"] == label), F.lit(0)
    )["avg_price"]
    span = F.element_at(years, -1)["year"] - F.element_at(years, 1)["year"]
    volatile = F.col("price_std") > F.col("average_price") * 0.3
    older = F.when(F.size(years) > 1, span > 2)
    low = mean_of("Low") < mean_of("High") * 0.8
    advice = F.array(
        F.when(volatile, F.lit(fixed.ADVICE_VOLATILE)),
        F.when(older, F.lit(fixed.ADVICE_OLDER)),
        F.when(low, F.lit(fixed.ADVICE_LOW_MILEAGE)),
    )
    return F.filter(advice, lambda text: text.isNotNull())
