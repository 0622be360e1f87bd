"""Idempotent ingest: insert-if-absent, upsert, image checksums, new-ad rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AD_KEY = ["source_site", "source_id"]


def first_per_key(rows: DataFrame, keys: list[str], *order: Column | str, keep: int = 1) -> DataFrame:
    """The first ``keep`` rows per key.

    Spark limits each group before the shuffle for this filter, so a key that holds a large share of
    the rows sends only ``keep`` rows per task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__rank", rank).filter(F.col("__rank") <= keep).drop("__rank")


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Rows of several sources under one schema; columns a source lacks are null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def surrogate_key(*natural: str) -> Column:
    return F.xxhash64(*natural)


def rows_to_insert(target: DataFrame, batch: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """Rows of the batch whose key is new, the first of each key."""
    fresh = first_per_key(batch, keys, *order)
    return fresh.join(target.select(*keys), keys, "left_anti").select(*batch.columns)


def insert_if_absent(target: DataFrame, batch: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """Target with the new rows of the batch; present rows stay as they are."""
    fresh = rows_to_insert(target, batch, keys, *order).select(
        *[c for c in batch.columns if c in target.columns]
    )
    return target.unionByName(fresh, allowMissingColumns=True)


def upsert(
    target: DataFrame,
    batch: DataFrame,
    keys: list[str],
    order: str,
    update: list[str],
    insert: list[str] | None = None,
    id_column: str | None = "id",
) -> DataFrame:
    """Target after applying the batch row by row in ``order``.

    A present key takes the last values of the ``update`` columns. A new key also takes the first
    values of the ``insert`` columns and an id made of its key.
    """
    insert = insert or []
    latest = batch.groupBy(*keys).agg(
        F.min_by(F.struct(F.lit(True).alias("__given"), *insert), order).alias("__first"),
        F.max_by(F.struct(F.lit(True).alias("__given"), *update), order).alias("__last"),
    )
    # Unique keys on both sides: one shuffle each, no skew.
    old = target.withColumn("__old", F.lit(True))
    joined = old.join(latest, keys, "full_outer")
    columns = []
    for name in target.columns:
        if name in keys:
            column = F.col(name)
        elif name in update:
            column = F.when(F.col("__last").isNotNull(), F.col("__last")[name]).otherwise(F.col(name))
        elif name in insert:
            column = F.when(F.col("__old"), F.col(name)).otherwise(F.col("__first")[name])
        elif name == id_column:
            column = F.coalesce(F.col(name), surrogate_key(*keys))
        else:
            column = F.col(name)
        columns.append(column.alias(name))
    return joined.select(*columns)


def new_images(known: DataFrame, batch: DataFrame, *order: Column | str) -> DataFrame:
    """Images whose checksum is not known yet, one per checksum over all ads."""
    return rows_to_insert(known, batch, ["checksum"], *order)


def ads_to_keep(batch: DataFrame, known_ads: DataFrame, fresh_images: DataFrame, ad_key: list[str] = AD_KEY) -> DataFrame:
    """Batch ads that are known already, or that bring at least one new image."""
    known = batch.join(known_ads.select(*ad_key), ad_key, "left_semi")
    unknown = batch.join(known_ads.select(*ad_key), ad_key, "left_anti")
    return known.unionByName(unknown.join(fresh_images.select(*ad_key), ad_key, "left_semi"))


def update_or_create_ads(target: DataFrame, batch: DataFrame, order: str = "last_scraped_at") -> DataFrame:
    """Auction ads: known ones get a new title, payload and time, new ones start active."""
    columns = [c for c in ("raw_title", "raw_data", "last_scraped_at") if c in target.columns]
    rows = batch.withColumn("is_active", F.lit(True))
    return upsert(target, rows, AD_KEY, order, columns, ["source_url", "is_active"])
