"""Seeded split into training and validation rows with exact sizes."""

from __future__ import annotations

from math import floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forecourt.operators.ranks import MAX_SORTED, select_ranks

HASH_DIGITS = 13  # 52 bits: exact in a double, so the quantile sketch sees every value as it is


def train_val_split(
    rows: DataFrame, key: str, ratio: float = 0.9, seed: int = 42, max_sorted: int = MAX_SORTED
) -> DataFrame:
    """Mark the first floor(n * ratio) rows in the order of a seeded hash of ``key`` as train.

    ``key`` must be unique. The border hash is found by rank selection and every row compares itself
    with it, so nothing is sorted and the result does not depend on partitioning.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    hashed = rows.withColumn("__digest", digest).withColumn(
        "__number", F.conv(F.substring("__digest", 1, HASH_DIGITS), 16, 10).cast("bigint")
    )
    n = rows.count()
    size = floor(n * ratio)
    if size <= 0 or size >= n:
        return rows.withColumn("split", F.lit("train" if size > 0 else "val"))
    border = select_ranks(hashed, {"__number": [size - 1]}, max_sorted)["__number"][0]
    counts = hashed.agg(
        F.count_if(F.col("__number") < border).alias("below"),
        F.count_if(F.col("__number") == border).alias("ties"),
    ).first()
    is_train = F.col("__number") <= border
    if counts.below + counts.ties > size:
        last = (
            hashed.filter(F.col("__number") == border).orderBy("__digest", key)
            .offset(size - counts.below - 1).limit(1).select("__digest", key).first()
        )
        reached = (F.col("__digest") < last[0]) | ((F.col("__digest") == last[0]) & (F.col(key) <= last[1]))
        is_train = (F.col("__number") < border) | ((F.col("__number") == border) & reached)
    return hashed.withColumn("split", F.when(is_train, F.lit("train")).otherwise(F.lit("val"))).drop(
        "__digest", "__number"
    )
