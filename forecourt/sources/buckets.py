"""Tables laid out by buckets of a key's hash, so that an upsert rewrites only the buckets its batch touches.

A bucket is a partition folder; rows of a key lie in one bucket. An upsert reads the touched buckets, merges, and overwrites
just those partitions: tasks write beside the table, and the folders change places when all of them are done. A job that dies
before leaves the table as it was, and running the batch again gives the same table. Choose ``n_buckets`` so that a bucket fits a
task comfortably (some hundred megabytes); it belongs to the table and must not change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forecourt.operators.ingest import upsert
from forecourt.sources.tables import path_exists

BUCKET = "key_bucket"


def bucket_of(keys: list[str], n_buckets: int) -> Column:
    """Bucket of a key; nulls count as a value of their own."""
    return F.pmod(F.xxhash64(*keys), F.lit(n_buckets)).cast("int")


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def write_buckets(rows: DataFrame, path: str, keys: list[str], n_buckets: int) -> None:
    """Write rows into their buckets, in place of what those buckets hold; others stay untouched."""
    placed = rows.withColumn(BUCKET, bucket_of(keys, n_buckets))
    (
        placed.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(BUCKET).parquet(path)
    )


def upsert_buckets(
    path: str, batch: DataFrame, keys: list[str], order: str, update: list[str], insert: list[str] | None = None,
    id_column: str | None = "id", n_buckets: int = 256, columns: DataFrame | None = None,
) -> list[int]:
    """Apply a batch to the table at ``path`` (see ``ingest.upsert``); returns the buckets that were rewritten.

    ``columns`` gives the table's columns where it does not exist yet. Only touched buckets are read and written; the
    list of touched ones is as long as the table has buckets at most.
    """
    spark = batch.sparkSession
    touched = sorted(r[0] for r in batch.select(bucket_of(keys, n_buckets).alias("b")).distinct().collect())
    if not touched:
        return []
    if path_exists(spark, path):
        stored = spark.read.parquet(path)
        target = stored.filter(F.col(BUCKET).isin(touched)).drop(BUCKET)
    else:
        target = spark.createDataFrame([], (columns or batch).schema)
    write_buckets(upsert(target, batch, keys, order, update, insert, id_column), path, keys, n_buckets)
    return touched
