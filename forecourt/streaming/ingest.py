"""Incremental ingest: a stream of ads into a table with one row per natural key.

Which keys are known lies in the stream's own state, not in the table: a batch costs its rows and their keys, however
large the table has grown. A streaming aggregate holds each key's first row and the batches in which the key was first
and last seen; rows of one key are combined before they travel, so a key with a large share of the rows is no burden.
A key is new where both batches are the same one. Keys that a table holds already come in as a second stream.

The first batch that shows a key decides; within it the first row by ``order`` (nulls first). Later rows of a known key
add nothing, whatever their time. A row whose key has a null names no ad and is left out. A batch that is run again
after a failure has the time and the state it had before, and writes its folder anew, so replays add nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from forecourt.operators.ingest import AD_KEY

BATCH_COLUMN = "ingest_batch"
STORE = "spark.sql.streaming.stateStore.providerClass"
STORE_CLASS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _before_all() -> Column:
    return F.timestamp_seconds(F.lit(0))


def first_rows(stream: DataFrame, keys: list[str], order: list[str], known: DataFrame | None = None) -> DataFrame:
    """Per key its first row, and when the key was first and last seen. ``known``: a stream of keys that are there."""
    rows = stream.dropna(subset=keys).select(
        *keys, F.struct(*stream.columns).alias("row"), F.current_timestamp().alias("seen"), F.struct(*order).alias("place")
    )
    if known is not None:
        none = lambda name: F.lit(None).cast(rows.schema[name].dataType).alias(name)
        rows = rows.unionByName(known.dropna(subset=keys).select(*keys, none("row"), _before_all().alias("seen"), none("place")))
    return rows.groupBy(*keys).agg(
        F.min_by("row", F.struct("seen", "place")).alias("first"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen")
    )


def write_new(target_path: str, source: str):
    """Batch function: the rows of new keys into the batch's own folder of the target."""

    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.filter((F.col("first_seen") == F.col("last_seen")) & (F.col("first_seen") > _before_all())).select("first.*")
        fresh.write.mode("overwrite").parquet(f"{target_path}/{BATCH_COLUMN}={source}-{batch_id}")

    return write


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB, unless the session names a store itself; a query keeps what it was started with."""
    named = spark.conf.get(STORE, None)
    if named is None or "HDFSBacked" in named:
        spark.conf.set(STORE, STORE_CLASS)
    try:
        yield
    finally:
        if named is not None:
            spark.conf.set(STORE, named)


def start_ingest(
    stream: DataFrame, target_path: str, checkpoint_path: str, keys: list[str] | None = None, order: list[str] | None = None,
    known: DataFrame | None = None,
) -> StreamingQuery:
    """Process everything that is there, then stop; the next start continues behind it.

    ``known``, a stream of the keys of rows stored elsewhere, must be given at every start or at none.
    """
    source = hashlib.md5(checkpoint_path.encode()).hexdigest()[:8]
    with _state_on_disk(stream.sparkSession):
        return (
            first_rows(stream, keys or AD_KEY, order or ["scraped_at"], known)
            .writeStream.outputMode("update").foreachBatch(write_new(target_path, source))
            .option("checkpointLocation", checkpoint_path).trigger(availableNow=True).start()
        )


def read_ingested(spark: SparkSession, target_path: str) -> DataFrame:
    """All rows that were added so far."""
    return spark.read.parquet(target_path).drop(BATCH_COLUMN)


def ad_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None, **options: str) -> DataFrame:
    reader = spark.readStream.schema(schema).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)
