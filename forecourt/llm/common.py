"""What the corpus operators share: tables, row batches, checked broadcasts."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from forecourt.session import cut_lineage, ensure_checkpoint_dir, ship_package, shared_folder  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with this package on the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(function, schema)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(),
          "array<long>": pa.list_(pa.int64())}


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a list of columns of plain types; needs no session, so tasks can ask for it."""
    return pa.schema([pa.field(name, _TYPES[kind]) for name, kind in (column.split() for column in ddl.split(", "))])


def power_of_two(n: float, least: int = 1) -> int:
    return max(least, 1 << max(0, math.ceil(math.log2(max(n, 1)))))


class Shared:
    """A value every task needs once: sent by Spark's broadcast, loaded once by each worker process."""

    def __init__(self, spark: SparkSession, value: Any) -> None:
        self.sent = spark.sparkContext.broadcast(value)

    def value(self) -> Any:
        return self.sent.value
