"""Keeping an expensive expression from being evaluated several times per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(rows: DataFrame, name: str, column: Column) -> DataFrame:
    """Rows with a column that is computed once per row, whatever uses it.

    The optimizer copies an expression into filters and fields that refer to it, and then works it out
    again in each place. It does not move one out of a generator, and one of a single element adds no rows.
    """
    return rows.withColumn(name, F.explode(F.array(column)))
