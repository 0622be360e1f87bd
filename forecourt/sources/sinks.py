"""Files the engine writes for other tools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECORD = ["local_path", "file_hash", "phash", "ad_id", "make", "model", "year"]


def records_as_text(records: DataFrame, *keep: str) -> DataFrame:
    """Image records with empty text for missing values."""
    return records.select(*keep, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in RECORD])


def write_metadata_csv(records: DataFrame, path: str) -> None:
    records_as_text(records).write.csv(path, header=True, emptyValue="")


def labelling_tasks(records: DataFrame) -> DataFrame:
    """One review task per image: its address and what is known about it."""
    return records.select(
        F.struct(F.col("local_path").alias("image")).alias("data"),
        F.struct("ad_id", "make", "model", "year").alias("meta"),
    )


def write_labelling_tasks(records: DataFrame, path: str) -> None:
    labelling_tasks(records).write.option("ignoreNullFields", "false").json(path)


def write_cluster_index(members: DataFrame, path: str) -> None:
    """Leader hash -> member path, as JSON lines, one for each member."""
    members.write.json(path)


def write_split_manifest(records: DataFrame, path: str) -> None:
    """Image addresses in one folder per split."""
    records.write.partitionBy("split").parquet(path)


def write_report(lines: DataFrame, path: str) -> None:
    """Report lines as text files, in name order over the files."""
    lines.select("line").write.text(path)
