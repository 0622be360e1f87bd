"""From raw documents to a training mix, in stages that are written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and keeps the columns of ``documents``, but for the last, which says how often
the mix takes each document. Nulls, ties, repeated rows and empty tables are handled as each operator states; columns
besides those of ``documents`` pass through all stages but the last.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forecourt.llm import decontaminate, line_dedup, mixing, ngram_join, toxicity
from forecourt.llm.common import shared_folder, table
from forecourt.llm.queries import ORACLES, QUERIES

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model scores under one half; it learns from the labels of the stage's own documents."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document without the lines that an earlier one has; ``n_chars`` follows. No document goes."""
    rows = line_dedup.dedup_lines(docs)
    changed = {"text": F.when(F.col("doc.text").isNull(), None).otherwise(F.col("kept.text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("kept.n_dropped") > 0, F.length("kept.text")).otherwise(F.col("doc.n_chars")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: that with the least doc_id. Of repeated rows one stays."""
    return ngram_join.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document, and the words it gets from it."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark),
    ("source_mixing", mix_sources),
]

# The classifier's weights are nothing that SQL can express; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between two of them is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{i}-{name}")
            docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs


QUERIES = QUERIES | {"pipeline": run}
