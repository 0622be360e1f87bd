"""The views of the given tables that every query builds on."""

import pytest
from pyspark.sql import functions as F

from forecourt.plans import dedup_queries, page_queries, text_queries
from forecourt.plans.bindings import LINE_ID, dealt_table, document_hashes, embedding_images


def test_line_ids_stay_unique_and_in_range(spark):
    keys = [(1, 150_000, 2, 1), (2, 50_000, 2, 1), (1, 1, 11, 1), (1, 11, 1, 1), (11, 1, 1, 1), (6 * 10**12, 2 * 10**11, 10**10, 7), (1, 1, 1, 11)]
    lines = spark.createDataFrame(keys, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int")
    found = [r.id for r in lines.selectExpr(f"{LINE_ID} as id").collect()]
    assert len(set(found)) == len(keys) and found[0] == "1-150000-2-1"


def test_pictures_hold_every_value(spark):
    for r in embedding_images(spark, "/root/testdata/sf0.001").limit(3).collect():
        assert (r.height, r.width, len(r.data)) == (8, 8, 192)


@pytest.fixture()
def one_row_group(spark, tmp_path):
    """Tables of one row group, cut into many splits of which one holds all rows."""
    texts = spark.range(0, 400, 1, 1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.sha2(F.concat("id", F.lit(f"-{i}")), 512) for i in range(8)]).alias("text"))
    texts.write.parquet(f"{tmp_path}/documents.parquet")
    texts.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<div>"), "text", F.lit("</div>")).alias("html")).write.parquet(f"{tmp_path}/pages.parquet")
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    for name in names:
        spark.conf.set(name, "1000")
    yield str(tmp_path)
    for name in names:
        spark.conf.unset(name)


def shares(rows):
    return [r["n"] for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]


def test_texts_of_one_row_group_are_read_by_many_tasks(spark, one_row_group):
    read = spark.read.parquet(f"{one_row_group}/documents.parquet")
    assert read.rdd.getNumPartitions() > 8 and max(shares(read)) == 400
    assert max(shares(dealt_table(spark, one_row_group, "documents"))) <= 100
    assert max(shares(page_queries._pages(spark, one_row_group))) <= 100
    for rows in (document_hashes(spark, one_row_group), page_queries.page_top_containers(spark, one_row_group), text_queries.page_site_listings(spark, one_row_group)):
        assert "RoundRobinPartitioning" in rows._jdf.queryExecution().executedPlan().toString()


def test_hash_distance_hashes_documents_once(spark, one_row_group):
    found = dedup_queries.hash_distance(spark, one_row_group)
    assert "parquet" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 399
