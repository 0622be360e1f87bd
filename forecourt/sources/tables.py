"""Reading and writing the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forecourt import schemas


def read_ads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ADS).parquet(path)


def read_ads_jdbc(
    spark: SparkSession, url: str, table: str, low: int, high: int, parts: int, **options: str
) -> DataFrame:
    """Ads in a database, read in parallel over ranges of the id."""
    return spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn="id", lowerBound=low, upperBound=high, numPartitions=parts, **options
    ).load()


def empty_catalog(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in schemas.CATALOG.items()}


def read_catalog(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).parquet(f"{root}/{name}") for name, schema in schemas.CATALOG.items()}


def write_catalog(catalog: dict[str, DataFrame], root: str) -> None:
    """Write every catalog table to a new root; readers switch to it once all tables are there."""
    for name, df in catalog.items():
        df.write.mode("errorifexists").parquet(f"{root}/{name}")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PAGES).parquet(path)


def read_scrape_config(spark: SparkSession, path: str) -> DataFrame:
    """One row per site of every configuration file, with the filter values beside it."""
    declared = (
        "name string, description string, make string, model string, generation string, year_from int, "
        "year_to int, sites array<struct<name:string,enabled:boolean,base_url:string,method:string,"
        "pagination:struct<type:string,param_name:string,start:int,max_pages:int>>>, "
        "filters struct<min_price:double,max_price:double,exclude_keywords:array<string>>"
    )
    rows = spark.read.schema(declared).json(path, multiLine=True)
    return rows.select(
        F.col("name").alias("job"), "make", "model", "generation", "year_from", "year_to",
        F.explode("sites").alias("site"), "filters",
    ).select(
        "job", "make", "model", "generation", "year_from", "year_to",
        F.col("site.name").alias("site_name"), F.col("site.enabled").alias("enabled"),
        F.col("site.base_url").alias("base_url"), F.col("site.method").alias("method"),
        F.col("site.pagination.max_pages").alias("max_pages"),
        F.col("filters.min_price").alias("min_price"), F.col("filters.max_price").alias("max_price"),
        F.col("filters.exclude_keywords").alias("exclude_keywords"),
    )


def read_image_index(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Image index and ad links; both empty where nothing was saved yet."""
    return (
        _read_or_empty(spark, f"{root}/image_index", schemas.IMAGE_INDEX),
        _read_or_empty(spark, f"{root}/ad_links", schemas.AD_LINKS),
    )


def save_image_index(index: DataFrame, links: DataFrame, root: str) -> None:
    index.write.mode("errorifexists").parquet(f"{root}/image_index")
    links.write.mode("errorifexists").parquet(f"{root}/ad_links")


def path_exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def _read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)
