"""Sources and sinks: what is written to the shared folder is read again and must be what was meant."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from forecourt.functions import fixed
from forecourt.operators import catalog, configured, dedup, images, listings, media
from forecourt.operators.split import train_val_split
from forecourt.plans.bindings import ads_sql, ads_view, embedding_images, spec_pages, table
from forecourt.plans.dedup_queries import SPLIT
from forecourt.plans.image_queries import PIXELS
from forecourt.plans.registry import query
from forecourt.plans.spec_queries import LOADED
from forecourt.session import shared_folder
from forecourt.sources import sinks, tables


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _records(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.select(
        F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")).alias("local_path"), F.md5("text").alias("file_hash"),
        F.lit(None).cast("string").alias("phash"), F.col("quality").alias("ad_id"), F.col("lang").alias("make"),
        F.col("source").alias("model"), F.col("n_chars").alias("year"),
    )


@query("""select doc_id || '.jpg' as local_path, md5(text) as file_hash, '' as phash, coalesce(cast(quality as varchar), '') as ad_id,
  lang as make, source as model, cast(n_chars as varchar) as year from documents left join labels using (doc_id)""")
def metadata_csv(spark, sf_dir):
    path = _folder(spark, "metadata")
    sinks.write_metadata_csv(_records(spark, sf_dir), path)
    columns = ", ".join(f"{c} string" for c in sinks.RECORD)
    return spark.read.csv(path, schema=columns, header=True).fillna("")


@query("""select to_json({'data': {'image': doc_id || '.jpg'}, 'meta': {'ad_id': quality, 'make': lang, 'model': source, 'year': n_chars}}) as task
from documents left join labels using (doc_id)""")
def labelling_file(spark, sf_dir):
    path = _folder(spark, "labelling")
    sinks.write_labelling_tasks(_records(spark, sf_dir), path)
    return spark.read.text(path).withColumnRenamed("value", "task")


@query("select min(doc_id) over (partition by md5(text)) as leader, doc_id as member, count(*) over (partition by md5(text)) as cluster_size from documents")
def cluster_index_file(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("file_hash"))
    firsts = docs.groupBy("file_hash").agg(F.min("doc_id").alias("leader"))
    path = _folder(spark, "clusters")
    sinks.write_cluster_index(dedup.cluster_members(docs.join(firsts, "file_hash"), "doc_id"), path)
    return spark.read.schema("leader bigint, member bigint, cluster_size bigint").json(path)


@query(SPLIT.format(key="doc_id", ratio="0.9", rows="documents"))
def split_manifest(spark, sf_dir):
    path = _folder(spark, "split")
    sinks.write_split_manifest(train_val_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id"), path)
    return spark.read.parquet(path).select("doc_id", "split")


@query("""select c_custkey as ad_id, c_name as source_id, 'http://img/' || c_custkey || '.jpg' as url, '/store/' || c_custkey || '.jpg' as image_path from customer""")
def image_index_saved(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    number = F.col("c_custkey").cast("string")
    index = customer.select(
        F.md5(number).alias("url_hash"), F.concat(F.lit("http://img/"), number, F.lit(".jpg")).alias("url"),
        F.concat(F.lit("/store/"), number, F.lit(".jpg")).alias("local_path"), F.concat(number, F.lit(".jpg")).alias("filename"),
        F.col("c_name").alias("source_id"), F.lit("2024-01-01").alias("downloaded_at"),
    )
    links = customer.select(
        F.col("c_custkey").alias("ad_id"), F.col("c_name").alias("source_id"),
        F.array(F.concat(F.lit("/store/"), number, F.lit(".jpg"))).alias("image_paths"), F.lit("2024-01-01").alias("linked_at"),
    )
    root = _folder(spark, "index")
    nothing, _ = tables.read_image_index(spark, root)
    tables.save_image_index(nothing.unionByName(index), links, root)
    saved, linked = tables.read_image_index(spark, root)
    shown = linked.select("ad_id", "source_id", F.explode("image_paths").alias("image_path"))
    return shown.join(saved.select("url", F.col("local_path").alias("image_path")), "image_path").select("ad_id", "source_id", "url", "image_path")


def _config_files(spark, sf_dir):
    """One configuration file a region: two sites, and price limits made of the region's key."""
    key = F.col("r_regionkey")
    site = lambda n, on: F.struct(
        F.concat(F.lower("r_name"), F.lit(n)).alias("name"), F.lit(on).alias("enabled"), F.lit(f"https://{n}.example.com").alias("base_url"),
        F.lit("html").alias("method"), F.struct(F.lit("query").alias("type"), F.lit("page").alias("param_name"), F.lit(1).alias("start"), (key + 2).cast("int").alias("max_pages")).alias("pagination"),
    )
    configs = table(spark, sf_dir, "region").select(
        "r_regionkey", F.col("r_name").alias("name"), F.lit("cars").alias("description"), F.lit("BMW").alias("make"), F.lit("M5").alias("model"),
        F.lit("all").alias("generation"), (key + 1993).cast("int").alias("year_from"), F.lit(2030).alias("year_to"),
        F.array(site("a", True), site("b", False)).alias("sites"),
        F.struct((key * 10000).cast("double").alias("min_price"), (key * 10000 + 30000).cast("double").alias("max_price"), F.array(F.lit("old"), F.lit("Bolt")).alias("exclude_keywords")).alias("filters"),
    )
    path = _folder(spark, "configs")
    configs.write.partitionBy("r_regionkey").json(path)  # a folder each, so a file holds one object
    return tables.read_scrape_config(spark, f"{path}/*")


@query("""select r_name as job, lower(r_name) || n as site_name, n = 'a' as enabled, cast(r_regionkey + 2 as int) as max_pages, cast(r_regionkey + 1993 as int) as year_from,
  cast(r_regionkey * 10000 as double) as min_price, cast(r_regionkey * 10000 + 30000 as double) as max_price, 'old,Bolt' as keywords from region, (values ('a'), ('b')) s(n)""")
def scrape_configs(spark, sf_dir):
    rows = _config_files(spark, sf_dir)
    return rows.select("job", "site_name", "enabled", "max_pages", "year_from", "min_price", "max_price", F.array_join("exclude_keywords", ",").alias("keywords"))


@query(f"""with ads as ({ads_sql("id", "title", "price", "year")}) select r_name as job, id, title, price, year from ads, region
where price >= r_regionkey * 10000 and price <= r_regionkey * 10000 + 30000 and year >= r_regionkey + 1993 and not (contains(title, 'old') or contains(title, 'bolt'))""")
def configured_listings(spark, sf_dir):
    """Listings that pass the filters of each configuration file."""
    ads = ads_view(spark, sf_dir, "id", "title", "price", "year")
    return configured.configured(ads, _config_files(spark, sf_dir).where("enabled"))


CONFIGS = """select concat('c', cast(c_custkey as string)) as job, case when c_custkey % 7 = 0 then null else abs(c_acctbal) * 9 end as min_price,
  case when c_custkey % 5 = 0 then null else abs(c_acctbal) * 9 + 500 + c_custkey % 900 end as max_price,
  case when c_custkey % 3 = 0 then null else cast(1992 + c_custkey % 6 as int) end as year_from, case when c_custkey % 4 = 0 then null else cast(1994 + c_custkey % 6 as int) end as year_to,
  case c_custkey % 4 when 0 then 'old' when 1 then 'Bolt' when 2 then 'GEAR' end as word from {customer}"""


@query(f"""with ads as materialized (select id, title || '' as title, price, year from ({ads_sql("id", "title", "price", "year")}) a),
configs as materialized (select *, case word when 'Bolt' then 'bolt' when 'GEAR' then 'gear' else word end as low_word from ({CONFIGS.format(customer="customer")}) c)
select job, count(*) as n, min(id) as first_id, max(id) as last_id, round(sum(price), 2) as total from ads join configs
on (min_price is null or price >= min_price) and (max_price is null or price <= max_price) and (year_from is null or year >= year_from) and (year_to is null or year <= year_to)
  and (low_word is null or position(low_word in title) = 0) group by job""")
def many_configured_listings(spark, sf_dir):
    """What a configuration for each customer finds, in one plan."""
    configs = spark.sql(CONFIGS, customer=table(spark, sf_dir, "customer"))
    configs = configs.withColumn("exclude_keywords", F.when(F.col("word").isNotNull(), F.array("word")))
    found = configured.configured(ads_view(spark, sf_dir, "id", "title", "price", "year", wide=True), configs, totals_of="id")
    return found.groupBy("job").agg(
        F.sum("n").alias("n"), F.min("first").alias("first_id"), F.max("last").alias("last_id"), F.round(F.sum("total"), 2).alias("total")
    )


@query(f"""{LOADED} select distinct brand, model, gen_name, version_name from v""")
def catalog_saved(spark, sf_dir):
    """The catalog written to a new root and read from there."""
    root = _folder(spark, "catalog")
    tables.write_catalog(catalog.load_catalog(spec_pages(spark, sf_dir), tables.empty_catalog(spark)), root)
    return catalog.catalog_chain(tables.read_catalog(spark, root)).select("brand", "model", "gen_name", "version_name")


@query(f"""with {PIXELS} select vec_id || '.png: ' || color || ' (' || printf('%.3f', confidence) || ')' as line from colors""")
def color_report_file(spark, sf_dir):
    path = _folder(spark, "report")
    sinks.write_report(media.color_lines(images.dominant_color(images.measure_images(embedding_images(spark, sf_dir)))), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("""select l_orderkey as owner, l_linenumber as ord, l_partkey as picture from (
  select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as n from lineitem) where n <= 3""")
def first_images(spark, sf_dir):
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("owner"), place.alias("place"))
    return media.first_images(rows, "owner", "place", 3).select("owner", F.col("place.l_linenumber").alias("ord"), F.col("place.l_partkey").alias("picture"))


@query(f"""select distinct p_partkey % 7 as model_id, p_type || ' ' || (1990 + p_size) || '-present' as gen_name, '{fixed.CATALOG_BASE_URL}/' || lower(p_type) || '/' as url,
  cast(1990 + p_size as int) as start_year, cast(null as int) as end_year from part""")
def generations_overview(spark, sf_dir):
    """Generations listed on overview pages, loaded into an empty catalog."""
    owners = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), (F.col("p_partkey") % 7).alias("model_id"))
    empty = tables.empty_catalog(spark)["generations"]
    found = catalog.generations_from_overview(spec_pages(spark, sf_dir), owners, empty)
    return found.select("model_id", "gen_name", "url", "start_year", "end_year")


@query("""select n_nationkey as generation_id, n_name as gen_name, case when s_name is not null then 'supplier' end as doc_type, s_name as document_url from nation left join supplier on s_nationkey = n_nationkey""")
def generation_documents(spark, sf_dir):
    """The documents half of the catalog: nations as generations, their suppliers as documents."""
    generations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("gen_name"))
    documents = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").cast("bigint").alias("generation_id"), F.lit("supplier").alias("doc_type"), F.col("s_name").alias("url")
    )
    found = catalog.generations_with_documents({"generations": generations, "documents": documents})
    return found.select("generation_id", "gen_name", "doc_type", "document_url")


@query("""select doc_id as id, source as source_site, cast(doc_id as varchar) as source_id, lang as title, cast(n_chars as double) as price, cast(null as int) as year from documents""")
def ads_saved(spark, sf_dir):
    """Listings written without all columns and read as the engine's own table."""
    path = _folder(spark, "ads")
    table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("source_site"), F.col("doc_id").cast("string").alias("source_id"),
        F.col("lang").alias("title"), F.col("n_chars").cast("double").alias("price"),
    ).write.parquet(path)
    return tables.read_ads(spark, path).select("id", "source_site", "source_id", "title", "price", "year")


@query("""select page_id, url, length(html) as n_chars from pages""")
def pages_read(spark, sf_dir):
    rows = tables.read_pages(spark, f"{sf_dir}/pages.parquet")
    return rows.select("page_id", "url", F.length("html").cast("bigint").alias("n_chars"))
