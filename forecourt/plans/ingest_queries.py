"""Idempotent ingest, image bookkeeping and incremental ingest over the given tables."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from forecourt.operators import ingest, media
from forecourt.plans.bindings import ads_sql, ads_view, enriched_sql, enriched_view, table, with_images
from forecourt.plans.registry import query
from forecourt.session import shared_folder
from forecourt.sources import buckets
from forecourt.streaming import ingest as stream_ingest

# Orders as ads: the natural key repeats. Old rows and the batch overlap in half of the keys.
ORDER_ADS = """select o_orderkey as ord, concat('site', cast(o_custkey % 3 as string)) as source_site, cast(o_custkey as string) as source_id,
  o_orderpriority as title, o_totalprice as price from {orders}"""
KNOWN = "select source_site, source_id, min(ord) as id, min(title) as title, max(price) as price from ({o}) k where cast(source_id as bigint) % 2 = 0 group by source_site, source_id"
O_SQL = ORDER_ADS.format(orders="orders")


def _order_ads(spark, sf_dir):
    return spark.sql(ORDER_ADS, orders=table(spark, sf_dir, "orders"))


def _known(batch):
    return (
        batch.filter(F.col("source_id").cast("bigint") % 2 == 0).groupBy("source_site", "source_id")
        .agg(F.min("ord").alias("id"), F.min("title").alias("title"), F.max("price").alias("price"))
    )


@query(f"""with o as ({O_SQL}), known as ({KNOWN.format(o=O_SQL)}),
fresh as (select source_site, source_id, arg_min(title, ord) as title, arg_min(price, ord) as price from o group by source_site, source_id)
select source_site, source_id, title, price from known union all
select source_site, source_id, title, price from fresh f where not exists (select 1 from known k where k.source_site = f.source_site and k.source_id = f.source_id)""")
def insert_if_absent(spark, sf_dir):
    batch = _order_ads(spark, sf_dir)
    return ingest.insert_if_absent(_known(batch).drop("id"), batch, ingest.AD_KEY, "ord")


@query(f"""with o as ({O_SQL}), known as ({KNOWN.format(o=O_SQL)}),
b as (select source_site, source_id, arg_max(price, ord) as price, arg_min(title, ord) as title from o group by source_site, source_id)
select b.source_site, b.source_id, coalesce(k.title, b.title) as title, b.price, k.id as known_id from b left join known k using (source_site, source_id)""")
def upsert_latest(spark, sf_dir):
    batch = _order_ads(spark, sf_dir)
    out = ingest.upsert(_known(batch), batch, ingest.AD_KEY, "ord", ["price"], ["title"])
    is_old = F.col("source_id").cast("bigint") % 2 == 0
    return out.select("source_site", "source_id", "title", "price", F.when(is_old, F.col("id")).alias("known_id"))


@query(f"""with o as ({O_SQL}), b as (select source_site, source_id, arg_max(title, ord) as raw_title, max(ord) as last_scraped_at,
  arg_min(price, ord) as source_url, cast(source_id as bigint) % 2 = 0 as old from o group by source_site, source_id)
select source_site, source_id, raw_title, last_scraped_at, case when old then 'known' else cast(source_url as string) end as source_url, not old as is_active from b""")
def ad_update_or_create(spark, sf_dir):
    batch = _order_ads(spark, sf_dir).select(
        "source_site", "source_id", F.col("title").alias("raw_title"), F.col("ord").alias("last_scraped_at"),
        F.col("price").cast("string").alias("source_url"),
    )
    known = _known(_order_ads(spark, sf_dir)).select(
        "id", "source_site", "source_id", F.lit("known").alias("source_url"), F.lit("old").alias("raw_title"),
        F.lit(0).cast("bigint").alias("last_scraped_at"), F.lit(False).alias("is_active"),
    )
    return ingest.update_or_create_ads(known, batch).drop("id")


# Document texts as image contents: copies share a checksum.
PICTURES = """select doc_id as ord, 'docs' as source_site, source as source_id, sha256(text) as checksum from documents"""


def _pictures(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ord"), F.lit("docs").alias("source_site"), F.col("source").alias("source_id"),
        F.sha2("text", 256).alias("checksum"), "lang",
    )


@query(f"""with p as ({PICTURES}), known as (select distinct sha256(text) as checksum from documents where lang = 'en')
select min(ord) as ord, arg_min(source_id, ord) as source_id, checksum from p where checksum not in (select checksum from known) group by checksum""")
def image_checksum_dedup(spark, sf_dir):
    pictures = _pictures(spark, sf_dir)
    known = pictures.filter("lang = 'en'").select("checksum").distinct()
    return ingest.new_images(known, pictures, "ord").select("ord", "source_id", "checksum")


@query("""with p as (select doc_id as ord, source, lang, sha256(text) as checksum from documents),
fresh as (select arg_min(source || lang, ord) as source_id from p where checksum not in (select checksum from p where lang = 'en') group by checksum),
ads as (select distinct source || lang as source_id, source in ('src1', 'src2') as known from p)
select source_id from ads where known or source_id in (select source_id from fresh)""")
def ads_with_new_images(spark, sf_dir):
    pictures = _pictures(spark, sf_dir).withColumns({"site": F.col("source_id"), "source_id": F.concat("source_id", "lang")})
    known_images = pictures.filter("lang = 'en'").select("checksum").distinct()
    fresh = ingest.new_images(known_images, pictures, "ord")
    ads = pictures.select("source_site", "source_id", "site").distinct()
    known_ads = ads.filter(F.col("site").isin("src1", "src2"))
    return ingest.ads_to_keep(ads, known_ads, fresh).select("source_id")


MEDIA = ("id", "source_id", "make", "model", "year", "image_count", "image_path", "is_processed")


def _media_ads(spark, sf_dir):
    return with_images(ads_view(spark, sf_dir, *MEDIA, wide=True))


@query(f"""with a as ({ads_sql(*MEDIA)}) select image_path as path, max(id) as ad_id, arg_max(make, id) as make, arg_max(year, id) as year
from a where is_processed group by image_path""")
def path_index(spark, sf_dir):
    return media.path_index(_media_ads(spark, sf_dir)).select("path", "ad_id", "make", "year")


FILE_PATH = "concat('/store/', cast(p_partkey % 997 as string), '/', cast(p_size as string), '.jpg')"


@query(f"""with a as ({ads_sql(*MEDIA)}), i as (select image_path as path, max(id) as ad_id from a where is_processed group by image_path),
f as (select distinct {FILE_PATH} as path from part) select f.path, i.ad_id from f left join i using (path)""")
def images_with_ads(spark, sf_dir):
    files = table(spark, sf_dir, "part").selectExpr(f"{FILE_PATH} as path").distinct()
    return media.with_ad(files, media.path_index(_media_ads(spark, sf_dir))).select("path", "ad_id")


@query(f"""with a as ({ads_sql(*MEDIA)}), f as (select distinct {FILE_PATH} as local_path from part)
select local_path from f where local_path not in (select image_path from a where is_processed)""")
def orphan_images(spark, sf_dir):
    files = table(spark, sf_dir, "part").selectExpr(f"{FILE_PATH} as local_path").distinct()
    return media.orphan_images(files, _media_ads(spark, sf_dir))


@query("""select c_custkey as ad_id, c_name as source_id from customer where c_custkey not in (select o_custkey from orders)""")
def orphan_links(spark, sf_dir):
    links = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ad_id"), F.col("c_name").alias("source_id"))
    return media.orphan_links(links, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")))


@query("""with d as (select o_custkey as id, o_orderkey as position, 'p' || o_orderkey || '.jpg' as path,
  row_number() over (partition by o_custkey order by o_orderkey) as n from orders)
select c_custkey as id, coalesce(string_agg(path, '|' order by n) filter (where n <= 3), 'none') as paths
from customer left join d on c_custkey = id and n <= 3 group by c_custkey""")
def link_images(spark, sf_dir):
    ads = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array(F.lit("none")).alias("local_image_paths"))
    downloads = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("ad_id"), F.col("o_orderkey").alias("position"),
        F.concat(F.lit("p"), F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("path"),
    )
    return media.link_images(ads, downloads, 3).select("id", F.array_join("local_image_paths", "|").alias("paths"))


@query(f"""with a as ({ads_sql(*MEDIA)}), i as (select distinct {FILE_PATH} as local_path from part)
select id as ad_id, source_id, image_path as paths from a where is_processed and image_path in (select local_path from i)""")
def ad_links(spark, sf_dir):
    index = table(spark, sf_dir, "part").selectExpr(f"{FILE_PATH} as local_path").distinct()
    return media.ad_links(_media_ads(spark, sf_dir), index).select(
        "ad_id", "source_id", F.array_join("image_paths", "|").alias("paths")
    )


@query(f"""with a as ({ads_sql(*MEDIA)}), u as (select id, source_id, 'https://img.example.com/photo/' || id || '_' || n || '.jpg' as url
  from a, range(1, 4) r(n) where n <= image_count),
known as (select distinct md5('https://img.example.com/photo/' || id || '_2.jpg') as h from a where not is_processed)
select id as ad_id, url, md5(url) as url_hash, split_part(url, '/', -1) as filename from u where md5(url) not in (select h from known)""")
def urls_to_download(spark, sf_dir):
    ads = _media_ads(spark, sf_dir)
    second = F.concat(F.lit("https://img.example.com/photo/"), F.col("id").cast("string"), F.lit("_2.jpg"))
    index = ads.filter(~F.col("is_processed")).select(F.md5(second).alias("url_hash"))
    return media.urls_to_download(ads, index, 3).select("ad_id", "url", "url_hash", "filename")


@query(f"""with a as ({ads_sql(*MEDIA)}), f as (select {FILE_PATH} as path, max(p_size * 100000) as length from part group by 1),
i as (select distinct image_path as path from a where is_processed)
select count(*) as total_images, round(coalesce(sum(length), 0) / 1048576.0, 2) as total_size_mb, (select count(*) from a where is_processed) as linked_ads
from i left join f using (path)""")
def image_stats(spark, sf_dir):
    ads = _media_ads(spark, sf_dir).filter("is_processed")
    files = table(spark, sf_dir, "part").selectExpr(f"{FILE_PATH} as path", "p_size * 100000 as length").groupBy("path").agg(F.max("length").alias("length"))
    index = ads.select(F.col("image_path").alias("local_path")).distinct()
    return media.image_stats(index, files, ads.select("id"))


@query(f"""with ads as ({ads_sql("id", "price", "model", "is_processed", "is_active", "image_path")}), enriched as ({enriched_sql()}),
c as (select image_path as path, case when min(price) < 5000 then 'green' when min(price) < 20000 then 'black' end as color, round(min(price) / 200000, 4) as confidence
  from ads where is_processed group by image_path),
found as (select id as raw_ad_id, color, confidence from ads join c on path = image_path where is_active and is_processed and color is not null)
select raw_ad_id, coalesce(f.color, e.detected_color) as detected_color,
  case when f.color is not null then f.confidence else e.detected_color_confidence end as detected_color_confidence
from enriched e full join found f using (raw_ad_id)""")
def color_enrichment(spark, sf_dir):
    ads = with_images(ads_view(spark, sf_dir, "id", "price", "is_processed", "is_active", "image_path", "image_count"))
    low = F.min("price")
    colors = ads.filter("is_processed").groupBy(F.col("image_path").alias("path")).agg(
        F.when(low < 5000, F.lit("green")).when(low < 20000, F.lit("black")).alias("color"), F.round(low / 200000, 4).alias("confidence")
    )
    out = media.enrich_with_colors(enriched_view(spark, sf_dir), ads.drop("image_path"), colors, None)
    return out.select("raw_ad_id", "detected_color", "detected_color_confidence")


@query("""select 'customer' as site, c_custkey as id, c_name as name, c_acctbal as balance, c_mktsegment as segment from customer
union all select 'supplier', s_suppkey, s_name, s_acctbal, null from supplier""")
def site_union(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").selectExpr(
        "'customer' as site", "c_custkey as id", "c_name as name", "c_acctbal as balance", "c_mktsegment as segment"
    )
    suppliers = table(spark, sf_dir, "supplier").selectExpr("'supplier' as site", "s_suppkey as id", "s_name as name", "s_acctbal as balance")
    return ingest.union_all([customers, suppliers])


@query("""select event_type as source_site, cast(user_id as string) as source_id, min(event_id) as ord, arg_min(value, event_id) as value
from events group by event_type, user_id""")
def incremental_ingest(spark, sf_dir):
    """Events streamed into a table with one row per natural key, then read back."""
    schema = table(spark, sf_dir, "events").schema
    stream = stream_ingest.ad_stream(spark, sf_dir, schema, pathGlobFilter="events.parquet").select(
        F.col("event_type").alias("source_site"), F.col("user_id").cast("string").alias("source_id"),
        F.col("event_id").alias("ord"), "value",
    )
    root = f"{shared_folder(spark)}/ingest-{uuid4().hex}"
    stream_ingest.start_ingest(stream, f"{root}/ads", f"{root}/progress", order=["ord"]).awaitTermination()
    return stream_ingest.read_ingested(spark, f"{root}/ads")


@query("""with e as (select event_type as source_site, cast(user_id as string) as source_id, event_id as ord, value, event_id % 3 = 0 as early from events where user_id % 10 <> 0)
select source_site, source_id, coalesce(min(ord) filter (early), min(ord)) as ord,
  coalesce(arg_min(value, ord) filter (early), arg_min(value, ord)) as value from e group by source_site, source_id""")
def incremental_ingest_runs(spark, sf_dir):
    """Two runs, the second over all events: keys of the first run, and those known before, stay as they are."""
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("source_site"), F.col("user_id").cast("string").alias("source_id"), F.col("event_id").alias("ord"), "value", "user_id"
    )
    root = f"{shared_folder(spark)}/ingest-{uuid4().hex}"
    events.filter("user_id % 10 = 0").select(*ingest.AD_KEY).distinct().write.parquet(f"{root}/known")
    ads = events.drop("user_id")
    for early in (F.col("ord") % 3 == 0, F.lit(True)):
        ads.filter(early).write.mode("append").parquet(f"{root}/source")
        known = stream_ingest.ad_stream(spark, f"{root}/known", ads.select(*ingest.AD_KEY).schema)
        stream = stream_ingest.ad_stream(spark, f"{root}/source", ads.schema)
        stream_ingest.start_ingest(stream, f"{root}/ads", f"{root}/progress", order=["ord"], known=known).awaitTermination()
    return stream_ingest.read_ingested(spark, f"{root}/ads")


def _bucketed(spark, rows, keys, n_buckets=16):
    path = f"{shared_folder(spark)}/buckets-{uuid4().hex}"
    buckets.write_buckets(rows, path, keys, n_buckets)
    return path


LATE_ORDERS = "cast(source_id as bigint) % 11 < 2"


@query(f"""with o as ({O_SQL}), known as ({KNOWN.format(o=O_SQL)}),
b as (select source_site, source_id, arg_max(price, ord) as price, arg_min(title, ord) as title from o where {LATE_ORDERS} group by source_site, source_id)
select source_site, source_id, coalesce(k.title, b.title) as title, coalesce(b.price, k.price) as price, k.id as known_id from b full join known k using (source_site, source_id)""")
def upsert_buckets(spark, sf_dir):
    """A stored table after an upsert of a part of its keys and of new ones."""
    batch = _order_ads(spark, sf_dir)
    path = _bucketed(spark, _known(batch), ingest.AD_KEY)
    buckets.upsert_buckets(path, batch.filter(LATE_ORDERS), ingest.AD_KEY, "ord", ["price"], ["title"], n_buckets=16)
    is_old = F.col("source_id").cast("bigint") % 2 == 0
    return buckets.read_buckets(spark, path).select("source_site", "source_id", "title", "price", F.when(is_old, F.col("id")).alias("known_id"))


@query(f"""with o as ({O_SQL}), b as (select source_site, source_id, arg_max(title, ord) as raw_title, max(ord) as last_scraped_at, arg_min(price, ord) as price,
  cast(source_id as bigint) % 2 = 0 as old, {LATE_ORDERS} as given from o group by source_site, source_id)
select source_site, source_id, case when given then raw_title else 'old' end as raw_title, case when given then last_scraped_at else 0 end as last_scraped_at, case when given then 'order ' || last_scraped_at else '{{}}' end as raw_data,
  case when old then 'known' else cast(price as string) end as source_url, not old as is_active from b where old or given""")
def ad_update_buckets(spark, sf_dir):
    """Stored auction ads after a batch of known and new ones."""
    ads = _order_ads(spark, sf_dir).select(
        "source_site", "source_id", F.col("title").alias("raw_title"), F.col("ord").alias("last_scraped_at"), F.col("price").cast("string").alias("source_url"),
        F.concat(F.lit("order "), F.col("ord").cast("string")).alias("raw_data"),
    )
    known = _known(_order_ads(spark, sf_dir)).select(
        "id", "source_site", "source_id", F.lit("known").alias("source_url"), F.lit("old").alias("raw_title"),
        F.lit(0).cast("bigint").alias("last_scraped_at"), F.lit(False).alias("is_active"), F.lit("{}").alias("raw_data"),
    )
    path = _bucketed(spark, known, ingest.AD_KEY)
    batch = ads.filter(LATE_ORDERS).withColumn("is_active", F.lit(True))
    buckets.upsert_buckets(path, batch, ingest.AD_KEY, "last_scraped_at", ["raw_title", "raw_data", "last_scraped_at"], ["source_url", "is_active"], n_buckets=16)
    return buckets.read_buckets(spark, path).drop("id")


@query(f"""with enriched as ({enriched_sql("(" + ads_sql("id", "price", "model", "is_processed") + ") a")}),
found as (select id as raw_ad_id, case when price < 5000 then 'green' else 'black' end as color, round(price / 200000, 4) as confidence
  from ({ads_sql("id", "price", "mileage")}) a where price < 20000 and mileage % 2000 = 0)
select coalesce(e.raw_ad_id, f.raw_ad_id) as raw_ad_id, coalesce(f.color, e.detected_color) as detected_color,
  case when f.color is not null then f.confidence else e.detected_color_confidence end as detected_color_confidence, e.body_type
from enriched e full join found f on e.raw_ad_id = f.raw_ad_id""")
def color_enrichment_buckets(spark, sf_dir):
    """Stored enrichment rows after the detected colours of some ads came in."""
    enriched = enriched_view(spark, sf_dir)
    path = _bucketed(spark, enriched, ["raw_ad_id"], 32)
    ads = ads_view(spark, sf_dir, "id", "price", "mileage").filter("price < 20000 and mileage % 2000 = 0")
    found = ads.select(
        F.col("id").alias("raw_ad_id"), F.when(F.col("price") < 5000, "green").otherwise("black").alias("detected_color"),
        F.round(F.col("price") / 200000, 4).alias("detected_color_confidence"),
    )
    buckets.upsert_buckets(path, found, ["raw_ad_id"], "raw_ad_id", ["detected_color", "detected_color_confidence"], id_column=None, n_buckets=32)
    return buckets.read_buckets(spark, path).select("raw_ad_id", "detected_color", "detected_color_confidence", "body_type")
