"""Addresses, file names, checksums."""

from __future__ import annotations

from pyspark.sql import functions as F

from forecourt.functions import urls
from forecourt.operators import media, pages
from forecourt.plans.bindings import ads_sql, ads_view, dealt_table, table
from forecourt.plans.registry import query

HOST = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)"
PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1)"


@query(rf"""with p as (select page_id, url, {HOST} as source_site, {PATH} as path from pages),
n as (select *, split_part(path, '/', -1) as name, regexp_extract(rtrim(path, '/'), '[^/]*$') as source_id from p)
select page_id, source_site, source_id,
  case when contains(name, '.') then name else 'p' || page_id || '_' || substr(md5(url), 1, 8) ||
    case when contains(lower(url), 'jpg') or contains(lower(url), 'jpeg') then '.jpg' when contains(lower(url), 'png') then '.png'
         when contains(lower(url), 'webp') then '.webp' else '.jpg' end end as filename,
  md5(url) as url_hash,
  (case when source_id = '' then 'image' else source_id end) || case when regexp_matches(lower(source_id), '\.(jpg|jpeg|png|webp)$') then '' else '.jpg' end as gallery_name
from n""")
def url_parts(spark, sf_dir):
    key = urls.source_site_and_id("url")
    return dealt_table(spark, sf_dir, "pages").select(
        "page_id", key["source_site"].alias("source_site"), key["source_id"].alias("source_id"),
        urls.image_filename("url", F.concat(F.lit("p"), F.col("page_id").cast("string"))).alias("filename"),
        urls.url_hash("url").alias("url_hash"), urls.gallery_filename("url").alias("gallery_name"),
    )


@query("""select doc_id, md5(text) as file_hash, sha256(text) as checksum,
  'store/' || substr(sha256(text), 1, 2) || '/' || substr(sha256(text), 3, 2) || '/' || source || '.txt' as path,
  'site_' || substr(md5(substr(text, 1, 200)), 1, 8) as source_id from documents""")
def content_path(spark, sf_dir):
    from forecourt.functions.text import source_id_of

    digest = urls.checksum("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5("text").alias("file_hash"), digest.alias("checksum"),
        urls.content_path("store", digest, F.concat("source", F.lit(".txt"))).alias("path"),
        source_id_of(F.col("text"), "site").alias("source_id"),
    )


# File addresses of many shapes from part names. Same text in both dialects.
SHAPES = """select p_partkey, case p_partkey % 4 when 0 then concat('//cdn.example.com/', replace(p_name, ' ', '/'), '.jpg')
  when 1 then concat('/', replace(p_name, ' ', '_'), '.png') when 2 then concat(replace(p_name, ' ', '-'), '_photo')
  else concat('https://h.example.com/', case when p_size % 5 = 0 then 'logo' else 'car' end, '/', cast(p_size as string)) end as src from {part}"""


@query(f"""with s as ({SHAPES.format(part="part")}),
u as (select p_partkey, src, case when starts_with(src, '//') then 'https:' || src when starts_with(src, '/') then 'https://base.example.com' || src
  when not starts_with(src, 'http') then 'https://base.example.com/' || src else src end as url from s)
select p_partkey, url,
  not regexp_matches(lower(url), 'logo|icon|nophoto|placeholder|banner|advertisement|social|facebook|twitter|instagram|youtube|google|analytics|tracking|pixel|beacon')
    and regexp_matches(lower(url), 'photo|image|car|auto|vehicle|mobile.bg|focus.bg|picturess|photosorg') as is_car_image,
  not regexp_matches(lower(src), 'icon|placeholder') as is_picture, regexp_matches(lower(src), '\\.(jpg|jpeg|png|webp|bmp)$') as is_file from u""")
def image_addresses(spark, sf_dir):
    shapes = spark.sql(SHAPES, part=table(spark, sf_dir, "part"))
    return shapes.withColumn("url", urls.absolute_url("src", "https://base.example.com")).select(
        "p_partkey", "url", urls.is_car_image("url").alias("is_car_image"), urls.is_real_picture("src").alias("is_picture"),
        urls.has_image_extension("src").alias("is_file"),
    )


SRCSETS = """select p_partkey, concat('a.jpg ', cast(p_size * 40 as string), 'w, b.jpg ', cast(p_size % 3 as string), 'x , c.jpg 640w, d.jpg') as srcset from {part}"""


@query(f"""with s as ({SRCSETS.format(part="part")}), p as (select p_partkey, trim(unnest(string_split(srcset, ','))) as part from s),
w as (select p_partkey, split_part(part, ' ', 1) as url, split_part(part, ' ', 2) as size from p)
select p_partkey, url as best from w qualify row_number() over (partition by p_partkey order by coalesce(
  case when size like '%w' then try_cast(rtrim(size, 'w') as int) when size like '%x' then cast(try_cast(rtrim(size, 'x') as double) * 1000 as int) end, 0) desc, url desc) = 1""")
def best_srcset(spark, sf_dir):
    sets = spark.sql(SRCSETS, part=table(spark, sf_dir, "part"))
    return sets.select("p_partkey", urls.best_source("srcset").alias("best"))


@query(f"""with a as ({ads_sql("id", "source_site", "title")}), f as (select id, source_site as folder, title || '.jpg' as name from a),
n as (select *, row_number() over (partition by folder, name order by id) - 1 as copy from f)
select id, folder, case when copy = 0 then name else replace(name, '.jpg', '') || '-' || copy || '.jpg' end as file_name from n""")
def numbered_files(spark, sf_dir):
    ads = ads_view(spark, sf_dir, "id", "source_site", "title")
    files = ads.select("id", F.col("source_site").alias("folder"), F.concat("title", F.lit(".jpg")).alias("name"))
    return media.numbered_files(files, order="id").select("id", "folder", "file_name")


@query(r"""with h as (select page_id, regexp_replace(html, '<!--.*?-->|<script.*?</script>', '', 'gs') as html, """ + HOST + r""" as host from pages),
l as (select page_id, host, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as href from h)
select page_id, href, case when starts_with(href, '//') then 'https:' || href when starts_with(href, '/') then 'https://' || host || href
  when not starts_with(href, 'http') then 'https://' || host || '/' || href else href end as url, count(*) as n from l group by all""")
def page_links(spark, sf_dir):
    source = dealt_table(spark, sf_dir, "pages")
    return pages.links(pages.elements(source, frozenset(["a"])), source).groupBy("page_id", "href", "url").agg(F.count(F.lit(1)).alias("n"))




@query(f"""with s as ({SHAPES.format(part="part")}), u as (select p_partkey, 'https://x.example.com/' || ltrim(replace(src, 'https://h.example.com', ''), '/') as url from s),
n as (select *, 's' || p_partkey as source_id, regexp_extract(url, '[^/]*$') as name from u)
select p_partkey, source_id || '/' || case when contains(name, '.') then name else source_id || '_' || substr(md5(url), 1, 8) || '.jpg' end as file_name from n""")
def download_names(spark, sf_dir):
    shapes = spark.sql(SHAPES, part=table(spark, sf_dir, "part"))
    address = F.concat(F.lit("https://x.example.com/"), F.ltrim(F.replace("src", F.lit("https://h.example.com"), F.lit("")), F.lit("/")))
    return shapes.select("p_partkey", urls.download_filename(address, F.concat(F.lit("s"), F.col("p_partkey").cast("string"))).alias("file_name"))


@query("""select p_partkey, case when p_size % 3 = 0 then p_name || '-2.jpg' when p_size % 3 = 1 then p_name || '.jpg' else 'none.jpg' end as best from part""")
def best_address(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("word", F.replace("p_name", F.lit(" "), F.lit("_")))
    several = F.when(F.col("p_size") % 3 == 0, F.concat("word", F.lit("-1.jpg 100w, "), "word", F.lit("-2.jpg 900w")))
    plain = F.when(F.col("p_size") % 3 == 1, F.concat("word", F.lit(".jpg"))).otherwise("")
    best = urls.best_image_url(several, plain, F.lit("none.jpg"))
    return part.select("p_partkey", F.replace(best, F.lit("_"), F.lit(" ")).alias("best"))
