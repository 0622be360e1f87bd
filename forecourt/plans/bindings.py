"""The given tables seen as listings, images, hashes and specification pages.

Every view is a projection or a key join of whole tables; nothing is sampled. Each comes with the same
view in plain SQL, for checking.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forecourt.operators.anomalies import words_of

# No arithmetic of the four columns stays unique and in range at every scale; their text does.
LINE_ID = "concat(cast(l_orderkey as string), '-', cast(l_partkey as string), '-', cast(l_suppkey as string), '-', cast(l_linenumber as string))"

# Listing column -> (expression valid in Spark SQL and in plain SQL, tables besides lineitem).
AD_COLUMNS = {
    "id": (LINE_ID, ""),
    "source_site": ("concat('site', cast(l_suppkey % 10 as string))", ""),
    "source_id": (LINE_ID, ""),
    "source_url": ("concat('https://site', cast(l_suppkey % 10 as string), '.example.com/ad/', cast(l_orderkey as string), '-', cast(l_linenumber as string))", ""),
    "title": ("p_name", "part"),
    "price": ("l_extendedprice", ""),
    "currency": ("'EUR'", ""),
    "year": ("cast(year(o_orderdate) as int)", "orders"),
    "make": ("p_brand", "part"),
    "model": ("p_type", "part"),
    "mileage": ("cast(l_quantity * 900 as int)", ""),
    "location": ("concat('Region ', cast(c_nationkey as string))", "orders customer"),
    "dealer_name": ("c_name", "orders customer"),
    "dealer_type": ("c_mktsegment", "orders customer"),
    "fuel_type": ("case l_returnflag when 'A' then 'Diesel' when 'N' then 'Hybrid' else 'Electric' end", ""),
    "transmission": ("case l_linestatus when 'O' then 'Automatic' else 'Manual' end", ""),
    "body_type": ("p_type", "part"),
    "color": ("p_brand", "part"),
    "engine_power": ("cast(100 + p_size * 10 as int)", "part"),
    "engine_displacement": ("cast(1 + p_size / 10.0 as double)", "part"),
    "image_count": ("cast(l_partkey % 24 as int)", ""),
    "image_path": ("concat('/store/', cast(l_partkey % 997 as string), '/', cast(l_suppkey as string), '.jpg')", ""),
    "scraped_at": ("l_shipdate", ""),
    "is_active": ("(l_linestatus = 'O' or o_orderstatus <> 'F')", "orders"),
    "is_processed": ("(l_returnflag = 'R')", ""),
    "extended_price": ("l_extendedprice", ""),
}
JOINS = {
    "orders": ("l_orderkey", "o_orderkey"), "part": ("l_partkey", "p_partkey"), "customer": ("o_custkey", "c_custkey"),
}


TASKS_PER_SPLIT = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table whose rows cost much work each, on all cores.

    A file of one row group is read by one task. A table with fewer splits than cores is dealt out; that moves
    less than one split a core. Any other table is left as it is read.
    """
    rows = table(spark, sf_dir, name)
    rows = rows.select(*columns) if columns else rows
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def dealt_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of texts whose rows cost much work each, dealt out to tasks of a few megabytes whatever its size.

    The number of splits says nothing of how many hold rows: a file is cut by bytes, but a row group, which may be a hundred
    thousand texts, is read by the one split that holds its middle.
    """
    rows = table(spark, sf_dir, name)
    rows = rows.select(*columns) if columns else rows
    tasks = TASKS_PER_SPLIT * max(rows.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)
    return rows.repartition(tasks)


def _needed(columns: tuple[str, ...]) -> list[str]:
    tables = {t for c in columns for t in AD_COLUMNS[c][1].split()}
    return [t for t in ("orders", "part", "customer") if t in tables]


def ads_view(spark: SparkSession, sf_dir: str, *columns: str, wide: bool = False) -> DataFrame:
    """Line items as listings; only the tables behind the asked columns are joined."""
    out = wide_table(spark, sf_dir, "lineitem") if wide else table(spark, sf_dir, "lineitem")
    for name in _needed(columns):
        left, right = JOINS[name]
        out = out.join(table(spark, sf_dir, name), F.col(left) == F.col(right))
    return out.selectExpr(*[f"{AD_COLUMNS[c][0]} as {c}" for c in columns])


def ads_sql(*columns: str) -> str:
    joins = "".join(f" join {t} on {JOINS[t][0]} = {JOINS[t][1]}" for t in _needed(columns))
    return f"select {', '.join(f'{AD_COLUMNS[c][0]} as {c}' for c in columns)} from lineitem{joins}"


def with_images(ads: DataFrame) -> DataFrame:
    """Address and path arrays from ``image_count``, ``is_processed`` and ``image_path``."""
    numbers = F.when(F.col("image_count") > 0, F.sequence(F.lit(1), F.col("image_count"))).otherwise(F.array().cast("array<int>"))
    address = lambda i: F.concat(F.lit("https://img.example.com/photo/"), F.col("id").cast("string"), F.lit("_"), i.cast("string"), F.lit(".jpg"))
    return ads.withColumns({
        "image_urls": F.transform(numbers, address),
        "local_image_paths": F.when(F.col("is_processed"), F.array("image_path")).otherwise(F.array().cast("array<string>")),
    })


def full_ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with every column the anomaly rules read."""
    rows = ads_view(
        spark, sf_dir, "id", "source_id", "title", "price", "year", "make", "model", "mileage",
        "dealer_name", "dealer_type", "image_count", "image_path", "scraped_at", "is_active", "is_processed",
        wide=True,
    )
    return with_images(rows).withColumn("raw_data", F.lit("{}"))


DOCUMENT_ADS = """
select doc_id as id, source as source_id, lang as title, cast(n_chars as double) as price,
  cast(case when doc_id % 50 = 0 then 1985 else 2015 + doc_id % 12 end as int) as year,
  lang as make, lang as model, cast((doc_id * 3779) % 250000 as int) as mileage,
  case when doc_id % 7 = 0 then null when doc_id % 11 = 0 then 'Latest Cars' else concat('Dealer ', source) end as dealer_name,
  case when doc_id % 3 = 0 then 'dealer' else 'private' end as dealer_type,
  cast(doc_id % 25 as int) as image_count, text, true as is_active
from documents"""


def document_ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as listings with a long text; lengths play the price."""
    source = dealt_table(spark, sf_dir, "documents")
    rows = spark.sql(DOCUMENT_ADS.replace("from documents", "from {docs}"), docs=source)
    address = lambda i: F.concat(F.lit("https://img.example.com/"), F.col("id").cast("string"), F.lit("/"), i.cast("string"))
    numbers = F.when(F.col("image_count") > 0, F.sequence(F.lit(1), F.col("image_count"))).otherwise(F.array().cast("array<int>"))
    return rows.withColumns({
        "image_urls": F.transform(numbers, address), "local_image_paths": F.array().cast("array<string>"),
        "raw_data": F.to_json(F.struct(F.col("text").alias("text_content"))),
    })


# Enrichment rows: one per processed listing. Same text in both dialects.
ENRICHED = """
select id, id as raw_ad_id, case when price > 50000 then 'red' when price > 20000 then 'blue' else null end as detected_color,
  case when price > 20000 then round(price / 200000, 3) else null end as detected_color_confidence, model as body_type
from {ads} where is_processed"""


def enriched_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    ads = ads_view(spark, sf_dir, "id", "price", "model", "is_processed")
    return spark.sql(ENRICHED, ads=ads)


def enriched_sql(ads: str = "ads") -> str:
    return ENRICHED.format(ads=ads)


# --- Listing text made of the listing columns. Same text in both dialects. ---
LISTING_TEXT = """
concat('Ad ', cast(l_linenumber as string), ' ', p_name, ' Built ', cast(year as string), ' г. ', cast(mileage as string), ' км ',
  cast(100 + p_size * 10 as string), ' к.с. ', cast(1000 + p_size * 100 as string), ' куб.см ',
  case l_returnflag when 'A' then 'Diesel' when 'N' then 'Hybrid' else 'Бензинов' end, ' ',
  case l_linestatus when 'O' then 'Автоматична' else 'Manual' end, ' ',
  case p_type when 'LARGE' then 'SUV' when 'SMALL' then 'Купе' when 'PROMO' then 'Sedan' else 'van' end, ' ',
  case when p_size % 3 = 0 then 'Черен' when p_size % 3 = 1 then 'Blue' else 'beige' end, ' гр. ',
  case when l_suppkey % 2 = 0 then 'София' else 'Varna' end, ', ', cast(cast(floor(l_extendedprice) as bigint) as string), ' ',
  case l_suppkey % 3 when 0 then 'EUR' when 1 then 'лв' else '$' end)"""

LISTING_TEXTS = f"""
select {LINE_ID} as id, {LISTING_TEXT} as text
from (select *, cast(year(o_orderdate) as int) as year, cast(l_quantity * 900 as int) as mileage
      from {{lineitem}} join {{orders}} on l_orderkey = o_orderkey join {{part}} on l_partkey = p_partkey)"""


def listing_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = wide_table(spark, sf_dir, "lineitem")
    return spark.sql(LISTING_TEXTS, lineitem=lines, **{t: table(spark, sf_dir, t) for t in ("orders", "part")})


def listing_texts_sql() -> str:
    return LISTING_TEXTS.format(lineitem="lineitem", orders="orders", part="part") + " t"


# --- Texts of the older site: an ad number, a title line, dealers and private sellers, years around the first one read. ---
SITE_TEXTS = f"""
select {LINE_ID} as id, concat(case when l_linenumber % 2 = 0 then concat('Обява ', cast(10000000 + l_orderkey as string), '\n') else 'Обява\n' end,
  case when l_linenumber % 3 = 0 then '' when p_size % 5 = 0 then concat('BMW M5 ', p_name, repeat(' още', 60), '\n') else concat('  BMW M5 ', p_name, ' \n') end,
  'Цена ', cast(cast(floor(l_extendedprice) as bigint) as string), ' ', case l_suppkey % 3 when 0 then '€' when 1 then 'лв' else '$' end, '\n',
  'Дата ', cast(2016 + p_size % 9 as string), ' г.\nПробег ', cast(cast(l_quantity * 900 as int) as string), ' км\n',
  cast(100 + p_size * 10 as string), ' к.с. ', cast(1000 + p_size * 100 as string), ' куб.см\n',
  case l_suppkey % 4 when 0 then concat('Дилър: Салон ', cast(l_suppkey as string), ', внос') when 1 then 'частно лице' when 2 then concat('Автокъща: Дом ', cast(l_suppkey as string)) else 'няма' end, '\n',
  case when p_size % 2 = 0 then 'гр. София, център' else 'Варна' end, '\n',
  case l_returnflag when 'A' then 'дизел' when 'N' then 'Хибрид' else 'Бензинов' end, ' ', case l_linestatus when 'O' then 'Автоматична' else 'Ръчна' end, ' ',
  case when p_size % 3 = 0 then 'Седан ЧЕРЕН' when p_size % 3 = 1 then 'Кабрио Бял' else 'друг' end) as text
from {{lineitem}} join {{part}} on l_partkey = p_partkey"""


def site_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SITE_TEXTS, lineitem=wide_table(spark, sf_dir, "lineitem"), part=table(spark, sf_dir, "part"))


def site_texts_sql() -> str:
    return SITE_TEXTS.replace("\n", "' || chr(10) || '").format(lineitem="lineitem", part="part")


# --- Specification values formatted from part columns. Same text in both dialects. ---
SPEC_TEXTS = """
select p_partkey as page_id, 0 as block_idx, 'specs' as category, ord, key, raw_text from (
  select p_partkey, 1 as ord, 'power' as key, concat(cast(60 + p_size as string), ' KW @ 6000 RPM ', cast(80 + p_size as string), ' HP @ 6000 RPM ', cast(79 + p_size as string), ' BHP @ 6000 RPM') as raw_text from {part}
  union all select p_partkey, 2, 'torque', concat(cast(100 + p_size as string), ' lb-ft @ 1800-', cast(4000 + p_size as string), ' RPM ', cast(140 + p_size as string), ' Nm @ 1800-', cast(4000 + p_size as string), ' RPM') from {part}
  union all select p_partkey, 3, 'length', concat(cast(cast(floor(p_retailprice) as bigint) % 90 + 100 as string), '.5 in (', cast(4000 + p_size as string), ' mm)') from {part}
  union all select p_partkey, 4, 'fuel_tank_capacity', concat(cast(10 + p_size % 10 as string), '.5 gal (', cast(40 + p_size as string), ' L)') from {part}
  union all select p_partkey, 5, 'city_fuel_consumption', concat(cast(10 + p_size as string), '.9 mpg US (', cast(5 + p_size % 9 as string), '.4 L/100Km)') from {part}
  union all select p_partkey, 6, 'unladen_weight', concat(cast(2 + p_size % 3 as string), ',', cast(100 + p_size as string), ' lbs (', cast(1000 + p_size as string), ' kg)') from {part}
  union all select p_partkey, 7, 'top_speed', concat(cast(180 + p_size as string), case when p_size % 4 = 0 then ' mph' else ' km/h' end) from {part}
  union all select p_partkey, 8, 'displacement', concat(cast(1000 + p_size * 50 as string), ' cc') from {part}
  union all select p_partkey, 9, 'fuel', case when p_size % 2 = 0 then 'Petrol' else 'Diesel' end from {part}
  union all select p_partkey, 10, 'cylinders', concat('V', cast(4 + p_size % 5 as string)) from {part}
  union all select p_partkey, 11, 'special_edition', p_name from {part}
  union all select p_partkey, 12, 'weight', '1 kg' from {part}
  union all select p_partkey, 13, 'acceleration_0-62_mph_0-100_kph', concat(cast(3 + p_size % 8 as string), '.', cast(p_size % 10 as string), ' sec') from {part}
) x"""


def spec_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SPEC_TEXTS, part=table(spark, sf_dir, "part"))


def spec_texts_sql() -> str:
    return SPEC_TEXTS.format(part="part")


def spec_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation pages: one per part, with two version sections, features and pictures."""
    part = dealt_table(spark, sf_dir, "part")
    return spark.sql(
        """
        select p_partkey as page_id, concat('https://cars.example.com/', cast(p_partkey as string), '.html') as url,
          concat('<html><head><title>', replace(p_brand, '#', ''), ' ', p_type, ' (G', cast(p_size as string), ') 2001-2010</title></head><body>',
            '<h1>', p_name, '</h1><div class="carmodel"><h2><a href="/', lower(p_type), '/">', p_type, ' ', cast(1990 + p_size as string), '-present</a></h2></div>',
            '<a id="aeng_', replace(p_name, ' ', '-'), '"></a><h2>', p_name, ' Performance Specs:</h2><div class="enginedata"><table class="techdata">',
            '<tr><td>Power:</td><td>', cast(60 + p_size as string), ' KW @ 6000 RPM<br>', cast(80 + p_size as string), ' HP @ 6000 RPM</td></tr>',
            '<tr><td>Top Speed:</td><td>', cast(180 + p_size as string), ' km/h</td></tr>',
            '<tr><td>Displacement</td><td>', cast(1000 + p_size * 50 as string), ' cm3</td></tr><tr><td>Lonely</td></tr></table></div>',
            '<h3>', p_type, ' Sport</h3><div class="enginedata"><table class="techdata">',
            '<tr><th>Power:</th><td>', cast(160 + p_size as string), ' HP @ 6500 RPM</td></tr>',
            '<tr><td>Unladen Weight</td><td>', cast(2000 + p_size as string), ' lbs (', cast(1000 + p_size as string), ' kg)</td></tr></table></div>',
            '<ul class="features"><li>', p_name, ' seats</li><li>Cruise control</li></ul><div class="infotainment"><p>Big screen</p></div>',
            '<div class="car-gallery"><img src="/p/', cast(p_partkey as string), '.jpg" alt="BMW ', p_name, '"><img src="/p/icon.png" alt="x"></div>',
            '<img src="/i/carplay.png" alt="Apple CarPlay"></body></html>') as html
        from {part}""",
        part=part,
    )


# --- Pages of listings: one per part, a card per line item; every third card has no picture of its own. ---
LISTING_CARDS = """
select l_partkey as page_id, p_name as name, line, cast(cast(floor(l_extendedprice) as bigint) as string) as price_text,
  cast(year(o_orderdate) as int) as year, cast(l_quantity * 900 as int) as mileage, kind, cast(case when kind = 2 then 0 else 1 end as int) as pictured,
  cast(3 + 7 * (line - 1) + sum(case when kind = 2 then 0 else 1 end) over (partition by l_partkey order by line) - case when kind = 2 then 0 else 1 end as int) as card_ord
from (select *, cast(l_linenumber % 3 as int) as kind,
        row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey) as line from {lineitem}) x
join {orders} on l_orderkey = o_orderkey join {part} on l_partkey = p_partkey"""


def listing_cards_sql() -> str:
    return LISTING_CARDS.format(lineitem="lineitem", orders="orders", part="part")


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, html: a section of cards with name, price, facts, the dealer's picture and, on most, their own as an
    element or as a background. A page's cards are those of one part."""
    cards = spark.sql(LISTING_CARDS, **{t: table(spark, sf_dir, t) for t in ("lineitem", "orders", "part")})
    own = F.concat(F.lit("/photo/"), F.col("page_id").cast("string"), F.lit("-"), F.col("line").cast("string"), F.lit(".jpg"))
    shown = (
        F.when(F.col("kind") == 0, F.concat(F.lit('<img src="'), own, F.lit('">')))
        .when(F.col("kind") == 1, F.concat(F.lit("<div style=\"background-image: url('"), own, F.lit("')\"></div>"))).otherwise("")
    )
    card = F.concat(
        F.lit('<article class="card"><h2>'), "name", F.lit("</h2>\n <p>"), "price_text", F.lit(' EUR</p><div class="facts"><span>'), F.col("year").cast("string"),
        F.lit(" г.</span><span>"), F.col("mileage").cast("string"), F.lit(' км</span></div><img data-src="/photo/dealer.jpg">'), shown, F.lit("</article>\n"),
    )
    bodies = cards.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("line", card.alias("card")))).alias("cards"))
    html = F.concat(F.lit('<html><body><section class="offers">'), F.array_join(F.transform("cards", lambda c: c["card"]), ""), F.lit("</section></body></html>"))
    return bodies.select("page_id", F.concat(F.lit("https://cars.example.com/offers/"), F.col("page_id").cast("string")).alias("url"), html.alias("html"))


# --- A 64-bit hash per document: majority of the word hash bits. Stands for a picture's hash. ---
def document_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, md5 of the text, and 16 hex digits in which near copies of a text differ in few bits."""
    docs = dealt_table(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id", F.md5("text").alias("file_hash"), F.array_distinct(words_of(F.lower("text"))).alias("words")
    )
    words = docs.select("doc_id", "file_hash", F.explode("words").alias("word")).withColumn("digest", F.md5("word"))
    halves = words.select(
        "doc_id", "file_hash",
        *[F.conv(F.substring("digest", 1 + 8 * i, 8), 16, 10).cast("bigint").alias(f"half{i}") for i in (0, 1)],
    )
    # One sum counts a bit of both halves, 32 binary places apart.
    count_of = lambda half, b: F.shiftright(half, 31 - b).bitwiseAND(F.lit(1))
    ones = [
        F.sum(count_of("half0", b) + F.shiftleft(count_of("half1", b), 32)).alias(f"b{b}") for b in range(32)
    ]
    sums = halves.groupBy("doc_id", "file_hash").agg(F.count(F.lit(1)).alias("n"), *ones)
    counted = lambda b: F.col(f"b{b}").bitwiseAND(F.lit(0xFFFFFFFF)) if b < 32 else F.shiftright(f"b{b - 32}", 32)
    bit = lambda b: F.when(counted(b) * 2 > F.col("n"), 1 << (3 - b % 4)).otherwise(0)
    digit = lambda d: F.lower(F.hex((bit(4 * d) + bit(4 * d + 1) + bit(4 * d + 2) + bit(4 * d + 3)).cast("bigint")))
    return sums.select("doc_id", "file_hash", F.concat(*[digit(d) for d in range(16)]).alias("phash"))


SPACE_SQL = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def words_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{SPACE_SQL}+'), lambda w: w <> '')"


def document_hashes_sql() -> str:
    """Common tables ``words`` and ``hashes`` (doc_id, file_hash, phash, h)."""
    words = words_sql("lower(text)")
    return f"""words as (select doc_id, unnest(list_distinct({words})) as w from documents),
bits as (select doc_id, b, 2 * sum(((instr('0123456789abcdef', substr(md5(w), cast(b // 4 + 1 as int), 1)) - 1) >> cast(3 - b % 4 as int)) & 1) > count(*) as one
  from words, range(64) t(b) group by doc_id, b),
digits as (select doc_id, b // 4 as d, sum(case when one then 1 << cast(3 - b % 4 as int) else 0 end) as v from bits group by doc_id, b // 4),
hashes as (select x.doc_id, md5(text) as file_hash, phash, cast(('0x' || phash) as ubigint) as h
  from (select doc_id, string_agg(substr('0123456789abcdef', cast(v + 1 as int), 1), '' order by d) as phash from digits group by doc_id) x
  join documents using (doc_id))"""


# --- Small pictures from embedding vectors: as square as may be, each value a byte of three pixels. ---
def embedding_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pictures_of(table(spark, sf_dir, "embeddings"))


def pictures_of(vectors: DataFrame) -> DataFrame:
    """Vectors as BGR pictures: value -1..1 becomes 0..255, one to a pixel's blue, those 21 and 42 on its green and red."""
    byte = lambda x: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.round((x.cast("double") + 1) * 127.5).cast("int")))), 2, "0")
    rows = vectors.withColumn("bytes", F.transform("embedding", byte)).withColumn("n", F.size("embedding"))
    width = F.ceil(F.sqrt("n")).cast("int")
    height = F.ceil(F.col("n") / width).cast("int")
    at = lambda i: F.get("bytes", (i % F.col("n")).cast("int"))
    pixels = F.transform(F.sequence(F.lit(0), width * height - 1), lambda i: F.concat(at(i), at(i + 21), at(i + 42)))
    return rows.select(
        F.concat(F.lit("/pictures/"), F.col("vec_id").cast("string"), F.lit(".png")).alias("path"),
        height.alias("height"), width.alias("width"), F.lit(3).alias("nChannels"), F.unhex(F.array_join(pixels, "")).alias("data"),
    )




# --- Large pictures of two plain colours, one above the other, one picture a supplier. Colours by number: name, red, green, blue. ---
PLAIN_COLORS = [("black", 20, 20, 20), ("white", 250, 250, 250), ("red", 200, 20, 20), ("blue", 20, 40, 200), ("green", 20, 200, 40), ("yellow", 220, 200, 20)]
PLAIN_HEIGHT, PLAIN_WIDTH = 360, 400


def plain_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, height, width, nChannels, data: 5 to 355 of 360 lines in the first colour, the others in the second."""
    codes = F.array(*[F.lit(f"{b:02X}{g:02X}{r:02X}") for _, r, g, b in PLAIN_COLORS])
    n, height = len(PLAIN_COLORS), F.lit(PLAIN_HEIGHT)
    # On all cores, a supplier's rows on one: pictures of one name are one file, as the last of them leaves it.
    suppliers = table(spark, sf_dir, "supplier").repartition(spark.sparkContext.defaultParallelism, "s_suppkey")
    rows = suppliers.select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".png")).alias("name"), (5 + 5 * (F.col("s_suppkey") % 71)).cast("int").alias("lines"),
        F.get(codes, (F.col("s_suppkey") % n).cast("int")).alias("upper"), F.get(codes, (F.col("s_nationkey") % n).cast("int")).alias("lower"),
    )
    hexes = F.concat(F.repeat("upper", F.col("lines") * PLAIN_WIDTH), F.repeat("lower", (height - F.col("lines")) * PLAIN_WIDTH))
    return rows.select("name", height.alias("height"), F.lit(PLAIN_WIDTH).alias("width"), F.lit(3).alias("nChannels"), F.unhex(hexes).alias("data"))
