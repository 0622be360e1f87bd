import pytest

from pyspark.sql import functions as F

from forecourt.operators import ingest, listings, media
from forecourt.sources import buckets
from forecourt.streaming import ingest as stream

KEY = ["source_site", "source_id"]


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([(1, "s", "1", "old", 5.0)], "id long, source_site string, source_id string, title string, price double")


@pytest.fixture(scope="module")
def batch(spark):
    return spark.createDataFrame(
        [(0, "s", "1", "new", 6.0), (1, "s", "2", "x", 7.0), (2, "s", "2", "y", None)],
        "ord int, source_site string, source_id string, title string, price double",
    )


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_insert_if_absent(target, batch):
    once = ingest.insert_if_absent(target, batch, KEY, "ord")
    assert rows(once, "source_id", "title") == [("1", "old"), ("2", "x")]
    assert rows(ingest.insert_if_absent(once, batch, KEY, "ord"), "source_id", "title") == rows(once, "source_id", "title")


def test_upsert(target, batch):
    once = ingest.upsert(target, batch, KEY, "ord", ["title", "price"])
    assert rows(once, "source_id", "title") == [("1", "new"), ("2", "y")]
    assert once.filter("source_id = 2 and price is null").count() == 1
    twice = ingest.upsert(once, batch, KEY, "ord", ["title", "price"])
    assert rows(twice.fillna(-1.0), *target.columns) == rows(once.fillna(-1.0), *target.columns)
    assert once.filter("source_id = 1").first().id == 1


def test_first_value_for_insert_columns(target, batch):
    out = ingest.upsert(target, batch, KEY, "ord", ["price"], ["title"])
    assert rows(out, "source_id", "title") == [("1", "old"), ("2", "x")]


def test_new_images_decide_new_ads(spark):
    batch_ads = spark.createDataFrame([("s", "known"), ("s", "fresh"), ("s", "stale")], "source_site string, source_id string")
    images = spark.createDataFrame(
        [(0, "s", "known", "a"), (1, "s", "fresh", "b"), (2, "s", "stale", "a"), (3, "s", "stale", "b")],
        "ord int, source_site string, source_id string, checksum string",
    )
    fresh = ingest.new_images(spark.createDataFrame([("a",)], "checksum string"), images, "ord")
    assert rows(fresh, "source_id", "checksum") == [("fresh", "b")]
    known = spark.createDataFrame([("s", "known")], "source_site string, source_id string")
    assert rows(ingest.ads_to_keep(batch_ads, known, fresh), "source_id") == [("fresh",), ("known",)]


SCHEMA = "source_site string, source_id string, scraped_at int, title string"


class Ingest:
    """A folder of ads that arrive, and runs over it."""

    def __init__(self, spark, root, known=None):
        self.spark, self.root = spark, str(root)
        self.schema = spark.createDataFrame([], SCHEMA).schema
        self.known = known
        if known is not None:
            spark.createDataFrame(known, "source_site string, source_id string").write.parquet(f"{root}/known")

    def arrive(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.root}/in")

    def run(self, target="out"):
        source = stream.ad_stream(self.spark, f"{self.root}/in", self.schema, 1)
        known = stream.ad_stream(self.spark, f"{self.root}/known", self.schema[:2]) if self.known is not None else None
        query = stream.start_ingest(source, f"{self.root}/{target}", f"{self.root}/progress", known=known)
        query.awaitTermination()
        return query

    def rows(self, target="out"):
        return rows(stream.read_ingested(self.spark, f"{self.root}/{target}"), "source_id", "title")


def test_stream_keeps_one_row_per_key(spark, tmp_path):
    box = Ingest(spark, tmp_path)
    box.arrive([("s", "1", 2, "later"), ("s", "1", 1, "first"), ("s", "2", 1, "x"), ("s", None, 1, "no ad"), (None, "9", 1, "no ad")])
    box.run()
    box.arrive([("s", "1", 0, "too late"), ("s", "3", 1, "z"), ("s", "3", None, "before all")])
    box.run()
    box.run()
    assert box.rows() == [("1", "first"), ("2", "x"), ("3", "before all")]


def test_stream_never_reads_its_target(spark, tmp_path):
    """A later run that writes elsewhere knows the keys all the same, and reads what is new only."""
    box = Ingest(spark, tmp_path)
    box.arrive([("s", str(i), 1, "old") for i in range(200)])
    box.run()
    box.arrive([("s", str(i), 1, "new") for i in range(150, 205)])
    query = box.run("elsewhere")
    assert box.rows("elsewhere") == [(str(i), "new") for i in range(200, 205)]
    assert sum(p["numInputRows"] for p in query.recentProgress) == 55
    plan = query._jsq.explainInternal(False)
    assert "StateStoreSave" in plan and "/out" not in plan and "/elsewhere" not in plan


def test_stream_with_known_keys(spark, tmp_path):
    box = Ingest(spark, tmp_path, known=[("s", "1"), ("s", "7"), ("s", None)])
    box.arrive([("s", "1", 1, "known"), ("s", "2", 1, "x")])
    box.run()
    box.arrive([("s", "7", 1, "known"), ("s", "2", 0, "late"), ("s", "8", 1, "y")])
    box.run()
    assert box.rows() == [("2", "x"), ("8", "y")]


def test_batch_run_again_adds_nothing(spark, tmp_path):
    batch = spark.createDataFrame([("s", "1", "a")], "source_site string, source_id string, title string")
    seen = batch.selectExpr("struct(*) as first", "timestamp'2024-01-01' as first_seen", "timestamp'2024-01-01' as last_seen")
    for _ in range(2):
        stream.write_new(str(tmp_path / "out"), "x")(seen, 3)
    assert rows(stream.read_ingested(spark, str(tmp_path / "out")), "source_id", "title") == [("1", "a")]


def files_of(path):
    return {f.parent.name: f.name for f in path.rglob("*.parquet") if "staging" not in str(f)}


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    path = tmp_path / "ads"
    old = spark.range(300).selectExpr("id", "'s' as source_site", "cast(id as string) as source_id", "'old' as title")
    buckets.write_buckets(old, str(path), KEY, 16)
    before = files_of(path)
    batch = spark.createDataFrame([("s", "5", "new", 1), ("s", "900", "added", 1), ("s", "5", "newer", 2)], "source_site string, source_id string, title string, ord int")
    touched = buckets.upsert_buckets(str(path), batch, KEY, "ord", ["title"], n_buckets=16)
    after = files_of(path)
    assert 1 <= len(touched) <= 2 and len(before) == 16
    assert {b for b in before if before[b] != after[b]} == {f"key_bucket={b}" for b in touched}
    found = dict(rows(buckets.read_buckets(spark, str(path)), "source_id", "title"))
    assert len(found) == 301 and found["5"] == "newer" and found["900"] == "added" and found["6"] == "old"
    buckets.upsert_buckets(str(path), batch, KEY, "ord", ["title"], n_buckets=16)  # a batch run again
    assert dict(rows(buckets.read_buckets(spark, str(path)), "source_id", "title")) == found
    assert buckets.upsert_buckets(str(path), batch.limit(0), KEY, "ord", ["title"], n_buckets=16) == []


def test_upsert_that_dies_leaves_the_table(spark, tmp_path):
    """A task that fails, and files that were written but never published."""
    path = tmp_path / "ads"
    old = spark.range(100).selectExpr("id", "'s' as source_site", "cast(id as string) as source_id", "'old' as title")
    buckets.write_buckets(old, str(path), KEY, 4)
    before = files_of(path)
    bad = old.select("source_site", "source_id", F.when(F.col("id") == 77, F.raise_error("lost")).otherwise("new").alias("title"), F.col("id").alias("ord"))
    with pytest.raises(Exception, match="lost"):
        buckets.upsert_buckets(str(path), bad, KEY, "ord", ["title"], n_buckets=4)
    staged = path / ".spark-staging-1" / "key_bucket=1"
    staged.mkdir(parents=True)
    (staged / "part-0.parquet").write_bytes((next(path.rglob("key_bucket=1/*.parquet"))).read_bytes())
    assert files_of(path) == before
    assert rows(buckets.read_buckets(spark, str(path)), "source_id", "title") == sorted((str(i), "old") for i in range(100))


def test_upsert_into_a_new_table(spark, tmp_path, batch, target):
    path = str(tmp_path / "ads")
    buckets.upsert_buckets(path, batch, KEY, "ord", ["title", "price"], n_buckets=4, columns=target)
    assert rows(buckets.read_buckets(spark, path), "source_id", "title") == [("1", "new"), ("2", "y")]


def test_numbered_files(spark):
    files = spark.createDataFrame([(i, "f", "a.jpg" if i % 3 else ".x") for i in range(40)], "ord long, folder string, name string")
    plain = rows(media.numbered_files(files), "ord", "file_name")
    assert plain[:3] == [(0, ".x"), (1, "a.jpg"), (2, "a-1.jpg")] and plain[3] == (3, ".x-1")
    assert len({name for _, name in plain}) == 40
    hot = spark.range(3000).selectExpr("concat('k', lpad(id, 6, '0')) as ord", "'f' as folder", "if(id % 10 = 0, 'b.png', 'a.jpg') as name")
    found = {r.ord: r.file_name for r in media.numbered_files(hot).collect()}
    count = {"a.jpg": 0, "b.png": 0}
    for i in range(3000):
        name = "a.jpg" if i % 10 else "b.png"
        stem, end = name.split(".")
        assert found[f"k{i:06d}"] == (name if not count[name] else f"{stem}-{count[name]}.{end}")
        count[name] += 1


def test_colour_enrichment(spark):
    ads = spark.createDataFrame(
        [(1, True, ["p1", "p2"], 5), (2, True, ["p2"], 4), (3, True, [], 3), (4, False, ["p1"], 2)],
        "id long, is_active boolean, local_image_paths array<string>, scraped_at int",
    )
    colors = spark.createDataFrame([("p1", "red", 0.5), ("p2", None, 0.0)], "path string, color string, confidence double")
    enriched = spark.createDataFrame([(9, 2, "blue", 0.1)], "id long, raw_ad_id long, detected_color string, detected_color_confidence double")
    out = media.enrich_with_colors(enriched, ads, colors)
    assert rows(out, "raw_ad_id", "detected_color", "detected_color_confidence") == [(1, "red", 0.5), (2, "blue", 0.1)]


def test_listing_filters(spark):
    ads = spark.createDataFrame(
        [(1, "BMW", "M5", 2020, True, 3, "ok 100% sound"), (2, "bmw", "X5", 2020, True, 3, "Salvage"), (3, "Audi", "A4", 2019, False, 1, None)],
        "id long, make string, model string, year int, is_active boolean, scraped_at int, title string",
    )
    assert rows(listings.filter_ads(ads, make="Bm", year=2020), "id") == [(1,), (2,)]
    assert rows(listings.filter_ads(ads, make="%"), "id") == []  # a wildcard is only a character
    assert rows(listings.filter_ads(ads, is_active=False), "id") == [(3,)]
    assert [r.id for r in listings.list_ads(ads, 0, 2).collect()] == [2, 1]
    assert rows(listings.matches_config(ads, exclude_keywords=("salvage",)), "id") == [(1,), (3,)]
    with pytest.raises(ValueError):
        listings.page_of(ads, 0, 101)


def test_empty_summary(spark):
    ads = spark.createDataFrame([], "is_active boolean, is_processed boolean")
    row = listings.stats_summary(ads, spark.createDataFrame([], "id long")).first()
    assert (row.total_ads, row.enrichment_rate) == (0, 0.0)


def test_one_owner(spark):
    images = spark.createDataFrame([(1, 1, None, None), (2, 1, 2, None), (3, None, None, None)], "id int, ad_id int, variant_id int, unique_car_id int")
    assert rows(listings.one_owner(images), "id") == [(1,)]


def test_link_images_keeps_first_paths(spark):
    ads = spark.createDataFrame([(1, ["old"]), (2, ["kept"])], "id long, local_image_paths array<string>")
    done = spark.createDataFrame([(1, i, f"p{i}") for i in (2, 0, 1)], "ad_id long, position int, path string")
    out = {r.id: r.local_image_paths for r in media.link_images(ads, done, 2).collect()}
    assert out == {1: ["p0", "p1"], 2: ["kept"]}


def test_orphan_links_reads_every_order(spark, tmp_path):
    from forecourt.plans import registry

    registry.load_all()
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, 1), (13, 2)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    assert rows(registry.QUERIES["orphan_links"](spark, str(tmp_path)), "ad_id", "source_id") == [(3, "c")]


def test_addresses_travel_without_their_hashes(spark):
    ads = spark.createDataFrame([(1, "s", ["http://h/a.jpg", None, "http://h/c"]), (2, "t", None), (3, "u", ["http://h/a.jpg"])], "id int, source_id string, image_urls array<string>")
    index = spark.createDataFrame([("http://h/c",), ("http://h/z",), (None,)], "url string").select(F.md5("url").alias("url_hash"))
    found = media.urls_to_download(ads, index, 3)
    assert found.columns == ["url_hash", "ad_id", "source_id", "url", "filename"]
    wanted = found.select("ad_id", "url", F.expr("url_hash <=> md5(url)").alias("hashed")).collect()
    assert sorted(map(tuple, wanted), key=str) == [(1, "http://h/a.jpg", True), (1, None, True), (3, "http://h/a.jpg", True)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = media.urls_to_download(ads, index, 3)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(md5(" in plan and "hashpartitioning(url_hash" not in plan
