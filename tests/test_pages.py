import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from forecourt.functions import specs, urls
from forecourt.operators import catalog, export, images, pages
from forecourt.sources import images as image_source
from forecourt.sources import tables

PAGE = """<html><head><title>BMW M5 (F90) specs</title></head><body>
<div class="listing"><h2>x</h2><p>Price 55 000 лв</p><span>2019 г.</span><img src="/p/car.jpg" alt="BMW"><img src="icon.png">
<div style="background-image: url('//h/photo.jpg')">10 000 км</div></div>
<a id="aeng_m5-cs"></a><h3>Performance Specs</h3><table class="techdata"><tr><td>Top Speed:</td><td>305 km/h</td></tr>
<tr><td>only</td></tr></table><ul class="features"><li>A</li></ul></body></html>"""


@pytest.fixture(scope="module")
def rows(spark):
    source = spark.createDataFrame([(1, "https://x.example/a", PAGE), (2, "u", None)], "page_id long, url string, html string")
    return pages.elements(source, pages.TEXT_TAGS).checkpoint()


def test_container(rows):
    top = pages.top_containers(rows).orderBy("rank").first()
    assert (top.fields.price, top.fields.year, top.fields.mileage) == (55000.0, 2019, 10000)
    assert top.image_urls == ["https://h/photo.jpg", "https://www.mobile.bg/p/car.jpg"]
    parts = ["55000.0", "2019", "10000"]
    assert top.n_fields == 4 and top.score == (sum(map(len, parts)) + len(str(top.image_urls))) / 4


def test_spec_table(rows):
    row = catalog.spec_rows(rows).first()
    assert (row.category, row.key, row.value_num, row.unit) == ("performance_specs", "top_speed", 305.0, "km/h")
    wide = catalog.wide_specs(catalog.spec_rows(rows)).first()
    assert (wide.top_speed_kph, wide.top_speed_mph) == (305, 189)
    assert [r.feature for r in pages.highlight_features(rows).collect()] == ["A"]
    assert [r.caption for r in pages.gallery_images(rows).collect()] == ["BMW"]


def test_catalog_load_is_idempotent(spark):
    source = spark.createDataFrame([(1, "https://x.example/a", PAGE)], "page_id long, url string, html string")
    once = catalog.load_catalog(source, tables.empty_catalog(spark))
    row = catalog.catalog_chain(once).first()
    assert (row.brand, row.model, row.gen_name, row.version_name) == ("BMW", "M5", "F90", "Performance Specs")
    assert row.url == "https://x.example/a#aeng_m5-cs" and row.top_speed_kph == 305
    stored = {name: df.checkpoint() for name, df in once.items()}
    twice = catalog.load_catalog(source, stored)
    for name in ("brands", "models", "generations", "versions", "specs", "version_images"):
        assert twice[name].collect() == stored[name].collect(), name


def parsed(spark, function, value):
    return spark.range(1).select(function(F.lit(value)).alias("v")).first().v.asDict()


def test_units(spark):
    assert parsed(spark, specs.power, "467 KW @ 6000 RPM\n635 HP @ 6000 RPM\n626 BHP @ 6000 RPM") == {"kw": 467, "hp": 635, "bhp": 626, "rpm": 6000}
    assert parsed(spark, specs.torque, "553 lb-ft @ 1800-5950 RPM\n750 Nm @ 1800-5950 RPM") == {"lb_ft": 553, "nm": 750, "rpm_min": 1800, "rpm_max": 5950}
    assert parsed(spark, specs.dimension, "74.9 in (1902 mm)") == {"mm": 1902, "in": 74.9}
    assert parsed(spark, specs.fuel_economy, "13.9 mpg US (16.9 L/100Km)") == {"mpg": 13.9, "l_100km": 16.9}
    assert parsed(spark, specs.fuel_capacity, "18.5 gal (70 L)") == {"l": 70.0, "gal": 18.5}
    assert parsed(spark, specs.weight, "4,023 lbs (1825 kg)") == {"kg": 1825, "lbs": 4023}
    assert parsed(spark, specs.speed, "190 mph")["mph"] == 190
    assert parsed(spark, specs.value_and_unit, "750 Nm @ 1800-5950 RPM") == {"value_num": 750.0, "value_text": None, "unit": "Nm"}
    assert parsed(spark, specs.value_and_unit, "Petrol") == {"value_num": None, "value_text": "Petrol", "unit": None}
    assert parsed(spark, specs.value_and_unit, "") == {"value_num": None, "value_text": None, "unit": None}


def test_addresses(spark):
    row = spark.range(1).select(
        *[urls.absolute_url(F.lit(u), "https://b").alias(n) for n, u in (("a", "//h/x.jpg"), ("b", "/x.jpg"), ("c", "x.jpg"))],
        urls.image_filename(F.lit("https://x.example/a?photo=1"), F.lit("s")).alias("f"),
        urls.content_path("r", urls.checksum(F.lit("abc")), F.lit("n")).alias("p"),
        urls.best_source(F.lit("a 320w, b 2x, c 640w")).alias("s"), urls.is_car_image(F.lit("http://car/logo.png")).alias("i"),
    ).first()
    assert (row.a, row.b, row.c) == ("https://h/x.jpg", "https://b/x.jpg", "https://b/x.jpg")
    assert (row.f, row.p, row.s, row.i) == ("s_04fb64e9.jpg", "r/ba/78/n", "b", False)


@pytest.mark.parametrize("hsv, name", [
    ((0, 0, 59), "black"), ((0, 24, 201), "white"), ((0, 34, 171), "silver"), ((0, 34, 170), "gray"), ((10, 200, 200), "red"),
    ((20, 200, 121), "yellow"), ((20, 200, 120), "brown"), ((35, 90, 90), "green"), ((90, 90, 90), "blue"), ((12, 90, 90), "gray"),
])
def test_color_names(spark, hsv, name):
    assert spark.range(1).select(images.color_name(*[F.lit(x) for x in hsv]).alias("c")).first().c == name


def png(path, rgb, width=4, height=3):
    line = b"\0" + bytes(rgb) * width
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(
        b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0))
        + chunk(b"IDAT", zlib.compress(line * height)) + chunk(b"IEND", b"")
    )


def test_pictures(spark, tmp_path):
    folder = tmp_path / "pictures"
    folder.mkdir()
    png(folder / "a.png", (255, 0, 0))
    png(folder / "b.PNG", (255, 0, 0))
    png(folder / "c.png", (0, 0, 255), 8, 8)
    (folder / "d.webp").write_bytes(b"broken")
    (folder / "e.txt").write_bytes(b"no picture")
    found = {r.name: (r.color, r.confidence) for r in export.scan_colors(spark, str(folder)).collect()}
    assert found == {"a.png": ("red", 1.0), "b.PNG": ("red", 1.0), "c.png": ("blue", 1.0), "d.webp": (None, 0.0)}
    record = images.analyse(images.measure_images(image_source.decode_images(spark, str(folder)))).filter("path like '%a.png'").first()
    assert (record.blur_level, record.color, record.resolution, record.damage.damage_types) == (1.0, "red", "low", ["rust"])
    made = export.materialize_dataset(spark, str(folder), str(tmp_path / "out"))
    assert made.kept.count() == spark.read.csv(made.paths["metadata_csv"], header=True).count()
    assert image_source.scan_image_files(spark, str(tmp_path / "missing")).count() == 0


def test_what_is_parsed_is_never_sent_whole(spark):
    """A plan can tell little of the size of pages that it makes itself: joins of their elements shuffle."""
    made = spark.range(3).selectExpr("id as page_id", "concat('https://cars.example.com/', id) as url", "repeat('<p>x</p>', 3) as html")
    rows = pages.elements(made, pages.BRIEF_TAGS)
    for found in (catalog.page_bundle(rows), pages.generation_links(rows), catalog.flat_specs(catalog.spec_rows(rows))):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


class _ByParser(pages._Outline):
    """The same page, every character of it read by HTMLParser."""

    def _read(self, html):
        self.feed(html)


def test_outline_reads_as_the_parser_does():
    rng = random.Random(1)
    bits = ['<div class="a">', "</div>", "<p>", "</p>", "text", "a < b", "&amp;", "&lt", "&am", "p;", "<br/>", "<br>", "<BR />", "<!-- c > d -->", "<!--", "-->",
            "<!DOCTYPE html>", "<script>", "</script>", "if (a<b && c>d)", "<style>", "</style >", "<title>", "</title>", '<a href="x&amp;y">', "<A HREF='q' href=\"z\" b=3>",
            "</a>", "<?php x ?>", "</>", "</ p>", "<p", ">", '"', '<img src="a>b" alt="">', "<textarea>", "</textarea>", " \n ", '<x:y z="1">', '<p class="q"/>',
            '<table\nid="t" Class="u" class="v">', "&#x41;", "\r\n", "<plaintext>", "<h2 >"]
    told = lambda found: [(e.tag, e.attrs, e.depth, e.parent, e.last_ord, e.leaf, "".join(e.own), e.below()) for e in found]
    for _ in range(5_000):
        html = "".join(rng.choice(bits) for _ in range(rng.randint(1, 25)))
        assert told(pages._Outline().outline(html)) == told(_ByParser().outline(html)), html


def test_elements_makes_what_is_asked(spark):
    source = spark.createDataFrame([(1, '<div id="d">x<p>y <a href="h">z</a></p></div><p></p>'), (2, None)], "page_id bigint, html string")
    every = pages.elements(source, frozenset(["p"]))
    some = pages.elements(source, frozenset(["p"]), columns=["tag", "text", "attr_href"], tags=frozenset(["p", "a"]))
    assert some.columns == ["page_id", "ord", "tag", "text", "attr_href"]
    assert some.collect() == every.filter("tag in ('p', 'a')").select(some.columns).collect() and some.count() == 3


def test_generation_links_parse_pages_once(spark):
    html = ('<div class="carmodel"><h2><a href="/x">one</a><a href="">none</a></h2><a href="/y">no heading</a><h2><div class="carmodel"><a href="/z"> two </a></div></h2></div>'
            '<h2><div class="carmodel"><a href="/w">box inside</a></div></h2>')
    source = spark.createDataFrame([(1, html), (2, html.replace("one", "uno")), (2, html)], "page_id bigint, html string")
    found = pages.generation_links(pages.overview_elements(source), "https://b")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2  # one reads the pages, one passes over what was found
    assert plan.count("Scan ExistingRDD") == 1
    expected = {(1, "one", "https://b/x"), (1, "two", "https://b/z"), (2, "uno", "https://b/x"), (2, "one", "https://b/x"), (2, "two", "https://b/z")}
    assert sorted(tuple(r) for r in found.select("page_id", "name", "url").collect()) == sorted(expected)
    assert pages.generation_links(pages.elements(source, pages.BRIEF_TAGS), "https://b").count() == 5


def test_rows_leave_in_bounded_batches(spark, monkeypatch):
    """Pages larger and smaller than a batch; with texts, batches are cut by their length too."""
    monkeypatch.setattr(pages, "OUT_ROWS", 7)
    monkeypatch.setattr(pages, "OUT_CHARS", 20)
    htmls = ["<p>ab<i>c</i></p>" * n for n in (0, 1, 5, 40, 2)]
    given = pages.pa.RecordBatch.from_pydict({"page_id": list(range(5)), "html": htmls})
    kinds = {"page_id": pages.pa.int64(), "ord": pages.pa.int32(), "tag": pages.pa.string(), "own_text": pages.pa.string()}
    for texts in (False, True):
        schema = pages.pa.schema(list((kinds | ({"text": pages.pa.string()} if texts else {})).items()))
        found = list(pages._outlines(frozenset(["p"]), False, None, schema)(iter([given])))
        rows = [r for b in found for r in b.to_pylist()]
        assert max(b.num_rows for b in found) <= 7 and [(r["page_id"], r["ord"]) for r in rows] == [(i, o) for i, h in enumerate(htmls) for o in range(2 * h.count("<p>"))]
        assert [r["own_text"] for r in rows] == ["ab", "c"] * 48
        assert not texts or [r["text"] for r in rows] == ["abc", None] * 48
