"""Pages as nested intervals, against plain loops over all elements inside each other."""

import random

import pytest
from pyspark.sql import functions as F

from forecourt.functions import text
from forecourt.operators import pages

WORDS = ["2019 г.", "55 000 лв", "10 000 км", "625 к.с.", "Diesel", "blue", "София", "text", "1 200 лв", "1995"]


def made_page(rng, depth=0):
    out = []
    for _ in range(rng.randint(1, 4 if depth < 3 else 2)):
        kind = rng.random()
        if kind < 0.25:
            out.append(rng.choice(WORDS) + rng.choice(["", " ", "\n"]))
        elif kind < 0.4:
            out.append(f'<img src="/photo/{rng.randint(1, 4)}.jpg">')
        elif kind < 0.5:
            out.append(rng.choice(["<br>", "<!-- x -->", "<script>2001</script>", "</b>", "<hr/>"]))
        else:
            tag = rng.choice(["div", "span", "p", "li", "section", "b", "a", "template"])
            style = f" style=\"background-image: url('/photo/{rng.randint(1, 4)}.jpg')\"" if rng.random() < 0.2 else ""
            out.append(f"<{tag}{style}>{made_page(rng, depth + 1) if depth < 6 else ''}" + (f"</{tag}>" if rng.random() < 0.9 else ""))
    return "".join(out)


@pytest.fixture(scope="module")
def source(spark):
    rng = random.Random(4)
    rows = [(i, f"u{i}", made_page(rng)) for i in range(150)] + [(150, "u", None), (151, None, "")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5).cache()


@pytest.fixture(scope="module")
def tree(source):
    rows = pages.elements(source, pages.TEXT_TAGS).withColumn("shown", pages.car_pictures())
    rows = text.with_fields(rows, "text", "own").withColumn("printed", F.struct(*[F.col(f"own.{f}").cast("string").alias(f) for f in text.FIELDS]))
    found = {}
    for r in rows.orderBy("page_id", "ord").collect():
        found.setdefault(r["page_id"], []).append(r)
    return found


def test_intervals_are_the_tree(tree):
    for rows in tree.values():
        for i, r in enumerate(rows):
            assert r["ord"] == i and (r["parent_ord"] < i if i else r["parent_ord"] == -1)
            inside = {i}
            for other in rows[i + 1 :]:
                if other["parent_ord"] in inside:
                    inside.add(other["ord"])
            assert inside == set(range(i, r["last_ord"] + 1))
            assert r["depth"] == (rows[r["parent_ord"]]["depth"] + 1 if r["parent_ord"] >= 0 else 0)
            texts = [o for o in rows[i + 1 : r["last_ord"] + 1] if o["tag"] in pages.TEXT_TAGS]
            assert r["leaf"] == (r["tag"] in pages.TEXT_TAGS and not texts)


def test_top_containers(source, tree):
    want = []
    for page_id, rows in tree.items():
        scored = []
        for r in rows:
            if r["tag"] not in pages.LISTING_TAGS or not r["text"]:
                continue
            inside = rows[r["ord"] + 1 : r["last_ord"] + 1]
            fields = {}
            for f in text.FIELDS:
                values = [o for o in inside if o["tag"] in pages.DETAIL_TAGS and o["text"] and o["own"][f] is not None] + [r]
                fields[f] = (values[0]["own"][f], values[0]["printed"][f])
            pictures = sorted({u for o in inside for u in o["shown"]}) or None
            sizes = [len(p) for _, p in fields.values() if p is not None] + ([sum(len(u) + 4 for u in pictures)] if pictures else [])
            if len(sizes) >= 2:
                scored.append((-sum(sizes) / len(sizes), r["ord"], len(sizes), {f: v for f, (v, _) in fields.items()}, pictures))
        scored.sort(key=lambda c: c[:2])
        want += [(page_id, ord_, rank, n, -score, fields, pictures) for rank, (score, ord_, n, fields, pictures) in enumerate(scored[:6], 1)]
    top = pages.top_containers(pages.elements(source, pages.LISTING_TEXTS), 6)
    got = [(r["page_id"], r["ord"], r["rank"], r["n_fields"], r["score"], r["fields"].asDict(), r["image_urls"]) for r in top.orderBy("page_id", "rank").collect()]
    assert len(got) > 150 and got == want


def test_inside(source, tree):
    rows = pages.elements(source)
    found = pages.inside(rows.select("page_id", "ord", F.col("tag").alias("kind")), rows.filter(F.col("tag").isin("div", "li")))
    want = sorted((p, o["ord"], o["tag"], r["ord"]) for p, rows in tree.items() for r in rows if r["tag"] in ("div", "li") for o in rows[r["ord"] + 1 : r["last_ord"] + 1])
    assert sorted(tuple(r) for r in found.select("page_id", "ord", "kind", "holder").collect()) == want


def test_texts_of_chosen(source, tree):
    chosen = pages.elements(source).filter("ord % 3 = 1").select("page_id", "ord", "tag")
    got = pages.texts_of(chosen, source).join(chosen, ["page_id", "ord"]).filter(F.col("tag").isin(*pages.TEXT_TAGS)).collect()
    assert len(got) > 50
    assert all((r["text"], r["raw_text"], r["source_url"]) == (tree[r["page_id"]][r["ord"]]["text"], tree[r["page_id"]][r["ord"]]["raw_text"], f"u{r['page_id']}") for r in got)


def test_deep_pages_stay_as_large_as_they_are(spark):
    """500 containers in each other: the rows hold the page's text once, and one pass finds the outermost ones."""
    depth = 500
    html = "".join(f"<div>row {i} " for i in range(depth)) + '<span>2019 г.</span><span>10 000 км</span><img src="/photo/1.jpg">' + "</div>" * depth
    source = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    rows = pages.elements(source).collect()
    assert len(rows) == depth + 3
    assert sum(len(v) for r in rows for v in r if isinstance(v, str)) < 2 * len(html)
    assert [r["last_ord"] for r in rows] == [depth + 2] * depth + [depth, depth + 1, depth + 2]
    top = pages.top_containers(pages.elements(source, pages.LISTING_TEXTS), 20).collect()
    assert [r["ord"] for r in top] == list(range(20)) and {r["fields"]["mileage"] for r in top} == {10000}


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert pages.elements(none).collect() == [] and pages.listings(none).collect() == []
