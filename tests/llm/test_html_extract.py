"""HTML extraction on written pages, and the style tree's own decisions."""

import math

import pytest
from forecourt.llm import html_extract
from forecourt.llm.html_extract import extract, main_text, parse, style_tree
from helpers import rows_of

CASES = [
    ("", ""),
    ("plain  text\n only", "plain text only"),
    ("<article><p>a<b>b</b>c<br>d</article>", "abc d"),
    ("<article><h1>T&eacute;</h1><p>one<p>two <i>x</i></p></article><footer>&copy; me</footer>", "Té one two x"),
    ("<html><head><title>no</title><script>var t='</p><article>';</script></head><body><nav><ul><li>m</ul></nav><article><p>yes</p></article></body>", "yes"),
    ("<body class='has-sidebar'><header>h</header><main><p>in</p></main><aside>s</aside>", "in"),
    ("<article><header><h1>Head</h1></header><p>body</p><section class='comments'><p>first!</p></section></article>", "Head body"),
    ("<article>real</article><article class='comment'>not</article>", "real"),
    ("<div class='ad'>buy</div><div id='cookieBanner'>ok?</div><div class='text'>keep</div><form>f<input></form>", "keep"),
    ("<article><p>one</p><!-- no --><div class='advert'><p>buy</p></div><p>two &amp; three &am</p>", "one two & three &am"),
    ("<article><p>cut <b", "cut"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><th>e</table><dl><dt>f<dd>g</dl></article>", "a b c d e f g"),
    ("<article><p hidden>h</p><p style='display: none'>n</p><p aria-hidden=true>i</p><p role=alert>r</p><p>x&nbsp;y</p></article>", "x y"),
    ("<article><p><b>bold<p>next</b> text</article>tail", "bold next text"),
    ("<noscript>n</noscript><style>p{}</style><textarea>t</textarea><p>p</p>", "p"),
    ("<article><p>a</p><button>go</button><figure><img alt=q><figcaption>cap</figcaption></figure></article>", "a cap"),
]


@pytest.mark.parametrize("html, text", CASES)
def test_one_page(html, text):
    assert main_text(parse(html)) == text


def pages_of(spark, rows, names="page_id long, url string, html string"):
    return spark.createDataFrame(rows, names).repartition(3)


def test_tree_removes_what_a_site_repeats(spark):
    html = "<body><div class=x1>Welcome to our wonderful site</div><div class=x2><p>story {i} about {j}</p><p>more on {j}</p></div></body>"
    rows = [(i, f"http://a.example/{i}", html.format(i=i, j=i * 7)) for i in range(30)]
    rows += [(100 + i, f"http://b.example/{i}", html.format(i=i, j=i)) for i in range(3)]
    got = {r[0]: r[1] for r in rows_of(extract(pages_of(spark, rows)), "page_id", "text")}
    assert got[4] == "story 4 about 28 more on 28"
    assert got[101] == "Welcome to our wonderful site story 1 about 1 more on 1"  # three pages prove nothing


def test_importance(spark):
    rows = [(f"<body><div class=same>s</div><div class=own>{i}</div></body>",) for i in range(16)]
    df = spark.createDataFrame([("h", r[0]) for r in rows], "host string, html string")
    got = {r["node"]: r for r in style_tree(df).collect()}
    same, own = got[html_extract.digest(">body>div.same")], got[html_extract.digest(">body>div.own")]
    assert same["content"] == pytest.approx(0) and own["content"] == pytest.approx(1)
    assert same["presentation"] == pytest.approx(0) and same["importance"] < html_extract.LOW < own["importance"]
    half = spark.createDataFrame([("h", f"<p>{i // 2}</p>") for i in range(16)], "host string, html string")
    assert style_tree(half).first()["content"] == pytest.approx(1 - math.log(2) / math.log(16))


def test_copies_of_one_page_keep_their_text(spark):
    rows = [(i, "http://c.example/", "<article><p>the only story</p></article>") for i in range(20)]
    assert {r[0] for r in rows_of(extract(pages_of(spark, rows)), "text")} == {"the only story"}


@pytest.mark.parametrize("bound", [100_000, 0])
def test_unique_pages_among_copies_keep_their_text(spark, monkeypatch, bound):
    monkeypatch.setattr(html_extract, "BROADCAST_ROWS", bound)
    page = lambda words, more="": "<body><article>" + "".join(f"<p>{w}</p>" for w in words) + more + "</article></body>"
    story = [f"part {k} of a story that many pages tell" for k in range(5)]
    own = [[f"only page {i} says this as its line {k}" for k in range(5)] for i in range(10)]
    rows = [(i, f"http://d.example/{i}", page(story, f"<div class=date>day {i}</div>")) for i in range(90)]
    rows += [(100 + i, f"http://d.example/u{i}", page(own[i], "<ul><li>a list</li></ul>" if i % 2 else "")) for i in range(10)]
    rows += [(200 + i, f"http://e.example/{i}", page(story)) for i in range(90)] + [(300 + i, f"http://e.example/u{i}", page(own[i // 2])) for i in range(20)]
    got = {r[0]: r[1] for r in rows_of(extract(pages_of(spark, rows)), "page_id", "text")}
    for i in range(90):
        assert got[i] == " ".join([*story, f"day {i}"]) and got[200 + i] == " ".join(story)
    for i in range(10):
        assert got[100 + i].startswith(" ".join(own[i]))
    assert all(got[300 + i] == " ".join(own[i // 2]) for i in range(20))


def test_odd_rows(spark, monkeypatch):
    long = "<article>" + "<p>word &lt; word</p>" * 50_000 + "</article>"
    deep = "<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(1, None, None), (2, "x", ""), (None, "http://h/", "<p>a</p>"), (3, "http://h/", long), (4, "http://h/", deep), (4, "http://h/", deep), (5, "http://h/", "\U0001f600")]
    got = rows_of(extract(pages_of(spark, [(*r, 1, "t") for r in rows], "page_id long, url string, html string, host int, text string")))
    want = [(1, None, ""), (2, "x", ""), (None, "http://h/", "a"), (3, "http://h/", " ".join(["word < word"] * 50_000)), (4, "http://h/", "deep"), (4, "http://h/", "deep"), (5, "http://h/", "\U0001f600")]
    assert got == sorted(((*w, len(w[2])) for w in want), key=str)
    assert extract(pages_of(spark, [])).collect() == []
    monkeypatch.setattr(html_extract, "BROADCAST_ROWS", -1)
    assert rows_of(extract(pages_of(spark, rows))) == got


def test_given_pages(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    html = {r["page_id"]: r["html"] for r in df.collect()}
    for r in extract(df).collect():
        inner = html[r["page_id"]].split("<article>")[1].split("</article>")[0]
        assert r["text"] == main_text(parse(f"<div>{inner}</div>")) and "<" not in r["text"]
