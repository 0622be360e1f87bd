"""HTML extraction with a site style tree.

The pages of a host are merged into one tree of style nodes: a node is the chain of elements, with their classes, that
leads to it. Each node gets an importance from two entropies over the pages that have it. Its content counts little where
the same texts stand on page after page, and its presentation counts little where its parent always shows the same
children. Equal pages of a host count as one. Of branches of low importance each page loses the texts that another page
has there too; it also loses branches that their element, role, class or id names as menu, header, footer, side bar,
notice, advert, form or comments. What remains of the article (of the main part, or else of the body) is the text. If
the tree alone would leave a page less than a quarter of its words, it is a copy of others with little of its own, and
keeps what only the names leave.

White space in a block becomes one blank and blocks are joined by one blank. A null html gives an empty text; pages
without a host are one site; equal pages get equal texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forecourt.llm.common import Shared, cut_lineage, map_batches
from forecourt.llm.url_filter import host_and_path

CONTENT_SHARE = 0.8
LOW = 0.3
LEAST_PAGES = 8
LEAST_LEFT = 0.25
BROADCAST_ROWS = 100_000  # of about 60 bytes: 6 MB

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre search section select summary "
    "table tbody td tfoot th thead tr ul".split()
)
UNSEEN = frozenset("head script style template noscript noframes iframe object svg math canvas audio video textarea title".split())
CHROME = frozenset("nav footer aside form menu dialog button select datalist fieldset search".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
CHROME_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar aside footer header masthead topbar notice notices cookie cookies consent gdpr popup modal overlay "
    "newsletter subscribe subscription signup login form search share sharing social related recommended recommendations pagination "
    "pager toolbar widget alert copyright".split()
)
COMMENT_NAMES = frozenset("comment comments commentlist disqus discussion reply replies respond".split())
OWN_KIND = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",), "option": ("select",)}
SAME = {"dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}}
NAME_PARTS = re.compile(r"[a-z]+")


@dataclass(slots=True)
class Element:
    tag: str
    path: str
    chrome: bool
    unseen: bool
    article: bool
    main: bool
    children: list[str]


NO_NAMES: frozenset[str] = frozenset()
HEADER = frozenset(["header"])
TELLING = frozenset("class id role hidden aria-hidden style itemprop".split())
NOTHING_TOLD = ("", NO_NAMES, False, False, False)


@lru_cache(maxsize=2_000)
def _told(attrs: tuple[tuple[str, str | None], ...]) -> tuple[str, frozenset[str], bool, bool, bool]:
    """Of an element's attributes: its classes, the chrome they name, whether it is no content, the main part, an article's body."""
    given = dict(attrs)
    names = NAME_PARTS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", f"{given.get('class') or ''} {given.get('id') or ''}").lower())
    role = (given.get("role") or "").lower()
    hidden = (
        role in CHROME_ROLES or "hidden" in given or (given.get("aria-hidden") or "").lower() == "true"
        or "display:none" in (given.get("style") or "").replace(" ", "").lower()
    )
    classes = "".join(f".{x}" for x in sorted((given.get("class") or "").split()))
    return classes, (CHROME_NAMES | COMMENT_NAMES).intersection(names), hidden, role == "main", given.get("itemprop") == "articleBody"


class Page(HTMLParser):
    """Blocks of one page: (path, whether its names tell chrome, in an article, in the main part, text)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack = [Element("", "", False, False, False, False, [])]
        self.blocks: list[tuple[str, bool, bool, bool, str]] = []
        self.styles: list[tuple[str, tuple[str, ...]]] = []
        self.text: list[str] = []
        self.holder = self.stack[0]

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            e = self.holder
            self.blocks.append((e.path, e.chrome, e.article, e.main, text))
        self.text.clear()

    def pop_to(self, place: int) -> None:
        if any(e.tag in BLOCKS for e in self.stack[place:]):
            self.flush()
        for e in self.stack[place:]:
            if e.children:
                self.styles.append((e.path, tuple(e.children)))
        del self.stack[place:]

    def close_implied(self, tag: str) -> None:
        """A block ends an open paragraph; an item ends the item before it."""
        if tag in BLOCKS:
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag == "p":
                    self.pop_to(k)
                    break
                if self.stack[k].tag in BLOCKS:
                    break
            if self.stack[-1].tag == "head" or tag == "body":
                for k in range(len(self.stack) - 1, 0, -1):
                    if self.stack[k].tag == "head":
                        self.pop_to(k)
                        break
        if tag in OWN_KIND:
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag in OWN_KIND[tag]:
                    break
                if self.stack[k].tag in SAME.get(tag, {tag}):
                    self.pop_to(k)
                    break

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.text.append(" ")
            return
        self.close_implied(tag)
        if tag in BLOCKS:
            self.flush()
        if tag in VOID:
            return
        parent = self.stack[-1]
        telling = tuple([a for a in attrs if a[0] in TELLING])
        style, names, hidden, main, body = _told(telling) if telling else NOTHING_TOLD
        if tag in ("html", "body", "main"):
            chrome = False
        elif tag == "article":
            chrome = not names.isdisjoint(COMMENT_NAMES)
        else:
            chrome = hidden or tag in CHROME or tag == "header" and not parent.article or bool(names and names - (HEADER if parent.article else NO_NAMES))
        style = tag + style
        block = tag in BLOCKS
        self.stack.append(Element(
            tag, f"{parent.path}>{style}" if block else parent.path, parent.chrome or chrome, parent.unseen or tag in UNSEEN,
            parent.article or tag == "article" or body, parent.main or tag == "main" or main, [],
        ))
        if block:
            parent.children.append(style)

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers are not asked for

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # the slash means nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.text.append(" ")
        inline = tag not in BLOCKS
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                self.pop_to(k)
                return
            if inline and self.stack[k].tag in BLOCKS and not self.stack[k].unseen:
                return

    def handle_data(self, data: str) -> None:
        element = self.stack[-1]
        if element.unseen:
            return
        if self.text and (self.holder.path, self.holder.chrome) != (element.path, element.chrome):
            self.flush()
        if not self.text:
            self.holder = element
        self.text.append(data)


UNFINISHED = re.compile(r"<[a-zA-Z/!][^>]*\Z")


def parse(html: str) -> Page:
    page = Page()
    tail = UNFINISHED.search(html, max(0, html.rfind("<")))
    page.feed(html[: tail.start()] if tail else html)
    page.close()
    page.flush()
    page.pop_to(1)
    return page


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _place(host: str | None, path: str, text: str) -> int:
    """The key of a text in a style node of a host."""
    return digest(f"{host}\0{path}\0{text}")


def main_text(page: Page, low: frozenset[int] = frozenset(), host: str | None = None) -> str:
    blocks = [b for b in page.blocks if not b[1]]
    for part in (2, 3):
        if any(b[part] for b in blocks):
            blocks = [b for b in blocks if b[part]]
            break
    whole = [b[4] for b in blocks]
    left = [b[4] for b in blocks if _place(host, b[0], b[4]) not in low] if low else whole
    if len(left) < len(whole) and sum(len(x.split()) for x in left) < LEAST_LEFT * sum(len(x.split()) for x in whole):
        left = whole
    return " ".join(left)


STATS = "host string, node long, kind int, value long, parent long, copies long"


def _style_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page its style nodes (kind 0), their texts (1, with their keys) and the children that elements show (2), each once."""
    for batch in batches:
        for start in range(0, batch.num_rows, 200):
            part = batch.slice(start, 200)
            rows = []
            for host, html, copies in zip(*[part.column(c).to_pylist() for c in ("host", "html", "copies")], strict=True):
                page = parse(html or "")
                found = {(digest(b[0]), 0, 0, digest(b[0].rpartition(">")[0])) for b in page.blocks}
                found |= {(digest(b[0]), 1, digest(b[4]), _place(host, b[0], b[4])) for b in page.blocks}
                found |= {(digest(path), 2, digest(" ".join(children)), 0) for path, children in page.styles}
                rows += [(host, *x, copies) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                                             names=["host", "node", "kind", "value", "parent", "copies"])


def _counted(pages: DataFrame) -> DataFrame:
    """(host, node, kind, value, n, parent): on how many pages; one that is there ``copies`` times counts as one."""
    n = F.greatest(F.round(F.sum(1 / F.col("copies"))).cast("long"), F.lit(1))
    return map_batches(pages, _style_rows, STATS).groupBy("host", "node", "kind", "value").agg(n.alias("n"), F.max("parent").alias("parent"))


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, node, parent, pages, content, presentation, importance) of every style node that holds text, every page counted."""
    return _importance(_counted(pages.withColumn("copies", F.lit(1).cast("long"))))


def _importance(counted: DataFrame) -> DataFrame:
    summed = counted.groupBy("host", "node").agg(
        F.max(F.when(F.col("kind") == 0, F.col("n"))).alias("pages"),
        F.max(F.when(F.col("kind") == 0, F.col("parent"))).alias("parent"),
        F.sum(F.when(F.col("kind") == 1, F.col("n"))).alias("texts"),
        F.sum(F.when(F.col("kind") == 1, F.col("n") * F.log("n"))).alias("text_logs"),
        F.sum(F.when(F.col("kind") == 2, F.col("n"))).alias("shown"),
        F.sum(F.when(F.col("kind") == 2, F.col("n") * F.log("n"))).alias("shown_logs"),
    )
    summed = cut_lineage(summed)
    entropy = (F.log("shown") - F.col("shown_logs") / F.col("shown")) / F.log("shown")
    shows = summed.where("shown is not null").select("host", F.col("node").alias("parent"), F.when(F.col("shown") > 1, entropy).otherwise(1.0).alias("presentation"))
    content = F.when(F.col("pages") > 1, 1 - F.col("text_logs") / F.col("texts") / F.log("pages")).otherwise(1.0)
    nodes = summed.where("pages is not null").select("host", "node", "parent", "pages", content.alias("content")).join(shows, ["host", "parent"], "left")
    importance = CONTENT_SHARE * F.col("content") + (1 - CONTENT_SHARE) * F.coalesce("presentation", F.lit(1.0))
    return nodes.withColumn("importance", importance)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of each page's texts."""
    for batch in batches:
        for mark, host, html in zip(*[batch.column(c).to_pylist() for c in ("mark", "host", "html")], strict=True):
            found = list({_place(host, b[0], b[4]) for b in parse(html or "").blocks})
            yield pa.RecordBatch.from_arrays([pa.array([mark] * len(found), pa.int64()), pa.array(found, pa.int64())], names=["mark", "place"])


def _texts(shared: Shared | None):
    """Texts without the places of low importance: the same for all pages, or each page's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                low = [shared.value()] * part.num_rows if shared else [frozenset(x or ()) for x in part.column("low").to_pylist()]
                texts = [main_text(parse(html or ""), own, host) for html, host, own in zip(part.column("html").to_pylist(), part.column("host").to_pylist(), low, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html)."""
    host, _ = host_and_path(F.col("url").cast("string"))
    rows = pages.select("page_id", "url", "html", host.alias("host")).withColumn("mark", F.xxhash64("host", "html"))
    again = cut_lineage(rows.groupBy("mark").agg(F.count("*").alias("copies")).where("copies > 1"))
    again = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    told = rows.select("mark", "host", "html").join(again, "mark", "left").select("host", "html", F.coalesce("copies", F.lit(1)).alias("copies"))
    counted = cut_lineage(_counted(told))
    low = _importance(counted).where((F.col("importance") < LOW) & (F.col("pages") >= LEAST_PAGES)).select("host", "node")
    repeated = counted.where("kind = 1 and n > 1").join(low, ["host", "node"], "left_semi")
    places = cut_lineage(repeated.select(F.col("parent").alias("place")).distinct())
    kind = pages.schema["page_id"].dataType.simpleString()
    ddl = f"page_id {kind}, url string, text string"
    if places.count() <= BROADCAST_ROWS:
        shared = Shared(pages.sparkSession, frozenset(r[0] for r in places.collect()))
        texts = map_batches(rows.select("page_id", "url", "html", "host"), _texts(shared), ddl)
    else:
        own = map_batches(rows.select("mark", "host", "html").join(low.select("host").distinct(), "host", "left_semi"), _places, "mark long, place long")
        own = own.distinct().join(places, "place").groupBy("mark").agg(F.collect_list("place").alias("low"))
        texts = map_batches(rows.join(own, "mark", "left").select("page_id", "url", "html", "host", "low"), _texts(None), ddl)
    return texts.withColumn("n_chars", F.length("text").cast("long"))
