"""Page structure as rows: elements, listings, links, images, features."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from heapq import nsmallest
from html import unescape
from html.parser import HTMLParser
from operator import attrgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from forecourt.functions import fixed, text, urls
from forecourt.operators.ingest import first_per_key
from forecourt.session import cut_lineage, ship_package

# Elements that have no content and close themselves. Fixed values.
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr basefont bgsound command "
    "frame image isindex nextid spacer keygen menuitem".split()
)
SILENT_TAGS = frozenset(["script", "style", "template"])  # their text belongs to no other element
LISTING_TAGS = ["div", "article", "section", "li"]
DETAIL_TAGS = ["span", "div", "p"]
TEXT_TAGS = frozenset([
    *LISTING_TAGS, *DETAIL_TAGS, "title", "a", "h1", "h2", "h3", "h4", "td", "th", "ul",
])
# Elements whose whole text the catalog, links and features read; they seldom hold each other.
LISTING_TEXTS = frozenset([*LISTING_TAGS, *DETAIL_TAGS])
BRIEF_TAGS = frozenset(["title", "a", "h1", "h2", "h3", "h4", "td", "th", "li", "p"])
ATTRIBUTES = ["id", "class", "href", "src", "data-src", "style", "alt", "title", "data-feature", "srcset"]

FIELD_COLUMNS = ["last_ord", "tag", "text", "attr_src", "attr_data_src", "attr_style"]  # what ``top_containers`` reads

ELEMENTS = (
    "page_id bigint, ord int, last_ord int, parent_ord int, depth int, leaf boolean, tag string, own_text string, text string, "
    "raw_text string, " + ", ".join(f"attr_{a.replace('-', '_')} string" for a in ATTRIBUTES)
)
ATTRIBUTE_OF = {f"attr_{a.replace('-', '_')}": a for a in ATTRIBUTES}
OUT_ROWS, OUT_CHARS = 20_000, 4 << 20
# Tags that any parser reads alike; whatever else a page holds is left to HTMLParser, and so are elements it reads as plain text.
TEXT_AND_TAG = re.compile("([^<]*)(<[^<>]*>)")
PLAIN_TAG = re.compile(r"""<(?:/([a-zA-Z][a-zA-Z0-9]*)>|([a-zA-Z][a-zA-Z0-9]*)((?:[ \n]+[a-zA-Z][-a-zA-Z0-9_]*="[^"&]*")*)[ \n]*>)""")
PLAIN_ATTRIBUTE = re.compile(r'([a-zA-Z][-a-zA-Z0-9_]*)="([^"]*)"')
UNPARSED_TAGS = frozenset("script style title textarea iframe noembed noframes noscript xmp plaintext".split())
SEEN_TAGS = 10_000


class _Stream:
    """Pieces of text in page order, with and without the white space around them."""

    def __init__(self) -> None:
        self.raw: list[str] = []
        self.stripped: list[str] = []


class _Element:
    __slots__ = ("attrs", "depth", "first", "last", "last_ord", "leaf", "own", "parent", "stream", "tag")

    def __init__(self, tag: str, attrs: dict, parent: int, depth: int, stream: _Stream) -> None:
        self.tag, self.attrs, self.parent, self.depth, self.stream = tag, attrs, parent, depth, stream
        self.first = self.last = len(stream.raw)
        self.own: list[str] | tuple = ()
        self.last_ord = -1
        self.leaf = tag in TEXT_TAGS  # until a text element begins inside

    def below(self) -> list[str]:
        return ["".join(pieces[self.first : self.last]) for pieces in (self.stream.stripped, self.stream.raw)]


_seen_tags: dict[str, tuple[str, dict | None]] = {}  # of a worker: what ``_plain_tag`` says of tags as they are written


def _plain_tag(written: str) -> tuple[str, dict | None] | None:
    """Name and attributes of a tag, no attributes for the end of an element, nothing if the tag is left to HTMLParser."""
    tag = PLAIN_TAG.fullmatch(written)
    name = tag and (tag[1] or tag[2]).lower()
    if not tag or (tag[2] and name in UNPARSED_TAGS):
        return None
    known = name, None if tag[1] else {a.lower(): value for a, value in reversed(PLAIN_ATTRIBUTE.findall(tag[3]))}
    if len(_seen_tags) < SEEN_TAGS:
        _seen_tags[written] = known
    return known


class _Outline(HTMLParser):
    """Elements of a page as nested intervals, in order of their start: every element knows the number of the last one
    inside it, and which run of the page's pieces of text lies below it. Nothing is repeated for the elements around."""

    def __init__(self, keep_texts: bool = True) -> None:
        super().__init__(convert_charrefs=True)
        self.keep_texts = keep_texts  # else only an element's own text is known
        self.elements: list[_Element] = []
        self.open: list[int] = []
        self.streams = [_Stream()]
        self.pending: list[str] = []
        self.open_tags: dict[str, int] = {}
        self.open_texts: list[int] = []

    def handle_starttag(self, tag, attrs):
        if self.pending:
            self._flush()
        self._start(tag, dict(reversed(attrs)))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.pending:
            self._flush()
        self._leave(tag)

    def handle_data(self, data):
        self.pending.append(data)

    def handle_comment(self, data):
        if self.pending:
            self._flush()

    def _start(self, tag: str, attrs: dict) -> None:
        elements, open_ = self.elements, self.open
        number = len(elements)
        if tag in SILENT_TAGS:
            self.streams.append(_Stream())
        element = _Element(tag, attrs, open_[-1] if open_ else -1, len(open_), self.streams[-1])
        elements.append(element)
        if element.leaf and self.open_texts:
            elements[self.open_texts[-1]].leaf = False
        if tag == "br":
            self._write("\n", "")
        if tag in VOID_TAGS:
            element.last_ord, element.last = number, element.first
        else:
            open_.append(number)
            self.open_tags[tag] = self.open_tags.get(tag, 0) + 1
            if element.leaf:
                self.open_texts.append(number)

    def _leave(self, tag: str) -> None:
        if self.open_tags.get(tag):
            while self._end() != tag:
                pass

    def _end(self) -> str:
        number = self.open.pop()
        if self.open_texts and self.open_texts[-1] == number:
            self.open_texts.pop()
        element = self.elements[number]
        element.last_ord, element.last = len(self.elements) - 1, len(element.stream.raw)
        self.open_tags[element.tag] -= 1
        if element.tag in SILENT_TAGS:
            self.streams.pop()
        return element.tag

    def _flush(self):
        if self.pending:
            raw = self.pending[0] if len(self.pending) == 1 else "".join(self.pending)
            self.pending.clear()
            self._write(raw, raw.strip())

    def _write(self, raw, stripped):
        if self.keep_texts:
            stream = self.streams[-1]
            stream.raw.append(raw)
            stream.stripped.append(stripped)
        if stripped and self.open:
            element = self.elements[self.open[-1]]
            if element.own:
                element.own.append(stripped)
            else:
                element.own = [stripped]

    def _read(self, html: str) -> None:
        """The page tag by tag, most of them by one pattern; ``feed`` takes what is between, up to where nothing is left over."""
        at, end, pending = 0, len(html), self.pending
        while at < end:
            met = TEXT_AND_TAG.match(html, at)
            known = None
            if met:
                known = _seen_tags.get(met[2]) or _plain_tag(met[2])
                before = met[1]
            else:
                start = html.find("<", at)
                before = html[at:] if start < 0 else html[at:start]
            if before:
                pending.append(unescape(before) if "&" in before else before)
                at += len(before)
            if known:
                if pending:
                    self._flush()
                if known[1] is None:
                    self._leave(known[0])
                else:
                    self._start(*known)
                at = met.end()
                continue
            step = 1
            while at < end:
                stop = html.find(">", at + step) + 1 or end
                self.feed(html[at:stop])
                at, step = stop, 2 * step
                if not self.rawdata and self.cdata_elem is None:
                    break

    def outline(self, html: str) -> list[_Element]:
        self._read(html)
        self.close()
        self._flush()
        while self.open:
            self._end()
        return self.elements




def _value_of(column: str) -> Callable[[_Element], object]:
    if column in ATTRIBUTE_OF:
        name = ATTRIBUTE_OF[column]
        return lambda e: e.attrs.get(name)
    if column in ("text", "raw_text"):
        return lambda e: "".join((e.stream.raw if column == "raw_text" else e.stream.stripped)[e.first : e.last])
    return (lambda e: "".join(e.own)) if column == "own_text" else attrgetter("parent" if column == "parent_ord" else column)


def _outlines(texts: frozenset[str], leaves: bool, tags: frozenset[str] | None, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = {n: _value_of(n) for n in schema.names if n not in ("page_id", "ord")}
        long = {n: values.pop(n) for n in ("text", "raw_text") if n in values}

        def made(out: dict[str, list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

        out, size = {n: [] for n in schema.names}, 0
        for batch in batches:
            for page_id, html in zip(batch.column("page_id").to_pylist(), batch.column("html")):
                found = _Outline(bool(long)).outline(html.as_py()) if html.is_valid else []
                chosen = range(len(found)) if tags is None else [i for i, e in enumerate(found) if e.tag in tags]
                first = 0
                while first < len(chosen):
                    k = min(len(chosen), first + OUT_ROWS - len(out["ord"]))
                    for at in range(first, k) if long else ():
                        e = found[chosen[at]]
                        with_texts = e.tag in texts or (leaves and e.leaf)
                        for n, below in long.items():
                            out[n].append(below(e) if with_texts else None)
                            size += len(out[n][-1] or "")
                        if size >= OUT_CHARS:
                            k = at + 1
                            break
                    full = size >= OUT_CHARS or len(out["ord"]) + k - first >= OUT_ROWS
                    out["page_id"] += [page_id] * (k - first)
                    out["ord"] += chosen[first:k]
                    some = [found[j] for j in chosen[first:k]]
                    for n, value in values.items():
                        out[n] += map(value, some)
                    first = k
                    if full:
                        yield made(out)
                        out, size = {n: [] for n in schema.names}, 0
        if out["ord"]:
            yield made(out)

    return run


def elements(
    pages: DataFrame, texts: frozenset[str] = frozenset(), leaves: bool = False, columns: list[str] | None = None,
    tags: frozenset[str] | None = None,
) -> DataFrame:
    """One row per element of every page, in page order: its interval (``ord`` to ``last_ord``, of itself and all elements
    inside), its parent and depth, whether it is an innermost text element, the text that is directly its own, and the
    attributes in use.

    As large as the page, however deep it nests. Elements of the tags in ``texts`` (and innermost ones, if ``leaves``) also
    carry the whole text below them, as ``text`` (pieces without the white space around them) and ``raw_text``; ask
    only for tags that are read. A null page has no elements. ``columns`` and ``tags`` name the columns and the elements
    that are made at all, if not every one: what Python does not make need not be sent.
    """
    ship_package(pages.sparkSession)
    kinds = dict(c.split() for c in ELEMENTS.split(", "))
    ddl = ", ".join(f"{c} {kind}" for c, kind in kinds.items() if columns is None or c in ("page_id", "ord", *columns))
    schema = pa.schema([(c.split()[0], _ELEMENT_KINDS[c.split()[1]]) for c in ddl.split(", ")])
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "html")
    return rows.mapInArrow(_outlines(frozenset(texts), leaves, None if tags is None else frozenset(tags), schema), ddl)


_ELEMENT_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}


def _chosen_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["page_id", "ord", "source_url", "text", "raw_text"]
    for batch in batches:
        for page_id, url, html, ords in zip(batch["page_id"], batch["url"], batch["html"], batch["ords"]):
            found = _Outline().outline(html)
            yield pd.DataFrame([(page_id, int(o), url, *found[o].below()) for o in ords], columns=names).astype({"page_id": "int64", "ord": "int32"})


def texts_of(chosen: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, ord, source_url, text, raw_text) of some elements a page; ``chosen`` names page_id and ord."""
    ship_package(pages.sparkSession)
    asked = chosen.groupBy("page_id").agg(F.sort_array(F.collect_list("ord")).alias("ords"))
    rows = join_pages(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), asked, "page_id")
    return rows.mapInPandas(_chosen_texts, "page_id bigint, ord int, source_url string, text string, raw_text string")


def has_class(name: str) -> Column:
    return F.array_contains(F.split(F.coalesce("attr_class", F.lit("")), r"\s+"), name)


def has_any_class(names: list[str]) -> Column:
    return F.arrays_overlap(
        F.split(F.coalesce("attr_class", F.lit("")), r"\s+"), F.array(*[F.lit(n) for n in names])
    )


def _page_passes(payload: list[str]):
    """One pass over each page's elements in order, with a stack of the holders that are open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, open_ = None, []
        for batch in batches:
            rows, holders = [], []
            for i, (page_id, ord_, last) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("page_id", "ord", "holder_last")), strict=True)):
                if page_id != page:
                    page, open_ = page_id, []
                while open_ and open_[-1][1] < ord_:
                    open_.pop()
                if last is None:
                    rows += [i] * len(open_)
                    holders += [h for h, _ in open_]
                else:
                    open_.append((ord_, last))
            if rows:
                taken = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(taken) for c in payload], pa.array(holders, pa.int32())], names=[*payload, "holder"])

    return run


def join_pages(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join of rows that come from pages, with no side sent whole to every task.

    The size of what is parsed from a page cannot be estimated from the table of pages, whose texts may be made by the plan
    itself: the estimate is small where there are many elements of many pages, and Spark would send them all through the driver.
    """
    return left.join(right.hint("merge"), on, how)


def inside(rows: DataFrame, holders: DataFrame) -> DataFrame:
    """Each row with the number of every holder around it as ``holder``, a row for each.

    ``rows`` have page_id, ord and any other columns; ``holders`` page_id, ord, last_ord. A page's rows and
    holders meet in page order; the work is that of the output.
    """
    ship_package(rows.sparkSession)
    both = rows.withColumn("holder_last", F.lit(None).cast("int")).unionByName(
        holders.select("page_id", "ord", F.col("last_ord").alias("holder_last")), allowMissingColumns=True
    )
    # A row that is a holder as well comes before itself: it is not inside itself.
    ordered = both.repartition("page_id").sortWithinPartitions("page_id", "ord", F.col("holder_last").asc_nulls_first())
    return ordered.mapInArrow(_page_passes(rows.columns), StructType([*rows.schema.fields, StructField("holder", IntegerType())]))


def picture_sources() -> Column:
    """Addresses an element shows: its source if it is a picture, and its background image."""
    given = F.coalesce(F.nullif("attr_src", F.lit("")), F.nullif("attr_data_src", F.lit("")))
    pattern = r"""background-image:\s*url\(["']?([^"']+)["']?\)"""
    background = F.nullif(F.regexp_extract(F.coalesce("attr_style", F.lit("")), pattern, 1), F.lit(""))
    shown = F.array(F.when(F.col("tag") == "img", given), background)
    return F.filter(shown, lambda s: s.isNotNull())


def car_pictures(base: str = fixed.SITE_BASE_URL) -> Column:
    """Absolute addresses of the likely car pictures an element shows."""
    complete = F.transform(picture_sources(), lambda s: urls.absolute_url(s, base))
    return F.filter(complete, urls.is_car_image)


def element_images(rows: DataFrame, base: str = fixed.SITE_BASE_URL) -> DataFrame:
    """Likely car pictures with the element that shows them."""
    showing = rows.filter((F.col("tag") == "img") | F.col("attr_style").isNotNull())
    return showing.select("page_id", "ord", "depth", F.posexplode(car_pictures(base)).alias("pos", "url"))


def field_rows(rows: DataFrame, base: str = fixed.SITE_BASE_URL) -> DataFrame:
    """Elements that take part in listings, with the fields in their text and the pictures they show.

    The text is parsed in its row and goes no further: what leaves is some numbers and words an element.
    """
    is_holder, is_detail = F.col("tag").isin(LISTING_TAGS), F.col("tag").isin(DETAIL_TAGS)
    has_text = F.coalesce("text", F.lit("")) != ""
    wanted = ((is_holder | is_detail) & has_text) | (F.col("tag") == "img") | F.col("attr_style").isNotNull()
    shown = rows.filter(wanted).withColumn("shown", car_pictures(base)).select(
        "page_id", "ord", "last_ord", "tag", "text", "shown", (is_holder & has_text).alias("is_holder"),
        (is_detail & has_text).alias("is_detail"),
    )
    read = text.with_fields(shown, "text", "own")
    printed = F.array(*[F.length(F.col(f"own.{f}").cast("string")) for f in text.FIELDS])
    found = F.exists(printed, lambda n: n.isNotNull())
    useful = F.col("is_holder") | (F.col("is_detail") & found) | (F.size("shown") > 0)
    return read.withColumn("printed", printed).filter(useful).select(
        "page_id", "ord", "last_ord", "tag", "is_holder", "is_detail", "printed", "shown", *[F.col(f"own.{f}").alias(f) for f in text.FIELDS]
    )


@dataclass
class _Holder:
    """A container of the page that the pass is in, and where each of its fields comes from."""

    place: int
    sources: list[int | None]
    n_pictures: int = 0
    picture_chars: int = 0


def _merged(ords: list[int], lasts: list[int], holds: list[bool], details: list[bool], printed: list[list[int | None]]) -> list[_Holder]:
    """Containers of a page with the place of each field's value: the first detail inside, else the container itself.

    Backwards over the page, the nearest later detail with a field is known for each; it lies inside or there is none."""
    nearest: list[int | None] = [None] * len(text.FIELDS)
    out = []
    for i in range(len(ords) - 1, -1, -1):
        if holds[i]:
            within = [j if j is not None and ords[j] <= lasts[i] else (i if printed[i][f] is not None else None) for f, j in enumerate(nearest)]
            out.append(_Holder(i, within))
        if details[i]:
            nearest = [i if printed[i][f] is not None else j for f, j in enumerate(nearest)]
    out.reverse()
    return out


def _count_pictures(holders: list[_Holder], ords: list[int], lasts: list[int], shown: list[list[str]]) -> None:
    """Number and length of the distinct pictures inside every container.

    Sums grow from the inside out; a picture seen before is taken off again where both places first share a container."""
    at = {h.place: h for h in holders}
    open_: list[int] = []  # places of containers around, outermost first
    seen: dict[str, int] = {}

    def leave() -> None:
        left = at[open_.pop()]
        if open_:
            around = at[open_[-1]]
            around.n_pictures += left.n_pictures
            around.picture_chars += left.picture_chars

    for i, ord_ in enumerate(ords):
        while open_ and lasts[open_[-1]] < ord_:
            leave()
        for url in shown[i]:
            if open_:
                inner = at[open_[-1]]
                inner.n_pictures += 1
                inner.picture_chars += len(url) + 4
                if url in seen:
                    # The innermost open container that begins before the earlier place holds both.
                    shared = bisect_left(open_, seen[url]) - 1
                    if shared >= 0:
                        at[open_[shared]].n_pictures -= 1
                        at[open_[shared]].picture_chars -= len(url) + 4
            seen[url] = i
        if i in at:
            open_.append(i)
    while open_:
        leave()


def _ranked(columns: dict[str, list], limit: int) -> Iterator[tuple]:
    """The richest containers of one page."""
    ords, lasts, shown = columns["ord"], columns["last_ord"], columns["shown"]
    holders = _merged(ords, lasts, columns["is_holder"], columns["is_detail"], columns["printed"])
    _count_pictures(holders, ords, lasts, shown)
    scored = []
    for h in holders:
        lengths = [columns["printed"][j][f] for f, j in enumerate(h.sources) if j is not None]
        n = len(lengths) + (h.n_pictures > 0)
        if n >= 2:
            scored.append((-(sum(lengths) + h.picture_chars) / n, ords[h.place], n, h))
    for rank, (score, ord_, n, h) in enumerate(nsmallest(limit, scored, key=lambda c: c[:2]), 1):
        end = bisect_right(ords, lasts[h.place])
        pictures = sorted({u for urls_ in shown[h.place + 1 : end] for u in urls_})
        values = [None if j is None else columns[name][j] for name, j in zip(text.FIELDS, h.sources, strict=True)]
        yield columns["page_id"][0], ord_, lasts[h.place], columns["tag"][h.place], dict(zip(text.FIELDS, values, strict=True)), pictures or None, n, -score, rank


def _tops(limit: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page: dict[str, list] = {}
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            ids, i = columns["page_id"], 0
            while i < len(ids):
                j = bisect_right(ids, ids[i], i)  # sorted by page
                if page and page["page_id"][0] != ids[i]:
                    out += _ranked(page, limit)
                    page = {}
                for name, values in columns.items():
                    page.setdefault(name, []).extend(values[i:j])
                i = j
            if out:
                yield made()
                out = []
        out += _ranked(page, limit) if page else []
        if out:
            yield made()

    return run


_PRINTED_KINDS = {"double": pa.float64(), "int": pa.int32(), "string": pa.string()}


def top_containers(rows: DataFrame, limit: int = 20, base: str = fixed.SITE_BASE_URL) -> DataFrame:
    """The richest elements per page: at least two fields, best score first, then page order.

    A container has the fields of its own text, overridden by those of the first detail inside that has them, and the
    distinct pictures inside. Its score is the mean printed length of what it has (a list prints quotes and
    separators). ``rows`` carry the texts of listing and detail tags. A page's elements are passed over twice in
    order, so the work is that of the page whatever its depth.
    """
    ship_package(rows.sparkSession)
    kinds = {r.field: r.kind for r in text.LISTING_RULES}
    fields = pa.struct([(f, _PRINTED_KINDS[kinds[f]]) for f in text.FIELDS])
    schema = pa.schema([("page_id", pa.int64()), ("ord", pa.int32()), ("last_ord", pa.int32()), ("tag", pa.string()), ("fields", fields),
                        ("image_urls", pa.list_(pa.string())), ("n_fields", pa.int32()), ("score", pa.float64()), ("rank", pa.int32())])
    ddl = (f"page_id bigint, ord int, last_ord int, tag string, fields struct<{', '.join(f'{f}: {kinds[f]}' for f in text.FIELDS)}>, "
           "image_urls array<string>, n_fields int, score double, rank int")
    ordered = field_rows(rows, base).repartition("page_id").sortWithinPartitions("page_id", "ord")
    return ordered.mapInArrow(_tops(limit, schema), ddl)


def listings(
    pages: DataFrame,
    make: str = "BMW",
    model: str = "M5",
    per_page: int = 15,
    source_site: str = fixed.SITE_NAME,
    id_prefix: str = fixed.SITE_ID_PREFIX + "_intelligent",
    base: str = fixed.SITE_BASE_URL,
) -> DataFrame:
    """Structured listings of every page: the richest containers that hold a price, a year or the make."""
    # Written once: the chosen ones' texts are looked up in their pages, and ranked ones never carry texts.
    top = cut_lineage(top_containers(elements(pages, LISTING_TEXTS, columns=FIELD_COLUMNS), per_page, base))
    top = join_pages(top, texts_of(top, pages), ["page_id", "ord"])
    price, year = F.col("fields.price"), F.col("fields.year")
    currency = text.currency_of(F.col("raw_text"))
    given = (F.coalesce(price, F.lit(0.0)) != 0) | (F.coalesce(year, F.lit(0)) != 0)
    return (
        top.filter(given | F.contains("text", F.lit(make)))
        .select(
            "page_id", "rank", F.lit(source_site).alias("source_site"),
            text.source_id_of(F.col("text"), id_prefix).alias("source_id"), "source_url",
            F.to_json(F.struct(F.col("text").alias("text_content"))).alias("raw_data"),
            text.title_of(make, model, year, price, currency).alias("title"),
            price.alias("price"), currency.alias("currency"), year.alias("year"),
            F.lit(make).alias("make"), F.lit(model).alias("model"), F.col("fields.mileage").alias("mileage"),
            F.col("fields.location").alias("location"), F.lit(None).cast("string").alias("dealer_name"),
            F.lit("unknown").alias("dealer_type"),
            *[F.col(f"fields.{f}").alias(f) for f in ("fuel_type", "transmission", "body_type", "color", "engine_power", "engine_displacement")],
            F.coalesce("image_urls", F.array().cast("array<string>")).alias("image_urls"),
        )
    )


def site_listings(rows: DataFrame, make: str = "BMW", model: str = "M5") -> DataFrame:
    """Older single-site profile over listing-like elements (rows with page_id, ord, text)."""
    read = text.with_site_fields(rows, "text", "f", make, model)
    read = read.withColumn("made_title", text.site_title(F.col("f"), make, model))
    meaningful = F.col("f.price").isNotNull() | F.col("f.year").isNotNull() | F.contains("text", F.lit(f"{make} {model}"))
    names = ["price", "currency", "year", "mileage", "location", "dealer_name", "dealer_type", "fuel_type",
             "transmission", "body_type", "color", "engine_power", "engine_displacement"]
    return read.filter(meaningful).select(
        "page_id", "ord", text.site_source_id(F.col("f"), F.col("made_title")).alias("source_id"),
        F.col("made_title").alias("title"), *[F.col(f"f.{n}").alias(n) for n in names],
    )


def fallback_listings(rows: DataFrame, make: str = "BMW", model: str = "M5", limit: int = 10) -> DataFrame:
    """Texts that name make and model: the first ``limit`` per page (rows with page_id, ord, text)."""
    naming = rows.filter(F.rlike("text", F.lit(text.any_case(f"{make}.*{model}"))))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("ord"))
    first = naming.withColumn("place", place).filter(F.col("place") <= limit)
    read = text.with_fallback_fields(first, "text", "f")
    source_id = F.concat(
        F.lit(fixed.SITE_ID_PREFIX + "_alt_"), (F.col("place") - 1).cast("string"), F.lit("_"),
        F.substring(F.md5(F.substring("text", 1, 100)), 1, 8),
    )
    return read.select(
        "page_id", "ord", source_id.alias("source_id"),
        F.concat(F.lit(f"{make} {model} - "), F.substring("text", 1, 100)).alias("title"),
        *[F.col(f"f.{n}").alias(n) for n in ("price", "currency", "year", "mileage")],
    )


def leaf_texts(rows: DataFrame) -> DataFrame:
    """Innermost text elements: those without a text element inside (rows of ``elements`` with ``leaves``)."""
    return rows.filter(F.col("leaf") & (F.coalesce("text", F.lit("")) != ""))


def links(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """All links of every page with their text and address."""
    return (
        rows.filter((F.col("tag") == "a") & F.col("attr_href").isNotNull())
        .select("page_id", "ord", F.col("attr_href").alias("href"), "text")
        .join(pages.select("page_id", urls.url_host("url").alias("host")), "page_id")
        .withColumn("url", urls.absolute_url("href", F.concat(F.lit("https://"), F.col("host"))))
    )


def generation_links(rows: DataFrame, base: str = fixed.CATALOG_BASE_URL) -> DataFrame:
    """Name and address of each generation: links in a heading inside a model box.

    ``rows`` are read once: links, headings and boxes, none of which is another, meet in page order."""
    named = (F.col("tag") == "a") & (F.coalesce("attr_href", F.lit("")) != "") & (F.coalesce("text", F.lit("")) != "")
    kind = F.when((F.col("tag") == "div") & has_class("carmodel"), BOX).when(F.col("tag") == "h2", HEADING).when(named, LINK)
    ship_package(rows.sparkSession)
    met = rows.select(
        "page_id", "ord", "last_ord", kind.alias("kind"), F.when(kind == LINK, F.trim("raw_text")).alias("name"), F.when(kind == LINK, F.col("attr_href")).alias("attr_href"),
    ).filter("page_id is not null and kind is not null")
    ordered = met.repartition("page_id").sortWithinPartitions("page_id", "ord")
    found = ordered.mapInArrow(_links_in_boxes, "page_id bigint, ord int, name string, attr_href string").distinct()
    return found.select("page_id", "ord", "name", urls.absolute_url("attr_href", base).alias("url"))


BOX, HEADING, LINK = 0, 1, 2


def _links_in_boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links whose innermost heading begins after the outermost box around them."""
    page, open_ = None, []
    for batch in batches:
        rows = []
        for i, (page_id, ord_, last, kind) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("page_id", "ord", "last_ord", "kind")), strict=True)):
            if page_id != page:
                page, open_ = page_id, []
            while open_ and open_[-1][1] < ord_:
                open_.pop()
            if kind != LINK:
                open_.append((ord_, last, kind))
            elif min((o for o, _, k in open_ if k == BOX), default=ord_) < max((o for o, _, k in open_ if k == HEADING), default=-1):
                rows.append(i)
        if rows:
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(rows)) for c in ("page_id", "ord", "name", "attr_href")], names=["page_id", "ord", "name", "attr_href"])


def overview_elements(pages: DataFrame) -> DataFrame:
    """The elements and columns that ``generation_links`` reads, and no others."""
    return elements(pages, frozenset(["a"]), columns=["last_ord", "tag", "text", "raw_text", "attr_class", "attr_href"], tags=frozenset(["a", "div", "h2"]))


def highlight_features(rows: DataFrame) -> DataFrame:
    """Feature texts per page: list items of the first container of each kind, paragraphs without any."""
    kinds = F.array(*[
        F.when((F.lit(tag is None) | (F.col("tag") == (tag or ""))) & has_class(name), F.lit(i))
        for i, (tag, name) in enumerate(fixed.FEATURE_CONTAINERS)
    ])
    holders = first_per_key(
        rows.select("page_id", "ord", "last_ord", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind")),
        ["page_id", "kind"], "ord",
    )
    texts = rows.filter(F.col("tag").isin("li", "p")).select("page_id", "ord", "tag", F.trim("raw_text").alias("feature"))
    # An element can be the first of several kinds.
    items = join_pages(
        inside(texts, holders.select("page_id", "ord", "last_ord").distinct()),
        holders.select("page_id", F.col("ord").alias("holder"), "kind"), ["page_id", "holder"],
    )
    lists = items.filter("tag = 'li'").select("page_id", "kind").distinct()
    chosen = items.filter("tag = 'li'").unionByName(
        join_pages(items.filter("tag = 'p'"), lists, ["page_id", "kind"], "left_anti").select(items.columns)
    )
    return chosen.filter("feature != ''").select("page_id", "kind", "ord", "feature")


def gallery_images(rows: DataFrame, base: str = fixed.CATALOG_BASE_URL) -> DataFrame:
    """Pictures of gallery containers with captions; icons and placeholders are left out.

    Rows come per kind of container and page order, one per address and kind.
    """
    pictures = rows.filter((F.col("tag") == "img") & (F.coalesce("attr_src", F.lit("")) != "")).select(
        "page_id", "ord", "attr_src", "attr_alt", has_class("gallery").alias("in_class"),
    ).filter(urls.is_real_picture("attr_src"))
    kinds = F.array(*[
        F.when((F.lit(tag is None) | (F.col("tag") == (tag or ""))) & has_class(name), F.lit(order))
        for order, (tag, name) in zip((1, 2, 4, 5), fixed.GALLERY_CONTAINERS)
    ])
    holders = rows.select(
        "page_id", "ord", "last_ord", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind")
    )
    own = F.array(
        F.when(F.col("in_class"), F.lit(0)),
        F.when(F.contains(F.lower(F.coalesce("attr_alt", F.lit(""))), F.lit(fixed.GALLERY_ALT_WORD)), F.lit(3)),
    )
    found = pictures.select("page_id", "ord", "attr_src", "attr_alt", F.explode(F.filter(own, lambda k: k.isNotNull())).alias("kind"))
    held = join_pages(
        inside(pictures.select("page_id", "ord", "attr_src", "attr_alt"), holders.select("page_id", "ord", "last_ord").distinct()),
        holders.select("page_id", F.col("ord").alias("holder"), "kind"), ["page_id", "holder"],
    ).select("page_id", "ord", "attr_src", "attr_alt", "kind")
    absolute = F.when(F.startswith("attr_src", F.lit("http")), F.col("attr_src")).otherwise(F.concat(F.lit(base), "attr_src"))
    every = found.unionByName(held).select(
        "page_id", "kind", "ord", absolute.alias("url"), F.coalesce("attr_alt", F.lit("")).alias("caption")
    )
    return first_per_key(every, ["page_id", "url"], "kind", "ord")


def infotainment_features(rows: DataFrame) -> DataFrame:
    """Labels of connectivity icons: alternative text, title or feature attribute, else the file name."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    by_alt = [
        F.when((F.col("tag") == "img") & F.contains(low("attr_alt"), F.lit(w)), F.lit(i))
        for i, w in enumerate(fixed.INFOTAINMENT_ALT_WORDS)
    ]
    by_data = [
        F.when(F.contains(low("attr_data_feature"), F.lit(w)), F.lit(4 + i))
        for i, w in enumerate(fixed.INFOTAINMENT_DATA_WORDS)
    ]
    kinds = F.array(*by_alt, F.when(has_class(fixed.INFOTAINMENT_CLASS), F.lit(3)), *by_data)
    given = lambda c: F.nullif(low(c), F.lit(""))
    label = F.coalesce(given("attr_alt"), given("attr_title"), given("attr_data_feature"))
    file_name = F.replace(F.replace(urls.base_name(F.col("attr_src")), F.lit(".png"), F.lit("")), F.lit(".jpg"), F.lit(""))
    named = F.contains(low("attr_src"), F.lit("carplay")) | F.contains(low("attr_src"), F.lit("android"))
    every = rows.select(
        "page_id", "ord", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"),
        F.coalesce(label, F.when(named, file_name)).alias("label"),
    ).filter("label is not null")
    return first_per_key(every, ["page_id", "label"], "kind", "ord")
