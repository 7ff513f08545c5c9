"""Fetched pages as rows: links, content, property cells, titles. One pass of the standard parser over each page, inside tasks."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as W
from ..functions.cleaning import UNI, blank_to_null, computed, content_valid, hits, strip
from ..functions.text import once, resolve_url, strip_accents
from .markup import Reader

#: Elements that have no end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SKIPPED = {"script", "style"}
#: Elements whose text isn't the body's.
QUIET = {"title", *W.NOISE_TAGS}
PLACES = set(W.CONTAINERS)
#: Elements that mean something to a _Page though they have no attributes.
MEANT = {*VOID, *SKIPPED, *QUIET, "td", "tr", "h1", "b"}
#: Parts of a page: those kept by ids, the body without noise, the cells after labels, titles and links.
PARTS = f"panels map<string,string>, body string, labelled struct<{', '.join(f'{k} string' for k in W.CELL_LABELS)}>, h1 string, title string, links array<struct<href string, listed boolean>>"


class _Page(Reader):
    """Collects the texts of wanted parts while the page is read.

    Of each open element what holds inside it is kept: its tag, the parts that its text is of, and whether it is in a listing title, the property box,
    a skipped element, a cell, bold, or an element that the body is without.
    """

    def __init__(self, panels: set[str]):
        super().__init__()
        self.wanted = panels
        self.open = [("", (), False, False, False, False, False, False)]
        self.parts: dict[str, list[str]] = {}
        self.cells: list[dict[str, list[str]]] = []
        self.links: list[tuple[str, bool]] = []

    def handle_starttag(self, tag, attrs):
        if not attrs and tag not in MEANT:  # holds what it is in
            self.open.append((tag, *self.open[-1][1:]))
            return
        at = dict(attrs)
        if tag == "a" and at.get("href") is not None:
            self.links.append((at["href"], self.open[-1][2]))
        if tag in VOID:
            return
        if tag in ("td", "tr"):
            self._close_cell()
        _, names, listed, box, skipped, cell, bold, quiet = self.open[-1]
        own = at.get("id")
        if own in self.wanted and f"#{own}" not in self.parts:
            self.parts[f"#{own}"] = []
            names = (*names, f"#{own}")
        if tag == "title" and "title" not in self.parts or tag == "h1" and "h1" not in self.parts and box:
            self.parts[tag] = []
            names = (*names, tag)
        if tag == "td":
            self.cells.append({"text": [], "bold": []})
        listed = listed or tag == "p" and "nqTitle" in (at.get("class") or "").split()
        self.open.append((tag, names, listed, box or own == "divThuocTinh", skipped or tag in SKIPPED, cell or tag == "td", bold or tag == "b", quiet or tag in QUIET))

    def _close_cell(self):
        """A cell without end tag ends where the next cell or row starts."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == "table":
                return
            if self.open[i][0] == "td":
                del self.open[i:]
                return

    def handle_endtag(self, tag):
        if self.open[-1][0] == tag and tag:
            self.open.pop()
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        _, names, _, _, skipped, cell, bold, quiet = self.open[-1]
        if not skipped:
            for name in names:
                self.parts[name].append(data)
            if cell and self.cells:
                self.cells[-1]["text"].append(data)
                if bold:
                    self.cells[-1]["bold"].append(data)
        if not quiet:
            self.parts.setdefault("body", []).append(data)


def _read(html: str, panels: set[str]) -> dict:
    page = _Page(panels)
    page.read(html or "")
    text = lambda name, sep="\n": sep.join(page.parts[name]) if name in page.parts else None
    cells = [{"text": "".join(c["text"]).strip(), "bold": "".join(c["bold"]).strip()} for c in page.cells]
    return {
        "panels": [(k[1:], text(k)) for k in page.parts if k[0] == "#"], "body": text("body"), "cells": cells, "h1": text("h1", ""), "title": text("title", ""),
        "links": [{"href": h, "listed": p} for h, p in page.links],
    }


_TYPES = {
    "panels": pa.map_(pa.string(), pa.string()), "body": pa.string(), "labelled": pa.struct([(k, pa.string()) for k in W.CELL_LABELS]), "h1": pa.string(),
    "title": pa.string(), "links": pa.list_(pa.struct([("href", pa.string()), ("listed", pa.bool_())])),
}


def cell_after(cells: list[dict], label: str) -> str | None:
    """Text of the cell after the first with the label, else after the first with it in bold; None if there is none."""
    for field in ("text", "bold"):
        at = next((i for i, c in enumerate(cells) if label in c[field]), len(cells)) + 1
        if at < len(cells):
            return cells[at]["text"]
    return None


def labelled_cells(cells: list[dict]) -> dict[str, str | None]:
    """The cell after each of CELL_LABELS; labels that are in no cell are known by one look."""
    all_text = "\n".join([c["text"] for c in cells] + [c["bold"] for c in cells])
    return {k: cell_after(cells, label) if label in all_text else None for k, label in W.CELL_LABELS.items()}


def page_parts(pages: DataFrame, panels: list[str] | None = None) -> DataFrame:
    """url, html and PARTS of each page; null html has no parts. Scripts and styles are never text."""
    wanted = set(panels or W.PANELS)

    def run(batches):
        for b in batches:
            rows = [_read(h, wanted) for h in b.column("html").to_pylist()]
            for r in rows:
                r["labelled"] = labelled_cells(r["cells"])
            yield pa.RecordBatch.from_arrays([b.column("url"), b.column("html"), *[pa.array([r[k] for r in rows], t) for k, t in _TYPES.items()]], names=["url", "html", *_TYPES])

    return pages.select("url", "html").mapInArrow(run, f"url string, html string, {PARTS}")


class _Blocks(Reader):
    """Block elements in the order in which they begin, with their texts and the containers they are in."""

    def __init__(self):
        super().__init__()
        self.blocks: list[dict] = []
        #: Of each open element its tag, its block, the containers and blocks it is in, and whether its text is skipped.
        self.open: list[tuple[str, dict | None, frozenset, tuple, bool]] = [("", None, frozenset(), (), False)]

    def handle_starttag(self, tag, attrs):
        _, outer, within, blocks, skipped = self.open[-1]
        block = {"text": [], "in": within, "outer": False} if tag in W.BLOCKS else None
        if block:
            self.blocks.append(block)
            if tag in W.INNER_BLOCKS and self.open[-1][0] == "div" and outer:
                outer["outer"] = True
        if tag not in VOID:
            at = dict(attrs)
            own = {("id", at.get("id")), *(("class", c) for c in (at.get("class") or "").split())} & PLACES if at else set()
            if tag == "body":
                own.add(("tag", "body"))
            self.open.append((tag, block, within | own if own else within, (*blocks, block) if block else blocks, skipped or tag in SKIPPED))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        _, _, _, blocks, skipped = self.open[-1]
        if not skipped and data.strip():
            text = " ".join(data.split())
            for block in blocks:
                block["text"].append(text)


def block_lines(html: str) -> list[str]:
    """Texts of the blocks of the first container with any, else of the body; of a text without tags its lines.

    Nested blocks are read one by one, so the text of a list and of its items comes twice; a div with a block as a child isn't a block.
    """
    if not re.search(r"<\s*[a-zA-Z_/]", html or ""):
        return (html or "").split("\n")
    page = _Blocks()
    page.read(html)
    kept = [("".join(b["text"]), b["in"]) for b in page.blocks if b["text"] and not b["outer"]]
    for place in [*W.CONTAINERS, ("tag", "body")]:
        if own := [t for t, within in kept if place in within]:
            return own
    return []


def block_text(pages: DataFrame) -> DataFrame:
    """url, content: the blocks of each page as lines."""

    def run(batches):
        for b in batches:
            lines = ["\n".join(block_lines(h)) for h in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lines, pa.string())], names=["url", "content"])

    return pages.select("url", "html").mapInArrow(run, "url string, content string")


def _squeezed(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, rf"{UNI}\n\s*\n", "\n\n"), " +", " ")


def with_content(parts: DataFrame) -> DataFrame:
    """Page parts with ``content``: the first panel, in the fixed order, of 100 characters with legal words and little furniture.

    Else the longest panel of 200; else the body. A panel's text must be valid; so must the body's lines of three characters, 200 in
    all. Null if none is.
    """
    panels = F.filter(F.transform(F.array(*map(F.lit, W.PANELS)), lambda p: F.col("panels")[p]), lambda t: F.length(t) >= 100)
    counted = F.transform(panels, lambda t: F.struct(t.alias("t"), F.length(t).alias("n"), hits(t, W.LEGAL).alias("legal"), hits(t, W.FURNITURE).alias("other")))
    lines = F.filter(F.transform(F.split(_squeezed(F.col("body")), "\n"), strip), lambda x: F.length(x) >= 3)
    read = computed(parts, _panels=counted, _rest=F.array_join(lines, "\n"))
    good = F.get(F.filter("_panels", lambda x: (x["legal"] >= 1) & (x["other"] <= x["legal"] + 1)), F.lit(0))["t"]
    longest = F.array_max(F.transform("_panels", lambda x: x["n"]))
    rest = F.get(F.filter("_panels", lambda x: (x["n"] == longest) & (x["n"] >= 200)), F.lit(0))["t"]
    read = computed(read, _text=_squeezed(F.coalesce(good, rest)))
    text = F.when((F.length("_text") >= 100) & content_valid(F.col("_text")), F.col("_text"))
    body = F.when((F.length("_rest") >= 200) & content_valid(F.col("_rest")), F.col("_rest"))
    return computed(read, content=F.coalesce(text, body)).drop("_panels", "_rest", "_text")


def extract_content(pages: DataFrame) -> DataFrame:
    """url, content."""
    return with_content(page_parts(pages)).select("url", "content")


def metadata_of() -> dict[str, Column]:
    """Columns from the property cells: all of CELL_LABELS, and year_published from the issued, else the effective date."""
    found = {k: F.col("labelled")[k] for k in W.CELL_LABELS}
    found["effective_date"] = F.when(~F.lower(strip(found["effective_date"])).isin("đã biết", ""), found["effective_date"])
    date = F.coalesce(blank_to_null(found["issued_date"]), found["effective_date"])
    parts = F.split(date, "/")
    year = F.when(F.size(parts) == 3, F.element_at(parts, -1)).when(F.size(parts) == 1, F.substring(date, 1, 4))
    return found | {"year_published": year.try_cast("int")}


def html_metadata(pages: DataFrame) -> DataFrame:
    """url and the columns above."""
    return page_parts(pages).select("url", *[c.alias(k) for k, c in metadata_of().items()])


def title_of(slug: Column) -> Column:
    """The property box's h1 unless it is an authority; else the page's title without the site's name, over ten characters; else from the slug.

    The first two must share a word of four letters with the slug, if it has one.
    """
    words = F.filter(F.regexp_extract_all(F.lower(F.translate(slug, "-", " ")), F.lit("([a-zđ]+)"), F.lit(1)), lambda w: F.length(w) >= 4)
    within = lambda plain, ws: (F.size(ws) == 0) | F.exists(ws, lambda w: F.contains(plain, w))
    shares = lambda t: once(strip_accents(t), lambda plain: once(words, lambda ws: within(plain, ws)))
    h1, title = strip(F.col("h1")), strip(F.regexp_replace(strip(F.col("title")), UNI + W.SITE_SUFFIX, ""))
    capitals = F.length(F.regexp_replace(h1, r"\P{Lu}", ""))
    authority = (capitals > F.length(h1) * 0.7) & ~h1.rlike(r"\d") & (F.length(h1) < 80)
    named = F.initcap(strip(F.regexp_replace(F.translate(slug, "_-", "  "), r"\s+\d{5,}$", "")))
    for word, right in (("Nd", "NĐ"), ("Cp", "CP"), ("Qh", "QH")):
        named = F.regexp_replace(named, rf"\b{word}\b", right)
    return F.coalesce(F.when(~authority & shares(h1), h1), F.when((F.length(title) > 10) & shares(title), title), F.when(F.length(named) > 5, F.substring(named, 1, 200)), F.lit("Văn bản pháp luật"))


def resolve_title(pages: DataFrame, slug: Column) -> DataFrame:
    """url, title; slug: a column of the url."""
    return page_parts(pages).select("url", title_of(slug).alias("title"))


def listing_links(pages: DataFrame, base: str, pattern: str = r"/van-ban/[^\"'?]+\.aspx$") -> DataFrame:
    """page_url, pos, link: links with the pattern inside listing titles; else any; else such paths in the raw page. First-seen, distinct."""
    fits = F.filter("links", lambda x: x["href"].rlike(pattern))
    href = lambda a: F.transform(a, lambda x: x["href"])
    listed = href(F.filter(fits, lambda x: x["listed"]))
    raw = F.regexp_extract_all("html", F.lit(f"({pattern.removesuffix('$')})"), F.lit(1))
    best = F.when(F.size(listed) > 0, listed).when(F.size(fits) > 0, href(fits)).otherwise(raw)
    links = F.array_distinct(F.transform(F.coalesce(best, F.array().cast("array<string>")), lambda h: resolve_url(h, base)))
    return page_parts(pages).select(F.col("url").alias("page_url"), F.posexplode(links).alias("pos", "link"))
