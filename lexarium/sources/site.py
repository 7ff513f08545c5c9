"""Pages of any site by rules (B9): an element tree of each page, selectors for the fields, content and blocks. One Arrow pass.

Rules are data: for each field an ordered list of selectors, of which the first that hits counts. A selector is a dict with ``tag`` and ``class`` or
``id``, ``tag`` alone, or ``text_before``: the cell after the first whose text holds it, whatever the case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import terms as W
from .html import VOID
from .markup import Reader

#: Fields that selectors give; content has rules of its own.
FIELDS = ("title", "doc_number", "doc_type", "issued_date", "effective_date", "issuing_authority", "signer", "status", "gazette_date", "gazette_number")
NO_TITLE = "Không có tiêu đề"
UNREAD, FURNITURE = {"script", "style"}, {"script", "style", "nav", "header", "footer"}
YEAR = re.compile(r"\b(?:19|20)\d{2}\b")
#: A cell or row without end tag ends where one of these begins, a paragraph or list item where its like does.
ENDS = {"td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "p": {"p"}, "li": {"li"}}
#: Within these what is open outside stays open.
HOLDS = {"td": "table", "th": "table", "tr": "table", "p": "div", "li": "ul"}


class Element:
    __slots__ = ("children", "classes", "id", "parent", "tag")

    def __init__(self, tag: str, attributes: dict, parent: Element | None):
        self.tag, self.parent, self.children = tag, parent, []
        self.id, self.classes = attributes.get("id"), set((attributes.get("class") or "").split())

    def elements(self, without: set[str] = frozenset()) -> Iterator[Element]:
        """All elements inside, in the order of the page, but those in elements of the tags ``without``; not by recursion, since pages nest deeply."""
        stack = [iter(self.children)]
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
            elif isinstance(child, Element) and child.tag not in without:
                yield child
                stack.append(iter(child.children))

    def strings(self, without: set[str] = frozenset()) -> Iterator[str]:
        """All pieces of text inside, but those in elements of the tags ``without``."""
        stack = [iter(self.children)]
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
            elif isinstance(child, str):
                yield child
            elif child.tag not in without:
                stack.append(iter(child.children))

    def joined(self, separator: str = "", without: set[str] = frozenset()) -> str:
        """The pieces of text without white space around and without blank ones."""
        return separator.join(filter(None, (s.strip() for s in self.strings(without))))


class _Tree(Reader):
    def __init__(self):
        super().__init__()
        self.root = self.at = Element("", {}, None)

    def _close(self, tags: set[str], within: str) -> None:
        """Ends the innermost open element of these tags, unless one of ``within`` is opened inside it."""
        at = self.at
        while at.parent and at.tag != within:
            if at.tag in tags:
                self.at = at.parent
                return
            at = at.parent

    def handle_starttag(self, tag, attrs):
        if tag in ENDS:
            self._close(ENDS[tag], HOLDS[tag])
            if tag == "tr":
                self._close({"tr"}, "table")
        element = Element(tag, dict(attrs), self.at)
        self.at.children.append(element)
        if tag not in VOID:
            self.at = element

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Element(tag, dict(attrs), self.at))

    def handle_endtag(self, tag):
        self._close({tag}, "")

    def handle_data(self, data):
        self.at.children.append(data)


def tree(html: str) -> Element:
    parser = _Tree()
    parser.read(html)
    return parser.root


def select(root: Element, selector: dict) -> Element | None:
    """The first element with the selector's tag, and its class or id."""
    tag, class_, id_ = (selector.get(k) for k in ("tag", "class", "id"))
    fits = lambda e: (tag is None or e.tag == tag) and (class_ in e.classes if class_ else id_ is None or e.id == id_)
    return next(filter(fits, root.elements()), None)


def cell_after(root: Element, label: str) -> str | None:
    """The cell next to the first that holds the label and has one."""
    for cell in root.elements():
        if cell.tag == "td" and label.lower() in "".join(cell.strings()).lower():
            row = [x for x in cell.parent.children if isinstance(x, Element) and x.tag == "td"]
            if (at := row.index(cell) + 1) < len(row):
                return row[at].joined()
    return None


def value_of(root: Element, selectors: list[dict]) -> str | None:
    """What the first selector with a hit gives: of an id its lines without scripts, of others their text in one."""
    for selector in selectors:
        if "text_before" in selector:
            found = cell_after(root, selector["text_before"])
        else:
            element = select(root, selector)
            found = element and (element.joined("\n", UNREAD) if "id" in selector and "class" not in selector else element.joined())
        if found is not None:
            return found
    return None


def blocks_of(container: Element, without: set[str]) -> list[str]:
    """Texts of the blocks inside, as html.block_lines reads them: nested ones one by one, a div that holds blocks not at all."""
    out = []
    for e in container.elements(without):
        if e.tag in W.BLOCKS and not (e.tag == "div" and any(isinstance(x, Element) and x.tag in W.INNER_BLOCKS for x in e.children)):
            if text := "".join(" ".join(s.split()) for s in e.strings(without)):
                out.append(text)
    return out


def doc_id_of(url: str) -> str:
    name = re.sub(r"[^a-zA-Z0-9_-]", "_", url.split("/")[-1].replace(".aspx", "").replace(".html", ""))
    return name or re.sub(r"[^a-zA-Z0-9_-]", "_", urlparse(url).path.strip("/").replace("/", "_"))


def read_page(html: str, url: str, rules: dict[str, list[dict]]) -> dict:
    root = tree(html)
    row = {"url": url, "doc_id": doc_id_of(url), **{k: value_of(root, rules.get(k, [])) for k in FIELDS}}
    row["title"] = row["title"] or NO_TITLE
    held = next((e for e in (select(root, s) for s in rules.get("content", [])) if e and e.joined()), None)
    body = select(root, {"tag": "body"})
    row["content"] = "\n".join(held.strings(UNREAD)) if held else "\n".join(body.strings(FURNITURE)) if body else ""
    row["sections"] = (held and blocks_of(held, UNREAD)) or (blocks_of(body, UNREAD if held else FURNITURE) if body else [])
    year = next((y for y in (YEAR.search(row[k] or "") for k in ("issued_date", "effective_date")) if y), None)
    return row | {"year_published": int(year[0]) if year else None}


def site_parse(pages: DataFrame, rules: dict[str, list[dict]]) -> DataFrame:
    """url, doc_id, FIELDS, content, sections (the content's blocks as lines, for ``structure.html_sections``), year_published of pages (url, html).

    rules: for each of FIELDS and for ``content`` selectors in order. Content is the first content selector's with text, without scripts, else the body's
    without furniture; the year is of issued_date, else effective_date. Null pages are as empty ones; null urls go.
    """
    names = ("url", "doc_id", *FIELDS, "content")
    schema = ", ".join(f"{c} string" for c in names) + ", sections array<string>, year_published int"
    kinds = [pa.string()] * len(names) + [pa.list_(pa.string()), pa.int32()]

    def run(batches):
        for batch in batches:
            rows = [read_page(html or "", url, rules) for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            columns = [*names, "sections", "year_published"]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in zip(columns, kinds, strict=True)], names=columns)

    return pages.where("url is not null").select("url", "html").mapInArrow(run, schema)
