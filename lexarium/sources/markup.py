"""The standard parser's events, read faster where a page is plainly written."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

#: Text, a tag whose attributes are names with quoted values, a comment or document type; and any other '<', which only the standard parser reads.
TOKEN = re.compile(
    r'([^<]+)|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n\r]+[a-zA-Z][a-zA-Z0-9_-]*="[^"<>&]*")*)[ \t\n\r]*(/?)>|(<!--[^<>-]+-->|<!(?:DOCTYPE|doctype) html>)|(<)'
)
ATTRIBUTE = re.compile(r'([a-zA-Z][a-zA-Z0-9_-]*)="([^"]*)"')
#: Elements whose content is no markup: one piece of text up to their end, raw or not, else the standard parser reads the page; and those which it always reads.
RAW, WHOLE = {"script", "style"}, {"script", "style", "title", "textarea"}
OTHERS = {"iframe", "math", "noembed", "noframes", "noscript", "plaintext", "svg", "xmp"}


def tokens_of(html: str) -> list[tuple] | None:
    """The page's tokens as TOKEN's groups; None if it isn't plainly written."""
    tokens = TOKEN.findall(html)
    within = None
    for text, slash, tag, attributes, closed, _, other in tokens:
        if other or slash and (attributes or closed):
            return None
        if within:  # nothing but its text and its end
            if not text and not (slash and tag.lower() == within):
                return None
            if not text:
                within = None
        elif tag and not slash:
            name = tag.lower()
            if name in OTHERS or name in WHOLE and closed:
                return None
            if name in WHOLE:
                within = name
    return None if within else tokens


class Reader(HTMLParser):
    """HTMLParser with ``read``, which calls the same handlers with the same values."""

    def __init__(self):
        super().__init__(convert_charrefs=True)

    def read(self, html: str) -> None:
        tokens = tokens_of(html)
        if tokens is None:
            self.feed(html)
            self.close()
            return
        raw = False
        for text, slash, tag, attributes, closed, *_ in tokens:
            if text:
                self.handle_data(unescape(text) if not raw and "&" in text else text)
            elif slash:
                raw = False
                self.handle_endtag(tag.lower())
            elif tag:
                name = tag.lower()
                found = [(k.lower(), v) for k, v in ATTRIBUTE.findall(attributes)] if attributes else []
                if closed:
                    self.handle_startendtag(name, found)
                else:
                    self.handle_starttag(name, found)
                    raw = name in RAW
