"""Pages read by tokens give what the standard parser gives."""

import random
import re
from html.parser import HTMLParser

from lexarium.sources import html as P
from lexarium.sources.markup import Reader, tokens_of

PIECES = [
    "<p>", "</p>", "<P Class=\"a b\">", "<div id=\"toanvancontent\">", "</div>", "<br>", "<br/>", "<br />", "<td>", "</td>", "<tr>", "<table>", "</table>", "<script>x(\"&amp;\")</script>", "<script>a < b</script>", "<style>", "</style>",
    "<title>", "</title>", "<TITLE>A &amp; B</TITLE>", "<!-- c -->", "<!-- a - b -->", "<!DOCTYPE html>", "Điều 1 &lt; 2", "&nbsp;", "&am", " ", "\n", "a < b", "<a href='x'>", "<a href=\"/x?a=1&amp;b\">", "<a href=\"/x\" x>", "</ p>", "</p >", "<",
    "<img src=\"a\" alt=\"b\"/>", "<iframe>", "<textarea>", "</textarea>", "<ul><li>x</li></ul>", "<b>", "</b>", "<h1>", "</h1>", "<x-y>", "<p a=b>", "</p a=\"b\">", "<script/>", "<body>", "</body>", "</script>", "<?pi?>",
]


def events(base, page):
    class Told(base):
        def __init__(self):
            super().__init__()
            self.told = []

        handle_starttag = lambda self, *x: self.told.append(("start", *x))
        handle_startendtag = lambda self, *x: self.told.append(("both", *x))
        handle_endtag = lambda self, *x: self.told.append(("end", *x))
        handle_data = lambda self, *x: self.told.append(("data", *x))

    told = Told()
    if base is HTMLParser:
        told.feed(page)
        told.close()
    else:
        told.read(page)
    return told.told


def test_events_are_the_standard_parsers():
    made, fast = random.Random(5), 0
    for _ in range(20_000):
        page = "".join(made.choices(PIECES, k=made.randint(0, 12)))
        fast += tokens_of(page) is not None
        assert events(Reader, page) == events(HTMLParser, page), page
    assert fast > 2000


def test_plain_pages_are_read_by_tokens(monkeypatch):
    """The standard parser isn't called for a page that is plainly written."""
    page = '<html><head><title>A</title></head><body><div id="divThuocTinh"><h1>H</h1><table><tr><td>Số hiệu:</td><td><b>1/2020</b></td></tr></table></div><p class="nqTitle"><a href="/x.aspx">x</a></p><div id="fulltext"><script>x()</script><p>Điều 1</p></div></body></html>'
    want = P._read(page + "<", set(P.W.PANELS)), P.block_lines(page + "<")  # a last '<' is text of its own
    monkeypatch.setattr(HTMLParser, "feed", None)
    got = P._read(page, set(P.W.PANELS))
    assert got | {"body": None} == want[0] | {"body": None}
    assert got["cells"] == [{"text": "Số hiệu:", "bold": ""}, {"text": "1/2020", "bold": "1/2020"}] and got["h1"] == "H" and got["links"] == [{"href": "/x.aspx", "listed": True}]
    assert P.block_lines(page) == want[1]


def test_elements_without_attributes_are_read_the_short_way():
    """A page gives the same with an attribute that means nothing in each of its elements; labels in no cell are known by one look."""
    rng = random.Random(4)
    names = ["p", "div", "td", "tr", "table", "b", "a", "h1", "title", "span", "script", "br", "nav", "li", "body", "x"]
    said = ["Số hiệu:", "1/2020", "\n", "Người ký: A", "Lĩnh vực:", "x"]
    for _ in range(2000):
        parts = [rng.choice([f"<{rng.choice(names)}>", f"</{rng.choice(names)}>", rng.choice(said), '<div id="divThuocTinh">', '<p id="fulltext">']) for _ in range(rng.randrange(20))]
        page = "".join(parts)
        got, want = (P._read(x, set(P.W.PANELS)) for x in (page, re.sub(r"<([a-z0-9]+)>", r'<\1 data-x="1">', page)))
        assert got == want and P.labelled_cells(got["cells"]) == {k: P.cell_after(got["cells"], label) for k, label in P.W.CELL_LABELS.items()}
