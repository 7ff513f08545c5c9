"""Relations between acts (F1, F2): wordings of whole and partial ones, and lists of acts under a head.

A text is read once, in an Arrow batch, since a relation needs what stands around its place; only edges leave the task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A document number as functions.text.DOC_NUMBER has it, in Python's syntax.
NUMBER = r"\d+/(?:\d+/)?[^\W\d_]+\d*(?:-[^\W\d_]+\d*)*"
#: Up to three words and 'số' before an act's number; the act's number; who issued it.
_TO = r"(?:\w+\s+){0,3}(?:số\s+)?"
_NUM = f"(?P<number>{NUMBER})"
_BY = r"(?:\s+của\s+(?P<by>[^,;.\n]+))?"
_PART = r"(?:Điều|điều|khoản|điểm)\s+\w+(?:[,\s]+(?:Điều|điều|khoản|điểm)\s+\w+)*"
#: Wordings of relations, parts of acts first; before each a word without which it can't occur.
WORDINGS = [
    ("bỏ", "amends_partial", rf"[Bb]ãi\s+bỏ\s+(?P<part>(?:khoản|điểm|mục)\s+\w+(?:[,\s]+(?:khoản|điểm|mục)\s+\w+)*(?:\s+[Đđ]iều\s+\w+)?)\s+(?:của\s+)?{_TO}{_NUM}{_BY}"),
    ("đổi", "amends_partial", rf"[Ss]ửa\s+đổi\s+(?P<part>{_PART})\s+(?:của\s+)?{_TO}{_NUM}{_BY}"),
    ("sung", "amends_partial", rf"[Bb]ổ\s+sung\s+(?P<part>{_PART})\s+(?:vào\s+)?{_TO}{_NUM}{_BY}"),
    ("kèm", "amends_partial", rf"[Ss]ửa\s+đổi[,\s]+bổ\s+sung\s+(?P<part>(?:các\s+)?(?:thủ\s+tục\s+hành\s+chính|nội\s+dung)\s+(?:nêu\s+tại\s+)?[\w,.\s_\-/]+?)\s+ban\s+hành\s+kèm\s+theo\s+{_TO}{_NUM}{_BY}"),
    ("bỏ", "abolishes", rf"[Bb]ãi\s+bỏ\s+(?:toàn\s+bộ\s+)?{_TO}{_NUM}{_BY}"),
    ("thế", "replaces", rf"[Tt]hay\s+thế\s+{_TO}{_NUM}{_BY}"),
    ("lực", "abolishes", rf"[Hh]ết\s+hiệu\s+lực\s+{_TO}{_NUM}{_BY}"),
    ("lực", "abolishes", rf"{_NUM}\s+hết\s+hiệu\s+lực{_BY}"),
    ("sung", "amends", rf"[Ss]ửa\s+đổi[,\s]+bổ\s+sung\s+{_TO}{_NUM}{_BY}"),
    ("kèm", "amends", rf"kèm\s+theo\s+{_TO}{_NUM}{_BY}"),
]
WORDINGS = [(word, kind, re.compile(p)) for word, kind, p in WORDINGS]
HEAD = re.compile(r"(thay\s+thế|bãi\s+bỏ|hết\s+hiệu\s+lực)\s*:\s*$", re.I | re.M)
ITEM = re.compile(r"\s*[-–•]")
DATED = re.compile(rf"{_NUM}\s+(?P<day>ngày\s+\d{{1,2}}\D+\d{{1,2}}\D+\d{{4}})", re.I)
DAYS = [re.compile(p, re.I) for p in (r"ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})", r"ngày\s+(\d{1,2})[/\-](\d{1,2})[/\-](\d{4})")]
#: What ends an authority and begins a title; acts, which are no authority.
ISSUED = re.compile(r"\bcủa\s+(?!(?:Bộ luật|Luật|Nghị định|Nghị quyết|Thông tư|Quyết định|Pháp lệnh)\b)(?P<by>[^,;.\n]+?)(?:\s+(?:ban\s+hành|phê\s+duyệt|quy\s+định|về)\s+(?P<title>.*)|[,;.\n]|$)", re.I | re.S)
SENTENCE = re.compile(r"\.(?=\s*$|\s+[^\W\d_])|;|\n")
_ACT = r"(?:Luật|Nghị\s+định|Thông\s+tư|Quyết\s+định)"
LINK = re.compile(r"\[([^\]]+)\]\([^)]+\)")
ENDS_WITH_THIS = re.compile(rf"{_ACT}\s+[\w\s]*?số\s+{_NUM}[^\n]*?hết\s+hiệu\s+lực\s+kể\s+từ\s+ngày\s+{_ACT}\s+này\s+có\s+hiệu\s+lực", re.I)
AT_BULLET = re.compile(rf"^(?:[a-zđ]\)\s*|–\s*|•\s*|\d+\.\s*){_TO}{_NUM}", re.I | re.M)
ENDS, ENDS_OR_REPLACES = (re.compile(p, re.I) for p in (r"hết\s+hiệu\s+lực|bãi\s+bỏ", r"hết\s+hiệu\s+lực|bãi\s+bỏ|thay\s+thế"))
#: Characters of the hit and after it in which a day, an authority and a title are looked for.
BEFORE, NEAR, TITLE = 50, 500, 300


class Edge(NamedTuple):
    doc_number: str
    relation_type: str
    provision: str = ""
    issuing_authority_hint: str | None = None
    old_issued_date: str | None = None
    title_hint: str | None = None


def _iso(d: str, m: str, y: str) -> str | None:
    return f"{y}-{int(m):02}-{int(d):02}" if 1 <= int(d) <= 31 and 1 <= int(m) <= 12 and 1900 <= int(y) <= 2099 else None


def _said(sentence: str) -> tuple[str | None, str | None]:
    """Authority and title that the rest of an act's own sentence names."""
    issued = ISSUED.search(SENTENCE.split(sentence, maxsplit=1)[0])
    by, title = ((x or "").strip(" \t.,;") for x in (issued["by"], issued["title"])) if issued else ("", "")
    return by or None, title[:TITLE] if len(title) > 10 else None


def _found(text: str, hit: re.Match, kind: str, part: str) -> Edge:
    """The edge of a hit: with the first day near it, and the authority and title of its sentence."""
    near = text[max(0, hit.end() - BEFORE) : hit.end() + NEAR]
    day = next((d for d in (p.search(near) for p in DAYS) if d), None)
    by, title = _said(text[hit.end("number") : hit.end() + NEAR])
    return Edge(_number(hit), kind, part, by or (hit["by"] or "").strip() or None, _iso(*day.groups()) if day else None, title)


def _number(hit: re.Match) -> str:
    return hit["number"].rstrip("-/")


def listed(text: str) -> Iterator[Edge]:
    """The edges of the lists under a head, from its bullet lines up to the first other line that isn't blank.

    In an item each number with a day counts, else its first number. A bullet line that ends as a head is one.
    """
    if not HEAD.search(text):
        return
    kind = None
    for line in text.split("\n"):
        head = HEAD.search(line)
        if kind and ITEM.match(line) and not head:
            dated = list(DATED.finditer(line))
            for hit in dated or filter(None, [re.search(_NUM, line)]):
                by, title = _said(line[hit.end("number") :])
                yield Edge(_number(hit), kind, "", by, _iso(*re.findall(r"\d+", hit["day"])[:3]) if dated else None, title)
        elif head:
            kind = "replaces" if head[1][0] in "tT" else "abolishes"
        elif line.strip():
            kind = None


def relations_in(text: str) -> list[Edge]:
    """The edges of a text, the first of each (number whatever its case, type, provision)."""
    found: dict[tuple[str, str, str], Edge] = {}
    for word, kind, pattern in WORDINGS:
        for hit in pattern.finditer(text) if word in text else ():
            part = hit["part"].strip()[:50] if kind == "amends_partial" else ""
            key = _number(hit).lower(), kind, part.lower()
            if len(key[0]) >= 5 and key not in found:
                found[key] = _found(text, hit, kind, part)
    for e in listed(text):
        if len(e.doc_number) >= 5:
            found.setdefault((e.doc_number.lower(), e.relation_type, ""), e)
    partly = {key[0] for key in found if key[1] == "amends_partial"}
    return [e for (number, kind, _), e in found.items() if kind != "amends" or number not in partly]


def expiries_in(text: str) -> list[Edge]:
    """The edges of enforcement text: relations_in, acts that end with this one, and numbers at bullets; without any, 0 for a text that speaks of an end."""
    text = LINK.sub(r"\1", text)
    found = relations_in(text)
    known = {e.doc_number.lower() for e in found}
    more = [ENDS_WITH_THIS] if "kể" in text.lower() else []
    for pattern in more + [AT_BULLET] if ENDS.search(text) else []:
        for hit in pattern.finditer(text):
            number = _number(hit)
            if len(number) >= 5 and number.lower() not in known:
                known.add(number.lower())
                found.append(Edge(number, "abolishes"))
    return found or ([Edge("0", "abolishes")] if ENDS_OR_REPLACES.search(text) else [])


def _edges(docs: DataFrame, edges_of: Callable[[str], list[Edge]]) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = [(i, e) for i, text in enumerate(batch.column(1).to_pylist()) for e in edges_of(text)]
            columns = [pa.array([e[k] for _, e in found], pa.string()) for k in range(len(Edge._fields))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _ in found], pa.int64())), *columns], names=["doc_id", *Edge._fields])

    return docs.select("doc_id", "content").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} string" for c in Edge._fields))


def extract_relations(docs: DataFrame) -> DataFrame:
    """doc_id, doc_number, relation_type, provision, issuing_authority_hint, old_issued_date, title_hint: distinct by number (whatever its case), type and provision.

    Wordings come first, in their order, then lists: under a head such as 'thay thế:', 'bãi bỏ:' or 'hết hiệu lực:' each bullet (-, –, •) has the head's type and its own
    day; an item without a day counts too. An ``amends`` goes where the same document amends the act in part. Numbers of fewer than five
    characters don't count. Null texts have no relations; a document whose id repeats has its relations each time.
    """
    return _edges(docs.where(F.col("content").rlike(r"\d/")), relations_in)  # every number has this


def expiry_relations(chunks: DataFrame) -> DataFrame:
    """doc_id, doc_number, relation_type: relations in enforcement text, acts that end with this one, and numbers at bullets.

    An ``amends`` goes as in extract_relations. Text that speaks of an end but names no act gives the number 0.
    """
    return _edges(chunks.where("content is not null"), expiries_in).select("doc_id", "doc_number", "relation_type").distinct()
