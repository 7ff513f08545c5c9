"""What one reading of a text finds of days: its section on entry into force, that day, and its end. Plain functions of one text, run in Arrow batches.

All wordings that lead to a day of force end in 'ngày', so one pattern finds each such place and what stands before it; days are parsed
only there.
"""

from __future__ import annotations

import re
from datetime import date, timedelta

from ..functions.cleaning import SPACE

#: Words of entry into force; heads of articles and of other sections.
IN_FORCE_WORDS = [
    "có hiệu lực thi hành", "hiệu lực thi hành", "có hiệu lực kể từ ngày", "có hiệu lực từ ngày", "có hiệu lực sau", "có hiệu lực vào",
    "thông qua", "thông qua ngày", "kể từ ngày ký", "kể từ ngày ký ban hành", "kể từ ngày ban hành", "từ ngày ký", "ngày ký ban hành",
    "bắt đầu có hiệu lực", "bắt đầu thi hành", "thi hành kể từ ngày", "thi hành từ ngày",
]
ARTICLE_HEAD, ARTICLE, ANY_HEAD = (re.compile(p) for p in (r"Điều\s+[\dIVXLCH]+\s*[.:]", r"Điều\s+[\dIVXLCH]+", r"(?:Điều|Chương|Phần|Mục)\s+[\dIVXLCH]"))
SPEAKS = re.compile(r"[Hh]iệu\s+lực|thi\s+hành")
#: Lines of an article that are looked at; characters from which a paragraph is narrowed, and of a candidate for a day.
WINDOW, LONG_PARAGRAPH, CANDIDATE = 6, 2000, 80
#: What leads to 'ngày': has, force, effect, from; or 'thông qua'. What follows isn't consumed.
LEAD = re.compile(r"(?:(?:(?P<has>có\s+)?(?P<force>hiệu\s+lực\s+))?(?P<effect>thi\s+hành\s+)?(?P<since>kể\s+từ\s+|từ\s+|vào\s+)?|(?P<passed>thông\s+qua\s+))ngày\s+(?=(?P<day>[^.,;\n]+))")
SIGNED, ISSUED_ON = re.compile(r"ký"), re.compile(r"ban\s+hành")
DELAY = re.compile(r"sau\s+(\d+)\s+ngày\s+kể\s+từ\s+ngày\s+ký")
NUMBER = r"\d+/(?:\d+/)?[^\W\d_]+\d*(?:-[^\W\d_]+\d*)*"
FROM_ACT = [re.compile(p) for p in (rf"từ\s+ngày\s+(?:\w+\s+){{1,5}}số\s+({NUMBER})\s+.*?có\s+hiệu\s+lực", rf"kể\s+từ\s+ngày\s+(?:\w+\s+){{1,5}}số\s+({NUMBER})")]
#: How days are written, in the order in which they are tried.
DAY_FORMS = [re.compile(p) for p in (r"(?:ngày\s+)?\d{1,2}\s+tháng\s+\d{1,2}\s+năm\s+\d{4}", r"\d{1,2}[/\-]\d{1,2}[/\-]\d{4}", r"\d{4}-\d{1,2}-\d{1,2}")]
#: How the end is worded, strict and narrow, then broad, in order; each with a short or a long date.
SHORT, LONG = r"\d{1,2}\s*[/\-]\s*\d{1,2}\s*[/\-]\s*\d{4}", r"\d{1,2}\s+tháng\s+\d{1,2}\s+năm\s+\d{4}"
ENDS = [r"hết\s+hiệu\s+lực\s+(?:thi\s+hành\s+)?(?:kể\s+từ\s+)?ngày", r"hết\s+hiệu\s+lực\s+vào\s+ngày", r"đến\s+hết\s+ngày"]
ENDS_BROAD = [r"đến\s+trước\s+ngày", r"đến\s+ngày"]
ENDS, ENDS_BROAD = ([re.compile(rf"{w}\s+({d})") for w in wordings for d in (SHORT, LONG)] for wordings in (ENDS, ENDS_BROAD))
OTHERS_END = re.compile(r"(?:các|những)\s+(?:quy[ếe]t\s*đ[ịi]nh|v[ăa]n\s*b[ảa]n|ngh[ịi]\s*đ[ịi]nh|th[ôo]ng\s*t[ưu])\s+sau\s+đ[âa]y\s+h[ếe]t\s+hi[ệe]u\s+l[ựư]c")
LINK, NUMBERED, OTHER_ACT = re.compile(r"\[([^\]]+)\]\([^)]+\)"), re.compile(r"^\s*(?=(?:\d+|điều\s+\d+)\\?[.)]\s)", re.M), re.compile(rf"số\s+{NUMBER}")


def _bare(line: str) -> str:
    return line.strip(SPACE).strip("*_").strip(SPACE)


def article_of(text: str) -> str | None:
    """Lines from the first 'Điều n.' whose six lines speak of force or effect, up to the next head; None if there is none."""
    if "Điều" not in text:
        return None
    lines = text.split("\n")
    bare = list(map(_bare, lines))
    start = next((i for i, line in enumerate(bare) if ARTICLE_HEAD.match(line) and SPEAKS.search(" ".join(bare[i : i + WINDOW]))), None)
    if start is None:
        return None
    rest = [line for line in (x.strip(SPACE) for x in lines[start:]) if line]
    end = next((i for i, line in enumerate(rest) if i and ANY_HEAD.match(_bare(line))), len(rest))
    return "\n".join(rest[:end])


def _article_with_words(paragraph: str) -> str | None:
    """The first 'Điều n' with a word of force, and a line on each side; None if there is none."""
    lines = paragraph.split("\n")
    heads = [i for i, line in enumerate(lines) if ARTICLE.match(_bare(line))]
    for start, stop in zip(heads, [*heads[1:], len(lines)]):
        own = "\n".join(lines[start:stop]).lower()
        if any(w in own for w in IN_FORCE_WORDS):
            return "\n".join(lines[max(start - 1, 0) : stop + 1])
    return None


def section_of(text: str) -> str:
    """The last paragraph with a word of force, '' if none; one of over 2000 characters is narrowed to its article, if it has one."""
    for paragraph in reversed(re.split(r"\n\s*\n", text)):
        low = paragraph.lower()
        if any(w in low for w in IN_FORCE_WORDS):
            own = paragraph.strip(SPACE)
            return own if len(own) <= LONG_PARAGRAPH else article_of(own) or _article_with_words(own) or own
    return ""


def _iso(digits: list[str]) -> str | None:
    y, m, d = digits if len(digits[0]) == 4 else digits[::-1]
    return f"{y}-{m:0>2}-{d:0>2}" if 1 <= int(d) <= 31 and 1 <= int(m) <= 12 and 1900 <= int(y) <= 2100 else None


def day_in(text: str) -> str | None:
    """As functions.text.parse_vn_date: the first day of the first form that gives one."""
    for form in DAY_FORMS:
        if (hit := form.search(text)) and (day := _iso(re.findall(r"\d+", hit[0]))):
            return day
    return None


def act_counted_from(low: str) -> str | None:
    """The act 'from whose day' a lower-cased text counts; None if none, or under five characters."""
    if "số" not in low or "ngày" not in low:
        return None
    hit = next(filter(None, (p.search(low) for p in FROM_ACT)), None)
    number = hit[1].rstrip("-/") if hit else ""
    return number if len(number) >= 5 else None


def _wordings(hit: re.Match) -> list[int]:
    """Which of the six wordings, in their order, lead to the hit's day: from 'có hiệu lực thi hành kể từ ngày' to a constitution's 'thông qua ngày'."""
    if hit["passed"]:
        return [5]
    has, force, effect = hit["has"] is not None, hit["force"] is not None, hit["effect"] is not None
    since = (hit["since"] or "").split()[:1]
    usual = since != ["vào"]
    each = [has and effect and since == ["kể"], has and effect and since == ["từ"], has, force and effect and usual, effect and usual]
    return [i for i, holds in enumerate(each) if holds]


def force_in(text: str, issued: str | None, wordings: range, signing: bool = True) -> tuple[bool, str | None]:
    """(whether the search ends here, the day) of one text: a named day, unless it counts from another act's; with ``signing`` the day of issue
    if it counts from signing; a delay from it."""
    low = text.lower()
    if "ngày" not in low:
        return False, None
    hits = list(LEAD.finditer(low))
    if len(wordings) and not act_counted_from(low):
        first: dict[int, str] = {}
        for hit in hits:
            for w in _wordings(hit):
                first.setdefault(w, hit["day"])
        day = next(filter(None, (day_in(first[w][:CANDIDATE]) for w in sorted(first) if w in wordings)), None)
        if day:
            return True, day
    for hit in hits if signing else ():
        has, force, effect, since = hit["has"], hit["force"], hit["effect"], (hit["since"] or "").split()[:1]
        signed = SIGNED.match(hit["day"]) and since in (["kể"], ["từ"]) and (has or (force and effect and since == ["kể"]))
        if signed or (ISSUED_ON.match(hit["day"]) and has and not effect and since in (["kể"], ["từ"])):
            return True, issued_day(issued)
    delay = DELAY.search(low) if "sau" in low else None
    try:
        return (True, str(date.fromisoformat(issued_day(issued) or "") + timedelta(int(delay[1])))) if delay else (False, None)
    except (ValueError, OverflowError):
        return False, None


def issued_day(day: str | None) -> str | None:
    """A day of issue as ISO: as it is, d/m/y or d-m-y without a check, or in words."""
    d = (day or "").strip(SPACE)
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", d):
        return d
    short = re.fullmatch(r"(\d{1,2})[/\-](\d{1,2})[/\-](\d{4})", d)
    return f"{short[3]}-{short[2]:0>2}-{short[1]:0>2}" if short else day_in(d)


def force_of(text: str, article: str | None, section: str, issued: str | None) -> str | None:
    """The day of entry into force: of the article, else of the section, else of signing or a delay that the whole text names."""
    for part, wordings in ((article, range(6)), (section, range(6)), (text, range(0))):
        done, day = force_in(part, issued, wordings) if part else (False, None)
        if done:
            return day
    return None


def force_of_chunk(text: str, issued: str | None) -> str | None:
    """The same of enforcement text: a named day, 'thông qua' apart, else a delay from signing."""
    return force_in(text, issued, range(5), signing=False)[1]


def end_in(text: str) -> str | None:
    """The first end date in enforcement text; None if none.

    Numbered paragraphs are read in order, and in each the wordings in order. Paragraphs that list other acts as ended don't count, nor
    does an end 'of force' or 'to the end of' a day that comes after another act's number.
    """
    low = text.lower()
    if "hết" not in low and "đến" not in low:
        return None
    for p in NUMBERED.split(LINK.sub(r"\1", low)):
        if ("hết" in p or "đến" in p) and re.search(r"\d{4}", p) and not OTHERS_END.search(p):
            before = OTHER_ACT.split(p, maxsplit=1)[0]
            for pattern, where in [*((x, before) for x in ENDS), *((x, p) for x in ENDS_BROAD)]:
                if (hit := pattern.search(where)) and (day := _iso(re.findall(r"\d+", hit[1]))):
                    return day
    return None
