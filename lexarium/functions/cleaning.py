"""Columns that repair, check and label legal documents and their texts."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import terms as W
from .text import nfc, normalize_query, once

#: Unicode classes, and only \n ends a line.
UNI = "(?Ud)"
SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
HIDDEN = "[\ufeff\u200b\u200c\u200d]"
#: White space at the ends of a text, and classes of patterns, of ASCII only.
PLAIN_ENDS = " \t\n\r"
PLAIN_CLASSES = {r"\s": r"[ \t\n\f\r]", r"\d": "[0-9]", r"\b": "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"}


def strip(s: Column) -> Column:
    return F.btrim(s, F.lit(SPACE))


def strip_plain(s: Column) -> Column:
    return F.btrim(s, F.lit(PLAIN_ENDS))


def plain(pattern: str) -> str:
    """The pattern with classes of ASCII only."""
    return re.sub(r"\\[sdb]", lambda m: PLAIN_CLASSES[m[0]], pattern)


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the columns, each computed once a row: filters on them don't move below, where they would compute them again."""
    one = F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("_once")
    return df.select("*", one).select("*", "_once.*").drop("_once")


def composed(df: DataFrame) -> DataFrame:
    """contract_id, text of contracts, with the text's letters composed: what all rules of contracts read."""
    return computed(df.select("contract_id", F.col("text").alias("_as_is")), text=nfc(F.col("_as_is"))).drop("_as_is")


def blank_to_null(s: Column) -> Column:
    return F.nullif(s, F.lit(""))


def any_of(words: list[str]) -> str:
    """Pattern of any of the words as they are."""
    return "|".join(rf"\Q{w}\E" for w in words)


def first_of(s: Column, table) -> Column:
    """Label of the first (pattern, label) whose pattern is in s, which is made once a row."""
    return once(s, lambda v: F.coalesce(*[F.when(v.rlike(UNI + p), label) for p, label in table]))


def fixed_parts(pattern: str) -> list[str]:
    """The texts that stand in all that a pattern fits, which has no choice outside groups and no group in a group."""
    return [x for x in re.sub(r"\(\?:.*?\)[*+?]?|\[.*?\][*+?]?|\\.[*+?]?|.[*?]", "\0", pattern).split("\0") if x]


def certain(pattern: str) -> str:
    """The longest of a pattern's fixed_parts (of terms.LEGAL and FURNITURE); '' if there is none."""
    return max(fixed_parts(pattern), key=len, default="")


def folded(s: Column) -> Column:
    """``s`` in lower case, letter for letter: what a pattern of small letters fits there, it fits in ``s`` in any case, and the other way round."""
    odd = reduce(lambda a, b: a | b, [F.contains(s, F.lit(x)) for x in "ſıİ"])
    return F.lower(F.when(odd, F.translate(s, "ſıİ", "sii")).otherwise(s))


def may_fit(low: Column, word: str) -> Column:
    """Whether all fixed_parts of a pattern of small letters are in a ``folded`` text, which takes far less time than a pattern for either case."""
    return reduce(lambda a, b: a & b, [F.contains(low, F.lit(x)) for x in dict.fromkeys(fixed_parts(word))])


def hits(s: Column, patterns: list[str], ascii_only: bool = False) -> Column:
    """How many of the patterns occur. What is certain in one is looked for first, which takes far less time."""
    return reduce(lambda a, b: a + b, [(F.contains(s, F.lit(certain(p))) & s.rlike(plain(p) if ascii_only else UNI + p)).cast("int") for p in patterns])


def fix_doc_number(number: Column, content: Column, url: Column) -> Column:
    """The number, cleaned; else one after 'số…:' in the content that has a digit; else from the URL's last part."""
    given = F.regexp_replace(number, rf"{UNI}[^\w/.\-]", "")
    given = F.regexp_replace(F.regexp_replace(given, "-{2,}", "-"), "/{2,}", "/")
    cited = F.regexp_extract(content, rf"(?i){UNI}(?:số|số hiệu|số ký hiệu)\s*:\s*([\w/.\-]+)", 1)
    slug = F.element_at(F.split(F.rtrim(url, F.lit("/")), "/"), -1)
    parts = [r"(\d{2,})[-\s]*(\d{4})[-\s]*([A-ZĐ]{2,})[-\s]*([A-Z]+)", r"(\d+)-(\d{4})-([A-ZĐ]+)-([A-Z]+)"]
    from_url = [F.when(slug.rlike(p), F.concat(*[x for i, end in enumerate("//-", 1) for x in (F.regexp_extract(slug, p, i), F.lit(end))], F.regexp_extract(slug, p, 4))) for p in parts]
    return F.coalesce(blank_to_null(given), F.when(cited.rlike(r"\d"), cited), *from_url)


def fix_doc_type(kind: Column, title: Column, url: Column) -> Column:
    slug = F.element_at(F.split(F.rtrim(url, F.lit("/")), "/"), -1)
    slug = F.regexp_replace(F.translate(F.regexp_replace(slug, r"\.aspx|\.html", ""), "-_", "  "), r"\s+\d{5,}$", "")
    tried = [F.translate(F.lower(x), "-", " ") for x in (slug, title)]
    return F.coalesce(blank_to_null(strip(kind)), *[first_of(x, W.DOC_TYPES) for x in tried])


def detect_category(title: Column) -> Column:
    """Category of the first phrase, in the fixed order, that the title holds; else the other one."""
    # a phrase's first word is looked for first, which takes far less time
    fits = lambda low, phrase: F.contains(low, F.lit(phrase.split(" ")[0])) & low.rlike(UNI + phrase.replace(" ", r"\s*"))
    first = once(F.lower(title), lambda low: F.coalesce(*[F.when(fits(low, phrase), label) for phrase, label in W.CATEGORIES]))
    return F.coalesce(first, F.lit(W.OTHER_CATEGORY))


def fix_category(category: Column, title: Column) -> Column:
    return F.coalesce(blank_to_null(strip(category)), detect_category(title))


def redecode(s: Column) -> Column:
    """A text with U+FFFD read again: its characters up to U+00FF as bytes, others as escapes (\\u1ead), decoded as UTF-8; broken bytes become U+FFFD.

    So a text that was decoded as Latin-1 by mistake is right again, while letters that were right turn into escapes. Other texts stay as they are.
    """
    code = lambda c: F.lower(F.hex(F.ascii(c)))
    escape = lambda c: F.when(F.length(code(c)) <= 4, F.concat(F.lit("\\u"), F.lpad(code(c), 4, "0"))).otherwise(F.concat(F.lit("\\U"), F.lpad(code(c), 8, "0")))
    wide = F.array_distinct(F.regexp_extract_all(s, F.lit("[^\\x00-\\xFF]"), F.lit(0)))
    narrow = F.aggregate(wide, s, lambda t, c: F.replace(t, c, escape(c)))
    return F.when(F.contains(s, F.lit("\ufffd")), F.make_valid_utf8(F.encode(narrow, "ISO-8859-1").cast("string"))).otherwise(s)


def strip_invisible(s: Column, again: bool = False) -> Column:
    """Without zero-width and control characters; tab, newline and CR stay. Texts with U+FFFD keep it, and validate_content drops them, unless
    they are to be decoded ``again`` first."""
    return strip(F.regexp_replace(redecode(s) if again else s, HIDDEN + r"|[\x00-\x08\x0b\x0c\x0e-\x1f]", ""))


def is_challenge(s: Column) -> Column:
    return F.lower(s).rlike(any_of(W.CHALLENGE))


def validate_content(s: Column) -> Column:
    """False for null, under 200 characters, challenge pages and broken encodings."""
    ok = (F.length(strip(s)) >= 200) & ~is_challenge(s) & ~s.rlike(f"[{W.BROKEN}]")
    return F.coalesce(ok, F.lit(False))


def clean_footer(s: Column) -> Column:
    """Text before the first footer line, without an English act title as last line."""
    cut = F.regexp_replace(s, rf"(?s)(?:^|\n)[^\S\n]*(?:{any_of(W.FOOTER)}).*\z", "")
    return strip(F.regexp_replace(cut, rf"(?i){UNI}(?:^|\n)[^\S\n]*(?:Circular|Decree|Ordinance|Resolution)\s+No\.[^\n]*\z", ""))


def has_garbage(s: Column) -> Column:
    return F.coalesce(s.rlike(any_of(W.FOOTER)), F.lit(False))


def content_valid(s: Column, ascii_only: bool = False) -> Column:
    """At least 100 characters, and legal words, or no page furniture, or over 4000 characters with at most 4 kinds of it.

    ascii_only: white space, digits and limits of words are those of ASCII, and legal words may begin within a word.
    """
    n = hits(s, W.FURNITURE, ascii_only)
    legal = [p.removeprefix(r"\b") for p in W.LEGAL] if ascii_only else W.LEGAL
    ok = (F.length(strip_plain(s) if ascii_only else strip(s)) >= 100) & ((hits(s, legal, ascii_only) > 0) | (n == 0) | ((F.length(s) > 4000) & (n <= 4)))
    return F.coalesce(ok, F.lit(False))


def mostly_english(s: Column) -> Column:
    """More than 60 % of words in plain letters."""
    words = F.regexp_extract_all(s, F.lit("[a-zA-ZÀ-ỹ]+"), F.lit(0))
    return once(words, lambda ws: F.size(F.filter(ws, lambda w: w.rlike("^[a-zA-Z]+$"))) > F.size(ws) * 0.6)


def is_translation(s: Column, html: Column) -> Column:
    """Pages marked as English, and texts over 200 characters with more than 60 % of words in plain letters."""
    marked = F.coalesce(html, F.lit("")).rlike(f"(?i){UNI}" + "|".join(W.ENGLISH_PAGE))
    own = F.regexp_replace(s, f"(?i){UNI}{W.COPYRIGHT}", "")
    return marked | F.coalesce((F.length(s) > 200) & mostly_english(own), F.lit(False))


def is_placeholder(s: Column, phrase: str = "Đang tải") -> Column:
    """Null, blank, or with the phrase that a page shows while it loads."""
    return F.coalesce((strip(s) == "") | s.contains(phrase), F.lit(True))


def cache_key(s: Column, intent: Column | None = None, entity: Column | None = None) -> Column:
    """The normal form, with ':intent' and ':entity' where given and not null."""
    return F.concat_ws(":", *[x for x in (normalize_query(s), intent, entity) if x is not None])


def _distinct(words: Column) -> Column:
    """First-seen distinct, case ignored; as written first, by hash, since the rest compares each with all before it."""
    first = lambda ws: once(F.transform(ws, F.lower), lambda low: F.filter(ws, lambda w, i: F.array_position(low, F.lower(w)) == i + 1))
    return once(F.array_distinct(words), first)


def _shown(word: Column, cased: Column) -> Column:
    return F.when(word.rlike(r"^[\d/]+$|^[A-ZĐ]{2,}(-[A-ZĐ]{2,})*$"), word).otherwise(cased)


def _title_case(word: Column) -> Column:
    return F.array_join(F.transform(F.regexp_extract_all(word, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1)), F.initcap), "")


def _all(s: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract_all(s, F.lit(f"{UNI}({pattern})"), F.lit(1)), F.array().cast("array<string>"))


def _tokens(s: Column) -> Column:
    stop = [F.lit(w) for w in W.STOPWORDS]
    return F.filter(_all(F.lower(s), r"\w+(?:-\w+)*"), lambda w: (F.length(w) >= 3) & ~F.array_contains(F.array(*stop), F.lower(w)))


def query_keywords(query: Column, n: int = 8) -> Column:
    """Document numbers, words of three letters that aren't stopwords, and years; distinct, n at most."""
    found = F.concat(_all(query, r"\d+[\s/]*[–\-]?[\s/]*\d{4}[\s/]*[–\-]?[\s/]*[A-ZĐ]+"), _tokens(query), _all(query, r"\b(?:19|20)\d{2}\b"))
    first = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))
    return F.transform(F.slice(_distinct(F.transform(found, strip)), 1, n), lambda w: _shown(w, first(w)))


def keywords(title: Column, content: Column, number: Column, n: int = 10) -> Column:
    """Number, title words, article references, acronyms and years of the whole content; distinct, n at most."""
    refs = _all(content, r"(?:Điều|Khoản|Chương|Mục|Phần)\s+[\dIVXLCH]+\b")
    acronyms = F.filter(_all(content, r"\b[A-ZĐ]{2,}(?:-[A-ZĐ]{2,})*\b"), lambda w: F.length(w) <= 10)
    own = F.when(number.isNotNull(), F.array(strip(number))).otherwise(F.array().cast("array<string>"))
    found = _distinct(F.filter(F.concat(own, _tokens(F.regexp_replace(title, HIDDEN, "")), refs, acronyms, _all(content, r"\b(?:19|20)\d{2}\b")), lambda w: F.length(w) >= 2))
    long = F.filter(found, lambda w: (F.length(w) >= 3) | w.rlike(r"^[\d/]"))
    return F.transform(F.slice(long, 1, n), lambda w: _shown(w, _title_case(w)))
