"""Column functions on legal text: dates, numbers, URLs, normal forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Precomposed Vietnamese letters (lower case) and what they lose their marks to.
ACCENTED = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵ"
PLAIN = "a" * 17 + "e" * 11 + "i" * 5 + "o" * 17 + "u" * 11 + "y" * 5
#: A document number: digits/digits/LETTERS(-LETTERS)*, or digits/LETTERS-LETTERS. No capture groups.
DOC_NUMBER = r"\d+/(?:\d+/)?[\p{L}]+\d*(?:-[\p{L}]+\d*)*"


def strip_accents(s: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(s), ACCENTED, PLAIN), r"\p{Mn}", "")


def normalize_doc_number(s: Column) -> Column:
    """Lower-case letters a-z and digits; đ is dropped."""
    return F.regexp_replace(strip_accents(s), "[^a-z0-9]", "")


def normalize_query(s: Column) -> Column:
    plain = F.translate(strip_accents(F.trim(s)), "đ", "d")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9\s]", " "), r"\s+", " "))


def once(value: Column, use) -> Column:
    """``use`` of a column that is computed once a row, though ``use`` names it several times."""
    return F.transform(F.array(value), use)[0]


def nfc(text: Column) -> Column:
    """``text`` in Unicode's NFC: a letter and its marks, in any canonical order, become one character where there is one; marks that compose with nothing stay.

    ICU does it, which Spark's own jars have for its collations; the Java library's method can't be named by ``java_method``, since one of its arguments is no plain value.
    """
    composed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))
    return F.when(text.isNotNull(), composed)


def fix_date(s: Column) -> Column:
    """First n/n/n (also with - or .) as ISO, if it begins or ends with a year of four digits and is a day; else a year from 1900 to 2099;
    else unchanged but for white space around. An n/n/n that is no day stays as it is; blank is null."""
    text = F.btrim(s, F.lit(" \t\n\r"))
    found = F.regexp_extract_all(F.regexp_extract(text, r"(\d{1,4})[/\-.](\d{1,2})[/\-.](\d{1,4})", 0), F.lit(r"(\d+)"), F.lit(1))

    def iso(n: Column) -> Column:
        y, m, d = (F.when(F.length(n[0]) == 4, n[i]).when(F.length(n[2]) == 4, n[2 - i]) for i in range(3))
        return F.date_format(F.try_to_date(F.concat_ws("-", y, m, d), "yyyy-M-d"), "yyyy-MM-dd")

    year = F.regexp_extract(text, r"\b(19\d{2}|20\d{2})\b", 1)
    return F.when(text != "", once(found, lambda n: F.when(F.size(n) == 3, F.coalesce(iso(n), text)).otherwise(F.coalesce(F.nullif(year, F.lit("")), text))))


#: How days are written, in the order in which they are tried.
DAYS = [r"(?:ngày\s+)?\d{1,2}\s+tháng\s+\d{1,2}\s+năm\s+\d{4}", r"\d{1,2}[/\-]\d{1,2}[/\-]\d{4}", r"\d{4}-\d{1,2}-\d{1,2}"]


def parse_vn_date(s: Column) -> Column:
    """The first day as ISO: 'd tháng m năm y', else d/m/y or d-m-y, else y-m-d; the order of the forms counts, not their places.

    Days to 31, months to 12 and years 1900 to 2100, no calendar check; of each form the first hit counts.
    """

    def iso(n: Column) -> Column:
        d, m, y = (F.when(F.length(n[0]) == 4, n[2 - i]).otherwise(n[i]) for i in range(3))
        ok = (F.size(n) == 3) & d.cast("int").between(1, 31) & m.cast("int").between(1, 12) & y.cast("int").between(1900, 2100)
        return F.when(ok, F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))

    return F.coalesce(*[once(F.regexp_extract_all(F.regexp_extract(s, f"(?Ud){p}", 0), F.lit(r"(\d+)"), F.lit(1)), iso) for p in DAYS])


def doc_id_from_url(url: Column) -> Column:
    last = F.regexp_replace(F.element_at(F.split(url, "/"), -1), r"\.(aspx|html)$", "")
    return F.regexp_replace(F.when(last == "", url).otherwise(last), "[^A-Za-z0-9_-]", "_")


def resolve_url(href: Column, base: str) -> Column:
    """Absolute, //host, /path and bare references against ``base``."""
    scheme, host = base.split("://")[0], base.split("://")[1].split("/")[0]
    return (
        F.when(href.rlike("^https?://"), href).when(href.startswith("//"), F.concat(F.lit(f"{scheme}:"), href))
        .when(href.startswith("/"), F.concat(F.lit(f"{scheme}://{host}"), href)).otherwise(F.concat(F.lit(f"{scheme}://{host}/"), href))
    )
