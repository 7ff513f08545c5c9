"""Sections that say when an act takes effect or ends, and the dates in them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.cleaning import UNI, detect_category, strip
from ..functions.text import normalize_doc_number
from . import days

#: Where the head of a document ends, in order.
HEAD_ENDS = [r"QUYẾT ĐỊNH:", r"Điều\s+1\b", r"CHƯƠNG\s+I\b"]
SHORT, LONG = days.SHORT, days.LONG


def _by_text(of):
    """A function of one text as one of a string column; null of null."""

    def each(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else of(t) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(each, StringType())


def header_section(content: Column) -> Column:
    """What follows 'Số hiệu' (else all) up to the first of HEAD_ENDS, in their order, that occurs; white space collapsed, 500 characters at most."""
    rest = F.coalesce(F.regexp_extract(F.when(content.rlike(rf"{UNI}Số\s*hiệu"), content), rf"(?s){UNI}Số\s*hiệu(.*)\z", 1), content)
    cut = F.coalesce(*[F.when(rest.rlike(UNI + p), F.split(rest, UNI + p, 2)[0]) for p in HEAD_ENDS], rest)
    return F.substring(strip(F.regexp_replace(cut, rf"{UNI}\s+", " ")), 1, 500)


#: Of a content: the lines from the first 'Điều n.' that speaks of force up to the next head; the first end date; the act from whose day it counts.
effective_article = _by_text(days.article_of)
expiry_in = _by_text(days.end_in)
cross_number = _by_text(lambda text: days.act_counted_from(text.lower()))

_READ = ("article_text", "section_text", "effective_date", "expiry_date")


def _read(content: pa.Array, issued: pa.Array) -> pa.Array:
    rows = []
    for text, day in zip(content.to_pylist(), issued.to_pylist(), strict=True):
        article, section = (None, "") if text is None else (days.article_of(text), days.section_of(text))
        end = (days.end_in(article) if article else None) or days.end_in(section)
        rows.append((article, section, days.force_of(text or "", article, section, day), end))
    return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(len(_READ))], names=list(_READ))


def read_days(docs: DataFrame) -> DataFrame:
    """docs with the columns article_text, section_text, effective_date and expiry_date instead of its content: all that one reading of a text finds."""
    day = F.col("issued_date") if "issued_date" in docs.columns else F.lit(None).cast("string")
    read = F.arrow_udf(_read, StructType([StructField(c, StringType()) for c in _READ]))
    rest = [c for c in docs.columns if c not in ("content", *_READ)]
    return docs.select(*rest, read(F.col("content"), day).alias("_read")).select(*rest, *[F.col("_read")[c].alias(c) for c in _READ])


def effective_section(docs: DataFrame) -> DataFrame:
    """doc_id, article_text, section_text: the article above, and the last paragraph with a word of force, '' if none.

    A paragraph over 2000 characters is narrowed to its article, if it has one, else to the first article with a word of force.
    """
    return read_days(docs.select("doc_id", "content")).select("doc_id", "article_text", "section_text")


def effective_date(docs: DataFrame) -> DataFrame:
    """doc_id, effective_date of docs (doc_id, content, issued_date). A null content has none.

    The day that the article, else the section names; the day of issue where it counts from signing, or a delay from it; else the last two of the whole
    text. 'From signing' ends the search even if the day of issue isn't known. A text that counts from another act's day names none.
    """
    return read_days(docs.select("doc_id", "content", "issued_date")).select("doc_id", "effective_date")


def effective_from_enforcement(chunks: DataFrame) -> DataFrame:
    """doc_id, effective_date of enforcement chunks (doc_id, content, issued_date): a named day, else a delay from signing."""

    def each(content: pa.Array, issued: pa.Array) -> pa.Array:
        return pa.array([None if t is None else days.force_of_chunk(t, d) for t, d in zip(content.to_pylist(), issued.to_pylist(), strict=True)], pa.string())

    return chunks.select("doc_id", F.arrow_udf(each, StringType())("content", "issued_date").alias("effective_date"))


def _date(s: Column) -> Column:
    """d/m/y, d-m-y or 'd tháng m năm y' as ISO; days to 31, years 1900 to 2100."""

    def iso(n: Column) -> Column:
        d, m, y = (F.get(n, F.lit(i)) for i in range(3))
        ok = d.try_cast("int").between(1, 31) & m.try_cast("int").between(1, 12) & y.try_cast("int").between(1900, 2100)
        return F.when(ok, F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))

    return F.transform(F.array(F.regexp_extract_all(s, F.lit(r"(\d+)"), F.lit(1))), iso)[0]


def validate_expiry(expiry: Column, effective: Column) -> Column:
    """Null where the end is before the start."""
    return F.when(~F.coalesce(expiry < effective, F.lit(False)), expiry)


def expiry_date(docs: DataFrame) -> DataFrame:
    """doc_id, expiry_date from the article of entry into force, else from the section; see days.end_in."""
    return read_days(docs.select("doc_id", "content")).select("doc_id", "expiry_date")


def extract_metadata(docs: DataFrame) -> DataFrame:
    """doc_id, category, effective_date (found, else given), expiry_date that isn't before it. Each row by itself, so doc_id may repeat."""
    given = F.col("effective_date") if "effective_date" in docs.columns else F.lit(None).cast("string")
    both = read_days(docs.select("doc_id", "title", "content", "issued_date", given.alias("given"))).withColumn("effective_date", F.coalesce("effective_date", "given"))
    return both.select("doc_id", detect_category(F.col("title")).alias("category"), "effective_date", validate_expiry(F.col("expiry_date"), F.col("effective_date")).alias("expiry_date"))


def cross_reference(docs: DataFrame, dates: DataFrame) -> DataFrame:
    """doc_id, ref_number, ref_effective_date: the act 'from whose day of entry into force' a document counts, and that act's date, if known.

    dates: doc_number, effective_date; of several the earliest.
    """
    refs = docs.select("doc_id", cross_number(F.col("content")).alias("ref_number")).where("ref_number is not null")
    known = dates.where("doc_number is not null").groupBy(normalize_doc_number(F.col("doc_number")).alias("_k")).agg(F.min("effective_date").alias("ref_effective_date"))
    return refs.withColumn("_k", normalize_doc_number(F.col("ref_number"))).join(known, "_k", "left").drop("_k")
