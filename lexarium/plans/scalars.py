"""Queries of columns and small joins that other operators are made of, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaning as L
from ..functions import terms as W
from ..functions import text as T
from ..operators import contracts as K
from ..operators import corpus as C
from ..operators import dates as D
from ..operators import fields as H
from ..sources.fixtures import read, view, view_sql

BASE = "https://example.org"
#: What makes each raw document cite the day of another act; the number comes from the document.
CITES = "content || chr(10) || 'Nghị định này có hiệu lực kể từ ngày Nghị định số ' || cast(length(title) % 9 + 1 as string) || '/2003/NĐ-CP có hiệu lực.'"
_D = "lpad(length(text) % 28 + 1, 2, '0')||'/'||(length(text) % 12 + 1)||'/'"
#: Days of signing, start and end, made of the contract's length.
TERM = f"text||chr(10)||'Hôm nay, ngày '||{_D}||'2023, hai bên ký'||chr(10)||'Từ ngày: '||{_D}||'2024'||chr(10)||'Đến ngày: '||{_D}||'2025'"


def _clean(s, d):
    return C.clean_dates(view(s, d, "legal_raw"))


def _cross(s, d):
    docs = _clean(s, d)
    dates = D.effective_date(docs).join(docs.select("doc_id", "doc_number"), "doc_id")
    return D.cross_reference(docs.withColumn("content", F.expr(CITES)), dates)


#: Texts that were decoded as Latin-1, with a letter that was right, a broken byte and U+FFFD; every third is as it should be.
MOJIBAKE = "case when doc_id % 3 = 0 then ' Số é '||doc_id else 'No '||doc_id||'\ufeff Ä\u0090á»\u0081 \ufffd ậ 😀 Ã( é!' end"


def _upserted(s, d):
    """Stored documents, of which the even ones come again and the odd ones of the incoming are new; one comes twice."""
    raw = view(s, d, "legal_raw")
    key = F.expr("cast(substring(doc_id, 4) as int)")
    stored = raw.where(key % 4 != 1).select("doc_id", "doc_number", "title", "issued_date", "signer", F.lit("2020-01-01 00:00:00").alias("created_at"), F.lit("2020-01-02 00:00:00").alias("updated_at"), (key % 3).alias("status_flag"))
    again = lambda seq, title: raw.where(key % 2 == 1).where(F.lit(seq == 1) | (key % 10 == 1)).select("doc_id", "doc_number", F.concat(F.lit(title), "title").alias("title"), "signer", F.lit(seq).alias("seq"))
    return C.upsert_documents(stored, again(1, "a ").unionByName(again(2, "b ")), "2024-05-06 00:00:00")


QUERIES = {
    "b2_resolve_url": lambda s, d: view(s, d, "legal_pages").select("url", T.resolve_url(F.regexp_extract("html", 'href="([^"]+)"', 1), BASE).alias("link")),
    "c4_strip_invisible": lambda s, d: read(s, d, "documents").select("doc_id", F.md5(L.strip_invisible(F.col("text"))).alias("text_md5")),
    "c4_redecode": lambda s, d: read(s, d, "documents").select("doc_id", L.strip_invisible(F.expr(MOJIBAKE), True).alias("text")),
    "a3_upsert_documents": _upserted,
    "c6_fix_category": lambda s, d: view(s, d, "legal_raw").select("doc_id", L.fix_category(F.when(F.length("title") % 2 == 0, " ").otherwise("Thuế"), F.col("title")).alias("category")),
    "e9_cross_reference": _cross,
    "e11_validate_expiry": lambda s, d: D.effective_date(_clean(s, d)).select("doc_id", D.validate_expiry(F.lit("2005-06-30"), F.col("effective_date")).alias("expiry_date")),
    "h1_first_match": lambda s, d: view(s, d, "contracts").select("contract_id", H.first_match(F.col("text"), [r"Không có: ([^\n]+)", r"Công ty: ([^\n]+)"]).alias("company"), H.line_around(F.col("text"), "Lương cơ bản", 0).alias("line")),
    "h3_contract_dates": lambda s, d: H.contract_dates(view(s, d, "contracts").withColumn("text", F.expr(TERM))),
}

_RAW = f"with raw as ({view_sql('legal_raw')})"
_CON = f"with c as ({view_sql('contracts')})"
_CLEAN = f"{_RAW}, clean as (select * replace (case when trim(issued_date) = '' then null when length(issued_date) = 10 then coalesce(strftime(try_strptime(issued_date, '%d/%m/%Y'), '%Y-%m-%d'), issued_date) else issued_date end as issued_date) from raw)"
_NAMED = """when regexp_matches(content, 'có hiệu lực thi hành kể từ ngày [0-9]+ tháng') then
  regexp_extract(content, 'năm ([0-9]{4})', 1) || '-' || lpad(regexp_extract(content, 'tháng ([0-9]+) năm', 1), 2, '0') || '-' || lpad(regexp_extract(content, 'từ ngày ([0-9]+) tháng', 1), 2, '0')"""
_SIGNED = "when contains(content, 'có hiệu lực kể từ ngày ký') then strftime(try_strptime(issued_date, '%Y-%m-%d'), '%Y-%m-%d')"
_AFTER = "when contains(content, 'sau 45 ngày kể từ ngày ký') then strftime(try_strptime(issued_date, '%Y-%m-%d') + interval 45 day, '%Y-%m-%d')"
_KEY = f"regexp_replace(translate(strip_accents(lower(%s)), '{T.ACCENTED}', '{T.PLAIN}'), '[^a-z0-9]', '', 'g')"
_EFF = f"{_CLEAN}, eff as (select doc_id, doc_number, title, case {_NAMED} {_SIGNED} {_AFTER} end as effective_date from clean)"
_CATEGORY = "when cast(substring(doc_id, 4) as integer) % 3 = 0 then 'Thuế - Phí - Lệ phí' when cast(substring(doc_id, 4) as integer) % 3 = 1 then 'Lao động - Tiền lương'"

_DM = "lpad(cast(length(text) % 28 + 1 as varchar), 2, '0') || '/' || cast(length(text) % 12 + 1 as varchar) || '/'"
ORACLES: dict[str, str] = {
    "h3_contract_dates": f"{_CON} select contract_id, {_DM} || '2023' as execution_date, {_DM} || '2024' as start_date, {_DM} || '2025' as end_date from c",
    "b2_resolve_url": f"with p as ({view_sql('legal_pages')}) select url, '{BASE}' || regexp_extract(html, 'href=\"([^\"]+)\"', 1) as link from p",
    "c4_strip_invisible": r"select doc_id, md5(trim(regexp_replace(text, '[\x{feff}\x{200b}\x{200c}\x{200d}\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), e' \t\n\r')) as text_md5 from documents",
    "c4_redecode": "select doc_id, case when doc_id % 3 = 0 then 'Số é ' || doc_id else 'No ' || doc_id || '\\ufeff Đề \\ufffd \\u1ead \\U0001f600 ' || chr(65533) || '( ' || chr(65533) || '!' end as text from documents",
    "a3_upsert_documents": f"""{_RAW}, k as (select *, cast(substring(doc_id, 4) as integer) as k from raw)
      select doc_id, case when k % 2 = 1 then coalesce(doc_number, doc_id) else doc_number end as doc_number, case when k % 10 = 1 then 'b ' when k % 2 = 1 then 'a ' else '' end || title as title,
        case when k % 2 = 0 then issued_date end as issued_date, signer, case when k % 4 = 1 then '2024-05-06 00:00:00' else '2020-01-01 00:00:00' end as created_at,
        case when k % 2 = 1 then '2024-05-06 00:00:00' else '2020-01-02 00:00:00' end as updated_at, case when k % 4 = 1 then 0 else k % 3 end as status_flag from k""",
    "c6_fix_category": f"{_RAW} select doc_id, case when length(title) % 2 <> 0 then 'Thuế' {_CATEGORY} else 'Khác' end as category from raw",
    "e9_cross_reference": f"""{_EFF}, known as (select {_KEY % 'doc_number'} as k, min(effective_date) as ref_effective_date from eff where doc_number is not null group by 1),
      refs as (select doc_id, cast(length(title) % 9 + 1 as varchar) || '/2003/nđ-cp' as ref_number from eff)
      select doc_id, ref_number, ref_effective_date from refs left join known on k = {_KEY % 'ref_number'}""",
    "e11_validate_expiry": f"{_EFF} select doc_id, case when not coalesce('2005-06-30' < effective_date, false) then '2005-06-30' end as expiry_date from eff",
    "h1_first_match": f"{_CON} select contract_id, regexp_extract(text, 'Công ty: ([^\\n]+)', 1) as company, regexp_extract(text, 'Lương cơ bản[^\\n]*', 0) as line from c",
}
