"""Registered queries over the given tables, and the equivalent SQL."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import amendments as A
from ..operators import contracts as K
from ..operators import corpus as C
from ..operators import dates as D
from ..operators import fields as H
from ..operators import relations as R
from ..operators import search as S
from ..operators import structure as G
from ..sources.fixtures import CONTRACT, read, view, view_sql
from ..sources.shared import settle
from ..streaming.ingest import outcomes_of
from . import mining, pages, relations, scalars, stores
from .relations import edges_sql

AS_OF = "2006-06-30"
#: Number of a raw document, and what is added to its text: a paragraph on entry into force in eight forms, with days made of the number.
KEY = "cast(substring(doc_id, 4) as int)"
DAY, MONTH, YEAR, FORM = f"({KEY} % 28 + 1)", f"({KEY} % 12 + 1)", f"({KEY} % 20 + 2001)", f"(cast(floor({KEY} / 4) as int) % 8)"
FORMS = (
    f"case {FORM} when 0 then 'Nghị định này có hiệu lực từ ngày '||{DAY}||'/'||{MONTH}||'/'||{YEAR}||'.' "
    f"when 1 then 'Nghị định này có hiệu lực thi hành vào ngày '||{YEAR}||'-'||{MONTH}||'-'||{DAY}||'.' "
    f"when 2 then 'Hiệu lực thi hành từ ngày '||{DAY}||'-'||{MONTH}||'-'||{YEAR}||'.' "
    f"when 3 then 'Luật này được Quốc hội thông qua ngày '||{DAY}||' tháng '||{MONTH}||' năm '||{YEAR}||'.' "
    "when 4 then 'Nghị định này có hiệu lực kể từ ngày ban hành.' "
    "when 5 then 'Nghị định này có hiệu lực sau '||(10 + {KEY} % 50)||' ngày kể từ ngày ký.' "
    f"when 6 then 'Có hiệu lực kể từ ngày Luật số 20/2005/QH11 ban hành ngày '||{DAY}||'/'||{MONTH}||'/'||{YEAR}||' có hiệu lực.' "
    "else 'Các bộ chịu trách nhiệm thi hành.' end"
).replace("{KEY}", KEY)
#: Relations to other acts in six forms, lists among them, and provisions with days of their own, made of the number.
_NTH = lambda k: f"(({KEY} * {k}) % 500)||'/'||(2000 + {KEY} % 7)"
OTHER, SECOND, THIRD = f"{_NTH(13)}||'/NĐ-CP'", f"{_NTH(17)}||'/NĐ-CP'", f"{_NTH(29)}||'/QĐ-TTg'"
RELATED = (
    f"content||chr(10)||case {KEY} % 6 when 0 then 'Bãi bỏ Nghị định số '||{OTHER}||' ngày '||{DAY}||' tháng '||{MONTH}||' năm 2001 của Chính phủ về quản lý vùng '||{KEY}||'. Các bộ thực hiện.' "
    f"when 1 then 'Sửa đổi Điều 3 Nghị định số '||{OTHER}||'. Bãi bỏ Nghị định số '||{OTHER}||'.' when 2 then 'Sửa đổi, bổ sung Nghị định số '||{OTHER}||'.' "
    f"when 3 then 'Các văn bản sau hết hiệu lực:'||chr(10)||'- Nghị định số '||{OTHER}||' ngày '||{DAY}||'/'||{MONTH}||'/2001;'||chr(10)||'– Nghị định số '||{SECOND}||' ngày '||{DAY}||' tháng '||{MONTH}||' năm 2002.'"
    f"||chr(10)||chr(10)||'• Quyết định số '||{THIRD}||' của Bộ Tài chính về việc chung số '||{KEY}||'; khác'||chr(10)||'1. Luật số 45/2019/QH14 được áp dụng.'||chr(10)||'- Luật số 46/2019/QH14' "
    f"when 4 then 'Nghị định này thay thế:'||chr(10)||'- Nghị định số '||lower({OTHER})||' ngày '||{DAY}||'-'||{MONTH}||'-2001'||chr(10)||'- Nghị định số '||{SECOND}||chr(10)||'2. Bãi bỏ:'||chr(10)||'– Nghị định số '||{OTHER} "
    "else 'Các bộ thực hiện.' end"
)
PROVISIONS = f"content||chr(10)||case {KEY} % 9 when 0 then '9. Điều 4 có hiệu lực từ ngày 01/07/2026.' when 1 then '9. Điều 4 có hiệu lực từ ngày 01/07/2004.' else '' end"


def _clean(s, d):
    return C.clean_dates(view(s, d, "legal_raw"))


def _related(s, d):
    return _clean(s, d).withColumn("content", F.expr(RELATED))


def _status(s, d):
    docs = settle(C.dedup_three_key(_related(s, d)))  # read by all that follows
    ends = F.when(F.expr(f"{KEY} % 10") == 0, F.expr(f"'2006-'||lpad({MONTH}, 2, '0')||'-15'"))
    dates = D.effective_date(docs).withColumn("expiry_date", F.when(F.col("effective_date").isNotNull(), ends))
    provisions = A.provision_dates(docs.withColumn("content", F.expr(PROVISIONS)))
    return C.status_flag(settle(dates), C.resolve_relations(R.extract_relations(docs), docs), AS_OF, provisions)


def _outcomes(s, d):
    """The derived pages, some of them in English, without text or outside the years, and repeats of stored documents."""
    n = "cast(regexp_extract(url, '-([0-9]+)[.]aspx', 1) as int)"
    bad = F.expr(f"case {n} % 10 when 1 then replace(html, repeat('Nội dung. ', 20), '') when 2 then replace(html, repeat('Nội dung. ', 20), repeat('This act takes effect. ', 20)) else html end")
    return view(s, d, "legal_pages").select("url", bad.alias("html"))


def _ingest_status(s, d):
    return _status(s, d).groupBy("status_flag").agg(F.count(F.lit(1)).alias("n"))


def _upsert(s, d):
    docs = view(s, d, "legal_raw").select("doc_id", "signer", "title")
    new = docs.where("length(doc_id) % 2 = 0").select("doc_id", F.upper("signer").alias("signer"), F.lit("x").alias("title"), F.lit(1).alias("seq"))
    return C.upsert(docs, new, "doc_id", ("title",))


def _kb(s, d):
    return K.build_kb(view(s, d, "kb_chunks"), view(s, d, "legal_raw"))


def _knn(s, d):
    return _search(s, d)


def _risks(s, d):
    return K.collect_risks(K.parse_responses(view(s, d, "llm_responses")))


#: Days of issue in five forms, where they are whole.
WRITTEN = "case when length(issued_date) = 10 then case cast(floor(cast(substring(doc_id, 4) as int) / 4) as int) % 5 when 1 then replace(issued_date, '/', '.') when 2 then 'Năm '||substring(issued_date, 7, 4) when 3 then substring(issued_date, 7, 4)||'/'||substring(issued_date, 4, 2)||'/'||substring(issued_date, 1, 2) when 4 then replace(issued_date, '/', '-') else issued_date end else issued_date end"
#: Contracts with all fields of the parties, in two ways of writing.
PARTIES = (
    "case when length(text) % 2 = 0 then replace(replace(replace(text, 'Mã số thuế', 'Địa chỉ: Số '||length(text)||' phố '||user_id||chr(10)||'Đại diện: Ông '||user_id||chr(10)||'Mã số thuế'), "
    "'Điều 1. Công', 'CCCD số: '||(100000000 + length(text))||chr(10)||'Điều 1. Công'), 'Công ty: ', 'CÔNG TY:'||chr(9)) "
    "else replace(replace(text, 'Họ và tên: ', 'Họ tên |: '), 'BÊN B: (Người lao động)'||chr(10), '') end || chr(10) || 'Địa chỉ: Ngõ '||user_id||chr(9)||'Điện thoại: 1'"
)


#: Precomposed letters of the contracts and their parts, as Unicode's canonical decomposition has them; every second contract is written so.
DECOMPOSED = {c: unicodedata.normalize("NFD", c) for c in "ôêộờẩạảậáàơềđãĐỘỢỒỆỐ" if unicodedata.normalize("NFD", c) != c}


def _apart(sql: str) -> str:
    """``sql`` with the letters apart in what it writes; all letters of DECOMPOSED in the texts come from there."""
    return sql.translate(str.maketrans(DECOMPOSED))


def _contracts(s, d):
    even = F.expr("cast(substring(contract_id, 4) as int) % 2 = 0")
    written = view(s, d, "contracts", apart=_apart(CONTRACT)).select("contract_id", "user_id", F.length("text").alias("n"), F.when(even, F.col("apart")).otherwise(F.col("text")).alias("text"))
    parties = PARTIES.replace("length(text)", "n")  # of the text as it is composed
    return written.withColumn("text", F.when(even, F.expr(_apart(parties))).otherwise(F.expr(parties))).drop("n")


def _formed(s, d):
    return _clean(s, d).withColumn("content", F.expr(f"content||chr(10)||chr(10)||{FORMS}"))


def _search(s, d, on=None, **more):
    v = read(s, d, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), *([on] if on else []), "embedding")
    return S.knn_filtered(q, v, on, **more) if on else S.knn(q, v, **more)


def _existing(s, d):
    docs = _clean(s, d)
    return C.dedup_three_key(docs.where("length(doc_id) % 2 = 0"), docs.where("length(doc_id) % 2 = 1"))


QUERIES = {
    "ingest_status": _ingest_status,
    "c3_fix_date": lambda s, d: C.clean_dates(view(s, d, "legal_raw").withColumn("issued_date", F.expr(WRITTEN))).select("doc_id", "issued_date", "year_published"),
    "c10_normalize_query": lambda s, d: view(s, d, "legal_raw").select("doc_id", T.normalize_query(F.col("title")).alias("q")),
    "c11_normalize_doc_number": lambda s, d: view(s, d, "legal_raw").select("doc_id", T.normalize_doc_number(F.col("doc_number")).alias("k")),
    "b3_doc_id_from_url": lambda s, d: read(s, d, "pages").select("page_id", T.doc_id_from_url(F.col("url")).alias("id")),
    "b11_year_filter": lambda s, d: C.year_filter(_clean(s, d)).select("doc_id", "year_published"),
    "d2_dedup_three_key": lambda s, d: C.dedup_three_key(_clean(s, d)).select("doc_id"),
    "a3_upsert": _upsert,
    "d2_dedup_existing": lambda s, d: _existing(s, d).select("doc_id"),
    "e6_parse_vn_date": lambda s, d: view(s, d, "legal_raw").select("doc_id", T.parse_vn_date(F.expr(FORMS)).alias("iso")),
    "e7_effective_date": lambda s, d: D.effective_date(_formed(s, d)),
    "e8_enforcement_date": lambda s, d: D.effective_from_enforcement(_clean(s, d).withColumn("content", F.expr(FORMS))),
    "e12_extract_metadata": lambda s, d: D.extract_metadata(_formed(s, d)),
    "f1_extract_relations": lambda s, d: R.extract_relations(_related(s, d)),
    "f6_resolve_relations": lambda s, d: C.resolve_relations(R.extract_relations(_related(s, d)), _clean(s, d)),
    "f1_replaced_numbers": lambda s, d: C.replaced_numbers(view(s, d, "legal_raw")),
    "f7_status_flag": _status,
    "g10_extract_clauses": lambda s, d: K.extract_clauses(view(s, d, "contracts")),
    "h2_parties": lambda s, d: K.contract_parties(_contracts(s, d)),
    "h7_parse_contracts": lambda s, d: H.parse_contracts(_contracts(s, d)).select(
        "contract_id", "contract_type", "contract_value", F.size("parties").alias("n_parties"), F.size("clauses").alias("n_clauses"), F.col("parties")[0]["tax_id"].alias("tax_id"), F.col("clauses")[1]["title"].alias("second_title")
    ),
    "h8_contract_summary": lambda s, d: H.contract_summary(H.parse_contracts(_contracts(s, d))),
    "i1_build_kb": _kb,
    "i3_knn": _knn,
    "i3_knn_all": lambda s, d: _search(s, d, min_score=-1.0),
    "i4_knn_filtered": lambda s, d: _search(s, d, "label"),
    "i4_knn_filtered_all": lambda s, d: _search(s, d, "label", k=7, min_score=-1.0),
    "i5_get_where": lambda s, d: view(s, d, "kb_chunks").where("section_type = 'enforcement'").select("chunk_ref", "doc_id"),
    "g11_reassemble": lambda s, d: K.reassemble(view(s, d, "kb_chunks").where("chunk_text is not null").select(F.col("doc_id").alias("contract_id"), "chunk_index", F.col("chunk_text").alias("text"))),
    "j11_owned": lambda s, d: K.owned(view(s, d, "contracts").select("contract_id", F.lit("U-7").alias("user_id")), view(s, d, "contracts")),
    "d3_ingest_summary": lambda s, d: C.ingest_summary(outcomes_of(_outcomes(s, d))),
    "j3_collect_risks": _risks,
    "j4_risk_counts": lambda s, d: K.overall_risk(_risks(s, d), G.clause_dicts(view(s, d, "contracts"))),
    "j5_overall_risk": lambda s, d: K.overall_risk(_risks(s, d)),
    "j8_last_turns": lambda s, d: K.last_turns(read(s, d, "conversations")),
}

_RAW = f"with raw as ({view_sql('legal_raw')})"
_PLAIN = f"translate(strip_accents(lower(%s)), '{T.ACCENTED}', '{T.PLAIN}')"
_CLEAN = f"""{_RAW}, clean as (select * replace (case when trim(issued_date) = '' then null when length(issued_date) = 10 then coalesce(strftime(try_strptime(issued_date, '%d/%m/%Y'), '%Y-%m-%d'), issued_date) else issued_date end as issued_date) from raw)"""
_ISO = "case when regexp_full_match(issued_date, '[0-9]{4}-[0-9]{2}-[0-9]{2}') then issued_date when regexp_full_match(issued_date, '[0-9]{2}/[0-9]{2}/[0-9]{4}') then issued_date[7:10] || '-' || issued_date[4:5] || '-' || issued_date[1:2] end"
_plus = lambda n: f"strftime(try_strptime({_ISO}, '%Y-%m-%d') + to_days(cast({n} as integer)), '%Y-%m-%d')"
_SIGNED, _AFTER = f"when contains(content, 'có hiệu lực kể từ ngày ký') then {_ISO}", f"when contains(content, 'sau 45 ngày kể từ ngày ký') then {_plus(45)}"
_BASE = f"""case when regexp_matches(content, 'có hiệu lực thi hành kể từ ngày [0-9]+ tháng') then
    regexp_extract(content, 'năm ([0-9]{{4}})', 1) || '-' || lpad(regexp_extract(content, 'tháng ([0-9]+) năm', 1), 2, '0') || '-' || lpad(regexp_extract(content, 'từ ngày ([0-9]+) tháng', 1), 2, '0')
  {_SIGNED} {_AFTER} end"""
_K = "cast(substring(doc_id, 4) as integer)"
_FORM = f"(({_K} // 4) % 8)"
_DAY = f"cast({_K} % 20 + 2001 as varchar) || '-' || lpad(cast({_K} % 12 + 1 as varchar), 2, '0') || '-' || lpad(cast({_K} % 28 + 1 as varchar), 2, '0')"
_FORMED = f"case when {_FORM} < 4 then {_DAY} when {_FORM} = 4 then {_ISO} when {_FORM} = 5 then coalesce({_plus(f'10 + {_K} % 50')}, case {_SIGNED} end) when {_FORM} = 6 then case {_SIGNED} {_AFTER} end else {_BASE} end"
_CATEGORY = "case cast(substring(doc_id, 4) as integer) % 3 when 0 then 'Thuế - Phí - Lệ phí' when 1 then 'Lao động - Tiền lương' else 'Khác' end"
_OLD_DAY = f"'2001' || substring({_DAY}, 5)"
_NORM = f"regexp_replace({_PLAIN % "replace(lower(%s), 'đ', 'd')"}, '[^a-z0-9]', '', 'g')"
_EDGES = edges_sql("docs", "content")
_MET = f"""{_EDGES}, met as (select e.doc_id as src_doc_id, c.doc_id as dst_doc_id, relation_type, row_number() over (partition by e.doc_id, e.doc_number, relation_type, provision order by coalesce(c.issued_date = e.old_issued_date, false) desc, c.doc_id) as n
   from edges e join known c on {_NORM % 'e.doc_number'} = {_NORM % 'c.doc_number'} where c.doc_number is not null),
 resolved as (select distinct src_doc_id, dst_doc_id, relation_type from met where n = 1)"""
_DEDUP = f"""{_CLEAN}, nth as (select *, row_number() over (partition by coalesce(doc_number, doc_id), issued_date, signer order by doc_id) as n from clean),
 kept as (select * from nth where n = 1 or issued_date is null or signer is null)"""
_STATUS = f"""{_DEDUP}, docs as (select * replace ({RELATED} as content) from kept), known as (select * from kept), {_MET},
 days as (select doc_id, {_BASE} as eff, case when {_K} % 10 = 0 and ({_BASE}) is not null then '2006-' || lpad(cast({_K} % 12 + 1 as varchar), 2, '0') || '-15' end as ends, case {_K} % 9 when 0 then '2026-07-01' when 1 then '2004-07-01' end as part from docs),
 acts as (select dst_doc_id as doc_id, bool_or(relation_type in ('replaces', 'abolishes')) as ended, bool_or(relation_type = 'amends_partial') as partly from resolved join days on days.doc_id = src_doc_id where src_doc_id <> dst_doc_id and coalesce(eff <= '{AS_OF}', true) group by 1),
 flags as (select doc_id, case when coalesce(ended, false) or coalesce(ends <= '{AS_OF}', false) then 2 when eff is null then 0 when eff > '{AS_OF}' then case when coalesce(part <= '{AS_OF}', false) then 5 else 3 end when coalesce(partly, false) then 4 when coalesce(part > '{AS_OF}', false) then 5 else 1 end as status_flag from days left join acts using (doc_id))"""
_PARTY = f"with c0 as ({view_sql('contracts')}), c as (select *, {PARTIES.replace('length(text)||', 'cast(length(text) as varchar)||').replace('(100000000 + length(text))', 'cast(100000000 + length(text) as varchar)')} as long_text from c0)"
_CLAUSE = f"""with c0 as ({view_sql('contracts')}), l as (select contract_id, generate_subscripts(string_split(text, chr(10)), 1) as i, unnest(string_split(text, chr(10))) as line from c0),
 g as (select *, count(*) filter (regexp_matches(line, '^Điều [0-9]+')) over (partition by contract_id order by i) as pos from l),
 clauses as (select contract_id, pos - 1 as pos, regexp_extract(min_by(line, i), '^Điều ([0-9]+)', 1) as clause_number, trim(regexp_replace(min_by(line, i), '^Điều [0-9]+[.]', '')) as title, trim(regexp_replace(regexp_replace(string_agg(line, ' ' order by i), '^Điều [0-9]+[.]', ''), ' +', ' ', 'g')) as summary from g where pos > 0 group by contract_id, pos)"""
_RISKS = f"""with resp as ({view_sql('llm_responses')}), j as (select contract_id, pos, regexp_extract(response, '\\{{[^}}]*\\}}') as t from resp),
 risks as (select contract_id, json_extract_string(t, '$.clause_ref') as clause_ref, json_extract_string(t, '$.issue') as issue, json_extract_string(t, '$.severity') as severity
  from j where t <> '' and json_extract_string(t, '$.severity') in ('critical', 'warning'))"""

ORACLES: dict[str, str] = {
    "ingest_status": f"{_STATUS} select status_flag, count(*) as n from flags group by 1",
    "f7_status_flag": f"{_STATUS} select * from flags",
    "f6_resolve_relations": f"{_CLEAN}, docs as (select * replace ({RELATED} as content) from clean), known as (select * from clean), {_MET} select * from resolved",
    "f1_extract_relations": f"{_RAW}, docs as (select * replace ({RELATED} as content) from raw), {_EDGES} select * from edges",
    "c3_fix_date": f"""{_RAW}, w as (select doc_id, trim(issued_date) as t, ({_K} // 4) % 5 as form, coalesce(strftime(try_strptime(issued_date, '%d/%m/%Y'), '%Y-%m-%d')) as iso from raw),
      r as (select doc_id, case when t = '' then null when length(t) = 10 and form = 2 then t[7:10] when length(t) = 10 then coalesce(iso, case form when 1 then replace(t, '/', '.') when 3 then t[7:10] || '/' || t[4:5] || '/' || t[1:2] when 4 then replace(t, '/', '-') else t end) else t end as issued_date from w)
      select *, coalesce(try_cast(substring(issued_date, 1, 4) as integer), 0) as year_published from r""",
    "d2_dedup_existing": f"""{_CLEAN}, x as (select *, coalesce(doc_number, doc_id) as nr, length(doc_id) % 2 = 0 as incoming from clean), n as (select *, row_number() over (partition by nr, issued_date, signer order by doc_id) as nth from x where incoming)
      select doc_id from n where issued_date is null or signer is null or (nth = 1 and not exists (select 1 from x where not x.incoming and x.nr = n.nr and x.issued_date = n.issued_date and x.signer = n.signer))""",
    "e8_enforcement_date": f"{_CLEAN} select doc_id, case when {_FORM} < 3 then {_DAY} when {_FORM} = 5 then {_plus(f'10 + {_K} % 50')} end as effective_date from clean",
    "e12_extract_metadata": f"{_CLEAN} select doc_id, {_CATEGORY} as category, {_FORMED} as effective_date, null as expiry_date from clean",
    "c11_normalize_doc_number": f"{_RAW} select doc_id, regexp_replace({_PLAIN % 'doc_number'}, '[^a-z0-9]', '', 'g') as k from raw",
    "c10_normalize_query": f"{_RAW} select doc_id, trim(regexp_replace(regexp_replace(replace({_PLAIN % 'trim(title)'}, 'đ', 'd'), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) as q from raw",
    "b3_doc_id_from_url": r"select page_id, regexp_replace(case when regexp_replace(string_split(url, '/')[-1], '\.(aspx|html)$', '') = '' then url else regexp_replace(string_split(url, '/')[-1], '\.(aspx|html)$', '') end, '[^A-Za-z0-9_-]', '_', 'g') as id from pages",
    "b11_year_filter": f"{_CLEAN}, y as (select doc_id, coalesce(try_cast(substring(issued_date, 1, 4) as integer), 0) as year_published from clean) select * from y where year_published <= 0 or year_published between 2004 and 2026",
    "d2_dedup_three_key": f"{_DEDUP} select doc_id from kept",
    "a3_upsert": f"{_RAW} select doc_id, case when length(doc_id) % 2 = 0 then upper(signer) else signer end as signer, title from raw",
    "e6_parse_vn_date": f"{_RAW} select doc_id, case when {_FORM} < 4 or {_FORM} = 6 then {_DAY} end as iso from raw",
    "e7_effective_date": f"{_CLEAN} select doc_id, {_FORMED} as effective_date from clean",
    "f1_replaced_numbers": f"{_RAW} select doc_id, regexp_extract(content, 'Thay thế Nghị định số ([0-9]+/[0-9]+/NĐ-CP)', 1) as doc_number from raw where contains(content, 'Thay thế Nghị định số')",
    "g10_extract_clauses": f"{_CLAUSE} select * from clauses",
    "h2_parties": f"""{_PARTY} select contract_id, regexp_extract(text, 'Công ty: ([^\n]+)', 1) as name, 'Người sử dụng lao động' as role, nullif(trim(regexp_extract(substring(long_text, strpos(long_text, 'lao động)') + 10, 2000), 'Địa chỉ: ([^\\t\\n]+)', 1)), '') as address, regexp_extract(text, 'Mã số thuế: ([0-9]+)', 1) as tax_id, case when length(text) % 2 = 0 then 'Ông ' || user_id end as representative from c
      union all select contract_id, regexp_extract(text, 'Họ và tên: ([^\n]+)', 1), 'Người lao động', 'Ngõ ' || user_id, case when length(text) % 2 = 0 then cast(100000000 + length(text) as varchar) end, null from c""",
    "h7_parse_contracts": f"{_PARTY} select contract_id, 'Hợp đồng LAO ĐỘNG' as contract_type, regexp_extract(text, 'Lương cơ bản: ([^\n]+)', 1) as contract_value, 2 as n_parties, 3 as n_clauses, regexp_extract(text, 'Mã số thuế: ([0-9]+)', 1) as tax_id, regexp_extract(text, 'Điều 2. ([^\n]+)', 1) as second_title from c",
    "h8_contract_summary": f"""{_PARTY} select contract_id, 'Loại: Hợp đồng LAO ĐỘNG' || chr(10) || 'Các bên:' || chr(10) || '  - Người sử dụng lao động: ' || regexp_extract(text, 'Công ty: ([^\n]+)', 1) || chr(10) || '  - Người lao động: ' || regexp_extract(text, 'Họ và tên: ([^\n]+)', 1) || chr(10) || 'Giá trị: ' || regexp_extract(text, 'Lương cơ bản: ([^\n]+)', 1) as info from c""",
    "i1_build_kb": f"{_RAW}, ch as ({view_sql('kb_chunks')}) select doc_id, chunk_ref, chunk_index, substring(chunk_text, 1, 1000) as chunk_text, doc_number, coalesce(issued_date, '') as issued_date from ch join raw using (doc_id) where trim(chunk_text) <> ''",
    "j3_collect_risks": f"{_RISKS} select *, null as legal_basis, null as recommendation from risks",
    "j4_risk_counts": f"""{_RISKS}, n as (select contract_id, count(*) filter (severity = 'critical') as critical, count(*) filter (severity = 'warning') as warning from risks group by 1), c0 as ({view_sql('contracts')}),
      m as (select contract_id, 4 as clauses from c0), b as (select contract_id, coalesce(critical, 0) as critical, coalesce(warning, 0) as warning, coalesce(clauses, 0) as clauses from m full join n using (contract_id))
      select *, case when critical >= 3 then 'critical' when critical >= 1 then 'high' when warning >= 3 then 'medium' else 'low' end as overall_risk from b""",
    "j5_overall_risk": f"{_RISKS}, n as (select contract_id, count(*) filter (severity = 'critical') as critical, count(*) filter (severity = 'warning') as warning from risks group by 1) select *, case when critical >= 3 then 'critical' when critical >= 1 then 'high' when warning >= 3 then 'medium' else 'low' end as overall_risk from n",
    "j8_last_turns": mining.HISTORY,
    "i3_knn": "with s as (select q.vec_id as query_id, v.vec_id, round(list_inner_product(cast(q.embedding as double[]), cast(v.embedding as double[])), 6) as score from embeddings q, embeddings v where q.vec_id % 100 = 0), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s where score >= 0.6) select query_id, vec_id, rank, score from r where rank <= 5",
    "i4_knn_filtered": "with s as (select q.vec_id as query_id, v.vec_id, round(list_inner_product(cast(q.embedding as double[]), cast(v.embedding as double[])), 6) as score from embeddings q join embeddings v on q.label = v.label where q.vec_id % 100 = 0), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s where score >= 0.6) select query_id, vec_id, rank, score from r where rank <= 5",
    "i3_knn_all": "with s as (select q.vec_id as query_id, v.vec_id, round(list_inner_product(cast(q.embedding as double[]), cast(v.embedding as double[])), 6) as score from embeddings q, embeddings v where q.vec_id % 100 = 0), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s where score >= -1) select query_id, vec_id, rank, score from r where rank <= 5",
    "i4_knn_filtered_all": "with s as (select q.vec_id as query_id, v.vec_id, round(list_inner_product(cast(q.embedding as double[]), cast(v.embedding as double[])), 6) as score from embeddings q join embeddings v on q.label = v.label where q.vec_id % 100 = 0), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s where score >= -1) select query_id, vec_id, rank, score from r where rank <= 7",
    "i5_get_where": f"with ch as ({view_sql('kb_chunks')}) select chunk_ref, doc_id from ch where section_type = 'enforcement'",
    "g11_reassemble": f"with ch as ({view_sql('kb_chunks')}) select doc_id as contract_id, string_agg(chunk_text, chr(10) order by chunk_index, chunk_text) as text from ch where chunk_text is not null group by doc_id",
    "j11_owned": f"with c as ({view_sql('contracts')}) select contract_id, user_id from c where user_id = 'U-7'",
    "d3_ingest_summary": f"""with p as ({view_sql('legal_pages')}), k as (select *, cast(regexp_extract(url, '-([0-9]+)[.]aspx', 1) as integer) % 10 as k, regexp_extract(html, '<td>([0-9]+/2020)', 1) as nr from p),
      o as (select case k when 1 then 'failed' when 2 then 'skipped translation' else 'ingested' end as outcome from k) select outcome, count(*) as n from o group by 1 union all select 'total', count(*) from o""",
}

QUERIES |= mining.QUERIES | relations.QUERIES | pages.QUERIES | scalars.QUERIES | stores.QUERIES
ORACLES |= mining.ORACLES | relations.ORACLES | pages.ORACLES | scalars.ORACLES | stores.ORACLES
