"""Queries of relations and amendments, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import amendments as A
from ..operators import corpus as C
from ..operators import dates as D
from ..operators import relations as R
from ..operators import structure as G
from ..sources.fixtures import view, view_sql

#: What turns each raw document into an amending one; the numbers come from the document.
CHANGE = "content || chr(10) || '3. Sửa đổi, bổ sung khoản 2 Điều ' || cast(length(title) % 9 + 1 as string) || ' như sau:' || chr(10) || 'Nội dung mới' || chr(10) || '4. Bãi bỏ Điều 7'"
EXCEPT = "content || chr(10) || '3. Điều ' || cast(length(title) % 9 + 1 as string) || ' và Phụ lục IV có hiệu lực từ ngày 01/07/2026. Luật cũ, trừ khoản 3 Điều 50 hết hiệu lực kể từ ngày 02/08/2027.'"


def _docs(s, d, content="content"):
    return view(s, d, "legal_raw").withColumn("content", F.expr(content))


def _amended_by(s, d):
    """Of days only those of acts that name another are asked for, so the other texts aren't read for them."""
    docs = _docs(s, d, CHANGE)
    amending = F.when(A.names_act(F.col("content")), F.col("content"))
    dated = D.read_days(C.clean_dates(docs).select("doc_id", "doc_number", "issued_date", amending.alias("content")))
    return A.amended_by(G.articles(docs), A.extract_amendments(docs, targeted=True), dated.select("doc_id", "doc_number", "effective_date"))


_NUMBER = r"[0-9]+/(?:[0-9]+/)?\p{L}+[0-9]*(?:-\p{L}+[0-9]*)*"
_TO = r"(?:[\p{L}\p{N}_]+\s+){0,3}(?:số\s+)?"
_PART = r"(?:Điều|điều|khoản|điểm)\s+[\p{L}\p{N}_]+(?:[,\s]+(?:Điều|điều|khoản|điểm)\s+[\p{L}\p{N}_]+)*"
#: Kind, pattern, and the groups of the part (0: none) and the number.
_WORDINGS = [
    ("amends_partial", rf"[Bb]ãi\s+bỏ\s+((?:khoản|điểm|mục)\s+[\p{{L}}\p{{N}}_]+(?:\s+[Đđ]iều\s+[\p{{L}}\p{{N}}_]+)?)\s+(?:của\s+)?{_TO}({_NUMBER})", 1, 2),
    ("amends_partial", rf"[Ss]ửa\s+đổi\s+({_PART})\s+(?:của\s+)?{_TO}({_NUMBER})", 1, 2),
    ("abolishes", rf"[Bb]ãi\s+bỏ\s+{_TO}({_NUMBER})", 0, 1),
    ("replaces", rf"[Tt]hay\s+thế\s+{_TO}({_NUMBER})", 0, 1),
    ("abolishes", rf"[Hh]ết\s+hiệu\s+lực\s+{_TO}({_NUMBER})", 0, 1),
    ("abolishes", rf"({_NUMBER})\s+hết\s+hiệu\s+lực", 0, 1),
    ("amends", rf"[Ss]ửa\s+đổi[,\s]+bổ\s+sung\s+{_TO}({_NUMBER})", 0, 1),
]


_SENTENCE = r"'^((?s:.*?))(?:\.\s*$|\.\s+\p{L}|;|\n|$)'"
_ISSUED = r"'của\s+([^,;.\n]+?)(?:\s+(?:ban\s+hành|phê\s+duyệt|quy\s+định|về)\s+(.*)|[,;.\n]|$)'"


def edges_sql(docs: str, content: str) -> str:
    """CTEs up to ``edges``: the relations of the table ``docs``: wordings by place, then the items of lists."""
    day = lambda near: f"coalesce(nullif(regexp_extract({near}, '(?i)ngày\\s+([0-9]+\\s+tháng\\s+[0-9]+\\s+năm\\s+[0-9]{{4}})', 1), ''), nullif(regexp_extract({near}, '(?i)ngày\\s+([0-9]+[/-][0-9]+[/-][0-9]{{4}})', 1), ''))"
    iso = lambda d: f"(select n[3] || '-' || lpad(n[2], 2, '0') || '-' || lpad(n[1], 2, '0') from (select regexp_extract_all({d}, '[0-9]+') as n))"
    hits = " union all ".join(
        f"select doc_id, content, {o} as o, '{kind}' as kind, unnest(regexp_extract_all(content, '{p}', 0)) as hit, '{p}' as p, {part} as part, {number} as number from worded" for o, (kind, p, part, number) in enumerate(_WORDINGS)
    )
    part = " ".join(f"when o = {o} then substring(regexp_extract(hit, '{p}', {part}), 1, 50)" for o, (_, p, part, _) in enumerate(_WORDINGS) if part)
    number = " ".join(f"when {o} then regexp_extract(hit, '{p}', {number})" for o, (_, p, _, number) in enumerate(_WORDINGS))
    return f"""worded as (select doc_id, {content} as content from {docs}),
 hits as ({hits.replace(", part as part", "")}),
 placed as (select doc_id, content, o, kind, case {part} else '' end as provision, case o {number} end as nr, strpos(content, hit) as pos, hit from hits),
 near as (select *, pos - 1 + length(hit) as stop, pos - 1 + strpos(hit, nr) - 1 + length(nr) as own from placed),
 seen as (select doc_id, o, pos, kind, provision, nr, substring(content, greatest(stop - 50, 0) + 1, stop + 500 - greatest(stop - 50, 0)) as ctx,
   regexp_extract(substring(content, own + 1, stop + 500 - own), {_SENTENCE}, 1) as sentence from near),
 said as (select *, regexp_extract(sentence, {_ISSUED}, ['a', 't']) as s, {day('ctx')} as d from seen),
 lines as (select doc_id, i, string_split(content, chr(10))[i] as line from worded, unnest(range(1, len(string_split(content, chr(10))) + 1)) r(i)),
 marked as (select *, regexp_matches(line, '^\\s*[-–•]') as item, max(case when trim(line) <> '' and not regexp_matches(line, '^\\s*[-–•]') then i end) over (partition by doc_id order by i) as above from lines),
 items as (select m.doc_id, m.i, m.line, lower(regexp_extract(h.line, '(?i)(thay\\s+thế|bãi\\s+bỏ|hết\\s+hiệu\\s+lực)\\s*:\\s*$', 1)) as head,
   regexp_extract_all(m.line, '(?i){_NUMBER}\\s+ngày\\s+[0-9]+[^0-9]+[0-9]+[^0-9]+[0-9]{{4}}') as dated from marked m join lines h on h.doc_id = m.doc_id and h.i = m.above where m.item),
 item_acts as (select *, unnest(case when len(dated) > 0 then dated else [line] end) as act from items where head <> ''),
 numbered as (select *, regexp_extract(act, '{_NUMBER}') as n from item_acts),
 named as (select *, regexp_extract(regexp_extract(substring(line, strpos(line, n) + length(n)), {_SENTENCE}, 1), {_ISSUED}, ['a', 't']) as s from numbered),
 listed as (select doc_id, 99 as o, i as pos, case when head like 'thay%' then 'replaces' else 'abolishes' end as kind, '' as provision, n as nr, nullif(s.a, '') as a, case when len(dated) > 0 then {iso("regexp_extract(act, '(?i)ngày.*')")} end as d, case when length(trim(s.t)) > 10 then substring(trim(s.t), 1, 300) end as t from named),
 found as (select doc_id, o, pos, kind, provision, nr, nullif(trim(s.a), '') as a, case when d is not null then {iso('d')} end as d, case when length(trim(s.t)) > 10 then substring(trim(s.t), 1, 300) end as t from said union all select * from listed),
 firsts as (select *, row_number() over (partition by doc_id, lower(nr), kind, lower(provision) order by o, pos) as nth, max(kind = 'amends_partial') over (partition by doc_id, lower(nr)) as partly from found where length(nr) >= 5),
 edges as (select doc_id, nr as doc_number, kind as relation_type, provision, a as issuing_authority_hint, d as old_issued_date, t as title_hint from firsts where nth = 1 and not (kind = 'amends' and partly))"""


QUERIES = {
    "e13_provision_dates": lambda s, d: A.provision_dates(_docs(s, d, EXCEPT)),
    "f2_expiry_relations": lambda s, d: R.expiry_relations(_docs(s, d)),
    "f3_extract_amendments": lambda s, d: A.extract_amendments(_docs(s, d, CHANGE)),
    "f4_amendment_target": lambda s, d: A.amendment_target(_docs(s, d)),
    "f5_amendment_dates": lambda s, d: A.amendment_dates(_docs(s, d, EXCEPT)),
    "f8_amended_by": _amended_by,
}

_RAW = f"with raw as ({view_sql('legal_raw')})"
_N = "cast(length(title) % 9 + 1 as varchar)"
_OLD = "nullif(regexp_extract(content, 'Thay thế Nghị định số ([0-9]+/[0-9]+/NĐ-CP)', 1), '')"
ORACLES: dict[str, str] = {
    "e13_provision_dates": f"{_RAW} select doc_id, {_N} as article, null as clause, null as appendix, '2026-07-01' as effective_date from raw union all select doc_id, null, null, '4', '2026-07-01' from raw",
    "f2_expiry_relations": f"{_RAW} select doc_id, {_OLD} as doc_number, 'replaces' as relation_type from raw where {_OLD} is not null",
    "f4_amendment_target": f"{_RAW} select doc_id, {_OLD} as target_doc_number from raw",
    "f5_amendment_dates": f"{_RAW} select doc_id, unnest(['D50', 'D50.K3']) as key, '2027-08-02' as date from raw",
    "f3_extract_amendments": f"""{_RAW}, t as (select *, len(string_split(content, chr(10))) as n, {_OLD} as target_doc_number from raw),
      u as (select doc_id, n as line_start, n + 1 as line_end, 'amended' as action, {_N} as article, '2' as clause, '3. Sửa đổi, bổ sung khoản 2 Điều ' || {_N} || ' như sau:' as description, 'Nội dung mới' as content, target_doc_number from t
       union all select doc_id, n + 2, n + 2, 'abolished', '7', null, '4. Bãi bỏ Điều 7', '', target_doc_number from t)
      select *, null as point, null as chapter, null as section, null as special, null as old, null as new from u""",
}
