"""Queries of pages, registries and the stream's batch step, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import doc_id_from_url
from ..operators import corpus as C
from ..operators import structure as G
from ..sources import html as P
from ..sources import tables as S
from ..sources.fixtures import read, view, view_sql
from ..sources.shared import tasks_for
from ..sources.site import site_parse
from ..streaming.ingest import documents_of, finished

BASE = "https://example.org"


def _legal(s, d):
    return view(s, d, "legal_pages")


def _real(s, d):
    return read(s, d, "pages").select("url", "html")


def _files(s, d):
    kind = F.element_at(F.array(*map(F.lit, (".DOCX", ".pdf", ".txt"))), (F.length("text") % 3 + 1).cast("int"))
    return view(s, d, "contracts").select("contract_id", F.concat("contract_id", kind).alias("filename"), "text")


def _registry(s, d):
    return S.contract_registry(_files(s, d), G.chunk_by_clause(view(s, d, "contracts")))


#: Derived pages with a legal basis, a chapter in a div and an article in a list.
NESTED = "replace(html, '<p>Điều 1. Phạm vi</p>', '<p>Căn cứ Luật số '||regexp_extract(url, '-([0-9]+)[.]aspx', 1)||' năm 2015</p><div><p>Chương I</p></div><ul><li>Điều '||regexp_extract(url, '-([0-9]+)[.]aspx', 1)||'. Phạm vi</li></ul>')"

#: Derived pages of three sites: property cells; classes and an id; cells without end tags and no content element.
_K = "regexp_extract(url, '-([0-9]+)[.]aspx', 1)"
SITES = (
    f"case cast({_K} as int) % 3 when 0 then html when 1 then '<html><head><title>Trang '||{_K}||'</title></head><body><header>Menu</header><h1 class=\"tieu-de big\">Quyết định <b>'||{_K}||'</b></h1>"
    f"<span class=\"so\">sai</span><span class=\"x so-hieu\">'||{_K}||'/2021/QĐ</span><div class=\"ngay\"> 05/0'||(1 + cast({_K} as int) % 9)||'/2021 </div><div id=\"noidung\"><script>x()</script><p>Căn cứ Luật số '||{_K}||' năm 2015</p><ul><li>Điều 1. Mục '||{_K}||'</li></ul></div><footer>f</footer></body></html>' "
    f"else '<body><nav>m</nav><p>Điều 2. '||{_K}||'<table><tr><td>SỐ HIỆU: <td> '||{_K}||'/2022/TT<tr><td>Ngày có hiệu lực<td>2022-01-02</table><footer>f</footer></body>' end"
)
RULES = {
    "title": [{"tag": "h1", "class": "tieu-de"}, {"tag": "title"}], "doc_number": [{"tag": "span", "class": "so-hieu"}, {"text_before": "số hiệu"}], "signer": [{"text_before": "Người ký"}],
    "issued_date": [{"tag": "div", "class": "ngay"}], "effective_date": [{"text_before": "có hiệu lực"}], "content": [{"tag": "div", "id": "toanvancontent"}, {"tag": "div", "id": "noidung"}],
}
SITE_COLUMNS = ("url", "doc_id", "title", "doc_number", "doc_type", "signer", "issued_date", "effective_date", "content", "year_published")


def _nested_sections(s, d):
    pages = _legal(s, d)
    return G.html_sections(P.block_text(pages.select("url", F.expr(NESTED).alias("html"))), tasks_for(pages, "html"))


def _site(s, d):
    return site_parse(_legal(s, d).select("url", F.expr(SITES).alias("html")), RULES)


def _site_sections(s, d):
    return G.html_sections(_site(s, d).select("url", F.array_join("sections", "\n").alias("content")), tasks_for(_legal(s, d), "html"))


QUERIES = {
    "g3_html_sections": _nested_sections,
    "a1_load_pages": lambda s, d: S.load_pages(s, f"{d}/pages.parquet").select("url", F.length("html").alias("n")),
    "a2_contract_registry": _registry,
    "a4_upsert_contracts": lambda s, d: S.upsert_contracts(
        _registry(s, d).drop("file_type"), view(s, d, "contracts").select("contract_id", F.col("contract_id").alias("filename"), F.lit("analyzed").alias("status"), F.lit("").alias("message"), F.lit(1).cast("long").alias("chunk_count"), F.lit(1).alias("seq"))
    ),
    "a5_all_urls": lambda s, d: S.all_urls(view(s, d, "legal_raw")),
    "b1_listing_links": lambda s, d: P.listing_links(_legal(s, d), BASE),
    "b1_page_links": lambda s, d: P.listing_links(_real(s, d), BASE, "."),
    "b4_extract_content": lambda s, d: P.extract_content(_legal(s, d)),
    "b5_extract_body": lambda s, d: P.extract_content(_real(s, d)),
    "b7_html_metadata": lambda s, d: P.html_metadata(_legal(s, d)).select("url", "doc_number", "signer"),
    "b8_resolve_title": lambda s, d: P.resolve_title(_real(s, d), doc_id_from_url(F.col("url"))),
    "b9_site_parse": lambda s, d: _site(s, d).select(*SITE_COLUMNS, F.array_join("sections", "|").alias("sections")),
    "b9_site_sections": _site_sections,
    "d1_new_urls": lambda s, d: C.new_urls(P.listing_links(_legal(s, d), BASE).select(F.col("link").alias("url")), view(s, d, "legal_raw")),
    "k1_documents_of": lambda s, d: finished(documents_of(_legal(s, d))).select("doc_id", "title", "doc_number", "signer", "year_published"),
}

_P = f"with p as ({view_sql('legal_pages')})"
_NUM, _SIGNER = "regexp_extract(html, '<td>([0-9]+/2020/NĐ-CP)</td>', 1)", "regexp_extract(html, '<td>(Customer#[0-9]+)</td>', 1)"
ORACLES: dict[str, str] = {
    "a2_contract_registry": f"""with c as ({view_sql('contracts')}), k as (select *, length(text) % 3 as kind, 1 + cast(substring(contract_id, 4) as integer) % 60 as m from c)
      select contract_id, contract_id || case kind when 0 then '.DOCX' else '.pdf' end as filename, case kind when 0 then '.docx' else '.pdf' end as file_type, 'parsed' as status, '' as message, cast(4 + case when m > 34 then 2 when m = 34 then 1 else 0 end as bigint) as chunk_count from k where kind < 2""",
    "a4_upsert_contracts": f"with c as ({view_sql('contracts')}) select contract_id, contract_id || case length(text) % 3 when 0 then '.DOCX' when 1 then '.pdf' else '' end as filename, 'analyzed' as status, '' as message, cast(1 as bigint) as chunk_count from c",
    "a1_load_pages": "select url, length(html) as n from pages",
    "a5_all_urls": f"with raw as ({view_sql('legal_raw')}) select distinct url from raw where url is not null",
    "b1_listing_links": f"{_P} select url as page_url, 0 as pos, '{BASE}' || regexp_extract(html, 'href=\"([^\"]+)\"', 1) as link from p",
    "b4_extract_content": f"{_P} select url, 'Điều 1. Phạm vi' || chr(10) || rtrim(repeat('Nội dung. ', 20)) || ' ' as content from p",
    "b7_html_metadata": f"{_P} select url, {_NUM} as doc_number, {_SIGNER} as signer from p",
    "b9_site_parse": f"""{_P}, k as (select *, {_K} as k, cast({_K} as integer) as n from p)
      select url, 'Nghi-dinh-' || k as doc_id, case n % 3 when 0 then 'Nghị định ' || k || ' - Thư viện Pháp luật' when 1 then 'Quyết định' || k else 'Không có tiêu đề' end as title,
        case n % 3 when 0 then {_NUM} when 1 then k || '/2021/QĐ' else k || '/2022/TT' end as doc_number, null as doc_type, case n % 3 when 0 then {_SIGNER} end as signer,
        case n % 3 when 1 then '05/0' || (1 + n % 9) || '/2021' end as issued_date, case n % 3 when 2 then '2022-01-02' end as effective_date,
        case n % 3 when 0 then 'Điều 1. Phạm vi' || chr(10) || repeat('Nội dung. ', 20) when 1 then 'Căn cứ Luật số ' || k || ' năm 2015' || chr(10) || 'Điều 1. Mục ' || k
          else 'Điều 2. ' || k || chr(10) || 'SỐ HIỆU: ' || chr(10) || ' ' || k || '/2022/TT' || chr(10) || 'Ngày có hiệu lực' || chr(10) || '2022-01-02' end as content,
        case n % 3 when 1 then 2021 when 2 then 2022 end as year_published,
        case n % 3 when 0 then 'Điều 1. Phạm vi|' || rtrim(repeat('Nội dung. ', 20)) when 1 then 'Căn cứ Luật số ' || k || ' năm 2015' || '|Điều 1. Mục ' || k || '|Điều 1. Mục ' || k
          else 'Điều 2. ' || k || 'SỐ HIỆU:' || k || '/2022/TTNgày có hiệu lực2022-01-02|SỐ HIỆU:' || k || '/2022/TTNgày có hiệu lực2022-01-02' end as sections from k""",
    "b9_site_sections": f"""{_P}, k as (select *, {_K} as k, cast({_K} as integer) as n from p)
      select url as doc_id, 1 as node_id, null as parent_id, 3 as depth, 'dieu' as section_type, '1' as number, 'Điều 1. Phạm vi' as heading, 'Điều 1. Phạm vi' || chr(10) || rtrim(repeat('Nội dung. ', 20)) as content from k where n % 3 = 0
      union all select url, 1, null, 99, 'legal_basis', null, 'Căn cứ Luật số ' || k || ' năm 2015', 'Căn cứ Luật số ' || k || ' năm 2015' from k where n % 3 = 1
      union all select url, 2, null, 3, 'dieu', '1', 'Điều 1. Mục ' || k, 'Điều 1. Mục ' || k from k where n % 3 = 1 union all select url, 3, null, 3, 'dieu', '1', 'Điều 1. Mục ' || k, 'Điều 1. Mục ' || k from k where n % 3 = 1
      union all select url, 1, null, 3, 'dieu', '2', h, h || chr(10) || substring(h, length('Điều 2. ' || k) + 1) from (select url, k, 'Điều 2. ' || k || 'SỐ HIỆU:' || k || '/2022/TTNgày có hiệu lực2022-01-02' as h from k where n % 3 = 2)""",
    "g3_html_sections": f"""{_P}, k as (select url, regexp_extract(url, '-([0-9]+)[.]aspx', 1) as k from p)
      select url as doc_id, 1 as node_id, null as parent_id, 99 as depth, 'legal_basis' as section_type, null as number, 'Căn cứ Luật số ' || k || ' năm 2015' as heading, 'Căn cứ Luật số ' || k || ' năm 2015' as content from k
      union all select url, 2, null, 1, 'chuong', 'I', 'Chương I', 'Chương I' from k union all select url, 3, 2, 3, 'dieu', k, 'Điều ' || k || '. Phạm vi', 'Điều ' || k || '. Phạm vi' from k
      union all select url, 4, 2, 3, 'dieu', k, 'Điều ' || k || '. Phạm vi', 'Điều ' || k || '. Phạm vi' || chr(10) || rtrim(repeat('Nội dung. ', 20)) from k""",
    "k1_documents_of": f"{_P} select regexp_extract(url, 'van-ban/(.*)[.]aspx', 1) as doc_id, 'Nghị định ' || regexp_extract(url, '-([0-9]+)[.]aspx', 1) as title, {_NUM} as doc_number, {_SIGNER} as signer, 0 as year_published from p",
    "d1_new_urls": f"{_P} select distinct '{BASE}' || regexp_extract(html, 'href=\"([^\"]+)\"', 1) as url from p",
}
