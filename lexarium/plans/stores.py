"""Queries that keep tables between steps: the ingest stream and the knowledge-base store, and their SQL."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..sources.fixtures import view, view_sql
from ..sources.shared import shared_folder
from ..sources.tables import read_kb, write_kb
from ..streaming.ingest import current, ingest_stream, stored

#: Number of a derived page; the batch that brings it; days, so that every 500th page is the same act; a signer, and that of a changed page.
N = "cast(regexp_extract(url, '-([0-9]+)[.]aspx', 1) as int)"
DAY = f"lpad(cast({N} % 500 % 28 + 1 as string), 2, '0')||'/0'||cast({N} % 500 % 9 + 1 as string)||'/2020'"
ROW = "</td></tr></table>"


def _arrivals(s, d):
    """(url, html, batch): all derived pages in three batches; the last repeats some of the first two, changed ones and unchanged ones."""
    pages = view(s, d, "legal_pages")
    signer = lambda name: F.expr(f"replace(regexp_replace(html, '<td>Customer#[0-9]+', '<td>'||{name}), '{ROW}', '</td></tr><tr><td>Ngày ban hành:</td><td>'||{DAY}||'{ROW}')")
    usual, changed = f"'S'||cast({N} % 500 % 7 as string)", f"'X'||cast({N} % 1000 as string)"
    first = pages.select("url", signer(usual).alias("html"), F.expr(f"{N} % 3").alias("batch"))
    again = pages.where(f"{N} % 12 = 0").select("url", signer(changed).alias("html"), F.lit(2).alias("batch"))
    return first.unionByName(again).unionByName(first.where(f"{N} % 15 = 1").withColumn("batch", F.lit(2)))


def _stream(s, d):
    at = f"{shared_folder(s)}/stream-{uuid4().hex}"
    pages = _arrivals(s, d)
    for k in range(3):
        pages.where(F.col("batch") == k).select("url", "html").write.mode("append").parquet(f"{at}/in")
        ingest_stream(s, f"{at}/in", f"{at}/table", f"{at}/checkpoint").awaitTermination()
    return current(stored(s, f"{at}/table")).select("doc_id", "doc_number", "issued_date", "signer", "batch")


def _kb(s, d):
    """A store that is rebuilt, to which one batch is added twice, and of which one section type is read."""
    at = f"{shared_folder(s)}/kb-{uuid4().hex}"
    chunks = view(s, d, "kb_chunks")
    write_kb(chunks.where("chunk_index = 7"), at)
    write_kb(chunks.where("chunk_index <= 2"), at)
    for _ in range(2):
        write_kb(chunks.where("chunk_index > 2"), at, "rest")
    return read_kb(s, at, section_type="dieu").select("chunk_ref", "doc_id", "chunk_index", F.length("chunk_text").alias("n"))


QUERIES = {"k1_ingest_stream": _stream, "a7_kb_store": _kb}

ORACLES = {
    "a7_kb_store": f"with ch as ({view_sql('kb_chunks')}) select chunk_ref, doc_id, chunk_index, length(chunk_text) as n from ch where section_type = 'dieu'",
    "k1_ingest_stream": f"""with p as ({view_sql('legal_pages')}), k as (select *, {N} as n from p),
      d as (select 'Nghi-dinh-' || n as doc_id, n, (n % 500) || '/2020/NĐ-CP' as doc_number, '2020-0' || (n % 500 % 9 + 1) || '-' || lpad(cast(n % 500 % 28 + 1 as varchar), 2, '0') as issued_date, 'S' || (n % 500 % 7) as signer from k),
      b0 as (select *, 0 as batch from d where n % 3 = 0 qualify row_number() over (partition by doc_number, issued_date, signer order by doc_id) = 1),
      b1 as (select *, 1 as batch from d where n % 3 = 1 and not exists (select 1 from b0 where b0.doc_number = d.doc_number and b0.signer = d.signer and b0.issued_date = d.issued_date) qualify row_number() over (partition by doc_number, issued_date, signer order by doc_id) = 1),
      s1 as (select * from b0 union all select * from b1),
      a2 as (select * from d where n % 3 = 2 or n % 15 = 1 union all select * replace ('X' || (n % 1000) as signer) from d where n % 12 = 0),
      n2 as (select *, 2 as batch from a2 where doc_id not in (select doc_id from s1) and not exists (select 1 from s1 where s1.doc_number = a2.doc_number and s1.signer = a2.signer and s1.issued_date = a2.issued_date) qualify row_number() over (partition by doc_number, issued_date, signer order by doc_id) = 1),
      c2 as (select a2.*, 2 as batch from a2 join s1 using (doc_id) where a2.signer <> s1.signer),
      now as (select * from s1 where doc_id not in (select doc_id from c2) union all select * from c2 union all select * from n2)
      select doc_id, doc_number, issued_date, signer, cast(batch as bigint) as batch from now""",
}
