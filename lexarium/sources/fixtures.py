"""Legal-text views derived from the driver tables. The same SQL runs on Spark and on DuckDB; FIXTURES.md shows it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = {"legal_pages": ("orders", "customer"), "legal_raw": ("orders", "customer", "nation"), "contracts": ("orders", "customer"), "llm_responses": ("lineitem",), "kb_chunks": ("lineitem",)}
#: SQL of a contract's text.
CONTRACT = """'HỢP ĐỒNG LAO ĐỘNG'||chr(10)||'BÊN A: (Người sử dụng lao động)'||chr(10)||'Công ty: '||c_name||chr(10)
  ||'Mã số thuế: '||cast(100000 + o_custkey as string)||chr(10)||'BÊN B: (Người lao động)'||chr(10)||'Họ và tên: '||o_orderpriority||chr(10)
  ||'Điều 1. Công việc và lương'||chr(10)||'Lương cơ bản: '||cast(cast(floor(o_totalprice) as bigint) as string)||' đồng'||chr(10)
  ||case when o_orderkey % 3 = 0 then 'Điều 2. Thử việc'||chr(10)||'Thời gian thử việc 60 ngày.'||chr(10)
         else 'Điều 2. Bảo hiểm'||chr(10)||'Đóng bảo hiểm xã hội.'||chr(10) end
  ||'Điều 3. Chấm dứt'||chr(10)||repeat('Bên vi phạm phải bồi thường. ', cast(1 + o_orderkey % 60 as int))"""
VIEWS = {
    "legal_raw": """
select 'ND-'||cast(o_orderkey as string) as doc_id,
  case o_orderkey % 3 when 0 then 'Nghị định về thuế ' when 1 then 'Luật lao động ' else 'Quyết định chung ' end||cast(o_orderkey as string) as title,
  case when o_orderkey % 11 = 0 then null
       when o_orderkey % 13 = 0 then '  '||cast(o_orderkey % 500 as string)||' / '||cast(year(o_orderdate) + 8 as string)||'//NĐ--CP '
       else cast(o_orderkey % 500 as string)||'/'||cast(year(o_orderdate) + 8 as string)||'/NĐ-CP' end as doc_number,
  case when o_orderkey % 19 = 0 then null
       when o_orderkey % 17 = 0 then cast(year(o_orderdate) + 8 as string)
       else lpad(cast(day(o_orderdate) as string), 2, '0')||'/'||lpad(cast(month(o_orderdate) as string), 2, '0')||'/'||cast(year(o_orderdate) + 8 as string) end as issued_date,
  case when o_orderkey % 7 = 0 then null else c_name end as signer,
  n_name as issuing_authority,
  'https://example.org/van-ban/Nghi-dinh-'||cast(100 + o_orderkey % 400 as string)||'-'||cast(year(o_orderdate) + 8 as string)||'-ND-CP-'||cast(100000 + o_orderkey as string)||'.aspx' as url,
  case when o_orderkey % 23 = 0 then 'Ngắn' else
    'Số: '||cast(o_orderkey % 500 as string)||'/'||cast(year(o_orderdate) + 8 as string)||'/NĐ-CP'||chr(10)
    ||'Chương I'||chr(10)||'Điều 1. Phạm vi điều chỉnh'||chr(10)
    ||'1. '||repeat('Nội dung quy định chi tiết. ', 8)||chr(10)||'a) Điểm thứ nhất'||chr(10)
    ||'Điều 2. Hiệu lực thi hành'||chr(10)
    ||case o_orderkey % 4
        when 0 then 'Nghị định này có hiệu lực thi hành kể từ ngày '||cast(day(o_orderdate) as string)||' tháng '||cast(month(o_orderdate) as string)||' năm '||cast(year(o_orderdate) + 8 as string)||'.'
        when 1 then 'Nghị định này có hiệu lực kể từ ngày ký.'
        when 2 then 'Nghị định này có hiệu lực thi hành sau 45 ngày kể từ ngày ký ban hành.'
        else 'Trách nhiệm thi hành.' end
    ||case when o_orderkey % 5 = 0 then chr(10)||'Thay thế Nghị định số '||cast((o_orderkey * 7) % 500 as string)||'/'||cast(year(o_orderdate) + 8 as string)||'/NĐ-CP của Chính phủ.' else '' end
  end as content
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
""",
    "legal_pages": """
select 'https://example.org/van-ban/Nghi-dinh-'||cast(o_orderkey as string)||'.aspx' as url,
  '<html><head><title>Nghị định '||cast(o_orderkey as string)||' - Thư viện Pháp luật</title></head><body><div id="divThuocTinh"><table><tr><td>Số hiệu:</td><td>'
  ||cast(o_orderkey % 500 as string)||'/2020/NĐ-CP</td></tr><tr><td><b>Người ký:</b></td><td>'||c_name
  ||'</td></tr></table></div><p class="nqTitle"><a href="/van-ban/x-'||cast(o_orderkey % 97 as string)
  ||'.aspx">x</a></p><div id="toanvancontent"><script>x()</script><p>Điều 1. Phạm vi</p><p>'||repeat('Nội dung. ', 20)||'</p></div></body></html>' as html
from orders join customer on o_custkey = c_custkey
""",
    "contracts": f"""
select 'HD-'||cast(o_orderkey as string) as contract_id, 'U-'||cast(o_custkey % 20 as string) as user_id,
  {CONTRACT} as text
from orders join customer on o_custkey = c_custkey
""",
    "llm_responses": """
select 'HD-'||cast(l_orderkey as string) as contract_id, l_linenumber as pos,
  case when l_partkey % 29 = 0 then 'not json' when l_partkey % 2 = 0 then '```json'||chr(10) else '' end
  ||'{"clause_ref":"Điều '||cast(l_linenumber as string)||'","severity":"'
  ||case l_returnflag when 'R' then 'critical' when 'A' then 'warning' else 'ok' end||'","issue":"p'||cast(l_partkey as string)||'"'
  ||case when l_partkey % 29 = 0 then '' else '}' end||case when l_partkey % 2 = 0 then chr(10)||'```' else '' end as response
from lineitem
""",
    "kb_chunks": """
select 'ND-'||cast(l_orderkey as string)||'-'||cast(l_linenumber as string) as chunk_ref,
  'ND-'||cast(l_orderkey as string) as doc_id, l_linenumber as chunk_index,
  case when l_partkey % 31 = 0 then '  ' when l_partkey % 37 = 0 then null
       else 'Điều '||cast(l_linenumber as string)||'. '||repeat('Quy định chung. ', cast(1 + l_partkey % 90 as int)) end as chunk_text,
  case when l_linenumber = 1 then 'enforcement' else 'dieu' end as section_type
from lineitem
""",
}


def view_sql(name: str) -> str:
    return VIEWS[name].strip()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task, and tasks for each core, of a table that is dealt anew.
TASK_ROWS, TASKS = 50_000, 3


#: What a view's first table is joined on.
JOINED = {"orders": "o_custkey"}


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """``df`` dealt over all cores where its file is read by fewer tasks than twice the cores: a file of one row group is one task, whatever is made of its rows.

    By ``key``, if it is joined on that, so that a join by hash keeps these tasks, whose number grows with the rows, and not the fixed one of a shuffle.
    """
    rows, tasks = df.select(F.spark_partition_id().alias("p")).groupBy("p").count().agg(F.sum("count"), F.count("p")).first()
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = rows and (key or tasks < 2 * cores)
    return df.repartition(max(TASKS * cores, -(-rows // TASK_ROWS)), *filter(None, [key])) if few else df


def view(spark: SparkSession, sf_dir: str, name: str, **more: str) -> DataFrame:
    """The view, with ``more`` columns, given as SQL over its tables."""
    sql = view_sql(name).replace("\nfrom ", "".join(f",\n  {x} as {k}" for k, x in more.items()) + "\nfrom ").replace("{", "{{").replace("}", "}}")
    tables = {t: read(spark, sf_dir, t) for t in TABLES[name]}
    most = TABLES[name][0]  # a row of the view for each of its rows
    return spark.sql(re.sub(r"\b(from|join) (\w+)", r"\1 {\2}", sql), **{**tables, most: spread(tables[most], JOINED.get(most))})
