import glob
import os

import duckdb
import pytest

from lexarium.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    a, b = QUERIES[name](spark, SF), c.sql(ORACLES[name])
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    rows = lambda got, head: sorted(str([r[head.index(k)] for k in cols]) for r in got)
    assert rows(a.collect(), a.columns) == rows(b.fetchall(), b.columns)


def test_clauses(spark):
    from lexarium.operators.contracts import extract_clauses

    text = "Mở đầu\nĐiều 1. Lương\nNội dung\nĐiều 2 – Phạt\n"
    rows = extract_clauses(spark.createDataFrame([("a", text), ("b", "không có")], "contract_id string, text string")).collect()
    assert [(r.contract_id, r.pos, r.clause_number, r.title) for r in rows][:1] == [("a", 0, "1", "Lương")]
    assert {r.contract_id for r in rows} == {"a"}


def test_status(spark):
    from lexarium.operators.corpus import status_flag

    docs = spark.createDataFrame([("a", "2005-01-01"), ("b", "2030-01-01"), ("c", None), ("d", "2001-01-01")], "doc_id string, effective_date string")
    edges = spark.createDataFrame([("a", "d"), ("a", "a")], "src_doc_id string, dst_doc_id string")
    assert {r.doc_id: r.status_flag for r in status_flag(docs, edges, "2006-01-01").collect()} == {"a": 1, "b": 3, "c": 0, "d": 2}


def test_fixtures_document():
    """FIXTURES.md shows the SQL of the views as the package has it."""
    import re

    from lexarium.sources.fixtures import VIEWS, view_sql

    text = open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "FIXTURES.md"), encoding="utf-8").read()
    shown = dict(re.findall(r"### \S+ `(\w+)`.*?```sql\n(.*?)\n```", text, re.S))
    assert {k: v.strip() for k, v in shown.items()} == {k: view_sql(k) for k in VIEWS}
