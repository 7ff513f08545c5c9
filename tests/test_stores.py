"""Tables that are kept between steps: the part log, the stream's table, the knowledge base, a database."""

import os

import pytest
from pyspark.sql import functions as F

from lexarium.sources import tables as S
from lexarium.sources.log import Log
from lexarium.streaming import ingest as I


def _rows(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, n int, kind string")


def _ids(df):
    return sorted((r.id, r.n) for r in df.collect())


def test_log(spark, tmp_path):
    log = Log(spark, f"{tmp_path}/t", "kind")
    assert log.read() is None and log.parts() == []
    log.put(_rows(spark, ("a", 1, "x"), ("b", 2, "1"), ("c", 3, None)), "one")
    log.put(_rows(spark, ("d", 4, "x")), "two")
    log.put(_rows(spark, ("d", 5, "x"), ("e", 6, "y")), "two")  # runs again
    assert _ids(log.read()) == [("a", 1), ("b", 2), ("c", 3), ("d", 5), ("e", 6)]
    assert _ids(log.read({log.folder("x")})) == [("a", 1), ("d", 5)] and _ids(log.read(besides="two")) == [("a", 1), ("b", 2), ("c", 3)]
    assert [r.kind for r in log.read({log.folder("1")}).collect()] == ["1"]
    assert all("kind=x" in f for f in log.read({log.folder("x")}).inputFiles())
    log.put(_rows(spark).limit(0), "three")
    assert len(_ids(log.read())) == 5
    log.put(_rows(spark, ("z", 9, "z")), "whole", log.parts())
    log.put(_rows(spark, ("y", 9, "z")), "more")
    assert _ids(log.read()) == [("y", 9), ("z", 9)]
    left = [f for _, _, files in os.walk(f"{tmp_path}/t/data") for f in files if f.endswith(".parquet")]
    assert len(left) == 2 and len(log._manifests()) == 2  # what no recent manifest names is gone


def test_log_shows_a_batch_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    log = Log(spark, f"{tmp_path}/t", "kind")
    log.put(_rows(spark, ("a", 1, "x")), "one")
    monkeypatch.setattr(Log, "_publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        log.put(_rows(spark, ("a", 2, "x")), "one")
    assert _ids(log.read()) == [("a", 1)]
    monkeypatch.undo()
    log.put(_rows(spark, ("a", 3, "x")), "one")
    assert _ids(Log(spark, f"{tmp_path}/t", "kind").read()) == [("a", 3)]


def test_stream_table_merges_full_buckets(spark, tmp_path, monkeypatch):
    """Ten versions of a page and new pages in between: one current row a page, few parts a bucket, and a key is free once its document has another."""
    monkeypatch.setattr(I, "BUCKETS", 2)
    monkeypatch.setattr(I, "documents_of", lambda pages: pages)  # the log, not the pages
    at = str(tmp_path / "table")
    make = lambda *rows: spark.createDataFrame(list(rows), "url string, doc_id string, doc_number string, issued_date string, signer string")
    for k in range(8):
        I.add_new(spark, make(("u0", "d0", f"{k}/1", "2001-01-01", "S"), (f"u{k + 1}", f"d{k + 1}", None, None, "S")), at, k)
    now = {r.doc_id: (r.doc_number, r.batch) for r in I.current(I.stored(spark, at)).collect()}
    assert now == {"d0": ("7/1", 7)} | {f"d{k + 1}": (None, k) for k in range(8)}
    log = Log(spark, f"{at}/documents", "bucket")
    assert max(sum(f == x for _, f in log.parts()) for x in ("bucket=0", "bucket=1")) <= I.FULL + 1
    I.add_new(spark, make(("v", "new", "3/1", "2001-01-01", "S"), ("w", "same", "7/1", "2001-01-01", "S")), at, 8)
    ids = {r.doc_id for r in I.current(I.stored(spark, at)).collect()}
    assert "new" in ids and "same" not in ids


def test_kb_store(spark, tmp_path):
    at = str(tmp_path / "kb")
    kb = spark.createDataFrame([(f"c{i}", "dieu" if i % 2 else "enforcement", [float(i)]) for i in range(8)], "chunk_ref string, section_type string, embedding array<float>")
    with pytest.raises(FileNotFoundError):
        S.read_kb(spark, at)
    S.write_kb(kb, at)
    S.write_kb(kb.where("chunk_ref < 'c3'"), at)
    for _ in range(2):
        S.write_kb(kb.where("chunk_ref = 'c7'"), at, "more")
    assert sorted(r.chunk_ref for r in S.read_kb(spark, at).collect()) == ["c0", "c1", "c2", "c7"]
    some = S.read_kb(spark, at, section_type="dieu")
    assert sorted((r.chunk_ref, r.embedding[0]) for r in some.collect()) == [("c1", 1.0), ("c7", 7.0)]
    assert "PartitionFilters: [isnotnull(section_type" in some._jdf.queryExecution().toString()


def test_database(spark, tmp_path):
    """Rows of legal_raw through an embedded database: written in batches, upserted over a staging table, read in ranges."""
    from lexarium.sources.fixtures import view

    url, more = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    docs = view(spark, "/root/testdata/sf0.001", "legal_raw").select(F.expr("cast(substring(doc_id, 4) as int)").alias("ID"), F.col("doc_number").alias("DOC_NUMBER"), F.col("signer").alias("SIGNER"))
    S.write_table(docs, url, "DOCS", "overwrite", batchsize="500", **more)
    read = lambda: S.read_table(spark, url, "DOCS", "ID", S.bounds(spark, url, "DOCS", "ID", **more), 4, **more)
    assert read().rdd.getNumPartitions() == 4 and sorted(map(str, read().collect())) == sorted(map(str, docs.collect()))
    changed = docs.where("ID % 10 = 0").withColumn("SIGNER", F.lit("new")).unionByName(spark.createDataFrame([(-5, None, "x")], docs.schema))
    for _ in range(2):
        S.upsert_table(changed, url, "DOCS", "ID", **more)
    want = {r.ID: r.SIGNER for r in docs.collect()} | {r.ID: r.SIGNER for r in changed.collect()}
    rows = read().collect()
    assert {r.ID: r.SIGNER for r in rows} == want and len(rows) == len(want)
    with pytest.raises(ValueError):
        S.bounds(spark, url, "DOCS", "SIGNER; drop table DOCS", **more)


def test_site_selectors():
    """The first selector that hits counts, whatever the page's form; odd pages have a row of their own."""
    from lexarium.sources.site import read_page, tree

    rules = {
        "title": [{"tag": "h2"}, {"tag": "div", "class": "t"}], "doc_number": [{"tag": "p", "id": "nr"}, {"text_before": "SỐ"}], "status": [{"tag": "span", "class": "a"}],
        "issued_date": [{"text_before": "ngày"}], "content": [{"tag": "div", "class": "none"}, {"tag": "div", "id": "empty"}, {"tag": "div", "id": "c"}],
    }
    html = "<div class='x t'> Tên <b>văn</b> bản </div><table><tr><td>Số<td>Ngày<td>5/2019<tr><th>số</th><td>7</table><p id=nr> a <i>b</i><script>z</script></p><div id=empty> </div><div id=c>x<style>y</style><br>z<p>một<p>hai</div>"
    row = read_page(html, "https://e.org/a/b%20c.html?x=1", rules)
    assert (row["title"], row["doc_number"], row["status"], row["issued_date"], row["content"], row["sections"], row["year_published"]) == ("Tênvănbản", "a\nb", None, "5/2019", "x\nz\nmột\nhai", ["một", "hai"], 2019)
    assert row["doc_id"] == "b_20c_x_1"
    for odd in ("", "<", "plain", "</div></p>", "<p" * 3000, "<div>" * 3000 + "x", "<td>" * 50):
        row = read_page(odd, "u/", rules)
        assert row["title"] == "Không có tiêu đề" and row["content"] == "" and row["year_published"] is None
    assert len(list(tree("<div>" * 3000).elements())) == 3000


def test_redecode(spark):
    """The same as Python's codec; texts without U+FFFD stay."""
    import random

    from lexarium.functions.cleaning import redecode, strip_invisible

    rng = random.Random(4)
    letters = ["a", "é", "ậ", "\ufffd", "😀", "Ã", "©", "\x80", "\x9f", "á", "»", "\x81", "\\u", "\n", "ÿ", "đ"]
    texts = [None, "", "ậ é", "\ufffd", *("".join(rng.choices(letters, k=rng.randint(1, 30))) for _ in range(300))]
    got = {r.s: r.x for r in spark.createDataFrame([(t,) for t in texts], "s string").select("s", redecode(F.col("s")).alias("x")).collect()}
    for t in texts:
        assert got[t] == (t.encode("raw_unicode_escape").decode("utf-8", "replace") if t and "\ufffd" in t else t), t
    assert spark.sql("select ' \ufffd Ä\x90\ufeff ' as s").select(strip_invisible(F.col("s"), True).alias("x")).first().x == "\\ufffd Đ\\ufeff"


def test_only_whole_objects_are_responses(spark):
    from lexarium.operators.contracts import parse_responses

    good = '{"severity":"ok","issue":"a } b"}'
    texts = {1: good, 2: f"```json\n{good}\n```", 3: f"text {good} more", 4: f"{good} tail }}", 5: f"{good},{good}", 6: f"{good}], [{good}", 7: f'{good}, "y": {good}', 8: "{", 9: None, 10: "{}", 11: '{"issue": "only", "deep": {"a": [1]}}', 12: good[:-1]}
    rows = spark.createDataFrame([("c", i, t) for i, t in texts.items()], "contract_id string, pos int, response string")
    assert sorted((r.pos, r.issue) for r in parse_responses(rows).collect()) == [(1, "a } b"), (2, "a } b"), (3, "a } b"), (11, "only")]
