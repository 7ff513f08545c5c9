"""Pages are read once, by as many tasks as they need."""

from pyspark.sql import functions as F

from lexarium.functions import cleaning as L
from lexarium.functions import terms as W
from lexarium.streaming import ingest as I

HTML = '<html><head><title>Nghị định {n}</title></head><body><table><tr><td>Số hiệu:</td><td>{n}/2020/NĐ-CP</td></tr><tr><td>Ngày ban hành:</td><td>01/02/2020</td></tr><tr><td>Người ký:</td><td>A</td></tr></table><div id="toanvancontent"><p>Điều 1. Phạm vi</p><p>{text}</p></div></body></html>'


def _pages(spark, n=30):
    rows = [(f"https://e.org/Nghi-dinh-{i}.aspx", HTML.format(n=i % 20, text="Nội dung. " * 30)) for i in range(n)]
    return spark.createDataFrame(rows, "url string, html string")


def test_outcomes_read_pages_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    pages = _pages(spark).mapInArrow(seen, "url string, html string")
    found = {r.outcome: r.n for r in I.outcomes_of(pages).groupBy("outcome").agg(F.count("*").alias("n")).collect()}
    assert found == {"ingested": 20, "duplicate": 10}
    assert read.value == 30


def test_documents_are_dealt_by_the_pages(spark, monkeypatch):
    monkeypatch.setattr(I, "tasks_for", lambda df, text: 37)
    assert I.documents_of(_pages(spark)).rdd.getNumPartitions() == 37


def test_what_is_certain_in_a_pattern(spark):
    """Counts are those of the patterns alone."""
    texts = ["Điều  7", "xĐiều 7", "Mục 1 Chương IV", "Chương", "* Lưu trữ", "* In ấn", "* Inđ", "Ghi chú", "** *Ghi chú*", "Pháp Luật Thuế", "Pháp Luật", "Bản án liên quan BannerTuyenDung", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(len(L.certain(p)) >= 3 for p in W.LEGAL + W.FURNITURE)
    plain = lambda ps: sum((F.col("t").rlike(L.UNI + p).cast("int") for p in ps), F.lit(0))
    for ps in (W.LEGAL, W.FURNITURE):
        assert all(r[0] == r[1] for r in df.select(L.hits(F.col("t"), ps), plain(ps)).collect())


def test_titles_are_only_made_of_what_is_taken(spark):
    """What says whether a document is new doesn't make its title, kind or category; labelled cells come with the page."""
    from lexarium.sources import html as P

    df = spark.createDataFrame([("Nghị định 1/2020",)], "title string")
    known = I.documents_of(_pages(spark), 4)
    made = {"doc_id", "url", "h1", "title", "content", "doc_number", "issued_date", "signer"}
    assert made <= set(known.columns) and "initcap(" not in known._jdf.queryExecution().analyzed().toString()  # as titles from the url are made
    assert "initcap(" in I.finished(known)._jdf.queryExecution().analyzed().toString() and "h1" not in I.finished(known).columns
    assert [(r.title, r.doc_type) for r in I.finished(known).where("doc_id = 'Nghi-dinh-3'").collect()] == [("Nghị định 3", "Nghị định")]
    assert I.finished(df).columns == ["title"]
    cells = [{"text": t, "bold": b} for t, b in (("Số hiệu: x", ""), ("", "Người ký:"), ("A", ""), ("Số hiệu:", ""), ("2", ""), ("Lĩnh vực:", ""))]
    assert [P.cell_after(cells, x) for x in ("Số hiệu:", "Người ký:", "Lĩnh vực:", "Nơi ban hành:")] == ["", "A", None, None]
