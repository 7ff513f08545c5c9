"""Rare wordings that the derived views don't hold."""

import pytest
from pyspark.sql import functions as F

from lexarium.functions import cleaning as L
from lexarium.operators import amendments as A
from lexarium.operators import dates as D
from lexarium.operators import fields as H
from lexarium.operators import relations as E
from lexarium.operators import retrieval as R
from lexarium.operators import structure as G


def _one(spark, value, make):
    return spark.createDataFrame([(value,)], "s string").select(make(F.col("s")).alias("x")).first()[0]


def _docs(spark, text, **more):
    return spark.createDataFrame([("a", text, *more.values())], "doc_id string, content string" + "".join(f", {k} string" for k in more))


@pytest.mark.parametrize(
    "make, value, want",
    [
        (lambda s: L.fix_doc_number(s, F.lit(None).cast("string"), F.lit(None).cast("string")), " 45 / 2019//QH--14 ", "45/2019/QH-14"),
        (lambda s: L.fix_doc_number(F.lit(None).cast("string"), s, F.lit(None).cast("string")), "SỐ: 45/2019/QH14", "45/2019/QH14"),
        (lambda s: L.fix_doc_number(F.lit(None).cast("string"), F.lit(None).cast("string"), s), "/Nghi-dinh-168-2024-ND-CP-1.aspx", "168/2024/ND-CP"),
        (lambda s: L.fix_doc_type(F.lit(None).cast("string"), F.lit(None).cast("string"), s), "/Bo-luat-Lao-dong-2019-333670.aspx", "Bộ luật"),
        (L.clean_footer, "Điều 1\n  * Email x\nnhiều", "Điều 1"),
        (L.clean_footer, "Điều 1\nDecree No. 5", "Điều 1"),
        (L.detect_category, "Luật An  ninh mạng", "Quốc phòng - An ninh"),
        (L.detect_category, "x", "Khác"),
        (L.strip_invisible, "\ufeff a\x00b\tc\xa0", "ab\tc"),
        (L.has_garbage, "a * Email b", True),
        (lambda s: L.is_translation(s, F.lit(None).cast("string")), "This act takes effect " * 20, True),
        (lambda s: L.is_translation(s, F.lit(None).cast("string")), "Nghị định này có hiệu lực " * 20, False),
        (lambda s: L.is_translation(F.lit("x"), s), "<p>Ngôn ngữ : Tiếng Anh</p>", True),
        (lambda s: F.array_join(L.query_keywords(s), "|"), "nghị định 168/2024/NĐ về thuế năm 2020", "168/2024/nđ|Nghị|Định|168|2024|Thuế|2020"),
        (D.header_section, "x Số hiệu: 1\n căn  cứ QUYẾT ĐỊNH: Điều 1", ": 1 căn cứ"),
        (D.expiry_in, "1. Nghị định này hết hiệu lực vào ngày 5 tháng 6 năm 2030.", "2030-06-05"),
        (D.expiry_in, "1. Các quyết định sau đây hết hiệu lực kể từ ngày 1/1/2020\n2. Áp dụng đến hết ngày 03/04/2031", "2031-04-03"),
        (D.expiry_in, "1. Nghị định số 5/2010/NĐ-CP hết hiệu lực kể từ ngày 1/1/2020", None),
        (lambda s: D.validate_expiry(s, F.lit("2021-01-01")), "2020-01-01", None),
        (H.contract_type, "HỢP ĐỒNG MUA BÁN (bản 2)", "Hợp đồng MUA BÁN"),
        (lambda s: H.line_around(s, r"bất\s+khả\s+kháng", 1), "a\nBất khả  kháng: bão\nĐiều 5. b", "Bất khả kháng: bão"),
        (A.roman, "XIV", "14"),
    ],
)
def test_columns(spark, make, value, want):
    assert _one(spark, value, make) == want


def test_nulls_are_defined(spark):
    checks = (L.clean_footer, L.strip_invisible, D.header_section, D.expiry_in, D.effective_article, H.contract_type)
    assert all(_one(spark, None, f) is None for f in checks)
    assert _one(spark, None, L.query_keywords) == []
    assert _one(spark, None, L.validate_content) is False and _one(spark, None, L.is_placeholder) is True


def test_split_text():
    assert G.split_text("") == [] and G.split_text("ab", 5, 0) == ["ab"]
    text = "một hai. " * 50
    assert "".join(G.split_text("x" * 25, 10, 0)) == "x" * 25
    pieces = G.split_text(text, 40, 5)
    assert all(b.startswith(a[-5:]) for a, b in zip(G.split_text(text, 40, 0), pieces[1:]))


def test_chunks(spark):
    df = spark.createDataFrame([("a", "Mở đầu\nĐiều 1. Lương\nKhoản 2) Thưởng"), ("b", "không có"), ("c", ""), ("d", None)], "contract_id string, text string")
    got = [(r.contract_id, r.clause_number, r.chunk_index, r.text) for r in G.chunk_by_clause(df).orderBy("contract_id", "chunk_index").collect()]
    assert got == [("a", "Preamble", 1, "Mở đầu"), ("a", "1", 2, "Điều 1. Lương"), ("a", "2", 3, "Khoản 2) Thưởng"), ("b", "1", 1, "không có")]
    cut = [(r.contract_id, r.clause_number, r.text) for r in G.clause_dicts(df).orderBy("contract_id", "pos").collect()]
    assert cut[:2] == [("a", "0", "Mở đầu"), ("a", "1", "\nĐiều 1. Lương\nKhoản 2) Thưởng")] and cut[2] == ("b", "0", "không có")


def test_tree_marks_and_rolls_up(spark):
    text = "THÔNG TƯ\nChương I\nĐiều 1. A\n1. x\na) y\nthêm\nĐiều 2. Hiệu lực thi hành\nPhụ lục 1\n2. z\nNơi nhận:\n- lưu"
    tree = G.section_tree(_docs(spark, text))
    rows = {r.node_id: r for r in tree.collect()}
    assert [(n, rows[n].section_type, rows[n].parent_id) for n in sorted(rows)] == [
        (1, "title_section", None), (2, "chuong", 1), (3, "dieu", 2), (4, "khoan", 3), (5, "diem", 4), (6, "dieu", 2), (7, "phu_luc", None), (8, "khoan", 7), (9, "signing", None),
    ]
    assert rows[5].content == "a) y\nthêm" and rows[9].content == "Nơi nhận:\n- lưu"
    marked = {r.node_id: r.section_type for r in G.mark_enforcement(tree).collect()}
    assert marked[6] == "enforcement" and marked[3] == "dieu"
    rolled = {r.node_id: r.content for r in G.rollup_content(tree).collect()}
    assert rolled[3] == "Điều 1. A\n1. x\na) y\nthêm"


def test_relations(spark):
    text = "Bãi bỏ khoản 2 Điều 3 của Nghị định số 5/2010/NĐ-CP. Sửa đổi, bổ sung Nghị định số 5/2010/NĐ-CP.\nThay thế:\n- Thông tư số 7/2011/TT-BTC của Bộ Tài chính; bãi bỏ 1/A"
    got = {(r.doc_number, r.relation_type, r.provision, r.issuing_authority_hint) for r in E.extract_relations(_docs(spark, text)).collect()}
    assert got == {("5/2010/NĐ-CP", "amends_partial", "khoản 2 Điều 3", None), ("7/2011/TT-BTC", "replaces", "", "Bộ Tài chính")}
    assert [(r.doc_number, r.relation_type) for r in E.expiry_relations(_docs(spark, "Các quy định trước đây hết hiệu lực.")).collect()] == [("0", "abolishes")]
    got = {r.doc_number for r in E.expiry_relations(_docs(spark, "Sau đây hết hiệu lực:\na) Quyết định số [9/2009/QĐ-BTC](u)")).collect()}
    assert got == {"9/2009/QĐ-BTC"}


def _edges(text):
    return sorted((e.doc_number, e.relation_type, e.old_issued_date) for e in E.relations_in(text))


def test_relation_lists():
    """Each bullet under a head has the head's type and its own day; what isn't in the list has nothing of it."""
    assert _edges("Nghị định này thay thế:\n- Nghị định số 1/2001/NĐ-CP ngày 2/3/2001;\n- Quyết định số 22/2002/QĐ-TTg ngày 4 tháng 5 năm 2002.") == [
        ("1/2001/NĐ-CP", "replaces", "2001-03-02"), ("22/2002/QĐ-TTg", "replaces", "2002-05-04")]
    assert _edges("Các văn bản sau hết hiệu lực:\n• Nghị định số 1/2001/NĐ-CP ngày 2-3-2001 thay thế Luật cũ") == [("1/2001/NĐ-CP", "abolishes", "2001-03-02")]
    text = "1. Luật số 45/2019/QH14 được áp dụng.\n2. Bãi bỏ:\n– Quyết định số 9/2001/QĐ-BTC\n\n- Quyết định số 8/2001/QĐ-BTC ngày 32/1/2001\n3. Khác\n- Luật số 46/2019/QH14 ngày 1/1/2019"
    assert _edges(text) == [("8/2001/QĐ-BTC", "abolishes", None), ("9/2001/QĐ-BTC", "abolishes", None)]
    assert _edges("Sửa đổi khoản 1 Điều 2 Nghị định 5/2010/NĐ-CP. Bãi bỏ Nghị định 5/2010/NĐ-CP.") == [("5/2010/NĐ-CP", "abolishes", None), ("5/2010/NĐ-CP", "amends_partial", None)]
    assert _edges("Bãi bỏ Nghị định 5/2010/NĐ-CP.\nBãi bỏ Nghị định 5/2010/nđ-cp.") == [("5/2010/NĐ-CP", "abolishes", None)]
    assert _edges("Bãi bỏ:\n- Thay thế:\n- Nghị định số 7/2001/NĐ-CP") == [("7/2001/NĐ-CP", "replaces", None)]


def test_relation_hints():
    """Authority and title come from the act's own sentence; another act is no authority."""
    text = "Thay thế Nghị định số 5/2010/NĐ-CP ngày 3 tháng 4 năm 2010 của Chính phủ quy định chi tiết thi hành Luật Thuế số 3. Các bộ của Quốc hội về mọi việc khác."
    (e,) = E.relations_in(text)
    assert (e.issuing_authority_hint, e.old_issued_date, e.title_hint) == ("Chính phủ", "2010-04-03", "chi tiết thi hành Luật Thuế số 3")
    (e,) = E.relations_in("Bãi bỏ Thông tư 5/2010/TT-BTC của Bộ Tài chính, của Luật cũ về thuế suất mới")
    assert (e.issuing_authority_hint, e.title_hint) == ("Bộ Tài chính", None)
    (e,) = E.relations_in("Bãi bỏ Thông tư 5/2010/TT-BTC. Theo đề nghị của Bộ trưởng về các việc khác nhau.")
    assert (e.issuing_authority_hint, e.title_hint) == (None, None)


def test_amendments(spark):
    text = 'Sửa đổi, bổ sung một số điều của Luật số 10/2012/QH13\n1. Sửa đổi, bổ sung điểm b khoản 2a Điều 9\nmới\n2. Thay thế cụm từ "cũ" bằng cụm từ "mới" tại khoản 3 Điều 4\n3. Bãi bỏ Phụ lục IV'
    got = [(r.action, r.article, r.clause, r.point, r.special, r.old, r.new, r.content, r.target_doc_number) for r in A.extract_amendments(_docs(spark, text)).orderBy("line_start").collect()]
    target = "10/2012/QH13"
    assert got == [
        ("amended", "9", "2a", "b", None, None, None, "mới", target), ("replaced_phrase", "4", "3", None, None, "cũ", "mới", "", target), ("abolished", None, None, None, "PLIV", None, None, "", target),
    ]


def test_topics_and_embed(spark):
    import numpy as np

    df = spark.createDataFrame([("a", "Đóng THUẾ và bảo hiểm"), ("b", None)], "contract_id string, text string")
    assert [r.topic for r in R.detect_topics(df).collect()] == ["insurance", "tax"]
    assert [(r.topic, r.keyword) for r in R.clause_topic(df).orderBy("contract_id").collect()] == [("insurance", "bảo hiểm"), ("general", "")]
    v = R.embed(df, lambda: lambda texts: np.array([[len(t), 0.0] for t in texts])).orderBy("contract_id").collect()
    assert [list(r.embedding) for r in v] == [[1.0, 0.0], [0.0, 0.0]]


def test_stream_adds_each_page_once(spark, tmp_path):
    from lexarium.streaming.ingest import ingest_stream, stored

    def page(k):
        return (f"https://example.org/van-ban/van-ban-{k}.aspx", f"<title>Nghị định số {k}</title><td>Số hiệu:<td>{k}/2020/NĐ-CP<tr><div id=fulltext><p>Điều 1. Phạm vi</p>" + "Nội dung quy định. " * 20)

    def add(*ks):
        spark.createDataFrame([page(k) for k in ks], "url string, html string").write.mode("append").parquet(f"{tmp_path}/in")
        ingest_stream(spark, f"{tmp_path}/in", f"{tmp_path}/table", f"{tmp_path}/ckpt").awaitTermination()
        return sorted(r.doc_number for r in stored(spark, f"{tmp_path}/table").collect())

    assert add(1, 2) == ["1/2020/NĐ-CP", "2/2020/NĐ-CP"]
    assert add(2, 3) == ["1/2020/NĐ-CP", "2/2020/NĐ-CP", "3/2020/NĐ-CP"]


def test_context_holds_whole_chunks(spark):
    """i10_format_context: every chunk stands in its document's context in whole (3000 characters at most)."""
    import __spark_entry__
    from lexarium.sources.fixtures import view

    at = "/root/testdata/sf0.001"
    context = dict(__spark_entry__.queries()["i10_format_context"](spark, at).collect())
    chunks = [r for r in view(spark, at, "kb_chunks").where("trim(chunk_text) <> ''").select("doc_id", "chunk_text").collect() if r.doc_id in context]
    assert max(len(r.chunk_text) for r in chunks) > 40 and all(r.chunk_text[:3000] in context[r.doc_id] for r in chunks)


def test_changed_pages_replace_their_documents(spark, tmp_path):
    from lexarium.streaming import ingest as I

    text = "Điều 1. Phạm vi điều chỉnh của nghị định này. " * 10
    page = lambda n, more="": (f"https://e.org/van-ban/Nghi-dinh-{n}.aspx", f'<title>Nghị định {n}</title><div id="toanvancontent"><p>{text}{more}</p></div>')
    make = lambda *rows: spark.createDataFrame(list(rows), "url string, html string")
    at = str(tmp_path / "table")
    I.add_new(spark, make(page(1), page(2)), at, 0)
    I.add_new(spark, make(page(1), page(2, "Sửa đổi"), page(3)), at, 1)
    I.add_new(spark, make(page(1), page(2, "Sửa đổi"), page(3)), at, 1)  # runs again
    I.add_new(spark, make(page(3)), at, 2)
    rows = I.stored(spark, at)
    assert rows.count() == 4
    now = {r.doc_id: r.content for r in I.current(rows).collect()}
    assert len(now) == 3 and now["Nghi-dinh-2"].endswith("Sửa đổi") and not now["Nghi-dinh-1"].endswith("Sửa đổi")


def test_amendments_of_every_kind(spark):
    text = "\n".join([
        "Luật sửa đổi, bổ sung một số điều của Luật số 5/2010/QH12", "1. Bãi bỏ khoản 1 Điều 2; bãi bỏ khoản 3 Điều 4", "2. Sửa đổi, bổ sung khoản 1, khoản 2 và khoản 3a Điều 5", "mới",
        "3. Sửa đổi, bổ sung một số khoản của Điều 9", "a) Sửa đổi, bổ sung khoản 1", "nội dung một", "b) Sửa đổi, bổ sung khoản 2", "nội dung hai",
        "4. Sửa đổi, bổ sung một số số thứ tự của Phụ lục IV", "a) Bổ sung số thứ tự 12 vào sau số thứ tự 11", "b) Bãi bỏ ngành, nghề tại số thứ tự 7",
        "5. Sửa đổi, bổ sung Điều 7", "6. Sửa đổi, bổ sung Điều 7", "7. Nghị định số 3/2001/NĐ-CP hết hiệu lực, trừ Điều 4 và Điều 6. Hết",
    ])
    rows = A.extract_amendments(_docs(spark, text)).collect()
    got = sorted((r.line_start, r.action, r.article or "", r.clause or "", r.special or "", r.content) for r in rows if r.action != "abolished_partial")
    assert got == [
        (1, "abolished", "2", "1", "", ""), (1, "abolished", "4", "3", "", ""), (2, "amended", "5", "1", "", "mới"), (2, "amended", "5", "2", "", "mới"), (2, "amended", "5", "3a", "", "mới"),
        (4, "amended", "9", "1", "", "nội dung một"), (4, "amended", "9", "2", "", "nội dung hai"), (9, "abolished", "", "", "PLIV.7", ""), (9, "supplemented", "", "", "PLIV.12", ""), (12, "amended", "7", "", "", ""),
    ]
    assert sorted((r.target_doc_number, r.article) for r in rows if r.action == "abolished_partial") == [("3/2001/NĐ-CP", "4"), ("3/2001/NĐ-CP", "6")]


@pytest.mark.parametrize(
    "text, issued, want",
    [
        ("có hiệu lực từ ngày 01/07/2026", None, "2026-07-01"), ("x\n\ncó hiệu lực kể từ ngày ký", "15/03/2020", "2020-03-15"), ("thông qua ngày 28 tháng 11 năm 2013", None, "2013-11-28"),
        ("Điều 3. Hiệu lực thi hành\ncó hiệu lực kể từ ngày 2-3-2024", None, "2024-03-02"), ("có hiệu lực từ ngày ban hành", "2019-05-06", "2019-05-06"), ("có hiệu lực kể từ ngày ký", "2019", None),
        ("có hiệu lực kể từ ngày Luật số 20/2026/QH15 có hiệu lực, 1/1/2020", None, None), ("sau 45 ngày kể từ ngày ký", "2020-01-01", "2020-02-15"), ("không", "2020-01-01", None),
    ],
)
def test_entry_into_force(spark, text, issued, want):
    docs = spark.createDataFrame([("a", text, issued)], "doc_id string, content string, issued_date string")
    assert D.effective_date(docs).first().effective_date == want


def test_long_paragraphs_are_narrowed(spark):
    long = "\n".join(["mở đầu " * 400, "Điều 1 Phạm vi", "chung", "Điều 2 Khác", "bắt đầu thi hành khi đủ điều kiện", "Điều 3 Cuối", "hết"])
    row = D.effective_section(_docs(spark, long)).first()
    assert row.article_text is None and row.section_text == "chung\nĐiều 2 Khác\nbắt đầu thi hành khi đủ điều kiện\nĐiều 3 Cuối"


def test_statuses(spark):
    from lexarium.operators import corpus as C

    docs = spark.createDataFrame([("a", "2005-01-01", None), ("b", "2030-01-01", None), ("c", None, None), ("d", "2001-01-01", None), ("e", "2001-01-01", "2004-01-01"), ("f", "2001-01-01", None), ("g", "2030-01-01", None), ("h", "2001-01-01", None)], "doc_id string, effective_date string, expiry_date string")
    edges = spark.createDataFrame([("a", "d", "replaces"), ("a", "a", "replaces"), ("a", "f", "amends_partial"), ("b", "a", "abolishes"), ("a", "h", "amends")], "src_doc_id string, dst_doc_id string, relation_type string")
    parts = spark.createDataFrame([("g", "2004-01-01"), ("h", "2030-01-01")], "doc_id string, effective_date string")
    got = {r.doc_id: r.status_flag for r in C.status_flag(docs, edges, "2006-01-01", parts).collect()}
    assert got == {"a": 1, "b": 3, "c": 0, "d": 2, "e": 2, "f": 4, "g": 5, "h": 5}


def test_hints_break_ties(spark):
    from lexarium.operators import corpus as C

    docs = spark.createDataFrame([("1", "5/2001/NĐ-CP", "Bộ A", "2001-01-01"), ("2", "5/2001/ND-CP", "Bộ B", "2001-01-01"), ("3", "5/2001/NĐ-CP", "Bộ B", "2002-01-01"), ("4", None, "Bộ B", None)], "doc_id string, doc_number string, issuing_authority string, issued_date string")
    cases = [("x", None, None, "1"), ("y", "bộ B", None, "2"), ("z", None, "2002-01-01", "3"), ("u", "Bộ B", "2002-01-01", "3"), ("v", "Bộ C", "1999-01-01", "1")]
    edges = spark.createDataFrame([(i, "5/2001/NĐ-CP", "replaces", a, d) for i, a, d, _ in cases], "doc_id string, doc_number string, relation_type string, issuing_authority_hint string, old_issued_date string")
    got = {r.src_doc_id: r.dst_doc_id for r in C.resolve_relations(edges, docs).collect()}
    assert got == {i: w for i, _, _, w in cases}


def test_parties_and_turns(spark):
    from lexarium.operators import contracts as K

    text = "BÊN A: (Chủ)\nCÔNG TY:\tABC \nĐịa chỉ: 1 phố X | p\nĐại diện: Ông Y\nBÊN B\nHọ tên: Nguyễn Z\tNam\nCMND: 123456789\n" + "x" * 300 + "\nĐịa chỉ: Ngõ 2\tĐiện thoại"
    rows = {r.name: (r.role, r.address, r.tax_id, r.representative) for r in K.contract_parties(spark.createDataFrame([("a", text), ("b", "không"), ("c", None)], "contract_id string, text string")).collect()}
    assert rows["ABC"] == ("Chủ", "1 phố X", None, "Ông Y")
    assert rows["Nguyễn Z"][1:] == ("Ngõ 2", "123456789", None) and len(rows) == 2
    turns = [("c", i, r, t) for i, (r, t) in enumerate([("user", "q0"), ("assistant", "a0"), ("user", "q1"), ("system", "s"), ("user", "q2"), ("assistant", "a2"), ("assistant", "a2b"), ("user", "q3")])]
    got = {r.conv_id: r.history for r in K.last_turns(spark.createDataFrame(turns, "conv_id string, turn int, role string, text string"), 3).collect()}
    assert got == {"c": "User: q1\nAssistant: \nUser: q2\nAssistant: a2\nUser: q3\nAssistant: "}


def test_search_in_blocks(spark, monkeypatch):
    """Small blocks, ties and null vectors: the same as all pairs."""
    import numpy as np

    from lexarium.operators import search as K

    monkeypatch.setattr(K, "QUERY_BLOCK", 3)
    monkeypatch.setattr(K, "VECTOR_BLOCK", 7)
    rng = np.random.default_rng(1)
    vectors = [(i, int(i % 3), [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(50)] + [(99, 0, None)]
    df = spark.createDataFrame(vectors, "vec_id long, label int, embedding array<double>")
    q = df.where("vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id")
    for got, same in ((K.knn(q.drop("label"), df, 4, -9.0), False), (K.knn_filtered(q, df, "label", 4, -9.0), True)):
        want = set()
        for i, g, a in vectors:
            if i % 5 == 0 and a is not None:
                order = sorted((-sum(x * y for x, y in zip(a, b)), j) for j, h, b in vectors if b is not None and (h == g or not same))
                want |= {(i, j, n + 1, -s) for n, (s, j) in enumerate(order[:4])}
        assert {(r.query_id, r.vec_id, r["rank"], r.score) for r in got.collect()} == want
    assert K.knn(q.drop("label").limit(0), df).count() == 0 and K.knn(q.drop("label"), df.limit(0)).count() == 0


@pytest.mark.parametrize("least, spread", [(-9.0, 1.0), (0.6, 0.05), (0.9, 0.3)])
def test_search_in_clusters(spark, monkeypatch, least, spread):
    """With a few vectors a cluster: the same as all pairs, with string ids, ties, odd lengths, zeros and nulls; near vectors prune."""
    import numpy as np

    from lexarium.operators import search as K

    monkeypatch.setattr(K, "CLUSTER", 20)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    rows = [(f"v{i:03}", (centres[i % 6] + spread * rng.normal(size=8)).round(3).tolist()) for i in range(300)]
    rows = [(i, (np.array(v) / np.linalg.norm(v) * (1 + (n % 3 == 0))).tolist()) for n, (i, v) in enumerate(rows)] + [("w1", rows[0][1]), ("w2", rows[0][1])]
    odd = [("x1", [1.0, 0.0]), ("x2", None), ("x3", [0.0] * 8), ("x4", [float("nan")] * 8), ("x5", []), ("x6", [None, 1.0])]
    df = spark.createDataFrame(rows + odd, "vec_id string, embedding array<double>")
    q = df.where("vec_id like '%7' or vec_id like 'x%' or vec_id = 'w1'").withColumnRenamed("vec_id", "query_id")
    asked = [r.query_id for r in q.collect()]
    vectors, want = {i: np.array(v, float) for i, v in rows + odd if v is not None}, set()
    for i in (i for i in asked if i in vectors):
        scored = sorted((-round(float(vectors[i] @ v), 6), j) for j, v in vectors.items() if len(v) == len(vectors[i]) and not np.isnan(vectors[i] @ v))
        want |= {(i, j, n, round(-s, 5)) for n, (s, j) in enumerate(scored[:4], 1) if -s >= least}
    got = {(r.query_id, r.vec_id, r["rank"], round(r.score, 5)) for r in K.knn(q, df, 4, least).collect()}
    assert got == want and len(K.pivots_of(df, 15)) == 15
    if spread < 0.1:
        seen = K.pruning(q, df, 4, least).first()
        assert seen.needed < 0.6 * seen.queries * (seen.clusters - 1)


NAMES = "BÊN A: (Người sử dụng lao động)\nCông ty: Ắ Ệ\nMã số thuế: 123\nĐại diện: Ông Ỷ\nBÊN B: (Người lao động)\nHọ và tên: Nguyễn Thị Ổ\nCMND: 123456789\nĐiều 1. Lương\nLương cơ bản: 5 đồng\nĐiều 2. Bảo mật\nBảo mật mọi thông tin\n"


def test_composed_letters(spark):
    """Decomposed contracts give what composed ones do, by every operator on contracts."""
    import random
    import unicodedata

    from lexarium.functions.text import nfc
    from lexarium.operators import contracts as K

    rng = random.Random(1)
    text = NAMES + "Điều 3. Chấm dứt\nĐơn phương chấm dứt hợp đồng lao động thì báo trước.\n"
    mixed = "".join(unicodedata.normalize("NFD", c) if rng.random() < 0.5 else c for c in text)
    rows = spark.createDataFrame(list({"a": text, "b": unicodedata.normalize("NFD", text), "c": mixed}.items()), "contract_id string, text string").cache()
    for operator in (H.contract_dates, H.finance, H.clause_fields, H.parse_contracts, K.contract_parties, K.extract_clauses, G.clause_dicts, G.chunk_by_clause):
        got = [r.asDict() for r in operator(rows).collect()]
        of = {i: sorted(str(r | {"contract_id": ""}) for r in got if r["contract_id"] == i) for i in "abc"}
        assert of["a"] and of["a"] == of["b"] == of["c"]
    odd = [None, "", "a", "e\u0302\u0323 e\u0323\u0302 x\u0301 \u0301 a\u0306\u0301\u0488 Ấ ", mixed * 50]
    got = [r.x for r in spark.createDataFrame([(t,) for t in odd], "s string").select(nfc(F.col("s")).alias("x")).collect()]
    assert sorted(map(str, got)) == sorted(str(t and unicodedata.normalize("NFC", t)) for t in odd)


def test_content_checks_of_null_texts_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    from lexarium.plans import mining

    spark.createDataFrame([(1, None), (2, ""), (3, "Điều 1. " * 40), (4, " \n")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = mining.QUERIES["b6_content_checks"](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = c.sql(mining.ORACLES["b6_content_checks"])
    assert sorted(tuple(r[k] for k in want.columns) for r in got.collect()) == sorted(want.fetchall())


def test_content_checks_of_odd_letters_are_those_of_the_sql(spark, tmp_path):
    """Limits of words, white space and digits are those of ASCII in the SQL, which takes nothing out of a text."""
    import duckdb

    from lexarium.plans import mining

    some = "Ein,*** einver$$$ und&&& geß " * 8
    odd = [some + x for x in ("*** Inédit", "*** Insel", "*** In", "* Lưu trữ", "* Emailé", "* In xĐiều 9", "* In Điều\xa09", "* In Điều ١", "* In Khoản\x0b2", "\x1f", "​\x07", "�", "cheCKİNG your browser", "Đang tải")]
    odd += ["\xa0", "\x0c", "a​", ("Bản dịch này thuộc quyền sở hữu " + "word " * 9) * 5, "\x85" + "a " * 49 + "\xa0", "a" * 199 + "\x1c"]
    spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = mining.QUERIES["b6_content_checks"](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = c.sql(mining.ORACLES["b6_content_checks"])
    assert sorted(tuple(r[k] for k in want.columns) for r in got.collect()) == sorted(want.fetchall())


def test_keywords_of_a_whole_text(spark):
    """References, acronyms and years behind 5000 characters count."""
    text = "Điều 1 và điều khác. " + "nội dung " * 700 + "Khoản 2 Điều 47 của UBND từ năm 2031. " + "Điều 1, " * 3000 + "QĐ-TTG"
    assert len(text) > 30_000
    df = spark.createDataFrame([("Luật lao động", text, None)], "title string, content string, number string")
    assert df.select(L.keywords(*map(F.col, ("title", "content", "number")))).first()[0] == ["Luật", "Lao", "Động", "Điều 1", "Khoản 2", "Điều 47", "UBND", "QĐ-TTG", "2031"]


def test_amended_by_reads_only_texts_that_name_an_act(spark):
    """Articles without the tree, and amendments with a target, are those of the whole tree and of all amendments."""
    import random

    from pyspark.sql import functions as F

    from lexarium.functions.cleaning import UNI
    from lexarium.operators import amendments as A

    rng = random.Random(3)
    said = ["Điều 1. A", "  điều 2", "**Điều 3**. B", "** Điều 4", "\\- Điều 5", "|Điều 6", "Đi**ều 7", "ĐIỀU\xa08", "Điều x", "Chương I", "1. Điều 9", "Số: 5/2008/NĐ-CP", "Thay thế Nghị định số 7/2008/NĐ-CP.", "nghị định 8/2009/nđ-cp", "LUẬT SỐ 9/2010/QH", "Thông tư\n10/2011/TT",
            "Sửa đổi, bổ sung khoản 2 Điều 3 như sau:", "Nội dung mới", "4. Bãi bỏ Điều 7", "Sửa đổi, bổ sung một số điều của Luật số 3/2001/QH10", "Nghị định 4/2002/NĐ-CP hết hiệu lực, trừ Điều 5 và Điều 6.", "pháp lệnh 5/2", "hạt 6/2000/X", "a) Sửa đổi, bổ sung khoản 3", "Bãi bỏ số thứ tự 4"]
    texts = ["\n".join(rng.choice(said) for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, content string").cache()
    rows = lambda df: sorted(map(str, df.collect()))
    tree = G.section_tree(docs, tasks=4).where("section_type = 'dieu'").select("doc_id", F.col("number").alias("article"))
    assert rows(G.articles(docs)) == rows(tree) and tree.count() > 300
    every, some = A.extract_amendments(docs), A.extract_amendments(docs, targeted=True)
    assert rows(some) == rows(every.where("target_doc_number is not null")) and some.count() < every.count()
    named = F.col("content").rlike(f"(?i){UNI}{A.ANY_ACT}")
    assert docs.where(A.names_act(F.col("content")) != named).count() == 0
    assert A.amendment_target(docs).where("target_doc_number is not null").count() == docs.where(named).count()
