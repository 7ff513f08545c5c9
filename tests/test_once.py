"""Costly columns are computed once a row, and rows are dealt over all cores: what the plans say."""

import pytest
from pyspark.sql import functions as F

from lexarium.functions import cleaning as L
from lexarium.operators import contracts as K
from lexarium.operators import fields as H
from lexarium.operators import retrieval as R
from lexarium.sources.fixtures import spread, view

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_one_row_group_is_many_tasks(spark):
    assert view(spark, SF, "contracts").select(F.spark_partition_id().alias("p")).distinct().count() > spark.sparkContext.defaultParallelism
    dealt = spread(spark.range(100, numPartitions=64))
    assert dealt.rdd.getNumPartitions() == 64  # tasks enough as it is


def test_keywords_read_a_text_once(spark):
    words = L.keywords(*map(F.col, ("title", "content", "doc_number")))
    df = spark.createDataFrame([("Luật lao động A", "Điều 1 và Điều 1. NĐ-CP 2020", "1/2020/NĐ-CP")], "title string, content string, doc_number string").select(words.alias("k"))
    assert _plan(df).count("Điều|Khoản|Chương") == 1
    assert df.first()["k"] == ["1/2020/Nđ-Cp", "Luật", "Lao", "Động", "Điều 1", "NĐ-CP", "2020"]


def test_topics_lower_a_text_once(spark):
    df = spark.createDataFrame([("a", "Tiền LƯƠNG và thuế"), ("b", "không")], "contract_id string, text string")
    assert _plan(R.detect_topics(df)).count("lower(") == 1
    assert R.detect_topics(df).collect() == [("a", "salary"), ("a", "tax")]
    assert [(r.topic, r.keyword) for r in R.clause_topic(df).orderBy("contract_id").collect()] == [("salary", "lương"), ("general", "")]
    assert R.shortest(["mức lương", "lương", "thưởng"]) == ["lương", "thưởng"]


@pytest.mark.parametrize("word", ["bồi\\s+hoàn", "mức\\s+phạt", "bí\\s+mật"])
def test_clause_words_are_looked_for_once(spark, word):
    df = spark.createDataFrame([("a", "x")], "contract_id string, text string")
    assert _plan(H.clause_fields(df)).count(word) == 1


def test_a_response_is_parsed_once(spark):
    df = spark.createDataFrame([("a", 1, 'Đây: {"severity":"ok","issue":"x"}'), ("b", 1, '{"severity":"ok"} {'), ("c", 2, '{"issue":"y"}, {"issue":"z"}')], "contract_id string, pos int, response string")
    parsed = K.parse_responses(df)
    assert _plan(parsed).count("from_json") <= 2
    assert [tuple(r)[:5] for r in parsed.collect()] == [("a", 1, None, "ok", "x"), ("b", 1, None, "ok", None)]


def test_distinct_texts_are_encoded_once(spark):
    def counting():
        def encode(texts):
            assert len(texts) == len(set(texts))
            return R.hashed_ngrams()()(texts)

        return encode

    rows = [(i, ["a b", "c", None][i % 3]) for i in range(5000)]
    got = R.embed(spark.createDataFrame(rows, "i int, text string").coalesce(1), counting).orderBy("i").collect()
    assert got[0].embedding == got[4998].embedding and len(got[1].embedding) == 128 and set(got[2].embedding) == {0.0}


def test_text_neighbours_are_those_of_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    words = ["luật", "thuế", "đất", "nhà", "lương"]
    rows = [(f"v{i % 170:03}", " ".join(rng.choice(words, rng.integers(1, 4)))) for i in range(200)]  # some ids and many texts repeat
    v = R.hashed_ngrams()()([t for _, t in rows]).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    kb = spark.createDataFrame([*rows, ("null", None)], "vec_id string, text string")
    got = R.text_neighbours(kb.where("vec_id < 'v040'").withColumnRenamed("vec_id", "query_id"), kb, R.hashed_ngrams(), 3, 0.5)
    pairs = {}
    for (q, _), x in zip(rows, v):
        if q < "v040":
            pairs.setdefault(q, []).extend((-round(float(x @ y), 6), c) for (c, _), y in zip(rows, v))
    want = sorted((q, c, n + 1, -s) for q, found in pairs.items() for n, (s, c) in enumerate(sorted(found)[:3]) if s <= -0.5)
    assert sorted(map(tuple, got.collect())) == want


def test_acts_of_a_shared_number_make_no_pairs_with_its_documents(spark):
    from lexarium.operators import amendments as A

    n = 300
    docs = spark.range(2 * n).selectExpr("concat('d', id) as doc_id", f"if(id < {n}, '1/2020/NĐ-CP', '2/2020/NĐ-CP') as doc_number", "'2021-01-01' as effective_date")
    acts = spark.range(n, 2 * n).selectExpr("concat('d', id) as doc_id", "'1/2020/nđ-cp' as target_doc_number", "'7' as article", "cast(null as string) as clause")
    chunks = docs.selectExpr("doc_id", "'7' as article")
    found = A.amended_by(chunks, acts, docs)
    assert sorted(map(tuple, found.collect())) == sorted((f"d{i}", "7", "2/2020/NĐ-CP 2021-01-01") for i in range(n))
    assert "_dst" not in _plan(found)  # each act with each document of its number would be n * n rows


def test_amendments_read_a_text_once(spark):
    from lexarium.operators import amendments as A

    df = spark.createDataFrame([("a", "Sửa đổi, bổ sung Điều 3\nx\nSửa đổi, bổ sung Điều 3\nBãi bỏ khoản 2 Điều 4\nBãi bỏ khoản 2 Điều 4")], "doc_id string, content string")
    found = A.extract_amendments(df)
    assert _plan(found).count("posexplode(_all") == 1
    assert sorted((r.line_start, r.action, r.article, r.clause) for r in found.collect()) == [(0, "amended", "3", None), (3, "abolished", "4", "2"), (4, "abolished", "4", "2")]


def test_a_value_of_many_rows_is_many_files(spark, tmp_path):
    from lexarium.sources.log import Log

    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    was = spark.conf.get(name)
    spark.conf.set(name, "100kb")
    try:
        log = Log(spark, str(tmp_path), "kind")
        log.put(spark.range(200_000).selectExpr("id", "sha2(string(id), 256) as text", "if(id < 10, 'few', 'many') as kind"), "whole")
    finally:
        spark.conf.set(name, was)
    assert len(list(tmp_path.glob("data/*/kind=many/*.parquet"))) > 1
    assert log.read().count() == 200_000


def test_a_summary_looks_for_no_clauses(spark):
    """Kinds of clause that a summary doesn't show aren't looked for, and days not where a text has none."""
    from lexarium.operators import fields as H

    texts = ["HỢP ĐỒNG LAO ĐỘNG\nTừ ngày: 01/02/2020 Đến ngày: 3 THÁNG 4 NĂM 2021\nMức phạt là 5 lần lương tháng\nBồi thường 7 lần", "HỢP ĐỒNG MUA BÁN\nTừ ngày: x"]
    parsed = H.parse_contracts(spark.createDataFrame(list(enumerate(texts)), "contract_id int, text string"))
    a, b = sorted(parsed.collect())
    assert (a.start_date, a.end_date, b.start_date, b.end_date) == ("01/02/2020", "3 THÁNG 4 NĂM 2021", None, None)
    assert a.penalty_clause.startswith("Mức phạt") and a.indemnity.startswith("Bồi thường")
    assert "phạt" not in H.contract_summary(parsed)._jdf.queryExecution().optimizedPlan().toString()


def test_sentences_that_repeat_are_looked_through_once(spark):
    """The first topic and its first word are those of the whole text, whatever its words and full stops are."""
    import random

    from lexarium.functions import terms as W

    made = random.Random(5)
    words = [w for ws in W.TOPICS.values() for w in ws]
    bits = [*words, *[w[: len(w) // 2] for w in words], "x", "nghỉ", "thời gian"]
    texts = ["".join(made.choice(bits).upper() + made.choice([" ", ".", ". ", "\n", ""]) for _ in range(made.randint(0, 3))) * made.randint(1, 9) for _ in range(1500)] + ["", ".", "...", None]
    found = R.clause_topic(spark.createDataFrame(list(enumerate(texts)), "contract_id int, text string"))
    shown = lambda t: next(((k, w) for k, ws in W.TOPICS.items() for w in ws if w in t), (W.GENERAL, ""))
    assert {r.contract_id: (r.topic, r.keyword) for r in found.collect()} == {i: shown((t or "").lower()) for i, t in enumerate(texts)}
    assert not [w for w in words if "." in w] and _plan(found).count("array_distinct") == 1


def test_prompts_deal_no_clauses_by_topic(spark):
    clauses = spark.createDataFrame([("a", 0, "1", "lương " * 2000), ("b", 1, "2", "x")], "contract_id string, pos int, clause_number string, text string")
    contexts = spark.createDataFrame([("salary", "y" * 5000)], "topic string, context string")
    prompts = R.clause_prompts(clauses, contexts)
    assert "strategy=broadcast" in _plan(prompts)
    assert {r.contract_id: r.prompt for r in prompts.collect()} == {"a": ("lương " * 2000)[:5000] + "\n\n" + "y" * 4000, "b": f"x\n\n{R.W.NO_LAW}"}


def test_clauses_are_cut_once(spark):
    from lexarium.operators import structure as G

    df = spark.createDataFrame([("a", " đầu\nĐiều 1. x \n\n Điều 2: y "), ("b", "không "), ("c", "Điều 3. z"), ("d", None)], "contract_id string, text string")
    found = G.clause_dicts(df)
    assert _plan(found).count("split(") <= 2
    assert sorted(map(tuple, found.collect())) == [("a", 0, "0", "đầu"), ("a", 1, "1", "\nĐiều 1. x"), ("a", 2, "2", "\n\n Điều 2: y"), ("b", 0, "0", "không "), ("c", 1, "3", "Điều 3. z")]


def test_few_vectors_need_no_pivots(spark, monkeypatch):
    from lexarium.operators import search as S

    monkeypatch.setattr(S, "pivots_of", None)
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in S.knn(v.limit(1).withColumnRenamed("vec_id", "query_id"), v, 2).orderBy("rank").collect()] == [0, 1]


def test_patterns_of_parties_are_looked_for_once(spark):
    """In either case; the first heading counts, though another is written alike, and 2000 characters of what follows it."""
    text = "bên a: (Chủ)\n" + "x\n" * 990 + "MÃ SỐ THUẾ: 12\nđại DIỆN: Y\nBÊN A: (Chủ)\ncông TY: B\nHỌ TÊN: Z | q\ncccd: 123456789\nđịa CHỈ: P\n"
    near = "BÊN A: (X)\nDoanh nghiệp: C\nĐIA CHỈ: Q\nMã số thuế: 7\nĐẠI diện: W\n \nbên b: (Thợ)\nhọ VÀ tên: V\nCmNd số: 987654321\n" + "y" * 90
    df = spark.createDataFrame([("a", text), ("b", near), ("c", "Công ty: không\n"), ("d", None)], "contract_id string, text string")
    found = K.contract_parties(df)
    plan = _plan(found)
    for p in (K.PARTY_B, K.COMPANY, K.TAX_ID, K.REPRESENTATIVE, K.WORKER, K.ID_NUMBER):
        assert plan.count(p) == 1
    assert sorted(map(tuple, found.collect()), key=str) == [("a", "Z", K.ROLES[1], "P", "123456789", None), ("b", "C", "X", "Q", "7", "W"), ("b", "V", "Thợ", "Q", "987654321", None)]


def test_every_second_contract_is_written_with_its_letters_apart(spark):
    """As if each letter were replaced in the text of all fields."""
    from lexarium.plans import registry as P

    even = F.expr("cast(substring(contract_id, 4) as int) % 2 = 0")
    text = F.expr(P.PARTIES)
    for c, parts in P.DECOMPOSED.items():
        text = F.replace(text, F.lit(c), F.lit(parts))
    want = view(spark, SF, "contracts").withColumn("text", F.when(even, text).otherwise(F.expr(P.PARTIES)))
    got = P._contracts(spark, SF)
    assert got.columns == want.columns and got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0
    assert _plan(got).count("replace(") < len(P.DECOMPOSED)  # not a letter after the other


def test_lines_are_only_read_where_a_clause_word_may_fit(spark):
    """What the folded text says first: the plan asks it before each word, and odd letters, cases and white space give what all lines give."""
    import random

    rng = random.Random(5)
    words = [w for *_, ws in H.CLAUSES.values() for w in ws]
    said = ["Bất khả kháng", "bẤt  KHẢ kháng", "SỰ KIỆN bất khả kháng", "ſeverab", "SEVERABLE", "confıdentİal", "CONFIDENTIAL", "bồi\nthường", "bồi hoàn", "Tạm hoãn rồi chấm dứt", "tạm hoãn\nchấm dứt", "luật áp dụng", "ĐIỀU 5. x", "Điều 6. y", "K", "lao động", "pháp luật", "force majeure", "forcemajeure"]
    texts = ["".join(rng.choice([*said, " ", "\n", "x", "\t"]) for _ in range(rng.randrange(1, 14))) for _ in range(300)]
    df = L.computed(spark.createDataFrame([(t,) for t in texts], "text string"), _lines=F.split("text", "\n"), _low=L.folded(F.col("text"))).cache()
    for w in words:
        first, plain = H.line_around(F.col("text"), w, 1, F.col("_lines"), F.col("_low")), H.line_around(F.col("text"), w, 1)
        assert df.where(~first.eqNullSafe(plain)).count() == 0, w
    plan = _plan(H.clause_fields(spark.createDataFrame([("a", "x")], "contract_id string, text string")))
    assert plan.count("Contains(_") > len(words)
