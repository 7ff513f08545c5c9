"""Rows dealt by keys over as many tasks as the input needs, and what is folded or merged on them."""

import random

from pyspark.sql import functions as F

from lexarium.operators import structure as G
from lexarium.sources import shared


def test_tasks_grow_with_the_input(spark, monkeypatch):
    """Of 4 shuffle partitions whatever the input is, each would hold a share that grows with it."""
    docs = spark.range(1000).select(F.concat(F.lit("d"), "id").alias("doc_id"), F.lit("Chương I\nĐiều 1. A\nb\n1. c\na) d").alias("content"))
    assert G.section_tree(docs).rdd.getNumPartitions() == shared.TASKS * spark.sparkContext.defaultParallelism
    monkeypatch.setattr(shared, "KEY_ROWS", 20)
    assert G.section_tree(docs).rdd.getNumPartitions() == 50
    monkeypatch.setattr(shared, "KEY_CHARS", docs.agg(F.sum(F.length("content"))).first()[0] // 100)
    assert G.section_tree(docs).rdd.getNumPartitions() == 100
    assert G.section_tree(docs, tasks=7).count() == 4000


def test_rollup_in_one_pass_is_the_fold_of_each_document(spark):
    """Documents that are cut by batches of few rows, in any order."""
    made = random.Random(3)
    rows = []
    for d in range(40):
        for i in range(made.randint(1, 30)):
            rows.append((f"d{d}", i + 1, made.randint(1, i) if i and made.random() < 0.8 else None, f"t{made.randint(0, 9)}"))
    want = {(f"d{d}", i): t for d in range(40) for i, t in G.rolled_up(sorted([r[1:] for r in rows if r[0] == f"d{d}"], key=lambda r: r[0])).items()}
    made.shuffle(rows)
    tree = spark.createDataFrame(rows, "doc_id string, node_id long, parent_id long, content string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for batch in ("3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got = G.rollup_content(tree)
            assert "FlatMapGroups" not in got._jdf.queryExecution().toString()  # no call of Python for each document
            assert {(r.doc_id, r.node_id): r.content for r in got.collect()} == want
            assert got.columns == tree.columns
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_law_is_merged_once_a_set_of_topics(spark):
    from lexarium.operators import retrieval as R

    law = spark.createDataFrame([("leave", 1, 1, "a" * 250), ("salary", 1, 2, "b"), ("salary", 2, 3, "a" * 200 + "x"), ("tax", 1, 4, "b"), ("tax", 2, 5, "c")], "topic string, pos int, vec_id long, text string")
    sets = {"c1": ["tax", "salary", "tax"], "c2": ["salary", "tax"], "c3": ["leave", "salary"], "c4": ["overtime"], "c5": ["tax"]}
    topics = spark.createDataFrame([(c, t) for c, ts in sets.items() for t in ts] + [(f"n{i}", "tax") for i in range(200)], "contract_id string, topic string")
    want = {("c1", 1, "salary", 2), ("c1", 2, "salary", 3), ("c1", 3, "tax", 5), ("c2", 1, "salary", 2), ("c2", 2, "salary", 3), ("c2", 3, "tax", 5), ("c3", 1, "salary", 2), ("c3", 2, "salary", 3), ("c5", 1, "tax", 4), ("c5", 2, "tax", 5)}
    got = R.merge_law(topics, law, 5)
    rows = got.collect()
    assert {(r.contract_id, r.pos, r.topic, r.vec_id) for r in rows if r.contract_id[0] == "c"} == want and len(rows) == len(want) + 400
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    assert plan.count("Window [") == 2 and all("contract_id" not in line for line in plan.splitlines() if "Window [" in line)  # no window over contracts


def test_contexts_are_made_where_their_rows_are_dealt(spark):
    from lexarium.operators import retrieval as R

    law = spark.createDataFrame([(f"d{i % 50}", i, "t") for i in range(500)], "doc_id string, pos int, text string")
    law = law.select("*", *[F.lit("x").alias(c) for c in ("doc_number", "title", "effective_date", "expiry_date")], F.lit(1).alias("status_flag"))
    got = R.format_context(shared.dealt(law, "doc_id", "text", 9), "doc_id")
    assert got.rdd.getNumPartitions() == 9 and got.count() == 50
    prompts = R.contract_prompts(spark.range(20).select(F.col("id").cast("string").alias("contract_id"), F.lit("a").alias("text")), spark.createDataFrame([("3", "law")], "contract_id string, context string"), 7)
    assert {r.contract_id: r.prompt for r in prompts.collect()}["3"] == "a\n\nlaw" and prompts.count() == 20
