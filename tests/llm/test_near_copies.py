import numpy as np
import pytest

import corpus_pipeline
from lexarium.llm import _common, near_copies

SCHEMA = "doc_id long, text string, component_id string, fp int"


def _brute(fps, bits):
    d = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2) <= bits
    label = np.arange(len(fps))
    while True:
        lower = np.array([label[row].min() for row in d])
        if (lower == label).all():
            return label
        label = lower


@pytest.mark.parametrize("n", [1, 2, 40, 300])
def test_spanning(n):
    """Chains, stars and single rows: the trees connect what all links connect."""
    rng = np.random.default_rng(n)
    fps = rng.integers(0, 2**64, (n, near_copies.WORDS), np.uint64)
    for i in range(1, n):
        if i % 3:
            fps[i] = fps[i - 1]
            fps[i, i % 8] ^= np.uint64(1) << np.uint64(i % 64)
    a, b = near_copies.spanning(fps, 1)
    assert len(set(b.tolist())) == len(b)
    root = dict(zip(b.tolist(), a.tolist()))

    def top(x):
        while x in root:
            x = root[x]
        return x

    want = _brute(fps, 1)
    assert len({(top(i), want[i]) for i in range(n)}) == len({top(i) for i in range(n)}) == len(set(want.tolist()))


def _edited(words, every, at):
    return " ".join("changed" if i % every == at else w for i, w in enumerate(words))


def test_near_copies(spark):
    """Copies with 1 of 60 words changed (similarity 0.85) are found whatever the group's size; unrelated and half-shared texts stay."""
    rng = np.random.default_rng(5)
    text = [[f"w{x}" for x in rng.integers(0, 5000, 300)] for _ in range(60)]
    rows = [(i, " ".join(w)) for i, w in enumerate(text)]
    rows += [(100 + i, _edited(w, 60, 7)) for i, w in enumerate(text[:20])]
    rows += [(1000 + i, " ".join(text[0][:i] + ["other"] + text[0][i + 1 :])) for i in range(250)]
    rows += [(2000 + i, " ".join(w[:150] + text[59 - i][:150])) for i, w in enumerate(text[20:30])]
    rows += [(None, " ".join(text[3])), (3000, None), (3001, ""), (3002, " \n\t"), (3003, "one"), (3003, "one")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = [(r.doc_id, r.component_id) for r in near_copies.similar_groups(docs).collect()]
    assert len(got) == len(rows)
    comp = dict(x for x in got if x[0] is not None)
    assert all(comp[100 + i] == i for i in range(20)) and all(comp[1000 + i] == 0 for i in range(250))
    assert all(comp[i] == i for i in [*range(60), *range(2000, 2010)])
    assert comp[3000] == comp[3001] == comp[3002] == 3000 and comp[3003] == 3003 and (None, 3) in got
    kept = near_copies.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.where("doc_id >= 100 and doc_id < 2000").isEmpty()
    assert kept.where("doc_id is null").count() == 1 and kept.where("doc_id = 3003").count() == 2
    empty = spark.createDataFrame([], SCHEMA)
    assert near_copies.similar_groups(empty).isEmpty() and corpus_pipeline.near_copies_out(spark, empty, "").isEmpty()


def test_large_buckets_in_blocks(spark, monkeypatch):
    """A bucket over several blocks links as one."""
    monkeypatch.setattr(near_copies, "BLOCK", 16)
    words = [f"w{i}" for i in range(200)]
    docs = spark.createDataFrame([(i, " ".join(words[:i] + ["x"] + words[i + 1 :])) for i in range(120)], "doc_id long, text string")
    assert {r.component_id for r in near_copies.similar_groups(docs).collect()} == {0}


def test_similarity_is_verified_on_shingles(spark):
    """Groups are those of all pairs of Jaccard similarity 0.8, on both sides of it and of very short texts: none missed, none added."""
    rng = np.random.default_rng(11)
    rows, known = [], []

    def add(words):
        rows.append((len(rows), " ".join(words)))
        known.append(near_copies.shingle_hashes(rows[-1][1]))

    for k in range(120):
        w = [f"{k}w{x}" for x in range(8)]  # 4 shingles, and 5 of which 4 are the same
        add(w)
        add([*w, "more"])
    for k in range(120):
        w = [f"{k}v{x}" for x in range(204)]
        add(w)
        add(w[: 204 - 15 - k % 15] + [f"{k}u{x}" for x in range(15 + k % 15)])
    want = list(range(len(rows)))
    pairs = 0
    for i in range(0, len(rows), 2):
        both = len(np.intersect1d(known[i], known[i + 1]))
        if both >= 0.8 * (len(known[i]) + len(known[i + 1]) - both):
            want[i + 1], pairs = i, pairs + 1
    assert 120 < pairs < 240
    got = dict(near_copies.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [got[i] for i in range(len(rows))] == want


def test_alike_sets_in_blocks(spark, monkeypatch):
    """A component of candidates in several blocks is linked as one; chance candidates aren't."""
    monkeypatch.setattr(near_copies, "PART", 2000)
    words = [f"w{i}" for i in range(200)]
    docs = spark.createDataFrame([(i, " ".join(words[:i] + ["x"] + words[i + 1 :])) for i in range(60)] + [(100, " ".join(words[:150] + ["y"] * 50))], "doc_id long, text string")
    assert {tuple(r) for r in near_copies.similar_groups(docs).collect()} == {*[(i, 0) for i in range(60)], (100, 100)}


def test_texts_stay_where_few_ids_go(spark, monkeypatch):
    """Up to MAX_BROADCAST_KEYS ids that go are broadcast: the rows aren't dealt anew. Beyond it the same rows stay."""
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[:i] + ["x"] + words[i + 1 :]), "x", 1) for i in range(20)] + [(100, "another", "x", 1), (None, "another", "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    few = near_copies.drop_near_copies(docs)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    monkeypatch.setattr(near_copies, "MAX_BROADCAST_KEYS", 0)
    assert sorted(map(str, few.collect())) == sorted(map(str, near_copies.drop_near_copies(docs).collect())) and few.count() == 3


def test_tasks_give_memory_back(monkeypatch):
    """A worker gives back what a task has freed, once and after its last batch."""
    order = []
    monkeypatch.setattr(_common, "give_back", lambda: order.append("back"))

    class Frame:
        def mapInArrow(self, run, schema):
            return list(run(iter([1, 2])))

    def each(batch):
        order.append(batch)
        yield batch

    assert _common.arrow_map(Frame(), each, "a long") == [1, 2] and order == [1, 2, "back"]
