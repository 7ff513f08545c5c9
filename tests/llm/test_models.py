"""Toxicity and language models against plain versions."""

import numpy as np
import pytest

from lexarium.llm import langid, toxicity


def test_pair_sum_against_all_pairs():
    rng = np.random.default_rng(4)
    rows = [np.sort(rng.choice(60, n, replace=False)) for n in (0, 1, 2, 17, 40)]
    m = toxicity.FactorizationMachine(np.arange(0, 60, 2), -0.3, rng.normal(size=30), rng.normal(size=(30, toxicity.FACTORS)) / 4)
    for row, got in zip(rows, m.score(rows), strict=True):
        own = [int(x) // 2 for x in row if x % 2 == 0]
        z = m.w0 + sum(m.w[i] for i in own) + sum(m.v[i] @ m.v[j] for i in own for j in own if i < j)
        assert np.isclose(got, 1 / (1 + np.exp(-z)))


def test_pairs_of_terms_that_say_nothing_alone():
    """Two terms are as frequent in clean texts as in toxic ones and toxic only together; a third is toxic by itself."""
    rng = np.random.default_rng(3)
    rows, y = [], []
    for _ in range(9000):
        a, b = rng.integers(0, 2, 2)
        alone = not a and not b
        rows.append(np.unique(np.concatenate([10 + rng.integers(0, 40, 4), [1] * a, [2] * b, [3] * alone]).astype(np.int64)))
        y.append(float(a == b))
    y = np.array(y)
    has = lambda k: np.array([k in r for r in rows])
    assert all(toxicity._association(has(k).sum(), y[has(k)].sum(), len(y), y.sum()) < toxicity.ASSOCIATION for k in (1, 2))
    m = toxicity.FactorizationMachine.fit(rows[:8000], y[:8000])
    score = m.score(rows[8000:])
    assert np.mean((score >= 0.5) == y[8000:]) > 0.95
    # without the pairs a and b together can't be told from either alone
    linear = toxicity.FactorizationMachine(m.active, m.w0, m.w, np.zeros_like(m.v))
    assert np.mean((linear.score(rows[8000:]) >= 0.5) == y[8000:]) < 0.8


def test_sample_is_bounded_in_bytes(spark):
    rows = spark.createDataFrame([(i, b"x" * 100) for i in range(50)], "doc_id long, terms binary")
    drawn = [r.doc_id for r in rows.selectExpr("doc_id", "xxhash64(doc_id) h").orderBy("h").collect()]
    assert {r.doc_id for r in toxicity.within(rows, "terms", 1050).collect()} == set(drawn[:10])
    assert toxicity.within(rows, "terms").count() == 50 and toxicity.within(rows.limit(0), "terms").count() == 0


def test_repeated_ids_are_one_sample(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (None, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    assert sorted(tuple(r) for r in toxicity.sample(docs, labels, "toxic").collect()) == [(1, "a", 1), (2, None, 0)]


def plain_cosines(text, protos):
    low = "".join(c if c.isalpha() else "\0" for c in text.lower())
    parts = [p for p in low.split("\0") if p]
    line = "\0" + "\0".join(parts) + "\0"
    v = np.zeros(langid.DIMENSIONS)
    for i in range(len(line) - 2):
        gram = np.ones(langid.DIMENSIONS)
        for k in range(3):
            gram = gram * np.roll(langid.letter_vector(ord(line[i + k])), 2 - k)
        v += gram
    return {k: float(p @ v / np.linalg.norm(p) / np.linalg.norm(v)) for k, p in protos.items()}


def test_language_against_plain_vectors(spark):
    texts = {"en": "the quick brown fox, and THE other things", "de": "der schnelle Fuchs; Straße über", "fr": "été à l'œuvre"}
    known = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(texts.items())] + [(9, "never", None)], "doc_id long, text string, lang string")
    protos = {k: np.array(v, float) for k, v in langid.prototypes(known).items()}
    assert set(protos) == set(texts)
    trial = ["other foxes", "über den Fuchs", "l'été", "x", "the " * 400, "été 12 über"]
    got = langid.identify(spark.createDataFrame(list(enumerate(trial)), "doc_id long, text string"), known).orderBy("doc_id").collect()
    for t, r in zip(trial, got, strict=True):
        cos = plain_cosines(t, protos)
        best = max(sorted(cos), key=lambda k: round(cos[k], 9))
        assert r.lang_pred == best and abs(r.score - max(0.0, cos[best])) < 1e-5


def test_ties_go_to_the_first_name(spark):
    known = spark.createDataFrame([(1, "abc", "zz"), (2, "abc", "aa"), (3, "abc", "mm")], "doc_id long, text string, lang string")
    docs = spark.createDataFrame([(1, "abc"), (2, None), (3, "12 !")], "doc_id long, text string")
    assert [(r.lang_pred, round(r.score, 6)) for r in langid.identify(docs, known).orderBy("doc_id").collect()] == [("aa", 1.0), ("und", 0.0), ("und", 0.0)]


@pytest.mark.parametrize("label", ["toxic"])
def test_without_labels(spark, label):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], f"doc_id long, {label} int")
    assert {r.score for r in toxicity.scored(docs, labels).collect()} == {0.5}


def test_too_many_languages(spark, monkeypatch):
    from lexarium.llm import langid

    monkeypatch.setattr(langid, "MOST_LANGUAGES", 2)
    docs = spark.createDataFrame([(i, "some words of text", f"l{i}") for i in range(3)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="lang has 3 values"):
        langid.identify(docs)
