"""The pipeline against a plain version, and its stages on odd tables."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from lexarium.llm import bpe, packing, simhash, toxicity

NAMES = [n for n, _ in corpus_pipeline.STAGES]
STAGE = dict(corpus_pipeline.STAGES)
#: Extra columns with names that helpers might take.
EXTRA = "lang string, source string, n_chars long, id long, row long, rows long, spans string, digest string, rank long, length string, bucket int, _number string"


def words(seed, n=120, letter="w"):
    return " ".join(f"{letter}{x}" for x in np.random.default_rng(seed).integers(0, 4000, n))


def corpus():
    """(doc_id, text) and labels: 300 labelled rows, toxic ones with an insult; exact copies, near copies at and below 0.8, secrets, a long text."""
    rows = [(i, words(i, 60) + (" vile scum" if i % 4 == 0 else " fine day")) for i in range(300)]
    labels = [(i, 0, int(i % 4 == 0)) for i in range(300)]
    rows += [(1000 + i, words(i, 60).upper() + " FINE DAY") for i in range(1, 40, 2)]
    base = words(7000, 200, "q").split()
    rows.append((2000, " ".join(base)))
    rows += [(2001 + i, " ".join("zz" if k in range(5 + i, 200, 60) else w for k, w in enumerate(base))) for i in range(12)]
    rows += [(2100 + i, " ".join("zz" if k % 8 == i else w for k, w in enumerate(base))) for i in range(8)]
    rows += [(3000, "my token = abcdef123456 is safe " + words(8000, 120, "q")), (3001, words(8001, 3000, "q")), (3002, None), (3003, ""), (3004, "é " * 700)]
    return rows, labels


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    rows, labels = corpus()
    full = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups_of(ids, linked):
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in linked:
        up[top(a)] = top(b)
    out = {}
    for i in ids:
        out.setdefault(top(i), []).append(i)
    return out.values()


def test_run_against_a_plain_version(spark, made):
    import public_tokenizers as P
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(setting)
    got = corpus_pipeline.run(spark, made).toPandas()
    assert spark.conf.get(setting) == was
    docs, labels = (spark.read.parquet(f"{made}/{t}.parquet") for t in ("documents", "labels"))
    learn = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    score = {r.doc_id: r.score for r in toxicity.scored(docs, labels, learn).collect()}
    text = {i: t or "" for i, t in corpus()[0] if score[i] < 0.5}
    assert not any("scum" in t for t in text.values()) and len(text) > 250
    same = {}
    for i, t in text.items():
        same.setdefault(t.encode().lower(), []).append(i)
    text = {i: text[i] for i in map(max, same.values())}
    sets = {i: shingles(t) for i, t in text.items()}
    ids = sorted(text)
    alike = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    kept = sorted(min(g) for g in groups_of(ids, alike))
    assert set(range(2001, 2013)).isdisjoint(kept) and set(range(2100, 2108)) <= set(kept)
    text = {i: text[i].replace("token = abcdef123456", "[assign]") for i in kept}
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for i, x in text.items():
        tokens = t.encode(x, add_special_tokens=False).ids + [packing.END]
        first = len(tokens) % 1024 or 1024
        for k, at in enumerate([0, *range(first, len(tokens), 1024)]):
            part = tokens[at : first if k == 0 else at + 1024]
            want.append((i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want)
    got = got.sort_values(["sequence_id", "offset"])
    assert ((got.offset + got.length).groupby(got.sequence_id).shift(fill_value=0) == got.offset).all() and got.groupby("sequence_id").length.sum().max() <= 1024


@pytest.mark.parametrize("name", NAMES)
def test_stages_on_odd_tables(spark, made, name):
    more = ("en", "s", 3, 1, 2, 3, "x", "y", 4, "z", 5, "n")
    rows = [(1, "Same text here"), (2, "same TEXT here"), (2, "same TEXT here"), (2, "another text of that id"), (3, None), (4, ""), (None, "no id"), (None, "no id"), (5, "secret=abcdef99 " * 3), (6, "x" * 30_000)]
    docs = spark.createDataFrame([(*r, *more) for r in rows], f"doc_id long, text string, {EXTRA}")
    out = STAGE[name](spark, docs, made)
    if name != NAMES[-1]:
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
    found = sorted((str(r.doc_id), (getattr(r, "text", "") or "")[:40]) for r in out.collect())
    first = sorted((str(i), (t or "")[:40]) for i, t in rows)
    if name == "toxicity":
        assert found == first
    elif name == "exact_dedup":  # null and empty are equal; of the repeated row one stays; of rows without ids one
        assert found == sorted([("2", "same TEXT here"), ("2", "another text of that id"), ("4", ""), ("None", "no id"), ("5", ("secret=abcdef99 " * 3)[:40]), ("6", "x" * 40)])
    elif name == "near_dedup":  # the largest group keeps its smallest id, rows without an id stay
        assert found == sorted([("1", "Same text here"), ("3", ""), ("None", "no id"), ("None", "no id"), ("5", ("secret=abcdef99 " * 3)[:40]), ("6", "x" * 40)])
    elif name == "secrets":
        assert [t for i, t in found if i == "5"] == ["[assign] [assign] [assign] "] and len(found) == len(rows)
    else:
        assert len([1 for i, _ in found if i != "6"]) == len(rows) - 1
    empty = STAGE[name](spark, docs.limit(0), made)
    assert empty.count() == 0


def test_without_labels(spark, made, tmp_path):
    """Nothing is toxic where no label says so."""
    docs = spark.read.parquet(f"{made}/documents.parquet")
    docs.limit(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{made}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert STAGE["toxicity"](spark, docs.limit(5), str(tmp_path)).count() in (0, 5)


def test_packing_of_long_documents(spark):
    """Pieces, also of cut documents, are those of the tokenizer; long documents of one length are no hot key."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = [(i, words(i, 1500)) for i in range(4)] + [(10 + i, "a b c") for i in range(2500)]
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    for i, x in rows[:6]:
        tokens = np.array(t.encode(x, add_special_tokens=False).ids + [2], "<u4")
        own = got[got.doc_id == i].sort_values("piece")
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() == len(tokens) and (own.length.iloc[1:] == 1024).all()
        assert own.ids_crc32.tolist() == [zlib.crc32(tokens[a : a + n].tobytes()) for a, n in zip(own.start, own.length)]
    assert got.groupby("sequence_id").length.sum().max() <= 1024 and got.sequence_id.nunique() == -(-got.length.sum() // 1024)
    assert not got.duplicated(["sequence_id", "offset"]).any()


def test_hot_fingerprints_and_digests(spark):
    """A third of all rows in one group gives the same components and classes as any other."""
    from lexarium.llm import exact_dedup

    rows = [(i, "the same text for a third of all rows") for i in range(0, 3000, 3)] + [(i, words(i, 12)) for i in range(3000) if i % 3]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    exact = exact_dedup.exact_groups(docs).where("doc_id % 3 = 0").select("keep_id", "group_size").distinct().collect()
    assert [tuple(r) for r in exact] == [(2997, 1000)]
    near = {r.doc_id: r.component_id for r in simhash.near_groups(docs).collect()}
    assert len(near) == 3000 and {near[i] for i in range(0, 3000, 3)} == {0}


def test_bpe_blocks(spark, monkeypatch):
    """Blocks of a few bytes, and words that a block's list lacks, give the same ids."""
    import public_tokenizers as P

    path = P.path("word_bpe_49k.json")
    rows = [(i, words(i, 30) + " naïve Ünïcode ​ don't <|endoftext|>x") for i in range(40)] + [(99, None), (98, "​"), (97, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {r.doc_id: r.ids_sha256 for r in bpe.encode(docs, path).collect()}
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 500)
    monkeypatch.setattr(bpe, "RUN_BYTES", 100)
    got = bpe.encode(docs, path)
    assert {r.doc_id: r.ids_sha256 for r in got.collect()} == want
    decoded = {r.doc_id: r.decoded for r in bpe.decode(got, path).collect()}
    assert {r.doc_id: r.decoded for r in got.collect()} == {k: v or "" for k, v in decoded.items()}
