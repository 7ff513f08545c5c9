"""Operators 11 to 13 against plain versions, and on odd tables."""

import hashlib
import math
import random
import zlib

import pytest

from lexarium.llm import licences, merkle, mining

DOC = "doc_id long, text string, lang string, source string, n_chars long, key string, d binary, i int, row string"


def _docs(spark, rows):
    """(doc_id, text, lang, source, n_chars) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "k", b"d", 1, "r") for r in rows], DOC)


# --- 11


def test_licences(spark):
    ids = {
        1: "Released under the MIT License. Under the  MIT-License!", 2: None, 3: "", 4: "under the mit\nlicense", 5: "Licensed under CC BY-NC 4.0.", 6: "underthe mit license",
        7: "Apache License, Version 2.0; Apache License Version 22", 8: "GNU General Public License, version 3", 9: "đ under the mit licensé", 10: "All rights\treserved " * 3000,
    }
    rows = {r.doc_id: r for r in licences.licences(_docs(spark, [(i, t, "x", "s", 1) for i, t in ids.items()])).collect()}
    assert [(rows[i].n_words, rows[i].n_base, rows[i].first_word, rows[i].last_word, rows[i].base_labels, rows[i].labels) for i in ids] == [
        (9, 2, 1, 5, "mit", "mit"), (0, 0, None, None, "", ""), (0, 0, None, None, "", ""), (4, 1, 0, 0, "mit", "mit"), (7, 1, 2, 2, "cc-by-nc", "cc-by-nc"), (3, 0, None, None, "", ""),
        (9, 1, 0, 0, "apache-2", "apache-2"), (6, 0, None, None, "", "gpl-3"), (5, 0, None, None, "", ""), (9000, 0, None, None, "", "all-rights-reserved"),
    ]
    assert rows[1].score == 1.0 and 0 < rows[7].score < 1 and rows[2].score == 0.0
    assert licences.licences(_docs(spark, [])).count() == 0


def test_licences_find_every_place(spark):
    """Texts of licence words alone, in random order: the same places as word-by-word search."""
    rng = random.Random(5)
    vocabulary = sorted({w.decode() for x in licences.TEMPLATES for w in licences.template(*x).words})
    pieces = [*vocabulary, *licences.BASE, *[n.replace("[", "").replace("]", "") for _, n in licences.TEMPLATES]]
    texts = [" ".join(rng.choices(pieces, k=rng.randint(0, 60))) for _ in range(200)]
    got = {r.doc_id: r for r in licences.licences(_docs(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)])).collect()}
    n = {w: sum(w in t.split() for t in texts) for w in vocabulary}
    idf = {w: math.log((1 + len(texts)) / (1 + n[w])) for w in vocabulary}
    for i, t in enumerate(texts):
        words = t.split()
        places = sorted(s for phrase in licences.BASE for s in range(len(words)) if words[s : s + len(phrase.split())] == phrase.split())
        labels, scores = set(), [0.0]
        for x in licences.TEMPLATES:
            label, own, keys = licences.template(*x)
            own = [w.decode() for w in own]
            for s in range(-len(own), len(words)):
                if all(s + k >= 0 and words[s + k : s + k + len(p)] == [w.decode() for w in p] for k, p in keys):
                    labels.add(label)
                    scores.append(sum(idf[w] for k, w in enumerate(own) if 0 <= s + k < len(words) and words[s + k] == w) / sum(idf[w] for w in own))
        assert (got[i].n_words, got[i].n_base, got[i].labels) == (len(words), len(places), ",".join(sorted(labels)))
        assert (got[i].first_word, got[i].last_word) == ((places[0], places[-1]) if places else (None, None))
        assert got[i].score == pytest.approx(max(scores), abs=2e-6)


# --- 12


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(i, text, lang, source, n):
    return _h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, source, lang, n, text)))


def _tree(leaves):
    """Root, and of each leaf its (before, after) by level."""
    level, paths, of = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[k : k + 16] for k in range(0, len(level), 16)]
        for leaf, at in enumerate(of):
            run, slot = runs[at // 16], at % 16
            paths[leaf].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
        of, level = [at // 16 for at in of], [_h(*r) for r in runs]
    return level[0], paths


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 17, "b": 1, None: 33, "": 16}, {f"s{k}": k % 3 + 1 for k in range(40)} | {"hot": 300}, {None: 260}])
def test_merkle(spark, sizes):
    rng = random.Random(1)
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((i, rng.choice([None, "", "Été AB", "x" * 500, "word"]), rng.choice([None, "en"]), source, rng.choice([None, 5])))
            i += rng.randint(1, 3)
    rng.shuffle(rows)
    by = {}
    for r in sorted(rows):
        by.setdefault(r[3], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: _tree([_leaf(*r) for r in by[s]]) for s in sources}
    root, top = _tree([trees[s][0] for s in sources])
    found = merkle.manifest(_docs(spark, rows)).withColumn("back", merkle.folded(merkle.F.col("leaf"), merkle.F.col("path"))).collect()
    assert len(found) == len(rows)
    got = {r.doc_id: (r.leaf.hex(), r.subroot.hex(), r.root.hex(), r.back.hex(), [(x.before.hex(), x.after.hex()) for x in r.path]) for r in found}
    for k, s in enumerate(sources):
        for r, path in zip(by[s], trees[s][1], strict=True):
            assert got[r[0]] == (_leaf(*r), trees[s][0], root, root, path + top[k])


def test_merkle_odd_tables(spark, tmp_path):
    assert merkle.manifest(_docs(spark, [])).count() == 0
    twice = merkle.manifest(_docs(spark, [(1, "a", None, "s", 1)] * 20 + [(None, "b", None, None, None)])).collect()
    assert len(twice) == 21 and len({bytes(r.root) for r in twice}) == 1
    rows = [(i, "Text With CAPITALS" if i % 2 else None, "en", "s", 3) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for r in merkle.query(spark, str(tmp_path)).collect():
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 5 != 0 or r.doc_id % 2 == 0)


# --- 13


def _mined(rows, positives=5, negatives=10):
    """Rows (id, label, vector of integers); all pairs."""
    out = []
    width = max((len(v) for _, _, v in rows), default=0)
    rows = [(i, label, list(v) + [0] * (width - len(v))) for i, label, v in rows]
    for a, (i, label, v) in enumerate(rows):
        if i % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j, k, other) for k, (j, other, w) in enumerate(rows) if k != a)
        for ps, p, _, _ in [x for x in scored if x[3] == label][:positives]:
            fit = [x for x in scored if x[3] != label and 30 * -ps <= 100 * -x[0] <= 90 * -ps][:negatives]
            out += [(i, p, rank, n, -ps, -ns) for rank, (ns, n, _, _) in enumerate(fit, 1)]
    return sorted(out)


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "c") for r in rows], "vec_id long, label long, q array<long>, anchor int, block string")


@pytest.mark.parametrize("dim, spread", [(1, 3), (3, 2), (16, 5), (40, 200), (64, 1)])
def test_hard_negatives(spark, dim, spread):
    rng = random.Random(dim)
    rows = [(i, rng.randrange(4), [rng.randint(-spread, spread) + (i % 4) for _ in range(dim)]) for i in rng.sample(range(900), 420)] + [(100 * k, k % 3, [1] * dim) for k in range(10, 14)]
    got = sorted(tuple(r) for r in mining.hard_negatives(_frame(spark, rows), mining.F.expr("vec_id % 100 = 0")).collect())
    assert got == _mined(rows) and got


def test_hard_negatives_odd_tables(spark):
    condition = mining.F.expr("vec_id % 100 = 0")
    mine = lambda rows: sorted(tuple(r) for r in mining.hard_negatives(_frame(spark, rows), condition).collect())
    assert mine([]) == [] and mine([(1, 1, [1])]) == [] and mine([(0, 1, []), (1, 1, []), (2, 2, [])]) == [(0, 1, 1, 2, 0, 0)]
    odd = [(0, 1, [2, 2]), (0, 1, [2, 2]), (1, None, [1, 1]), (None, 1, [1, 1]), (2, 1, None), (3, 2, [1]), (4, 2, [1, 1]), (5, 1, [4, 0, 9])]
    assert mine(odd) == _mined([r for r in odd if None not in r])
    big = [(0, 1, [1 << 40, 1 << 40]), (1, 1, [1 << 20, 1]), (2, 2, [1 << 19, 0])]
    assert mine(big) == _mined(big)
    high = [(0, 1, [1 << 62]), (1, 1, [1 << 62]), (2, 2, [1])]
    assert mine(high) == [(0, 1, 1, 2, (1 << 63) - 1, 1 << 62)]  # scores stay within a long


def test_bounds_hold_and_prune():
    """No score is outside its bounds, and of vectors around a few directions most are excluded before exact scoring."""
    np = mining.np
    rng = np.random.default_rng(3)
    v = np.floor(32 * np.repeat(rng.normal(size=(5, 64)), 200, axis=0) + rng.normal(size=(1000, 64)))
    sums, scores = mining.summaries(v), v @ v[0]
    anchor = [(m[0], d[0]) for m, d in sums]
    for (means, devs), (m, d) in zip(sums, anchor, strict=True):
        assert (np.abs(scores - means @ m) <= devs @ d + 0.02).all()
    ids = np.arange(1000)
    goals = [mining.Goal(-np.inf, np.inf, 5), mining.Goal(74_000, 75_400, 5), mining.Goal(10**9, 10**10, 5)]
    block = (ids, ids, None, None, v, sums)
    assert mining.search(goals[:1], v[0], anchor, block, ids) < 300
    assert mining.search(goals[1:], v[0], anchor, block, ids) < 300
    for g in goals:
        assert g.ids.tolist() == sorted((i for i in range(1000) if g.least <= scores[i] <= g.most), key=lambda i: (-scores[i], i))[:5]
