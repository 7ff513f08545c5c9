"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram's vector binds (multiplies) its letters' vectors, permuted
(rotated) by their place; a text's vector bundles (adds) those of its n-grams; a language's prototype bundles those of its
training texts. A text gets the language whose prototype has the largest cosine.

Prototypes are added up in each task and then by language and dimension, as whole numbers, so they don't depend on order. What
reaches the driver is DIMENSIONS numbers for each language.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import batch_of, groups, held_out, settle, table, texts

DIMENSIONS = 1024
#: Languages at most: their prototypes, 8 kB each, are held at the driver and in each task.
MOST_LANGUAGES = 2000
#: Letters of an n-gram; a gap between words counts as one letter.
N = 3
SEED = 20_260
UNKNOWN = "und"
#: Distinct n-grams whose vectors are held at once.
_HELD = 16_384


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=4096)
def letter_vector(code: int) -> np.ndarray:
    return (np.random.default_rng((SEED, code)).integers(0, 2, DIMENSIONS, np.int8) * 2 - 1).astype(np.int8)


def ngrams(text: str) -> np.ndarray:
    """Codes of the n-grams of the letters of ``text``; none if it has no letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    c = np.where(_letters()[c], c, 0) if c.size else c
    if not c.any():
        return np.zeros(0, np.int64)
    c = np.concatenate([[0], c, [0]])
    c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]  # one gap for several
    codes = c[: c.size - N + 1].copy()
    for k in range(1, N):
        codes = codes << 21 | c[k : c.size - N + 1 + k]
    return codes


def ngram_vectors(codes: np.ndarray) -> np.ndarray:
    out = np.ones((len(codes), DIMENSIONS), np.int8)
    for k in range(N):
        letters, which = np.unique(codes >> 21 * (N - 1 - k) & 0x1FFFFF, return_inverse=True)
        turned = np.stack([np.roll(letter_vector(int(x)), N - 1 - k) for x in letters]) if len(letters) else np.zeros((0, DIMENSIONS), np.int8)
        out *= turned[which]
    return out


def bundle(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of the n-grams' vectors, in float64: whole numbers, exactly."""
    total = np.zeros(DIMENSIONS)
    for i in range(0, len(codes), _HELD):
        total += counts[i : i + _HELD].astype(np.float64) @ ngram_vectors(codes[i : i + _HELD]).astype(np.float64)
    return total


def prototypes(docs: DataFrame) -> dict[str, list[int]]:
    """Prototype of each language of ``docs`` (text, lang; null lang is left out). More than MOST_LANGUAGES values of lang are an error."""

    def partial(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = iter(batch.column(1).to_pylist())
            for group in groups(texts(batch)):
                parts: dict[str, list] = {}
                for t in group:
                    parts.setdefault(next(langs), []).append(ngrams(t))
                for lang, codes in parts.items():
                    sums[lang] = sums.get(lang, 0) + bundle(*np.unique(np.concatenate(codes), return_counts=True))
        if sums:
            yield batch_of(lang=pa.array(list(sums)), vector=pa.array([v.astype(np.int64).tolist() for v in sums.values()], pa.list_(pa.int64())))

    rows = docs.where("lang is not null").select("text", "lang").mapInArrow(partial, "lang string, vector array<long>")
    rows = rows.select("lang", F.posexplode("vector").alias("at", "v")).groupBy("lang", "at").agg(F.sum("v").alias("v"))
    rows = settle(rows)
    if (n := rows.count() // DIMENSIONS) > MOST_LANGUAGES:
        raise ValueError(f"lang has {n} values; prototypes of {MOST_LANGUAGES} at most are held at the driver and in tasks")
    vectors: dict[str, list[int]] = {}
    for r in rows.collect():
        vectors.setdefault(r["lang"], [0] * DIMENSIONS)[r["at"]] = r["v"]
    return vectors


def predict(docs: DataFrame, vectors: dict[str, list[int]]) -> DataFrame:
    """doc_id, lang_pred, score. Text that is null or has no letter is UNKNOWN with score 0, as is any if nothing was learned.

    Equal cosines go to the language that comes first by name. score is the cosine, 0 where negative.
    """
    names = sorted(vectors)
    protos = np.array([vectors[n] for n in names], np.float64).reshape(-1, DIMENSIONS)
    protos /= np.maximum(np.linalg.norm(protos, axis=1, keepdims=True), 1)

    def run(batches):
        for batch in batches:
            found = []
            for group in groups(texts(batch, "text")):
                part = [ngrams(t) for t in group]
                known = np.unique(np.concatenate(part))
                held = ngram_vectors(known).astype(np.float32) if len(known) <= _HELD else None
                for codes in part:
                    own, counts = np.unique(codes, return_counts=True)
                    if held is not None:
                        v = counts.astype(np.float32) @ held[np.searchsorted(known, own)]
                    else:
                        v = bundle(own, counts)
                    size = np.linalg.norm(v)
                    if not size or not names:
                        found.append((UNKNOWN if not len(own) or not names else names[0], 0.0))
                    else:
                        cos = np.round(protos @ (v / size), 9)
                        found.append((names[int(cos.argmax())], min(1.0, max(0.0, float(cos.max())))))
            yield batch_of(doc_id=batch.column(0), lang_pred=pa.array([x for x, _ in found], pa.string()), score=pa.array([x for _, x in found], pa.float64()))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """Languages of ``docs``, learned from the text and lang of ``learn_from``."""
    cast = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return predict(cast, prototypes(docs if learn_from is None else learn_from))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out(4, 2)
    return identify(docs, docs.where(~out)).select("doc_id", out.alias("held_out"), "lang_pred", "score")
