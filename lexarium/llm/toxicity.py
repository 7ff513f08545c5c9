"""Toxicity by a factorization machine over hashed terms.

logit = w0 + sum w_i x_i + sum over pairs of <v_i, v_j> x_i x_j, where x_i is 1 if a term that hashes to i is in the text. The
pairs let an insult weigh more beside the mention of a group than alone; their sum is taken in linear time from the
sums and the sums of squares of the factors. Every bucket seen in at least LEAST labelled texts has a weight and factors, so terms that
say nothing alone can matter in pairs; those not associated with the label by themselves learn their weights slowly, which keeps noise out.

The model is fitted on at most SAMPLE labelled rows, chosen by a hash of doc_id, and has a fixed size; it is scored over all
rows where they are.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import arrow_map, batch_of, give_back, groups, held_out, settle, table, texts

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 12_000
#: Bytes of these, encoded, that reach the driver, at most.
SAMPLE_BYTES = 96 << 20
#: Parts in which the sample comes to the driver.
PARTS = 8
BUCKETS = 1 << 18
FACTORS = 4
#: Letters of a word's beginnings.
STEMS = (4, 5)
LEAST = 5
#: Chi-square statistic of presence and label from which a bucket's weight learns fast.
ASSOCIATION = 10.0
#: Steps of associated weights, of other weights, and of factors.
FAST, SLOW, PAIRS = 0.3, 0.005, 0.02
EPOCHS = 30
BATCH = 256
_WORD = re.compile(r"[^\W_]+")


class _Hashed(dict):
    """Word to the buckets of itself and its beginnings, which stand for inflected forms; bounded."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= 300_000:
            self.clear()
        starts = [f"{word[:n]}-" for n in STEMS] if len(word) > STEMS[0] else []
        found = tuple(zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in (word, *starts))
        if len(word) <= 64:
            self[word] = found
        return found


_hashed = _Hashed()


def terms(text: str) -> np.ndarray:
    """Distinct hash buckets, in order, of the words of ``text`` and of their beginnings."""
    found = set(chain.from_iterable([_hashed[w] for w in set(_WORD.findall(text.lower()))]))
    return np.sort(np.fromiter(found, np.int64, len(found)))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE) -> DataFrame:
    """text and label of at most ``rows`` labelled documents; null labels don't count, of repeated ids the largest label and the least text do."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.join(F.broadcast(some), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")


def within(found: DataFrame, column: str, most: int = SAMPLE_BYTES) -> DataFrame:
    """Of the encoded rows of a sample, in the order in which it was drawn, those up to which ``column`` has ``most`` bytes.

    ``found`` is written once; the order is found from ids and sizes alone, SAMPLE of them at most.
    """
    found = settle(found)
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id")
    fits = found.select("doc_id", F.sum(F.octet_length(column)).over(order).alias("upto")).where(F.col("upto") <= most).select("doc_id")
    return found.join(F.broadcast(fits), "doc_id", "left_semi")


def _association(counts, hits, n: int, positive: float):
    """Chi-square statistic of each bucket's presence and the label."""
    a, b, c, d = hits, counts - hits, positive - hits, n - positive - counts + hits
    return n * (a * d - b * c) ** 2 / np.maximum(counts * positive * (n - counts) * (n - positive), 1)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class FactorizationMachine:
    def __init__(self, active: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray):
        self.active, self.w0, self.w, self.v = active, w0, w, v

    @classmethod
    def fit(cls, rows: list[np.ndarray], y: np.ndarray, seed: int = 7) -> FactorizationMachine:
        """AdaGrad over mini-batches, with a penalty on weights and factors. Equal rows in equal order give equal models."""
        counts, hits = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS)
        for i in range(0, len(rows), 512):  # some rows at a time: the sample is held once, as 32-bit numbers
            part = rows[i : i + 512]
            flat = np.concatenate(part)
            counts += np.bincount(flat, minlength=BUCKETS)
            hits += np.bincount(flat, np.repeat(y[i : i + 512], [len(r) for r in part]), BUCKETS)
        active = np.flatnonzero(counts >= LEAST)
        counts, hits = counts[active], hits[active]
        steps = np.where(_association(counts, hits, len(y), y.sum()) >= ASSOCIATION, FAST, SLOW)
        rate = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        rng = np.random.default_rng(seed)
        m = cls(active, float(np.log(rate / (1 - rate))), np.zeros(len(active)), rng.normal(0, 0.02, (len(active), FACTORS)))
        if not len(active) or not 0 < y.mean() < 1:
            return m
        own = [m._own(r).astype(np.int32) for r in rows]
        gw, gv, g0 = np.full(len(active), 1e-2), np.full((len(active), FACTORS), 1e-2), 1e-2
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for i in range(0, len(order), BATCH):
                part = [own[k] for k in order[i : i + BATCH]]
                idx, n = np.concatenate(part), np.array([len(x) for x in part])
                row = np.repeat(np.arange(len(part)), n)
                z, sums = m._logits(idx, row, len(part))
                e = (_sigmoid(z) - y[order[i : i + BATCH]]) / len(part)
                used, where = np.unique(idx, return_inverse=True)
                er = e[row]
                dw = np.bincount(where, er, len(used)) + 1e-5 * m.w[used]
                g0 += e.sum() ** 2
                m.w0 -= 0.1 * e.sum() / np.sqrt(g0)
                vi = m.v[idx]
                dv = np.stack([np.bincount(where, er * (sums[row, f] - vi[:, f]), len(used)) for f in range(FACTORS)], 1) + 1e-4 * m.v[used]
                gw[used] += dw**2
                gv[used] += dv**2
                m.w[used] -= steps[used] * dw / np.sqrt(gw[used])
                m.v[used] -= PAIRS * dv / np.sqrt(gv[used])
        return m

    def _own(self, buckets: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.active, buckets)
        at[at == len(self.active)] = 0
        return at[self.active[at] == buckets] if len(self.active) else at[:0]

    def _logits(self, idx: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        v = self.v[idx]
        sums = np.stack([np.bincount(row, v[:, f], n) for f in range(FACTORS)], 1)
        squares = np.bincount(row, (v**2).sum(1), n)
        return self.w0 + np.bincount(row, self.w[idx], n) + 0.5 * ((sums**2).sum(1) - squares), sums

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        own = [self._own(r) for r in rows]
        idx = np.concatenate(own) if own else np.zeros(0, np.int64)
        return _sigmoid(self._logits(idx, np.repeat(np.arange(len(own)), [len(x) for x in own]), len(own))[0])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE) -> FactorizationMachine:
    """The model of at most ``rows`` labelled documents, of SAMPLE_BYTES when encoded."""

    def each(batch):
        yield batch_of(doc_id=batch.column(0), y=batch.column(2), terms=pa.array([terms(t).astype(np.int32).tobytes() for t in texts(batch)], pa.binary()))
        _hashed.clear()

    encoded = within(arrow_map(sample(docs, labels, label, rows), each, "doc_id long, y int, terms binary"), "terms")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))  # some at a time, so that the driver's JVM never holds the whole sample
    found = pa.concat_tables([encoded.where(part == k).toArrow() for k in range(PARTS)])
    order = np.argsort(found["doc_id"].to_numpy(), kind="stable")
    y, found = found["y"].to_numpy()[order].astype(float), found["terms"]
    terms_of = [np.frombuffer(found[i].as_buffer(), np.int32) for i in order]
    del found
    model = FactorizationMachine.fit(terms_of, y)
    give_back()
    return model


def scorer(model: FactorizationMachine):
    """A column function: text to score, 0 to 1."""
    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in parts:
            out = [model.score([terms(t) for t in part]) for part in groups([t or "" for t in text])]
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))
        _hashed.clear()  # workers stay; what they remember needn't
        give_back()

    return score


def scored(docs: DataFrame, labels: DataFrame, learn=None) -> DataFrame:
    """doc_id, score and predicted (1 from 0.5 on) of every row; null text counts as empty. Labels of rows outside ``learn`` aren't read.

    Without labels of both values every row gets the rate of label 1 (0.5 if there is none).
    """
    model = fit(docs, labels if learn is None else labels.where(learn))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(scorer(model)(F.col("text").cast("string")), F.lit(0.0)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    out = held_out(5, 0)
    rows = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~out)
    return rows.select("doc_id", out.alias("held_out"), "score", "predicted")
