"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage is encoded from its bytes and word hashes; a gated attention
layer, learned from document labels alone, weighs the passages' hidden vectors (softmax of w . (tanh(V h) * sigmoid(U h))), and
the document's score is a logistic function of their weighted sum.

The model is fitted on at most SAMPLE labelled rows; a passage's encoding and the weights have fixed sizes. Whole texts are
encoded, in groups of documents of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map, batch_of, groups, held_out, table, texts
from .toxicity import sample, within

PASSAGE = 64
#: Labelled rows that the model is fitted on, at most.
SAMPLE = 12_000
HIDDEN, ATTENTION = 16, 8
EPOCHS = 25
BATCH = 128
_CLASSES = 16
_HASHED = 16
FEATURES = _CLASSES + _HASHED + 5


def _byte_classes() -> np.ndarray:
    kind = np.full(256, 12, np.uint8)
    for k, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r\t", "!", "?", ".", ",;:", "|", "#$%&*@^~=+<>", "\"'()[]{}`")):
        kind[list(chars.encode())] = k
    kind[list(b"-_/\\")] = 13
    kind[128:192] = 14
    kind[192:] = 15
    return kind


_KIND = _byte_classes()
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(0, n - 1), base, np.uint64)]))[:n]


def encode(group: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (rows), and the number of passages of each text: 1 at least. Those of a text are its own, whatever is beside it."""
    raw = [t.encode("utf-8", "surrogatepass") for t in group]
    b = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    if not group:
        return np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64)
    lengths = np.array([len(x) + 1 for x in raw])
    doc_of = np.repeat(np.arange(len(raw)), lengths)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    ends = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
    word_doc = doc_of[starts]
    n_words = np.bincount(word_doc, minlength=len(raw))
    first_word = np.cumsum(n_words) - n_words
    within = np.arange(len(starts)) - first_word[word_doc]
    n_passages = np.maximum(1, -(-n_words // PASSAGE))
    first_passage = np.cumsum(n_passages) - n_passages
    word_passage = first_passage[word_doc] + within // PASSAGE
    total = int(n_passages.sum())
    # bytes belong to the passage of the last word that began before them
    byte_passage = first_passage[doc_of]
    np.maximum.at(byte_passage, starts, word_passage)
    byte_passage = np.maximum.accumulate(byte_passage)
    bytes_in = np.bincount(byte_passage, minlength=total).clip(1)
    out = np.zeros((total, FEATURES), np.float32)
    out[:, :_CLASSES] = np.bincount(byte_passage * _CLASSES + _KIND[b], minlength=total * _CLASSES).reshape(total, _CLASSES) / bytes_in[:, None]
    words_in = np.bincount(word_passage, minlength=total).clip(1)
    with np.errstate(over="ignore"):
        lower = np.where(_KIND[b] == 1, b + np.uint8(32), b).astype(np.uint64) + np.uint64(1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(lower * _powers(len(b), _BASE), dtype=np.uint64)])
        back = _powers(len(b), np.uint64(pow(int(_BASE), -1, 1 << 64)))
        h = (sums[ends] - sums[starts]) * back[starts] if len(starts) else np.zeros(0, np.uint64)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        whole = np.flatnonzero(word_doc[:-2] == word_doc[2:])  # first words of three that are of one text
        three = h[whole] * np.uint64(3) + h[whole + 1] * np.uint64(5) + h[whole + 2] * np.uint64(7)
        in_doc = three ^ (word_doc[whole].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        in_passage = h ^ (word_passage.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    out[:, _CLASSES : _CLASSES + _HASHED] = np.bincount(word_passage * _HASHED + (h % np.uint64(_HASHED)).astype(np.int64), minlength=total * _HASHED).reshape(total, _HASHED) / words_in[:, None]
    k = _CLASSES + _HASHED
    out[:, k] = np.bincount(word_passage, ends - starts, total) / words_in / 10
    _, first = np.unique(in_passage, return_index=True)
    out[:, k + 1] = np.bincount(word_passage[first], minlength=total) / words_in
    _, inverse, counts = np.unique(in_doc, return_inverse=True, return_counts=True)
    out[:, k + 2] = np.bincount(word_passage[whole], counts[inverse] > 1, total) / words_in
    out[:, k + 3] = np.bincount(byte_passage[1:], (b[1:] == b[:-1]) & (doc_of[1:] == doc_of[:-1]), total) / bytes_in
    out[:, k + 4] = np.log1p(n_words)[np.repeat(np.arange(len(raw)), n_passages)] / 10
    return out, n_passages


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class GatedAttention:
    """Parameters as a dict of arrays; forward and backward passes over bags laid end to end."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p

    def forward(self, x: np.ndarray, sizes: np.ndarray):
        p = self.p
        f = (x - p["mean"]) / p["std"]
        h = np.tanh(f @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        s = (t * g) @ p["w"]
        at = np.cumsum(sizes) - sizes
        bag = np.repeat(np.arange(len(sizes)), sizes)
        e = np.exp(s - np.maximum.reduceat(s, at)[bag])
        a = e / np.add.reduceat(e, at)[bag]
        z = np.add.reduceat(a[:, None] * h, at, axis=0)
        return _sigmoid(z @ p["c"] + p["d"][0]), (f, h, t, g, a, z, at, bag)

    def score(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return self.forward(x.astype(np.float64), sizes)[0] if len(sizes) else np.zeros(0)

    @classmethod
    def fit(cls, x: np.ndarray, sizes: np.ndarray, y: np.ndarray, seed: int = 11) -> GatedAttention:
        rng = np.random.default_rng(seed)
        x = x.astype(np.float64)
        rate = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        p = {
            "mean": x.mean(0) if len(x) else np.zeros(FEATURES), "std": x.std(0) + 1e-3 if len(x) else np.ones(FEATURES), "W": rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN),
            "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)), "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)), "w": rng.normal(0, ATTENTION**-0.5, ATTENTION), "c": np.zeros(HIDDEN), "d": np.array([np.log(rate / (1 - rate))]),
        }
        m = cls(p)
        if not len(y) or not 0 < y.mean() < 1:
            return m
        names = [k for k in p if k not in ("mean", "std")]
        m1, m2 = {k: np.zeros_like(p[k]) for k in names}, {k: np.zeros_like(p[k]) for k in names}
        first, step = np.cumsum(sizes) - sizes, 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for i in range(0, len(order), BATCH):
                pick = order[i : i + BATCH]
                rows = np.concatenate([np.arange(first[k], first[k] + sizes[k]) for k in pick])
                grads = m._gradients(x[rows], sizes[pick], y[pick])
                step += 1
                for k in names:
                    g = grads[k] + 1e-4 * p[k] * (k not in "bd")
                    m1[k] = 0.9 * m1[k] + 0.1 * g
                    m2[k] = 0.999 * m2[k] + 0.001 * g**2
                    p[k] -= 0.005 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
        return m

    def _gradients(self, x, sizes, y):
        p = self.p
        score, (f, h, t, g, a, z, at, bag) = self.forward(x, sizes)
        e = (score - y) / len(y)
        dz = e[:, None] * p["c"][None, :]
        dh = a[:, None] * dz[bag]
        da = (h * dz[bag]).sum(1)
        ds = a * (da - np.add.reduceat(a * da, at)[bag])
        dtg = ds[:, None] * p["w"][None, :]
        dt, dg = dtg * g * (1 - t**2), dtg * t * g * (1 - g)
        dh += dt @ p["V"].T + dg @ p["U"].T
        dpre = dh * (1 - h**2)
        return {"c": z.T @ e, "d": np.array([e.sum()]), "w": (t * g).T @ ds, "V": h.T @ dt, "U": h.T @ dg, "W": f.T @ dpre, "b": dpre.sum(0)}


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE) -> GatedAttention:
    """The model of at most ``rows`` labelled documents, of SAMPLE_BYTES when encoded."""

    def each(batch):
        ts, ids, ys = texts(batch), batch.column(0).to_pylist(), batch.column(2).to_pylist()
        at = 0
        for part in groups(ts):
            x, sizes = encode(part)
            split = np.split(x, np.cumsum(sizes)[:-1])
            yield batch_of(doc_id=pa.array(ids[at : at + len(part)], pa.int64()), y=pa.array(ys[at : at + len(part)], pa.int32()), x=pa.array([s.tobytes() for s in split], pa.binary()))
            at += len(part)

    found = within(arrow_map(sample(docs, labels, label, rows), each, "doc_id long, y int, x binary"), "x").toArrow().sort_by("doc_id")
    bags = [np.frombuffer(v, np.float32).reshape(-1, FEATURES) for v in found["x"].to_pylist()]
    return GatedAttention.fit(np.concatenate(bags) if bags else np.zeros((0, FEATURES)), np.array([len(v) for v in bags], np.int64), np.array(found["y"].to_pylist(), float))


def scored(docs: DataFrame, labels: DataFrame, learn=None) -> DataFrame:
    """doc_id, score and predicted (1 from 0.3 on) of every row; null text counts as empty, which is one passage without words.

    Labels of rows outside ``learn`` aren't read. Without labels of both values every row gets the rate of label 1 (0.5 if there is none).
    """
    model = fit(docs, labels if learn is None else labels.where(learn))

    def each(batch):
        ts, ids, at = texts(batch), batch.column(0), 0
        for part in groups(ts):
            s = np.round(model.score(*encode(part)), 9)  # so that it doesn't depend on the texts beside
            yield batch_of(doc_id=ids.slice(at, len(part)), score=pa.array(s, pa.float64()), predicted=pa.array((s >= 0.3).astype(np.int32), pa.int32()))
            at += len(part)

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(text, each, "doc_id long, score double, predicted int")


def query(spark, sf_dir: str) -> DataFrame:
    out = held_out(5, 0)
    rows = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~out)
    return rows.select("doc_id", out.alias("held_out"), "score", "predicted")
