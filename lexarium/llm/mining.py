"""Hard negatives by segment summaries: the rows that score close to, but not too close to, an anchor's positives.

Each vector is cut into 1, 4 and 16 segments; of each segment its mean and its deviation (the length of what is left without the mean)
are stored beside the vector. The product of two segments lies within the means' product, plus or minus the deviations' product, so the
sums bound the score. An anchor's candidates in a block are bounded coarsely first; those that can still be among the rows asked for are
bounded by finer segments, and what is left then is scored exactly, in integers. Groups of anchors meet classes of blocks, each pair in a
group of its own that keeps only as many rows an anchor as can be in the answer; a window over the anchor's rows merges the classes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import batch_of, settle, table

#: Vectors of a block, anchors of a group, blocks of a class on the average.
BLOCK, GROUP, CLASS = 4096, 1024, 2
SEGMENTS = (1, 4, 16)
#: Integers are exact in a double below this.
EXACT = 1 << 53
#: Rows of a block that are scored before bounds of the finest segments exclude others.
PROBE = 48


def matrix(lists: pa.ListArray, dim: int) -> np.ndarray:
    """Vectors as rows of doubles; shorter ones end in zeros."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == dim).all():
        return flat.reshape(len(lengths), dim)
    out = np.zeros((len(lengths), dim))
    out[np.arange(dim) < lengths[:, None]] = flat
    return out


def summaries(vectors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each number of segments: means (times the root of the segment's length) and deviations, a column a segment."""
    out = []
    for parts in SEGMENTS:
        edges = np.unique(np.arange(parts) * vectors.shape[1] // parts)
        lengths = np.diff(np.append(edges, vectors.shape[1]))
        sums = np.add.reduceat(vectors, edges, axis=1) if vectors.size else np.zeros((len(vectors), len(edges)))
        squares = np.add.reduceat(vectors**2, edges, axis=1) if vectors.size else sums
        means = sums / np.sqrt(np.maximum(lengths, 1))
        out.append((means, np.sqrt(np.maximum(squares - means**2, 0))))
    return out


def products(vectors: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Exact inner products of integers; beyond 64 bits they stay at the largest or smallest long."""
    if not vectors.size or np.abs(vectors).max() * np.abs(anchor).max() * len(anchor) < EXACT:
        return (vectors @ anchor).astype(np.int64)
    whole = [int(x) for x in anchor]
    return np.array([min(max(sum(int(x) * y for x, y in zip(v, whole, strict=True)), -(1 << 63)), (1 << 63) - 1) for v in vectors], np.int64)


class Goal:
    """The first k rows whose score is from ``least`` to ``most``: higher scores first, ties by id, then by row."""

    def __init__(self, least: float, most: float, k: int):
        self.least, self.most, self.k = least, most, k
        self.scores = self.ids = self.rows = np.zeros(0, np.int64)

    def threshold(self) -> float:
        return max(self.least, self.scores[-1]) if len(self.scores) == self.k else self.least

    def add(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        fit = (scores >= self.least) & (scores <= self.most)
        all_ = [np.concatenate(x) for x in ((self.scores, scores[fit]), (self.ids, ids[fit]), (self.rows, rows[fit]))]
        best = np.lexsort((all_[2], all_[1], -all_[0]))[: self.k]
        self.scores, self.ids, self.rows = (x[best] for x in all_)


def search(goals: list[Goal], vector: np.ndarray, sums: list, block: tuple, at: np.ndarray) -> int:
    """Brings the block's rows ``at`` to the goals; the number of rows that were scored exactly.

    Level by level of segments rows go that no goal can take: below its threshold at most, or above its range at least. At the finest level
    those of the highest middle are scored first, which raises the thresholds for the others.
    """
    own, ids, _, _, vectors, summed = block
    scored = 0

    def score(at: np.ndarray) -> int:
        scores = products(vectors[at], vector)
        for goal in goals:
            goal.add(scores, ids[at], own[at])
        return len(at)

    for level, ((means, devs), (mean, dev)) in enumerate(zip(summed, sums, strict=True), 1):
        middle, reach = means[at] @ mean, devs[at] @ dev
        reach += 0.01 + 1e-9 * (np.abs(middle) + reach)  # rounding of doubles never excludes a row
        rest = np.arange(len(at))
        if level == len(SEGMENTS) and len(at) > PROBE:
            order = np.argpartition(-middle, PROBE)
            scored, rest = score(at[order[:PROBE]]), order[PROBE:]
        keep = np.zeros(len(rest), bool)
        for goal in goals:
            keep |= (middle[rest] + reach[rest] >= goal.threshold()) & (middle[rest] - reach[rest] <= goal.most)
        at = at[rest[keep]]
    return scored + score(at)


def _packed(rows: DataFrame, dim: int) -> DataFrame:
    """Blocks of vectors with their summaries. A row's number is unique."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK):
                part = batch.slice(begin, BLOCK)
                ids, labels, anchors = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3))
                vectors = matrix(part.column(2), dim)
                small = next((t for t in (np.int16, np.int32) if not vectors.size or np.abs(vectors).max() <= np.iinfo(t).max), np.int64)
                stored = [x.tobytes() for pair in summaries(vectors) for x in pair]
                content = [ids.astype(np.int64).tobytes(), labels.astype(np.int64).tobytes(), anchors.astype(np.int8).tobytes(), vectors.astype(small).tobytes(), *stored]
                yield batch_of(block=pa.array([at], pa.int64()), n=pa.array([part.num_rows], pa.int32()), kind=[np.dtype(small).name], content=pa.array([content], pa.list_(pa.binary())))
                at += part.num_rows

    return rows.select("vec_id", "label", "q", "anchor").mapInArrow(run, "block long, n int, kind string, content array<binary>")


def _unpacked(block: dict, dim: int) -> tuple:
    """row numbers, ids, labels, anchors, vectors, summaries of a block."""
    ids, labels, anchors, vectors, *stored = block["content"]
    n = block["n"]
    wide = np.frombuffer(vectors, block["kind"]).reshape(n, dim).astype(np.float64)
    parts = [np.frombuffer(x, np.float64).reshape(n, -1) for x in stored]
    return block["block"] + np.arange(n), np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), np.frombuffer(anchors, np.int8), wide, list(zip(parts[::2], parts[1::2], strict=True))


def _anchors(blocks: DataFrame, dim: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for block in batch.to_pylist():
                rows, ids, labels, anchors, vectors, _ = _unpacked(block, dim)
                at = np.flatnonzero(anchors)
                yield batch_of(anchor=rows[at], anchor_id=ids[at], label=labels[at], q=pa.array(list(vectors[at].astype(np.int64)), pa.list_(pa.int64())))

    return blocks.mapInArrow(run, "anchor long, anchor_id long, label long, q array<long>")


def _meet(anchors: DataFrame, blocks: DataFrame, n: tuple[int, int], dim: int, each: Callable, schema: str) -> DataFrame:
    """The rows that ``each`` (of an anchor's row, its vector, its summaries and blocks) gives for all of n[0] anchors and all blocks, of n[1] rows."""
    i, j = max(1, -(-n[0] // GROUP)), max(1, -(-n[1] // (BLOCK * CLASS)))
    own = lambda c, many: F.pmod(F.xxhash64(c), F.lit(many))
    all_ = lambda many: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long")))
    left = anchors.withColumns({"i": own("anchor", i), "j": all_(j)})
    right = blocks.withColumns({"j": own("block", j), "i": all_(i)})

    def pair(of: pa.Table, with_: pa.Table) -> pa.Table:
        found = []
        if of.num_rows:
            vectors = matrix(of["q"].combine_chunks(), dim)
            sums = summaries(vectors)
            all_blocks = [_unpacked(b, dim) for b in with_.to_pylist()]
            for a, row in enumerate(of.drop_columns(["q"]).to_pylist()):
                found += each(row, vectors[a], [(m[a], d[a]) for m, d in sums], all_blocks)
        return pa.Table.from_pylist(found, schema=pa.schema([(c, pa.int64()) for c in schema.replace(" long", "").split(", ")]))

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(pair, schema)


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: vec_id long, label long, q array<long>; ``anchor`` is a condition on them. A score is the inner product. An anchor's positives are the first
    rows of its label other than itself, a positive's negatives the first rows of other labels whose score is ``low`` to ``high`` hundredths of
    the positive's, all ordered by score and then by the smaller vec_id. A positive without such rows (one of a negative score always) gives none.
    Rows with a null in any of the three columns take no part; null components count as 0, and shorter vectors end in zeros. Rows that
    repeat a vec_id are rows of their own. An empty table, or one without anchors, gives no row. Other columns don't matter.
    """
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.transform("q", lambda x: F.coalesce(x, F.lit(0)).cast("long")).alias("q"), F.coalesce(anchor, F.lit(False)).alias("anchor")).where("vec_id is not null and label is not null and q is not null")
    dim = rows.agg(F.max(F.size("q"))).first()[0] or 0
    dim = max(dim, 1)
    blocks = settle(_packed(rows, dim))
    anchors = settle(_anchors(blocks, dim))
    n = anchors.count(), blocks.agg(F.sum("n")).first()[0] or 0

    def positives_of(row, vector, sums, with_):
        goal = Goal(-np.inf, np.inf, positives)
        for block in with_:
            search([goal], vector, sums, block, np.flatnonzero((block[2] == row["label"]) & (block[0] != row["anchor"])))
        return [{"anchor": row["anchor"], "positive": r, "positive_id": i, "positive_score": s} for r, i, s in zip(goal.rows.tolist(), goal.ids.tolist(), goal.scores.tolist(), strict=True)]

    near = _meet(anchors, blocks, n, dim, positives_of, "anchor long, positive long, positive_id long, positive_score long")
    w = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id", "positive")
    near = near.withColumn("place", F.row_number().over(w)).where(F.col("place") <= positives)
    near = near.groupBy("anchor").agg(F.collect_list(F.struct("positive", "positive_id", "positive_score")).alias("positives"))
    with_positives = settle(anchors.join(near, "anchor"))

    def negatives_of(row, vector, sums, with_):
        goals = [Goal(-(-low * p["positive_score"] // 100), high * p["positive_score"] // 100, negatives) for p in row["positives"]]
        open_ = [g for g in goals if g.least <= g.most]
        for block in with_ if open_ else ():
            search(open_, vector, sums, block, np.flatnonzero(block[2] != row["label"]))
        return [
            {"anchor": row["anchor"], "anchor_id": row["anchor_id"], **p, "negative": r, "negative_id": i, "negative_score": s}
            for p, g in zip(row["positives"], goals, strict=True) for r, i, s in zip(g.rows.tolist(), g.ids.tolist(), g.scores.tolist(), strict=True)
        ]

    hard = _meet(with_positives, blocks, n, dim, negatives_of, "anchor long, anchor_id long, positive long, positive_id long, positive_score long, negative long, negative_id long, negative_score long")
    w = Window.partitionBy("anchor", "positive").orderBy(F.desc("negative_score"), "negative_id", "negative")
    hard = hard.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= negatives)
    return hard.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    v = v.where(F.coalesce(finite, F.lit(False)))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = v.select("vec_id", label.alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("q"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, a.label = b.label as same, b.vec_id, cast(list_dot_product(a.q, b.q) as bigint) as score
  from v a, v b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select * from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, p.vec_id as positive_id, cast(row_number() over (partition by p.anchor_id, p.vec_id order by s.score desc, s.vec_id) as integer) as rank,
  s.vec_id as negative_id, p.score as positive_score, s.score as negative_score
from p join s on s.anchor_id = p.anchor_id and not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score
qualify rank <= 10
"""
