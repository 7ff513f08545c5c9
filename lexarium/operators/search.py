"""Exact inner-product search (I3, I4): blocks of queries meet blocks of vectors, and of clusters of vectors only those that can matter.

Vectors are clustered around pivots. With a cluster's largest angle to its pivot and its largest length, the angle between query and pivot bounds
every score in the cluster from above (triangle inequality on the sphere). Each query searches its own cluster first; the k-th score
found there, or the least score asked for, tells which other clusters it must see. Nothing but pivots and one row a cluster passes the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

#: Queries and vectors of the blocks that are compared with each other, and queries that are multiplied at once.
QUERY_BLOCK, VECTOR_BLOCK, AT_ONCE = 4096, 20_000, 256
#: Clusters at most, and vectors of a cluster on the average at least.
PIVOTS, CLUSTER = 256, 2000
#: Scores are compared as rounded to six digits.
SLACK = 1e-6


def _matrix(vectors: pa.ChunkedArray | pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the vectors of length ``dim`` and these as rows."""
    lists = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    at = np.flatnonzero(lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dim)
    flat = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return at, flat.reshape(len(at), dim)


def _lengths(vectors: pa.ChunkedArray) -> list[int]:
    return pc.unique(pc.list_value_length(vectors)).to_pylist()


def _in_blocks(rows: DataFrame, others: DataFrame, id_: str, sizes: tuple[int, int], on: list[str]) -> DataFrame:
    """rows, each in a block of its own and once for each block of ``others`` (with its value of ``on``): own, other.

    How many blocks there are is counted: rows meet counts, never each other here.
    """
    if on:
        blocks = lambda df, size, name: df.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / size).alias(name))
        rows = rows.join(blocks(rows, sizes[0], "_own").join(blocks(others, sizes[1], "_other"), on), on)
    else:
        rows = rows.withColumns({name: F.lit(-(-df.count() // size)).cast("long") for name, df, size in (("_own", rows, sizes[0]), ("_other", others, sizes[1]))})
    own = F.pmod(F.xxhash64(id_), F.greatest("_own", F.lit(1))).alias("own")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("_other") - 1, F.lit(0)))).alias("other")
    # under names of their own, so that the two sides of a search stay apart
    return rows.select(*[F.col(c).alias(c) for c in rows.columns if c not in ("_own", "_other")], own, each)


def _hits(queries: DataFrame, kb: DataFrame, k: int, min_score: float, on: list[str]) -> DataFrame:
    """query_id, vec_id, score: of each block the first k of a query; vectors of different lengths don't meet."""
    q = _in_blocks(queries, kb, "query_id", (QUERY_BLOCK, VECTOR_BLOCK), on).withColumnsRenamed({"own": "i", "other": "j"})
    v = _in_blocks(kb, queries, "vec_id", (VECTOR_BLOCK, QUERY_BLOCK), on).withColumnsRenamed({"own": "j", "other": "i"})
    schema = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField("vec_id", kb.schema["vec_id"].dataType), StructField("score", DoubleType())])

    def top(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        order = pc.rank(right["vec_id"], sort_keys="ascending", tiebreaker="first").to_numpy() if right.num_rows else None
        for dim in _lengths(left["embedding"]) if right.num_rows else ():
            (own_at, own), (all_at, all_) = _matrix(left["embedding"], dim), _matrix(right["embedding"], dim)
            for a in range(0, len(own), AT_ONCE) if len(all_) else ():
                for n, s in enumerate(np.nan_to_num(np.round(own[a : a + AT_ONCE] @ all_.T, 6), nan=-np.inf), a):
                    best = np.flatnonzero(s >= np.partition(s, -min(k, len(s)))[-min(k, len(s))])  # with all ties of the last
                    best = best[np.lexsort((order[all_at[best]], -s[best]))][:k]
                    best = best[(s[best] >= min_score) & np.isfinite(s[best])]
                    for out, x in zip(found, (np.full(len(best), own_at[n]), all_at[best], s[best]), strict=True):
                        out.append(x)
        own, other, score = map(np.concatenate, found)
        return pa.table({"query_id": left["query_id"].take(pa.array(own)), "vec_id": right["vec_id"].take(pa.array(other)), "score": pa.array(score)})

    key = [*on, "i", "j"]
    return q.groupBy(*key).cogroup(v.groupBy(*key)).applyInArrow(top, schema)


def ranked(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "vec_id", "rank", "score")


def _angles(vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angles to all pivots (a row a vector) and lengths; a vector of length 0 is at an angle of 0 to all."""
    lengths = np.linalg.norm(vectors, axis=1)
    unit = np.divide(vectors, lengths[:, None], out=np.zeros_like(vectors), where=lengths[:, None] > 0)
    return np.where(lengths[:, None] > 0, np.arccos(np.clip(unit @ pivots.T, -1, 1)), 0.0), lengths


def _clustered(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """rows with cluster (the nearest pivot; none for vectors of another length than the pivots'), angle and length."""
    fields = [StructField("cluster", LongType()), StructField("angle", DoubleType()), StructField("length", DoubleType())]

    def run(batches):
        for batch in batches:
            cluster, angle, length = np.full(batch.num_rows, -1), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            at, vectors = _matrix(batch.column("embedding"), pivots.shape[1])
            if len(at):
                angles, length[at] = _angles(vectors, pivots)
                cluster[at], angle[at] = angles.argmin(axis=1), angles.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster), pa.array(angle), pa.array(length)], names=[*batch.schema.names, "cluster", "angle", "length"])

    return rows.mapInArrow(run, StructType([*rows.schema, *fields]))


def pivots_of(kb: DataFrame, n: int) -> np.ndarray:
    """So many vectors of the most common length, unit length, in the order of a hash of their ids: at most PIVOTS rows at the driver."""
    finite = kb.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists("embedding", lambda x: x != 0))
    lengths = finite.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return np.zeros((0, 0))
    rows = finite.where(F.size("embedding") == lengths["n"]).orderBy(F.xxhash64("vec_id"), "vec_id").select("embedding").limit(min(n, PIVOTS)).toArrow()
    _, vectors = _matrix(rows["embedding"], lengths["n"])
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def upper_bounds(queries: np.ndarray, pivots: np.ndarray, radius: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """The most that a vector of each cluster can score, a row a query."""
    angles, lengths = _angles(queries, pivots)
    most = lengths[:, None] * longest[None, :] * np.cos(np.clip(angles - radius[None, :] - 1e-7, 0, np.pi))
    return np.maximum(most, 0) if (lengths == 0).any() else most


def _others(queries: DataFrame, pivots: np.ndarray, clusters: list, min_score: float) -> DataFrame:
    """A row for each query and each cluster, but its own, that can hold a row of its answer. ``kth``: the least score that counts so far."""
    numbers = np.array([r["cluster"] for r in clusters], np.int64)
    known = np.flatnonzero(numbers >= 0)
    radius, longest = (np.array([r[c] for r in clusters], np.float64) for c in ("radius", "longest"))
    fields = [f for f in queries.schema if f.name in ("query_id", "embedding")]

    def run(batches):
        for batch in batches:
            own, kth = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "kth"))
            needed = np.zeros((batch.num_rows, len(numbers)), bool)
            at, vectors = _matrix(batch.column("embedding"), pivots.shape[1])
            if len(at) and len(known):
                most = upper_bounds(vectors, pivots[numbers[known]], radius[known], longest[known])
                needed[np.ix_(at, known)] = ~(most < (np.fmax(kth[at], min_score) - SLACK)[:, None])
            needed &= numbers[None, :] != own[:, None]
            q, c = np.nonzero(needed)
            rows = pa.array(q)
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name).take(rows) for f in fields], pa.array(numbers[c])], names=[*[f.name for f in fields], "cluster"])

    return queries.mapInArrow(run, StructType([*fields, StructField("cluster", LongType())]))


def knn(queries: DataFrame, kb: DataFrame, k: int = 5, min_score: float = 0.6) -> DataFrame:
    """query_id, vec_id, rank, score: exact inner-product top k, scores to six digits, equal ones by vec_id. Ids are of any type.

    Null vectors don't count, nor do scores with a null or NaN component; vectors of different lengths don't meet.
    """
    queries, kb = (df.select(c, "embedding").where("embedding is not null") for df, c in ((queries, "query_id"), (kb, "vec_id")))
    n = kb.count() // CLUSTER
    pivots = pivots_of(kb, n) if n > 1 else ()
    if len(pivots) < 2:
        return ranked(_hits(queries, kb, k, min_score, []), k)
    own, others, vectors = _two_steps(queries, kb, pivots, k, min_score)
    return ranked(own.unionByName(_hits(others, vectors, k, min_score, ["cluster"])), k)


def _two_steps(queries: DataFrame, kb: DataFrame, pivots: np.ndarray, k: int, min_score: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hits in the queries' own clusters; the queries once for each other cluster that they must see; the clustered vectors."""
    vectors = _clustered(kb, pivots)
    clusters = vectors.groupBy("cluster").agg(F.max("angle").alias("radius"), F.max("length").alias("longest")).collect()  # PIVOTS + 1 rows at most
    near = _clustered(queries, pivots).drop("angle", "length")
    own = _hits(near, vectors.drop("angle", "length"), k, min_score, ["cluster"])
    kth = own.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.element_at(F.array_sort(F.collect_list("score"), lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0)), k)).alias("kth"))
    seen = near.join(kth, "query_id", "left").withColumn("kth", F.coalesce("kth", F.lit(float("-inf"))))
    return own, _others(seen, pivots, clusters, min_score), vectors.drop("angle", "length")


def pruning(queries: DataFrame, kb: DataFrame, k: int = 5, min_score: float = 0.6) -> DataFrame:
    """queries, clusters, needed: how many pairs of query and other cluster there are to search, of queries * (clusters - 1)."""
    queries, kb = (df.select(c, "embedding").where("embedding is not null") for df, c in ((queries, "query_id"), (kb, "vec_id")))
    pivots = pivots_of(kb, kb.count() // CLUSTER)
    _, others, vectors = _two_steps(queries, kb, pivots, k, min_score)
    return others.agg(F.count(F.lit(1)).alias("needed")).select(F.lit(queries.count()).alias("queries"), F.lit(vectors.select("cluster").distinct().count()).alias("clusters"), "needed")


def knn_filtered(queries: DataFrame, kb: DataFrame, on: str, k: int = 5, min_score: float = 0.6) -> DataFrame:
    """query_id, vec_id, rank, score: the exact top k among the rows of ``kb`` with the query's value of ``on``; as knn otherwise.

    The vectors of one value meet in as many blocks as they need.
    """
    queries, kb = (df.select(c, on, "embedding").where("embedding is not null") for df, c in ((queries, "query_id"), (kb, "vec_id")))
    return ranked(_hits(queries, kb, k, min_score, [on]), k)
