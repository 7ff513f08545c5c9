"""Exact dedup by skew-safe combining.

Rows are combined three times, each time by comparing the whole normalised content and not only its
digest: inside an Arrow batch and a task (local), by (digest, salt), and over the salts of a digest. Only
digests with more than ``1/HOT`` of all rows are salted: there are at most ``HOT`` of them, so that list is
small whatever the input. A text thus moves once at most, and the winners of the salts of hot digests
a second time. Membership goes back to the documents by digest, without texts; that of hot digests by broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import HOT, arrow_batches, arrow_map, batch_of, helper, id_text, join_split, settle, texts
#: Parts of a hot digest.
SALTS = 64


def sha256(content: bytes) -> bytes:
    return hashlib.sha256(content).digest()


def normalised(text: str) -> bytes:
    """UTF-8 with A-Z, and only these, in lower case."""
    return text.encode().lower()


def _digests(docs: DataFrame, digest: Callable[[bytes], bytes]) -> DataFrame:
    def each(batch):
        yield batch_of(doc_id=batch.column(0), digest=pa.array([digest(normalised(t)) for t in texts(batch)], pa.binary()))

    return arrow_map(docs, each, "doc_id long, digest binary")


def _combined(docs: DataFrame, digest: Callable[[bytes], bytes]) -> DataFrame:
    """Distinct contents of each Arrow batch, with the largest id and the number of rows."""

    def each(batch):
        best: dict[bytes, list] = {}
        for i, t in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
            seen = best.setdefault(normalised(t), [None, 0])
            seen[1] += 1
            if i is not None and (seen[0] is None or i > seen[0]):
                seen[0] = i
        yield batch_of(
            digest=pa.array([digest(c) for c in best], pa.binary()), content=pa.array(list(best), pa.binary()),
            top=pa.array([x[0] for x in best.values()], pa.int64()), n=pa.array([x[1] for x in best.values()], pa.int64()),
        )

    return arrow_map(docs, each, "digest binary, content binary, top long, n long")


def _classes(rows: DataFrame, hot: list[bytes]) -> DataFrame:
    """One row per content: digest, top, n. ``contents`` counts the contents of a digest (1 unless digests collide)."""
    is_hot = F.col("digest").isin(hot) if hot else F.lit(False)
    salted = (
        rows.withColumn("salt", F.when(is_hot, F.pmod(F.spark_partition_id(), F.lit(SALTS))).otherwise(0))
        .groupBy("digest", "salt", "content").agg(F.max("top").alias("top"), F.sum("n").alias("n"))
    )
    # A content that isn't hot is complete here: it goes on without its bytes, told from others by a number of its own.
    winners = salted.select("digest", "top", "n", F.when(is_hot, F.col("content")).alias("content"), F.when(~is_hot, F.monotonically_increasing_id()).alias("own"))
    merged = winners.repartition("digest").groupBy("digest", "content", "own").agg(F.max("top").alias("top"), F.sum("n").alias("n"))
    return merged.groupBy("digest").agg(F.max("top").alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("contents"))


def exact_groups(docs: DataFrame, digest: Callable[[bytes], bytes] = sha256) -> DataFrame:
    """Each row of ``docs`` with its class of equal texts.

    Returns doc_id, keep_id (largest doc_id of the class), group_size, kept, digest (binary). Texts are equal
    when identical after lower-casing A-Z. Null text counts as empty. Rows that repeat both doc_id and text
    are members of their own, of which exactly one is kept. A null doc_id is below any other; a class that has
    only null ids has keep_id null and one row kept. An empty table gives an empty result.
    """
    docs = id_text(docs)
    with arrow_batches(docs.sparkSession):
        ids = settle(_digests(docs, digest).withColumn("row", F.monotonically_increasing_id()))
    # the row to stay: the largest id, and of several rows with it the last
    tops = settle(ids.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "row")).alias("top")))
    total = ids.count()
    hot = [bytes(r["digest"]) for r in tops.where(F.col("n") > max(1, total // HOT)).limit(HOT).collect()]  # the limit never cuts: see HOT
    with arrow_batches(docs.sparkSession, 4000):
        classes = settle(_classes(_combined(docs, digest), hot))
    plain = classes.where("contents = 1").select("digest", F.col("top").alias("keep_id"), F.col("n").alias("group_size"))
    known = plain.join(tops.select("digest", "n", F.col("top.row").alias("stays")), "digest")
    out = join_split(ids, known, "digest", total)
    collided = classes.where("contents > 1").select("digest")
    if not collided.isEmpty():
        # different contents with one digest: these few are told apart by content in a join of their own
        def each(batch):
            ts = [normalised(t) for t in texts(batch)]
            yield batch_of(doc_id=batch.column(0), digest=pa.array([digest(t) for t in ts], pa.binary()), content=pa.array(ts, pa.binary()))

        rows = arrow_map(docs, each, "doc_id long, digest binary, content binary").join(collided, "digest", "left_semi")
        rows = settle(rows.withColumn("row", F.monotonically_increasing_id()))
        sizes = rows.groupBy("digest", "content").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "row")).alias("top"))
        out = out.unionByName(rows.join(sizes.withColumn("stays", F.col("top.row")), ["digest", "content"]).select(*out.columns))
    return out.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("stays")).alias("kept"), "digest")


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class of equal texts: the one with the largest doc_id. All columns stay.

    Null text counts as empty. Of rows that repeat both doc_id and text one stays.
    """
    groups = settle(exact_groups(docs))
    n, has = helper("rows", docs), docs.columns
    id_, digest = helper("id", docs), helper("digest", docs)
    stays = groups.where("kept").select(F.col("doc_id").alias(id_), F.col("digest").alias(digest))
    lower = F.translate(F.coalesce(F.col("text"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # a repeated id may stand for several texts, of which others stay, or for the same text twice
    repeated = groups.groupBy(F.col("doc_id").alias(id_), F.col("digest").alias(digest)).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > 1)
    twice = not repeated.isEmpty()
    if twice:
        stays = stays.join(repeated, (stays[id_].eqNullSafe(repeated[id_])) & (stays[digest] == repeated[digest]), "left").select(stays[id_], stays[digest], n)
    found = docs.join(stays, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)))
    found = found.where(F.unhex(F.sha2(lower, 256)) == F.col(digest))
    once = found.where(F.col(n).isNull()) if twice else found
    if not twice:
        return once.select(*has)
    one = found.where(F.col(n).isNotNull()).groupBy(id_, digest).agg(F.first(F.struct(*has)).alias(n))
    return once.select(*has).unionByName(one.select(*[F.col(n)[c].alias(c) for c in has]))


def query(spark, sf_dir: str) -> DataFrame:
    from ._common import table

    return exact_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


SQL = """
with d as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
  from documents)
select doc_id, max(doc_id) over (partition by text_sha256) as keep_id,
  count(*) over (partition by text_sha256) as group_size,
  doc_id = max(doc_id) over (partition by text_sha256) as kept, text_sha256
from d
"""
