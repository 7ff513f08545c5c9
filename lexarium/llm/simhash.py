"""SimHash near-dedup by multi-index hashing.

A 64-bit fingerprint has two segments of 32 bits. Fingerprints that differ in up to five bits differ in at most two bits of
one of them. Each distinct fingerprint is filed under the 33 values within one bit of each segment: segments that
differ in up to two bits then share a value. Fingerprints that meet in a bucket are verified over all 64 bits.

Most buckets hold one fingerprint and are dropped by a count. A bucket of two gives its pair, one of up to ``SMALL`` is
compared in place, and a larger one is dealt in blocks to tasks that return only a spanning star of each
component they find: no bucket emits all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map, batch_of, helper, id_text, join_split, settle, table, texts
from .components import star_components

#: Bits in which linked fingerprints may differ; the balls find all links of up to MOST_BITS.
BITS = 4
MOST_BITS = 5
SEED = 42
#: A bucket up to this size is compared in place.
SMALL = 32
#: Fingerprints of a block of a large bucket.
BLOCK = 2048
#: Keys that may be broadcast (8 bytes each).
MAX_BROADCAST_KEYS = 200_000
_MASKS = [0] + [1 << i for i in range(32)]


def fingerprint(text: str, shingle: int = 4) -> int:
    """Unsigned 64-bit SimHash of the word shingles of ``text``; 0 if it has no word."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        first = [0, *ends[: len(words) - shingle].tolist()]
        last = (ends[shingle - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = np.array(hashes[i : i + 65536], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, fp (the 64 bits as a long). Null text counts as empty; text without a word has fp 0."""

    def each(batch):
        fps = np.array([fingerprint(t, shingle) for t in texts(batch)], "<u8").view("<i8")
        yield batch_of(doc_id=batch.column(0), fp=pa.array(fps, pa.int64()))

    return arrow_map(id_text(docs), each, "doc_id long, fp long")


def _keys(distinct: DataFrame) -> DataFrame:
    """Each fingerprint under the values within one bit of each segment; the segment's number is above the 32 bits."""
    masks = F.lit(_MASKS).cast("array<bigint>")
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    both = F.concat(F.transform(masks, lambda m: high.bitwiseXOR(m)), F.transform(masks, lambda m: low.bitwiseXOR(m).bitwiseOR(F.lit(1 << 32))))
    return distinct.select("fp", F.explode(both).alias("key"))


def _stars(pdf: pd.DataFrame, bits: int) -> pd.DataFrame:
    """Links of one block, or between two: of each component that they form, every member with its smallest."""
    fps = np.unique(pdf["fp"].to_numpy())
    label = np.arange(len(fps))
    near = []
    for i in range(0, len(fps), 256):
        d = np.bitwise_count(fps[i : i + 256, None].view("u8") ^ fps[None, :].view("u8")) <= bits
        near.append(np.nonzero(d))
    rows = np.concatenate([r + 256 * i for i, (r, _) in enumerate(near)])
    cols = np.concatenate([c for _, c in near])
    while True:
        lower = label.copy()
        np.minimum.at(lower, rows, label[cols])
        lower = lower[lower]
        if (lower == label).all():
            break
        label = lower
    far = label != np.arange(len(fps))
    return pd.DataFrame({"a": fps[label[far]], "b": fps[far]})


def links(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints such that what they connect is what all pairs within ``bits`` connect.

    Every link of a bucket of up to SMALL is there; of larger buckets, a spanning star for each component of each block pair.
    """
    if bits > MOST_BITS:
        raise ValueError(f"bits: {MOST_BITS} at most")

    def _close(a, b):
        return F.bit_count(a.bitwiseXOR(b)) <= bits

    buckets = settle(
        _keys(distinct).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    )
    pairs = buckets.where("n = 2").select("a", "b").where(_close(F.col("a"), F.col("b")))
    many = buckets.where("n > 2").select("key", "n")
    n_many = many.count()
    if n_many:
        members = settle(_keys(distinct).join(F.broadcast(many) if n_many <= MAX_BROADCAST_KEYS else many, "key"))
        small = members.where(F.col("n") <= SMALL).groupBy("key").agg(F.collect_set("fp").alias("fps"))
        found = F.flatten(F.transform("fps", lambda x: F.transform(F.filter("fps", lambda y: (x < y) & _close(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
        pairs = pairs.unionByName(small.select(F.explode(found).alias("p")).select("p.a", "p.b"))
        large = members.where(F.col("n") > SMALL).withColumn("of", F.ceil(F.col("n") / BLOCK))
        own = large.withColumn("i", F.pmod(F.xxhash64("fp"), F.col("of")))
        dealt = own.withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("of") - 1)))
        dealt = dealt.select("key", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "fp")
        pairs = pairs.unionByName(dealt.groupBy("key", "i", "j").applyInPandas(lambda pdf: _stars(pdf, bits), "a long, b long"))
    return pairs.distinct()


def near_groups(docs: DataFrame, shingle: int = 4, bits: int = BITS) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable over links of at most ``bits`` bits) of each row.

    Texts without a word have fingerprint 0 and link like any other. Rows that share an id each have a row. Null ids are
    ignored when the smallest is taken; a component with none but null ids has component_id null.
    """
    fps = settle(fingerprints(docs, shingle))
    classes = settle(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    stars = star_components(links(classes.select("fp"), bits))  # b -> a
    found = components(classes, stars, "fp")
    return join_split(fps, found, "fp", fps.count())


def components(classes: DataFrame, stars: DataFrame, key: str) -> DataFrame:
    """(key, component_id, n): of ``classes`` (key, least, n) those in one star share the least of all."""
    roots = settle(classes.join(stars.select(F.col("b").alias(key), F.col("a").alias("root")), key, "left").withColumn("root", F.coalesce("root", key)))
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    return join_split(roots.select("root", key, F.col("n").alias("rows")), least, "root", roots.count()).select(key, "component_id", F.col("rows").alias("n"))


def drop_near_copies(docs: DataFrame, shingle: int = 5, bits: int = MOST_BITS) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the smallest doc_id. All columns stay.

    Rows with a null id stay. Of rows that share the smallest id all stay.
    """
    id_ = helper("id", docs)
    goes = near_groups(docs, shingle, bits).where("doc_id <> component_id").select(F.col("doc_id").alias(id_)).distinct()
    return docs.join(goes, F.col("doc_id").cast("long") == F.col(id_), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
