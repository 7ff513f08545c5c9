"""Near copies of a Jaccard similarity of 0.8 or more: candidates by multi-index hashing of wide SimHash fingerprints, verified on shingles.

A fingerprint has 512 bits over the distinct word shingles of a text, in segments of some 28 bits. Two texts of Jaccard similarity s have sets of
cosine c = 2s / (1 + s), and each bit differs with probability acos(c) / pi: 77 of 512 bits are expected at 0.8, give or take 8.
Such texts rarely agree in whole segments, but bits that differ are nearly always those whose votes were close. So a fingerprint
is filed, for each segment, under the small Hamming ball over its three least certain bits: 8 values. Two texts meet if
all bits that differ in some segment are uncertain in either. As some pairs of 0.8 never do, a text is also filed under the first
fifth of its hashes and one more, in an order that all texts share: two texts of similarity 0.8 have one of these in common. Shingles
that a sample shows to be common are last in this order, so they are hardly ever keys.

What meets is a candidate up to ``BITS``, far beyond what 0.8 lets expect. Candidates only propose: the components they form get the distinct
shingle hashes of their members, each once a block, and only pairs of similarity 0.8 on these are links.

Chance candidates of a text are 64 * segments / 2^bits of all others: the bits of a segment grow with the logarithm of the number of texts
(``segment_bits``), so these stay few at any size. Fewer segments lose nothing: what has no segment in common meets by its first hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_batches, arrow_map, batch_of, helper, id_text, join_split, settle, texts, tidy
from .components import star_components
from .simhash import components

SEED = 42
WORDS = 8
#: Uncertain bits of a segment that the ball flips.
LOOSE = 3
#: Bits in which candidates may differ. Similarity 0.8 lets expect 77 +- 8, and 96 +- 9 at worst (4 of 5 shingles): over four deviations more.
BITS = 138
#: Linked texts share this part of the shingles of both: 4 / 5.
ALIKE, OF = 4, 5
#: A shingle is common if so many of one in SAMPLED texts have it; at most MAX_COMMON, which any order allows.
COMMON, SAMPLED, MAX_COMMON = 20, 50, 100_000
#: Shingle hashes of a block of a large component of candidates.
PART = 1 << 20
#: Fingerprints of a block of a large bucket.
BLOCK = 2048
#: Bucket keys, or ids of near copies, that may be broadcast (8 bytes each).
MAX_BROADCAST_KEYS = 500_000
_STEPS = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def segment_bits(rows: int) -> int:
    """Bits of a segment for so many texts: ten more than would tell them apart, 20 to 48."""
    return min(48, max(20, (max(rows, 1) - 1).bit_length() + 10))


def shingle_hashes(text: str, shingle: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 of the word shingles; of all words where there are fewer; none for a text without words."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - shingle + 1)
    first, last = [0, *ends[: n - 1].tolist()], (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)], np.uint64))


def fingerprint(hashes: np.ndarray, segment: int = 28) -> tuple[bytes, bytes]:
    """The bits (64 bytes; the last are in no whole segment) and, for each segment, the places of its LOOSE least certain bits."""
    votes = np.zeros(64 * WORDS, np.int64)
    for i in range(0, len(hashes), 255):
        h = hashes[i : i + 255, None] + _STEPS[None, :]
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        votes += np.unpackbits(h.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    margin = 2 * votes - len(hashes)
    in_segments = np.abs(margin[: 64 * WORDS // segment * segment]).reshape(-1, segment)
    places = np.argsort(in_segments, axis=1, kind="stable")[:, :LOOSE]
    return np.packbits(margin > 0).tobytes(), places.astype(np.uint8).tobytes()


def fingerprints(docs: DataFrame, shingle: int = 5, segment: int = 28) -> DataFrame:
    """doc_id, set (digest of the distinct shingle hashes), n (how many), fp, loose, few (32 bits of each of the first hashes).

    Null text counts as empty; all texts without a word share one set.
    """

    last = common(docs, shingle)

    def first(h):
        late = np.isin(h, last, assume_unique=True) if len(last) else np.zeros(len(h), bool)
        return np.concatenate([h[~late], h[late]])[: len(h) // OF + 1].astype(np.uint32).tobytes()

    def each(batch):
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            found = [shingle_hashes(t, shingle) for t in texts(part)]
            both = [fingerprint(h, segment) for h in found]
            few = [first(h) for h in found]
            yield batch_of(
                doc_id=part.column(0), set=pa.array([_digest(h) for h in found], pa.binary()), n=pa.array([len(h) for h in found], pa.int64()),
                fp=pa.array([b[0] for b in both], pa.binary()), loose=pa.array([b[1] for b in both], pa.binary()), few=pa.array(few, pa.binary()),
            )

    return arrow_map(id_text(docs), each, "doc_id long, set binary, n long, fp binary, loose binary, few binary")


def common(docs: DataFrame, shingle: int = 5) -> np.ndarray:
    """Sorted hashes of the common shingles of a sample."""

    def each(batch):
        for at in range(0, batch.num_rows, 500):
            yield batch_of(h=pa.array(np.concatenate([shingle_hashes(t, shingle) for t in texts(batch.slice(at, 500))]).view(np.int64), pa.int64()))

    some = id_text(docs).where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0)
    most = arrow_map(some, each, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON).orderBy(F.desc("n"), "h").limit(MAX_COMMON)
    return np.sort(np.array(most.select("h").toArrow()["h"].to_pylist(), np.int64).view(np.uint64))


def _digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(hashes.tobytes(), SEED)


def _keys(classes: DataFrame, segment: int) -> DataFrame:
    """node under each key: the segment's number above one value of its ball; the first hashes, above all these."""
    flips, segments = (np.arange(2**LOOSE)[:, None] >> np.arange(LOOSE)) & 1, 64 * WORDS // segment

    def each(batch):
        for at in range(0, batch.num_rows, 250):
            part = batch.slice(at, 250)
            n = part.num_rows
            fp = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(n, 8 * WORDS)
            bits = np.unpackbits(fp, axis=1)[:, : segment * segments].reshape(n, segments, segment).astype(np.int64)
            value = (bits << np.arange(segment)).sum(axis=2)
            loose = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(n, segments, LOOSE).astype(np.int64)
            masks = ((np.int64(1) << loose)[:, :, None, :] * flips).sum(axis=3)
            keys = (value[:, :, None] ^ masks) | (np.arange(segments)[None, :, None] << segment)
            yield batch_of(key=pa.array(keys.reshape(-1), pa.int64()), node=pa.array(np.repeat(part.column(0).to_numpy(), segments * 2**LOOSE), pa.int64()))
            few = part.column(3).to_pylist()
            keys = np.frombuffer(b"".join(few), np.uint32).astype(np.int64) | np.int64(1 << 60)
            yield batch_of(key=pa.array(keys, pa.int64()), node=pa.array(np.repeat(part.column(0).to_numpy(), [len(x) // 4 for x in few]), pa.int64()))

    return arrow_map(classes.select("node", "fp", "loose", "few"), each, "key long, node long")


def _words(fps: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(fps), np.uint64).reshape(len(fps), WORDS)


def spanning(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (rows of ``fps``) of a tree over each component of the links of up to ``bits`` bits.

    From each start what is reached is compared with what is left only, so a group of near copies costs few comparisons each.
    """
    left, ends = np.arange(len(fps)), ([np.zeros(0, int)], [np.zeros(0, int)])
    while len(left) > 1:
        edge, left = left[:1], left[1:]
        while len(edge) and len(left):
            parent = np.full(len(left), -1)
            for i in range(0, len(edge), 64):
                rest = np.nonzero(parent < 0)[0]
                near = np.bitwise_count(fps[edge[i : i + 64], None] ^ fps[None, left[rest]]).sum(axis=2, dtype=np.uint16) <= bits
                hit = near.any(axis=0)
                parent[rest[hit]] = edge[i : i + 64][near.argmax(axis=0)[hit]]
            met = parent >= 0
            ends[0].append(parent[met])
            ends[1].append(left[met])
            edge, left = left[met], left[~met]
    return np.concatenate(ends[0]), np.concatenate(ends[1])


def spanning_alike(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links (places in ``sets``, sorted distinct hashes) of a tree over each component of the links of similarity ALIKE / OF or more."""
    n, sizes = len(sets), np.array([len(x) for x in sets], np.int64)
    owner, ends = np.repeat(np.arange(n), sizes), np.append(0, np.cumsum(sizes))
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    having, first = owner[np.argsort(ids, kind="stable")], np.append(0, np.cumsum(np.bincount(ids)))
    left, links = np.ones(n, bool), ([], [])
    for start in range(n):
        if not left[start]:
            continue
        left[start], edge = False, [start]
        while edge and left.any():
            x = edge.pop()
            own = ids[ends[x] : ends[x + 1]]
            many = first[own + 1] - first[own]
            shared = np.bincount(having[np.arange(many.sum()) + np.repeat(first[own] - np.cumsum(many) + many, many)], minlength=n)
            met = np.nonzero(left & (OF * shared >= ALIKE * (sizes[x] + sizes - shared)))[0]
            left[met] = False
            links[0].extend([x] * len(met))
            links[1].extend(met.tolist())
            edge.extend(met.tolist())
    return np.array(links[0], int), np.array(links[1], int)


def _in_runs(column: str, spanning_of):
    """mapInArrow function: rows sorted by (key, i, j, node) to the spanning links, over ``column``, of each run of equal ones."""

    def links_of(run: pa.Table) -> pa.RecordBatch:
        nodes = run["node"].to_numpy()
        a, b = spanning_of(run[column].to_pylist())
        return batch_of(a=pa.array(nodes[a], pa.int64()), b=pa.array(nodes[b], pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
            if not t.num_rows:
                continue
            at = np.stack([t[c].to_numpy() for c in ("key", "i", "j")])
            cuts = [0, *(np.nonzero((at[:, 1:] != at[:, :-1]).any(axis=0))[0] + 1).tolist()]
            for x, y in zip(cuts, cuts[1:]):
                yield links_of(t.slice(x, y - x))
            held = t.slice(cuts[-1])
        if held is not None:
            yield links_of(held)

    return tidy(run)


def links(classes: DataFrame, bits: int = BITS, segment: int = 28) -> DataFrame:
    """(a, b) of nodes that connect what all links found in buckets connect; a bucket gives spanning links, never all pairs."""
    fps = classes.select("node", "fp")
    buckets = settle(_keys(classes, segment).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("a"), F.max("node").alias("b")).where("n > 1"))
    a, b = (fps.select(F.col("node").alias(x), F.col("fp").alias(f"fp_{x}")) for x in "ab")

    def near(batch):
        d = np.bitwise_count(_words(batch.column(2).to_pylist()) ^ _words(batch.column(3).to_pylist())).sum(axis=1) <= bits
        yield batch.filter(pa.array(d)).select([0, 1])

    pairs = buckets.where("n = 2").select("a", "b").distinct().join(a, "a").join(b, "b").select("a", "b", "fp_a", "fp_b")
    found = arrow_map(pairs, near, "a long, b long")
    many = buckets.where("n > 2").select("key", F.ceil(F.col("n") / BLOCK).alias("of"))
    n_many = many.count()
    if n_many:
        members = _keys(classes, segment).join(F.broadcast(many) if n_many <= MAX_BROADCAST_KEYS else many, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("of")))
        dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)))
        dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node").join(fps, "node")
        runs = dealt.select("key", "i", "j", "node", "fp").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
        found = found.unionByName(runs.mapInArrow(_in_runs("fp", lambda fps: spanning(_words(fps), bits)), "a long, b long"))
    return found.distinct()


def verified(docs: DataFrame, classes: DataFrame, stars: DataFrame, shingle: int = 5) -> DataFrame:
    """(a, b) of nodes that connect what all pairs of similarity ALIKE / OF in a component of candidates connect.

    ``stars``: (a, b) as of star_components. Of each class one text is read again; a component of many hashes is dealt in blocks.
    """
    members = stars.union(stars.select("a", "a").distinct()).toDF("key", "node").join(classes.select("node", "set", "n", "least"), "node")
    members = settle(members)
    of = members.groupBy("key").agg(F.ceil(F.greatest(F.sum("n"), F.lit(1)) / PART).alias("of"))
    dealt = members.join(of, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("of"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "set")

    def each(batch):
        for at in range(0, batch.num_rows, 500):
            found = [shingle_hashes(t, shingle) for t in texts(batch.slice(at, 500))]
            yield batch_of(set=pa.array([_digest(h) for h in found], pa.binary()), hashes=pa.array([h.tobytes() for h in found], pa.binary()))

    wanted = members.select(F.col("least").alias("__id")).distinct()
    read = id_text(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    hashes = arrow_map(read, each, "set binary, hashes binary").join(members.select("set"), "set", "left_semi").dropDuplicates(["set"])
    runs = dealt.join(hashes, "set").select("key", "i", "j", "node", "hashes").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    alike = _in_runs("hashes", lambda rows: spanning_alike([np.frombuffer(x, np.uint64) for x in rows]))
    return runs.mapInArrow(alike, "a long, b long").distinct()


def similar_groups(docs: DataFrame, shingle: int = 5, bits: int = BITS) -> DataFrame:
    """doc_id and component_id (smallest doc_id reachable over links of similarity ALIKE / OF or more) of each row.

    Texts without a word are one group. Rows that share an id each have a row. Null ids are ignored when the smallest is taken;
    a component with none but null ids has component_id null. An empty table gives an empty result.
    """
    segment = segment_bits(docs.count())
    with arrow_batches(docs.sparkSession):
        fps = settle(fingerprints(docs, shingle, segment))
        # texts of one set have equal bits, of equal certainty
        classes = fps.groupBy("set").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"), *[F.first(c).alias(c) for c in ("n", "fp", "loose", "few")])
        classes = settle(classes.withColumn("node", F.monotonically_increasing_id()))
        near = star_components(links(classes, bits, segment))
        stars = star_components(verified(docs, classes, near, shingle))
    found = components(classes.select("node", "least", F.col("rows").alias("n")), stars, "node")
    sets = classes.select("node", "set").join(found, "node").select("set", "component_id", "n")
    return join_split(fps.select("doc_id", "set"), sets, "set", fps.count()).select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, shingle: int = 5, bits: int = BITS) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the smallest doc_id. All columns stay.

    A group is a component of links: ends of a chain go with it, though they may resemble only what goes as well.

    Rows with a null id stay. Of rows that share the smallest id all stay.

    Up to MAX_BROADCAST_KEYS ids that go are broadcast, so texts are neither moved nor sorted; more meet the rows by hash.
    """
    id_ = helper("id", docs)
    goes = settle(similar_groups(docs, shingle, bits).where("doc_id <> component_id").select(F.col("doc_id").alias(id_)).distinct())
    few = goes.count() <= MAX_BROADCAST_KEYS
    return docs.join(F.broadcast(goes) if few else goes, F.col("doc_id").cast("long") == F.col(id_), "left_anti")
