"""Best-two-fit packing of token sequences.

Only lengths decide what fits, and there are at most 1024 of them. Spark counts the pieces of each length; from these
counts the plan is made: bins are filled greedily with the longest that fits, then a bin's smallest piece gives way to two
unpacked ones that together fit the widened gap more tightly. A bin's pattern is repeated as often as the counts allow, so the
plan is a table of some thousand slots for any number of pieces. Pieces get a rank within their length (from salted buckets of
bounded size, so a very common length is no hot key) and look up their slot by length and rank.
"""

from __future__ import annotations

import base64
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import arrow_map, batch_of, helper, id_text, settle, table, texts
from .bpe import tokenizer

CAPACITY = 1024
END = 2
#: Pieces of a bucket of one length, in which ranks are counted, about.
BUCKET = 1000
#: Units whose ids a task remembers.
REMEMBERED = 400_000
#: Splits where the tokenizer's own pattern always splits, in texts of the characters of _PLAIN.
_UNIT = re.compile(r" ?[^ \n\t\r]+|[ \n\t\r]+(?![^ \n\t\r])|[ \n\t\r]+")
_OTHER = re.compile("[^\n\t\r\x20-\x7e\xa1-ɏ]")
_SPECIAL = "<|endoftext|>"


class _Units(dict):
    """Unit to ids as bytes, with a bound on how many are held."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("units", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = np.array(self.encode(unit), "<u4").tobytes()
        if len(unit) <= 64:
            self[unit] = ids
        return ids


@lru_cache(maxsize=1)
def _units(ranks_path: str) -> _Units:
    import public_tokenizers

    return _Units(ranks_path, public_tokenizers.PATTERN)


def token_bytes(text: str, path: str, ranks_path: str) -> bytes:
    """ids of the tokenizer at ``path`` as little-endian unsigned 32-bit integers.

    Texts of Latin letters go unit by unit through the same vocabulary's ranks, and repeated units are encoded once; texts
    with other characters or the special token go to the tokenizer whole.
    """
    if _SPECIAL in text or _OTHER.search(text):
        return np.array(tokenizer(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    units = _units(ranks_path)
    return b"".join([units[u] for u in _UNIT.findall(text)])


def pieces(docs: DataFrame, path: str, ranks_path: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and END, cut from the back into pieces of CAPACITY."""

    def each(batch):
        ids, piece, start, length, crc = [], [], [], [], []
        for i, t in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
            b = token_bytes(t, path, ranks_path) + END.to_bytes(4, "little")
            n = len(b) // 4
            first = n % CAPACITY or CAPACITY
            for k, at in enumerate([0, *range(first, n, CAPACITY)]):
                size = first if k == 0 else CAPACITY
                ids.append(i)
                piece.append(k)
                start.append(at)
                length.append(size)
                crc.append(zlib.crc32(b[4 * at : 4 * (at + size)]))
        yield batch_of(
            doc_id=pa.array(ids, pa.int64()), piece=pa.array(piece, pa.int32()), start=pa.array(start, pa.int64()), length=pa.array(length, pa.int64()), ids_crc32=pa.array(crc, pa.int64())
        )

    return arrow_map(id_text(docs), each, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Bins as (lengths in order, how many such bins) that hold exactly the counted lengths."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    at = np.arange(capacity + 1)
    bins: list[tuple[list[int], int]] = []
    while left.any():
        rest, lengths, gap = left.copy(), [], capacity
        while gap and (fits := np.flatnonzero(rest[1 : gap + 1])).size:
            longest = int(fits[-1]) + 1
            take = int(min(rest[longest], gap // longest))
            lengths += [longest] * take
            rest[longest] -= take
            gap -= longest * take
        while gap:
            smallest = min(lengths)
            room = gap + smallest
            there = rest > 0
            floor = np.maximum.accumulate(np.where(there, at, 0))
            x = at[: room + 1][there[: room + 1]]
            y = floor[room - x]
            same = (y == x) & (rest[x] < 2)
            y = np.where(same, np.where(x > 0, floor[np.maximum(x - 1, 0)], 0), y)
            both = np.where(y > 0, x + y, 0)
            if not both.size or both.max() <= smallest:
                break
            best = int(both.argmax())
            lengths.remove(smallest)
            rest[smallest] += 1
            for taken in (int(x[best]), int(y[best])):
                lengths.append(taken)
                rest[taken] -= 1
            gap = room - int(both[best])
        need = np.bincount(lengths, minlength=capacity + 1)
        used = np.flatnonzero(need)
        times = int((left[used] // need[used]).min())
        left -= need * times
        bins.append((sorted(lengths, reverse=True), times))
    return bins


def _slots(bins: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """For each length the ranks from ``rank`` on go to sequences from ``sequence`` on, at ``offset``."""
    rows, next_rank, sequence = [], {}, 0
    for lengths, times in bins:
        offset = 0
        for length in lengths:
            rank = next_rank.get(length, 0)
            next_rank[length] = rank + times
            rows.append((length, rank, sequence, offset))
            offset += length
        sequence += times
    table_ = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"key": (table_[:, 0] << 48) + table_[:, 1], "rank": table_[:, 1], "sequence": table_[:, 2], "offset": table_[:, 3]}


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (rows with a length of 1 to capacity) with sequence_id and offset. Rows that are equal in all columns may change places."""
    cut = settle(cut)
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    slots = _slots(plan(counts, capacity))
    # as many buckets for each length as it needs: a row for each length at most
    parts = cut.sparkSession.createDataFrame([(k, -(-n // BUCKET)) for k, n in counts.items()], "length long, parts long")
    row, bucket, base, within = (helper(x, cut) for x in ("row", "bucket", "base", "within"))
    keyed = cut.withColumn(row, F.monotonically_increasing_id()).join(F.broadcast(parts.withColumnRenamed("parts", bucket)), "length")
    keyed = keyed.withColumn(bucket, F.pmod(F.xxhash64(row), F.col(bucket)))
    before = Window.partitionBy("length").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sizes = keyed.groupBy("length", bucket).agg(F.count(F.lit(1)).alias("n"))
    bases = sizes.select("length", bucket, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(base))
    nth = F.row_number().over(Window.partitionBy("length", bucket).orderBy(row)) - 1
    ranked = keyed.withColumn(within, nth).join(bases, ["length", bucket])
    ranked = ranked.select(*cut.columns, (F.col(base) + F.col(within)).cast("long").alias("rank"))

    def place(batch):
        t = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        rank = t.pop("rank").to_numpy(zero_copy_only=False)
        k = np.searchsorted(slots["key"], (t["length"].to_numpy(zero_copy_only=False) << 48) + rank, side="right") - 1
        yield batch_of(**t, sequence_id=pa.array(slots["sequence"][k] + rank - slots["rank"][k]), offset=pa.array(slots["offset"][k]))

    return arrow_map(ranked, place, ", ".join(f"{n} {k}" for n, k in cut.dtypes) + ", sequence_id long, offset long")


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of each row of ``docs``.

    Null or empty text is the one id END. Every row counts as a document of its own, repeated ones too.
    """
    import public_tokenizers

    return pack(pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")))


def query(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
