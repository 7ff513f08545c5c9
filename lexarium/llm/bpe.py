"""BPE encoding and decoding over a distinct-word table.

White space never enters a token of the word tokenizer, so a text's ids are those of its words in order. Spark splits the
texts and reduces them to the distinct words of each block of documents; one shuffle by word brings all
occurrences of a word in such lists together, where it is encoded once; a second one takes the ids back to the blocks, where
they are joined to the words of each text by position. There the ids of the block's distinct words are also joined with the
id-to-piece table, and a text is decoded as the pieces of its words in order. Texts travel once, compressed. The id-to-piece
table has the size of the vocabulary, whatever the documents.

A block is a run of rows of an input partition with about ``BLOCK_BYTES`` of text (a longer text is a block of its own or ends one), so
what one task holds is bounded. A block's number is only a way to meet: a word that isn't in the list of its block (if an input could
be read again in another order) is encoded in place.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import batch_of, id_text, table, texts

BLOCK_BYTES = 32 << 20
#: Text of a row in which the texts of a block travel.
RUN_BYTES = 1 << 20
#: Words that a task holds before it hands them on.
HELD = 1_000_000
#: Blocks in which one task meets a word, about.
MEETING = 4096


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=2)
def pieces(path: str) -> pa.Table:
    """The id-to-piece table: id, piece."""
    t = tokenizer(path)
    n = t.get_vocab_size(with_added_tokens=True)
    return pa.table({"id": pa.array(range(n), pa.int32()), "piece": pa.array([t.id_to_token(i) or "" for i in range(n)], pa.string())})


def _lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), values)


def _encoded(words: list[str], path: str) -> pa.ListArray:
    """The ids of each word."""
    found = [e.ids for e in tokenizer(path).encode_batch_fast(words, add_special_tokens=False)]
    counts = np.fromiter(map(len, found), np.int64, len(found))
    return _lists(counts, pa.array(np.fromiter(chain.from_iterable(found), np.int32, counts.sum())))


def _decoded(ids: pa.ListArray, path: str) -> pa.Array:
    """Each list's pieces, with spaces between: a join of its ids with the id-to-piece table, back in their order."""
    flat = pa.table({"id": ids.flatten(), "at": pa.array(np.arange(len(ids.flatten())))})
    met = flat.join(pieces(path), "id", join_type="left outer").sort_by("at")["piece"].combine_chunks()
    return pc.binary_join(_lists(pc.list_value_length(ids).to_numpy(), pc.fill_null(met, "")), " ")


def _in_blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, bool, list, list[list[bytes]]]]:
    """(block, whether it ends, ids, words of each text) in runs of about ``most`` bytes."""
    block, size, held, ids, words = TaskContext.get().partitionId() << 33, 0, 0, [], []
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
            raw = t.encode()
            ids.append(i)
            words.append(raw.split())  # at ASCII white space, all of which the tokenizer drops
            size += len(raw)
            held += len(raw)
            if held >= most or size >= BLOCK_BYTES:
                yield block, size >= BLOCK_BYTES, ids, words
                held, ids, words = 0, [], []
                if size >= BLOCK_BYTES:
                    block, size = block + 1, 0
    yield block, True, ids, words


def word_table(docs: DataFrame, path: str, parts: int, blocks: int) -> DataFrame:
    """(block, words, sizes, ids): the distinct words of each block, each encoded where its blocks meet.

    Words are made distinct in each task before the one shuffle by word. After it they are sorted, so that a word is encoded once
    for all of its blocks (once for each MEETING of them), and go back in packed lists: letters, and their numbers with those of the ids.
    """

    def distinct(batches):
        seen: set[bytes] = set()
        for block, ends, _, words in _in_blocks(batches, RUN_BYTES):
            for w in words:
                seen.update(w)
            if ends or len(seen) >= HELD:
                own = pa.array(sorted(seen), pa.binary()).cast(pa.string())  # sorted: neighbours in a shuffle block begin alike
                for i in range(0, len(own), 50_000):
                    part = own.slice(i, 50_000)
                    yield batch_of(block=pa.array(np.full(len(part), block)), word=part)
                seen.clear()

    def meet(batches):
        held: list[pa.Table] = []
        n = 0
        for batch in batches:
            found = batch.column(1).dictionary_encode()
            ids = _encoded(found.dictionary.to_pylist(), path)
            held.append(pa.table({"block": batch.column(0), "word": batch.column(1).cast(pa.binary()), "ids": ids.take(found.indices)}))
            n += batch.num_rows
            if n >= HELD:
                yield from _packed(held)
                held, n = [], 0
        if held:
            yield from _packed(held)

    met = docs.mapInArrow(distinct, "block long, word string")
    salt = F.pmod(F.col("block").bitwiseXOR(F.shiftright("block", 33)), F.lit(-(-blocks // MEETING)))
    met = met.repartition(parts, "word", salt).sortWithinPartitions("word")
    return met.mapInArrow(meet, "block long, words binary, sizes binary, ids binary")


def _packed(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=3)
    t = pa.concat_tables(held).combine_chunks()
    t = t.take(pa.array(np.argsort(t["block"].to_numpy(), kind="stable")))
    blocks = t["block"].to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
    for a, b in zip(cuts, cuts[1:]):
        part = t.slice(a, b - a)
        words, ids = part["word"].combine_chunks(), part["ids"].combine_chunks()
        sizes = np.concatenate([pc.binary_length(words).to_numpy(), pc.list_value_length(ids).to_numpy()]).astype("<u4")
        letters = b"".join(words.to_pylist())
        yield batch_of(
            block=pa.array([blocks[a]], pa.int64()), words=pa.array([z.compress(letters)], pa.binary()), sizes=pa.array([z.compress(_planes(sizes))], pa.binary()),
            ids=pa.array([z.compress(ids.flatten().to_numpy().astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes())], pa.binary()),
        )


def _planes(numbers: np.ndarray) -> bytes:
    """Bytes of equal weight together: those that are nearly always 0 shrink to nothing."""
    return numbers.view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(words: bytes, sizes: bytes, ids: bytes) -> tuple[pa.Array, pa.ListArray]:
    z = zstandard.ZstdDecompressor()
    n = np.ascontiguousarray(np.frombuffer(z.decompress(sizes), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    three = np.frombuffer(z.decompress(ids), np.uint8).reshape(-1, 3)
    flat = np.ascontiguousarray(np.pad(three, ((0, 0), (0, 1)))).view("<u4").ravel().astype(np.int32)
    letters, half = z.decompress(words), len(n) // 2
    at = pa.py_buffer(np.append(0, np.cumsum(n[:half])).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), half, [None, at, pa.py_buffer(letters)]), _lists(n[half:], pa.array(flat))


class _Known:
    """The distinct words of a block, with their ids and pieces by place."""

    def __init__(self, right: pa.Table, path: str):
        self.path, self.place = path, {}
        self.counts, self.first, self.flat, self.text = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4"), pa.array([], pa.string())
        lists = [_unpacked(*x) for x in zip(*(right[c].to_pylist() for c in ("words", "sizes", "ids")), strict=True)]
        if lists:
            self._add(list(chain.from_iterable(w.to_pylist() for w, _ in lists)), pa.concat_arrays([i for _, i in lists]))

    def _add(self, words: list[bytes], ids: pa.ListArray) -> None:
        n = len(self.place)
        self.place.update(zip(words, range(n, n + len(words))))
        counts = pc.list_value_length(ids).to_numpy().astype(np.int64)
        self.counts = np.concatenate([self.counts, counts])
        self.first = np.cumsum(self.counts) - self.counts
        self.flat = np.concatenate([self.flat, ids.flatten().to_numpy().astype("<u4")])
        self.text = pa.concat_arrays([self.text, _decoded(ids, self.path)])

    def places(self, words: list[bytes]) -> np.ndarray:
        try:
            return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        except KeyError:
            new = sorted({w for w in words if w not in self.place})
            self._add(new, _encoded([w.decode() for w in new], self.path))
            return self.places(words)

    def texts(self, words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Of texts as lists of words: the number of ids of each, all ids, and what each decodes to."""
        at = self.places(list(chain.from_iterable(words)))
        of = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        some = self.counts[at] > 0  # a word without ids leaves no piece
        at, of = at[some], of[some]
        n = self.counts[at]
        ids = self.flat[np.arange(n.sum()) + np.repeat(self.first[at] - np.cumsum(n) + n, n)]
        return np.bincount(of, n, len(words)).astype(np.int64), ids, pc.binary_join(_lists(np.bincount(of, minlength=len(words)), self.text.take(pa.array(at))), " ")


def encode(docs: DataFrame, path: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids also ids (array of int) and decoded (string).

    Null or empty text has no ids and decodes to the empty string. Rows that repeat an id each have a row of their own.
    """
    docs = id_text(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size // BLOCK_BYTES + 1
    parts = 2 * blocks

    def pack(batches):
        z = zstandard.ZstdCompressor(level=3)
        for block, _, ids, words in _in_blocks(batches, RUN_BYTES):
            if ids:
                yield batch_of(block=pa.array([block], pa.int64()), ids=pa.array([ids], pa.list_(pa.int64())), z=pa.array([z.compress(b"\n".join([b" ".join(w) for w in words]))], pa.binary()))

    packed = docs.mapInArrow(pack, "block long, ids array<long>, z binary")

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        known, z, out = _Known(right, path), zstandard.ZstdDecompressor(), []
        for ids, run in zip(left["ids"].to_pylist(), left["z"].to_pylist(), strict=True):
            n, flat, decoded = known.texts([x.split() for x in z.decompress(run).split(b"\n")])
            raw, ends = memoryview(flat.tobytes()), (4 * np.cumsum(n)).tolist()
            cols = {
                "doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array(n),
                "ids_sha256": pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip([0, *ends], ends)], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in decoded.cast(pa.binary()).to_pylist()], pa.string()),
            }
            if keep_ids:
                cols |= {"ids": _lists(n, pa.array(flat.astype(np.int32))), "decoded": decoded}
            out.append(pa.table(cols))
        return pa.concat_tables(out) if out else _none(keep_ids)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    found = word_table(docs, path, parts, blocks).repartition(parts, "block")
    return packed.repartition(parts, "block").groupBy("block").cogroup(found.groupBy("block")).applyInArrow(assemble, schema)


def _none(keep_ids: bool) -> pa.Table:
    kinds = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    return pa.schema(kinds | ({"ids": pa.list_(pa.int32()), "decoded": pa.string()} if keep_ids else {})).empty_table()


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, decoded) of rows (doc_id, ids), by a join with the id-to-piece table. An id outside of it gives no piece."""
    known = encoded.sparkSession.createDataFrame(pieces(path))  # as large as the vocabulary
    keyed = encoded.select("doc_id", F.monotonically_increasing_id().alias("row"), "ids")
    parts = keyed.select("doc_id", "row", F.posexplode_outer("ids").alias("pos", "id")).join(F.broadcast(known), "id", "left")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), " ")
    return parts.groupBy("row", "doc_id").agg(text.alias("decoded")).select("doc_id", "decoded")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)
