"""What the operators of this subpackage share: reading a table, cutting lineage, Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so lost executors can't undo it.

    The folder is ``shared_folder``'s.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int = 1000):
    """Batches of at most so many rows go to Python for what runs inside; the session's setting is as before afterwards.

    Only for work that ends inside (``settle``): texts of one batch are held in a Python worker several times over.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(was)) if int(was) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only where that is unset and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return named or tempfile.mkdtemp(prefix="spark-", dir="/tmp")


#: A key is hot from 1/HOT of all rows on, so at most HOT keys are.
HOT = 512


def join_split(rows: DataFrame, known: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of ``rows``, ``total`` in all, with ``known`` by ``key``, which is unique there; its column n says how many of ``rows`` have the key.

    Rows of hot keys stay where they are and meet a broadcast table of at most HOT rows; the others meet by hash. n is dropped.
    """
    least = max(1, total // HOT)
    few = known.where(F.col("n") > least)
    hot = few.limit(HOT).collect()  # the limit never cuts: see HOT
    if not hot:
        return rows.join(known.drop("n"), key)
    is_hot = F.col(key).isin([r[key] for r in hot])
    found = rows.sparkSession.createDataFrame(hot, known.schema).drop("n")
    return rows.where(~is_hot).join(known.where(F.col("n") <= least).drop("n"), key).unionByName(rows.where(is_hot).join(F.broadcast(found), key))


def arrow_map(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches):
        for batch in batches:
            out = each(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return df.mapInArrow(tidy(run), schema)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, after whose last batch the worker gives back what it has freed: workers stay for later tasks and stages, of any operator."""

    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return tidied


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A text column as Python strings; null counts as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def groups(all_texts: list[str], most: int = 1 << 20) -> Iterator[list[str]]:
    """Runs of texts of about ``most`` characters, so that what is made of them at once is bounded."""
    part, size = [], 0
    for t in all_texts:
        part.append(t)
        size += len(t)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in columns.values()], names=list(columns))


def give_back() -> None:
    """Memory that this process has freed goes back to the machine, where its libraries can do that: what follows a fit or a task needs it elsewhere."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # of glibc alone
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def helper(name: str, df: DataFrame) -> str:
    """A column name that ``df`` doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def id_text(docs: DataFrame) -> DataFrame:
    """Only what the operators read of ``documents``, so extra columns and their names don't matter."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def held_out(modulus: int, remainder: int):
    """Column: crc32 of doc_id as text, modulo ``modulus``, is ``remainder`` (a null id counts as empty)."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder
