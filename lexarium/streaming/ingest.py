"""The corpus as a stream: files of new pages become documents of a table, each once."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..functions.cleaning import computed, is_placeholder, is_translation
from ..functions.text import doc_id_from_url
from ..operators.corpus import check_documents, dedup_three_key, label_documents
from ..sources.html import metadata_of, page_parts, title_of, with_content
from ..sources.log import Log
from ..sources.shared import dealt, settle, tasks_for

#: Years of documents that are taken; unknown ones are too.
YEARS = (2004, 2026)
_KEY = ["doc_number", "issued_date", "signer"]


def examined(pages: DataFrame) -> DataFrame:
    """url, doc_id, content, property columns, year_published and outcome of each page (url, html) with a url, and the titles (h1, title) of its parts.

    outcome: ``failed`` without valid content, ``skipped translation``, ``skipped year``, else ``ingested``. Nothing is made here that doesn't decide this
    or whether a document is new; ``finished`` makes the rest, of what is taken.
    """
    own = page_parts(pages.where("url is not null")).withColumn("doc_id", doc_id_from_url(F.col("url")))
    text = F.col("content")
    first = F.when(is_placeholder(text), "failed").when(is_translation(text, F.col("html")), "skipped translation").otherwise("ingested")
    docs = computed(with_content(own), _first=first).drop("html")
    on = lambda c: F.when(F.col("_first") == "ingested", c)
    docs = check_documents(docs.select("doc_id", "url", "h1", "title", "content", *[on(c).alias(k) for k, c in metadata_of().items()], "_first"))
    y = F.col("year_published")
    year = (y <= 0) | y.between(*YEARS)
    outcome = F.when(F.col("_first") != "ingested", F.col("_first")).when(F.col("_skip"), "failed").when(~year, "skipped year").otherwise("ingested")
    return docs.withColumn("outcome", outcome).drop("_first", "_skip")


def finished(docs: DataFrame) -> DataFrame:
    """``examined`` documents with their title, kind, category and days; documents that have no parts of a page (h1) stay as they are."""
    if "h1" not in docs.columns:
        return docs
    named = computed(docs, _title=title_of(F.col("doc_id"))).drop("h1").withColumn("title", F.col("_title")).drop("_title")
    return label_documents(named)


def documents_of(pages: DataFrame, tasks: int | None = None) -> DataFrame:
    """``examined`` documents of pages (url, html) that count: doc_id, url, content, property columns, year_published; ``finished`` adds the rest. Null urls go.

    Pages without valid content, translations, placeholders and years outside the range go; of documents with one id the smallest url stays. Whole
    documents are dealt by id over ``tasks``, by default as many as the pages' rows and characters need.
    """
    good = examined(pages).where("outcome = 'ingested'").drop("outcome").repartition(tasks or tasks_for(pages, "html"), "doc_id")
    return good.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("url"))).where("_n = 1").drop("_n")


def outcomes_of(pages: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """url, outcome of each page: as ``examined``, and ``duplicate`` where its document has the id, or number, date and signer, of an earlier or stored one.

    Pages are read once: what is compared of them, slim columns, is settled first.
    """
    docs = settle(examined(pages).select("url", "outcome", "doc_id", *_KEY))
    good = docs.where("outcome = 'ingested'")
    first = good.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("url"))).where("_n = 1").drop("_n")
    fresh = dedup_three_key(first, existing).select("url", F.lit(True).alias("_fresh"))
    marked = docs.select("url", "outcome").join(fresh, "url", "left")
    return marked.select("url", F.when((F.col("outcome") == "ingested") & F.col("_fresh").isNull(), "duplicate").otherwise(F.col("outcome")).alias("outcome"))


#: Buckets of a table, and the parts of a bucket from which they are merged into one.
BUCKETS, FULL = 64, 4


def _logs(spark: SparkSession, table_dir: str) -> tuple[Log, Log]:
    """The documents by the hash of their id, and their keys (number else id, day of issue, signer) by the hash of these."""
    return Log(spark, f"{table_dir}/documents", "bucket"), Log(spark, f"{table_dir}/keys", "bucket")


def _bucket(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)).cast("int")


def stored(spark: SparkSession, table_dir: str) -> DataFrame | None:
    """All rows of the table that weren't merged away; None if there are none."""
    return _logs(spark, table_dir)[0].read()


def current(rows: DataFrame) -> DataFrame:
    """Of each document the row of the last batch. Only ids are grouped."""
    last = rows.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["doc_id", "batch"], "left_semi")


def _touched(log: Log, rows: DataFrame, besides: str) -> DataFrame | None:
    """What the log holds in the buckets of ``rows`` (BUCKETS numbers at most come to the driver)."""
    return log.read({log.folder(r[0]) for r in rows.select("bucket").distinct().collect()}, besides)


def _keys_of(docs: DataFrame, alive: bool) -> DataFrame:
    whole = docs.where("issued_date is not null and signer is not null")
    return whole.select(F.coalesce("doc_number", "doc_id").alias("doc_number"), "issued_date", "signer", "doc_id", "batch", F.lit(alive).alias("alive")).withColumn("bucket", _bucket(*_KEY))


def _last_keys(keys: DataFrame) -> DataFrame:
    """Of each key and document what the last batch says."""
    last = keys.groupBy(*_KEY, "doc_id", "bucket").agg(F.max_by("alive", "batch").alias("alive"), F.max("batch").alias("batch"))
    return last.where("alive").select(*keys.columns)


def add_new(spark: SparkSession, pages: DataFrame, table_dir: str, batch: int) -> None:
    """Documents of pages that are new, or whose page has changed, as a part of the table; ``current`` gives the table as it is now.

    A document is new if its id isn't stored and none that is has its number, day of issue and signer. Of the table only slim columns of the buckets
    that the batch's ids and keys fall into are read. A batch that runs again replaces its own part, so each change is written
    once. Buckets of more than FULL parts are merged, the others aren't written again.
    """
    documents, keys = _logs(spark, table_dir)
    part = f"batch-{batch:010d}"
    docs = settle(documents_of(pages.dropDuplicates(["url"])).withColumn("bucket", _bucket("doc_id")))
    before = _touched(documents, docs, part)
    ids = docs.select("doc_id")
    if before is None:
        before = docs.limit(0).select("*", F.lit(batch).cast("long").alias("batch"), F.lit(0).cast("long").alias("row_hash"))
    old = current(before.select("doc_id", "batch", "row_hash", *_KEY)).select("doc_id", F.col("row_hash").alias("_was"), *_KEY)
    old = settle(old.join(ids, "doc_id", "left_semi"))
    fresh = docs.join(old, "doc_id", "left_anti")
    known = _touched(keys, _keys_of(fresh.withColumn("batch", F.lit(batch).cast("long")), True), part)
    # titles, kinds and days are only made of documents that are new, or may have changed
    taken = finished(dedup_three_key(fresh, None if known is None else _last_keys(known)).unionByName(docs.join(old, "doc_id", "left_semi")))
    own = [c for c in taken.columns if c != "bucket"]
    taken = taken.select(*own, F.xxhash64(*own).alias("row_hash"), F.lit(batch).cast("long").alias("batch"), "bucket").join(old.select("doc_id", "_was"), "doc_id", "left")
    rows = settle(taken.where("_was is null or row_hash <> _was").drop("_was"))
    changed = rows.join(old.select("doc_id"), "doc_id", "left_semi")
    documents.put(rows, part)
    ended = old.join(changed.select("doc_id"), "doc_id", "left_semi").withColumn("batch", F.lit(batch).cast("long"))
    owned = _keys_of(rows, True)
    keys.put(owned.unionByName(_keys_of(ended, False).join(owned.select(*_KEY, "doc_id"), [*_KEY, "doc_id"], "left_anti").select(*owned.columns)), part)
    for log, last in ((documents, current), (keys, _last_keys)):
        _merge(log, last, f"merged-{batch:010d}")


def _merge(log: Log, last: Callable[[DataFrame], DataFrame], part: str) -> None:
    """Buckets of more than FULL parts as one part of the rows that are current."""
    parts = log.parts()
    full = {folder for folder, n in Counter(folder for _, folder in parts).items() if n > FULL}
    if full:
        log.put(last(log.read(full)), part, [x for x in parts if x[1] in full])


def ingest_stream(spark: SparkSession, in_dir: str, table_dir: str, checkpoint: str, max_files: int = 1000) -> StreamingQuery:
    """Reads Parquet files (url, html) that are new in in_dir and adds their new and changed documents to the table. The table is the only state."""
    pages = spark.readStream.schema("url string, html string").option("maxFilesPerTrigger", max_files).parquet(in_dir)

    def one(batch: DataFrame, n: int) -> None:
        # files are read by few tasks, and a shuffle's tasks are merged by their bytes, though pages take long to read
        add_new(batch.sparkSession, dealt(batch, "url", "html"), table_dir, n)

    return pages.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
