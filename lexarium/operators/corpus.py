"""Corpus operators: filters, dedup, upsert, dates, relations, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.cleaning import computed, fix_category, fix_doc_number, fix_doc_type, strip_invisible, validate_content
from ..functions.text import DOC_NUMBER, fix_date, normalize_doc_number, normalize_query


def year_filter(docs: DataFrame, low: int = 2004, high: int = 2026) -> DataFrame:
    """Known years outside low to high go; unknown ones (null, 0) stay."""
    y = F.coalesce("year_published", F.lit(0))
    return docs.where((y <= 0) | y.between(low, high))


def clean_dates(raw: DataFrame) -> DataFrame:
    """issued_date as ISO where valid, and year_published from it."""
    iso = fix_date(F.col("issued_date"))
    return raw.withColumn("issued_date", iso).withColumn("year_published", F.coalesce(F.substring("issued_date", 1, 4).try_cast("int"), F.lit(0)))


_KEY = ["_number", "issued_date", "signer"]


def dedup_three_key(docs: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One document for each (number else id, issued date, signer), the smallest id, and none that ``existing`` has.

    Rows with a null date or signer never match and bypass the shuffle.
    """
    whole = F.col("issued_date").isNotNull() & F.col("signer").isNotNull()
    number = F.coalesce("doc_number", "doc_id")
    w = Window.partitionBy(*_KEY).orderBy("doc_id")
    first = docs.where(whole).withColumn("_number", number).withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")
    if existing is not None:
        first = first.join(existing.where(whole).select(number.alias("_number"), "issued_date", "signer").distinct(), _KEY, "left_anti")
    return first.select(*docs.columns).unionByName(docs.where(~whole))


def new_urls(links: DataFrame, known: DataFrame) -> DataFrame:
    return links.dropDuplicates(["url"]).join(known.select("url"), "url", "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, key: str, kept: tuple[str, ...] = ()) -> DataFrame:
    """``incoming`` replaces by ``key`` all columns but ``kept``; of repeated incoming keys the last by ``seq`` counts."""
    last = incoming.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("seq")))).where("_n = 1").drop("_n", "seq")
    e, i = existing.alias("e"), last.withColumn("_new", F.lit(True)).alias("i")
    cols = [F.coalesce(f"e.{c}", f"i.{c}").alias(c) if c == key or c in kept else F.when(F.col("_new"), F.col(f"i.{c}")).otherwise(F.col(f"e.{c}")).alias(c) for c in existing.columns]
    return e.join(i, F.col(f"e.{key}") == F.col(f"i.{key}"), "full_outer").select(*cols)


def upsert_documents(existing: DataFrame, incoming: DataFrame, now: Column | str) -> DataFrame:
    """``existing`` with the rows of ``incoming`` (its columns and ``seq``) written over by doc_id: the last by seq counts, a missing doc_number is the doc_id.

    A stored document keeps created_at and status_flag and has ``now`` as updated_at; a new one has ``now`` as both times and the flag 0. Columns that
    incoming lacks become null, as when a whole row is written.
    """
    now = F.lit(now) if isinstance(now, str) else now
    times = now.cast(existing.schema["updated_at"].dataType)
    given = [F.col(c) if c in incoming.columns else F.lit(None).cast(existing.schema[c].dataType).alias(c) for c in existing.columns if c not in ("doc_id", "doc_number", "created_at", "updated_at", "status_flag")]
    number = F.coalesce("doc_number", "doc_id") if "doc_number" in incoming.columns else F.col("doc_id")
    rows = incoming.select("doc_id", number.alias("doc_number"), *given, times.alias("created_at"), times.alias("updated_at"), F.lit(0).cast(existing.schema["status_flag"].dataType).alias("status_flag"), "seq")
    return upsert(existing, rows.select(*existing.columns, "seq"), "doc_id", ("created_at", "status_flag"))


def replaced_numbers(docs: DataFrame) -> DataFrame:
    """Edges (doc_id, doc_number) of 'Thay thế … số X'."""
    hits = F.regexp_extract_all("content", F.lit(rf"(?iu)thay thế [\p{{L}} ]{{1,40}}số ({DOC_NUMBER})"), F.lit(1))
    return docs.select("doc_id", F.explode(F.array_distinct(hits)).alias("doc_number"))


def resolve_relations(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """(src_doc_id, dst_doc_id, relation_type): edges whose number, normalised, is a stored document's; đ counts as d.

    Of several documents of one number those count whose authority and day of issue are the edge's hints, else those with one of these, else all;
    then the smallest id. edges: doc_id, doc_number, relation_type, and issuing_authority_hint, old_issued_date if there. docs: doc_id,
    doc_number, and issuing_authority, issued_date if there. Each document is known by its number, alone and with one or both of the
    others; of each such key the smallest id is kept, so one join finds all, and a number that many documents share is no pair of all.
    """
    has = lambda df, c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    number = normalize_doc_number(F.translate(F.lower("doc_number"), "đ", "d"))

    def keyed(df: DataFrame, columns: list[str], authority: str, day: str) -> DataFrame:
        """A row for each key: the number, and what else it holds; ``rank`` says how much."""
        a, d = normalize_query(has(df, authority)), has(df, day)
        some = df.where("doc_number is not null").select(*columns, number.alias("k"), a.alias("a"), d.alias("d")).where("k not in ('', '0')")
        key = lambda rank, tag, *parts: F.struct(F.lit(rank).alias("rank"), F.concat(F.lit(tag), *[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]).alias("key"))
        k, a, d = F.col("k"), F.col("a"), F.col("d")
        keys = F.array(key(0, "ad", k, a, d), key(1, "a", k, a), key(1, "d", k, d), key(2, "", k))
        return some.select(*columns, F.inline(F.filter(keys, lambda x: x["key"].isNotNull())))

    known = keyed(docs, ["doc_id"], "issuing_authority", "issued_date").groupBy("key").agg(F.min("doc_id").alias("dst_doc_id"))
    own = edges.withColumnRenamed("doc_id", "src_doc_id").withColumn("edge", F.monotonically_increasing_id())
    sought = keyed(own, ["edge", "src_doc_id", "relation_type"], "issuing_authority_hint", "old_issued_date")
    best = sought.join(known, "key").groupBy("edge", "src_doc_id", "relation_type").agg(F.min(F.struct("rank", "dst_doc_id")).alias("best"))
    return best.select("src_doc_id", F.col("best.dst_doc_id").alias("dst_doc_id"), "relation_type").distinct()


def status_flag(docs: DataFrame, relations: DataFrame, as_of: str, provisions: DataFrame | None = None) -> DataFrame:
    """doc_id, status_flag as of a date: 0 unknown, 1 in force, 2 ended, 3 not yet in force, 4 ended in part, 5 in force in part.

    docs: doc_id, effective_date, and expiry_date if there. An act has ended from its expiry on, or if an act in force (or without a known date)
    replaces or abolishes it; in part, if such an act changes or abolishes parts of it. It is in force in part if single provisions (provisions:
    doc_id, effective_date) are in force before it, or not yet though it is. relations: as of resolve_relations; without a type each one ends.
    """
    types = relations if "relation_type" in relations.columns else relations.withColumn("relation_type", F.lit("replaces"))
    since = docs.select(F.col("doc_id").alias("src_doc_id"), F.col("effective_date").alias("_since"))
    acts = types.where("src_doc_id <> dst_doc_id").join(since, "src_doc_id", "left").where(F.coalesce(F.col("_since") <= as_of, F.lit(True)))
    by = acts.groupBy(F.col("dst_doc_id").alias("doc_id")).agg(
        F.max(F.col("relation_type").isin("replaces", "abolishes")).alias("_ended"), F.max(F.col("relation_type").isin("amends_partial", "abolished_partial")).alias("_partly")
    )
    found = docs.join(by, "doc_id", "left")
    if provisions is not None:
        days = provisions.groupBy("doc_id").agg(F.min("effective_date").alias("_first"), F.max("effective_date").alias("_last"))
        found = found.join(days, "doc_id", "left")
    else:
        found = found.withColumns({"_first": F.lit(None).cast("string"), "_last": F.lit(None).cast("string")})
    eff = F.col("effective_date")
    over = F.col("_ended") | (F.col("expiry_date") <= as_of) if "expiry_date" in docs.columns else F.col("_ended")
    flag = F.when(over, 2).when(eff.isNull(), 0).when(eff > as_of, F.when(F.col("_first") <= as_of, 5).otherwise(3)).when(F.col("_partly"), 4).when(F.col("_last") > as_of, 5).otherwise(1)
    return found.select("doc_id", flag.alias("status_flag"))


def ingest_summary(outcomes: DataFrame) -> DataFrame:
    """outcome, n of rows (outcome), and the row ``total`` with the number of all."""
    each = outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    return each.unionByName(each.agg(F.lit("total").alias("outcome"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")))


def _of(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def check_documents(raw: DataFrame, again: bool = False) -> DataFrame:
    """raw with what decides whether a document counts: text, number, day of issue and year repaired, and ``_skip``; see clean_documents."""
    year = F.col("year_published") if "year_published" in raw.columns else F.lit(0)
    cut = computed(raw, _text=strip_invisible(_of(raw, "content"), again), _issued=fix_date(_of(raw, "issued_date")))
    cut = computed(cut, _skip=~validate_content(F.col("_text")))
    text, issued = F.col("_text"), F.col("_issued")
    known = F.coalesce(F.nullif(year, F.lit(0)), F.substring(issued, 1, 4).try_cast("int"), F.lit(0))
    return cut.withColumns({"content": text, "doc_number": fix_doc_number(_of(raw, "doc_number"), text, _of(raw, "url")), "issued_date": issued, "year_published": known}).drop("_text", "_issued")


def label_documents(raw: DataFrame) -> DataFrame:
    """raw with kind, category and the days of force and end repaired; see clean_documents."""
    title = _of(raw, "title")
    return raw.withColumns(
        {
            "doc_type": fix_doc_type(_of(raw, "doc_type"), title, _of(raw, "url")),
            "category": fix_category(_of(raw, "category"), title),
            "effective_date": fix_date(_of(raw, "effective_date")),
            "expiry_date": fix_date(_of(raw, "expiry_date")),
        }
    )


def clean_documents(raw: DataFrame, again: bool = False) -> DataFrame:
    """raw with text, number, kind, category and dates repaired, year_published where it was missing, and ``_skip`` where the text isn't valid.

    Columns that raw lacks count as null. ``again``: texts with U+FFFD are decoded again (see cleaning.redecode), else they are skipped.
    """
    made = ["content", "doc_number", "doc_type", "category", "issued_date", "effective_date", "expiry_date", "year_published"]
    return label_documents(check_documents(raw, again)).select(*raw.columns, "_skip", *[c for c in made if c not in raw.columns])


def cap_documents(docs: DataFrame, max_docs: int, max_pages: int, *order: str) -> DataFrame:
    """The first max_docs rows, in order, of the first max_pages pages of listing (column ``page``)."""
    return docs.where(F.col("page") <= max_pages).orderBy(*order).limit(max_docs)
