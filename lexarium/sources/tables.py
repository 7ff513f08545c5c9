"""Pages, contracts, documents and the knowledge base as tables on shared storage or over JDBC."""

from __future__ import annotations

import re
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import upsert
from .log import Log


def load_pages(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """url, html from Parquet or JSON, or from whole text files, whose path is their url."""
    if format == "text":
        return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))
    return spark.read.format(format).load(path).select("url", "html")


def contract_registry(files: DataFrame, chunks: DataFrame, kinds: tuple[str, ...] = (".doc", ".docx", ".pdf")) -> DataFrame:
    """contract_id, filename, file_type, status, message, chunk_count of files with a known last suffix.

    files: contract_id, filename, text (null: not read). Blank texts count as not read.
    """
    suffix = F.lower(F.regexp_extract("filename", r"(\.[^./\\]+)$", 1))
    n = chunks.groupBy("contract_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    read = F.coalesce(F.trim("text") != "", F.lit(False))
    own = files.select("contract_id", "filename", suffix.alias("file_type"), F.when(read, "parsed").otherwise("uploaded").alias("status"), F.when(read, "").otherwise("no text").alias("message"))
    return own.where(F.col("file_type").isin(*kinds)).join(n, "contract_id", "left").fillna(0, ["chunk_count"])


def upsert_contracts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows replace status, message and chunk_count by contract_id; other columns stay. incoming has ``seq``."""
    kept = tuple(c for c in existing.columns if c not in ("contract_id", "status", "message", "chunk_count"))
    return upsert(existing, incoming, "contract_id", kept)


def get_by_id(docs: DataFrame, doc_id: str) -> DataFrame:
    return docs.where(F.col("doc_id") == doc_id)


def get_by_number(docs: DataFrame, number: str) -> DataFrame:
    return docs.where(F.col("doc_number") == number)


def all_urls(docs: DataFrame) -> DataFrame:
    return docs.where("url is not null").select("url").distinct()


def read_table(spark: SparkSession, url: str, table: str, partition_col: str, bounds: tuple[int, int], partitions: int, **options: str) -> DataFrame:
    """A database table, read in ranges of partition_col."""
    own = {"url": url, "dbtable": table, "partitionColumn": partition_col, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(partitions)}
    return spark.read.format("jdbc").options(**own, **options).load()


def _plain(name: str) -> str:
    """A table's or column's name that can stand in SQL as it is."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)?", name):
        raise ValueError(f"not a plain name: {name!r}")
    return name


def bounds(spark: SparkSession, url: str, table: str, column: str, **options: str) -> tuple[int, int]:
    """The least and the largest value of a whole-number column, as the database finds them; (0, 0) for an empty table."""
    query = f"select min({_plain(column)}) as lo, max({_plain(column)}) as hi from {_plain(table)}"
    row = spark.read.format("jdbc").options(url=url, query=query, **options).load().first()
    return (0, 0) if row[0] is None else (int(row[0]), int(row[1]))


def write_table(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    """Rows to a database table, in batches (option batchsize)."""
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()


def upsert_table(rows: DataFrame, url: str, table: str, key: str, **options: str) -> None:
    """``rows`` replace those of a database table with their key, and are added where it has none; running it again changes nothing.

    They are written to a staging table by all tasks, and moved from there in one transaction of the database. Of rows that repeat a key one is taken;
    rows with a null key don't count.
    """
    staging = f"{_plain(table)}_STAGING"
    write_table(rows.where(F.col(key).isNotNull()).dropDuplicates([key]), url, staging, "overwrite", **options)
    jvm = rows.sparkSession._jvm
    quoted = jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier
    columns, k = ", ".join(map(quoted, rows.columns)), quoted(key)
    connection = jvm.java.sql.DriverManager.getConnection(url)
    try:
        connection.setAutoCommit(False)
        for sql in (f"delete from {table} where {k} in (select {k} from {staging})", f"insert into {table} ({columns}) select {columns} from {staging}"):
            statement = connection.createStatement()
            statement.executeUpdate(sql)
            statement.close()
        connection.commit()
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()


def write_kb(kb: DataFrame, path: str, batch: str | None = None) -> None:
    """Chunks with vectors, split by section_type: as the whole store, or as the part ``batch`` of it, which replaces an earlier part of that name.

    Readers see the store before or after, never half of it.
    """
    log = Log(kb.sparkSession, path, "section_type")
    log.put(kb, f"batch-{batch}") if batch is not None else log.put(kb, f"whole-{uuid4().hex}", log.parts())


def read_kb(spark: SparkSession, path: str, **eq: str) -> DataFrame:
    """The chunks whose columns equal the given values; only the folders of a given section_type are opened. A store that was never written raises."""
    log = Log(spark, path, "section_type")
    kb = log.read()
    if kb is None:
        raise FileNotFoundError(f"no store at {path}")
    for c, v in eq.items():
        kb = kb.where(F.col(c) == v)
    return kb


def next_status(status: Column, analysed: Column) -> Column:
    return F.when(analysed, "analyzed").otherwise(status)
