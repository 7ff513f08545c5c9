"""A corpus pipeline: toxic documents go, then exact and near copies; secrets are masked; what is left is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next.
Null text counts as empty, extra columns of ``docs`` stay until the last stage whatever their names, and an empty table passes through.
Of rows that repeat an id and a text one stays; rows that repeat an id with other texts are documents of their own. A document with a null
id goes only if its text is scored toxic or equals that of a document with an id.

Of exact copies the one with the largest id stays, of near copies then the one with the smallest: a group is all that links of similarity
0.8 connect.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.llm import exact_dedup, near_copies, packing, secrets, toxicity
from lexarium.llm._common import held_out, shared_folder, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the factorization machine scores 0.5 or more; it is fitted on the labels that op6 learns from."""
    score = toxicity.scorer(toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held_out(5, 0))))
    return docs.where(F.coalesce(score(F.col("text")), F.lit(0.0)) < 0.5)


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts that are equal but for the case of A-Z: the one with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle similarity of 0.8 or more: the one with the smallest doc_id."""
    return near_copies.drop_near_copies(docs)


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by their kinds."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 1024 tokens."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("exact_dedup", copies_out),
    ("near_dedup", near_copies_out),
    ("secrets", secrets_masked),
    ("packing", packed),
]

#: SQL can't express the model's scores, the components or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over ``documents``; tables between them are in the folder that spark.checkpoint.dir names, and stay there."""
    shared = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(at := f"{shared}/pipeline-{uuid.uuid4().hex}-{name}")
            docs = spark.read.parquet(at)
    return docs
