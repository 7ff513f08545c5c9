"""Where tables between two steps are kept."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only where that is unset and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return named or tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def settle(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: what is read several times is made once, and lost executors can't undo it."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: Tasks for each core, rows and characters of a task, where rows are dealt by a key.
TASKS, KEY_ROWS, KEY_CHARS = 3, 20_000, 8_000_000


def tasks_for(df: DataFrame, text: str) -> int:
    """How many tasks deal ``df`` so that none has more than its share of rows or of the characters in ``text``: the number grows with the input."""
    rows, chars = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(text)), F.lit(0))).first()
    return max(TASKS * df.sparkSession.sparkContext.defaultParallelism, -(-rows // KEY_ROWS), -(-chars // KEY_CHARS))


def dealt(df: DataFrame, key: str, text: str, tasks: int | None = None) -> DataFrame:
    """``df`` dealt by ``key`` over ``tasks`` (by default tasks_for), whatever the number of shuffle partitions is; windows and groups of the key need no other shuffle."""
    return df.repartition(tasks or tasks_for(df, text), key)
