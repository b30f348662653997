"""Shared helpers of the corpus operators: sizes checked before a broadcast, held-out rows, words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.sources.work import large, work_dir
from cairnfield.sources.work import table as materialize

__all__ = ["BATCH_ROWS", "BROADCAST_ROWS", "SPACE", "held_out", "large", "lean_batches", "materialize", "shuffle_partitions", "skewed_join", "small", "table", "work_dir"]

#: White space that separates words, as a regular-expression class body.
SPACE = r"\x20\x09-\x0D"
#: Most rows of a table that may be broadcast after its rows were counted.
BROADCAST_ROWS = 200_000
#: Most texts in one Arrow batch.
BATCH_ROWS = 1_000


def lean_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches hold BATCH_ROWS rows at most: texts are long, and a batch is in memory whole
    on both sides of the Python worker's socket. A smaller setting stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else with one to shuffle both sides.

    Without the second hint Spark goes by the bytes of a file, which say nothing of the rows that an explode makes of them.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else large(df)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    """True for rows whose crc32(doc_id as text) mod 3 is 1; such rows are never learned from. Null ids: False."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


#: A key with over 1 / HOT_KEYS of all rows is hot: there are fewer than HOT_KEYS of them, whatever the input.
HOT_KEYS = 256


def skewed_join(left: DataFrame, right: DataFrame, key: str, rows: int) -> DataFrame:
    """Inner join of ``left`` with ``right`` (key, n, ...), n being how many of the ``rows`` rows of ``left`` have the key.

    The few hot keys are broadcast and their rows stay where they are; the others are shuffled, whatever size Spark takes them for.
    """
    limit = max(1_000, rows // HOT_KEYS)
    hot = F.broadcast(right.where(F.col("n") > limit))
    rest = left.join(hot.select(key), key, "left_anti").join(large(right.where(F.col("n") <= limit)), key)
    return left.join(hot, key).unionByName(rest)
