"""Tables of intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of this machine only where the session names none and runs on this machine alone."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "/tmp/cairnfield-checkpoints"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new path under the work folder; nothing is there yet."""
    return f"{work_dir(spark)}/cairnfield/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """``df`` written as Parquet, in folders by the columns of ``by``, and read back: for results that several branches of a plan use.

    Spark runs a branch again for each use when the uses prune it differently; a table is computed once, its readers
    take only their columns, and it survives the loss of any executor.
    """
    path = folder(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def large(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that grows with the input: joined by sorting, never broadcast.

    Spark judges a shuffled side by its compressed bytes, and a panel that is mostly zeros is packed so well that 10 MB of it unfold to
    more than a driver holds.
    """
    return df.hint("merge")


#: Most rows of a table that may be broadcast after its rows were counted.
CHECKED_ROWS = 100_000


def checked(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of its own, with a broadcast hint if it has CHECKED_ROWS rows at most, else without (Spark then shuffles both sides)."""
    made = table(df, name)
    return F.broadcast(made) if made.count() <= CHECKED_ROWS else made
