"""Evaluation of origins as a stream: one origin alive at a time, committed by origin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.streaming.metrics import run_each_batch

#: The forecast rows of one origin.
Produce = Callable[[int], DataFrame]


def announce(origins: DataFrame, path: str) -> None:
    """Writes origins (m0) as a source of a stream, a file for each; more can be appended while the stream stands still."""
    origins.select("m0", F.col("m0").alias("origin")).repartition("origin").write.mode("append").partitionBy("origin").parquet(path)


def evaluate(spark: SparkSession, source: str, produce: Produce, store: str, checkpoint: str) -> None:
    """Produces the forecasts of every announced origin, one micro-batch for each, and writes them to ``store`` in a folder by origin.

    Only one origin's rows exist at a time. A folder is replaced as a whole, so a micro-batch that is run again after a crash
    leaves what it would have left the first time; origins that were committed are not produced again.
    """

    def commit(rows: DataFrame, number: int) -> None:
        for r in rows.select("m0").distinct().collect():  # one origin, as the source hands over one file at a time
            produce(r["m0"]).write.mode("overwrite").parquet(f"{store}/origin={r['m0']}")

    stream = spark.readStream.schema("m0 int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
    run_each_batch(stream, commit, checkpoint, "append")


def read_store(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(store)
