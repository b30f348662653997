"""Incremental forms: metric sums by lesson, windowed event counts with late data, stateful last values."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def metric_sums(records: DataFrame) -> DataFrame:
    """(key, lesson, n, se, ae, sh, sy): mergeable sums of (key, lesson, y, yh); a stream keeps one state row a group."""
    d = F.col("yh") - F.col("y")
    return records.groupBy("key", "lesson").agg(F.count("*").alias("n"), F.sum(d * d).alias("se"), F.sum(F.abs(d)).alias("ae"), F.sum("yh").alias("sh"), F.sum("y").alias("sy"))


def finish(sums: DataFrame) -> DataFrame:
    """(key, lesson, mse, mae, bias) from the sums; the bias is 1 where the truth sums to 0."""
    return sums.select("key", "lesson", (F.col("se") / F.col("n")).alias("mse"), (F.col("ae") / F.col("n")).alias("mae"), F.when(F.col("sy") == 0, 1.0).otherwise(F.col("sh") / F.when(F.col("sy") == 0, 1.0).otherwise(F.col("sy"))).alias("bias"))


def score_counts(records: DataFrame) -> DataFrame:
    """(key, lesson, s, pos, n): how many records (key, lesson, s, y) have each score, and how many of them events.

    These counts are the exact, mergeable state of every ranking metric: ``scores.precision_of`` and ``scores.auc_of`` finish them.
    """
    return records.groupBy("key", "lesson", "s").agg(F.count(F.when(F.col("y") > 0, 1)).alias("pos"), F.count("*").alias("n"))


def windowed_counts(events: DataFrame, time: str, key: str, width: str, slide: str, late: str) -> DataFrame:
    """(start, key, n): event-time windows; rows later than the watermark are dropped by Spark, which frees their state."""
    w = F.window(time, width, slide)
    return events.withWatermark(time, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def carry_forward(records: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, order, value) with the last known value of the key where a record has none; state is one number a key."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0.0
        # Spark hands a key's records of a micro-batch over in pieces; what reaches the state is ordered within the micro-batch only.
        pdf = pd.concat(list(batches)).sort_values(order)
        out = []
        for at, v in zip(pdf[order], pdf[value], strict=True):
            last = last if pd.isna(v) else float(v)
            out.append((k[0], int(at), last))
        state.update((last,))
        yield pd.DataFrame(out, columns=["key", "at", "value"])

    return records.groupBy(key).applyInPandasWithState(step, "key string, at long, value double", "last double", "append", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there now into Parquet; a rerun with the same checkpoint goes on where it stopped."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def run_each_batch(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    """Hands every micro-batch to ``sink(rows, number)``; with an idempotent sink each batch counts once."""
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def read_stream(spark: SparkSession, path: str, schema: str, files_at_once: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)
