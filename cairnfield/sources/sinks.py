"""Sinks: prediction stores by origin and target, scoreboards, audit records."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.sources import work


def write_predictions(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """(origin, target, h, month_id, unit, samples) in folders by target and horizon, so a scan of one reads only its files.

    Rows are dealt by (target, h, unit) first: each folder gets a file from each of a few tasks rather than from all.
    """
    df.repartition("target", "h", F.pmod(F.xxhash64("unit"), F.lit(8))).write.mode(mode).partitionBy("target", "h").parquet(path)


def write_board(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def union_boards(*boards: DataFrame) -> DataFrame:
    """Boards with different columns in one; what a board lacks is null."""
    out = boards[0]
    for b in boards[1:]:
        out = out.unionByName(b, allowMissingColumns=True)
    return out.select(*sorted(out.columns))


def write_audit(df: DataFrame, path: str) -> None:
    """One JSON record for each row."""
    df.write.mode("overwrite").json(path)


def write_manifest(spark: SparkSession, path: str, name: str, body: bytes, config: Mapping[str, object], required: Sequence[str] = ()) -> None:
    """Appends an artifact's row (name, sha256, bytes, config as JSON) to a manifest table; ``required`` settings must be there."""
    lacking = [k for k in required if k not in config]
    if lacking:
        raise ValueError(f"the configuration lacks {lacking}")
    row = (name, hashlib.sha256(body).hexdigest(), len(body), json.dumps(config, sort_keys=True))
    spark.createDataFrame([row], "name string, sha256 string, bytes long, config string").write.mode("append").parquet(path)


def append_records(records: DataFrame, path: str) -> None:
    """Adds rows of a training trajectory, one for each lesson, to a CSV folder."""
    records.write.mode("append").option("header", True).csv(path)


def markdown(df: DataFrame, limit: int = 200) -> str:
    """A small report table; ``limit`` rows at most."""
    rows = df.limit(limit).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])


def each_origin(df: DataFrame, sink: Callable[[int, DataFrame], None]) -> None:
    """Calls ``sink(origin, rows)`` for each origin in ascending order; only the list of origins reaches the driver.

    ``df`` is computed once, into folders by origin; each call then reads its own folder.
    """
    stored = work.table(df, "origins", by=["origin"])
    for r in stored.select("origin").distinct().orderBy("origin").collect():
        sink(r["origin"], stored.where(F.col("origin") == r["origin"]))


def ascending(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether the partitions of ``df`` follow each other: no key of one lies before a key of an earlier one. Rows reach no driver, one pair a partition does."""
    key = F.struct(*keys)
    ends = df.groupBy(F.spark_partition_id().alias("at")).agg(F.min(key).alias("low"), F.max(key).alias("high")).collect()
    ends.sort(key=lambda r: r["at"])
    return all(a["high"] <= b["low"] for a, b in zip(ends, ends[1:], strict=False))


def write_ordered(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Parquet files that follow each other in order of the keys, each sorted inside.

    Where the partitions follow each other already (a panel that was written month by month) they are only sorted inside;
    else rows are dealt by ranges of the keys first.
    """
    placed = df if ascending(df, keys) else df.repartitionByRange(*keys)
    placed.sortWithinPartitions(*keys).write.parquet(path)
