"""Scans: panels, truths, prediction stores, scoreboards, sidecars and artifacts.

All are plain ``spark.read`` plans, so filters on month, origin, target or horizon and column pruning reach the files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnfield.operators.contracts import ContractError
from cairnfield.schema import unit_column


def panel(spark: SparkSession, path: str, columns: Sequence[str] | None = None, through: int | None = None, months: Sequence[int] | None = None) -> DataFrame:
    """A raw panel with its cell column named ``unit``; only the given columns, months and months up to ``through``."""
    df = spark.read.parquet(path)
    df = df.withColumnRenamed(unit_column(df.columns), "unit")
    if through is not None:
        df = df.where(F.col("month_id") <= through)
    if months is not None:
        df = df.where(F.col("month_id").isin([int(m) for m in months]))
    return df.select("month_id", "unit", *columns) if columns else df


def run_path(root: str, run_type: str, suffix: str = ".parquet") -> str:
    """Where a run type's raw panel lies."""
    if run_type not in ("calibration", "validation", "forecasting"):
        raise ValueError(f"unknown run type {run_type!r}")
    return f"{root.rstrip('/')}/{run_type}_panel{suffix}"


def truth(spark: SparkSession, path: str, targets: Sequence[str], months: Sequence[int] | None = None) -> DataFrame:
    """(month_id, unit, targets…); a key that occurs twice is an error."""
    df = panel(spark, path, targets, months=months)
    if df.groupBy("month_id", "unit").count().where("count > 1").limit(1).count():
        raise ContractError("the truth's (month_id, unit) is not unique")
    return df


def active_months(panel_df: DataFrame, target: str) -> DataFrame:
    """(unit, months): the sorted months in which the target is above zero."""
    return panel_df.where(F.col(target) > 0).groupBy("unit").agg(F.array_sort(F.collect_set("month_id")).alias("months"))


def with_horizon(store: DataFrame, by: Sequence[str] = ("origin",)) -> DataFrame:
    """A store with m0 (the first month of each origin) and h = month_id - m0 + 1."""
    first = store.groupBy(*by).agg(F.min("month_id").alias("m0"))
    return store.join(first, list(by)).withColumn("h", (F.col("month_id") - F.col("m0") + 1).cast("int"))


def prediction_store(spark: SparkSession, path: str, target: str | None = None, horizons: Sequence[int] | None = None) -> DataFrame:
    """The store written by ``sinks.write_predictions``; target and horizon are partitions of its folders."""
    df = spark.read.parquet(path)
    if target is not None:
        df = df.where(F.col("target") == target)
    return df if horizons is None else df.where(F.col("h").isin([int(h) for h in horizons]))


def emitted_months(store: DataFrame) -> DataFrame:
    """(origin, first, last, n): the month range of each origin; samples are never read."""
    return store.groupBy("origin").agg(F.min("month_id").alias("first"), F.max("month_id").alias("last"), F.countDistinct("month_id").alias("n"))


def sample_width(store: DataFrame) -> int:
    """The one number of draws that all rows share; several are an error."""
    found = [r[0] for r in store.select(F.size("samples").alias("s")).distinct().limit(3).collect()]
    if len(found) != 1:
        raise ContractError(f"sample vectors must share one width, found {sorted(found)}")
    return found[0]


def support_summary(panel_df: DataFrame) -> DataFrame:
    return panel_df.agg(F.min("month_id").alias("first"), F.max("month_id").alias("last"), F.countDistinct("month_id").alias("months"), F.countDistinct("unit").alias("units"))


def unit_grid(panel_df: DataFrame, row_offset: int = 0, col_offset: int = 0) -> DataFrame:
    """(unit, r, c): each unit's one place; a unit in two places is an error."""
    places = panel_df.select("unit", (F.col("row") - row_offset).alias("r"), (F.col("col") - col_offset).alias("c")).distinct()
    if places.groupBy("unit").count().where("count > 1").limit(1).count():
        raise ContractError("a unit has two places")
    return places


def scoreboards(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every score CSV under ``path``, read with one schema."""
    return spark.read.option("header", True).schema(schema).csv(path)


def sidecar(spark: SparkSession, path: str) -> DataFrame:
    """The JSON settings beside an artifact, one row for each file."""
    return spark.read.option("multiLine", True).json(path)


def artifacts(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, length, modified) of binary artifacts."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), "length", F.col("modificationTime").alias("modified"))


def latest_artifact(spark: SparkSession, path: str, sha256: str | None = None) -> DataFrame:
    """The newest artifact (by the time stamp that ends its name); a wrong checksum is an error."""
    # Names first: only the content of the one that is chosen is read and hashed.
    names = spark.read.format("binaryFile").load(path).select("path", F.regexp_extract("path", r"(\d{8}_\d{6})\.[A-Za-z0-9.]+$", 1).alias("stamp"))
    newest = names.orderBy(F.desc("stamp"), F.desc("path")).first()
    if newest is None:
        return artifacts(spark, path).withColumn("stamp", F.lit(""))
    found = artifacts(spark, newest["path"]).withColumn("stamp", F.lit(newest["stamp"]))
    if sha256 is not None and [r["sha256"] for r in found.collect()] != [sha256]:
        raise ContractError("the artifact's checksum differs from its record")
    return found


def file_order(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a Parquet folder with ``position``, their place from 0 in the order of its files; only counts by file are summed."""
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    counts = rows.groupBy("_file").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_file", before.alias("_start"))
    return rows.join(starts, "_file").withColumn("position", F.col("_start") + F.col("_at")).drop("_file", "_at", "_start")
