"""Contracts: each counts its violations; ``enforce`` raises. Nothing is repaired.

Checks of one table are one aggregate, so a panel is scanned once however many of them are asked for.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnfield.functions.scalars import is_real
from cairnfield.sources.work import large


class ContractError(ValueError):
    """A table breaks a contract."""


def obligatory_columns(df: DataFrame, names: Sequence[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ContractError(f"missing columns: {missing}")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def _bad(name: str) -> Column:
    return ~is_real(F.col(name).cast("double"))


def violations(df: DataFrame, height: int, width: int, row_offset: int, col_offset: int, statics: Sequence[str] = (), static_limit: float = 1e4) -> DataFrame:
    """(check_name, violations) of the ingestion contracts: keys, identities, span, anchor, finite numbers, statics.

    Expects month_id, unit, row, col. Statics must be finite, within the limit, and constant over a unit's months.
    """
    n = lambda cond: F.count(F.when(cond, 1))
    keyed = df.groupBy("month_id", "unit").agg(F.count("*").alias("k"))
    placed = df.groupBy("month_id", "row", "col").agg(F.count("*").alias("k"))
    numbers = [c for c in numeric_columns(df) if c not in ("month_id", "unit", "row", "col")]
    one = df.agg(
        n(_bad("month_id") | _bad("unit") | _bad("row") | _bad("col")).alias("identity_finite"),
        n(F.col("unit") <= 0).alias("unit_positive"),
        n(F.col("row") < row_offset).alias("anchor_row"),
        n(F.col("col") < col_offset).alias("anchor_col"),
        (F.max("row") - F.min("row") >= height).cast("long").alias("span_rows"),
        (F.max("col") - F.min("col") >= width).cast("long").alias("span_cols"),
        *[n(_bad(c)).alias(f"finite_{c}") for c in numbers],
        *[n(F.abs(c) > static_limit).alias(f"scale_{c}") for c in statics],
    )
    parts = [
        keyed.agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("key_unique")),
        placed.agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("place_unique")),
        one,
    ]
    if statics:
        ranges = df.groupBy("unit").agg(*[(F.max(c) - F.min(c)).alias(c) for c in statics])
        parts.append(ranges.agg(*[n(F.col(c) > 1e-9).alias(f"constant_{c}") for c in statics]))
    out = None
    for part in parts:
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("check_name"), F.col(c).cast("long").alias("violations")) for c in part.columns])).alias("p")
        rows = part.select(pairs).select("p.check_name", F.coalesce("p.violations", F.lit(0).cast("long")).alias("violations"))
        out = rows if out is None else out.unionByName(rows)
    return out


def enforce(found: DataFrame) -> None:
    """Raises with every check that counted a violation; the table has a row for each check."""
    bad = {r["check_name"]: r["violations"] for r in found.where("violations > 0").collect()}
    if bad:
        raise ContractError(f"contract violations: {bad}")


def duplicate_examples(df: DataFrame, key: Sequence[str], n: int = 5) -> DataFrame:
    """The first n repeated keys, in key order, and how often each occurs.

    Keys are dealt to all tasks of a shuffle: a panel's keys are packed so well that Spark would join their partitions to one.
    """
    keys = df.select(*key).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)
    return keys.groupBy(*key).count().where("count > 1").orderBy(*key).limit(n)


def forecast_alignment(history: DataFrame, scaffold: DataFrame) -> None:
    """The scaffold must start in the month after the history ends."""
    last = history.agg(F.max("month_id")).first()[0]
    first = scaffold.agg(F.min("month_id")).first()[0]
    if last is None or first != last + 1:
        raise ContractError(f"history ends at {last}, the scaffold starts at {first}")


def grid_bounds(df: DataFrame, height: int, width: int, row_offset: int, col_offset: int) -> None:
    low_r, high_r, low_c, high_c = df.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    if low_r is None:
        return
    problems = [
        text
        for bad, text in (
            (low_r < row_offset, "a row lies before the grid"),
            (high_r >= row_offset + height, "a row lies behind the grid"),
            (low_c < col_offset, "a column lies before the grid"),
            (high_c >= col_offset + width, "a column lies behind the grid"),
        )
        if bad
    ]
    if problems:
        raise ContractError("; ".join(problems))


def complete_join(joined: DataFrame, column: str) -> DataFrame:
    """``joined``, if every row found its partner; never an inner join in silence."""
    lost = joined.where(F.col(column).isNull()).limit(1).count()
    if lost:
        raise ContractError(f"rows without {column} after the join")
    return joined


def samples_contract(store: DataFrame, least: int = 2) -> DataFrame:
    """(check_name, violations): vectors shorter than ``least``, unlike widths, draws that are no numbers."""
    one = store.agg(
        F.count(F.when(F.size("samples") < least, 1)).alias("samples_few"),
        (F.countDistinct(F.size("samples")) - 1).alias("samples_ragged"),
        F.count(F.when(F.exists("samples", lambda x: ~is_real(x)), 1)).alias("samples_finite"),
    )
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("check_name"), F.greatest(F.col(c), F.lit(0)).cast("long").alias("violations")) for c in one.columns])).alias("p")
    return one.select(pairs).select("p.check_name", "p.violations")


def probability_range(df: DataFrame, column: str, slack: float = 1e-6) -> None:
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is not None and (low < -slack or high > 1 + slack):
        raise ContractError(f"{column} lies outside [0, 1]: {low} to {high}")


def coverage(arms: dict[str, DataFrame], common: DataFrame, tolerance: float = 0.2) -> list[str]:
    """Names of arms that lose over ``tolerance`` of their keys to the common support; an empty support is an error."""
    kept = common.count()
    if not kept:
        raise ContractError("no key is common to all arms")
    return [name for name, df in arms.items() if kept < (1 - tolerance) * df.count()]


def headline(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` whose rows raise when one of the columns is missing or no number."""
    obligatory_columns(df, columns)
    bad = None
    for c in columns:
        bad = ~is_real(F.col(c).cast("double")) if bad is None else bad | ~is_real(F.col(c).cast("double"))
    return df.select(*[F.when(bad, F.raise_error(F.lit("a headline row is incomplete"))).otherwise(F.col(c)).alias(c) if c == columns[0] else F.col(c) for c in df.columns])


def output_schema(df: DataFrame, targets: Sequence[str], identities: Sequence[str] = ("month_id", "unit")) -> None:
    """Predictions are named ``pred_`` and their target, each target once, beside the identities."""
    obligatory_columns(df, [*identities, *(f"pred_{t}" for t in targets)])
    odd = [c for c in df.columns if c.startswith("pred_") and c.removeprefix("pred_") not in targets]
    legacy = [c for c in df.columns if re.search(r"_(raw|log|mean)$", c) and c.startswith("pred_")]
    if odd or legacy:
        raise ContractError(f"unexpected predictions: {sorted({*odd, *legacy})}")


def provenance(store: DataFrame, train_end: int, least_samples: int = 2) -> DataFrame:
    """(origin, leaks, few): origins whose first month is not after training, and whose vectors are too short."""
    return store.groupBy("origin").agg((F.min("month_id") <= train_end).alias("leaks"), (F.min(F.size("samples")) < least_samples).alias("few"))


def parity(a: DataFrame, b: DataFrame, key: Sequence[str], tolerance: float = 1e-5, relative: float = 1e-5) -> DataFrame:
    """(column_name, mismatches, only_a, only_b): two keyed tables compared in any order; numbers within a tolerance."""
    columns = [c for c in a.columns if c not in key]
    left = a.select(*key, *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(1).alias("_a"))
    right = b.select(*key, *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(1).alias("_b"))
    both = left.join(large(right), list(key), "full")
    kinds = dict(a.dtypes)

    def differ(c: str) -> Column:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        if kinds[c] in ("double", "float"):
            return ~(F.coalesce(F.abs(x - y) <= tolerance + relative * F.abs(y), F.lit(False)) | x.eqNullSafe(y))
        return ~x.eqNullSafe(y)

    paired = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    one = both.agg(
        F.count(F.when(F.col("_b").isNull(), 1)).alias("only_a"),
        F.count(F.when(F.col("_a").isNull(), 1)).alias("only_b"),
        *[F.count(F.when(paired & differ(c), 1)).alias(f"m_{c}") for c in columns],
    )
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"m_{c}").alias("mismatches")) for c in columns])).alias("p")
    return one.select(pairs, "only_a", "only_b").select("p.column_name", "p.mismatches", "only_a", "only_b")
