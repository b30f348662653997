"""Checks before a run: channels, settings, heads, dispersions, and the way back from levels to counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.functions.scalars import is_real
from cairnfield.operators.contracts import ContractError


def channels(df: DataFrame, ledger: Sequence[str], months: int, keys: Sequence[str] = ("month_id", "unit")) -> DataFrame:
    """(check_name, violations): channels of the ledger that ``df`` lacks, channels beyond it, and how far its months are from ``months``."""
    held = [c for c in df.columns if c not in keys]
    lacking, beyond = len(set(ledger) - set(held)), len(set(held) - set(ledger))
    one = df.agg(
        F.lit(lacking).cast("long").alias("channels_lacking"),
        F.lit(beyond).cast("long").alias("channels_beyond"),
        F.abs(F.countDistinct("month_id") - F.lit(months)).cast("long").alias("months_off"),
    )
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("check_name"), F.col(c).alias("violations")) for c in one.columns])).alias("p")
    return one.select(pairs).select("p.check_name", "p.violations")


def genome(records: DataFrame, core: Sequence[str], losses: Mapping[str, Sequence[str]], loss_key: str = "loss_reg") -> DataFrame:
    """(run, missing, unset, unknown_loss) from settings as rows (run, key, value).

    A run needs every key of ``core`` and those that its loss asks for; ``missing`` are absent, ``unset`` are null.
    """
    names = lambda keys: F.array(*map(F.lit, keys)).cast("array<string>")
    asked = F.create_map(*[part for loss, keys in losses.items() for part in (F.lit(loss), names(keys))])
    one = records.groupBy("run").agg(
        F.collect_set("key").alias("given"),
        F.collect_set(F.when(F.col("value").isNotNull(), F.col("key"))).alias("filled"),
        F.max(F.when(F.col("key") == loss_key, F.col("value"))).alias("loss"),
    )
    needed = F.array_union(names(core), F.coalesce(F.try_element_at(asked, F.col("loss")), names(())))
    return one.select(
        "run",
        F.array_sort(F.array_except(needed, "given")).alias("missing"),
        F.array_sort(F.array_intersect(needed, F.array_except("given", "filled"))).alias("unset"),
        F.coalesce(~F.col("loss").isin(*losses), F.lit(True)).alias("unknown_loss"),
    )


def to_counts(level: Column) -> Column:
    """Counts from log1p levels: raises on what is no number or lies below zero, beyond rounding; null stays null."""
    count = F.expm1(level)
    bad = ~is_real(level) | (count < -1e-6)
    return F.when(level.isNull(), F.lit(None).cast("double")).when(bad, F.raise_error(F.lit("a level is no number or gives a negative count")).cast("double")).otherwise(F.greatest(count, F.lit(0.0)))


def unlike_widths(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """(by…, n, unlike): rows, and rows whose arrays differ in length; a null array is unlike any."""
    differ = ~F.size(a).eqNullSafe(F.size(b)) | F.col(a).isNull() | F.col(b).isNull()
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count(F.when(differ, 1)).alias("unlike"))


def dispersions(given: float | Mapping[str, float] | None, targets: Sequence[str]) -> dict[str, float]:
    """A positive dispersion for each target, in their order, from one number for all or from a mapping."""
    if given is None or not targets:
        raise ContractError("dispersions and targets must be given")
    lacking = [t for t in targets if t not in given] if isinstance(given, Mapping) else []
    if lacking:
        raise ContractError(f"no dispersion for {lacking}")
    found = {t: float(given[t] if isinstance(given, Mapping) else given) for t in targets}
    low = [t for t, v in found.items() if not v > 0]
    if low:
        raise ContractError(f"dispersions must be above zero: {low}")
    return found


def heads(regression: Sequence[str], classification: Sequence[str], least: int = 1) -> int:
    """How many pairs of heads there are; both lists must be distinct, as long as each other, and ``least`` long."""
    if len(set(regression)) != len(regression) or len(set(classification)) != len(classification):
        raise ContractError("a target occurs twice")
    if len(regression) != len(classification) or len(regression) < least:
        raise ContractError(f"{len(regression)} regression and {len(classification)} classification targets")
    return len(regression)


def static_sources(names: Sequence[str], registered: Sequence[str], columns: Sequence[str]) -> dict[str, str]:
    """``geometry`` or ``data`` for each static channel; one that is both or neither is an error."""
    both = [n for n in names if n in registered and n in columns]
    neither = [n for n in names if n not in registered and n not in columns]
    if both or neither:
        raise ContractError(f"static channels with two sources: {both}, with none: {neither}")
    return {n: "geometry" if n in registered else "data" for n in names}


def without_predictions(out: DataFrame, like: DataFrame) -> DataFrame:
    """``out`` without ``pred_`` columns and without ``by_`` columns that ``like`` lacks, its columns ordered and typed as in ``like``."""
    kept = [c for c in out.columns if not c.startswith("pred_") and not (c.startswith("by_") and c not in like.columns)]
    if sorted(kept) != sorted(like.columns):
        raise ContractError(f"columns differ beside predictions: {sorted(set(kept) ^ set(like.columns))}")
    return out.select(*[F.col(f.name).cast(f.dataType) for f in like.schema])
