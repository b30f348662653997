"""Ranks, running sums and exact quantiles of large groups: no task sorts a group and none keeps its values.

Values are dealt to the steps of a fixed logarithmic scale (``bucket``), which respects their order. Counts by step are few
whatever the group's size, so their running sums give every step its offset and tell in which step an order statistic lies.
What is left is inside one step: running sums of its distinct values, or the one value that is asked for. Both passes are
plain aggregations and joins on (group, step), so a group spreads over as many tasks as it has steps.

Nulls rank below all numbers and NaN above them; quantiles leave nulls out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnfield.sources.work import large

#: Steps for each power of two; values in one step differ by less than one in a thousand.
STEPS = 1024
#: Every exponent of a double is above -OCTAVES and below OCTAVES.
OCTAVES = 1100


def bucket(value: Column) -> Column:
    """The step of a number, a long that never falls as the number rises."""
    v = value.cast("double")
    size = F.floor(F.log2(F.when(F.abs(v) < float("inf"), F.abs(v))) * STEPS) + OCTAVES * STEPS
    end = F.lit(2 * OCTAVES * STEPS + 2).cast("long")
    known = F.when(F.isnan(v), end).when(v == float("inf"), end - 1).when(v == float("-inf"), 1 - end).when(v == 0, 0).when(v > 0, size).otherwise(-size)
    return F.coalesce(F.when(v.isNotNull(), known), -end)


def before(ties: DataFrame, by: Sequence[str], value: str, sums: Sequence[str], falling: bool = False) -> DataFrame:
    """``ties``, one row for each (by, value), with ``<c>_before`` for each c of ``sums``: its sum over the smaller values of the
    group (``falling``: over the larger ones)."""
    step = bucket(F.col(value))
    dealt = ties.withColumn("_step", -step if falling else step)
    keys = [*by, "_step"]
    earlier = lambda name, over: F.coalesce(F.sum(name).over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = dealt.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
    offsets = totals.select(*keys, *[earlier(c, W.partitionBy(*by).orderBy("_step")).alias(f"_o_{c}") for c in sums])
    inside = W.partitionBy(*keys).orderBy(F.desc_nulls_last(value) if falling else F.asc_nulls_first(value))
    rows = dealt.select("*", *[earlier(c, inside).alias(f"_i_{c}") for c in sums])
    return rows.join(large(offsets), keys).select(*ties.columns, *[(F.col(f"_o_{c}") + F.col(f"_i_{c}")).alias(f"{c}_before") for c in sums])


def quantiles(df: DataFrame, by: Sequence[str], asked: dict[str, tuple[Column, float]]) -> DataFrame:
    """(by, a column for each name of ``asked``): the exact quantile of a column at a level, interpolated between neighbours;
    null, or no row, where the group has no value."""
    levels: dict[str, list[tuple[str, float]]] = {}
    columns: dict[str, Column] = {}
    for name, (column, level) in asked.items():
        columns.setdefault(str(column), column)
        levels.setdefault(str(column), []).append((name, level))
    values = [F.struct(F.lit(m).alias("m"), c.cast("double").alias("v")) for m, c in enumerate(columns.values())]
    each = df.select(*by, F.explode(F.filter(F.array(*values), lambda s: s["v"].isNotNull())).alias("_s")).select(*by, F.col("_s.m").alias("_m"), F.col("_s.v").alias("_v"))
    ties = each.withColumn("_step", bucket(F.col("_v"))).groupBy(*by, "_m", "_step", "_v").agg(F.count("*").alias("_n"))
    keys = [*by, "_m", "_step"]
    steps, whole = W.partitionBy(*by, "_m").orderBy("_step").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*by, "_m")
    counts = ties.groupBy(*keys).agg(F.sum("_n").alias("_k"))
    placed = counts.select(*keys, "_k", F.coalesce(F.sum("_k").over(steps), F.lit(0)).alias("_o"), F.sum("_k").over(whole).alias("_all"))

    def places(level: float) -> tuple[Column, Column]:
        at = F.lit(float(level)) * (F.col("_all") - 1)
        return F.floor(at), F.ceil(at)

    within = lambda at, start, n: (start <= at) & (at < start + n)
    wanted = F.lit(False)
    for m, mine in enumerate(levels.values()):
        for _, level in mine:
            for at in places(level):
                wanted = wanted | ((F.col("_m") == m) & within(at, F.col("_o"), F.col("_k")))
    found = ties.join(large(placed.where(wanted).drop("_k")), keys)
    inside = W.partitionBy(*keys).orderBy("_v").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("_o") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    ranked = found.select(*by, "_m", "_v", "_n", "_all", start.alias("_start"))
    out = []
    for m, mine in enumerate(levels.values()):
        for name, level in mine:
            value = lambda at, m=m: F.max(F.when((F.col("_m") == m) & within(at, F.col("_start"), F.col("_n")), F.col("_v")))
            low, high = places(level)
            share = F.max(F.when(F.col("_m") == m, F.lit(float(level)) * (F.col("_all") - 1) - low))
            out.append(F.when(value(low) == value(high), value(low)).otherwise(value(low) * (1 - share) + value(high) * share).alias(name))
    return ranked.groupBy(*by).agg(*out).select(*by, *asked)


def with_quantiles(rows: DataFrame, df: DataFrame, by: Sequence[str], asked: dict[str, tuple[Column, float]]) -> DataFrame:
    """``rows``, one for each group of ``df``, with the groups' quantiles; null where a group has no value."""
    return rows.join(quantiles(df, by, asked), list(by), "left")


def ranks(df: DataFrame, by: Sequence[str], column: str, count: str = "n") -> DataFrame:
    """(by, column, n, rank): the average rank of the rows that share a value."""
    ties = df.groupBy(*by, column).agg(F.count("*").alias(count))
    return before(ties, by, column, [count]).select(*by, column, count, (F.col(f"{count}_before") + (F.col(count) + 1) / 2.0).alias("rank"))
