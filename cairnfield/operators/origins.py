"""Rolling origins, horizons, supports, reference forecasts and pre-origin strata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnfield.functions import keyed
from cairnfield.sources.work import large


def rolling_origins(total_months: int, time_steps: int, num_windows: int, last: int | None = None) -> list[int]:
    """Indices of the origins, ascending: the last leaves room for the steps; none if there is no room."""
    final = total_months - time_steps - 1 if last is None else last
    if final < 0:
        return []
    n = min(num_windows, final + 1)
    return list(range(final - n + 1, final + 1))


def origins_table(spark: SparkSession, indices: Sequence[int], first_month: int) -> DataFrame:
    """(origin, m0): index of the last known month, and the first month to predict."""
    return spark.createDataFrame([(int(i), int(first_month + i + 1)) for i in indices], "origin int, m0 int")


def fan_out(dense: DataFrame, origins: DataFrame, steps: int) -> DataFrame:
    """Every origin's months m0 to m0 + steps - 1 with h from 1; windows overlap.

    Each origin lists its months, so the sliding window is an equi-join with a small table.
    """
    wanted = origins.select("origin", "m0", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("h")).withColumn("month_id", (F.col("m0") + F.col("h") - 1).cast("int"))
    return dense.join(F.broadcast(wanted), "month_id")


def horizons_of(store: DataFrame, by: Sequence[str]) -> DataFrame:
    """h = month - first month of the origin + 1."""
    return store.withColumn("h", (F.col("month_id") - F.min("month_id").over(W.partitionBy(*by)) + 1).cast("int"))


def common_support(store: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """(m0, unit) present for every arm of the store at every horizon; samples are not read."""
    keys = store.where(F.col("h").isin([int(h) for h in horizons])).select("arm", "m0", "unit", "h").distinct()
    arms = keys.select(F.countDistinct("arm").alias("arms"))
    full = keys.groupBy("m0", "unit").agg(F.count("*").alias("n"))
    return full.crossJoin(F.broadcast(arms)).where(F.col("n") == F.col("arms") * len(horizons)).select("m0", "unit")


def with_truth(store: DataFrame, truth: DataFrame, missing: str) -> DataFrame:
    """The store with y from (month_id, unit, target, y); ``missing`` is 'error' or 'zero'."""
    if missing not in ("error", "zero"):
        raise ValueError("missing must be 'error' or 'zero'")
    joined = store.join(large(truth), ["month_id", "unit", "target"], "left")
    if missing == "zero":
        return joined.withColumn("y", F.coalesce("y", F.lit(0.0)))
    return joined.withColumn("y", F.when(F.col("y").isNull(), F.raise_error(F.lit("a prediction has no truth"))).otherwise(F.col("y")))


def pre_origin(truth: DataFrame, origins: DataFrame, window: int) -> DataFrame:
    """(m0, unit, target, month_id, y): the truth of the ``window`` months before each origin, and no later.

    An equi-join on the month: every origin lists its months.
    """
    months = origins.select("m0", F.explode(F.sequence(F.col("m0") - window, F.col("m0") - 1)).alias("month_id")).withColumn("month_id", F.col("month_id").cast("int"))
    return truth.join(F.broadcast(months), "month_id")


def risk_stratum(truth: DataFrame, origins: DataFrame, window: int = 12) -> DataFrame:
    """(m0, unit, target, active): whether the cell had any event in the months before the origin."""
    return pre_origin(truth, origins, window).groupBy("m0", "unit", "target").agg((F.max("y") > 0).alias("active"))


def persistence(truth: DataFrame, origins: DataFrame, horizons: Sequence[int], samples: int) -> DataFrame:
    """The value of the month before the origin as every draw of every horizon."""
    last = origins.select("m0", (F.col("m0") - 1).cast("int").alias("month_id"))
    known = truth.join(F.broadcast(last), "month_id").select("m0", "unit", "target", F.col("y").alias("v"))
    ahead = known.select("*", F.explode(F.array(*[F.lit(int(h)) for h in horizons])).alias("h"))
    return ahead.select("target", "m0", "h", (F.col("m0") + F.col("h") - 1).cast("int").alias("month_id"), "unit", F.array_repeat("v", samples).alias("samples"))


def climatology(truth: DataFrame, origins: DataFrame, horizons: Sequence[int], *, samples: int, seed: str, window: int = 36, anchor: int | None = None) -> DataFrame:
    """Draws with replacement from each cell's trailing months, the same for every horizon.

    Without an anchor the pool slides: [m0 - window, m0 - 1]; with one it is [anchor - window + 1, anchor] for all
    origins. Draw k takes the pool's month number (48-bit keyed integer mod window); pools are in order of month.
    """
    if anchor is None:
        pooled = pre_origin(truth, origins, window)
    else:
        pooled = truth.where(F.col("month_id").between(anchor - window + 1, anchor)).crossJoin(F.broadcast(origins.select("m0")))
    pool = pooled.groupBy("m0", "unit", "target").agg(F.array_sort(F.collect_list(F.struct("month_id", "y"))).alias("pool"))
    base = F.col("m0") if anchor is None else F.lit(anchor)
    pick = lambda k: F.get("pool", (keyed.integer(F.lit(seed), base, F.col("unit"), F.col("target"), F.lit(k)) % F.size("pool")).cast("int"))["y"]
    drawn = pool.select("m0", "unit", "target", F.array(*[pick(k) for k in range(samples)]).alias("samples"))
    ahead = drawn.select("*", F.explode(F.array(*[F.lit(int(h)) for h in horizons])).alias("h"))
    return ahead.select("target", "m0", "h", (F.col("m0") + F.col("h") - 1).cast("int").alias("month_id"), "unit", "samples")


def last_active(dense: DataFrame, column: str) -> DataFrame:
    """(month_id, unit, since): months since the cell was last active before the month; null if it never was."""
    before = W.partitionBy("unit").orderBy("month_id").rowsBetween(W.unboundedPreceding, -1)
    seen = F.last(F.when(F.col(column) > 0, F.col("month_id")), ignorenulls=True).over(before)
    return dense.select("month_id", "unit", (F.col("month_id") - seen).alias("since"))
