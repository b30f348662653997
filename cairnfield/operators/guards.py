"""Guards around a run: health of predictions, equality of two runs, planned sizes, hold-out, and the losses a run reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.functions import scalars
from cairnfield.functions.registry import lookup
from cairnfield.operators.contracts import ContractError
from cairnfield.operators.rollout import nb_log_pmf


def prediction_health(df: DataFrame, column: str, by: Sequence[str], warn: float = 100.0, alarm: float = 500.0, halt: float = 1000.0) -> DataFrame:
    """(by, n, not_finite, top, status): the largest magnitude of a column and what it calls for: ok, warn, alarm or halt.

    NaN, infinite and null values count as not finite and halt. A group without finite values has a null top.
    """
    x = F.col(column).cast("double")
    real = scalars.is_real(x)
    one = df.groupBy(*by).agg(F.count("*").alias("n"), F.count(F.when(~F.coalesce(real, F.lit(False)), 1)).alias("not_finite"), F.max(F.when(real, F.abs(x))).alias("top"))
    top = F.col("top")
    status = F.when((F.col("not_finite") > 0) | (top > halt), "halt").when(top > alarm, "alarm").when(top > warn, "warn").otherwise("ok")
    return one.withColumn("status", status)


def enforce_health(health: DataFrame) -> DataFrame:
    """``health``, unless a group calls for a halt."""
    halted = health.where("status = 'halt'").limit(1).count()
    if halted:
        raise ContractError("predictions are not finite or beyond the halting magnitude")
    return health


def determinism(a: DataFrame, b: DataFrame, key: Sequence[str], value: str, by: Sequence[str]) -> DataFrame:
    """(by, only_a, only_b, differing, equal, same): two runs compared value by value, bit for bit.

    Each side is reduced to its digests and both are grouped by key once, instead of joined; a key that a run holds twice
    counts as differing.
    """
    digest = F.sha2(F.to_json(F.struct(F.col(value).alias("v"))), 256)
    side = lambda df, n: df.select(*key, digest.alias("d"), F.lit(n).alias("side"))
    both = side(a, 0).unionByName(side(b, 1)).groupBy(*key)
    met = both.agg(F.count(F.when(F.col("side") == 0, 1)).alias("na"), F.count(F.when(F.col("side") == 1, 1)).alias("nb"), F.min("d").alias("low"), F.max("d").alias("high"))
    alone = (F.col("na") == 0) | (F.col("nb") == 0)
    alike = ~alone & (F.col("na") == 1) & (F.col("nb") == 1) & (F.col("low") == F.col("high"))
    one = met.groupBy(*by).agg(
        F.count(F.when(F.col("nb") == 0, 1)).alias("only_a"),
        F.count(F.when(F.col("na") == 0, 1)).alias("only_b"),
        F.count(F.when(~alone & ~alike, 1)).alias("differing"),
        F.count(F.when(alike, 1)).alias("equal"),
    )
    return one.withColumn("same", (F.col("only_a") == 0) & (F.col("only_b") == 0) & (F.col("differing") == 0))


def planned_bytes(store: DataFrame, by: Sequence[str], width: int = 4) -> DataFrame:
    """(by, n, draws, bytes): what the sample vectors of a store take at ``width`` bytes a draw."""
    draws = F.sum(F.size("samples").cast("long"))
    return store.groupBy(*by).agg(F.count("*").alias("n"), draws.alias("draws"), (draws * width).alias("bytes"))


def fits(planned: DataFrame, budget: int) -> DataFrame:
    """``planned``, if its bytes stay within ``budget`` together."""
    total = planned.agg(F.sum("bytes")).first()[0] or 0
    if total > budget:
        raise ContractError(f"{total} bytes are planned, {budget} are allowed")
    return planned


def holdout(panel: DataFrame, steps: int, time: str = "month_id") -> DataFrame:
    """``panel`` without its last ``steps`` months. The bound is one number, so it reaches the scan as a filter."""
    if steps < 0:
        raise ValueError("steps cannot be negative")
    last = panel.agg(F.max(time)).first()[0]
    return panel if last is None else panel.where(F.col(time) <= last - steps)


def worst_over(board: DataFrame, columns: Sequence[str], by: Sequence[str], over: str = "target") -> DataFrame:
    """(by, over, max_<column>...): the largest values over all horizons, for each ``over`` and, where that is null, for all."""
    return board.rollup(*by, over).agg(F.grouping_id().alias("level"), *[F.max(c).alias(f"max_{c}") for c in columns]).where("level <= 1").drop("level")


def body_probe(cells: DataFrame, by: Sequence[str], alive: float = 0.1) -> DataFrame:
    """(by, n_pos, share_alive, ratio_median, ey_mean_pos, ey_max): whether a forecast lives where events are."""
    event = F.col("y") > 0
    at = lambda c: F.when(event, c)
    return cells.groupBy(*by).agg(
        F.count(at(F.lit(1))).alias("n_pos"),
        F.avg(at((F.col("ey") > alive).cast("double"))).alias("share_alive"),
        F.median(at(F.col("ey") / F.col("y"))).alias("ratio_median"),
        F.avg(at(F.col("ey"))).alias("ey_mean_pos"),
        F.max("ey").alias("ey_max"),
    )


def quantile_loss(df: DataFrame, by: Sequence[str], levels: Sequence[float], knots: str = "knots") -> DataFrame:
    """(by, loss): pinball loss of a vector of quantiles, averaged over rows and levels; vectors of another length raise."""
    y = F.col("y")
    taus = F.array(*[F.lit(float(t)) for t in levels])
    each = F.zip_with(knots, taus, lambda q, t: F.greatest(t * (y - q), (t - 1) * (y - q)))
    whole = F.when(F.size(knots) == len(levels), F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / len(levels))
    checked = F.when(F.size(knots) != len(levels), F.raise_error(F.lit("as many quantiles as levels are needed"))).otherwise(whole)
    return df.select(*by, checked.alias("l")).groupBy(*by).agg(F.avg("l").alias("loss"))


def latent_losses(df: DataFrame, by: Sequence[str], theta: float, latent: str = "latent", target: str = "target_log") -> DataFrame:
    """(by, dense, truncated): negative binomial losses of a raw latent against a log1p target.

    Dense takes all rows, truncated the positive ones with P(0) taken out; 0 where there are none.
    """
    if theta <= 0:
        raise ValueError("theta must be positive")
    y, mu = scalars.to_counts(F.col(target)), scalars.softplus(F.col(latent))
    parts = df.select(*by, y.alias("y"), mu.alias("mu"))
    log_p = nb_log_pmf(F.col("y"), F.col("mu"), F.lit(theta))
    zero = scalars.nb_zero(F.col("mu"), F.lit(theta))
    lost = parts.select(*by, "y", (-log_p).alias("l"), F.log1p(-F.least(zero, F.lit(1 - 1e-12))).alias("rest"))
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return lost.groupBy(*by).agg(mean(F.col("l")).alias("dense"), mean(F.when(F.col("y") > 0, F.col("l") + F.col("rest"))).alias("truncated"))


def balanced(loss: Column, log_var: Column, regression: Column, eps: float = 1e-8) -> Column:
    """A task's loss weighted by its uncertainty; a regression's variance counts twice."""
    deviation = F.exp(log_var / 2)
    weight = 1 / (F.when(regression, 2.0).otherwise(1.0) * deviation * deviation + eps)
    return weight * loss + F.log(deviation + eps)


#: A family's parameters before training, in the order of the head: (parameter, name of its prior, value without one).
BIASES: dict[str, tuple[tuple[str, str | None, float], ...]] = {
    "nb": (("mu", None, 0.5), ("theta", "theta", 1.0)),
    "zinb": (("mu", None, 0.5), ("theta", "theta", 1.0), ("pi", "pi", 0.9)),
    "mixture": (("w", "w", 0.9), ("mu1", "mu", 0.5), ("theta1", "theta", 1.0), ("gap", "tail_gap", 5.0), ("theta2", "theta", 1.0)),
    "truncated": (("mu", None, 0.5), ("theta", "theta", 1.0)),
}


def initial_bias(spark: SparkSession, family: str, priors: Mapping[str, float] | None = None) -> DataFrame:
    """(family, position, parameter, prior, raw): the raw bias at which a head starts at its priors; shares use the logit link."""
    given = priors or {}
    rows = [(family, i, name, float(given.get(prior, at))) for i, (name, prior, at) in enumerate(lookup(BIASES, family))]
    df = spark.createDataFrame(rows, "family string, position int, parameter string, prior double")
    x = F.col("prior")
    return df.withColumn("raw", F.when(F.col("parameter").isin("pi", "w"), scalars.logit(x)).otherwise(scalars.inverse_softplus(x)))
