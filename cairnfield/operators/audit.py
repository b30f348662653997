"""Audits and readouts: rows that gather several scores, divergence of two panels, health of parameters, naming and calendars."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnfield.functions import arrays
from cairnfield.functions.registry import COLLAPSES, lookup
from cairnfield.functions.scalars import logit
from cairnfield.operators import order
from cairnfield.operators.scores import ratio
from cairnfield.sources.work import large


def collapse(store: DataFrame, method: str) -> DataFrame:
    """Sample vectors to one point, by a registered method; call it after the samples are back in count space."""
    return store.withColumn("point", lookup(COLLAPSES, method)(F.col("samples"))).drop("samples")


def wide_predictions(store: DataFrame, targets: Sequence[str]) -> DataFrame:
    """One row for each key with ``pred_`` and the target's name for each target's vector."""
    keys = [c for c in store.columns if c not in ("target", "samples", "gate", "y")]
    return store.groupBy(*keys).pivot("target", list(targets)).agg(F.first("samples")).select(*keys, *[F.col(t).alias(f"pred_{t}") for t in targets])


def evaluation_join(actual: DataFrame, predictions: DataFrame, steps: Mapping[int, Mapping[int, int]]) -> DataFrame:
    """Predictions with their truth and step from the month-to-step map declared for each origin; months outside it raise."""
    spark = actual.sparkSession
    table = spark.createDataFrame([(int(o), int(m), int(s)) for o, of in steps.items() for m, s in of.items()], "m0 int, month_id int, step int")
    joined = predictions.join(F.broadcast(table), ["m0", "month_id"], "left")
    step = F.when(F.col("step").isNull(), F.raise_error(F.lit("a predicted month has no step"))).otherwise(F.col("step"))
    return joined.withColumn("step", step).join(large(actual), ["month_id", "unit", "target"])


def unmatched(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """(only_a, only_b, both): how many keys each side has alone."""
    keys = list(key)
    left = a.select(*keys).join(large(b.select(*keys)), keys, "left_anti").agg(F.count("*").alias("only_a"))
    right = b.select(*keys).join(large(a.select(*keys)), keys, "left_anti").agg(F.count("*").alias("only_b"))
    both = a.select(*keys).join(large(b.select(*keys)), keys, "left_semi").agg(F.count("*").alias("both"))
    return left.crossJoin(right).crossJoin(both)


def audit_rows(cells: DataFrame, by: Sequence[str], tail: float = 100.0) -> DataFrame:
    """(by, n, prevalence, y_max, ey_max, crps, brier, within2, zero_mass, tail_n, p10, p50, p90): one aggregation for each step's audit, and its quantiles."""
    event = F.col("y") > 0
    r = F.when(event, F.col("ey") / F.col("y"))
    one = cells.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(event.cast("double")).alias("prevalence"),
        F.max("y").alias("y_max"),
        F.max("ey").alias("ey_max"),
        F.avg("crps").alias("crps"),
        F.avg(F.pow(F.col("p") - event.cast("double"), 2)).alias("brier"),
        F.avg(r.between(0.5, 2.0).cast("double")).alias("within2"),
        ratio(F.sum(F.when(event, 0.0).otherwise(F.col("ey"))), F.sum("ey")).alias("zero_mass"),
        F.count(F.when(F.col("y") >= tail, 1)).alias("tail_n"),
    )
    return order.with_quantiles(one, cells, by, {"p10": (r, 0.1), "p50": (r, 0.5), "p90": (r, 0.9)})


def proper_scores(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, n, crps, tw0, tw1, mcr, y_mean, ey_mean): proper scores of one subset in one aggregation."""
    s, y = F.col("samples"), F.col("y")
    one = scored.select(*by, "y", arrays.mean(s).alias("ey"), arrays.crps(s, y).alias("c"), arrays.tw_crps(s, y, 0.0).alias("t0"), arrays.tw_crps(s, y, 1.0).alias("t1"))
    return one.groupBy(*by).agg(F.count("*").alias("n"), F.avg("c").alias("crps"), F.avg("t0").alias("tw0"), F.avg("t1").alias("tw1"), ratio(F.sum("ey"), F.sum("y")).alias("mcr"), F.avg("y").alias("y_mean"), F.avg("ey").alias("ey_mean"))


def step_and_full(cells: DataFrame) -> DataFrame:
    """Every cell under the tag FULL, and first-month cells under STEP-1 too."""
    return cells.withColumn("tag", F.explode(F.filter(F.array(F.lit("FULL"), F.when(F.col("h") == 1, "STEP-1")), lambda x: x.isNotNull())))


def divergence(a: DataFrame, b: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """(by, n, abs_diff, sum_a, sum_b, both_zero, only_a, only_b, neither_zero): where two panels part, missing counting as zero."""
    key = ["month_id", "unit"]
    left = a.select(*key, F.col(column).alias("x"))
    right = b.select(*key, F.col(column).alias("z"))
    both = left.join(large(right), key, "full").withColumns({"x": F.coalesce("x", F.lit(0.0)), "z": F.coalesce("z", F.lit(0.0))})
    x, z = F.col("x"), F.col("z")
    n = lambda cond: F.count(F.when(cond, 1))
    return both.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sum(F.abs(x - z)).alias("abs_diff"),
        F.sum(x).alias("sum_a"),
        F.sum(z).alias("sum_b"),
        n((x == 0) & (z == 0)).alias("both_zero"),
        n((x != 0) & (z == 0)).alias("only_a"),
        n((x == 0) & (z != 0)).alias("only_b"),
        n((x != 0) & (z != 0)).alias("neither_zero"),
    )


def parameter_health(params: DataFrame, active: Column) -> DataFrame:
    """(mu_mean, theta_cov, pi_mean, pi_min, pi_max): theta's population deviation over its mean, on active cells."""
    theta = F.when(active, F.col("theta"))
    return params.agg(F.avg("mu").alias("mu_mean"), ratio(F.stddev_pop(theta), F.avg(theta)).alias("theta_cov"), F.avg("pi").alias("pi_mean"), F.min("pi").alias("pi_min"), F.max("pi").alias("pi_max"))


def gate_penalty(params: DataFrame, prior_logit: float, scale: float, weight: str | None = None) -> DataFrame:
    """(penalty): scale times the weighted mean of (logit pi - prior)^2, pi clipped off its ends."""
    p = F.least(F.greatest(F.col("pi"), F.lit(1e-6)), F.lit(1 - 1e-6))
    w = F.col(weight) if weight else F.lit(1.0)
    return params.agg((scale * F.sum(w * F.pow(logit(p) - prior_logit, 2)) / F.greatest(F.sum(w), F.lit(1e-8))).alias("penalty"))


def block_norms(weights: DataFrame) -> DataFrame:
    """(block, tensors, mean_norm): mean L2 norm of the tensors of each block, from (name, value); the block is the name up to the first dot."""
    per = weights.groupBy("name").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    return per.groupBy(F.substring_index("name", ".", 1).alias("block")).agg(F.count("*").alias("tensors"), F.avg("norm").alias("mean_norm"))


def horizon_slices(metrics: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, first, third, last): the value at the first step, at the step a third of the way, and at the last step recorded."""
    steps = metrics.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("h", F.col(value).alias("v")))).alias("s"))
    at = lambda i: F.get("s", i)["v"]
    return steps.select(*by, at(F.lit(0)).alias("first"), at(F.floor(F.size("s") / 3).cast("int")).alias("third"), at(F.size("s") - 1).alias("last"))


def top_rows(rows: DataFrame, column: str, n: int = 8, ties: Sequence[str] = ()) -> DataFrame:
    """The n rows with the largest value, for a report."""
    return rows.orderBy(F.desc(column), *ties).limit(n)


def temporal_mean(dense: DataFrame, columns: Sequence[str], months: int = 5) -> DataFrame:
    """(unit, means) over evenly spaced months, first and last included."""
    ends = dense.agg(F.min("month_id").alias("a"), F.max("month_id").alias("b"))
    at = F.transform(F.sequence(F.lit(0), F.lit(months - 1)), lambda i: (F.col("a") + F.floor(i * (F.col("b") - F.col("a")) / (months - 1))).cast("int"))
    wanted = ends.select(F.explode(F.array_distinct(at)).alias("month_id"))
    return dense.join(F.broadcast(wanted), "month_id").groupBy("unit").agg(*[F.avg(c).alias(c) for c in columns])


def month_names(months: DataFrame) -> DataFrame:
    """(month_id, year, month, first_day): calendar of the month ordinal, 1 for January 1980."""
    m = F.col("month_id") - 1
    year, month = (1980 + F.floor(m / 12)).cast("int"), (m % 12 + 1).cast("int")
    return months.select("month_id", year.alias("year"), month.alias("month"), F.make_date(year, month, F.lit(1)).cast("string").alias("first_day"))


def artifact_names(names: DataFrame) -> DataFrame:
    """(name, label, stamp, gate): a file-safe label, the run's time stamp at the end of the name, and the gate's name for a target."""
    n = F.col("name")
    return names.select("name", F.translate(F.lower(n), " /", "__").alias("label"), F.regexp_extract(n, r"(\d{8}_\d{6})$", 1).alias("stamp"), F.regexp_replace(F.regexp_replace(n, "^pred_", ""), "^lr_", "by_").alias("gate"))


def config_records(configs: DataFrame) -> DataFrame:
    """(name, steps, threshold) read from JSON text."""
    parsed = F.from_json("body", "name string, time_steps int, derivations struct<threshold: double>")
    return configs.select(parsed.alias("c")).select(F.col("c.name").alias("name"), F.col("c.time_steps").alias("steps"), F.col("c.derivations.threshold").alias("threshold"))


def mixed_inputs(panel: DataFrame, own: DataFrame, epsilon: float, uniform: Column) -> DataFrame:
    """(month_id, unit, x): the truth with chance epsilon, else the model's own last output."""
    joined = panel.join(large(own), ["month_id", "unit"])
    return joined.select("month_id", "unit", F.when(uniform < epsilon, F.col("y")).otherwise(F.col("own")).alias("x"))


def persistence_share(dense: DataFrame, column: str) -> DataFrame:
    """(month_id, same, n): how many cells repeat last month's value."""
    before = F.lag(column).over(W.partitionBy("unit").orderBy("month_id"))
    return dense.select("month_id", (F.col(column) == before).alias("s")).where("s is not null").groupBy("month_id").agg(F.count(F.when(F.col("s"), 1)).alias("same"), F.count("*").alias("n"))
