"""The sequential roll-out and random draws of count families: the steps without a relational form.

A roll-out feeds its own output back, so months of one (origin, block of units) run in order inside one group, pass after pass;
groups run in parallel. A group holds the history and the free months of its block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from cairnfield.functions import arrays, keyed
from cairnfield.functions.registry import lookup
from cairnfield.functions.scalars import log_normal_cdf
from cairnfield.operators.draws import family_draw, family_draws

__all__ = ["FEEDBACKS", "cell_roll_out", "composed", "family_draws", "family_nll", "posterior", "roll_out", "roll_out_samples", "tobit_nll"]

#: (state, field, rng) to (next state, mean field): one step of an injected model on arrays over the cells.
Scorer = Callable[[np.ndarray, np.ndarray, np.random.Generator], tuple[np.ndarray, np.ndarray]]


def smoothing_scorer(state: np.ndarray, field: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A small deterministic model: an exponential average over time."""
    state = 0.7 * state + 0.3 * field
    return state, np.expm1(0.9 * np.log1p(state))


def _stream(*key: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([abs(int(k)) for k in key])))


def _rolled(panel: DataFrame, origins: DataFrame, column: str, emit: Callable[[int, np.ndarray, list], pd.DataFrame], schema: str, *, steps: int, passes: int, history: int, seed: int, scorer: Scorer = smoothing_scorer, feedback: str = "sample", cap: float | None = None, block_units: int | None = 1_000) -> DataFrame:
    """What ``emit`` makes of an origin's passes over a block of units: of m0, the units, and (mean, draw) of each step of each pass."""
    if feedback not in ("mean", "sample", "teacher_forced"):
        raise ValueError(f"unknown feedback {feedback!r}")
    listed = origins.select("m0", F.explode(F.sequence(F.col("m0") - history, F.col("m0") + steps - 1)).alias("month_id")).withColumn("month_id", F.col("month_id").cast("int"))
    rows = panel.select("month_id", "unit", F.col(column).cast("double").alias("x")).join(F.broadcast(listed), "month_id")
    block = F.floor(F.col("unit") / block_units).cast("int") if block_units else F.lit(0)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        m0 = int(pdf["m0"].iloc[0])
        wide = pdf.pivot(index="month_id", columns="unit", values="x").sort_index().fillna(0.0)
        units = wide.columns.to_numpy()
        fields = {month: x for month, x in zip(wide.index, wide.to_numpy(), strict=True)}
        out = []
        for pass_no in range(passes):
            state = np.zeros(len(units))
            mean = np.zeros(len(units))
            rng = _stream(seed, m0, pass_no, int(pdf["block"].iloc[0]))
            for month in range(m0 - history, m0):
                state, mean = scorer(state, fields.get(month, np.zeros(len(units))), rng)
            made = []
            for h in range(1, steps + 1):
                draw = rng.poisson(np.minimum(mean, 1e6)).astype(float)
                made.append((mean, draw))
                fed = mean if feedback == "mean" else draw
                if feedback == "teacher_forced" and m0 + h - 1 in fields:
                    fed = fields[m0 + h - 1]
                state, mean = scorer(state, fed if cap is None else np.minimum(fed, cap), rng)
            out.append(made)
        return emit(m0, units, out)

    return rows.withColumn("block", block).groupBy("m0", "block").applyInPandas(fold, schema)


def roll_out(panel: DataFrame, origins: DataFrame, column: str, **how) -> DataFrame:
    """(m0, pass_no, h, month_id, unit, mean, draw): months before m0 are digested, then ``steps`` months run freely.

    ``feedback`` is what a free step gets: the mean, or one Poisson draw for each cell, capped on the copy fed back only;
    ``teacher_forced`` gets the truth where it is known. Units are dealt in blocks of ``block_units`` ids, so a group holds that many
    units times history and steps whatever the panel's size; this needs a scorer that treats cells by themselves. For one
    that sees the whole grid (a convolution, say) give None: a group then holds the grid. See ``_rolled`` for the settings.
    """

    def emit(m0: int, units: np.ndarray, out: list) -> pd.DataFrame:
        return pd.concat([pd.DataFrame({"m0": m0, "pass_no": p, "h": h, "month_id": m0 + h - 1, "unit": units, "mean": mean, "draw": draw}) for p, made in enumerate(out) for h, (mean, draw) in enumerate(made, 1)])

    return _rolled(panel, origins, column, emit, "m0 int, pass_no int, h int, month_id int, unit long, mean double, draw double", **how)


def roll_out_samples(panel: DataFrame, origins: DataFrame, column: str, **how) -> DataFrame:
    """(m0, h, month_id, unit, samples): ``posterior`` of a roll-out, made where the passes run, so nothing is shuffled again."""

    def emit(m0: int, units: np.ndarray, out: list) -> pd.DataFrame:
        return pd.concat([pd.DataFrame({"m0": m0, "h": h, "month_id": m0 + h - 1, "unit": units, "samples": list(np.stack([made[h - 1][1] for made in out], 1))}) for h in range(1, len(out[0]) + 1)])

    return _rolled(panel, origins, column, emit, "m0 int, h int, month_id int, unit long, samples array<double>", **how)


#: What a free step gets from the mean and the composed draw of the step before; add an entry to extend.
FEEDBACKS: dict[str, Callable[[Column, Column], Column]] = {"mean": lambda mean, draw: mean, "sample": lambda mean, draw: draw}


def composed(draw: Column, p: Column, u: Column, composition: str, threshold: float | None = None) -> Column:
    """A family's draw behind its gate: as it is, zero with chance 1 - p, or zero where p stays below the threshold."""
    if composition == "self_zeroed":
        return draw
    if composition == "soft_gate":
        return F.when(u < p, draw).otherwise(0.0)
    if composition == "threshold_gate" and threshold is not None:
        return F.when(p >= threshold, draw).otherwise(0.0)
    raise ValueError(f"unknown composition {composition!r}, or no threshold")


def cell_roll_out(panel: DataFrame, origins: DataFrame, column: str, *, steps: int, passes: int, history: int, seed: int, family: str, parameters: Callable[[Column], dict[str, Column]], gate: Callable[[Column], Column] | None = None, composition: str = "self_zeroed", threshold: float | None = None, feedback: str = "sample", cap: float | None = None) -> DataFrame:
    """(m0, unit, pass_no, h, mean, draw): a roll-out of the smoothing model as a native fold over each cell's months.

    The history before m0 is digested once for each cell and its state forked for the passes. Each free step emits the mean,
    draws the family (``parameters`` gives its parameters from the mean), composes the draw with its gate, and feeds
    back what ``FEEDBACKS`` names, capped on the copy fed back only. Uniforms are digests of seed, origin, unit, pass and step.
    """
    fed_back = lookup(FEEDBACKS, feedback)
    listed = origins.select("m0", F.explode(F.sequence(F.col("m0") - history, F.col("m0") - 1)).alias("month_id")).withColumn("month_id", F.col("month_id").cast("int"))
    known = panel.select("month_id", "unit", F.col(column).cast("double").alias("x")).join(F.broadcast(listed), "month_id")
    series = known.groupBy("m0", "unit").agg(F.array_sort(F.collect_list(F.struct("month_id", "x"))).alias("past"))
    smooth = lambda state, x: 0.7 * state + 0.3 * x
    digest = F.aggregate("past", F.lit(0.0), lambda s, r: smooth(s, r["x"]))
    forked = series.select("m0", "unit", digest.alias("state"), F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass_no"))
    made = lambda h, mean, draw: F.struct(h.cast("int").alias("h"), mean.alias("mean"), draw.alias("draw"))

    def step(run: Column, h: Column) -> Column:
        keys = (F.lit(seed), F.col("m0"), F.col("unit"), F.col("pass_no"), h)

        def emit(mean: Column) -> Column:
            p = gate(mean) if gate else F.lit(1.0)
            draw = composed(family_draw(family, parameters(mean), *keys), p, keyed.uniform(*keys, F.lit("gate")), composition, threshold)

            def advance(y: Column) -> Column:
                fed = fed_back(mean, y)
                return F.struct(smooth(run["state"], fed if cap is None else F.least(fed, F.lit(cap))).alias("state"), F.concat(run["out"], F.array(made(h, mean, y))).alias("out"))

            return arrays.once(draw, advance)

        return arrays.once(F.expm1(0.9 * F.log1p(run["state"])), emit)

    nothing = F.array().cast("array<struct<h:int,mean:double,draw:double>>")
    run = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.col("state").alias("state"), nothing.alias("out")), step, lambda s: s["out"])
    return forked.select("m0", "unit", "pass_no", F.explode(run).alias("s")).select("m0", "unit", "pass_no", "s.*")


def posterior(rolled: DataFrame, *by: str) -> DataFrame:
    """(by, m0, h, month_id, unit, samples): the passes' draws in order of the pass."""
    return rolled.groupBy(*by, "m0", "h", "month_id", "unit").agg(F.transform(F.array_sort(F.collect_list(F.struct("pass_no", "draw"))), lambda s: s["draw"]).alias("samples"))


def lgamma(x):
    """log Γ of positive numbers, which Spark SQL lacks: Stirling's series from 8 on, and below by the recurrence. Null for NaN."""

    def series(z):
        # Coefficients of Stirling's series.
        tail = sum(F.lit(c) / F.pow(z, F.lit(float(n))) for n, c in ((1, 1 / 12), (3, -1 / 360), (5, 1 / 1260), (7, -1 / 1680), (9, 1 / 1188), (11, -691 / 360360)))
        return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + tail

    shifted = series(x + 8.0) - sum(F.log(x + float(i)) for i in range(8))
    return F.when(~F.isnan(x), F.when(x < 8, shifted).otherwise(series(x)))


def nb_log_pmf(y, mu, theta):
    """log P(Y = y) of a negative binomial; mean and dispersion at least 1e-6."""
    m, t = F.greatest(mu, F.lit(1e-6)), F.greatest(theta, F.lit(1e-6))
    return lgamma(y + t) - lgamma(t) - lgamma(y + 1.0) + t * (F.log(t) - F.log(t + m)) + y * (F.log(m) - F.log(t + m))


def _clip(name: str) -> Column:
    return F.least(F.greatest(F.col(name), F.lit(1e-6)), F.lit(1 - 1e-6))


def _log_add(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def _base_log_pmf() -> Column:
    return nb_log_pmf(F.col("y"), F.col("mu"), F.col("theta"))


def _zinb_log_pmf() -> Column:
    inner = F.log(1 - _clip("pi")) + _base_log_pmf()
    return F.when(F.col("y") == 0, _log_add(F.log(_clip("pi")), inner)).otherwise(inner)


def _mixture_log_pmf() -> Column:
    second = nb_log_pmf(F.col("y"), F.col("mu2"), F.col("theta2"))
    return _log_add(F.log(_clip("w")) + _base_log_pmf(), F.log(1 - _clip("w")) + second)


def _truncated_log_pmf() -> Column:
    """Null where y is 0: such rows have no likelihood and no weight."""
    theta = F.greatest(F.col("theta"), F.lit(1e-6))
    zero = -theta * F.log1p(F.greatest(F.col("mu"), F.lit(1e-6)) / theta)
    return F.when(F.col("y") > 0, _base_log_pmf() - F.log(-F.expm1(zero)))


#: log P(y) of each family, from the columns y and the family's parameters; add an entry to extend.
LOG_PMFS: dict[str, Callable[[], Column]] = {"nb": _base_log_pmf, "zinb": _zinb_log_pmf, "mixture": _mixture_log_pmf, "truncated": _truncated_log_pmf}


def family_nll(df: DataFrame, family: str, weight: str | None = None) -> DataFrame:
    """(nll): weighted mean negative log-likelihood of column y under the family's parameter columns; truncated: positives only."""
    if family not in LOG_PMFS:
        raise ValueError(f"unknown family {family!r}")
    w = F.col(weight) if weight else F.lit(1.0)
    scored = df.select((-LOG_PMFS[family]()).alias("l"), w.alias("w")).where("l is not null")
    return scored.agg((F.sum(F.col("l") * F.col("w")) / F.greatest(F.sum("w"), F.lit(1e-8))).alias("nll"))


def tobit_nll(df: DataFrame, sigma: float) -> DataFrame:
    """(nll): -log Φ(-μ/σ) where y is 0, else the Gaussian's; columns y and mu."""
    gauss = F.pow((F.col("y") - F.col("mu")) / sigma, 2) / 2 + F.log(F.lit(sigma)) + F.lit(0.9189385332046727)
    return df.select(log_normal_cdf(-F.col("mu") / sigma).alias("t"), gauss.alias("g"), "y").agg(F.avg(F.when(F.col("y") == 0, -F.col("t")).otherwise(F.col("g"))).alias("nll"))


def free_runs(starts: DataFrame, key: str, steps: int, growth: float = 1.1, cap: float = 13.0) -> DataFrame:
    """(key, step, x, top): the map x to min(growth x, cap), run freely from x0, and the largest level so far."""
    level = lambda x, top: F.struct(x.alias("x"), top.alias("top"))

    def step(run: Column, _: Column) -> Column:
        last = F.element_at(run, -1)
        x = F.least(growth * last["x"], F.lit(cap))
        return F.concat(run, F.array(level(x, F.greatest(last["top"], x))))

    run = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.array(level(F.col("x0"), F.abs("x0"))), step)
    return starts.select(key, F.posexplode(run).alias("step", "s")).select(key, "step", "s.x", "s.top")
