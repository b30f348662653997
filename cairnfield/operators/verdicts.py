"""Gap decomposition, skill, verdict tokens, screens, falsifiers and the tail index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.functions.scalars import gpd_cdf, is_real
from cairnfield.operators import order
from cairnfield.sources.work import checked


def gap_decomposition(rows: DataFrame, reference: str) -> DataFrame:
    """(arm, target, h, gap, zero_part, event_part, zero_share, residual, skill) of each arm against the reference arm.

    The gap in mean CRPS splits into cells without and with events, weighted by their shares; without a gap the share is null.
    """
    ref = rows.where(F.col("arm") == reference).select("target", "h", *[F.col(c).alias(f"r_{c}") for c in ("crps_all", "crps_none", "crps_events")])
    joined = rows.where(F.col("arm") != reference).join(ref, ["target", "h"])
    p = F.col("n_event") / F.col("n")
    gap = F.col("crps_all") - F.col("r_crps_all")
    zero = (1 - p) * (F.coalesce("crps_none", F.lit(0.0)) - F.coalesce("r_crps_none", F.lit(0.0)))
    event = p * (F.coalesce("crps_events", F.lit(0.0)) - F.coalesce("r_crps_events", F.lit(0.0)))
    return joined.select(
        "arm",
        "target",
        "h",
        gap.alias("gap"),
        zero.alias("zero_part"),
        event.alias("event_part"),
        F.when(gap != 0, zero / F.when(gap != 0, gap)).alias("zero_share"),
        (gap - zero - event).alias("residual"),
        skill(F.col("crps_all"), F.col("r_crps_all")).alias("skill"),
    )


def skill(crps: Column, reference: Column) -> Column:
    """1 - crps / reference; the reference must be above zero."""
    return F.when(reference > 0, 1 - crps / reference).otherwise(F.raise_error(F.lit("the reference CRPS is not above zero")))


def verdict(zero_share: Column, delta_ap: Column, crpss: Column, ci_excludes_zero: Column, share_max: float = 0.5, skill_min: float = 0.05) -> Column:
    """ARTIFACT, REAL or UNDECIDABLE; an input that is missing or no number is an error."""
    broken = ~(is_real(zero_share) & is_real(delta_ap) & is_real(crpss)) | ci_excludes_zero.isNull()
    return (
        F.when(broken, F.raise_error(F.lit("a verdict needs four finite inputs")))
        .when((zero_share > share_max) & (delta_ap < 0), "ARTIFACT")
        .when((crpss >= skill_min) & (delta_ap > 0) & ci_excludes_zero, "REAL")
        .otherwise("UNDECIDABLE")
    )


def identity_falsifier(decomposed: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(rows, worst, holds): the residual must vanish everywhere; a missing one counts as a failure."""
    bad = F.coalesce(F.isnan("residual"), F.lit(True)) | F.col("residual").isNull()
    return decomposed.agg(F.count("*").alias("rows"), F.max(F.abs("residual")).alias("worst"), (F.count(F.when(bad | (F.abs("residual") >= tolerance), 1)) == 0).alias("holds"))


def bloom(boards: DataFrame, trajectories: DataFrame, none_max: float = 0.5, mean_max: float = 5.0) -> DataFrame:
    """(arm, worst_none, worst_mean, bloomed): the worst over targets and horizons against both limits."""
    a = boards.groupBy("arm").agg(F.max("crps_none").alias("worst_none"))
    b = trajectories.groupBy("arm").agg(F.max("mean").alias("worst_mean"))
    return a.join(b, "arm").withColumn("bloomed", (F.col("worst_none") > none_max) | (F.col("worst_mean") > mean_max))


def screen(first: DataFrame, limits: dict[str, float]) -> DataFrame:
    """(arm, k1, k2, s1, s2, outcome) from first-step rows (arm, target, crps_all, crps_none, ap, brier, mcr_all).

    k1: a forecast out of any range; k2: leakage beyond the limit; s1, s2: enough score and ranking to survive.
    """
    wide = first.groupBy("arm").agg(
        F.max("mcr_all").alias("mcr"),
        F.max("crps_none").alias("leak"),
        F.max("crps_all").alias("crps"),
        F.min("ap").alias("ap"),
    )
    k1 = ~is_real(F.col("mcr")) | (F.col("mcr") > limits["k1"])
    k2 = F.col("leak") > limits["k2"]
    s1, s2 = F.col("crps") <= limits["crps"], F.coalesce(F.col("ap") >= limits["ap"], F.lit(False))
    return wide.select("arm", k1.alias("k1"), k2.alias("k2"), s1.alias("s1"), s2.alias("s2"), F.when(k1 | k2, "KILL").when(s1 & s2, "SURVIVE").otherwise("HOLD").alias("outcome"))


def confirm(outcomes: DataFrame, name: str = "outcome", wanted: str = "SURVIVE") -> DataFrame:
    """(arm, seeds, confirmed): the outcome must hold for every seed."""
    return outcomes.groupBy("arm").agg(F.count("*").alias("seeds"), F.bool_and(F.col(name) == wanted).alias("confirmed"))


def parity_falsifiers(scorecard: DataFrame, last_month: Column, exact_min: float = 99.9, drift_max: float = 5.0, required_end: int = 504) -> DataFrame:
    """(column_name, same_cells, exact, drift, covers, passed) over a parity scorecard."""
    checks = {
        "same_cells": (F.col("only_a") == 0) & (F.col("only_b") == 0),
        "exact": F.coalesce(F.col("exact_pct") >= exact_min, F.lit(False)),
        "drift": F.coalesce(F.col("drift_pct") <= drift_max, F.lit(False)),
        "covers": last_month >= required_end,
    }
    out = scorecard.select("column_name", *[v.alias(k) for k, v in checks.items()])
    return out.withColumn("passed", F.col("same_cells") & F.col("exact") & F.col("drift") & F.col("covers"))


def eligibility(rows: DataFrame, reference: str, gain: float = 0.05, slack: float = 0.01) -> DataFrame:
    """(arm, target, eligible): CRPS better by the gain, Brier no worse than the slack, the magnitude ratio nearer to 1."""
    ref = rows.where(F.col("arm") == reference).select("target", F.col("crps_all").alias("rc"), F.col("brier").alias("rb"), F.col("mcr_all").alias("rm"))
    joined = rows.where(F.col("arm") != reference).join(ref, "target")
    ok = (F.col("crps_all") <= (1 - gain) * F.col("rc")) & (F.col("brier") <= (1 + slack) * F.col("rb")) & (F.abs(F.col("mcr_all") - 1) < F.abs(F.col("rm") - 1))
    return joined.select("arm", "target", F.coalesce(ok, F.lit(False)).alias("eligible"))


def pwm_fit(exceedances: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, m, gamma, sigma): generalised Pareto by probability-weighted moments of column v, ascending ranks i from 1.

    a0 is the mean, a1 = sum((m - i) / (m - 1) v) / m; gamma = 2 - a0 / (a0 - 2 a1), sigma = 2 a0 a1 / (a0 - 2 a1). Fewer than two
    exceedances, or moments without a positive scale, have no fit: both are null.
    """
    ties = exceedances.groupBy(*by, "v").agg(F.count("*").alias("c"))
    totals = ties.groupBy(*by).agg(F.sum("c").alias("m"), (F.sum(F.col("c") * F.col("v")) / F.sum("c")).alias("a0"))
    c = F.col("c")
    # The sum of m - i over the ranks of equal values.
    above = c * F.col("m") - c * F.col("c_before") - c * (c + 1) / 2
    a = order.before(ties, by, "v", ["c"]).join(totals, list(by)).groupBy(*by, "m", "a0").agg((F.sum(above * F.col("v")) / F.col("m") / F.greatest(F.col("m") - 1, F.lit(1))).alias("a1"))
    d = F.col("a0") - 2 * F.col("a1")
    safe = F.when((F.col("m") > 1) & (F.abs(d) > 1e-12), d)
    sigma = 2 * F.col("a0") * F.col("a1") / safe
    return a.select(*by, "m", F.when(sigma > 0, 2 - F.col("a0") / safe).alias("gamma"), F.when(sigma > 0, sigma).alias("sigma"))


def tail_index(pairs: DataFrame, q: float, least: int) -> DataFrame:
    """(target, u, n_model, n_ref, gamma, index, ceiling): 1 minus the ratio of both sides' distance from the model's fitted tail.

    ``pairs`` has (target, crps_model, crps_ref). u is the q-quantile of both pooled; exceedances over u are fitted for
    the reference, and the Cramer-von Mises distances of both sides to that fit are compared. Fewer exceedances than
    ``least`` on a side give a null index.
    """
    sides = pairs.select("target", F.explode(F.array(F.struct(F.lit("model").alias("side"), F.col("crps_model").alias("x")), F.struct(F.lit("ref").alias("side"), F.col("crps_ref").alias("x")))).alias("s")).select("target", "s.*")
    cut = checked(order.quantiles(sides, ["target"], {"u": (F.col("x"), q)}), "cuts")
    over = sides.join(cut, "target").where(F.col("x") > F.col("u")).select("target", "side", "u", (F.col("x") - F.col("u")).alias("v"))
    fit = pwm_fit(over.where("side = 'ref'"), ["target"]).select("target", "gamma", "sigma")
    ties = order.before(over.groupBy("target", "side", "u", "v").agg(F.count("*").alias("c")), ["target", "side"], "v", ["c"])
    sides_m = over.groupBy("target", "side").agg(F.count("*").alias("m"))
    placed = ties.join(sides_m, ["target", "side"]).join(fit, "target")
    # Sums of 2 i - 1 and of its square over the first n ranks are n^2 and n (4 n^2 - 1) / 3.
    low, high = F.col("c_before").cast("double"), (F.col("c_before") + F.col("c")).cast("double")
    first, second = high * high - low * low, (high * (4 * high * high - 1) - low * (4 * low * low - 1)) / 3
    f, m2 = gpd_cdf(F.col("v"), F.col("gamma"), F.col("sigma")), 2 * F.col("m")
    gaps = F.col("c") * f * f - 2 * f * first / m2 + second / (m2 * m2)
    omega = placed.groupBy("target", "u", "gamma", "side", "m").agg((1 / (12 * F.col("m")) + F.sum(gaps)).alias("omega"))
    wide = omega.groupBy("target", "u", "gamma").agg(*[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}_{s}") for s in ("model", "ref") for c in ("m", "omega")])
    enough = (F.coalesce("m_model", F.lit(0)) >= least) & (F.coalesce("m_ref", F.lit(0)) >= least)
    index = F.when(enough & (F.col("omega_model") > 0), 1 - F.col("omega_ref") / F.col("omega_model"))
    return wide.select("target", "u", F.coalesce("m_model", F.lit(0)).alias("n_model"), F.coalesce("m_ref", F.lit(0)).alias("n_ref"), "gamma", index.alias("index"), (F.col("gamma") > 0.9).alias("ceiling"))
