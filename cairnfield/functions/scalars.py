"""Scalar links, transforms and count-family moments as native expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-6


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def softplus(x: Column) -> Column:
    return F.when(x > 30, x).otherwise(F.log1p(F.exp(F.least(x, F.lit(30.0)))))


def inverse_softplus(y: Column) -> Column:
    return y + F.log1p(-F.exp(-y))


def to_counts(log1p_value: Column) -> Column:
    """max(expm1(x), 0); below -1e-6 it is an error."""
    return F.when(F.expm1(log1p_value) < -1e-6, F.raise_error(F.lit("a recovered count is negative"))).otherwise(F.greatest(F.expm1(log1p_value), F.lit(0.0)))


def is_real(x: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def above(x: Column, threshold: float) -> Column:
    """x > threshold, where a missing or NaN value is not above anything."""
    return F.coalesce(~F.isnan(x.cast("double")) & (x > threshold), F.lit(False))


def out_of_range(level: Column, data_log_max: float = 12.1, margin: float = 1.0) -> Column:
    return ~is_real(level) | (level > data_log_max + margin)


def _clamp(x: Column) -> Column:
    return F.greatest(x, F.lit(FLOOR))


def _unit(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(FLOOR)), F.lit(1 - FLOOR))


def nb_log_zero(mu: Column, theta: Column) -> Column:
    """log P(0) of a negative binomial: -θ log1p(μ/θ)."""
    return -_clamp(theta) * F.log1p(_clamp(mu) / _clamp(theta))


def nb_zero(mu: Column, theta: Column) -> Column:
    return F.exp(nb_log_zero(mu, theta))


def family_mean(family: str, **p: Column) -> Column:
    if family == "nb":
        return p["mu"]
    if family == "zinb":
        return (1 - p["pi"]) * p["mu"]
    if family == "mixture":
        return p["w"] * p["mu"] + (1 - p["w"]) * p["mu2"]
    if family == "truncated":
        return p["mu"] / -F.expm1(nb_log_zero(p["mu"], p["theta"]))
    raise ValueError(f"unknown family {family!r}")


def family_positive(family: str, **p: Column) -> Column:
    """P(Y > 0)."""
    if family == "nb":
        return -F.expm1(nb_log_zero(p["mu"], p["theta"]))
    if family == "zinb":
        return (1 - p["pi"]) * -F.expm1(nb_log_zero(p["mu"], p["theta"]))
    if family == "mixture":
        return p["w"] * -F.expm1(nb_log_zero(p["mu"], p["theta"])) + (1 - p["w"]) * -F.expm1(nb_log_zero(p["mu2"], p["theta2"]))
    if family == "truncated":
        return F.lit(1.0)
    raise ValueError(f"unknown family {family!r}")


def activate(family: str, raw: list[Column]) -> dict[str, Column]:
    """Raw channels to parameters; mixture means are ordered."""
    names = {"nb": ("mu", "theta"), "zinb": ("mu", "theta", "pi"), "mixture": ("mu", "theta", "mu2", "theta2", "w"), "truncated": ("mu", "theta")}
    if family not in names or len(raw) != len(names[family]):
        raise ValueError(f"{family!r} takes {len(names.get(family, ()))} channels, got {len(raw)}")
    out = {n: sigmoid(r) if n in ("pi", "w") else softplus(r) for n, r in zip(names[family], raw, strict=True)}
    if family == "mixture":
        out["mu2"] = out["mu"] + out["mu2"]
    return out


def hurdle_log1p_mean(kind: str, reg: Column, prob: Column, dispersion: float = 1.0, ceiling: float = 30.0) -> Column:
    """log1p of the hurdle's mean: prob times the positive part's mean (truncated nb, lognormal or point)."""
    x = F.least(reg, F.lit(ceiling))
    if kind == "nb":
        mu = F.exp(x)
        part = mu / -F.expm1(nb_log_zero(mu, F.lit(dispersion)))
    elif kind == "lognormal":
        part = F.exp(F.least(x + dispersion**2 / 2, F.lit(ceiling)))
    elif kind == "point":
        part = F.greatest(F.expm1(x), F.lit(0.0))
    else:
        raise ValueError(f"unknown hurdle {kind!r}")
    return F.log1p(prob * part)


def compose_mean(m: Column, p: Column, composition: str, threshold: float | None = None) -> Column:
    if (composition == "threshold_gate") != (threshold is not None):
        raise ValueError("a threshold goes with threshold_gate, and only with it")
    if composition == "self_zeroed":
        return m
    if composition == "soft_gate":
        return p * m
    if composition == "threshold_gate":
        return F.when(p >= threshold, m).otherwise(0.0)
    raise ValueError(f"unknown composition {composition!r}")


def gpd_cdf(v: Column, gamma: Column, sigma: Column) -> Column:
    """Generalised Pareto: the exponential limit for small shapes, clipped to [0, 1]; null without a scale."""
    x = v / F.when(sigma != 0, sigma)
    bounded = F.when(F.abs(gamma) >= 1e-9, gamma)
    z = F.when(1 + gamma * x > 0, F.pow(1 + gamma * x, -1 / bounded)).otherwise(0.0)
    body = F.when(F.abs(gamma) < 1e-9, 1 - F.exp(-x)).otherwise(1 - z)
    return F.when(sigma != 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), body)))


def epsilon(kind: str, i: Column, n: int, k: float = 5.0) -> Column:
    """Share of teacher forcing at step i of n: linear, inverse sigmoid or exponential decay."""
    x = i / F.lit(float(max(1, n - 1)))
    return {"linear": 1 - x, "inverse_sigmoid": k / (k + F.exp(x * k * 2 - k)), "exponential": F.pow(F.lit(0.5), x * k)}[kind]


def cooling(i: Column, steps: int, low: float, high: float, slope: float, roof: float) -> Column:
    """Linear cooling of the intensity ratio, capped and floored."""
    return F.greatest(F.lit(low), F.least(F.lit(high * roof), F.lit(high) + F.lit((low - high) / (steps * slope)) * i))


def warmup_rate(n: Column, d: float, w: float) -> Column:
    """d^-1/2 min(n^-1/2, n w^-3/2)."""
    return F.lit(d**-0.5) * F.least(F.pow(n, F.lit(-0.5)), n * F.lit(w**-1.5))


def _erf_series(x: Column) -> Column:
    """erf of a number from 0 to 3, by the series of positive terms 2^n x^(2n+1) / (2n+1)!! times exp(-x^2)."""
    grow = lambda s, n: F.struct((s["term"] * 2 * x * x / (2 * n + 1)).alias("term"), (s["sum"] + s["term"] * 2 * x * x / (2 * n + 1)).alias("sum"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(70)), F.struct(x.alias("term"), x.alias("sum")), grow, lambda s: s["sum"])
    return 2 / math.sqrt(math.pi) * F.exp(-x * x) * total


def _erfc_fraction(x: Column) -> Column:
    """erfc(x) exp(x^2) x sqrt(pi) of a number from 3 on, by its continued fraction."""
    return 1 / F.aggregate(F.sequence(F.lit(70), F.lit(1), F.lit(-1)), F.lit(1.0), lambda s, k: 1 + k / (2 * x * x) / s)


def erfc(x: Column) -> Column:
    """The complementary error function, which Spark SQL lacks, to about 14 digits."""
    a = F.abs(x)
    near, far = F.least(a, F.lit(3.0)), F.greatest(a, F.lit(3.0))
    upper = F.when(a < 3, 1 - _erf_series(near)).otherwise(F.exp(-far * far) / (far * math.sqrt(math.pi)) * _erfc_fraction(far))
    return F.when(x < 0, 2 - upper).otherwise(upper)


def log_normal_cdf(x: Column) -> Column:
    """log of the normal distribution function, stable in the lower tail; null for NaN."""
    z = -x / math.sqrt(2)
    far = F.greatest(z, F.lit(3.0))
    tail = -far * far - F.log(far * math.sqrt(math.pi)) + F.log(_erfc_fraction(far)) - math.log(2)
    return F.when(~F.isnan(x), F.when(z < 3, F.log(erfc(F.least(z, F.lit(3.0))) / 2)).otherwise(tail))
