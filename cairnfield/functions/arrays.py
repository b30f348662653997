"""Functions of sample vectors (arrays of draws) as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, f) -> Column:
    """f(value) with value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(samples: Column) -> Column:
    return total(samples) / F.size(samples)


def median(samples: Column) -> Column:
    return quantile(samples, 0.5)


def quantile(samples: Column, q: float) -> Column:
    """Empirical quantile with linear interpolation between order statistics."""

    def at(s: Column) -> Column:
        pos = F.lit(float(q)) * (F.size(s) - 1)
        low = F.floor(pos).cast("int")
        a, b = F.get(s, low), F.get(s, F.least(low + 1, F.size(s) - 1))
        return a + (b - a) * (pos - low)

    return once(F.array_sort(samples), at)


def spread(samples: Column) -> Column:
    """Sum over order statistics of (2j - m + 1) x_(j), j from 0."""
    return once(F.array_sort(samples), lambda s: total(F.transform(s, lambda x, j: (2 * j - F.size(s) + 1) * x)))


def crps(samples: Column, y: Column) -> Column:
    """Energy form with the 1/m² spread: mean|x - y| - spread / m²."""
    m = F.size(samples)
    return total(F.transform(samples, lambda x: F.abs(x - y))) / m - spread(samples) / (m * m)


def tw_crps(samples: Column, y: Column, threshold: float) -> Column:
    """Threshold-weighted CRPS: both sides clipped from below at the threshold."""
    return crps(F.transform(samples, lambda x: F.greatest(x, F.lit(threshold))), F.greatest(y, F.lit(threshold)))


def scrps(samples: Column, y: Column, floor: float = 1e-12) -> Column:
    """Scaled CRPS: -A/β - ln(β)/2 with A = mean|x - y| and β twice the mean spread, floored."""
    m = F.size(samples)
    a = total(F.transform(samples, lambda x: F.abs(x - y))) / m
    beta = F.greatest(2 * spread(samples) / (m * m), F.lit(floor))
    return -a / beta - F.log(beta) / 2


def pit(samples: Column, y: Column, u: Column) -> Column:
    """Randomised PIT: P(X < y) + u P(X = y)."""
    m = F.size(samples)
    below = F.size(F.filter(samples, lambda x: x < y))
    equal = F.size(F.filter(samples, lambda x: x == y))
    return (below + u * equal) / m


def share_positive(samples: Column) -> Column:
    return F.size(F.filter(samples, lambda x: x > 0)) / F.size(samples)


def finite(samples: Column) -> Column:
    return F.forall(samples, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def threshold_gate(samples: Column, p: Column, tau: float | None) -> Column:
    """The samples where p reaches tau, else zeros; no tau changes nothing."""
    return samples if tau is None else F.when(p >= tau, samples).otherwise(F.transform(samples, lambda x: F.lit(0.0)))


def compose_samples(samples: Column, p: Column, composition: str, uniforms: Column | None = None, threshold: float | None = None) -> Column:
    """Gate and magnitude draws together: unchanged, one Bernoulli for each draw, or a threshold on the gate."""
    if composition == "self_zeroed":
        return samples
    if composition == "soft_gate":
        return F.zip_with(samples, uniforms, lambda x, u: F.when(u < p, x).otherwise(0.0))
    if composition == "threshold_gate":
        return threshold_gate(samples, p, threshold)
    raise ValueError(f"unknown composition {composition!r}")


def midpoints(n: int) -> list[float]:
    return [(k + 0.5) / n for k in range(n)]


def _interpolate(knots: Column, levels: list[float], u: Column) -> Column:
    """Piecewise linear in the knots at the given levels, flat outside."""
    out = F.get(knots, F.lit(len(levels) - 1))
    for i in range(len(levels) - 1, 0, -1):
        a, b = F.get(knots, F.lit(i - 1)), F.get(knots, F.lit(i))
        out = F.when(u < levels[i], a + (b - a) * ((u - levels[i - 1]) / (levels[i] - levels[i - 1]))).otherwise(out)
    return F.when(u <= levels[0], F.get(knots, F.lit(0))).otherwise(out)


def quantiles_to_samples(knots: Column, levels: list[float], n: int) -> Column:
    """n draws by inverting the quantile function on the midpoint grid."""
    return F.array(*[_interpolate(knots, levels, F.lit(u)) for u in midpoints(n)])


def hurdle_to_samples(knots: Column, levels: list[float], p: Column, n: int) -> Column:
    """n draws of a hurdle: zero up to 1 - p, above it the positive part's quantile at (u - (1 - p)) / p."""
    q = F.greatest(p, F.lit(1e-6))
    return F.array(*[F.when(F.lit(u) <= 1 - q, 0.0).otherwise(_interpolate(knots, levels, (F.lit(u) - (1 - q)) / q)) for u in midpoints(n)])


def monotone_quantiles(raw: Column) -> Column:
    """The first value, then running sums of softplus gaps."""
    soft = lambda x: F.when(x > 30, x).otherwise(F.log1p(F.exp(x)))
    step = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + soft(x)))
    return F.aggregate(F.slice(raw, 2, 1_000_000), F.slice(raw, 1, 1), step)


def pool(samples: Column) -> Column:
    """Aggregate: all members' draws in one vector, in order of the member's name."""
    return F.flatten(F.transform(F.array_sort(F.collect_list(samples)), lambda s: s["samples"]))
