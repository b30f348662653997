"""Random draws of count families as native expressions on keyed uniforms.

A negative binomial is a Poisson number, of rate θ log(1 + μ / θ), of logarithmic jumps. The number comes from inverting its
distribution, whose probabilities follow one another by a recurrence; a jump has a closed form in two uniforms (Kemp's).
Both are exact whatever the parameters, work grows with the rate only, and no row needs a generator of its own: the uniforms
are digests of seed, key, draw and jump, so another engine draws the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.functions import arrays, keyed

#: Parameters of each family besides mu and theta.
PARAMETERS: dict[str, list[str]] = {"nb": [], "zinb": ["pi"], "mixture": ["mu2", "theta2", "w"], "truncated": []}
LEAST = 1e-6
#: Steps of an inversion before the first look whether it is done; the result does not depend on it.
EARLY = 8


def _real(hexed: Column, start: int) -> Column:
    """A uniform in (0, 1) from 12 digits of a digest."""
    return (F.conv(F.substring(hexed, start, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 48))


def poisson(u: Column, rate: Column, positive: bool = False) -> Column:
    """The Poisson count at level u of its distribution; ``positive``: of the distribution given that it is not zero."""
    start = 1 if positive else 0
    state = lambda lp, cum, n: F.struct(lp.alias("lp"), cum.alias("cum"), n.cast("int").alias("n"))

    def inverted(given: Column) -> Column:
        rate, goal = given["rate"], given["goal"]
        # Beyond ten standard deviations and 60 the probability is under 2^-50.
        last = (rate + 10 * F.sqrt(rate) + 60).cast("int")
        first = F.log(rate) - rate if positive else -rate

        def step(s: Column, n: Column) -> Column:
            lp = s["lp"] + F.log(rate / (n + 1))
            return F.when(s["cum"] < goal, state(lp, s["cum"] + F.exp(lp), n + 1)).otherwise(s)

        # Most levels are reached in a few steps; the others go on to the last one.
        begun = F.aggregate(F.sequence(F.lit(start), F.lit(start + EARLY - 1)), state(first, F.exp(first), F.lit(start)), step)
        later = lambda s: F.aggregate(F.sequence(F.lit(start + EARLY), last), s, step, lambda x: x["n"])
        return F.when(rate.isNotNull(), arrays.once(begun, lambda s: F.when(s["cum"] < goal, later(s)).otherwise(s["n"])))

    # Rate and level are worked out once, or else every step would read the level from its digest again.
    given = lambda r: F.struct(r.alias("rate"), (u * -F.expm1(-r) if positive else u).alias("goal"))
    return arrays.once(rate, lambda r: arrays.once(given(r), inverted))


def logarithmic(u: Column, v: Column, log_rest: Column) -> Column:
    """A draw of the logarithmic distribution with P(k) in proportion to p^k / k; ``log_rest`` is log(1 - p)."""
    h = -F.expm1(log_rest * u)
    far = F.floor(1 + F.log(v) / F.log(h))
    return F.when(v >= -F.expm1(log_rest), 1).when(v <= h * h, F.greatest(far, F.lit(1))).when(v >= h, 1).otherwise(2).cast("double")


def negative_binomial(u: Column, mu: Column, theta: Column, *keys: Column, positive: bool = False) -> Column:
    """The sum of as many jumps as ``u`` says, their uniforms being digests of ``keys`` and the jump's number."""
    m, t = F.greatest(mu, F.lit(LEAST)), F.greatest(theta, F.lit(LEAST))

    def drawn(given: Column) -> Column:
        grown = given["grown"]
        level = lambda hexed: F.struct(_real(hexed, 1).alias("u"), _real(hexed, 13).alias("v"))

        def jump(i: Column) -> Column:
            return arrays.once(arrays.once(keyed.digest(*keys, i), level), lambda x: logarithmic(x["u"], x["v"], -grown))

        number = poisson(u, given["t"] * grown, positive)
        return arrays.once(number, lambda n: F.when(n == 0, 0.0).otherwise(arrays.total(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), jump))))

    return arrays.once(F.struct(t.alias("t"), F.log1p(m / t).alias("grown")), drawn)


def family_draw(family: str, parameters: dict[str, Column], *keys: Column, core: bool = False) -> Column:
    """One draw; ``core``: of a zero-inflated family without its extra zeros."""
    if family not in PARAMETERS:
        raise ValueError(f"unknown family {family!r}")
    p = parameters

    def draw(hexed: Column) -> Column:
        u, v = _real(hexed, 1), _real(hexed, 13)
        if family == "mixture":
            mine = v < p["w"]
            return negative_binomial(u, F.when(mine, p["mu"]).otherwise(p["mu2"]), F.when(mine, p["theta"]).otherwise(p["theta2"]), *keys)
        plain = negative_binomial(u, p["mu"], p["theta"], *keys, positive=family == "truncated")
        return F.when(v < p["pi"], 0.0).otherwise(plain) if family == "zinb" and not core else plain

    return arrays.once(keyed.digest(*keys), draw)


def family_draws(params: DataFrame, family: str, k: int, seed: int, core: bool = False) -> DataFrame:
    """``params`` (key, mu, theta and pi, mu2, theta2 or w as the family needs) with an array of k draws.

    Draws depend on seed, key and their number alone; a null parameter gives null draws.
    """
    columns = ["mu", "theta", *PARAMETERS[family]]
    given = {c: F.col(c).cast("double") for c in columns}
    one = lambda j: family_draw(family, given, F.lit(seed), F.col("key"), j, core=core)
    known = F.lit(True)
    for c in given.values():
        known = known & c.isNotNull()
    return params.select("key", *[v.alias(c) for c, v in given.items()], F.when(known, F.transform(F.sequence(F.lit(0), F.lit(k - 1)), one)).alias("samples"))
