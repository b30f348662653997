"""Native draws of count families against their probabilities."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnfield.operators import draws


def nb_pmf(y, mu, theta):
    return math.exp(math.lgamma(y + theta) - math.lgamma(theta) - math.lgamma(y + 1) + theta * math.log(theta / (theta + mu)) + y * math.log(mu / (theta + mu)))


PMF = {
    "nb": lambda y, p: nb_pmf(y, p["mu"], p["theta"]),
    "zinb": lambda y, p: (y == 0) * p["pi"] + (1 - p["pi"]) * nb_pmf(y, p["mu"], p["theta"]),
    "mixture": lambda y, p: p["w"] * nb_pmf(y, p["mu"], p["theta"]) + (1 - p["w"]) * nb_pmf(y, p["mu2"], p["theta2"]),
    "truncated": lambda y, p: (y > 0) * nb_pmf(y, p["mu"], p["theta"]) / (1 - nb_pmf(0, p["mu"], p["theta"])),
}


@pytest.mark.parametrize("family", sorted(PMF))
@pytest.mark.parametrize(("mu", "theta"), [(3.0, 0.4), (0.2, 5.0), (8.0, 40.0), (40.0, 0.05)])
def test_frequencies_follow_the_law(spark, family, mu, theta):
    p = {"mu": mu, "theta": theta, "pi": 0.3, "mu2": 6.0, "theta2": 2.0, "w": 0.6}
    params = spark.range(40).select(F.col("id").alias("key"), *[F.lit(v).alias(c) for c, v in p.items()])
    x = np.concatenate([r["samples"] for r in draws.family_draws(params, family, 250, 3).collect()])
    seen, chi, bins = 0.0, 0.0, 0
    for y in range(30):
        want = PMF[family](y, p) * len(x)
        seen += want
        if want > 20:
            chi, bins = chi + ((x == y).sum() - want) ** 2 / want, bins + 1
    assert chi < bins + 5 * math.sqrt(2 * bins) + 5
    assert abs((x >= 30).sum() - (len(x) - seen)) < 5 * math.sqrt(max(1.0, len(x) - seen)) + 5


def test_draws_depend_on_the_key_alone_and_bear_extremes(spark):
    rows = [(1, 2.0, 1.0), (2, None, 1.0), (3, 0.0, 0.0), (4, 1e6, 0.01), (5, 3000.0, 900.0), (1, 2.0, 1.0)]
    df = spark.createDataFrame(rows, "key long, mu double, theta double")
    got = {(r["key"], i): r["samples"] for i, r in enumerate(sorted(draws.family_draws(df, "nb", 200, 7).collect(), key=lambda r: r["key"]))}
    again = sorted(draws.family_draws(df.repartition(4).orderBy(F.desc("key")), "nb", 200, 7).collect(), key=lambda r: r["key"])
    assert [r["samples"] for r in again] == list(got.values()) and got[1, 0] == got[1, 1]
    assert got[2, 2] is None and set(got[3, 3]) == {0.0}
    assert max(got[4, 4]) > 1e6 and min(got[4, 4]) == 0 and abs(np.mean(got[5, 5]) / 3000 - 1) < 0.02
    assert all(y >= 1 for y in draws.family_draws(df.where("key = 3"), "truncated", 50, 7).first()["samples"])
    with pytest.raises(ValueError):
        draws.family_draw("poisson", {}, F.lit(1))
