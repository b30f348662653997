"""Name to callable: the extension points. Add an entry to extend; an unknown name is an error."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairnfield.functions import arrays, scalars

#: forward and inverse transforms of features.
TRANSFORMS: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column]]] = {
    "log1p": (F.log1p, F.expm1),
    "asinh": (F.asinh, F.sinh),
    "identity": (lambda x: x, lambda x: x),
}
COLLAPSES = {"mean": arrays.mean, "median": arrays.median}
COMPOSITIONS = ("self_zeroed", "soft_gate", "threshold_gate")
FAMILIES = ("nb", "zinb", "mixture", "truncated")
#: static channel from (position, size) along an axis.
STATICS: dict[str, Callable[[Column, Column], Column]] = {
    "row_coord": lambda i, n: F.when(n == 1, 0.0).otherwise(2.0 * i / (n - 1) - 1.0),
    "col_coord": lambda i, n: F.when(n == 1, 0.0).otherwise(2.0 * i / (n - 1) - 1.0),
}
#: anchor weights from a cell's activity.
ANCHORS: dict[str, Callable[..., Column]] = {
    "threshold": lambda a, t, **_: F.when(a >= t, 1.0).otherwise(0.0),
    "power_law": lambda a, t, alpha=1.0, **_: F.when(a >= t, F.pow(a.cast("double"), F.lit(alpha))).otherwise(0.0),
    "boltzmann": lambda a, t, tau=4.0, top=None, **_: F.when(a >= t, F.exp((a - top) / F.lit(tau))).otherwise(0.0),
    "sigmoid": lambda a, t, k=0.5, **_: F.when(a >= t, scalars.sigmoid(F.least(F.greatest(F.lit(k) * (a - t), F.lit(-500.0)), F.lit(500.0)))).otherwise(0.0),
}
#: losses of a prediction p against y, one row at a time.
LOSSES: dict[str, Callable[..., Column]] = {
    "mse": lambda p, y: F.pow(p - y, 2),
    "mae": lambda p, y: F.abs(p - y),
    "huber": lambda p, y, delta=1.0: F.when(F.abs(p - y) <= delta, F.pow(p - y, 2) / 2).otherwise(delta * (F.abs(p - y) - delta / 2)),
    "msle": lambda p, y: F.pow(F.log1p(p) - F.log1p(y), 2),
    "pinball": lambda p, y, tau=0.9: F.greatest(tau * (y - p), (tau - 1) * (y - p)),
    "shrinkage": lambda p, y, a=10.0, c=0.2: F.pow(p - y, 2) / (1 + F.exp(a * (c - F.abs(p - y)))),
    "lognormal": lambda p, y, sigma=1.0: F.pow(F.log1p(y) - p, 2) / (2 * sigma**2),
    "pareto": lambda p, y, scale=1.0: (scalars.softplus(p) + 1) * F.log1p(y / scale) - F.log(scalars.softplus(p)),
    "bce": lambda p, y: -(y * F.log(F.greatest(p, F.lit(1e-12))) + (1 - y) * F.log(F.greatest(1 - p, F.lit(1e-12)))),
    "weighted_bce_logits": lambda z, y, w=1.0: (1 - y) * z + (1 + (w - 1) * y) * (F.log1p(F.exp(-F.abs(z))) + F.greatest(-z, F.lit(0.0))),
    "focal": lambda p, y, alpha=0.25, gamma=2.0: -(F.when(y > 0, alpha).otherwise(1 - alpha)) * F.pow(1 - F.when(y > 0, p).otherwise(1 - p), F.lit(gamma)) * F.log(F.greatest(F.when(y > 0, p).otherwise(1 - p), F.lit(1e-12))),
}
#: what a head emits, as log1p of a count, from its channel and the event probability.
EMITS: dict[str, Callable[..., Column]] = {
    "standard": lambda reg, prob, **_: reg,
    "dense_nb": lambda reg, prob, **_: F.log1p(F.greatest(reg, F.lit(0.0))),
    # Fixed value: 13 lies above the logarithm of any count in the data.
    "quantile": lambda reg, prob, **_: F.least(F.greatest(reg, F.lit(0.0)), F.lit(13.0)),
    "hurdle_nb": lambda reg, prob, dispersion=1.0: scalars.hurdle_log1p_mean("nb", reg, prob, dispersion),
    "hurdle_lognormal": lambda reg, prob, dispersion=1.0: scalars.hurdle_log1p_mean("lognormal", reg, prob, dispersion),
    "hurdle_shrinkage": lambda reg, prob, **_: scalars.hurdle_log1p_mean("point", reg, prob),
}


def lookup(registry: dict, name: str):
    if name not in registry:
        raise KeyError(f"unknown name {name!r}; known are {sorted(registry)}")
    return registry[name]
