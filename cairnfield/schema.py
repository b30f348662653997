"""Schemas, column roles and the run configuration."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

TARGETS = ("sb", "ns", "os")
KEY = ("month_id", "unit")

GRID = T.StructType([T.StructField("unit", T.LongType(), False), T.StructField("row", T.IntegerType(), False), T.StructField("col", T.IntegerType(), False), T.StructField("c_id", T.LongType())])
PREDICTIONS = T.StructType(
    [
        T.StructField("arm", T.StringType(), False),
        T.StructField("target", T.StringType(), False),
        T.StructField("m0", T.IntegerType(), False),
        T.StructField("h", T.IntegerType(), False),
        T.StructField("month_id", T.IntegerType(), False),
        T.StructField("unit", T.LongType(), False),
        T.StructField("samples", T.ArrayType(T.DoubleType(), False), False),
    ]
)
BOARD = T.StructType([T.StructField("arm", T.StringType()), T.StructField("target", T.StringType()), T.StructField("h", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in ("crps_all", "crps_events", "crps_none", "brier", "size_ratio", "pos_mcr")]])

#: Names that one grid's cell column may go by; exactly one may be present.
UNIT_ALIASES = ("priogrid_id", "priogrid_gid", "unit")


def role(field_: T.StructField) -> str | None:
    """The role that a column was given in its metadata (feature, static, target, identity), if any."""
    return (field_.metadata or {}).get("role")


def with_roles(df, roles: dict[str, str]):
    """``df`` whose columns carry their role in the schema's metadata."""
    return df.select(*[df[c].alias(c, metadata={"role": roles[c]}) if c in roles else df[c] for c in df.columns])


def roles(df) -> list[tuple[int, str, str | None]]:
    """(position, column, role) of every column, in order."""
    return [(i, f.name, role(f)) for i, f in enumerate(df.schema)]


def with_role(df, *wanted: str) -> list[str]:
    """The columns that have one of the roles, in order."""
    return [name for _, name, r in roles(df) if r in wanted]


def without_identities(df):
    """``df`` without the columns whose role is identity."""
    return df.drop(*with_role(df, "identity"))


def unit_column(names: list[str]) -> str:
    """The one alias of the cell column among ``names``; none or several is an error."""
    found = [n for n in UNIT_ALIASES if n in names]
    if len(found) != 1:
        raise ValueError(f"expected exactly one of {UNIT_ALIASES}, found {found}")
    return found[0]


@dataclass(frozen=True)
class RunConfig:
    """What a run needs to know about its panel. Unknown settings go to ``extra``."""

    train_end: int = 226
    test_start: int = 227
    test_end: int = 262
    time_steps: int = 12
    row_offset: int = 87
    col_offset: int = 310
    height: int = 180
    width: int = 180
    threshold: float = 0.0
    onset_lead: int = 1
    cessation_lag: int = 2
    features: tuple[str, ...] = tuple(f"lr_{t}" for t in TARGETS)
    transforms: dict[str, str] = field(default_factory=lambda: {f"lr_{t}": "log1p" for t in TARGETS})
    collapse: str = "mean"
    composition: str = "self_zeroed"
    gate_threshold: float | None = None
    extra: dict = field(default_factory=dict)

    def validate(self) -> RunConfig:
        """Raises on the first setting that contradicts another."""
        from cairnfield.functions.registry import COLLAPSES, COMPOSITIONS, TRANSFORMS

        problems = []
        if not self.train_end < self.test_start <= self.test_end:
            problems.append("partitions must not overlap: train_end < test_start <= test_end")
        if self.time_steps < 1 or self.time_steps > self.test_end - self.test_start + 1:
            problems.append("time_steps must fit in the test partition")
        if len(set(self.features)) != len(self.features):
            problems.append("features must be distinct")
        problems += [f"unknown transform {t!r} of {c}" for c, t in self.transforms.items() if t not in TRANSFORMS]
        problems += [f"transform of {c}, which is no feature" for c in self.transforms if c not in self.features]
        if self.collapse not in COLLAPSES:
            problems.append(f"collapse must be one of {sorted(COLLAPSES)}")
        if self.composition not in COMPOSITIONS:
            problems.append(f"composition must be one of {sorted(COMPOSITIONS)}")
        if (self.composition == "threshold_gate") != (self.gate_threshold is not None):
            problems.append("a gate threshold goes with threshold_gate, and only with it")
        if min(self.onset_lead, self.cessation_lag) < 0:
            problems.append("lead and lag cannot be negative")
        if problems:
            raise ValueError("; ".join(problems))
        return self

    @property
    def windows(self) -> int:
        """How many origins the test partition holds."""
        return self.test_end - (self.test_start - 1) - self.time_steps + 1
