"""What the queries share: the tables they start from, the rounding, and the register of names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.operators import origins as O
from cairnfield.operators import panel as P
from cairnfield.operators import scores as S
from cairnfield.sources import fixtures as X
from cairnfield.sources import work

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

FEATURES = [f"lr_{t}" for t in X.TARGETS]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL that must give the same rows."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def r6(c: Column | str) -> Column:
    """Six decimals; adding zero turns -0.0 into 0.0."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def q6(sql: str) -> str:
    return f"round({sql}, 6) + 0.0::double"


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    """``df`` with every double column but those named rounded to six decimals."""
    return df.select(*[r6(c).alias(c) if kind == "double" and c not in keep else F.col(c) for c, kind in df.dtypes])


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.densify(X.sparse_panel(spark, sf_dir), X.grid(spark, sf_dir), *X.MONTHS, FEATURES)


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.truth_long(dense(spark, sf_dir))


def origins(spark: SparkSession) -> DataFrame:
    return spark.range(X.ORIGINS[0], X.ORIGINS[1] + 1).select(F.col("id").cast("int").alias("m0"))


def store(spark: SparkSession, sf_dir: str, horizons=X.HORIZONS, arms=X.ARMS) -> DataFrame:
    return X.predictions(spark, O.risk_stratum(truth(spark, sf_dir), origins(spark)), horizons, arms)


def scored(spark: SparkSession, sf_dir: str, horizons=X.HORIZONS, arms=X.ARMS) -> DataFrame:
    return O.with_truth(store(spark, sf_dir, horizons, arms), truth(spark, sf_dir), "error")


def cells(spark: SparkSession, sf_dir: str, horizons=X.HORIZONS, arms=X.ARMS) -> DataFrame:
    return S.cell_scores(scored(spark, sf_dir, horizons, arms), "gate")


def cells_table(spark: SparkSession, sf_dir: str, horizons=X.HORIZONS, arms=X.ARMS) -> DataFrame:
    """Cell scores computed once, for queries that use them in several branches."""
    return work.table(cells(spark, sf_dir, horizons, arms), "cells")


def cells_sql(horizons=X.HORIZONS, arms=X.ARMS) -> str:
    return f"""{X.preds_sql(horizons, arms)},
cells as (select arm, target, m0, h, month_id, unit, y, gate, gate as p, {X.MEAN_SQL} as ey, {X.CRPS_SQL} as crps from preds)"""


#: Columns of a board, rounded; SQL over a table with y, ey, p, crps.
BOARD_SQL = f"""count(*) as n, count(*) filter (where y > 0) as n_event,
  {q6('avg(crps)')} as crps_all, {q6('avg(crps) filter (where y > 0)')} as crps_events, {q6('avg(crps) filter (where y <= 0)')} as crps_none,
  {q6('avg((p - case when y > 0 then 1.0::double else 0.0::double end) ** 2)')} as brier,
  {q6('quantile_cont(case when y > 0 then ey / y end, 0.5)')} as size_ratio, {q6('avg(case when y > 0 then ey / y end)')} as pos_mcr,
  {q6('case when sum(y) <> 0 then sum(ey) / sum(y) end')} as mcr_all, {q6('avg(ey) filter (where y <= 0)')} as mcr_none"""


def ap_sql(by: str, source: str = "cells", score: str = "p") -> str:
    """CTEs ending in ``ap`` (by, ap): ties grouped, then cumulated over falling scores."""
    return f"""ap_ties as (select {by}, {score} as s, count(*) filter (where y > 0) as pos, count(*) as n from {source} group by {by}, {score}),
ap_run as (select {by}, pos, n, sum(pos) over w as tp, sum(n) over w as k from ap_ties window w as (partition by {by} order by s desc)),
ap as (select {by}, case when sum(pos) > 0 and sum(pos) < sum(n) then sum(pos * tp / k) / sum(pos) end as ap from ap_run group by {by})"""


def erfc_sql(x: str) -> str:
    """erfc of a number from 0 on: a series below 3, its continued fraction from there; lgamma gives the double factorials."""
    series = f"2 / sqrt(pi()) * exp(-1.0 * ({x}) * ({x})) * list_sum(list_transform(range(0, 71), lambda n: case when {x} > 0 then exp(2 * n * ln(2) + (2 * n + 1) * ln({x}) + lgamma(n + 1) - lgamma(2 * n + 2)) else 0 end))"
    fraction = f"list_reduce(list_prepend(1.0::double, list_reverse(range(1, 71))::double[]), lambda a, k: 1 + k / (2 * ({x}) ** 2) / a)"
    return f"case when {x} < 3 then 1 - {series} else exp(-1.0 * ({x}) * ({x})) / (({x}) * sqrt(pi())) / {fraction} end"
