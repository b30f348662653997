"""Queries of the guards around a run, and of the losses it reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.functions import scalars
from cairnfield.operators import guards as G
from cairnfield.operators import scores as S
from cairnfield.plans.audit_queries import AT, ATH, T0
from cairnfield.plans.base import cells, cells_sql, dense, q6, query, r6, rounded, scored, store
from cairnfield.plans.panel_queries import _LZ, _PARAMS_SQL, params
from cairnfield.sources import fixtures as X

_STEEP = "case when arm = 'B' and h = 6 and unit % 37 = 0 then 'inf'::double else ey * 60 * h end"


@query(f"""with {cells_sql()}, s as (select arm, target, h, {_STEEP} as x from cells),
g as (select arm, target, h, count(*) as n, count(*) filter (where isinf(x)) as not_finite, max(x) filter (where not isinf(x)) as top from s group by 1, 2, 3)
select arm, target, h, n, not_finite, {q6('top')} as top, case when not_finite > 0 or top > 1000 then 'halt' when top > 500 then 'alarm' when top > 100 then 'warn' else 'ok' end as status from g""")
def prediction_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts made steep and, at one horizon, infinite."""
    broken = (F.col("arm") == "B") & (F.col("h") == 6) & (F.col("unit") % 37 == 0)
    steep = cells(spark, sf_dir).withColumn("x", F.when(broken, F.lit(float("inf"))).otherwise(F.col("ey") * 60 * F.col("h")))
    return rounded(G.prediction_health(steep, "x", ATH))


@query(f"""with {X.preds_sql()}, a as (select target, m0, h, unit, samples from preds where arm = 'A' and unit % 11 <> 3),
b as (select target, m0, h, unit, case when unit % 17 = 5 then list_transform(samples, lambda x: x + 1) else samples end as samples from preds where arm = 'A' and unit % 13 <> 4),
j as (select coalesce(a.target, b.target) as target, coalesce(a.h, b.h) as h, a.unit as ua, b.unit as ub, a.samples = b.samples as eq from a full join b on a.target = b.target and a.m0 = b.m0 and a.h = b.h and a.unit = b.unit),
g as (select target, h, count(*) filter (where ub is null) as only_a, count(*) filter (where ua is null) as only_b, count(*) filter (where not eq) as differing, count(*) filter (where eq) as equal from j group by 1, 2)
select *, only_a = 0 and only_b = 0 and differing = 0 as same from g""")
def run_determinism(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run against itself with cells missing on both sides and some draws moved."""
    run = store(spark, sf_dir, arms=("A",)).select("target", "m0", "h", "unit", "samples")
    moved = F.when(F.col("unit") % 17 == 5, F.transform("samples", lambda x: x + 1)).otherwise(F.col("samples"))
    return G.determinism(run.where("unit % 11 <> 3"), run.where("unit % 13 <> 4").withColumn("samples", moved), ["target", "m0", "h", "unit"], "samples", ["target", "h"])


@query(f"with {X.preds_sql()} select arm, target, count(*) as n, cast(sum(len(samples)) as bigint) as draws, cast(sum(len(samples)) * 4 as bigint) as bytes from preds group by 1, 2")
def planned_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.planned_bytes(store(spark, sf_dir), AT)


@query(f"with {X.DENSE_SQL} select count(*) as n, min(month_id) as first, max(month_id) as last, sum(lr_sb) as lr_sb from dense where month_id <= (select max(month_id) from dense) - 12")
def train_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.holdout(dense(spark, sf_dir), 12).agg(F.count("*").alias("n"), F.min("month_id").alias("first"), F.max("month_id").alias("last"), F.sum("lr_sb").alias("lr_sb"))


@query(f"""with {cells_sql()}, b as (select arm, target, h, avg(crps) filter (where y <= 0) as crps_none, avg(crps) as crps_all from cells group by 1, 2, 3)
select arm, target, {q6('max(crps_none)')} as max_crps_none, {q6('max(crps_all)')} as max_crps_all from b group by 1, 2 union all select arm, null, {q6('max(crps_none)')}, {q6('max(crps_all)')} from b group by 1""")
def worst_over_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.worst_over(S.board(cells(spark, sf_dir), ATH), ["crps_none", "crps_all"], ["arm"]))


@query(f"""with {cells_sql(T0)} select arm, target, count(*) filter (where y > 0) as n_pos, {q6('avg(case when ey > 0.1 then 1.0::double else 0.0::double end) filter (where y > 0)')} as share_alive,
  {q6('quantile_cont(case when y > 0 then ey / y end, 0.5)')} as ratio_median, {q6('avg(ey) filter (where y > 0)')} as ey_mean_pos, {q6('max(ey)')} as ey_max from cells group by 1, 2""")
def body_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.body_probe(cells(spark, sf_dir, T0), AT))


_LEVELS = [0.1, 0.5, 0.9]


@query(f"""with {X.preds_sql(T0)}, k as (select arm, target, y, list_sort(samples) as s from preds), l as (select arm, target, y, unnest([(s[2], 0.1::double), (s[9], 0.5::double), (s[15], 0.9::double)]) as p from k)
select arm, target, {q6('avg(greatest(p[2] * (y - p[1]), (p[2] - 1) * (y - p[1])))')} as loss from l group by 1, 2""")
def quantile_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order statistics of the draws as quantiles."""
    ordered = scored(spark, sf_dir, T0).withColumn("s", F.array_sort("samples"))
    knots = F.array(*[F.get("s", F.lit(i)) for i in (1, 8, 14)])
    return rounded(G.quantile_loss(ordered.select(*AT, "y", knots.alias("knots")), AT, _LEVELS))


_LATENT_LP = "(lgamma(y + theta) - lgamma(theta) - lgamma(y + 1) + theta * (ln(theta) - ln(theta + mu)) + y * (ln(mu) - ln(theta + mu)))"


@query(f"""with {_PARAMS_SQL}, r as (select unit % 2 as part, (unit % 4)::double as y, 1.5::double as theta, ln(1 + exp(mu - 1)) as mu from params)
select part, {q6(f'avg(-{_LATENT_LP})')} as dense, {q6(f'coalesce(avg(-({_LATENT_LP} - ln(1 - exp({_LZ})))) filter (where y > 0), 0)')} as truncated from r group by 1""")
def latent_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("unit")
    rows = params(spark, sf_dir).select((u % 2).alias("part"), (F.col("mu") - 1).alias("latent"), F.log1p((u % 4).cast("double")).alias("target_log"))
    return rounded(G.latent_losses(rows, ["part"], 1.5))


@query(f"""with {cells_sql(T0)}, b as (select target, 'count' as task, avg((ey - y) ** 2) as loss, 0.4::double as v, 2.0::double as w from cells group by 1 union all
  select target, 'event', avg((p - case when y > 0 then 1.0::double else 0.0::double end) ** 2), -0.7::double, 1.0::double from cells group by 1)
select target, task, {q6('loss')} as loss, {q6('loss / (w * exp(v) + 1e-8::double) + ln(exp(v / 2) + 1e-8::double)')} as balanced from b""")
def task_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A regression and a classification loss for each target, weighted by their uncertainty."""
    event = (F.col("y") > 0).cast("double")
    sums = cells(spark, sf_dir, T0).groupBy("target").agg(F.avg(F.pow(F.col("ey") - F.col("y"), 2)).alias("count"), F.avg(F.pow(F.col("p") - event, 2)).alias("event"))
    tasks = F.explode(F.array(*[F.struct(F.lit(t).alias("task"), F.col(t).alias("loss"), F.lit(v).alias("v")) for t, v in (("count", 0.4), ("event", -0.7))])).alias("t")
    long = sums.select("target", tasks).select("target", "t.*")
    return rounded(long.select("target", "task", "loss", G.balanced(F.col("loss"), F.col("v"), F.col("task") == "count").alias("balanced")))


def _soft(x: str) -> str:
    return f"{x} + ln(1 - exp(-({x})))"


@query(f"""with {X.DENSE_SQL}, p as (select avg(case when lr_sb = 0 then 1.0::double else 0.0::double end) as pi, avg(case when lr_sb > 0 then lr_sb end) as mu from dense),
b as (select unnest([('nb', 0, 'mu', 0.5), ('nb', 1, 'theta', 1.0), ('zinb', 0, 'mu', 0.5), ('zinb', 1, 'theta', 1.0), ('zinb', 2, 'pi', pi),
  ('mixture', 0, 'w', 0.9), ('mixture', 1, 'mu1', mu), ('mixture', 2, 'theta1', 1.0), ('mixture', 3, 'gap', 5.0), ('mixture', 4, 'theta2', 1.0), ('truncated', 0, 'mu', 0.5), ('truncated', 1, 'theta', 1.0)]) as t from p),
r as (select t[1] as family, cast(t[2] as integer) as position, t[3] as parameter, cast(t[4] as double) as prior from b)
select family, position, parameter, {q6('prior')} as prior, {q6(f"case when parameter in ('w', 'pi') then ln(prior / (1 - prior)) else {_soft('prior')} end")} as raw from r""")
def initial_biases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every family; the share of zeros and the mean of the events are the panel's."""
    y = F.col("lr_sb")
    priors = dense(spark, sf_dir).agg(F.avg((y == 0).cast("double")).alias("pi"), F.avg(F.when(y > 0, y)).alias("mu")).first().asDict()
    out = None
    for family in G.BIASES:
        one = G.initial_bias(spark, family, priors)
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query(f"""with {_PARAMS_SQL}, n as (select unit % 3 as grp, mu - 2 as value from params) select grp, count(*) as n, {q6('sqrt(sum(value * value))')} as norm from n group by 1""")
def weight_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = params(spark, sf_dir).select((F.col("unit") % 3).alias("grp"), (F.col("mu") - 2).alias("value"))
    return values.groupBy("grp").agg(F.count("*").alias("n"), r6(F.sqrt(F.sum(F.col("value") * F.col("value")))).alias("norm"))


@query(f"""with {X.DENSE_SQL}, l as (select month_id, lr_sb, case when unit % 9 = 0 then 14.0::double when unit % 9 = 1 then 'nan'::double else ln(1 + lr_sb) end as level from dense)
select month_id, count(*) as n, count(*) filter (where isnan(level) or level > 13.1) as out_of_range from l group by 1""")
def out_of_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels beyond what the data can reach, or no numbers."""
    u = F.col("unit") % 9
    level = F.when(u == 0, 14.0).when(u == 1, F.lit(float("nan"))).otherwise(F.log1p("lr_sb"))
    d = dense(spark, sf_dir).select("month_id", level.alias("level"))
    return d.groupBy("month_id").agg(F.count("*").alias("n"), F.count(F.when(scalars.out_of_range(F.col("level")), 1)).alias("out_of_range"))
