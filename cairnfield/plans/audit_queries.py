"""Audit, readout, naming and calendar queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.functions import arrays, keyed
from cairnfield.operators import audit as A
from cairnfield.operators import origins as O
from cairnfield.operators import panel as P
from cairnfield.operators import rollout as RO
from cairnfield.operators import scores as S
from cairnfield.operators import verdicts as V
from cairnfield.plans.base import BOARD_SQL, cells, cells_sql, dense, erfc_sql, origins, q6, query, r6, rounded, scored, store, truth
from cairnfield.plans.panel_queries import _LZ, _PARAMS_SQL, _parity_sql, _second_truth, params
from cairnfield.sources import fixtures as X
from cairnfield.sources import sinks, work

T0 = (1,)
AT = ["arm", "target"]
ATH = ["arm", "target", "h"]


@query(f"""with {X.preds_sql(T0)} select arm, target, m0, unit, {q6(X.MEAN_SQL)} as mean, {q6('list_sort(samples)[8] + (list_sort(samples)[9] - list_sort(samples)[8]) * 0.5::double')} as median from preds""")
def collapse_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir, T0)
    key = ["arm", "target", "m0", "unit"]
    mean = A.collapse(s.withColumn("kept", F.col("samples")), "mean").withColumnsRenamed({"point": "mean", "kept": "samples"})
    return rounded(A.collapse(mean, "median").select(*key, "mean", F.col("point").alias("median")))


@query(f"""with {X.preds_sql(T0)} select arm, m0, h, month_id, unit, {', '.join(f"{q6(f"max(list_sum(samples) / 16) filter (where target = '{t}')")} as pred_{t}" for t in X.TARGETS)} from preds group by 1, 2, 3, 4, 5""")
def wide_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each target's vector in a column of its own, shown by its mean."""
    wide = A.wide_predictions(store(spark, sf_dir, T0), X.TARGETS)
    return rounded(wide.withColumns({f"pred_{t}": arrays.mean(F.col(f"pred_{t}")) for t in X.TARGETS}))


@query(f"""with {X.preds_sql()}
select arm, m0, month_id - m0 + 1 as step, count(*) as n, {q6(f'avg({X.CRPS_SQL})')} as crps from preds group by 1, 2, 3""")
def evaluation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = {m0: {m0 + s - 1: s for s in range(1, 13)} for m0 in range(X.ORIGINS[0], X.ORIGINS[1] + 1)}
    joined = A.evaluation_join(truth(spark, sf_dir), store(spark, sf_dir), steps)
    return rounded(S.cell_scores(joined).groupBy("arm", "m0", "step").agg(F.count("*").alias("n"), F.avg("crps").alias("crps")))


@query(f"""with {X.SPARSE_SQL}, b as (select * from sparse where unit % 13 <> 0)
select count(*) filter (where not exists (select 1 from b where b.month_id = a.month_id and b.unit = a.unit)) as only_a, 0::bigint as only_b,
  count(*) filter (where exists (select 1 from b where b.month_id = a.month_id and b.unit = a.unit)) as both from sparse a""")
def unmatched_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.unmatched(X.sparse_panel(spark, sf_dir), _second_truth(spark, sf_dir), ["month_id", "unit"])


@query(f"""with {X.SPARSE_SQL}, b as (select month_id, unit, case when month_id % 11 = 0 then lr_sb + 1 else lr_sb end as lr_sb from sparse where unit % 13 <> 0)
(select month_id, unit, lr_sb, 'a' as side from (select month_id, unit, lr_sb from sparse except all select month_id, unit, lr_sb from b)) union all
(select month_id, unit, lr_sb, 'b' from (select month_id, unit, lr_sb from b except all select month_id, unit, lr_sb from sparse))""")
def symmetric_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = ["month_id", "unit", "lr_sb"]
    a, b = X.sparse_panel(spark, sf_dir).select(*cut), _second_truth(spark, sf_dir).select(*cut)
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


@query(f"""with {cells_sql()} select arm, target, h, count(*) as n, {q6('avg(case when y > 0 then 1.0::double else 0.0::double end)')} as prevalence, max(y) as y_max, {q6('max(ey)')} as ey_max, {q6('avg(crps)')} as crps,
  {q6('avg((p - case when y > 0 then 1.0::double else 0.0::double end) ** 2)')} as brier, {q6('avg(case when y > 0 then case when ey / y between 0.5 and 2 then 1.0::double else 0.0::double end end)')} as within2,
  {q6('case when sum(ey) <> 0 then sum(case when y > 0 then 0.0 else ey end) / sum(ey) end')} as zero_mass, count(*) filter (where y >= 2) as tail_n,
  {', '.join(f"{q6(f'quantile_cont(case when y > 0 then ey / y end, {q / 100})')} as p{q}" for q in (10, 50, 90))} from cells group by 1, 2, 3""")
def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.audit_rows(cells(spark, sf_dir), ATH, tail=2.0))


def _clipped(t: float) -> str:
    return f"(list_sum(list_transform(samples, lambda x: abs(greatest(x, {t}) - greatest(y, {t})))) / 16 - list_sum(list_transform(list_sort(list_transform(samples, lambda x: greatest(x, {t}))), lambda x, i: (2 * (i - 1) - 15) * x)) / 256)"


@query(f"""with {X.preds_sql(T0)} select arm, target, count(*) as n, {q6(f'avg({X.CRPS_SQL})')} as crps, {q6(f'avg({_clipped(0)})')} as tw0, {q6(f'avg({_clipped(1)})')} as tw1,
  {q6(f'case when sum(y) <> 0 then sum({X.MEAN_SQL}) / sum(y) end')} as mcr, {q6('avg(y)')} as y_mean, {q6(f'avg({X.MEAN_SQL})')} as ey_mean from preds where y > 0 group by 1, 2""")
def proper_score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On events only."""
    return rounded(A.proper_scores(scored(spark, sf_dir, T0).where("y > 0"), AT))


@query(f"""with {cells_sql()}, tagged as (select 'FULL' as tag, * from cells union all select 'STEP-1', * from cells where h = 1)
select tag, arm, target, {BOARD_SQL} from tagged group by 1, 2, 3""")
def magnitude_readout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards of the first month and of all months from one pass over the cells."""
    return rounded(S.board(A.step_and_full(cells(spark, sf_dir)), ["tag", *AT]))


def _divergence_sql(by: str) -> str:
    return f"""with {X.SPARSE_SQL}, other as (select month_id, unit, case when month_id % 11 = 0 then lr_sb + 1 else lr_sb end as lr_sb from sparse where unit % 13 <> 0),
j as (select coalesce(a.month_id, b.month_id) as month_id, coalesce(a.unit, b.unit) as unit, coalesce(a.lr_sb, 0) as x, coalesce(b.lr_sb, 0) as z from sparse a full join other b on a.month_id = b.month_id and a.unit = b.unit)
select {by}, count(*) as n, sum(abs(x - z)) as abs_diff, sum(x) as sum_a, sum(z) as sum_b, count(*) filter (where x = 0 and z = 0) as both_zero, count(*) filter (where x <> 0 and z = 0) as only_a,
  count(*) filter (where x = 0 and z <> 0) as only_b, count(*) filter (where x <> 0 and z <> 0) as neither_zero from j group by {by}"""


@query(_divergence_sql("month_id"))
def divergence_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.divergence(X.sparse_panel(spark, sf_dir), _second_truth(spark, sf_dir), "lr_sb", ["month_id"])


@query(_divergence_sql("unit"))
def divergence_by_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.divergence(X.sparse_panel(spark, sf_dir), _second_truth(spark, sf_dir), "lr_sb", ["unit"])


@query(f"""with s as ({_parity_sql()}), l as (select cast(max((year(l_shipdate) - 1980) * 12 + month(l_shipdate)) as integer) as last from lineitem)
select column_name, only_a = 0 and only_b = 0 as same_cells, coalesce(exact_pct >= 99.9, false) as exact, coalesce(drift_pct <= 5, false) as drift, last >= 260 as covers,
  only_a = 0 and only_b = 0 and coalesce(exact_pct >= 99.9, false) and coalesce(drift_pct <= 5, false) and last >= 260 as passed from s cross join l""")
def parity_falsifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = rounded(S.parity_scorecard(X.sparse_panel(spark, sf_dir), _second_truth(spark, sf_dir), ["lr_sb", "lr_ns"]))
    last = X.sparse_panel(spark, sf_dir).agg(F.max("month_id").alias("last"))
    return V.parity_falsifiers(card.crossJoin(F.broadcast(last)), F.col("last"), required_end=260)


@query(f"""with {X.preds_sql(T0)}, other as (select p.* exclude (y), case when (p.month_id % 11) = 0 and p.target = 'sb' then y + 1 else y end as y from preds p),
scores as (select arm, target, y, gate as p, {X.MEAN_SQL} as ey, {X.CRPS_SQL} as crps from other) select arm, target, {BOARD_SQL} from scores group by 1, 2""")
def second_truth_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scores against another truth table."""
    t = truth(spark, sf_dir)
    other = t.withColumn("y", F.when((F.col("month_id") % 11 == 0) & (F.col("target") == "sb"), F.col("y") + 1).otherwise(F.col("y")))
    return rounded(S.board(S.cell_scores(O.with_truth(store(spark, sf_dir, T0), other, "error"), "gate"), AT))


@query(f"""with {_PARAMS_SQL} select {q6('avg(mu)')} as mu_mean, {q6('stddev_pop(theta) filter (where unit % 2 = 0) / avg(theta) filter (where unit % 2 = 0)')} as theta_cov, {q6('avg(pi)')} as pi_mean, {q6('min(pi)')} as pi_min, {q6('max(pi)')} as pi_max from params""")
def parameter_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.parameter_health(params(spark, sf_dir), F.col("unit") % 2 == 0))


@query(f"""with {_PARAMS_SQL}, c as (select *, least(greatest(pi, 1e-6::double), 1 - 1e-6::double) as q from params) select {q6('0.1::double * sum(w * (ln(q / (1 - q)) + 1.5::double) ** 2) / sum(w)')} as penalty from c""")
def gate_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.gate_penalty(params(spark, sf_dir), -1.5, 0.1, "w"))


@query(f"""with {_PARAMS_SQL}, t as (select case when unit % 3 = 0 then 'enc.' when unit % 3 = 1 then 'dec.' else 'head.' end || (unit % 4) as name, mu - 2 as value from params),
n as (select name, sqrt(sum(value * value)) as norm from t group by 1) select split_part(name, '.', 1) as block, count(*) as tensors, {q6('avg(norm)')} as mean_norm from n group by 1""")
def block_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("unit")
    block = F.when(u % 3 == 0, "enc.").when(u % 3 == 1, "dec.").otherwise("head.")
    return rounded(A.block_norms(params(spark, sf_dir).select(F.concat(block, (u % 4).cast("string")).alias("name"), (F.col("mu") - 2).alias("value"))))


@query(f"""with {cells_sql()}, b as (select arm, target, h, avg(crps) as v from cells group by 1, 2, 3), s as (select arm, target, list(v order by h) as v from b group by 1, 2)
select arm, target, {q6('v[1]')} as first, {q6('v[1 + len(v) // 3]')} as third, {q6('v[len(v)]')} as last from s""")
def horizon_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.horizon_slices(S.board(cells(spark, sf_dir), ATH), AT, "crps_all"))


@query(f"""with {cells_sql()}, b as (select arm, target, h, {q6('avg(crps)')} as crps_all from cells group by 1, 2, 3) select arm, target, h, crps_all from b order by crps_all desc, arm, target, h limit 8""")
def top_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's eight worst rows; the limit is the feature."""
    b = S.board(cells(spark, sf_dir), ATH).select(*ATH, r6("crps_all").alias("crps_all"))
    return A.top_rows(b, "crps_all", 8, ATH)


@query(f"""with {X.DENSE_SQL}, m as (select cast(floor(181 + i * 81 / 4.0) as integer) as month_id from (select unnest(range(5)) as i))
select unit, {q6('avg(lr_sb)')} as lr_sb, {q6('avg(lr_ns)')} as lr_ns from dense where month_id in (select month_id from m) group by 1""")
def temporal_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.temporal_mean(dense(spark, sf_dir), ["lr_sb", "lr_ns"]))


@query(f"""with {X.SPARSE_SQL} select i as month_id, cast(1980 + (i - 1) // 12 as integer) as year, cast((i - 1) % 12 + 1 as integer) as month, strftime(make_date(1980 + (i - 1) // 12, (i - 1) % 12 + 1, 1), '%Y-%m-%d') as first_day from (select distinct month_id as i from sparse)""")
def month_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.month_names(X.sparse_panel(spark, sf_dir).select("month_id").distinct())


@query(f"""with {X.DENSE_SQL}, n as (
  select distinct 'predictions_calibration_' || (1980 + (month_id - 1) // 12) || lpad(cast((month_id - 1) % 12 + 1 as varchar), 2, '0') || '01_102130' as name from sparse union all
  select distinct 'Stage ' || c_id || '/Train Set' from grid union all select distinct 'pred_lr_' || c_id from grid union all select distinct 'lr_' || c_id from grid)
select name, translate(lower(name), ' /', '__') as label, regexp_extract(name, '(\\d{{8}}_\\d{{6}})$', 1) as stamp, regexp_replace(regexp_replace(name, '^pred_', ''), '^lr_', 'by_') as gate from n""")
def artifact_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of runs by month and of stages and targets by nation."""
    m = F.col("month_id") - 1
    runs = X.sparse_panel(spark, sf_dir).select("month_id").distinct().select(F.format_string("predictions_calibration_%d%02d01_102130", (1980 + F.floor(m / 12)).cast("int"), (m % 12 + 1).cast("int")).alias("name"))
    nations = X.grid(spark, sf_dir).select("c_id").distinct()
    kinds = F.array(F.concat(F.lit("Stage "), "c_id", F.lit("/Train Set")), F.concat(F.lit("pred_lr_"), "c_id"), F.concat(F.lit("lr_"), "c_id"))
    return A.artifact_names(runs.unionByName(nations.select(F.explode(kinds).alias("name"))))


@query(f"""with {X.GRID_SQL} select 'nation_' || c_id as name, cast(count(*) as integer) as steps, case when c_id % 3 <> 0 then count(*) / 4.0::double end as threshold from grid group by c_id""")
def config_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as JSON, one for each nation, some without the nested setting, and read back."""
    nations = X.grid(spark, sf_dir).groupBy("c_id").agg(F.count("*").alias("k"))
    nested = F.when(F.col("c_id") % 3 != 0, F.struct((F.col("k") / 4.0).alias("threshold")))
    body = F.to_json(F.struct(F.concat(F.lit("nation_"), "c_id").alias("name"), F.col("k").alias("time_steps"), nested.alias("derivations"), F.array("c_id").alias("other")))
    return A.config_records(nations.select(body.alias("body")))


@query(f"""with {X.DENSE_SQL}, u as (select month_id, unit, lr_sb as y, 0.5::double as own, (cast('0x' || substr(md5('mix:' || month_id || ':' || unit), 1, 12) as bigint) + 0.5::double) / {float(1 << 48)!r}::double as u from dense)
select month_id, unit, case when u < 0.7 then y else own end as x from u""")
def mixed_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dense(spark, sf_dir).select("month_id", "unit", F.col("lr_sb").alias("y"))
    own = d.select("month_id", "unit", F.lit(0.5).alias("own"))
    return A.mixed_inputs(d, own, 0.7, keyed.uniform(F.lit("mix"), F.col("month_id"), F.col("unit")))


@query(f"""with {X.DENSE_SQL}, l as (select month_id, lr_sb = lag(lr_sb) over (partition by unit order by month_id) as s from dense) select month_id, count(*) filter (where s) as same, count(*) as n from l where s is not null group by 1""")
def persistence_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.persistence_share(dense(spark, sf_dir), "lr_sb")


@query(f"""with {X.preds_sql(T0)}, s as (select target, unit, m0, arm, list_transform(samples, lambda x: case when target = 'sb' then ln(1 + x) when target = 'ns' then asinh(x) else x end) as z from preds)
select arm, target, {q6("avg(list_sum(list_transform(z, lambda x: case when target = 'sb' then exp(x) - 1 when target = 'ns' then sinh(x) else x end)) / 16)")} as mean from s group by 1, 2""")
def samples_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inversion comes before collapse: the mean is taken in count space."""
    kinds = {"lr_sb": "log1p", "lr_ns": "asinh", "lr_os": "identity"}
    s = scored(spark, sf_dir, T0)
    forward = {"sb": F.log1p, "ns": F.asinh}
    z = s.withColumn("samples", F.when(F.col("target") == "sb", F.transform("samples", forward["sb"])).when(F.col("target") == "ns", F.transform("samples", forward["ns"])).otherwise(F.col("samples")))
    return rounded(A.collapse(P.unscale_samples(z, kinds), "mean").groupBy(*AT).agg(F.avg("point").alias("mean")))


_LP = "(lgamma(y + theta) - lgamma(theta) - lgamma(y + 1) + theta * (ln(theta) - ln(theta + mu)) + y * (ln(mu) - ln(theta + mu)))"
_LP2 = _LP.replace("theta", "theta2").replace("mu", "mu2")


@query(f"""with {_PARAMS_SQL}, r as (select p.*, (p.unit % 4)::double as y, least(greatest(pi, 1e-6::double), 1 - 1e-6::double) as q from params p)
select 'zinb' as family, {q6(f'avg(-(case when y = 0 then ln(q + (1 - q) * exp({_LP})) else ln(1 - q) + {_LP} end))')} as nll from r union all
select 'mixture', {q6(f'avg(-ln(w * exp({_LP}) + (1 - w) * exp({_LP2})))')} from r union all
select 'truncated', {q6(f'avg(-({_LP} - ln(1 - exp({_LZ}))))')} from r where y > 0""")
def family_likelihoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = params(spark, sf_dir).withColumn("y", (F.col("unit") % 4).cast("double"))
    out = None
    for family in ("zinb", "mixture", "truncated"):
        one = RO.family_nll(p, family).select(F.lit(family).alias("family"), r6("nll").alias("nll"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""with {cells_sql(T0)}, a as (select arm, target, avg(crps) as crps_all from cells group by 1, 2), b as (select arm, target, max(ey) as top from cells group by 1, 2)
select arm, target, {q6('crps_all')} as crps_all, null::double as top from a union all select arm, target, null, {q6('top')} from b""")
def union_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two boards with different columns under one header."""
    c = cells(spark, sf_dir, T0)
    return rounded(sinks.union_boards(S.board(c, AT).select(*AT, "crps_all"), S.trajectory(c, AT).select(*AT, "top")))


@query(f"""with {cells_sql(T0)}, b as (select arm, m0, avg(crps) <= 0.2 as ok from cells group by 1, 2) select arm, count(*) as seeds, bool_and(ok) as confirmed from b group by 1""")
def confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A criterion that must hold on every origin, as it must on every seed."""
    b = S.board(cells(spark, sf_dir, T0), ["arm", "m0"]).select("arm", F.when(F.col("crps_all") <= 0.2, "SURVIVE").otherwise("KILL").alias("outcome"))
    return V.confirm(b)


@query(f"""with {X.preds_sql(T0)}, t as (select arm, target, m0, unit, y, {X.MEAN_SQL} as mean_field, samples[1] as draw_field from preds)
select arm, target, {q6('count(*) filter (where mean_field > 0.5) / greatest(count(*) filter (where y > 0), 1)')} as mean_area, {q6('count(*) filter (where draw_field > 0.5) / greatest(count(*) filter (where y > 0), 1)')} as draw_area from t group by 1, 2""")
def sharpness_of_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean field spreads where a single draw is sharp: forecast area over event area of both."""
    mean = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x) / F.size("samples")
    s = work.table(scored(spark, sf_dir, T0).select(*AT, "unit", "y", mean.alias("mean"), F.get("samples", F.lit(0)).alias("draw")), "fields")
    field = lambda c, name: S.area_concentration(s.select(*AT, "unit", "y", c.alias("ey")), AT).select(*AT, F.col("area_ratio").alias(name))
    return rounded(field(F.col("mean"), "mean_area").join(field(F.col("draw"), "draw_area"), AT))


@query(f"""with {_PARAMS_SQL}, x as (select mu, greatest(unit % 4 - 1, 0)::double as y, mu / sqrt(2) as z from params)
select {q6(f'avg(case when y = 0 then -ln(({erfc_sql("z")}) / 2) else (y - mu) ** 2 / 2 + 0.9189385332046727 end)')} as nll from x""")
def tobit_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(RO.tobit_nll(params(spark, sf_dir).withColumn("y", F.greatest(F.col("unit") % 4 - 1, F.lit(0)).cast("double")), 1.0))


@query(f"""with {X.LONG_SQL}, o as (select cast(unnest(range({X.ORIGINS[0]}, {X.ORIGINS[1] + 1})) as integer) as m0) select o.m0, l.target, count(*) as n, sum(l.y) as total from o join long l on l.month_id between o.m0 - 3 and o.m0 - 1 group by 1, 2""")
def pre_origin_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.pre_origin(truth(spark, sf_dir), origins(spark), 3).groupBy("m0", "target").agg(F.count("*").alias("n"), F.sum("y").alias("total"))
