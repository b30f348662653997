"""Panel, contract and origin queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.functions import scalars
from cairnfield.operators import contracts as C
from cairnfield.operators import origins as O
from cairnfield.operators import panel as P
from cairnfield.operators import scores as S
from cairnfield.plans.base import FEATURES, dense, origins, q6, query, r6, rounded, store, truth
from cairnfield.sources import fixtures as X
from cairnfield.sources import readers as R


@query(f"""with {X.SPARSE_SQL}
select month_id, unit - 1 as unit, lr_sb, lr_ns, lr_os, case when lr_sb > 0 then 1.0::double else 0.0::double end as by_sb,
  case when lr_ns > 0 then 1.0::double else 0.0::double end as by_ns, case when lr_os > 0 then 1.0::double else 0.0::double end as by_os
from sparse where unit - 1 > 0""")
def panel_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier 0 stands for the ocean."""
    return P.standardize(X.sparse_panel(spark, sf_dir).withColumn("unit", F.col("unit") - 1), X.TARGETS)


@query(f"""with {X.SPARSE_SQL}
select count(*) as rows_in, count(*) filter (where unit > 1) as rows_out, min(month_id) filter (where unit > 1) as first, max(month_id) filter (where unit > 1) as last,
  count(*) filter (where unit <= 1) as dropped from sparse""")
def ingestion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = X.sparse_panel(spark, sf_dir).withColumn("unit", F.col("unit") - 1)
    return P.ingestion_report(raw, P.land_only(raw))


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A panel that breaks several contracts: repeated keys, missing values, rows before the anchor."""
    d = dense(spark, sf_dir)
    holes = d.withColumn("lr_os", F.when(F.col("unit") % 7 != 0, F.col("lr_os")))
    return holes.unionByName(holes.where("month_id = 181 and unit <= 3"))


@query(f"""with {X.DENSE_SQL},
holes as (select month_id, unit, row, col, c_id, lr_sb, lr_ns, case when unit % 7 <> 0 then lr_os end as lr_os from dense),
broken as (select * from holes union all select * from holes where month_id = 181 and unit <= 3),
keyed as (select month_id, unit, count(*) as k from broken group by 1, 2),
placed as (select month_id, row, col, count(*) as k from broken group by 1, 2, 3),
ranges as (select unit, max(c_id) - min(c_id) as d from broken group by 1)
select 'key_unique' as check_name, cast(sum(k - 1) as bigint) as violations from keyed union all
select 'place_unique', cast(sum(k - 1) as bigint) from placed union all
select 'identity_finite', 0 union all select 'unit_positive', count(*) from broken where unit <= 0 union all
select 'anchor_row', count(*) from broken where row < 88 union all select 'anchor_col', count(*) from broken where col < 310 union all
select 'span_rows', cast(max(row) - min(row) >= 180 as bigint) from broken union all select 'span_cols', cast(max(col) - min(col) >= 180 as bigint) from broken union all
select 'finite_c_id', count(*) from broken where c_id is null union all select 'finite_lr_sb', count(*) from broken where lr_sb is null union all
select 'finite_lr_ns', count(*) from broken where lr_ns is null union all select 'finite_lr_os', count(*) from broken where lr_os is null union all
select 'scale_c_id', count(*) from broken where abs(c_id) > 10000 union all select 'constant_c_id', count(*) from ranges where d > 1e-9""")
def panel_contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.violations(_broken(spark, sf_dir), 180, 180, 88, 310, statics=["c_id"])


@query(f"""with {X.DENSE_SQL}
select month_id, unit, 2::bigint as count from dense where month_id = 181 and unit <= 3 order by 1, 2 limit 5""")
def duplicate_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.duplicate_examples(_broken(spark, sf_dir), ["month_id", "unit"])


_MIX = {"lr_sb": "log1p", "lr_ns": "asinh", "lr_os": "identity"}


@query(f"""with {X.SPARSE_SQL}
select month_id, unit, {q6('ln(1 + lr_sb)')} as lr_sb, {q6('asinh(lr_ns)')} as lr_ns, {q6('lr_os')} as lr_os,
  {q6('exp(ln(1 + lr_sb)) - 1')} as back_sb, {q6('sinh(asinh(lr_ns))')} as back_ns, {q6('lr_os')} as back_os from sparse""")
def panel_scale_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = P.scale(X.sparse_panel(spark, sf_dir), _MIX)
    back = P.unscale(s.withColumns({f"k_{c}": F.col(c) for c in FEATURES}), _MIX)
    return rounded(back.select("month_id", "unit", *[F.col(f"k_{c}").alias(c) for c in FEATURES], *[F.col(c).alias(c.replace("lr_", "back_")) for c in FEATURES]))


@query(f"with {X.DENSE_SQL} select month_id, unit, row, col, c_id, lr_sb, lr_ns, lr_os from dense")
def panel_densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense(spark, sf_dir)


@query(f"""with {X.DENSE_SQL}
select month_id, unit, {q6('2.0::double * (row - 87) / 179 - 1.0')} as row_coord, {q6('2.0::double * (col - 310) / 179 - 1.0')} as col_coord from dense""")
def static_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    channels = P.static_channels(X.grid(spark, sf_dir), ["row_coord", "col_coord"], 180, 180, 87, 310)
    joined = P.attach_static(dense(spark, sf_dir).select("month_id", "unit"), channels, ["row_coord", "col_coord"])
    return rounded(joined.select("month_id", "unit", "row_coord", "col_coord"))


_ACTIVITY_SQL = f"""{X.LONG_SQL},
act as (select target, unit, count(*) filter (where y <> 0) as a from long group by 1, 2)"""


@query(f"""with {_ACTIVITY_SQL}
select 'lr_' || target as target, max(a) as max_activity, count(*) filter (where a > 0) as active_units, count(*) filter (where a >= 8) as qualified from act group by 1""")
def activity_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.activity_maxima(dense(spark, sf_dir), FEATURES, 8)


@query(f"""with {_ACTIVITY_SQL},
maxima as (select 'lr_' || target as target, max(a) as top, row_number() over (order by 'lr_' || target) - 1 as slot from act group by 1),
plan as (select cast(unnest(range(0, 60)) as bigint) as step),
cooled as (select step, greatest(0.2::double, least(0.9::double * 0.95::double, 0.9::double + (-0.7::double / 42.0::double) * step)) as ratio from plan)
select c.step, m.target, {q6('ratio')} as ratio, cast(greatest(1, floor(ratio * top)) as bigint) as threshold from cooled c join maxima m on m.slot = c.step % 3""")
def lesson_planner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.lesson_plan(P.activity_maxima(dense(spark, sf_dir), FEATURES, 1), 60, 0.2, 0.9, 0.7, 0.95))


@query(f"""with {X.DENSE_SQL},
flags as (select month_id, unit, case when lr_sb > 0 then 1 else 0 end as active from dense)
select month_id, unit, active, max(active) over (partition by unit order by month_id range between 2 preceding and 1 following) as supervised,
  max(active) over (partition by unit) as ever, case when max(active) over (partition by unit) = 1 and active = 0 then 1 else 0 end as decay from flags""")
def supervision_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.supervision(dense(spark, sf_dir), "lr_sb", onset_lead=1, cessation_lag=2)


@query(f"""with {X.DENSE_SQL}
select month_id, unit, month_id - max(case when lr_sb > 0 then month_id end) over (partition by unit order by month_id rows between unbounded preceding and 1 preceding) as since from dense""")
def last_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.last_active(dense(spark, sf_dir), "lr_sb")


@query(f"with {X.SPARSE_SQL} select unit, string_agg(distinct month_id::varchar, ',' order by month_id::varchar) as months from sparse where lr_sb > 0 group by unit")
def active_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.active_months(X.sparse_panel(spark, sf_dir), "lr_sb")
    return found.select("unit", F.array_join(F.transform("months", lambda m: m.cast("string")), ",").alias("months"))


@query(f"with {X.SPARSE_SQL} select min(month_id) as first, max(month_id) as last, count(distinct month_id) as months, count(distinct unit) as units from sparse")
def support_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.support_summary(X.sparse_panel(spark, sf_dir))


_N_MONTHS = X.MONTHS[1] - X.MONTHS[0] + 1


def _rolling(spark: SparkSession) -> DataFrame:
    return O.origins_table(spark, O.rolling_origins(_N_MONTHS, 12, 13), X.MONTHS[0])


@query(f"""with {X.SPARSE_SQL}, m as (select min(month_id) as lo, max(month_id) - min(month_id) + 1 as n from sparse)
select cast(i as integer) as origin, cast(lo + i + 1 as integer) as m0 from (select lo, unnest(range(n - 12 - 1 - 12, n - 12)) as i from m)""")
def rolling_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origins over the months that the table has."""
    lo, n = X.sparse_panel(spark, sf_dir).agg(F.min("month_id"), F.max("month_id") - F.min("month_id") + 1).first()
    return O.origins_table(spark, O.rolling_origins(n, 12, 13), lo)


@query(f"""with {X.DENSE_SQL},
o as (select cast(i as integer) as origin, cast({X.MONTHS[0]} + i + 1 as integer) as m0 from (select unnest(range({_N_MONTHS} - 25, {_N_MONTHS} - 12)) as i))
select d.month_id, d.unit, d.lr_sb, o.origin, o.m0, cast(d.month_id - o.m0 + 1 as integer) as h from o join dense d on d.month_id between o.m0 and o.m0 + 11""")
def origin_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.fan_out(dense(spark, sf_dir).select("month_id", "unit", "lr_sb"), _rolling(spark), 12)


@query(f"""with {X.DENSE_SQL}
select cast(d.month_id + k as integer) as month_id, d.unit, d.row, d.col, d.c_id, d.lr_sb, d.lr_ns, d.lr_os
from dense d cross join (select unnest(range(1, 13)) as k) where d.month_id = {X.MONTHS[1]}""")
def future_scaffold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.future_scaffold(dense(spark, sf_dir), 12)


@query(f"""with {X.preds_sql()},
kept as (select * from preds where not (arm = 'B' and h = 12 and (unit + m0) % 7 = 0)),
keys as (select distinct arm, m0, unit, h from kept)
select m0, unit from keys group by m0, unit having count(*) = 6""")
def common_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = store(spark, sf_dir).where(~((F.col("arm") == "B") & (F.col("h") == 12) & ((F.col("unit") + F.col("m0")) % 7 == 0)))
    return O.common_support(some, X.HORIZONS)


@query(f"""with {X.LONG_SQL}, origins as (select cast(unnest(range({X.ORIGINS[0]}, {X.ORIGINS[1] + 1})) as integer) as m0)
select o.m0, l.unit, l.target, max(l.y) > 0 as active from origins o join long l on l.month_id between o.m0 - 12 and o.m0 - 1 group by 1, 2, 3""")
def exante_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.risk_stratum(truth(spark, sf_dir), origins(spark), 12)


_WEIGHTS_SQL = {
    "threshold": "case when a >= 3 then 1.0::double else 0.0::double end",
    "power_law": "case when a >= 3 then a ** 1.5::double else 0.0::double end",
    "boltzmann": "case when a >= 3 then exp((a - top) / 4.0::double) else 0.0::double end",
    "sigmoid": "case when a >= 3 then 1 / (1 + exp(-(0.5::double * (a - 3)))) else 0.0::double end",
}


@query(f"""with {_ACTIVITY_SQL},
sb as (select unit, a, max(a) over () as top from act where target = 'sb'),
w as ({' union all '.join(f"select '{k}' as strategy, unit, a, cast({v} as double) as w from sb" for k, v in _WEIGHTS_SQL.items())})
select strategy, unit, a as activity, {q6("case when sum(w) over (partition by strategy) > 0 then w / sum(w) over (partition by strategy) else 1.0 / count(*) over (partition by strategy) end")} as p from w""")
def anchor_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    act = P.activity(dense(spark, sf_dir), ["lr_sb"])
    out = None
    for name in _WEIGHTS_SQL:
        one = P.anchor_weights(act, "lr_sb", name, 3, **({"alpha": 1.5} if name == "power_law" else {})).select(F.lit(name).alias("strategy"), "unit", "activity", r6("p").alias("p"))
        out = one if out is None else out.unionByName(one)
    return out


_U = lambda text: f"(cast(('0x' || substr(md5({text}), 1, 12)) as bigint) + 0.5::double) / 281474976710656.0::double"
_I = lambda text: f"cast(('0x' || substr(md5({text}), 1, 12)) as bigint)"


def _picked_sql(by: list[str], keys: list[str]) -> str:
    """CTEs from ``cells`` (by, unit, activity) and ``chances`` (by, keys, u, activity, n, w) to ``picked`` (keys, unit)."""
    k, b = ", ".join(keys), "".join(f"{c}, " for c in by)
    same = " and ".join(f"c.{c} = p.{c}" for c in [*by, "activity"])
    return f"""known as (select * replace (case when sum(n * w) over (partition by {k}) > 0 then w else 1.0 end as w) from chances),
placed as (select *, coalesce(sum(n * w) over (partition by {k} order by activity rows between unbounded preceding and 1 preceding), 0) as low, u * sum(n * w) over (partition by {k}) as aim from known where w > 0),
levels as (select * from placed where low <= aim qualify row_number() over (partition by {k} order by activity desc) = 1),
numbered as (select *, row_number() over (partition by {b}activity order by unit) - 1 as place from cells),
picked as (select {', '.join(f'p.{c}' for c in keys)}, c.unit from levels p join numbered c on {same} and c.place = least(p.n - 1, floor((aim - low) / p.w)))"""


def _cut_sql(keys: list[str], dim: int, seed: int, columns: str) -> str:
    """The windows around ``picked``, cut from ``dense`` and flipped, with the keys and the given columns."""
    k, parts = ", ".join(keys), ", ".join(keys)
    tag = lambda axis: f"concat_ws(':', {seed}, '{axis}', {parts})"
    return f"""side as (select max(col) - min(col) + 1 as n from grid),
corners as (select {k}, greatest(0, least(row - 87 - {_I(tag('r'))} % {dim}, n - {dim})) as r0, greatest(0, least(col - 310 - {_I(tag('c'))} % {dim}, n - {dim})) as c0 from picked join grid using (unit) cross join side),
places as (select {k}, dr, dc, r0 + dr + 87 as row, c0 + dc + 310 as col from corners cross join (select unnest(range({dim})) as dr) cross join (select unnest(range({dim})) as dc))
select {k}, month_id, unit, case when {_U(tag('flip-r'))} < 0.5 then {dim} - 1 - dr else dr end as dr, case when {_U(tag('flip-c'))} < 0.5 then {dim} - 1 - dc else dc end as dc, {columns} from places join dense using (row, col)"""


@query(f"""with {X.DENSE_SQL}, cells as (select unit, count(*) filter (where lr_sb <> 0) as activity from dense group by 1),
levels_w as (select activity, count(*) as n, case when activity >= 1 then activity::double else 0 end as w from cells group by 1),
chances as (select d.draw, {_U("concat_ws(':', 5, d.draw)")} as u, l.activity, l.n, l.w from levels_w l cross join (select unnest(range(8)) as draw) d),
{_picked_sql([], ["draw"])}, {_cut_sql(["draw"], 3, 5, "lr_sb")}""")
def anchor_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows around drawn anchors anywhere on the grid, over all months, with jitter and flips."""
    g = X.grid(spark, sf_dir)
    act = P.activity(dense(spark, sf_dir), ["lr_sb"])
    picked = P.draw_anchors(P.anchor_weights(act, "lr_sb", "power_law", 1), 8, 5)
    # The side of the square that the cells are laid on; its last row may be empty.
    side = g.agg(F.max("col") - F.min("col") + 1).first()[0]
    corners = P.windows(g, picked, 3, side, side, 87, 310, 5)
    return P.cut_windows(dense(spark, sf_dir), corners, 3, 87, 310, seed=5).select("draw", "month_id", "unit", "dr", "dc", "lr_sb")


LESSONS = 30


@query(f"""with {X.DENSE_SQL}, act as ({' union all '.join(f"select 'lr_{x}' as target, unit, count(*) filter (where lr_{x} <> 0) as activity from dense group by 2" for x in X.TARGETS)}),
maxima as (select target, max(activity) as top, row_number() over (order by target) - 1 as slot, count(*) over () as many from act group by target),
plan as (select i as step, target, greatest(1, floor(greatest(0.1::double, least(0.9::double * 0.9, 0.9::double + (-0.8::double / {LESSONS * 0.5}::double) * i)) * top)) as threshold
  from (select unnest(range({LESSONS})) as i) join maxima on slot = i % many),
cells as (select * from act),
chances as (select p.step, d.draw, p.target, {_U("concat_ws(':', 9, p.step, d.draw)")} as u, l.activity, l.n, case when l.activity >= p.threshold then 1.0 else 0.0 end as w
  from plan p cross join (select unnest(range(2)) as draw) d join (select target, activity, count(*) as n from act group by all) l on l.target = p.target),
{_picked_sql(["target"], ["step", "draw"])}, {_cut_sql(["step", "draw"], 3, 9, "lr_sb, lr_ns, lr_os")}""")
def curriculum_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planner, lens and window in one: every lesson's target and threshold, its anchors, and the flipped windows around them."""
    d, g = dense(spark, sf_dir), X.grid(spark, sf_dir)
    plan = P.lesson_plan(P.activity_maxima(d, FEATURES, 1), LESSONS, 0.1, 0.9, 0.5, 0.9)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("target"), F.col(c).alias("activity")) for c in FEATURES])).alias("p")
    cells = P.activity(d, FEATURES).select("unit", pairs).select("p.target", "unit", "p.activity")
    anchors = P.lesson_anchors(cells, plan, "threshold", 1, 2, 9)
    side = g.agg(F.max("col") - F.min("col") + 1).first()[0]
    keys = ["step", "draw"]
    corners = P.windows(g, anchors, 3, side, side, 87, 310, 9, keys)
    return P.cut_windows(d, corners, 3, 87, 310, seed=9, keys=keys).select(*keys, "month_id", "unit", "dr", "dc", *FEATURES)


@query(f"""with {X.DENSE_SQL}
select 'lr_sb' as column_name, {q6('avg(lr_sb)')} as mean, {q6('stddev_pop(lr_sb)')} as sd, min(lr_sb) as low, max(lr_sb) as high from dense union all
select 'lr_ns', {q6('avg(lr_ns)')}, {q6('stddev_pop(lr_ns)')}, min(lr_ns), max(lr_ns) from dense""")
def column_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.column_statistics(dense(spark, sf_dir), ["lr_sb", "lr_ns"]))


def _second_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.sparse_panel(spark, sf_dir).where("unit % 13 != 0").withColumn("lr_sb", F.when(F.col("month_id") % 11 == 0, F.col("lr_sb") + 1).otherwise(F.col("lr_sb")))


def _parity_sql() -> str:
    one = lambda c: f"""select '{c}' as column_name, count(*) filter (where b.unit is null) as only_a, count(*) filter (where a.unit is null) as only_b,
  count(*) filter (where a.unit is not null and b.unit is not null) as shared, count(*) filter (where a.{c} <> b.{c}) as mismatches, max(a.{c}) as max_a, max(b.{c}) as max_b,
  sum(a.{c}) filter (where b.unit is not null) as sx, sum(b.{c}) filter (where a.unit is not null) as sy, sum(a.{c} * a.{c}) filter (where b.unit is not null) as sxx,
  sum(b.{c} * b.{c}) filter (where a.unit is not null) as syy, sum(a.{c} * b.{c}) as sxy from sparse a full join other b on a.month_id = b.month_id and a.unit = b.unit"""  # noqa: E731
    return f"""with {X.SPARSE_SQL},
other as (select month_id, unit, case when month_id % 11 = 0 then lr_sb + 1 else lr_sb end as lr_sb, lr_ns from sparse where unit % 13 <> 0),
s as ({one('lr_sb')} union all {one('lr_ns')})
select column_name, only_a, only_b, shared, mismatches, {q6('100.0::double * (shared - mismatches) / shared')} as exact_pct, max_a, max_b, {q6('100.0::double * abs(sy - sx) / sx')} as drift_pct,
  {q6('case when mismatches = 0 then 1.0 else (shared * sxy - sx * sy) / sqrt((shared * sxx - sx * sx) * (shared * syy - sy * sy)) end')} as r from s"""


@query(_parity_sql())
def parity_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.parity_scorecard(X.sparse_panel(spark, sf_dir), _second_truth(spark, sf_dir), ["lr_sb", "lr_ns"]))


@query(f"""with {X.SPARSE_SQL},
other as (select month_id, unit, case when month_id % 11 = 0 then lr_sb + 1 else lr_sb end as lr_sb from sparse where unit % 13 <> 0),
j as (select a.unit as ua, b.unit as ub, a.lr_sb as x, b.lr_sb as y from sparse a full join other b on a.month_id = b.month_id and a.unit = b.unit)
select 'lr_sb' as column_name, count(*) filter (where ua is not null and ub is not null and not abs(x - y) <= 1e-5 + 1e-5 * abs(y)) as mismatches,
  count(*) filter (where ub is null) as only_a, count(*) filter (where ua is null) as only_b from j""")
def table_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = ["month_id", "unit", "lr_sb"]
    return C.parity(X.sparse_panel(spark, sf_dir).select(*cut), _second_truth(spark, sf_dir).select(*cut), ["month_id", "unit"])


_PARAMS_SQL = f"""{X.GRID_SQL},
params as (select unit, 0.5::double + unit % 5 as mu, 0.3::double + unit % 3 as theta, (unit % 10) / 12.0::double as pi, 2.5::double + unit % 7 as mu2, 1.0::double + unit % 2 as theta2, 0.25::double + (unit % 4) / 8.0::double as w from grid)"""


def params(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("unit")
    return X.grid(spark, sf_dir).select(
        "unit", (0.5 + u % 5).alias("mu"), (0.3 + u % 3).alias("theta"), (u % 10 / 12.0).alias("pi"), (2.5 + u % 7).alias("mu2"), (1.0 + u % 2).alias("theta2"), (0.25 + u % 4 / 8.0).alias("w")
    )


_LZ = "(-theta * ln(1 + mu / theta))"
_LZ2 = "(-theta2 * ln(1 + mu2 / theta2))"


@query(f"""with {_PARAMS_SQL}
select unit, 'nb' as family, {q6('mu')} as mean, {q6(f'1 - exp({_LZ})')} as positive from params union all
select unit, 'zinb', {q6('(1 - pi) * mu')}, {q6(f'(1 - pi) * (1 - exp({_LZ}))')} from params union all
select unit, 'mixture', {q6('w * mu + (1 - w) * mu2')}, {q6(f'w * (1 - exp({_LZ})) + (1 - w) * (1 - exp({_LZ2}))')} from params union all
select unit, 'truncated', {q6(f'mu / (1 - exp({_LZ}))')}, 1.0::double from params""")
def family_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = params(spark, sf_dir)
    named = {c: F.col(c) for c in p.columns if c != "unit"}
    out = None
    for family in ("nb", "zinb", "mixture", "truncated"):
        one = p.select("unit", F.lit(family).alias("family"), r6(scalars.family_mean(family, **named)).alias("mean"), r6(scalars.family_positive(family, **named)).alias("positive"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""with {_PARAMS_SQL}, x as (select unit, ln(mu) as reg, pi as prob, theta from params)
select unit, {q6("ln(1 + prob * exp(reg) / (1 - exp(-2.0 * ln(1 + exp(reg) / 2.0))))")} as nb, {q6("ln(1 + prob * exp(reg + 0.5))")} as lognormal, {q6("ln(1 + prob * greatest(exp(reg) - 1, 0))")} as point from x""")
def hurdle_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = params(spark, sf_dir).select("unit", F.log("mu").alias("reg"), F.col("pi").alias("prob"))
    at = lambda kind, d: r6(scalars.hurdle_log1p_mean(kind, F.col("reg"), F.col("prob"), d)).alias(kind)
    return x.select("unit", at("nb", 2.0), at("lognormal", 1.0), at("point", 1.0))


@query(f"""with {X.SPARSE_SQL}, m as (select month_id - min(month_id) over () as i, count(*) over () - 1.0::double as d, count(*) over () * 0.5::double as h from (select distinct month_id from sparse))
select cast(i as bigint) as step, {q6('1 - i / d')} as linear, {q6('5.0::double / (5 + exp(i / d * 10 - 5))')} as inverse_sigmoid, {q6('0.5::double ** (i / d * 5)')} as exponential,
  {q6('greatest(0.1::double, least(0.9::double * 0.9, 0.9::double + (-0.8::double / h) * i))')} as cooling, {q6('64.0::double ** -0.5 * least((i + 1.0::double) ** -0.5, (i + 1.0::double) * 10.0::double ** -1.5)')} as rate from m""")
def schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every schedule over the months of the table, a step for each."""
    months = X.sparse_panel(spark, sf_dir).select("month_id").distinct()
    lo, n = months.agg(F.min("month_id"), F.count("*")).first()
    i = (F.col("month_id") - lo).cast("long")
    kinds = [r6(scalars.epsilon(k, i, n)).alias(k) for k in ("linear", "inverse_sigmoid", "exponential")]
    return months.select(i.alias("step"), *kinds, r6(scalars.cooling(i, n, 0.1, 0.9, 0.5, 0.9)).alias("cooling"), r6(scalars.warmup_rate(i + 1.0, 64.0, 10.0)).alias("rate"))
