"""Board, metric, reference, bootstrap and verdict queries over the prediction store."""

from __future__ import annotations

from functools import reduce

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.functions import arrays, keyed, scalars
from cairnfield.functions.registry import LOSSES
from cairnfield.operators import inference as I
from cairnfield.operators import origins as O
from cairnfield.operators import rollout as RO
from cairnfield.operators import scores as S
from cairnfield.operators import verdicts as V
from cairnfield.plans.base import BOARD_SQL, ap_sql, cells, cells_sql, cells_table, dense, erfc_sql, origins, q6, query, r6, rounded, scored, store, truth
from cairnfield.plans.panel_queries import _PARAMS_SQL, params
from cairnfield.sources import fixtures as X
from cairnfield.sources import work

AT = ["arm", "target"]
ATH = ["arm", "target", "h"]
T0 = (1,)


def _with_ap(c: DataFrame, by: list[str]) -> DataFrame:
    return S.board(c, by).join(S.average_precision(c, by), by, "left")


@query(f"""with {cells_sql(T0)}, {ap_sql('arm, target')},
board as (select arm, target, {BOARD_SQL} from cells group by arm, target)
select b.*, {q6('ap.ap')} as ap from board b left join ap on b.arm = ap.arm and b.target = ap.target""")
def board_t0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: first-month scores of every arm and target."""
    return rounded(_with_ap(cells_table(spark, sf_dir, T0), AT))


@query(f"""with {cells_sql()}, {ap_sql('arm, target, h')},
board as (select arm, target, h, {BOARD_SQL} from cells group by arm, target, h)
select b.*, {q6('ap.ap')} as ap from board b left join ap on b.arm = ap.arm and b.target = ap.target and b.h = ap.h""")
def board_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_with_ap(cells_table(spark, sf_dir), ATH))


@query(f"""with {X.preds_sql(T0)},
gated as (select arm, target, y, case when gate >= 0.5 then samples else list_transform(samples, lambda x: 0.0::double) end as samples from preds),
scores as (select arm, target, y, {X.MEAN_SQL} as ey, len(list_filter(samples, lambda x: x > 0)) / 16 as p, {X.CRPS_SQL} as crps from gated)
select arm, target, {BOARD_SQL} from scores group by arm, target""")
def board_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold gate on whole sample vectors, before scoring."""
    s = scored(spark, sf_dir, T0)
    return rounded(S.board(S.cell_scores(s.withColumn("samples", arrays.threshold_gate(F.col("samples"), F.col("gate"), 0.5))), AT))


_REFERENCE_SQL = f"""{X.LONG_SQL},
origins as (select cast(unnest(range({X.ORIGINS[0]}, {X.ORIGINS[1] + 1})) as integer) as m0),
hs as (select cast(unnest({list(X.HORIZONS)}) as integer) as h)"""
_SCORE_SQL = f"scores as (select target, h, y, {X.MEAN_SQL} as ey, len(list_filter(samples, lambda x: x > 0)) / 16 as p, {X.CRPS_SQL} as crps from preds)"


@query(f"""with {_REFERENCE_SQL},
known as (select o.m0, l.unit, l.target, l.y as v from origins o join long l on l.month_id = o.m0 - 1),
preds as (select k.target, hs.h, l.y, list_transform(range(16), lambda k: v) as samples from known k cross join hs join long l on l.month_id = k.m0 + hs.h - 1 and l.unit = k.unit and l.target = k.target),
{_SCORE_SQL} select target, h, {BOARD_SQL} from scores group by target, h""")
def persistence_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = truth(spark, sf_dir)
    return rounded(S.board(S.cell_scores(O.with_truth(O.persistence(t, origins(spark), X.HORIZONS, X.SAMPLES), t, "error")), ["target", "h"]))


def _climatology_sql(pool: str, base: str) -> str:
    return f"""with {_REFERENCE_SQL},
pool as ({pool}),
drawn as (select m0, unit, target, list_transform(range(16), lambda k: vs[1 + cast('0x' || substr(md5('clim:' || {base} || ':' || unit || ':' || target || ':' || k), 1, 12) as bigint) % len(vs)]) as samples from pool),
preds as (select d.target, hs.h, l.y, d.samples from drawn d cross join hs join long l on l.month_id = d.m0 + hs.h - 1 and l.unit = d.unit and l.target = d.target),
{_SCORE_SQL} select target, h, {BOARD_SQL} from scores group by target, h"""


@query(_climatology_sql("select o.m0, l.unit, l.target, list(l.y order by l.month_id) as vs from origins o join long l on l.month_id between o.m0 - 36 and o.m0 - 1 group by 1, 2, 3", "m0"))
def climatology_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws from the 36 months before each origin."""
    t = truth(spark, sf_dir)
    drawn = O.climatology(t, origins(spark), X.HORIZONS, samples=X.SAMPLES, seed="clim")
    return rounded(S.board(S.cell_scores(O.with_truth(drawn, t, "error")), ["target", "h"]))


@query(_climatology_sql("select o.m0, l.unit, l.target, list(l.y order by l.month_id) as vs from origins o cross join long l where l.month_id between 191 and 226 group by 1, 2, 3", "226"))
def climatology_fixed_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws from the last 36 training months for every origin."""
    t = truth(spark, sf_dir)
    drawn = O.climatology(t, origins(spark), X.HORIZONS, samples=X.SAMPLES, seed="clim", anchor=226)
    return rounded(S.board(S.cell_scores(O.with_truth(drawn, t, "error")), ["target", "h"]))


_GAP_SQL = """board as (select arm, target, h, count(*) as n, count(*) filter (where y > 0) as n_event, avg(crps) as crps_all, avg(crps) filter (where y > 0) as crps_events,
  avg(crps) filter (where y <= 0) as crps_none from cells group by 1, 2, 3),
parts as (select a.target, a.h, a.crps_all - b.crps_all as gap, (1 - a.n_event / a.n) * (coalesce(a.crps_none, 0) - coalesce(b.crps_none, 0)) as zero_part,
  a.n_event / a.n * (coalesce(a.crps_events, 0) - coalesce(b.crps_events, 0)) as event_part, 1 - a.crps_all / b.crps_all as skill
  from board a join board b on a.target = b.target and a.h = b.h and a.arm = 'A' and b.arm = 'B')"""


@query(f"""with {cells_sql()}, {_GAP_SQL}
select 'A' as arm, target, h, {q6('gap')} as gap, {q6('zero_part')} as zero_part, {q6('event_part')} as event_part,
  {q6('case when gap <> 0 then zero_part / gap end')} as zero_share, {q6('gap - zero_part - event_part')} as residual, {q6('skill')} as skill from parts""")
def gap_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.gap_decomposition(S.board(cells_table(spark, sf_dir), ATH), "B"))


@query(f"""with {cells_sql()}, {_GAP_SQL} select count(*) as rows, {q6('max(abs(gap - zero_part - event_part))')} as worst, count(*) filter (where not abs(gap - zero_part - event_part) < 1e-9) = 0 as holds from parts""")
def identity_falsifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.identity_falsifier(V.gap_decomposition(S.board(cells_table(spark, sf_dir), ATH), "B")))


_PAIRS_SQL = """pairs as (select a.target, a.m0, a.h, a.unit, a.crps - b.crps as d from cells a join cells b
  on a.target = b.target and a.m0 = b.m0 and a.h = b.h and a.unit = b.unit and a.arm = 'A' and b.arm = 'B')"""


def _block_sql(source: str, by: str, reps: int, level: float, seed: str) -> str:
    """CTEs ending in ``block`` (by, n, blocks, mean, low, high, p)."""
    a = (1 - level) / 2
    cols = by.split(", ")
    same = " and ".join(f"p.{c} = b.{c}" for c in cols)
    listed = ", ".join(f"p.{c}" for c in cols)
    return f"""b_sums as (select {by}, m0, sum(d) as s, count(*) as c from {source} group by {by}, m0),
b_rows as (select *, row_number() over (partition by {by} order by m0) - 1 as i from b_sums),
b_size as (select {by}, count(*) as blocks, sum(s) as total, sum(c) as n from b_sums group by {by}),
b_picks as (select {by}, blocks, n, total, rep, slot, cast('0x' || substr(md5('{seed}:' || rep || ':' || slot), 1, 12) as bigint) % blocks as i
  from b_size cross join (select unnest(range({reps})) as rep) cross join (select unnest(range({X.ORIGINS[1] - X.ORIGINS[0] + 1})) as slot) where slot < blocks),
b_drawn as (select {listed}, p.blocks, p.n, p.total, p.rep, sum(b.s) / sum(b.c) as m from b_picks p join b_rows b on {same} and p.i = b.i group by {listed}, p.blocks, p.n, p.total, p.rep),
block as (select {by}, cast(n as bigint) as n, blocks, total / n as mean, quantile_cont(m, {a}) as low, quantile_cont(m, {1 - a}) as high,
  least(1.0, 2 * least(avg(case when m <= 0 then 1.0::double else 0.0::double end), avg(case when m >= 0 then 1.0::double else 0.0::double end))) as p from b_drawn group by {by}, n, blocks, total)"""


def _iid_sql(source: str, by: str, key: list[str], reps: int, level: float, seed: str) -> str:
    a = (1 - level) / 2
    steps, p, total = [], math.exp(-1), 0.0
    for k in range(8):
        total += p
        steps.append(total)
        p /= k + 1
    weight = " + ".join(f"(case when u >= {s!r}::double then 1 else 0 end)" for s in steps)
    keys = " || ':' || ".join(key)
    return f"""i_hex as (select {by}, d, b, md5('{seed}:' || b || ':' || {keys}) as x from {source} cross join (select unnest(range({-(-reps // 8)})) as b)),
i_many as (select {by}, b * 8 + j as rep, d, (cast('0x' || x[4 * j + 1 : 4 * j + 4] as bigint) + 0.5::double) / 65536.0::double as u from i_hex cross join (select unnest(range(8)) as j)),
i_drawn as (select {by}, rep, sum(d * ({weight})) / sum({weight}) as m from i_many where rep < {reps} group by {by}, rep),
i_plain as (select {by}, count(*) as n, avg(d) as mean from {source} group by {by}),
i_ci as (select {by}, quantile_cont(m, {a}) as low, quantile_cont(m, {1 - a}) as high,
  least(1.0, 2 * least(avg(case when m <= 0 then 1.0::double else 0.0::double end), avg(case when m >= 0 then 1.0::double else 0.0::double end))) as p from i_drawn group by {by}),
iid as (select * from i_plain join i_ci using ({by}))"""


def _out(columns: str) -> str:
    return ", ".join(f"{q6(c)} as {c}" for c in columns.split())


REPS = 2_000
IID_REPS = 1_000


@query(f"""with {cells_sql()}, {_PAIRS_SQL}, {_block_sql('pairs', 'target, h', REPS, 0.9, 'block')} select target, h, n, blocks, {_out('mean low high p')} from block""")
def block_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = I.paired_differences(cells_table(spark, sf_dir), "A", "B")
    return rounded(I.block_bootstrap(d, ["target", "h"], block="m0", replicates=REPS, level=0.9, seed="block"))


@query(f"""with {cells_sql(T0)}, {_PAIRS_SQL}, {_iid_sql('pairs', 'target', ['target', 'm0', 'unit'], IID_REPS, 0.95, 'iid')} select target, n, {_out('mean low high p')} from iid""")
def iid_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = I.paired_differences(cells_table(spark, sf_dir, T0), "A", "B")
    return rounded(I.iid_bootstrap(d, ["target"], key=["target", "m0", "unit"], replicates=IID_REPS, level=0.95, seed="iid"))


@query(f"""with {cells_sql(T0)}, {_PAIRS_SQL}, {_block_sql('pairs', 'target', REPS, 0.9, 'block')}, {_iid_sql('pairs', 'target', ['target', 'm0', 'unit'], IID_REPS, 0.9, 'iid')}
select b.target, {q6('(b.high - b.low) / 2')} as block_half, {q6('(i.high - i.low) / 2')} as iid_half, {q6('case when i.high > i.low then ((b.high - b.low) / 2) / ((i.high - i.low) / 2) end')} as inflation
from block b join iid i on b.target = i.target""")
def minimum_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = I.paired_differences(cells_table(spark, sf_dir, T0), "A", "B")
    block = I.block_bootstrap(d, ["target"], block="m0", replicates=REPS, level=0.9, seed="block")
    iid = I.iid_bootstrap(d, ["target"], key=["target", "m0", "unit"], replicates=IID_REPS, level=0.9, seed="iid")
    return rounded(I.minimum_effect(block, iid, ["target"]))


@query(f"""with {cells_sql()}, {_PAIRS_SQL},
active as (select p.* from pairs p join support s on p.m0 = s.m0 and p.unit = s.unit and p.target = s.target where s.active),
{_block_sql('active', 'target, h', REPS, 0.95, 'stratum')} select target, h, n, blocks, {_out('mean low high p')} from block""")
def stratified_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = I.paired_differences(cells_table(spark, sf_dir), "A", "B")
    strata = O.risk_stratum(truth(spark, sf_dir), origins(spark))
    return rounded(I.stratified_test(d, strata, ["target", "h"], replicates=REPS, seed="stratum"))


_RANKS_SQL = """ranked as (select target, d, abs(d) as a, rank() over (partition by target order by abs(d)) + (count(*) over (partition by target, abs(d)) - 1) / 2 as r from pairs),
s as (select target, count(*) as n, sum(case when d > 0 then r when d = 0 then r / 2 else 0 end) as w_plus, count(*) filter (where d = 0)::double as m0 from ranked group by target),
t as (select target, sum(t * t * t - t) as tie from (select target, a, count(*) as t from ranked where a > 0 group by target, a) group by target)"""
_Z_SQL = "(w_plus - n::double * (n + 1) / 4) / sqrt((n::double * (n + 1) * (2 * n + 1) - m0 * (m0 + 1) * (2 * m0 + 1) - coalesce(tie, 0) / 2) / 24)"


@query(f"""with {cells_sql(T0)}, {_PAIRS_SQL}, {_RANKS_SQL}
select s.target, n, w_plus, {q6(_Z_SQL)} as z from s left join t on s.target = t.target""")
def signed_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(I.signed_ranks(I.paired_differences(cells_table(spark, sf_dir, T0), "A", "B"), ["target"]))


@query(f"""with {cells_sql(T0)}, {_PAIRS_SQL}, {_iid_sql('pairs', 'target', ['target', 'm0', 'unit'], IID_REPS, 0.95, 'iid')}, {_RANKS_SQL},
wilcoxon as (select s.target, abs({_Z_SQL}) / sqrt(2) as x from s left join t on s.target = t.target),
tailed as (select target, {erfc_sql("x")} as wilcoxon_p from wilcoxon)
select i.target, n, {_out('mean low high wilcoxon_p')}, (low > 0 or high < 0) and coalesce(wilcoxon_p < 0.05, false) as significant from iid i join tailed w on w.target = i.target""")
def paired_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = I.paired_differences(cells_table(spark, sf_dir, T0), "A", "B")
    return rounded(I.paired_significance(d, ["target"], key=["target", "m0", "unit"], replicates=IID_REPS, seed="iid"))


@query(f"""with {cells_sql()}, {ap_sql('arm, target, h')}, {_GAP_SQL}, {_PAIRS_SQL}, {_block_sql('pairs', 'target, h', REPS, 0.9, 'block')}
select p.target, p.h, {q6('case when gap <> 0 then zero_part / gap end')} as zero_share, {q6('x.ap - y.ap')} as delta_ap, {q6('skill')} as skill, b.low > 0 or b.high < 0 as excludes_zero,
  case when zero_part / gap > 0.5 and x.ap < y.ap then 'ARTIFACT' when skill >= 0.05 and x.ap > y.ap and (b.low > 0 or b.high < 0) then 'REAL' else 'UNDECIDABLE' end as verdict
from parts p join ap x on x.target = p.target and x.h = p.h and x.arm = 'A' join ap y on y.target = p.target and y.h = p.h and y.arm = 'B' join block b on b.target = p.target and b.h = p.h""")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support, cell scores, decomposition, interval and verdict in one plan."""
    c = cells_table(spark, sf_dir)
    parts = V.gap_decomposition(S.board(c, ATH), "B").drop("arm")
    ap = S.average_precision(c, ATH)
    th = ["target", "h"]
    delta = ap.where("arm = 'A'").select(*th, F.col("ap").alias("a")).join(ap.where("arm = 'B'").select(*th, F.col("ap").alias("b")), th).select(*th, (F.col("a") - F.col("b")).alias("delta_ap"))
    ci = I.block_bootstrap(I.paired_differences(c, "A", "B"), th, block="m0", replicates=REPS, level=0.9, seed="block")
    joined = parts.join(delta, th).join(ci.select(*th, ((F.col("low") > 0) | (F.col("high") < 0)).alias("excludes_zero")), th)
    token = V.verdict(F.col("zero_share"), F.col("delta_ap"), F.col("skill"), F.col("excludes_zero"))
    return rounded(joined.select(*th, "zero_share", "delta_ap", "skill", "excludes_zero", token.alias("verdict")))


@query(f"with {cells_sql()}, {ap_sql('arm, target, h')} select arm, target, h, {q6('ap')} as ap from ap")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.average_precision(cells(spark, sf_dir), ATH))


@query(f"""with {cells_sql()},
ties as (select arm, target, h, p as s, count(*) filter (where y > 0) as pos, count(*) as n from cells group by 1, 2, 3, 4),
run as (select *, coalesce(sum(n - pos) over (partition by arm, target, h order by s rows between unbounded preceding and 1 preceding), 0) as below from ties)
select arm, target, h, {q6('case when sum(pos) > 0 and sum(n - pos) > 0 then sum(pos * (2 * below + n - pos)) / (2 * sum(pos) * sum(n - pos)) end')} as auc from run group by 1, 2, 3""")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.roc_auc(cells(spark, sf_dir), ATH))


@query(f"""with {cells_sql()},
r as (select arm, target, h, rank() over (partition by arm, target, h order by y) + (count(*) over (partition by arm, target, h, y) - 1) / 2 as ry,
  rank() over (partition by arm, target, h order by ey) + (count(*) over (partition by arm, target, h, ey) - 1) / 2 as re from cells where y > 0),
s as (select arm, target, h, count(*) as n, sum(ry) as sx, sum(re) as sy, sum(ry * ry) as sxx, sum(re * re) as syy, sum(ry * re) as sxy from r group by 1, 2, 3)
select arm, target, h, n, {q6('case when n < 2 then null when n * sxx - sx * sx <= 0 or n * syy - sy * sy <= 0 then 0.0 else (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) end')} as rho from s""")
def spearman_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.spearman_positive(cells(spark, sf_dir), ATH))


_BIN_SQL = " + ".join(f"(case when p >= {i * (1.0 / 10)!r}::double then 1 else 0 end)" for i in range(1, 10))
_RELIABILITY_SQL = f"bins as (select arm, target, {_BIN_SQL} as bin, count(*) as n, avg(p) as p_mean, avg(case when y > 0 then 1.0::double else 0.0::double end) as freq from cells group by 1, 2, 3)"


@query(f"with {cells_sql()}, {_RELIABILITY_SQL} select arm, target, bin, n, {_out('p_mean freq')} from bins")
def reliability_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.reliability(cells(spark, sf_dir), AT))


@query(f"with {cells_sql()}, {_RELIABILITY_SQL} select arm, target, {q6('sum(n * abs(p_mean - freq)) / sum(n)')} as ece from bins group by 1, 2")
def reliability_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.expected_calibration_error(S.reliability(cells(spark, sf_dir), AT), AT))


@query(f"""with {cells_sql()}, b as (select arm, target, avg((p - case when y > 0 then 1.0::double else 0.0::double end) ** 2) as brier, avg(case when y > 0 then 1.0::double else 0.0::double end) as rho from cells group by 1, 2)
select arm, target, {q6('brier')} as brier, {q6('rho')} as rho, {q6('rho * (1 - rho)')} as brier_base, {q6('case when rho * (1 - rho) > 0 then 1 - brier / (rho * (1 - rho)) end')} as skill from b""")
def base_rate_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.base_rate_skill(cells(spark, sf_dir), AT))


_EDGE_SQL = " + ".join(f"(case when y >= {e!r}::double then 1 else 0 end)" for e in S.TAIL_EDGES)


@query(f"""with {X.preds_sql()},
one as (select arm, target, {_EDGE_SQL} - 1 as bin, y, {X.MEAN_SQL} as ey, list_sort(samples)[14] + (list_sort(samples)[15] - list_sort(samples)[14]) * 0.5::double as q90, list_max(samples) as top from preds where y >= 1)
select arm, target, bin, count(*) as n, {q6('quantile_cont(y, 0.5)')} as y_med, {q6('quantile_cont(ey, 0.5)')} as ey_med, {q6('avg(case when top >= y then 1.0::double else 0.0::double end)')} as reach,
  {q6('avg(case when y <= q90 then 1.0::double else 0.0::double end)')} as cover90, {q6('avg(greatest(0.9::double * (y - q90), -0.1::double * (y - q90)))')} as pin90 from one group by 1, 2, 3""")
def tail_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.tail_scorecard(scored(spark, sf_dir), AT))


@query(f"""with {X.preds_sql()},
cuts as (select target, quantile_cont(y, 0.97) as cut from long where month_id <= 226 and y > 0 group by 1),
one as (select p.arm, p.target, p.y, c.cut, {X.MEAN_SQL} as ey, list_sort(samples)[15] + (list_sort(samples)[16] - list_sort(samples)[15]) * (0.99::double * 15 - 14) as q from preds p join cuts c on p.target = c.target where p.y > 0)
select arm, target, count(*) filter (where y <= cut) as bulk_n, count(*) filter (where y > cut) as tail_n, {q6('quantile_cont(case when y <= cut then ey / y end, 0.5)')} as ratio_med,
  {q6('avg(case when y <= cut then case when ey / y between 0.5 and 2 then 1.0::double else 0.0::double end end)')} as within2,
  {q6('avg(case when y > cut then greatest(0.99::double * (y - q), -0.01::double * (y - q)) end)')} as pin_tail from one group by 1, 2""")
def bulk_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = S.bulk_cut(truth(spark, sf_dir).where("month_id <= 226"), 0.97)
    return rounded(S.bulk_calibration(scored(spark, sf_dir), cuts, AT))


@query(f"""with {cells_sql()} select arm, target, {q6('case when sum(y) <> 0 then sum(ey) / sum(y) end')} as mcr_all, {q6('avg(ey) filter (where y <= 0)')} as mcr_none, {q6('avg(case when y > 0 then ey / y end)')} as pos_mcr from cells group by 1, 2""")
def mcr_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.board(cells(spark, sf_dir), AT).select(*AT, "mcr_all", "mcr_none", "pos_mcr"))


@query(f"""with {cells_sql()} select arm, target, {', '.join(f"{q6(f'quantile_cont(ey / y, {q / 100})')} as p{q}" for q in (10, 25, 50, 75, 90))} from cells where y > 0 group by 1, 2""")
def ratio_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.ratio_distribution(cells(spark, sf_dir), AT))


@query(f"""with {cells_sql()}, med as (select arm, target, quantile_cont(ey / y, 0.5) as m from cells where y > 0 group by 1, 2)
select c.arm, c.target, count(*) as n, {q6('max(m)')} as ratio_med, {q6('avg(case when ey / y between 0.5 and 2 then 1.0::double else 0.0::double end)')} as within2,
  {q6('avg(case when ey / y / (case when m > 0 then m else 1.0::double end) between 0.5 and 2 then 1.0::double else 0.0::double end)')} as rescaled
from cells c join med on c.arm = med.arm and c.target = med.target where y > 0 group by 1, 2""")
def within_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.within_two(cells_table(spark, sf_dir), AT))


@query(f"""with {cells_sql()},
q as (select arm, target, quantile_cont(case when y between 1 and 1 then y end, 0.5) as ys, quantile_cont(case when y >= 2 then y end, 0.5) as yb, quantile_cont(case when y between 1 and 1 then ey end, 0.5) as es, quantile_cont(case when y >= 2 then ey end, 0.5) as eb from cells group by 1, 2)
select arm, target, {q6('yb / greatest(ys, 1e-3::double)')} as truth_range, {q6('eb / greatest(es, 1e-3::double)')} as pred_range from q""")
def range_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.range_compression(cells(spark, sf_dir), AT, small=(1.0, 1.0), big=2.0))


@query(f"""with {cells_sql()} select arm, target, {q6('sum(case when y <= 0 then ey else 0 end) / sum(ey)')} as zero_mass, {q6('avg(y) filter (where y >= 2) / avg(ey) filter (where y >= 2)')} as tail_miss from cells group by 1, 2""")
def zero_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.zero_mass(cells(spark, sf_dir), AT, tail=2.0))


@query(f"with {cells_sql()} select arm, target, h, {q6('avg(ey)')} as mean, {q6('quantile_cont(ey, 0.99)')} as p99, max(ey) as top from cells group by 1, 2, 3")
def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.trajectory(work.table(cells(spark, sf_dir).select(*ATH, "ey"), "cells"), ATH))


def _fss_sql() -> str:
    one = lambda n: f"""select a.arm, a.target, a.m0, {n} as scale, a.row, a.col, sum(b.f) as bf, sum(b.o) as bo from field a join field b
  on a.arm = b.arm and a.target = b.target and a.m0 = b.m0 and b.row between a.row - {n // 2} and a.row + {n // 2} and b.col between a.col - {n // 2} and a.col + {n // 2} group by 1, 2, 3, 4, 5, 6"""  # noqa: E731
    return f"""with {cells_sql(T0)},
field as (select c.arm, c.target, c.m0, g.row, g.col, case when ey > 0.5 then 1.0::double else 0.0::double end as f, case when y > 0 then 1.0::double else 0.0::double end as o from cells c join grid g on c.unit = g.unit),
boxes as ({one(1)} union all {one(3)} union all {one(5)})
select arm, target, m0, scale, {q6('case when sum(bf * bf + bo * bo) > 0 then 1 - sum((bf - bo) ** 2) / sum(bf * bf + bo * bo) end')} as fss from boxes group by 1, 2, 3, 4"""


@query(_fss_sql())
def fss_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["arm", "target", "m0"]
    return rounded(S.fractions_skill(work.table(cells(spark, sf_dir, T0).select(*by, "unit", "y", "ey"), "cells"), X.grid(spark, sf_dir), by, (1, 3, 5)))


_RANKED_SQL = """ranked as (select *, row_number() over (partition by arm, target, m0 order by ey desc, unit) as k, sum(case when ey > 0 then 1 else 0 end) over (partition by arm, target, m0) as pos,
  sum(case when y > 0 then 1 else 0 end) over (partition by arm, target, m0) as events from cells)"""


@query(f"""with {cells_sql(T0)}, {_RANKED_SQL}
select arm, target, m0, {q6('count(*) filter (where ey > 0.5) / greatest(count(*) filter (where y > 0), 1)')} as area_ratio,
  {q6('case when sum(ey) <> 0 then sum(case when k <= greatest(1, floor(pos / 100)) then ey else 0 end) / sum(ey) end')} as top_share from ranked group by 1, 2, 3""")
def area_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["arm", "target", "m0"]
    return rounded(S.area_concentration(work.table(cells(spark, sf_dir, T0).select(*by, "y", "ey"), "cells"), by))


@query(f"with {cells_sql(T0)}, {_RANKED_SQL} select arm, target, m0, max(ey) filter (where k = events) as level from ranked group by 1, 2, 3")
def matched_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["arm", "target", "m0"]
    return S.matched_threshold(work.table(cells(spark, sf_dir, T0).select(*by, "y", "ey"), "cells"), by)


@query(f"""with {cells_sql(T0)}, ranked as (
  select p.arm, p.target, p.m0, p.unit, p.y, {X.MEAN_SQL} as ey, list_max(samples) > 0 as fires, row_number() over (partition by p.arm, p.target, p.m0 order by {X.MEAN_SQL} desc, p.unit) as k from preds p)
select arm, target, m0, {q6('avg(case when fires then 1.0::double else 0.0::double end)')} as fired, {q6('avg(case when y > 0 then 1.0::double else 0.0::double end)')} as true_rate,
  count(*) filter (where k <= 5 and y > 0) as hits, {q6('count(*) filter (where k <= 5 and y > 0) / count(*) filter (where k <= 5)')} as precision_at_k, {q6('avg(ey) filter (where k <= 5 and y <= 0)')} as false_size
from ranked group by 1, 2, 3""")
def activation_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.activation(scored(spark, sf_dir, T0), ["arm", "target", "m0"], 5))


_SPREAD_SQL = "list_sum(list_transform(list_sort(samples), lambda x, i: (2 * (i - 1) - 15) * x))"


@query(f"""with {X.preds_sql()},
s as (select arm, target, list_sum(list_transform(samples, lambda x: abs(x - y))) / 16 as a, 2 * {_SPREAD_SQL} / 256 as b from preds)
select arm, target, count(*) as n, {q6('avg(-a / b - ln(b) / 2)')} as scrps from s where b > 0 group by 1, 2""")
def scrps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled CRPS over forecasts with spread; a point forecast has no scale."""
    s = scored(spark, sf_dir).where(arrays.spread(F.col("samples")) > 0)
    return rounded(s.groupBy(*AT).agg(F.count("*").alias("n"), F.avg(arrays.scrps(F.col("samples"), F.col("y"))).alias("scrps")))


@query(f"""with {X.preds_sql()}, clipped as (select arm, target, greatest(y, 1) as y, list_transform(samples, lambda x: greatest(x, 1)) as samples from preds)
select arm, target, {q6(f'avg({X.CRPS_SQL})')} as tw_crps from clipped group by 1, 2""")
def tw_crps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scored(spark, sf_dir).groupBy(*AT).agg(F.avg(arrays.tw_crps(F.col("samples"), F.col("y"), 1.0)).alias("tw_crps")))


@query(f"""with {X.preds_sql(T0)},
pits as (select arm, target, (len(list_filter(samples, lambda x: x < y)) + (cast('0x' || substr(md5('pit:' || arm || ':' || target || ':' || m0 || ':' || unit), 1, 12) as bigint) + 0.5::double) / {float(1 << 48)!r}::double
  * len(list_filter(samples, lambda x: x = y))) / 16 as pit from preds),
b as (select arm, target, least(floor(pit * 10), 9) as bin, count(*) as c from pits group by 1, 2, 3), n as (select arm, target, sum(c) as n, count(*) as bins from b group by 1, 2)
select n.arm, n.target, cast(max(n.n) as bigint) as n, {q6('(sum(abs(c / n.n - 0.1::double)) + (10 - max(bins)) * 0.1::double) / 10')} as flatness from n join b on n.arm = b.arm and n.target = b.target group by 1, 2""")
def pit_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = keyed.uniform(F.lit("pit"), F.col("arm"), F.col("target"), F.col("m0"), F.col("unit"))
    pits = scored(spark, sf_dir, T0).select(*AT, arrays.pit(F.col("samples"), F.col("y"), u).alias("pit"))
    return rounded(S.pit_flatness(pits, AT))


@query(f"""with {cells_sql()}, rates as (select arm, target, avg(case when y > 0 then 1.0::double else 0.0::double end) as rho, avg(y) filter (where y > 0) as m from cells group by 1, 2),
z as (select c.arm, c.target, gate as pi, ey / greatest(gate, 1e-4::double) as body, rho, coalesce(m, 0) as m from cells c join rates r on c.arm = r.arm and c.target = r.target where y <= 0),
s as (select arm, target, avg(pi * body) as leak, avg(pi * body - least(pi, rho) * body) as by_gate, avg(pi * body - pi * least(body, m)) as by_body from z group by 1, 2)
select arm, target, {_out('leak by_gate by_body')}, {q6('case when by_gate + by_body <> 0 then by_gate / (by_gate + by_body) end')} as gate_share, case when by_gate >= by_body then 'gate' else 'body' end as dominant from s""")
def hurdle_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.hurdle_attribution(cells_table(spark, sf_dir), AT))


@query(f"""with {cells_sql()}, e as (select arm, target, y, gate as pi, ey / greatest(gate, 1e-4::double) as body from cells where y > 0)
select arm, target, {q6('avg(greatest(y - pi * body, 0))')} as shortfall, {q6('avg(body - pi * body)')} as by_gate, {q6('avg(pi * greatest(y - body, 0))')} as by_body from e group by 1, 2""")
def underfire_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.underfire_attribution(cells(spark, sf_dir), AT))


@query(f"""with {cells_sql()}, seen as (select o.m0, l.unit, l.target, o.m0 - max(l.month_id) as since from origins o join long l on l.month_id between o.m0 - 46 and o.m0 - 1 and l.y > 0 group by 1, 2, 3),
split as (select c.arm, c.target, w.k, coalesce(s.since <= w.k, false) as recent, c.ey from cells c left join seen s on c.m0 = s.m0 and c.unit = s.unit and c.target = s.target cross join (select cast(unnest([3, 12]) as integer) as k) w where c.y <= 0),
g as (select arm, target, k, recent, count(*) as n, sum(ey) as mass from split group by 1, 2, 3, 4)
select arm, target, k, recent, n, {q6('mass / n')} as leak, {q6('mass / sum(mass) over (partition by arm, target, k)')} as share from g""")
def decay_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = O.pre_origin(truth(spark, sf_dir).where("y > 0"), origins(spark), 46)
    recency = before.groupBy("m0", "unit", "target").agg((F.first("m0") - F.max("month_id")).alias("since"))
    return rounded(S.decay_split(cells(spark, sf_dir), recency))


@query(f"""with {cells_sql()}, seen as (select distinct o.m0, l.unit, l.target from origins o join long l on l.month_id between o.m0 - 12 and o.m0 - 1 and l.y > 0),
recent as (select c.* from cells c join seen s on c.m0 = s.m0 and c.unit = s.unit and c.target = s.target), {ap_sql('arm, target', 'recent')} select arm, target, {q6('ap')} as ap from ap""")
def decay_discrimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking within cells that were active in the year before the origin."""
    strata = O.risk_stratum(truth(spark, sf_dir), origins(spark)).where("active")
    return rounded(S.average_precision(cells(spark, sf_dir).join(work.large(strata), ["m0", "unit", "target"], "left_semi"), AT))


TEMPERATURES = (1.0, 1.5, 2.0, 3.0, 5.0, 8.0)


@query(f"""with {cells_sql()}, g as (select arm, target, y, least(greatest(gate, 1e-6::double), 1 - 1e-6::double) as p, ey / greatest(gate, 1e-4::double) as body, t.temperature
  from cells cross join (select cast(unnest([1.0, 1.5, 2.0, 3.0, 5.0, 8.0]) as double) as temperature) t), m as (select *, 1 / (1 + exp(-(temperature * ln(p / (1 - p))))) * body as m from g)
select arm, target, temperature, {q6('case when sum(y) <> 0 then sum(m) / sum(y) end')} as mcr, {q6('avg(m) filter (where y <= 0)')} as leak, {q6('avg(m) filter (where y > 0)')} as pos from m group by 1, 2, 3""")
def gate_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.gate_sweep(cells(spark, sf_dir), AT, TEMPERATURES), "temperature")


@query(f"""with {cells_sql()} select arm, target, m0 as by_origin, h as by_step, month_id as by_month, count(*) as n, {q6('avg(crps)')} as score from cells group by grouping sets ((arm, target, m0), (arm, target, h), (arm, target, month_id))""")
def eval_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.evaluation_schemas(cells(spark, sf_dir)))


@query(f"""with {X.preds_sql()}, pooled as (select a.target, a.h, a.y, a.samples || b.samples as samples from preds a join preds b on a.target = b.target and a.m0 = b.m0 and a.h = b.h and a.unit = b.unit and a.arm = 'A' and b.arm = 'B')
select target, h, count(*) as n, {q6("avg(list_sum(list_transform(samples, lambda x: abs(x - y))) / 32 - list_sum(list_transform(list_sort(samples), lambda x, i: (2 * (i - 1) - 31) * x)) / 1024)")} as crps from pooled group by 1, 2""")
def ensemble_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = O.with_truth(S.ensemble(store(spark, sf_dir)), truth(spark, sf_dir), "error")
    return rounded(S.cell_scores(pooled).groupBy("target", "h").agg(F.count("*").alias("n"), F.avg("crps").alias("crps")))


@query(f"""with {cells_sql(T0)}, {ap_sql('arm, target')},
b as (select arm, target, avg(crps) as crps_all, avg(ey) filter (where y <= 0) as x, avg(crps) filter (where y <= 0) as crps_none, sum(ey) / sum(y) as mcr_all from cells group by 1, 2),
w as (select b.arm, max(mcr_all) as mcr, max(crps_none) as leak, max(crps_all) as crps, min(ap) as ap from b join ap on b.arm = ap.arm and b.target = ap.target group by 1)
select arm, mcr > 1e7 as k1, leak > 0.1 as k2, crps <= 0.6 as s1, coalesce(ap >= 0.3, false) as s2, case when mcr > 1e7 or leak > 0.1 then 'KILL' when crps <= 0.6 and coalesce(ap >= 0.3, false) then 'SURVIVE' else 'HOLD' end as outcome from w""")
def screen_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.screen(_with_ap(cells_table(spark, sf_dir, T0), AT), {"k1": 1e7, "k2": 0.10, "crps": 0.60, "ap": 0.30})


@query(f"""with {cells_sql()}, b as (select arm, target, h, avg(crps) filter (where y <= 0) as none, avg(ey) as m from cells group by 1, 2, 3)
select arm, {q6('max(none)')} as worst_none, {q6('max(m)')} as worst_mean, max(none) > 0.5 or max(m) > 5 as bloomed from b group by 1""")
def bloom_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells_table(spark, sf_dir)
    return rounded(V.bloom(S.board(c, ATH), S.trajectory(c, ATH)))


@query(f"""with {cells_sql(T0)}, b as (select arm, target, avg(crps) as crps_all, avg((p - case when y > 0 then 1.0::double else 0.0::double end) ** 2) as brier, sum(ey) / sum(y) as mcr from cells group by 1, 2)
select a.arm, a.target, coalesce(a.crps_all <= 0.95::double * r.crps_all and a.brier <= 1.01::double * r.brier and abs(a.mcr - 1) < abs(r.mcr - 1), false) as eligible from b a join b r on a.target = r.target and r.arm = 'B' and a.arm <> 'B'""")
def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.eligibility(S.board(cells_table(spark, sf_dir, T0), AT), "B")


_GPD_SQL = "case when sigma <> 0 then least(1.0, greatest(0.0, case when abs(gamma) < 1e-9 then 1 - exp(-v / sigma) else 1 - case when 1 + gamma * v / sigma > 0 then (1 + gamma * v / sigma) ** (-1 / gamma) else 0.0 end end)) end"


@query(f"""with {cells_sql()},
pairs as (select a.target, a.crps as cm, b.crps as cr from cells a join cells b on a.target = b.target and a.m0 = b.m0 and a.h = b.h and a.unit = b.unit and a.arm = 'A' and b.arm = 'B'),
sides as (select target, 'model' as side, cm as x from pairs union all select target, 'ref', cr from pairs),
cut as (select target, quantile_cont(x, 0.9) as u from sides group by 1),
over_u as (select s.target, side, u, x - u as v from sides s join cut c on s.target = c.target where x > u),
pw as (select target, v, row_number() over (partition by target order by v) as i, count(*) over (partition by target) as m from over_u where side = 'ref'),
a as (select target, m, sum(v) / m as a0, sum((m - i) * v) / m / greatest(m - 1, 1) as a1 from pw group by 1, 2),
fit as (select target, case when m > 1 and abs(a0 - 2 * a1) > 1e-12 and 2 * a0 * a1 / (a0 - 2 * a1) > 0 then 2 - a0 / (a0 - 2 * a1) end as gamma, case when m > 1 and abs(a0 - 2 * a1) > 1e-12 and 2 * a0 * a1 / (a0 - 2 * a1) > 0 then 2 * a0 * a1 / (a0 - 2 * a1) end as sigma from a),
placed as (select o.target, side, u, gamma, sigma, v, row_number() over (partition by o.target, side order by v) as i, count(*) over (partition by o.target, side) as m from over_u o join fit f on o.target = f.target),
om as (select target, u, gamma, side, m, 1 / (12 * m) + sum(({_GPD_SQL} - (2 * i - 1) / (2 * m)) ** 2) as omega from placed group by 1, 2, 3, 4, 5),
wide as (select target, u, gamma, max(m) filter (where side = 'model') as m_model, max(omega) filter (where side = 'model') as o_model, max(m) filter (where side = 'ref') as m_ref, max(omega) filter (where side = 'ref') as o_ref from om group by 1, 2, 3)
select target, {q6('u')} as u, coalesce(m_model, 0) as n_model, coalesce(m_ref, 0) as n_ref, {q6('gamma')} as gamma, {q6('case when coalesce(m_model, 0) >= 20 and coalesce(m_ref, 0) >= 20 and o_model > 0 then 1 - o_ref / o_model end')} as index, gamma > 0.9 as ceiling from wide""")
def tail_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells_table(spark, sf_dir)
    key = ["target", "m0", "h", "unit"]
    pairs = c.where("arm = 'A'").select(*key, F.col("crps").alias("crps_model")).join(work.large(c.where("arm = 'B'").select(*key, F.col("crps").alias("crps_ref"))), key)
    return rounded(V.tail_index(pairs, 0.9, 20))


@query(f"""with {cells_sql(T0, ('A',))},
per as (select target as key, m0 as lesson, avg((ey - y) ** 2) as mse, avg(abs(ey - y)) as mae, avg((ln(1 + ey) - ln(1 + y)) ** 2) as msle, sum(ey) as sh, sum(y) as sy from cells where m0 <> 230 group by 1, 2),
every as (select k.key, l.lesson, mse, mae, msle, sh, sy from (select distinct key from per) k cross join (select cast(unnest(range({X.ORIGINS[0]}, {X.ORIGINS[1] + 1})) as integer) as lesson) l left join per p on p.key = k.key and p.lesson = l.lesson)
select key, lesson, {_out('mse mae msle')}, {q6('sqrt(msle)')} as rmsle, {q6('case when mse is not null then case when sy = 0 then 1.0 else sh / sy end end')} as bias,
  {q6('case when coalesce(sum(sy) over w, 0) = 0 then 1.0 else coalesce(sum(sh) over w, 0) / sum(sy) over w end')} as running_bias, {q6('coalesce(last_value(mse ignore nulls) over w, 0)')} as carried
from every window w as (partition by key order by lesson)""")
def metric_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One lesson has no records and carries the last value forward."""
    records = cells(spark, sf_dir, T0, ("A",)).where("m0 != 230").select(F.col("target").alias("key"), F.col("m0").alias("lesson"), "y", F.col("ey").alias("yh"))
    return rounded(S.metric_history(records))


@query(f"""with {cells_sql()} select arm, target, {', '.join(f"{q6(f'avg(crps) filter (where h = {h})')} as \"{h}\"" for h in X.HORIZONS)} from cells group by 1, 2""")
def horizon_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.horizon_pivot(S.board(cells(spark, sf_dir), ATH), X.HORIZONS))


@query(f"""with {cells_sql()}, s as (select arm, target, m0, h, unit, gate, ey, y from cells)
select arm, target, {q6('avg(ey)')} as self_zeroed, {q6('avg(gate * ey)')} as soft_gate, {q6('avg(case when gate >= 0.5 then ey else 0 end)')} as threshold_gate from s group by 1, 2""")
def compose_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    m, p = F.col("ey"), F.col("gate")
    means = {"self_zeroed": scalars.compose_mean(m, p, "self_zeroed"), "soft_gate": scalars.compose_mean(m, p, "soft_gate"), "threshold_gate": scalars.compose_mean(m, p, "threshold_gate", 0.5)}
    return rounded(c.groupBy(*AT).agg(*[F.avg(v).alias(k) for k, v in means.items()]))


@query(f"""with {X.preds_sql(T0)}, u as (select *, md5('bern:' || arm || ':' || target || ':' || m0 || ':' || unit) as e from preds),
z as (select arm, target, y, list_transform(range(16), lambda k: case when (cast('0x' || substr(e, 2 * k + 1, 2) as integer) + 0.5::double) / 256 < gate then samples[k + 1] else 0.0::double end) as samples from u)
select arm, target, {q6(f'avg({X.CRPS_SQL})')} as crps, {q6(f'avg({X.MEAN_SQL})')} as mean from z group by 1, 2""")
def compose_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Bernoulli for each draw, from the bytes of a keyed digest."""
    e = keyed.digest(F.lit("bern"), F.col("arm"), F.col("target"), F.col("m0"), F.col("unit"))
    u = F.transform(keyed.bytes_of(e), lambda b: (b + 0.5) / 256.0)
    s = scored(spark, sf_dir, T0).withColumn("samples", arrays.compose_samples(F.col("samples"), F.col("gate"), "soft_gate", u))
    return rounded(S.cell_scores(s).groupBy(*AT).agg(F.avg("crps").alias("crps"), F.avg("ey").alias("mean")))


_LEVELS = [0.1, 0.4, 0.7, 0.95]
_KNOTS_SQL = f"{X.GRID_SQL}, k as (select unit, 0.0::double as a, (unit % 3)::double as b, (unit % 5 + 3)::double as c, (unit % 7 + 8)::double as d, (unit % 10) / 10.0::double as p from grid)"
_CDF_SQL = "case when u <= 0.1 then a when u < 0.4 then a + (b - a) * ((u - 0.1) / 0.3) when u < 0.7 then b + (c - b) * ((u - 0.4) / 0.3) when u < 0.95 then c + (d - c) * ((u - 0.7) / 0.25) else d end"


def _knots(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("unit")
    return X.grid(spark, sf_dir).select("unit", F.array(F.lit(0.0), (u % 3).cast("double"), (u % 5 + 3).cast("double"), (u % 7 + 8).cast("double")).alias("knots"), (u % 10 / 10.0).alias("p"))


@query(f"with {_KNOTS_SQL}, g as (select unit, i, (i + 0.5::double) / 8 as u, a, b, c, d from k cross join (select cast(unnest(range(8)) as integer) as i)) select unit, i, {q6(_CDF_SQL)} as x from g")
def quantile_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_knots(spark, sf_dir).select("unit", F.posexplode(arrays.quantiles_to_samples(F.col("knots"), _LEVELS, 8)).alias("i", "x")))


@query(f"""with {_KNOTS_SQL}, g as (select unit, i, (i + 0.5::double) / 8 as v, greatest(p, 1e-6::double) as q, a, b, c, d from k cross join (select cast(unnest(range(8)) as integer) as i)),
w as (select *, (v - (1 - q)) / q as u from g) select unit, i, {q6(f'case when v <= 1 - q then 0.0 else {_CDF_SQL} end')} as x from w""")
def hurdle_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_knots(spark, sf_dir).select("unit", F.posexplode(arrays.hurdle_to_samples(F.col("knots"), _LEVELS, F.col("p"), 8)).alias("i", "x")))


_LOSS_SQL = {
    "mse": "(ey - y) ** 2",
    "mae": "abs(ey - y)",
    "huber": "case when abs(ey - y) <= 1 then (ey - y) ** 2 / 2 else abs(ey - y) - 0.5 end",
    "msle": "(ln(1 + ey) - ln(1 + y)) ** 2",
    "pinball": "greatest(0.9::double * (y - ey), -0.1::double * (y - ey))",
    "shrinkage": "(ey - y) ** 2 / (1 + exp(10 * (0.2::double - abs(ey - y))))",
    "lognormal": "(ln(1 + y) - ey) ** 2 / 2",
}


@query(f"with {cells_sql(T0)} select arm, target, {', '.join(f'{q6(f'avg({v})')} as {k}' for k, v in _LOSS_SQL.items())} from cells group by 1, 2")
def point_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cells(spark, sf_dir, T0).groupBy(*AT).agg(*[F.avg(LOSSES[k](F.col("ey"), F.col("y"))).alias(k) for k in _LOSS_SQL]))


@query(f"""with {cells_sql(T0)}, c as (select arm, target, case when y > 0 then 1.0::double else 0.0::double end as e, p, case when y > 0 then p else 1 - p end as pt from cells)
select arm, target, {q6('avg(-(e * ln(greatest(p, 1e-12)) + (1 - e) * ln(greatest(1 - p, 1e-12))))')} as bce, {q6('avg(-(case when e > 0 then 0.25 else 0.75 end) * (1 - pt) ** 2 * ln(greatest(pt, 1e-12)))')} as focal from c group by 1, 2""")
def event_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = (F.col("y") > 0).cast("double")
    return rounded(cells(spark, sf_dir, T0).groupBy(*AT).agg(F.avg(LOSSES["bce"](F.col("p"), e)).alias("bce"), F.avg(LOSSES["focal"](F.col("p"), e)).alias("focal")))


@query(f"""with {_PARAMS_SQL}, y as (select p.*, (p.unit % 4)::double as y from params p)
select {q6('avg(-(lgamma(y + theta) - lgamma(theta) - lgamma(y + 1) + theta * (ln(theta) - ln(theta + mu)) + y * (ln(mu) - ln(theta + mu))))')} as nll from y""")
def family_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(RO.family_nll(params(spark, sf_dir).withColumn("y", (F.col("unit") % 4).cast("double")), "nb"))


@query(f"""with recursive {X.LONG_SQL}, starts as (select target, avg(y) as x from long where y > 0 group by target),
run(target, step, x, top) as (select target, 0, x, abs(x) from starts union all select target, step + 1, least(1.1::double * x, 13.0::double), greatest(top, least(1.1::double * x, 13.0::double)) from run where step < 48)
select target, step, {q6('x')} as x, {q6('top')} as top from run""")
def attractor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free runs from every target's mean event."""
    starts = truth(spark, sf_dir).where("y > 0").groupBy("target").agg(F.avg("y").alias("x0"))
    return rounded(RO.free_runs(starts, "target", 48))


@query()
def rollout_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every origin and target: 24 months are digested, then 12 run freely in four passes."""
    panel, every = work.table(dense(spark, sf_dir), "panel"), origins(spark)
    rolled = [RO.roll_out_samples(panel, every, f"lr_{t}", steps=12, passes=4, history=24, seed=3 + i).select(F.lit(t).alias("target"), "*") for i, t in enumerate(X.TARGETS)]
    return reduce(DataFrame.unionByName, rolled)


FAMILIES = ("nb", "zinb", "mixture", "truncated")
_UNIFORM = lambda digits: f"(cast(('0x' || {digits}) as bigint) + 0.5::double) / 281474976710656.0::double"


@query(f"""with {_PARAMS_SQL},
named as (select p.*, family from params p, (values {', '.join(f"('{f}')" for f in FAMILIES)}) f(family)),
hexed as (select *, md5(concat_ws(':', 11, unit, j)) as x from (select *, unnest(range(0, 16)) as j from named)),
level as (select *, {_UNIFORM("x[1:12]")} as u, {_UNIFORM("x[13:24]")} as v from hexed),
chosen as (select unit, family, j, u, family = 'zinb' and v < pi as nought, case when family = 'mixture' and v >= w then mu2 else mu end as m, case when family = 'mixture' and v >= w then theta2 else theta end as t from level),
rated as (select *, t * ln(1 + m / t) as rate, -ln(1 + m / t) as rest from chosen),
likely as (select unit, family, j, n, u * case when family = 'truncated' then 1 - exp(-rate) else 1 end as goal, exp(n * ln(rate) - rate - lgamma(n + 1)) as p
  from (select *, unnest(range(case when family = 'truncated' then 1 else 0 end, cast(rate + 10 * sqrt(rate) + 60 as integer) + 1)) as n from rated)),
run as (select *, sum(p) over (partition by unit, family, j order by n) as c from likely),
number as (select unit, family, j, count(*) filter (where c < goal) + min(n) as jumps from run group by all),
jumped as (select r.*, md5(concat_ws(':', 11, r.unit, r.j, i)) as y from rated r join (select *, unnest(range(1, jumps + 1)) as i from number) n on n.unit = r.unit and n.family = r.family and n.j = r.j),
pairs as (select *, 1 - exp(rest * {_UNIFORM("y[1:12]")}) as h, {_UNIFORM("y[13:24]")} as k from jumped),
sized as (select unit, family, j, sum(case when k >= 1 - exp(rest) then 1 when k <= h * h then greatest(floor(1 + ln(k) / ln(h)), 1) when k >= h then 1 else 2 end) as y from pairs group by all)
select r.unit, r.family, list(case when nought then 0.0::double else coalesce(s.y, 0.0::double) end order by r.j) as samples
from rated r left join sized s on s.unit = r.unit and s.family = r.family and s.j = r.j group by r.unit, r.family""")
def nb_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen draws for each unit and family."""
    p = params(spark, sf_dir).withColumnRenamed("unit", "key")
    return reduce(DataFrame.unionByName, [RO.family_draws(p, f, 16, 11).select(F.col("key").alias("unit"), F.lit(f).alias("family"), "samples") for f in FAMILIES])


_KEMP = lambda x: f"(case when {_UNIFORM(f'{x}[13:24]')} >= 1 - exp(-grown) then 1 when {_UNIFORM(f'{x}[13:24]')} <= (1 - exp(-grown * {_UNIFORM(f'{x}[1:12]')})) ** 2 then greatest(floor(1 + ln({_UNIFORM(f'{x}[13:24]')}) / ln(1 - exp(-grown * {_UNIFORM(f'{x}[1:12]')}))), 1) when {_UNIFORM(f'{x}[13:24]')} >= 1 - exp(-grown * {_UNIFORM(f'{x}[1:12]')}) then 1 else 2 end)"
#: Family, composition and feedback of each run; the parameters follow from the mean.
_ROLLS = (("nb", "soft_gate", "sample"), ("zinb", "self_zeroed", "sample"), ("mixture", "threshold_gate", "sample"), ("truncated", "soft_gate", "mean"))


@query(f"""with recursive {X.DENSE_SQL}, o as (select cast(unnest(range({X.ORIGINS[0]}, {X.ORIGINS[1] + 1})) as integer) as m0),
past as (select o.m0, d.unit, sum(0.3::double * d.lr_sb * pow(0.7::double, o.m0 - 1 - d.month_id)) as state from o join dense d on d.month_id between o.m0 - 24 and o.m0 - 1 group by 1, 2),
run(family, composition, feedback, m0, unit, pass_no, h, state, mean, draw) as (
  select family, composition, feedback, m0, unit, pass_no, 0, state, 0.0::double, 0.0::double from past cross join (values {', '.join(str(r) for r in _ROLLS)}) f(family, composition, feedback) cross join (select unnest(range(2)) as pass_no)
  union all
  select family, composition, feedback, m0, unit, pass_no, h, 0.7::double * state + 0.3::double * least(case when feedback = 'mean' then mean else y end, 50.0), mean, y from (
    select *, case composition when 'soft_gate' then case when {_UNIFORM("md5(concat_ws(':', 21, m0, unit, pass_no, h, 'gate'))[1:12]")} < p then drawn else 0 end when 'threshold_gate' then case when p >= 0.3 then drawn else 0 end else drawn end as y from (
      select *, case when family = 'zinb' and v < 0.2 then 0.0::double when jumps = 0 then 0.0::double else list_sum(list_transform(range(1, jumps + 1), lambda i: {_KEMP("md5(concat_ws(':', 21, m0, unit, pass_no, h, i))")}))::double end as drawn from (
        select *, cast(first + len(list_filter(range(first, cast(rate + 10 * sqrt(rate) + 60 as integer) + 1), lambda n: list_sum(list_transform(range(first, n + 1), lambda j: exp(j * ln(rate) - rate - lgamma(j + 1)))) < u * case when first = 1 then 1 - exp(-rate) else 1 end)) as bigint) as jumps from (
          select *, t * grown as rate, case when family = 'truncated' then 1 else 0 end as first from (
            select *, ln(1 + greatest(m, 1e-6) / t) as grown from (
              select *, 1 - exp(-mean) as p, case when family = 'mixture' and v >= 0.7 then mean + 1 else mean end as m, case when family = 'mixture' and v >= 0.7 then 2.0::double else 0.8::double end as t from (
                select *, {_UNIFORM("x[1:12]")} as u, {_UNIFORM("x[13:24]")} as v from (
                  select family, composition, feedback, m0, unit, pass_no, h + 1 as h, state, exp(0.9 * ln(1 + state)) - 1 as mean, md5(concat_ws(':', 21, m0, unit, pass_no, h + 1)) as x from run where h < 6))))))))) 
select family, m0, unit, pass_no, h, {q6('mean')} as mean, draw from run where h > 0""")
def rollout_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free runs from every origin and cell, with each family, a composition with its gate, and what is fed back."""
    panel, every = work.table(dense(spark, sf_dir).select("month_id", "unit", "lr_sb"), "panel"), origins(spark)
    given = lambda mean: {"mu": mean, "theta": F.lit(0.8), "pi": F.lit(0.2), "mu2": mean + 1, "theta2": F.lit(2.0), "w": F.lit(0.7)}
    out = []
    for family, composition, feedback in _ROLLS:
        threshold = 0.3 if composition == "threshold_gate" else None
        rolled = RO.cell_roll_out(panel, every, "lr_sb", steps=6, passes=2, history=24, seed=21, family=family, parameters=given, gate=lambda mean: 1 - F.exp(-mean), composition=composition, threshold=threshold, feedback=feedback, cap=50.0)
        out.append(rolled.select(F.lit(family).alias("family"), "m0", "unit", "pass_no", "h", r6("mean").alias("mean"), "draw"))
    return reduce(DataFrame.unionByName, out)


@query(f"""with {cells_sql(T0)}, alone as (select arm, avg(crps) as c, row_number() over (order by avg(crps), arm) as r from cells group by arm),
together as (select avg(list_sum(list_transform(s, lambda x: abs(x - y))) / 32 - list_sum(list_transform(list_sort(s), lambda x, i: (2 * (i - 1) - 31) * x)) / 1024) as c from (select target, m0, h, unit, any_value(y) as y, flatten(list(samples)) as s from preds group by target, m0, h, unit))
select cast(r as integer) as place, arm from alone where r = 1 or (select c from together) < (select min(c) from alone)""")
def greedy_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arms that a pool keeps, in order, at the first horizon."""
    made = work.table(scored(spark, sf_dir, T0), "scored")
    alone = S.cell_scores(made).groupBy("arm").agg(F.avg("crps").alias("crps_all"))
    ranked = [r["arm"] for r in alone.orderBy("crps_all", "arm").collect()]
    return spark.createDataFrame(list(enumerate(S.greedy_members(made, ranked), 1)), "place int, arm string")

