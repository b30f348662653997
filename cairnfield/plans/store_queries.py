"""Queries that go through the sinks and scans: what they write to the work folder, they read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield import schema
from cairnfield.functions import arrays
from cairnfield.functions.registry import EMITS, STATICS
from cairnfield.operators import contracts as C
from cairnfield.operators import preflight as V
from cairnfield.operators import scores as S
from cairnfield.operators import settings as SE
from cairnfield.plans.audit_queries import AT, T0
from cairnfield.plans.base import FEATURES, cells_table, cells_sql, dense, q6, query, r6, rounded, store, truth
from cairnfield.plans.panel_queries import _PARAMS_SQL, params
from cairnfield.sources import fixtures as X
from cairnfield.sources import readers as R
from cairnfield.sources import sinks, work


def _raw(spark: SparkSession, sf_dir: str) -> str:
    """The dense panel as a raw file of a run type, under another name of its cell column."""
    path = R.run_path(work.folder(spark, "raw"), "calibration")
    dense(spark, sf_dir).withColumnRenamed("unit", "priogrid_gid").write.parquet(path)
    return path


@query(f"with {X.DENSE_SQL} select month_id, unit, lr_sb from dense where month_id <= 222")
def panel_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.panel(spark, _raw(spark, sf_dir), ["lr_sb"], through=222)


@query(f"with {X.DENSE_SQL} select month_id, unit, lr_sb, lr_ns, lr_os from dense")
def truth_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.truth(spark, _raw(spark, sf_dir), FEATURES)


@query(f"with {X.DENSE_SQL} select month_id, unit, lr_os from dense where month_id between {X.ORIGINS[0]} and {X.ORIGINS[1]}")
def truth_scan_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.truth(spark, _raw(spark, sf_dir), ["lr_os"], months=range(X.ORIGINS[0], X.ORIGINS[1] + 1))


@query(f"with {X.GRID_SQL} select unit, row - 87 as r, col - 310 as c from grid")
def grid_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.unit_grid(R.panel(spark, _raw(spark, sf_dir)), 87, 310)


def _emitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir, arms=("A",)).select(F.col("m0").alias("origin"), "target", "h", "month_id", "unit", "samples")


def _store(spark: SparkSession, sf_dir: str) -> str:
    path = work.folder(spark, "store")
    sinks.write_predictions(_emitted(spark, sf_dir), path)
    return path


_PREDS = X.preds_sql(arms=("A",))


@query(f"with {_PREDS} select m0 as origin, target, h, month_id, unit, {q6(X.MEAN_SQL)} as ey from preds where target = 'sb' and h = 6")
def store_scan_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One target and one horizon: only their folder is read."""
    return R.prediction_store(spark, _store(spark, sf_dir), "sb", [6]).select("origin", "target", "h", "month_id", "unit", r6(arrays.mean(F.col("samples"))).alias("ey"))


@query(f"with {_PREDS} select m0 as origin, m0, target, h, month_id, unit, {q6(X.MEAN_SQL)} as ey from preds")
def store_scan_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Horizons counted from the first month of each origin, not taken from the folders."""
    found = R.with_horizon(R.prediction_store(spark, _store(spark, sf_dir)).drop("h"))
    return found.select("origin", "m0", "target", "h", "month_id", "unit", r6(arrays.mean(F.col("samples"))).alias("ey"))


@query(f"with {_PREDS} select m0 as origin, target, month_id, unit, {q6(X.MEAN_SQL)} as ey from preds where h = 1")
def store_scan_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.with_horizon(R.prediction_store(spark, _store(spark, sf_dir)).drop("h")).where("h = 1")
    return found.select("origin", "target", "month_id", "unit", r6(arrays.mean(F.col("samples"))).alias("ey"))


@query(f"with {_PREDS} select m0 as origin, min(month_id) as first, max(month_id) as last, count(distinct month_id) as n from preds group by 1")
def store_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.emitted_months(R.prediction_store(spark, _store(spark, sf_dir)))


@query(f"with {_PREDS} select distinct cast(len(samples) as integer) as width from preds")
def store_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(F.lit(R.sample_width(R.prediction_store(spark, _store(spark, sf_dir)))).alias("width"))


@query(f"with {_PREDS} select m0 as origin, m0 - {X.ORIGINS[0]} as position, count(*) as n, cast(sum(list_sum(samples)) as double) as total from preds group by 1")
def origin_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each origin's rows handed on in order; the sink here keeps their sums and the position of its call."""
    path = work.folder(spark, "sink")
    calls: list[int] = []

    def keep(origin: int, rows: DataFrame) -> None:
        total = F.sum(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)).alias("total")
        rows.groupBy("origin").agg(F.lit(len(calls)).alias("position"), F.count("*").alias("n"), total).write.parquet(f"{path}/call={len(calls)}")
        calls.append(origin)

    sinks.each_origin(_emitted(spark, sf_dir), keep)
    return spark.read.parquet(path).drop("call")


_BOARD_SQL = f"{cells_sql(T0)}, b as (select arm, target, count(*) as n, {q6('avg(crps)')} as crps_all, {q6('max(ey)')} as ey_max from cells group by 1, 2)"


def _board(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = cells_table(spark, sf_dir, T0)
    tops = cells.groupBy(*AT).agg(F.max("ey").alias("ey_max"))
    return rounded(S.board(cells, AT).select(*AT, "n", "crps_all").join(tops, AT))


@query(f"with {_BOARD_SQL} select * from b")
def scoreboard_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of CSV files for each arm, scanned as one."""
    path = work.folder(spark, "boards")
    board = work.table(_board(spark, sf_dir), "board")
    for arm in X.ARMS:
        sinks.write_board(board.where(F.col("arm") == arm), f"{path}/score_{arm}")
    return R.scoreboards(spark, f"{path}/score_*", "arm string, target string, n long, crps_all double, ey_max double")


@query(f"with {_BOARD_SQL} select * from b")
def audit_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work.folder(spark, "audit")
    sinks.write_audit(_board(spark, sf_dir), path)
    return spark.read.schema("arm string, target string, n long, crps_all double, ey_max double").json(path)


@query(f"with {_BOARD_SQL} select arm, cast(sum(n) as bigint) as n, max(ey_max) as ey_max from b group by 1")
def sidecar_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON file for each arm."""
    path = work.folder(spark, "sidecars")
    arms = _board(spark, sf_dir).groupBy("arm").agg(F.sum("n").alias("n"), F.max("ey_max").alias("ey_max"))
    arms.select("arm", F.to_json(F.struct("n", "ey_max")).alias("value")).repartition("arm").write.partitionBy("arm").text(path)
    return R.sidecar(spark, path).select("arm", "n", "ey_max")


@query(f"""with {X.LONG_SQL}, t as (select target || ':' || cast(cast(sum(y) as bigint) as varchar) || chr(10) as body from long group by target)
select sha256(body) as sha256, cast(strlen(body) as bigint) as length from t""")
def artifact_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each target, hashed where it lies."""
    path = work.folder(spark, "artifacts")
    totals = X.truth_long(dense(spark, sf_dir)).groupBy("target").agg(F.sum("y").cast("long").alias("y"))
    totals.select("target", F.concat_ws(":", "target", "y").alias("value")).repartition("target").write.partitionBy("target").text(path)
    return R.artifacts(spark, f"{path}/*/*.txt").select("sha256", "length")


@query(f"""with {X.LONG_SQL}, t as (select target, target || ':' || cast(sum(y) as bigint) as body, count(distinct month_id) as steps from long group by 1)
select 'm_' || target as name, sha256(body) as sha256, strlen(body)::bigint as bytes, '{{"loss": "mse", "steps": ' || steps || '}}' as config from t""")
def artifact_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each target's artifact, its body being the target's total."""
    path = work.folder(spark, "manifest")
    for r in truth(spark, sf_dir).groupBy("target").agg(F.sum("y").cast("long").alias("total"), F.countDistinct("month_id").alias("steps")).collect():
        sinks.write_manifest(spark, path, f"m_{r['target']}", f"{r['target']}:{r['total']}".encode(), {"steps": r["steps"], "loss": "mse"}, ["steps"])
    return spark.read.parquet(path)


@query(f"with {X.DENSE_SQL} select month_id - 180 as lesson, count(*) as n, {q6('avg(lr_sb * lr_sb)')} as loss from dense group by 1")
def trajectory_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each lesson, appended in two parts."""
    path = work.folder(spark, "trajectory")
    lesson = (F.col("month_id") - 180).alias("lesson")
    records = work.table(dense(spark, sf_dir).groupBy(lesson).agg(F.count("*").alias("n"), r6(F.avg(F.col("lr_sb") * F.col("lr_sb"))).alias("loss")), "lessons")
    for part in ("lesson <= 40", "lesson > 40"):
        sinks.append_records(records.where(part), path)
    return R.scoreboards(spark, path, "lesson int, n long, loss double")


@query(f"""with {_PREDS}, k as (select unit, case when unit % 7 = 0 then 1 when unit % 5 = 0 then 2 else 16 end as width from preds)
select 'samples_few' as check_name, count(*) filter (where width < 2) as violations from k union all
select 'samples_ragged', count(distinct width) - 1 from k union all select 'samples_finite', count(*) filter (where width = 2) from k""")
def store_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store with vectors of one draw and vectors that are no numbers."""
    nan = F.array(F.lit(float("nan")), F.lit(float("nan")))
    broken = F.when(F.col("unit") % 7 == 0, F.slice("samples", 1, 1)).when(F.col("unit") % 5 == 0, nan).otherwise(F.col("samples"))
    return C.samples_contract(_emitted(spark, sf_dir).withColumn("samples", broken))


@query(f"with {_PREDS} select m0 as origin, min(month_id) <= 230 as leaks, min(len(samples)) < 2 as few from preds group by 1")
def store_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.provenance(_emitted(spark, sf_dir), 230)


@query(f"""with {X.DENSE_SQL}, n as (select count(*) as a, count(*) filter (where unit % 3 <> 0) as b from dense)
select arm from (select 'A' as arm, a as own, b as kept from n union all select 'B', b, b from n) where kept < 0.8 * own""")
def support_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arms that lose over a fifth of their keys to the common support."""
    keys = dense(spark, sf_dir).select("month_id", "unit")
    arms = {"A": keys, "B": keys.where("unit % 3 <> 0")}
    return spark.createDataFrame([(a,) for a in C.coverage(arms, arms["A"].join(arms["B"], ["month_id", "unit"]))], "arm string")


def _breaks(check: Callable[[], object]) -> bool:
    try:
        check()
    except C.ContractError:
        return True
    return False


@query(f"""with {X.DENSE_SQL}, p as (select max(month_id % 3 / 2.0::double) as top from dense), g as (select max(row) as r, max(col) as c from dense)
select 'columns' as check_name, false as broken union all select 'columns_lacking', true union all
select 'scaffold', (select min(month_id) from dense where month_id > 250) <> (select max(month_id) from dense where month_id <= 250) + 1 union all
select 'scaffold_gap', (select min(month_id) from dense where month_id > 251) <> (select max(month_id) from dense where month_id <= 250) + 1 union all
select 'grid', r >= 87 + 180 or c >= 310 + 180 from g union all select 'grid_small', r >= 87 + 2 or c >= 310 + 2 from g union all
select 'probability', top > 1 from p union all select 'probability_high', top + 0.5 > 1 from p union all
select 'output', false union all select 'output_suffix', true union all
select 'heads', false union all select 'heads_unlike', true union all select 'statics', false union all select 'statics_twice', true union all select 'dispersion_zero', true""")
def contract_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts that raise, each on a table that keeps it and on one that does not."""
    d = work.table(dense(spark, sf_dir), "dense")
    share = lambda up: d.select((F.col("month_id") % 3 / 2.0 + up).alias("p"))
    out = d.select("month_id", "unit", F.col("lr_sb").alias("pred_sb"))
    checks = {
        "columns": lambda: C.obligatory_columns(d, ["month_id", "unit"]),
        "columns_lacking": lambda: C.obligatory_columns(d, ["month_id", "level"]),
        "scaffold": lambda: C.forecast_alignment(d.where("month_id <= 250"), d.where("month_id > 250")),
        "scaffold_gap": lambda: C.forecast_alignment(d.where("month_id <= 250"), d.where("month_id > 251")),
        "grid": lambda: C.grid_bounds(d, 180, 180, 87, 310),
        "grid_small": lambda: C.grid_bounds(d, 2, 2, 87, 310),
        "probability": lambda: C.probability_range(share(0.0), "p"),
        "probability_high": lambda: C.probability_range(share(0.5), "p"),
        "output": lambda: C.output_schema(out, ["sb"]),
        "output_suffix": lambda: C.output_schema(out.withColumn("pred_sb_raw", F.lit(0.0)), ["sb"]),
        "heads": lambda: V.heads(X.TARGETS, ["by_sb", "by_ns", "by_os"]),
        "heads_unlike": lambda: V.heads(X.TARGETS, ["by_sb"]),
        "statics": lambda: V.static_sources(["row_coord", "c_id"], list(STATICS), d.columns),
        "statics_twice": lambda: V.static_sources(["row_coord"], list(STATICS), [*d.columns, "row_coord"]),
        "dispersion_zero": lambda: V.dispersions({"sb": 0.0}, ["sb"]),
    }
    return spark.createDataFrame([(name, _breaks(check)) for name, check in checks.items()], "check_name string, broken boolean")


@query(f"with {X.DENSE_SQL} select 'channels_lacking' as check_name, 1::bigint as violations union all select 'channels_beyond', 3::bigint union all select 'months_off', abs(count(distinct month_id) - 80) from dense")
def channel_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.channels(dense(spark, sf_dir), [*FEATURES, "elevation"], 80)


@query(f"""with {X.GRID_SQL}, n as (select c_id, ['mse', 'focal', 'other'][c_id % 3 + 1] as loss from grid group by c_id)
select 'run_' || c_id as run, list_filter([case when c_id % 3 = 1 and c_id % 2 <> 0 then 'alpha' end, case when c_id % 3 = 1 and c_id % 4 = 0 then 'gamma' end, case when c_id % 5 = 0 then 'seed' end, case when c_id % 7 = 3 then 'steps' end], lambda x: x is not null) as missing,
  list_filter([case when c_id % 7 <> 3 and c_id % 4 = 1 then 'steps' end], lambda x: x is not null) as unset, loss = 'other' as unknown_loss from n""")
def genome_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of a run for each nation: whole ones, some that lack keys, some set to null, some with an unknown loss."""
    c = F.col("c_id")
    setting = lambda key, value, there: F.when(there, F.struct(F.lit(key).alias("key"), value.cast("string").alias("value")))
    loss = F.element_at(F.array(*map(F.lit, ("mse", "focal", "other"))), (c % 3 + 1).cast("int"))
    rows = [setting("seed", c, c % 5 != 0), setting("steps", F.when(c % 4 != 1, F.col("k")), c % 7 != 3), setting("loss_reg", loss, F.lit(True)), setting("alpha", c, c % 2 == 0), setting("gamma", c, c % 4 != 0)]
    nations = X.grid(spark, sf_dir).groupBy("c_id").agg(F.count("*").alias("k"))
    records = nations.select(F.concat(F.lit("run_"), c).alias("run"), F.explode(F.filter(F.array(*rows), lambda s: s.isNotNull())).alias("s")).select("run", "s.key", "s.value")
    return V.genome(records, ["seed", "steps", "loss_reg"], {"mse": (), "focal": ("alpha", "gamma")})


@query(f"with {_PREDS} select target, count(*) as n, count(*) filter (where unit % 4 = 1) as unlike from preds group by 1")
def shape_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors against copies that lack a draw in every fourth cell."""
    rows = _emitted(spark, sf_dir).withColumn("other", F.when(F.col("unit") % 4 == 1, F.slice("samples", 1, 15)).otherwise(F.col("samples")))
    return V.unlike_widths(rows, "samples", "other", ["target"])


@query(f"""with {X.LONG_SQL} select target, {q6('greatest(avg(y) ** 2 / greatest(var_pop(y) - avg(y), 0.001::double), 0.001::double)')} as theta from long group by 1""")
def target_dispersions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dispersions by moments of each target's truth, checked and put in the targets' order."""
    mean, spread = F.avg("y"), F.var_pop("y")
    theta = F.greatest(mean * mean / F.greatest(spread - mean, F.lit(0.001)), F.lit(0.001))
    given = {r["target"]: r["theta"] for r in truth(spark, sf_dir).groupBy("target").agg(theta.alias("theta")).collect()}
    return rounded(spark.createDataFrame(list(V.dispersions(given, X.TARGETS).items()), "target string, theta double"))


@query(f"with {X.DENSE_SQL} select month_id, unit, {q6('lr_sb')} as count from dense")
def target_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense(spark, sf_dir).select("month_id", "unit", r6(V.to_counts(F.log1p("lr_sb"))).alias("count"))


_ROLES = {"month_id": "identity", "unit": "identity", "row": "identity", "col": "identity", "c_id": "static", **{f: "feature" for f in FEATURES}}


@query(f"""with {X.DENSE_SQL}, f as (select count(*) filter (where c_id <> 0) as a, count(*) filter (where lr_sb <> 0) as b, count(*) filter (where lr_ns <> 0) as c, count(*) filter (where lr_os <> 0) as d from dense)
select unnest([0, 1, 2, 3]) as position, unnest(['c_id', 'lr_sb', 'lr_ns', 'lr_os']) as channel, unnest(['static', 'feature', 'feature', 'feature']) as role, unnest([a, b, c, d]) as filled from f""")
def model_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions and roles of the channels that are left without identities, and how many cells of each are filled."""
    kept = schema.without_identities(schema.with_roles(dense(spark, sf_dir).select(*_ROLES), _ROLES))
    named = spark.createDataFrame(schema.roles(kept), "position int, channel string, role string")
    counts = kept.agg(*[F.count(F.when(F.col(c) != 0, 1)).alias(c) for c in kept.columns])
    filled = counts.select(F.explode(F.create_map(*[x for c in kept.columns for x in (F.lit(c), F.col(c))])).alias("channel", "filled"))
    return named.join(filled, "channel")


@query(f"""with {X.DENSE_SQL}, m as (select count(*) filter (where unit % 4 = 0) as k from dense)
select column_name, case when column_name = 'lr_os' then k else 0 end as mismatches, 0::bigint as only_a, 0::bigint as only_b
from m cross join (select unnest(['row', 'col', 'c_id', 'lr_sb', 'lr_ns', 'lr_os']) as column_name)""")
def stripped_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An output with predictions, other types and one moved column, stripped and compared with its input."""
    d = dense(spark, sf_dir)
    moved = d.withColumn("lr_os", F.when(F.col("unit") % 4 == 0, F.col("lr_os") + 1).otherwise(F.col("lr_os")))
    out = moved.withColumn("unit", F.col("unit").cast("int")).withColumn("pred_sb", F.lit(0.0)).withColumn("by_sb", F.lit(1.0))
    return C.parity(V.without_predictions(out, d), d, ["month_id", "unit"])


@query(f"""with {_PARAMS_SQL}, r as (select unit, (mu - 1)::double as x, (unit % 5) / 5.0::double as p from params)
select unit, 'standard' as head, {q6('x')} as emitted from r union all select unit, 'dense_nb', {q6('ln(1 + greatest(x, 0))')} from r union all
select unit, 'quantile', {q6('least(greatest(x, 0), 13)')} from r union all select unit, 'hurdle_shrinkage', {q6('ln(1 + p * greatest(exp(least(x, 30)) - 1, 0))')} from r union all
select unit, 'hurdle_lognormal', {q6('ln(1 + p * exp(least(x + 0.5, 30)))')} from r union all
select unit, 'hurdle_nb', {q6('ln(1 + p * exp(x) / (1 - 1 / (1 + exp(x))))')} from r""")
def emit_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every head emits from the same channel."""
    rows = params(spark, sf_dir).select("unit", (F.col("mu") - 1).alias("x"), (F.col("unit") % 5 / 5.0).alias("p"))
    emitted = F.explode(F.array(*[F.struct(F.lit(name).alias("head"), r6(emit(F.col("x"), F.col("p"))).alias("emitted")) for name, emit in EMITS.items()])).alias("e")
    return rows.select("unit", emitted).select("unit", "e.*")


#: A value that keeps each kind's rule, whatever its bounds.
_FITTING = {"int": "3", "number": "0.5", "flag": "true", "list": "[1, 2, 3]", "map": "{}", "text": "a"}
_RULES = SE.rules()
_RULES_SQL = "rules(i, field, kind, required, low, low_open, high, high_open, choices, counts, when_field, when_value) as (values " + ", ".join(
    f"({i}, '{r.field}', '{r.kind}', {r.required}, {'null' if r.low is None else r.low}::double, {r.low_open}, {'null' if r.high is None else r.high}::double, {r.high_open}, {'null' if r.choices is None else list(r.choices)}::varchar[], "
    + ", ".join("null" if x is None else f"'{x}'" for x in (r.counts, r.when_field, r.when_value)) + ")"
    for i, r in enumerate(_RULES)
) + ")"


@query(f"""with {X.GRID_SQL}, {_RULES_SQL}, nations as (select c_id, count(*) as k from grid group by 1),
made as (select 'run_' || c_id as run, field as key, case when (c_id * 3 + i) % 13 = 0 then null when (c_id + i * 2) % 17 = 3 then cast(k - 6 as varchar) when (c_id * 5 + i) % 19 = 7 then '1.0' when i % 31 = 30 and c_id % 3 = 0 then 'tobit'
  when choices is not null then choices[1 + c_id % len(choices)] when kind = 'int' then '3' when kind = 'number' then '0.5' when kind = 'flag' then 'true' when kind = 'list' then '[1, 2, 3]' when kind = 'map' then '{{}}' else 'a' end as value
  from nations cross join rules where (c_id + i) % 11 <> 0 union all select 'run_' || c_id, 'surplus_' || k, 'x' from nations where c_id % 4 = 0),
runs as (select distinct run from made),
p as (select r.run, u.*, v.value, o.value as other, w.value as cause from runs r cross join rules u left join made v on v.run = r.run and v.key = u.field left join made o on o.run = r.run and o.key = u.counts left join made w on w.run = r.run and w.key = u.when_field),
n as (select *, try_cast(value as double) as x from p)
select run, field, 'missing' as violation from n where value is null and (required or coalesce(cause = when_value, false)) union all
select run, field, 'kind' from n where value is not null and not case kind when 'int' then regexp_matches(value, '^-?[0-9]+$') when 'number' then x is not null when 'flag' then value in ('true', 'false') when 'list' then value like '[%]' when 'map' then value like '{{%}}' else true end union all
select run, field, 'range' from n where coalesce(x < low or (low_open and x = low), false) or coalesce(x > high or (high_open and x = high), false) union all
select run, field, 'choice' from n where value is not null and choices is not null and not list_contains(choices, value) union all
select run, field, 'count' from n where x is not null and other is not null and coalesce(case when other like '[%]' then json_array_length(other) end, -1) <> x union all
select run, key, 'unknown' from made where key not in (select field from rules)""")
def config_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole contract over a run for each nation, whose settings lack keys, are null, out of range or of another kind here and there."""
    nations = X.grid(spark, sf_dir).groupBy("c_id").agg(F.count("*").alias("k"))
    table = SE.rule_table(spark, _RULES).join(spark.createDataFrame([(r.field, i) for i, r in enumerate(_RULES)], "field string, i long"), "field")
    c, i = F.col("c_id"), F.col("i")
    fitting = F.coalesce(F.get("choices", (c % F.size("choices")).cast("int")), F.try_element_at(F.create_map(*[F.lit(x) for pair in _FITTING.items() for x in pair]), F.col("kind")))
    value = (
        F.when((c * 3 + i) % 13 == 0, F.lit(None)).when((c + i * 2) % 17 == 3, (F.col("k") - 6).cast("string")).when((c * 5 + i) % 19 == 7, "1.0").when((i % 31 == 30) & (c % 3 == 0), "tobit").otherwise(fitting)
    )
    made = nations.crossJoin(F.broadcast(table)).where((c + i) % 11 != 0).select(F.concat(F.lit("run_"), c).alias("run"), F.col("field").alias("key"), value.alias("value"))
    surplus = nations.where(c % 4 == 0).select(F.concat(F.lit("run_"), c), F.concat(F.lit("surplus_"), "k"), F.lit("x"))
    return SE.violations(made.union(surplus), _RULES)


@query(f"with {X.SPARSE_SQL} select month_id, unit, row_number() over (order by month_id, unit) - 1 as position from sparse")
def panel_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel as a file in order of (month, unit): every row's place, from its file and its place there."""
    path = work.folder(spark, "ordered")
    sinks.write_ordered(X.sparse_panel(spark, sf_dir), path, ["month_id", "unit"])
    return R.file_order(spark, path).select("month_id", "unit", "position")
