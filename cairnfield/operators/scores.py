"""Scores of probabilistic forecasts: boards, ranking metrics, calibration, tails, maps, parity.

A scored table has (arm, target, m0, h, month_id, unit, samples, y) and often gate. Cell scores are native expressions over
the sample vector; boards are one aggregation over them. Medians and quantiles are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnfield.functions import arrays
from cairnfield.functions.scalars import logit, sigmoid
from cairnfield.operators import order
from cairnfield.operators.panel import neighbourhood_sum
from cairnfield.sources.work import checked, large, table

TAIL_EDGES = (1.0, 3.0, 10.0, 30.0, 100.0, 300.0, 1e6)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b != 0, a / b)


def cell_scores(scored: DataFrame, gate: str | None = None) -> DataFrame:
    """Adds ey (mean draw), p (the gate, else the share of positive draws), crps; drops the samples."""
    s = F.col("samples")
    p = F.coalesce(F.col(gate), arrays.share_positive(s)) if gate else arrays.share_positive(s)
    return scored.select(*[c for c in scored.columns if c not in ("samples", "p")], arrays.mean(s).alias("ey"), p.alias("p"), arrays.crps(s, F.col("y")).alias("crps"))


def board(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """N, n_event, crps_all/events/none, brier, size_ratio (median of ey / y), pos_mcr (its mean), mcr_all, mcr_none."""
    event = F.col("y") > 0
    r = F.when(event, F.col("ey") / F.col("y"))
    sums = cells.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count(F.when(event, 1)).alias("n_event"),
        F.avg("crps").alias("crps_all"),
        F.avg(F.when(event, F.col("crps"))).alias("crps_events"),
        F.avg(F.when(~event, F.col("crps"))).alias("crps_none"),
        F.avg(F.pow(F.col("p") - event.cast("double"), 2)).alias("brier"),
        F.avg(r).alias("pos_mcr"),
        ratio(F.sum("ey"), F.sum("y")).alias("mcr_all"),
        F.avg(F.when(~event, F.col("ey"))).alias("mcr_none"),
    )
    return order.with_quantiles(sums, cells, by, {"size_ratio": (r, 0.5)})


def base_rate_skill(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Brier against that of the base rate, rho (1 - rho)."""
    event = (F.col("y") > 0).cast("double")
    b = cells.groupBy(*by).agg(F.avg(F.pow(F.col("p") - event, 2)).alias("brier"), F.avg(event).alias("rho"))
    return b.withColumn("brier_base", F.col("rho") * (1 - F.col("rho"))).withColumn("skill", F.when(F.col("brier_base") > 0, 1 - F.col("brier") / F.col("brier_base")))


def _by_score(cells: DataFrame, by: Sequence[str], score: str, event: Column) -> DataFrame:
    """Positives and totals of each distinct score: ties fall together before anything is cumulated."""
    return cells.groupBy(*by, F.col(score).alias("s")).agg(F.sum(event.cast("long")).alias("pos"), F.count("*").alias("n"))


def precision_of(ties: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, ap) from counts by score (by, s, pos, n)."""
    run = order.before(ties, by, "s", ["pos", "n"], falling=True)
    reached = (F.col("pos_before") + F.col("pos")) / (F.col("n_before") + F.col("n"))
    sums = run.groupBy(*by).agg(F.sum(F.col("pos") * reached).alias("s"), F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    return sums.select(*by, F.when((F.col("pos") > 0) & (F.col("pos") < F.col("n")), F.col("s") / F.col("pos")).alias("ap"))


def auc_of(ties: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, auc) from counts by score (by, s, pos, n)."""
    run = order.before(ties.withColumn("neg", F.col("n") - F.col("pos")), by, "s", ["neg"])
    sums = run.groupBy(*by).agg(F.sum(F.col("pos") * (2 * F.col("neg_before") + F.col("neg"))).alias("u2"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return sums.select(*by, F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("u2") / (2 * F.col("pos") * F.col("neg"))).alias("auc"))


def average_precision(cells: DataFrame, by: Sequence[str], score: str = "p", event: Column | None = None) -> DataFrame:
    """(by, ap): sum of recall steps times precision over falling scores; null unless both classes occur."""
    return precision_of(_by_score(cells, by, score, F.col("y") > 0 if event is None else event), by)


def roc_auc(cells: DataFrame, by: Sequence[str], score: str = "p", event: Column | None = None) -> DataFrame:
    """(by, auc): the Mann-Whitney share with ties counting half; null unless both classes occur."""
    return auc_of(_by_score(cells, by, score, F.col("y") > 0 if event is None else event), by)


def spearman_positive(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, n, rho): rank correlation of y and ey on events; 0 for a constant side, null below two rows."""
    pairs = table(cells.where("y > 0").groupBy(*by, "y", "ey").agg(F.count("*").alias("c")), "pairs")
    ranked = pairs
    for column, name in (("y", "ry"), ("ey", "re")):
        placed = order.before(pairs.groupBy(*by, column).agg(F.sum("c").alias("n")), by, column, ["n"])
        ranked = ranked.join(large(placed.select(*by, column, (F.col("n_before") + (F.col("n") + 1) / 2.0).alias(name))), [*by, column])
    x, y = F.col("ry"), F.col("re")
    c = F.col("c")
    s = ranked.groupBy(*by).agg(F.sum(c).alias("n"), F.sum(c * x).alias("sx"), F.sum(c * y).alias("sy"), F.sum(c * x * x).alias("sxx"), F.sum(c * y * y).alias("syy"), F.sum(c * x * y).alias("sxy"))
    vx, vy = F.col("n") * F.col("sxx") - F.col("sx") ** 2, F.col("n") * F.col("syy") - F.col("sy") ** 2
    rho = F.when(F.col("n") < 2, F.lit(None)).when((vx <= 0) | (vy <= 0), 0.0).otherwise((F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(F.when((vx > 0) & (vy > 0), vx * vy).otherwise(1.0)))
    return s.select(*by, "n", rho.alias("rho"))


def pearson(df: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """(by, r): 1 for identical columns, 0 where one is constant."""
    x, y = F.col(a), F.col(b)
    s = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"), F.max((x != y).cast("int")).alias("differ"))
    vx, vy = F.col("n") * F.col("sxx") - F.col("sx") ** 2, F.col("n") * F.col("syy") - F.col("sy") ** 2
    return s.select(*by, F.when(F.col("differ") == 0, 1.0).when((vx <= 0) | (vy <= 0), 0.0).otherwise((F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(F.when((vx > 0) & (vy > 0), vx * vy).otherwise(1.0))).alias("r"))


def reliability(cells: DataFrame, by: Sequence[str], bins: int = 10) -> DataFrame:
    """(by, bin, n, p_mean, freq): equal-width bins on [0, 1], the last closed, by the same edges as a linspace."""
    edges = [i * (1.0 / bins) for i in range(1, bins)]
    index = sum((F.col("p") >= e).cast("int") for e in edges)
    return cells.withColumn("bin", index).groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("p").alias("p_mean"), F.avg((F.col("y") > 0).cast("double")).alias("freq"))


def expected_calibration_error(table: DataFrame, by: Sequence[str]) -> DataFrame:
    return table.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("p_mean") - F.col("freq"))) / F.sum("n")).alias("ece"))


def within_two(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, n, ratio_med, within2, rescaled): share of events with ey / y in [1/2, 2], as is and after division by the median ratio."""
    r = cells.where("y > 0").withColumn("r", F.col("ey") / F.greatest(F.col("y"), F.lit(1e-9)))
    med = checked(order.quantiles(r, by, {"ratio_med": (F.col("r"), 0.5)}), "medians")
    inside = lambda x: F.avg(x.between(0.5, 2.0).cast("double"))
    joined = r.join(med, list(by))
    scaled = F.col("r") / F.when(F.col("ratio_med") > 0, F.col("ratio_med")).otherwise(1.0)
    return joined.groupBy(*by, "ratio_med").agg(F.count("*").alias("n"), inside(F.col("r")).alias("within2"), inside(scaled).alias("rescaled"))


def ratio_distribution(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, p10, p25, p50, p75, p90) of ey / y on events."""
    levels = (0.1, 0.25, 0.5, 0.75, 0.9)
    return order.quantiles(cells.where("y > 0"), by, {f"p{round(100 * v)}": (F.col("ey") / F.col("y"), v) for v in levels})


def tail_scorecard(scored: DataFrame, by: Sequence[str], edges: Sequence[float] = TAIL_EDGES) -> DataFrame:
    """(by, bin, n, y_med, ey_med, reach, cover90, pin90) over bins of the truth; reach: the largest draw is at least y."""
    s, y = F.col("samples"), F.col("y")
    index = sum((y >= e).cast("int") for e in edges) - 1
    one = scored.where(y >= edges[0]).select(*by, index.alias("bin"), "y", arrays.mean(s).alias("ey"), arrays.quantile(s, 0.9).alias("q90"), F.array_max(s).alias("top"))
    u = F.col("y") - F.col("q90")
    sums = one.groupBy(*by, "bin").agg(
        F.count("*").alias("n"),
        F.avg((F.col("top") >= F.col("y")).cast("double")).alias("reach"),
        F.avg((F.col("y") <= F.col("q90")).cast("double")).alias("cover90"),
        F.avg(F.greatest(0.9 * u, -0.1 * u)).alias("pin90"),
    )
    return order.with_quantiles(sums, one, [*by, "bin"], {"y_med": (F.col("y"), 0.5), "ey_med": (F.col("ey"), 0.5)})


def bulk_cut(train: DataFrame, q: float, column: str = "y") -> DataFrame:
    """(target, cut): the q-quantile of the positive training truth."""
    return order.quantiles(train.where(F.col(column) > 0), ["target"], {"cut": (F.col(column), q)})


def bulk_calibration(scored: DataFrame, cuts: DataFrame, by: Sequence[str], tau: float = 0.99) -> DataFrame:
    """(by, bulk_n, tail_n, ratio_med, within2, pin_tail): events up to the cut are the bulk, those above the tail."""
    s, y = F.col("samples"), F.col("y")
    one = scored.where(y > 0).join(checked(cuts, "cuts"), "target").select(*by, "y", "cut", arrays.mean(s).alias("ey"), arrays.quantile(s, tau).alias("q"))
    bulk = F.col("y") <= F.col("cut")
    r = F.when(bulk, F.col("ey") / F.col("y"))
    u = F.col("y") - F.col("q")
    sums = one.groupBy(*by).agg(
        F.count(F.when(bulk, 1)).alias("bulk_n"),
        F.count(F.when(~bulk, 1)).alias("tail_n"),
        F.avg(F.when(bulk, r.between(0.5, 2.0).cast("double"))).alias("within2"),
        F.avg(F.when(~bulk, F.greatest(tau * u, (tau - 1) * u))).alias("pin_tail"),
    )
    return order.with_quantiles(sums, one, by, {"ratio_med": (r, 0.5)})


def zero_mass(cells: DataFrame, by: Sequence[str], tail: float = 100.0) -> DataFrame:
    """(by, zero_mass, tail_miss): forecast mass on cells without events, and mean truth over mean forecast in the tail."""
    none, big = F.col("y") <= 0, F.col("y") >= tail
    return cells.groupBy(*by).agg(
        ratio(F.sum(F.when(none, F.col("ey")).otherwise(0.0)), F.sum("ey")).alias("zero_mass"),
        ratio(F.avg(F.when(big, F.col("y"))), F.avg(F.when(big, F.col("ey")))).alias("tail_miss"),
    )


def range_compression(cells: DataFrame, by: Sequence[str], small: tuple[float, float] = (1.0, 10.0), big: float = 100.0, floor: float = 1e-3) -> DataFrame:
    """(by, truth_range, pred_range): median of large events over median of small ones, in truth and forecast."""
    is_small, is_big = F.col("y").between(*small), F.col("y") >= big
    med = lambda cond, c: (F.when(cond, F.col(c)), 0.5)
    groups = cells.groupBy(*by).agg(F.count("*").alias("n"))
    q = order.with_quantiles(groups, cells, by, {"ys": med(is_small, "y"), "yb": med(is_big, "y"), "es": med(is_small, "ey"), "eb": med(is_big, "ey")})
    over = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(floor))
    return q.select(*by, over("yb", "ys").alias("truth_range"), over("eb", "es").alias("pred_range"))


def trajectory(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, mean, p99, top) of the cells' mean draws."""
    sums = cells.groupBy(*by).agg(F.avg("ey").alias("mean"), F.max("ey").alias("top"))
    return order.with_quantiles(sums, cells, by, {"p99": (F.col("ey"), 0.99)})


def fractions_skill(fields: DataFrame, grid: DataFrame, keys: Sequence[str], scales: Sequence[int], level: float = 0.5) -> DataFrame:
    """(keys, scale, fss): 1 - MSE of the event fractions over their largest possible MSE; null where nothing happens.

    Predicted events are cells with ey above ``level``; borders count as no event.
    """
    cells = fields.join(large(grid.select("unit", "row", "col")), "unit").select(*keys, "row", "col", (F.col("ey") > level).cast("double").alias("f"), (F.col("y") > 0).cast("double").alias("o"))
    out = None
    for n in scales:
        # Counts in the box instead of shares: whole numbers, so that sums are exact in any order; the ratio is the same.
        bf, bo = F.round(F.col("bf") * (n * n)), F.round(F.col("bo") * (n * n))
        one = neighbourhood_sum(cells, {"bf": F.col("f"), "bo": F.col("o")}, n, keys).groupBy(*keys).agg(F.sum((bf - bo) ** 2).alias("num"), F.sum(bf**2 + bo**2).alias("den")).select(*keys, F.lit(n).alias("scale"), F.when(F.col("den") > 0, 1 - F.col("num") / F.col("den")).alias("fss"))
        out = one if out is None else out.unionByName(one)
    return out


def matched_threshold(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, level): the k-th largest forecast, k the number of true events; null without events."""
    ties = cells.groupBy(*by, "ey").agg(F.count("*").alias("n"))
    events = cells.groupBy(*by).agg(F.count(F.when(F.col("y") > 0, 1)).alias("events"))
    placed = order.before(ties, by, "ey", ["n"], falling=True).join(events, list(by))
    here = (F.col("n_before") < F.col("events")) & (F.col("events") <= F.col("n_before") + F.col("n"))
    return placed.groupBy(*by).agg(F.max(F.when(here, F.col("ey"))).alias("level"))


def area_concentration(cells: DataFrame, by: Sequence[str], level: float = 0.5) -> DataFrame:
    """(by, area_ratio, top_share): cells forecast above the level over cells with events (at least 1), and the share of the forecast's mass in its top hundredth of positive cells."""
    sums = cells.groupBy(*by).agg(
        (F.count(F.when(F.col("ey") > level, 1)) / F.greatest(F.count(F.when(F.col("y") > 0, 1)), F.lit(1))).alias("area_ratio"),
        F.greatest(F.lit(1), F.floor(F.count(F.when(F.col("ey") > 0, 1)) / 100)).alias("most"),
        F.sum("ey").alias("mass"),
    )
    ties = order.before(cells.groupBy(*by, "ey").agg(F.count("*").alias("n")), by, "ey", ["n"], falling=True)
    taken = F.greatest(F.lit(0), F.least(F.col("n"), F.col("most") - F.col("n_before")))
    top = ties.join(sums, list(by)).groupBy(*by, "area_ratio", "mass").agg(F.sum(taken * F.col("ey")).alias("top"))
    return top.select(*by, "area_ratio", ratio(F.col("top"), F.col("mass")).alias("top_share"))


def pit_flatness(pits: DataFrame, by: Sequence[str], bins: int = 10) -> DataFrame:
    """(by, n, flatness): mean distance of the bins' shares from 1 / bins; empty bins count."""
    index = F.least(F.floor(F.col("pit") * bins), F.lit(bins - 1)).cast("int")
    counts = pits.groupBy(*by).agg(F.count("*").alias("n"), *[F.count(F.when(index == b, 1)).alias(f"b{b}") for b in range(bins)])
    gap = sum(F.abs(F.col(f"b{b}") / F.col("n") - 1 / bins) for b in range(bins)) / bins
    return counts.select(*by, "n", gap.alias("flatness"))


def hurdle_attribution(cells: DataFrame, by: Sequence[str], gate: str = "gate", floor: float = 1e-4) -> DataFrame:
    """(by, leak, by_gate, by_body, gate_share, dominant): what would remove forecast mass from cells without events.

    By the gate: pi set to the base rate; by the body: the conditional mean set to that of the events.
    """
    event = F.col("y") > 0
    rates = cells.groupBy(*by).agg(F.avg(event.cast("double")).alias("rho"), F.avg(F.when(event, F.col("y"))).alias("m_pos"))
    pi = F.col(gate)
    body = F.col("ey") / F.greatest(pi, F.lit(floor))
    none = cells.where(~event).join(checked(rates, "rates"), list(by))
    one = none.groupBy(*by).agg(
        F.avg(pi * body).alias("leak"),
        F.avg(pi * body - F.least(pi, F.col("rho")) * body).alias("by_gate"),
        F.avg(pi * body - pi * F.least(body, F.coalesce("m_pos", F.lit(0.0)))).alias("by_body"),
    )
    share = ratio(F.col("by_gate"), F.col("by_gate") + F.col("by_body"))
    return one.withColumn("gate_share", share).withColumn("dominant", F.when(F.col("by_gate") >= F.col("by_body"), "gate").otherwise("body"))


def underfire_attribution(cells: DataFrame, by: Sequence[str], gate: str = "gate", floor: float = 1e-4) -> DataFrame:
    """(by, shortfall, by_gate, by_body) on events: what a sure gate, or the true size, would recover."""
    pi = F.col(gate)
    body = F.col("ey") / F.greatest(pi, F.lit(floor))
    return cells.where("y > 0").groupBy(*by).agg(F.avg(F.greatest(F.col("y") - pi * body, F.lit(0.0))).alias("shortfall"), F.avg(body - pi * body).alias("by_gate"), F.avg(pi * F.greatest(F.col("y") - body, F.lit(0.0))).alias("by_body"))


def decay_split(cells: DataFrame, recency: DataFrame, windows: Sequence[int] = (3, 12)) -> DataFrame:
    """(arm, target, k, recent, n, leak, share): forecast mass on cells without events, split by activity in the last k months.

    ``recency`` has (m0, unit, target, since): months from the last event to the origin.
    """
    none = cells.where("y <= 0").join(large(recency), ["m0", "unit", "target"], "left")
    split = none.select("arm", "target", "ey", "since", F.explode(F.array(*[F.lit(k) for k in windows])).alias("k")).withColumn("recent", F.coalesce(F.col("since") <= F.col("k"), F.lit(False)))
    one = split.groupBy("arm", "target", "k", "recent").agg(F.count("*").alias("n"), F.sum("ey").alias("mass"))
    whole = F.sum("mass").over(W.partitionBy("arm", "target", "k"))
    return one.select("arm", "target", "k", "recent", "n", (F.col("mass") / F.col("n")).alias("leak"), ratio(F.col("mass"), whole).alias("share"))


def gate_sweep(cells: DataFrame, by: Sequence[str], temperatures: Sequence[float], gate: str = "gate", eps: float = 1e-6, floor: float = 1e-4) -> DataFrame:
    """(by, temperature, mcr, leak, pos): the forecast with its gate sharpened to sigmoid(T logit(p))."""
    p = F.least(F.greatest(F.col(gate), F.lit(eps)), F.lit(1 - eps))
    body = F.col("ey") / F.greatest(F.col(gate), F.lit(floor))
    warm = cells.select(*by, "y", p.alias("p"), body.alias("body"), F.explode(F.array(*[F.lit(float(t)) for t in temperatures])).alias("temperature"))
    m = warm.withColumn("m", sigmoid(F.col("temperature") * logit(F.col("p"))) * F.col("body"))
    return m.groupBy(*by, "temperature").agg(ratio(F.sum("m"), F.sum("y")).alias("mcr"), F.avg(F.when(F.col("y") <= 0, F.col("m"))).alias("leak"), F.avg(F.when(F.col("y") > 0, F.col("m"))).alias("pos"))


def evaluation_schemas(cells: DataFrame, value: str = "crps") -> DataFrame:
    """(arm, target, by_origin, by_step, by_month, n, score): one pass over the three groupings, as grouping sets."""
    kinds = {"m0": "by_origin", "h": "by_step", "month_id": "by_month"}
    named = cells.select("arm", "target", *[F.col(c).alias(k) for c, k in kinds.items()], F.col(value).alias("_value"))
    return named.groupingSets([["arm", "target", k] for k in kinds.values()], "arm", "target", *kinds.values()).agg(F.count("*").alias("n"), F.avg("_value").alias("score"))


def ensemble(store: DataFrame) -> DataFrame:
    """(target, m0, h, month_id, unit, samples): all arms' draws in one vector, in order of the arm."""
    return store.groupBy("target", "m0", "h", "month_id", "unit").agg(arrays.pool(F.struct("arm", "samples")).alias("samples"))


def greedy_members(scored: DataFrame, ranked: Sequence[str]) -> list[str]:
    """Members in order: the first of ``ranked`` (best alone first), then each that improves the mean CRPS of the pool.

    A round scores the pool with each arm that is left, all in one job, and takes the first that improves it; those before it did
    not. The pool is kept as a table, so jobs grow with the members taken, not with the arms. ``scored`` has (arm, target, m0, h, month_id, unit,
    samples, y), the draws sorted or not; cells that an arm lacks do not count for it.
    """
    key = ["target", "m0", "h", "month_id", "unit"]
    rest = list(ranked)
    if not rest:
        return []
    chosen = [rest.pop(0)]
    pool = scored.where(F.col("arm") == chosen[0]).select(*key, "y", F.array_sort("samples").alias("pooled"))
    best = pool.agg(F.avg(arrays.crps(F.col("pooled"), F.col("y")))).first()[0]
    while rest:
        joined = pool.join(scored.where(F.col("arm").isin(rest)).select(*key, "arm", "samples"), key)
        merged = joined.withColumn("pooled", F.array_sort(F.concat("pooled", "samples")))
        means = {r["arm"]: r["m"] for r in merged.groupBy("arm").agg(F.avg(arrays.crps(F.col("pooled"), F.col("y"))).alias("m")).collect()}
        better = next((a for a in rest if a in means and means[a] < best), None)
        if better is None:
            break
        chosen.append(better)
        best = means[better]
        rest = rest[rest.index(better) + 1 :]
        if rest:
            pool = table(merged.where(F.col("arm") == better).select(*key, "y", "pooled"), "pool")
    return chosen


def activation(scored: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """(by, fired, true_rate, hits, precision_at_k, false_size): shares of cells that fire and that have events; of the k largest forecasts (ties by unit) those with events, and the mean forecast on the others."""
    cells = scored.select(*by, "unit", "y", arrays.mean(F.col("samples")).alias("ey"), F.exists("samples", lambda x: x > 0).alias("fires"))
    sums = cells.groupBy(*by).agg(F.avg(F.col("fires").cast("double")).alias("fired"), F.avg((F.col("y") > 0).cast("double")).alias("true_rate"))
    # Spark keeps no more than k rows of a partition before they meet.
    top = cells.withColumn("k", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("ey"), "unit"))).where(F.col("k") <= k)
    hit = F.col("y") > 0
    best = top.groupBy(*by).agg(F.count(F.when(hit, 1)).alias("hits"), F.avg(hit.cast("double")).alias("precision_at_k"), F.avg(F.when(~hit, F.col("ey"))).alias("false_size"))
    return sums.join(best, list(by))


def parity_scorecard(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, only_a, only_b, shared, exact_pct, mismatches, max_a, max_b, drift_pct, r) of two panels on (month_id, unit)."""
    left = a.select("month_id", "unit", F.lit(1).alias("_a"), *[F.col(c).alias(f"a_{c}") for c in columns])
    right = b.select("month_id", "unit", F.lit(1).alias("_b"), *[F.col(c).alias(f"b_{c}") for c in columns])
    both = left.join(large(right), ["month_id", "unit"], "full")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"a_{c}").alias("x"), F.col(f"b_{c}").alias("y")) for c in columns])).alias("p")
    long = both.select("_a", "_b", pairs).select("_a", "_b", "p.*")
    shared = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    x, y = F.when(shared, F.col("x")), F.when(shared, F.col("y"))
    s = long.groupBy("column_name").agg(
        F.count(F.when(F.col("_b").isNull(), 1)).alias("only_a"),
        F.count(F.when(F.col("_a").isNull(), 1)).alias("only_b"),
        F.count(F.when(shared, 1)).alias("shared"),
        F.count(F.when(shared & (F.col("x") != F.col("y")), 1)).alias("mismatches"),
        F.max("x").alias("max_a"),
        F.max("y").alias("max_b"),
        F.sum(x).alias("sx"),
        F.sum(y).alias("sy"),
        F.sum(x * x).alias("sxx"),
        F.sum(y * y).alias("syy"),
        F.sum(x * y).alias("sxy"),
    )
    n = F.col("shared")
    vx, vy = n * F.col("sxx") - F.col("sx") ** 2, n * F.col("syy") - F.col("sy") ** 2
    r = F.when(F.col("mismatches") == 0, 1.0).when((vx <= 0) | (vy <= 0), 0.0).otherwise((n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(F.when((vx > 0) & (vy > 0), vx * vy).otherwise(1.0)))
    return s.select("column_name", "only_a", "only_b", "shared", "mismatches", ratio(100.0 * (n - F.col("mismatches")), n).alias("exact_pct"), "max_a", "max_b", ratio(100.0 * F.abs(F.col("sy") - F.col("sx")), F.col("sx")).alias("drift_pct"), r.alias("r"))


def metric_history(records: DataFrame) -> DataFrame:
    """(key, lesson, mse, mae, msle, rmsle, bias, running_bias, carried): losses of (key, lesson, y, yh), by lesson.

    Bias is the ratio of sums, 1 where the truth sums to 0; the running one sums over lessons so far. A lesson without
    records carries the last mse forward, 0 if there was none.
    """
    d = F.col("yh") - F.col("y")
    ld = F.log1p("yh") - F.log1p("y")
    per = records.groupBy("key", "lesson").agg(F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"), F.avg(ld * ld).alias("msle"), F.sum("yh").alias("sh"), F.sum("y").alias("sy"))
    lessons = records.agg(F.min("lesson").alias("a"), F.max("lesson").alias("b")).select(F.explode(F.sequence("a", "b")).alias("lesson"))
    every = records.select("key").distinct().crossJoin(F.broadcast(lessons)).join(per, ["key", "lesson"], "left")
    so_far = W.partitionBy("key").orderBy("lesson")
    bias = lambda a, b: F.when(b == 0, 1.0).otherwise(a / F.when(b == 0, 1.0).otherwise(b))
    return every.select(
        "key",
        "lesson",
        "mse",
        "mae",
        "msle",
        F.sqrt("msle").alias("rmsle"),
        F.when(F.col("mse").isNotNull(), bias(F.col("sh"), F.col("sy"))).alias("bias"),
        bias(F.coalesce(F.sum("sh").over(so_far), F.lit(0.0)), F.coalesce(F.sum("sy").over(so_far), F.lit(0.0))).alias("running_bias"),
        F.coalesce(F.last("mse", ignorenulls=True).over(so_far), F.lit(0.0)).alias("carried"),
    )


def horizon_pivot(scores: DataFrame, horizons: Sequence[int], value: str = "crps_all") -> DataFrame:
    """One row for each (arm, target), a column for each horizon."""
    return scores.groupBy("arm", "target").pivot("h", list(horizons)).agg(F.first(value))
