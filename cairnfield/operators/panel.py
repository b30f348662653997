"""Panel operators: standardise, derive, scale, densify, static channels, dilation, activity, anchors, scaffold."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnfield.functions import keyed
from cairnfield.functions.registry import ANCHORS, STATICS, TRANSFORMS, lookup
from cairnfield.functions.scalars import above, is_real
from cairnfield.operators.contracts import ContractError, obligatory_columns
from cairnfield.sources.work import large


def land_only(df: DataFrame) -> DataFrame:
    """Rows of real cells: the unit is a number above zero."""
    return df.where(is_real(F.col("unit").cast("double")) & (F.col("unit") > 0))


def derive_binary(df: DataFrame, derivations: Mapping[str, tuple[str, float]]) -> DataFrame:
    """New columns dst = 1.0 where src > threshold, else 0.0; {dst: (src, threshold)}."""
    obligatory_columns(df, [src for src, _ in derivations.values()])
    return df.withColumns({dst: F.when(above(F.col(src), thr), 1.0).otherwise(0.0) for dst, (src, thr) in derivations.items()})


def standardize(df: DataFrame, targets: Sequence[str], threshold: float = 0.0) -> DataFrame:
    """Land rows with a by_ column for each lr_ target. Row order carries no meaning, so nothing is sorted."""
    return derive_binary(land_only(df), {f"by_{t}": (f"lr_{t}", threshold) for t in targets})


def scale(df: DataFrame, transforms: Mapping[str, str]) -> DataFrame:
    """Columns by their named forward transform. log1p at or below -1 is an error, not a null."""
    obligatory_columns(df, list(transforms))
    out = {}
    for c, name in transforms.items():
        forward = lookup(TRANSFORMS, name)[0](F.col(c))
        out[c] = F.when(F.col(c) <= -1, F.raise_error(F.lit(f"log1p of {c} at or below -1"))).otherwise(forward) if name == "log1p" else forward
    return df.withColumns(out)


def unscale(df: DataFrame, transforms: Mapping[str, str]) -> DataFrame:
    """Columns by their inverse transform; columns that are absent are passed over."""
    return df.withColumns({c: lookup(TRANSFORMS, name)[1](F.col(c)) for c, name in transforms.items() if c in df.columns})


def unscale_samples(df: DataFrame, transforms: Mapping[str, str], column: str = "samples") -> DataFrame:
    """Sample vectors by the inverse transform of their row's target; gates (by_) stay."""
    out = F.col(column)
    for c, name in transforms.items():
        out = F.when(F.col("target") == c.removeprefix("lr_"), F.transform(column, lookup(TRANSFORMS, name)[1])).otherwise(out)
    return df.withColumn(column, out)


def densify(facts: DataFrame, grid: DataFrame, first: int, last: int, features: Sequence[str]) -> DataFrame:
    """Every cell in every month from first to last, zero where no fact is.

    The months are a sequence exploded beside each cell, so there is no join but the one with the facts. Cells are dealt
    out first: a grid is one file split, and one task would make all of its months.
    """
    spread = grid.repartition(int(grid.sparkSession.conf.get("spark.sql.shuffle.partitions")), "unit")
    scaffold = spread.select("*", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("month_id"))
    joined = scaffold.join(large(facts.select("month_id", "unit", *features)), ["month_id", "unit"], "left")
    return joined.select("month_id", *grid.columns, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in features])


def static_channels(grid: DataFrame, names: Sequence[str], height: int, width: int, row_offset: int, col_offset: int) -> DataFrame:
    """The grid with registered static channels over its full height and width."""
    out = {}
    for name in names:
        along_rows = name.startswith("row")
        at = F.col("row") - row_offset if along_rows else F.col("col") - col_offset
        out[name] = lookup(STATICS, name)(at, F.lit(height if along_rows else width))
    return grid.withColumns(out)


def attach_static(panel: DataFrame, grid: DataFrame, names: Sequence[str]) -> DataFrame:
    """Every cell's static values repeated over its months; the grid has one row for each cell."""
    return panel.join(large(grid.select("unit", *names)), "unit")


def activity(dense: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(unit, activity of each column): months in which it is not zero."""
    return dense.groupBy("unit").agg(*[F.count(F.when(F.col(c) != 0, 1)).alias(c) for c in columns])


def activity_maxima(dense: DataFrame, columns: Sequence[str], threshold: int) -> DataFrame:
    """(target, max_activity, active_units, qualified): over units, for each column."""
    per_unit = activity(dense, columns)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("target"), F.col(c).alias("a")) for c in columns])).alias("p")
    return per_unit.select(pairs).groupBy(F.col("p.target").alias("target")).agg(F.max("p.a").alias("max_activity"), F.count(F.when(F.col("p.a") > 0, 1)).alias("active_units"), F.count(F.when(F.col("p.a") >= threshold, 1)).alias("qualified"))


def lesson_plan(maxima: DataFrame, steps: int, low: float, high: float, slope: float, roof: float) -> DataFrame:
    """(step, target, ratio, threshold): subjects in turn; the threshold cools with the step, at least 1."""
    from cairnfield.functions.scalars import cooling

    spark = maxima.sparkSession
    ordered = maxima.select("target", "max_activity").withColumn("slot", F.row_number().over(W.orderBy("target")) - 1).withColumn("n", F.count("*").over(W.partitionBy()))
    plan = spark.range(steps).withColumnRenamed("id", "step")
    ratio = cooling(F.col("step"), steps, low, high, slope, roof)
    joined = plan.join(F.broadcast(ordered), F.col("slot") == F.col("step") % F.col("n"))
    return joined.select("step", "target", ratio.alias("ratio"), F.greatest(F.lit(1), F.floor(ratio * F.col("max_activity"))).cast("long").alias("threshold"))


def supervision(dense: DataFrame, column: str, onset_lead: int, cessation_lag: int, threshold: float = 0.0) -> DataFrame:
    """(month_id, unit, active, supervised, ever, decay): dilation of activity by the lag behind and the lead ahead."""
    active = above(F.col(column), threshold).cast("int")
    by_time = W.partitionBy("unit").orderBy("month_id")
    near = F.max(active).over(by_time.rangeBetween(-cessation_lag, onset_lead))
    ever = F.max(active).over(W.partitionBy("unit"))
    return dense.select("month_id", "unit", active.alias("active"), near.alias("supervised"), ever.alias("ever"), F.when((ever == 1) & (active == 0), 1).otherwise(0).alias("decay"))


def future_scaffold(dense: DataFrame, steps: int) -> DataFrame:
    """The last month repeated for the next ``steps`` months, everything but the time cloned."""
    last = dense.agg(F.max("month_id").alias("last"))
    final = dense.join(F.broadcast(last), F.col("month_id") == F.col("last"))
    ahead = final.select("*", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("k"))
    return ahead.withColumn("month_id", (F.col("month_id") + F.col("k")).cast("int")).drop("last", "k")


def anchor_weights(act: DataFrame, column: str, strategy: str, min_events: int, **params: float) -> DataFrame:
    """(unit, activity, p): the chance of each cell as a window's anchor; with no weight at all every cell is alike."""
    if strategy == "boltzmann":
        top = act.agg(F.max(column).alias("top"))
        act = act.crossJoin(F.broadcast(top))
        params["top"] = F.col("top")
    weighted = act.select("unit", F.col(column).alias("activity"), lookup(ANCHORS, strategy)(F.col(column), F.lit(min_events), **params).alias("w"))
    sums = weighted.agg(F.sum("w").alias("total"), F.count("*").alias("n"))
    return weighted.crossJoin(F.broadcast(sums)).select("unit", "activity", F.when(F.col("total") > 0, F.col("w") / F.col("total")).otherwise(1 / F.col("n")).alias("p"))


#: Cells that share the offset of a running count.
BLOCK = 10_000


def pick_cells(cells: DataFrame, chances: DataFrame, by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys, unit): one cell for each draw.

    ``cells`` has (by, unit, activity); ``chances`` has (by, keys, u, activity, n, w): for each draw the levels of activity, how many cells
    each has and the weight of one of them (no weight at all: every cell alike). The level of activity is found where u falls
    among the levels' running sums, the place in the level by what is left of u, and the cell at that place by running
    counts of blocks of cells. No cell is copied for a draw, and only cells of the blocks that are hit are numbered.
    """
    of_draw = W.partitionBy(*keys)
    known = chances.withColumn("w", F.when(F.sum(F.col("n") * F.col("w")).over(of_draw) > 0, F.col("w")).otherwise(1.0)).where("w > 0")
    earlier = of_draw.orderBy("activity").rowsBetween(W.unboundedPreceding, -1)
    mass = F.col("n") * F.col("w")
    placed = known.select(*by, *keys, "activity", "n", "w", F.coalesce(F.sum(mass).over(earlier), F.lit(0.0)).alias("low"), (F.col("u") * F.sum(mass).over(of_draw)).alias("at"))
    level = F.max_by(F.struct("activity", "n", "w", "low", "at"), "activity").alias("v")
    found = placed.where("low <= at").groupBy(*by, *keys).agg(level).select(*by, *keys, "v.*")
    place = F.least(F.col("n") - 1, F.floor((F.col("at") - F.col("low")) / F.col("w")))
    found = found.select(*by, *keys, "activity", place.alias("place"))
    spot = [*by, "activity", "_block"]
    dealt = cells.select(*by, "unit", "activity", F.floor(F.col("unit") / BLOCK).alias("_block"))
    counts = dealt.groupBy(*spot).agg(F.count("*").alias("_n"))
    start = F.coalesce(F.sum("_n").over(W.partitionBy(*by, "activity").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = counts.select(*spot, "_n", start.alias("_start"))
    hit = found.join(blocks, [*by, "activity"]).where((F.col("place") >= F.col("_start")) & (F.col("place") < F.col("_start") + F.col("_n")))
    hit = hit.select(*spot, *keys, (F.col("place") - F.col("_start") + 1).alias("_k"))
    inside = dealt.join(hit.select(*spot).distinct(), spot, "left_semi").withColumn("_k", F.row_number().over(W.partitionBy(*spot).orderBy("unit")))
    return hit.join(inside, [*spot, "_k"]).select(*keys, "unit")


def draw_anchors(weights: DataFrame, draws: int, seed: int) -> DataFrame:
    """(draw, unit): cells drawn by their chance, which is a function of their activity; uniforms are keyed by seed and draw."""
    levels = weights.groupBy("activity").agg(F.count("*").alias("n"), F.max("p").alias("w"))
    wanted = levels.select("*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    return pick_cells(weights.select("unit", "activity"), wanted.withColumn("u", keyed.uniform(F.lit(seed), F.col("draw"))), [], ["draw"])


def lesson_anchors(cells: DataFrame, plan: DataFrame, strategy: str, min_events: int, draws: int, seed: int, **params: float) -> DataFrame:
    """(step, draw, unit): anchors of every lesson, ``draws`` each, from the cells (target, unit, activity) of the lesson's target.

    The threshold strategy takes the lesson's threshold, the others ``min_events``.
    """
    levels = cells.groupBy("target", "activity").agg(F.count("*").alias("n")).withColumn("top", F.max("activity").over(W.partitionBy("target")))
    least = F.col("threshold") if strategy == "threshold" else F.lit(min_events)
    if strategy == "boltzmann":
        params["top"] = F.col("top")
    wanted = plan.select("step", "target", "threshold", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    chances = wanted.join(levels, "target").withColumn("w", lookup(ANCHORS, strategy)(F.col("activity"), least, **params)).withColumn("u", keyed.uniform(F.lit(seed), F.col("step"), F.col("draw")))
    return pick_cells(cells, chances, ["target"], ["step", "draw"])


def windows(grid: DataFrame, anchors: DataFrame, dim: int, height: int, width: int, row_offset: int, col_offset: int, seed: int, keys: Sequence[str] = ("draw",)) -> DataFrame:
    """(keys, r0, c0): window corners, the anchor less a keyed jitter below dim, clipped to the grid."""
    if dim > height or dim > width:
        raise ContractError("the window is larger than the grid")
    at = anchors.join(grid.select("unit", "row", "col"), "unit")
    jitter = lambda axis: keyed.integer(F.lit(seed), F.lit(axis), *[F.col(k) for k in keys]) % dim
    clip = lambda x, size: F.greatest(F.lit(0), F.least(x, F.lit(size - dim)))
    return at.select(*keys, clip(F.col("row") - row_offset - jitter("r"), height).alias("r0"), clip(F.col("col") - col_offset - jitter("c"), width).alias("c0"))


def cut_windows(panel: DataFrame, corners: DataFrame, dim: int, row_offset: int, col_offset: int, seed: int | None = None, keys: Sequence[str] = ("draw",)) -> DataFrame:
    """The panel inside each window, as an equi-join: every corner lists its rows and columns. With a seed, axes flip at random."""
    cells = corners.select(*keys, "r0", "c0", F.explode(F.sequence(F.lit(0), F.lit(dim - 1))).alias("dr")).select("*", F.explode(F.sequence(F.lit(0), F.lit(dim - 1))).alias("dc"))
    places = cells.select(*keys, "dr", "dc", (F.col("r0") + F.col("dr") + row_offset).cast("int").alias("row"), (F.col("c0") + F.col("dc") + col_offset).cast("int").alias("col"))
    out = panel.join(places, ["row", "col"])
    if seed is None:
        return out
    coin = lambda axis: keyed.uniform(F.lit(seed), F.lit(axis), *[F.col(k) for k in keys]) < 0.5
    return out.withColumns({"dr": F.when(coin("flip-r"), dim - 1 - F.col("dr")).otherwise(F.col("dr")), "dc": F.when(coin("flip-c"), dim - 1 - F.col("dc")).otherwise(F.col("dc"))})


def flip(df: DataFrame, column: str, size: int, offset: int = 0) -> DataFrame:
    """An axis read from its other end."""
    return df.withColumn(column, offset + size - 1 - (F.col(column) - offset))


def ingestion_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """(rows_in, rows_out, dropped, first, last) of a standardised panel."""
    a = before.agg(F.count("*").alias("rows_in"))
    b = after.agg(F.count("*").alias("rows_out"), F.min("month_id").alias("first"), F.max("month_id").alias("last"))
    return a.crossJoin(b).withColumn("dropped", F.col("rows_in") - F.col("rows_out"))


def column_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, mean, sd, low, high): over finite values, population sd."""
    finite = {c: F.when(is_real(F.col(c).cast("double")), F.col(c)) for c in columns}
    one = df.agg(*[f(finite[c]).alias(f"{c}|{n}") for c in columns for n, f in (("mean", F.avg), ("sd", F.stddev_pop), ("low", F.min), ("high", F.max))])
    pick = lambda c, n: F.col(f"`{c}|{n}`").alias(n)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), *[pick(c, n) for n in ("mean", "sd", "low", "high")]) for c in columns])).alias("p")
    return one.select(pairs).select("p.*")


def neighbourhood_sum(cells: DataFrame, values: Mapping[str, Column], n: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, row, col, one column for each of ``values``): means over the n x n box around each cell, zero beyond the border.

    A box is a sum over rows of sums over columns: each cell is sent to n rows, the sums to n columns, so it costs 2 n rows and
    not n x n; all values go together. Places without a cell carry sums between the two steps.
    """
    half = n // 2
    shifts = F.sequence(F.lit(-half), F.lit(n - 1 - half))
    sums = [F.sum(v).alias(v) for v in values]
    rows = cells.select(*keys, "row", "col", *[v.alias(name) for name, v in values.items()], F.explode(shifts).alias("d"))
    tall = rows.groupBy(*keys, (F.col("row") + F.col("d")).alias("row"), "col").agg(*sums)
    wide = tall.select("*", F.explode(shifts).alias("d")).groupBy(*keys, "row", (F.col("col") + F.col("d")).alias("col")).agg(*sums)
    return cells.select(*keys, "row", "col").join(large(wide.select(*keys, "row", "col", *[(F.col(v) / (n * n)).alias(v) for v in values])), [*keys, "row", "col"])
