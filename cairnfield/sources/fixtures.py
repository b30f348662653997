"""Panels and prediction stores made from the driver's tables, each with the SQL that defines it.

``lineitem`` is read as a sparse monthly panel of suppliers: three counts of large lines, by flag and status. Predictions are
integer draws from the bytes of an md5 of their key, so any engine makes the same ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.functions import keyed

#: Months of the dense panel, a fixed run window as a forecast run has one. ``lineitem`` goes on into month 263, which is partial (968
#: of the 600,000 rows of sf0.1); those rows are in the sparse panel and not in the dense one, in query and SQL alike.
MONTHS = (181, 262)
ORIGINS = (227, 239)
HORIZONS = (1, 6, 12)
ARMS = ("A", "B")
TARGETS = ("sb", "ns", "os")
SAMPLES = 16


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sparse_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(month_id, unit, lr_sb, lr_ns, lr_os) where a supplier has any line."""
    month = ((F.year("l_shipdate") - 1980) * 12 + F.month("l_shipdate")).cast("int")
    large = lambda cond: F.count(F.when(cond, 1)).cast("double")
    q = F.col("l_quantity")
    return (
        _table(spark, sf_dir, "lineitem")
        .groupBy(month.alias("month_id"), (F.col("l_suppkey") + 1).cast("long").alias("unit"))
        .agg(
            large((F.col("l_returnflag") == "A") & (q >= 48)).alias("lr_sb"),
            large((F.col("l_returnflag") == "R") & (q >= 50)).alias("lr_ns"),
            large((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O") & (q >= 50)).alias("lr_os"),
        )
    )


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit, row, col, c_id): suppliers on the smallest square grid, row by row, with their nation."""
    supplier = _table(spark, sf_dir, "supplier")
    side = supplier.agg(F.ceil(F.sqrt(F.count("*"))).cast("long").alias("side"))
    unit = (F.col("s_suppkey") + 1).cast("long")
    placed = supplier.select(unit.alias("unit"), F.col("s_nationkey").cast("long").alias("c_id")).crossJoin(F.broadcast(side))
    return placed.select("unit", (F.expr("(unit - 1) div side") + 87).cast("int").alias("row"), ((F.col("unit") - 1) % F.col("side") + 310).cast("int").alias("col"), "c_id")


GRID_SQL = """grid as (
  select cast(s_suppkey + 1 as bigint) as unit, cast(s_suppkey // side + 87 as integer) as row, cast(s_suppkey % side + 310 as integer) as col,
         cast(s_nationkey as bigint) as c_id
  from supplier cross join (select cast(ceil(sqrt(count(*))) as bigint) as side from supplier))"""

SPARSE_SQL = """sparse as (
  select cast((year(l_shipdate) - 1980) * 12 + month(l_shipdate) as integer) as month_id, cast(l_suppkey + 1 as bigint) as unit,
         cast(count(*) filter (where l_returnflag = 'A' and l_quantity >= 48) as double) as lr_sb,
         cast(count(*) filter (where l_returnflag = 'R' and l_quantity >= 50) as double) as lr_ns,
         cast(count(*) filter (where l_returnflag = 'N' and l_linestatus = 'O' and l_quantity >= 50) as double) as lr_os
  from lineitem group by 1, 2)"""

DENSE_SQL = f"""{GRID_SQL}, {SPARSE_SQL},
months as (select cast(unnest(range({MONTHS[0]}, {MONTHS[1] + 1})) as integer) as month_id),
dense as (
  select m.month_id, g.unit, g.row, g.col, g.c_id, coalesce(s.lr_sb, 0.0::double) as lr_sb, coalesce(s.lr_ns, 0.0::double) as lr_ns, coalesce(s.lr_os, 0.0::double) as lr_os
  from grid g cross join months m left join sparse s on s.month_id = m.month_id and s.unit = g.unit)"""

LONG_SQL = f"""{DENSE_SQL},
long as (
  select month_id, unit, 'sb' as target, lr_sb as y from dense union all
  select month_id, unit, 'ns', lr_ns from dense union all
  select month_id, unit, 'os', lr_os from dense)"""


def truth_long(dense: DataFrame) -> DataFrame:
    """(month_id, unit, target, y) from the dense panel."""
    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"lr_{t}").alias("y")) for t in TARGETS])).alias("p")
    return dense.select("month_id", "unit", pairs).select("month_id", "unit", "p.target", "p.y")


def predictions(spark: SparkSession, support: DataFrame, horizons: tuple[int, ...] = HORIZONS, arms: tuple[str, ...] = ARMS) -> DataFrame:
    """The prediction store over ``support`` (m0, unit, target, active): (arm, target, m0, h, month_id, unit, samples, gate)."""
    keys = support.select("m0", "unit", "target", "active", F.explode(F.array(*map(F.lit, arms))).alias("arm")).select("*", F.explode(F.array(*map(F.lit, horizons))).alias("h"))
    hexed = keys.withColumn("d", keyed.digest(F.col("arm"), F.col("m0"), F.col("h"), F.col("unit"), F.col("target")))
    quiet = lambda b: F.greatest(F.lit(0), b % 16 - 13)
    busy = lambda b: b % 4
    flat = lambda b: F.greatest(F.lit(0), b % 8 - 4)
    draw = lambda b: F.when(F.col("arm") == "B", flat(b)).when(F.col("active"), busy(b)).otherwise(quiet(b)).cast("double")
    samples = F.transform(keyed.bytes_of(F.col("d")), draw)
    gate = (F.conv(F.substring("d", 1, 6), 16, 10).cast("long") % 1000) / 1000.0
    return hexed.select("arm", "target", F.col("m0").cast("int").alias("m0"), F.col("h").cast("int").alias("h"), (F.col("m0") + F.col("h") - 1).cast("int").alias("month_id"), "unit", samples.alias("samples"), gate.alias("gate"))


def preds_sql(horizons: tuple[int, ...] = HORIZONS, arms: tuple[str, ...] = ARMS) -> str:
    """CTEs up to ``preds``: the prediction store joined with the truth y of its month."""
    return f"""{LONG_SQL},
origins as (select cast(unnest(range({ORIGINS[0]}, {ORIGINS[1] + 1})) as integer) as m0),
support as (
  select o.m0, l.unit, l.target, max(l.y) > 0 as active
  from origins o join long l on l.month_id between o.m0 - 12 and o.m0 - 1 group by 1, 2, 3),
keyed as (
  select s.*, a.arm, h.h, md5(a.arm || ':' || s.m0 || ':' || h.h || ':' || s.unit || ':' || s.target) as d
  from support s cross join (select unnest({list(arms)}) as arm) a cross join (select cast(unnest({list(horizons)}) as integer) as h) h),
drawn as (
  select *, list_transform(range(16), lambda k: cast('0x' || substr(d, 2 * k + 1, 2) as integer)) as b from keyed),
preds as (
  select k.arm, k.target, k.m0, k.h, cast(k.m0 + k.h - 1 as integer) as month_id, k.unit, l.y,
         list_transform(k.b, lambda x: cast(case when k.arm = 'B' then greatest(0, x % 8 - 4) when k.active then x % 4 else greatest(0, x % 16 - 13) end as double)) as samples,
         (cast('0x' || substr(k.d, 1, 6) as bigint) % 1000) / 1000.0::double as gate
  from drawn k join long l on l.month_id = k.m0 + k.h - 1 and l.unit = k.unit and l.target = k.target)"""


CRPS_SQL = """(list_sum(list_transform(samples, lambda x: abs(x - y))) / 16 - list_sum(list_transform(list_sort(samples), lambda x, i: (2 * (i - 1) - 15) * x)) / 256)"""
MEAN_SQL = "(list_sum(samples) / 16)"
