"""Queries that run a stream over a table to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.operators import origins as O
from cairnfield.operators import scores as S
from cairnfield.plans.base import cells_sql, origins, query, rounded, truth
from cairnfield.sources import fixtures as X
from cairnfield.sources import work
from cairnfield.streaming import evaluation as E
from cairnfield.streaming import metrics as M


@query("""select cast((year(l_shipdate) - 1980) * 12 + month(l_shipdate) as integer) as lesson, l_returnflag as key, count(*) as n, sum(cast((l_quantity - 25) * (l_quantity - 25) as double)) as se,
  sum(cast(abs(l_quantity - 25) as double)) as ae, sum(25.0::double) as sh, sum(cast(l_quantity as double)) as sy from lineitem where l_shipdate is not null group by 1, 2""")
def stream_metric_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lessons of a constant forecast, summed as the rows stream in; every batch replaces its groups' sums."""
    root = f"{work.work_dir(spark)}/streams/{uuid.uuid4().hex}"
    path = f"{sf_dir}/lineitem.parquet"
    schema = spark.read.parquet(path).schema
    lines = spark.readStream.schema(schema).parquet(f"{sf_dir}/lineitem.parque[t]")
    month = ((F.year("l_shipdate") - 1980) * 12 + F.month("l_shipdate")).cast("int")
    records = lines.where("l_shipdate is not null").select(F.col("l_returnflag").alias("key"), month.alias("lesson"), F.col("l_quantity").cast("double").alias("y"), F.lit(25.0).alias("yh"))

    def keep(rows: DataFrame, number: int) -> None:
        rows.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/number={number}")

    M.run_each_batch(M.metric_sums(records), keep, f"{root}/checkpoint")
    done = spark.read.parquet(f"{root}/out")
    latest = done.groupBy("key", "lesson").agg(*[F.max_by(c, "batch").alias(c) for c in ("n", "se", "ae", "sh", "sy")])
    return latest


@query("""select time_bucket(interval '1 day', ts) as start, event_type, count(*) as n from events where ts is not null group by 1, 2""")
def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events counted by day and type as they stream in; a window's later counts replace its earlier ones. Times are UTC, as the session is."""
    root = f"{work.work_dir(spark)}/streams/{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").where("ts is not null").withColumn("ts", F.col("ts").cast("timestamp"))

    def keep(rows: DataFrame, number: int) -> None:
        rows.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/number={number}")

    M.run_each_batch(M.windowed_counts(events, "ts", "event_type", "1 day", "1 day", "2 days"), keep, f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out").groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""with records as (select l_linestatus as key, cast(year(l_shipdate) as integer) as lesson, cast(l_extendedprice as double) as s, l_returnflag = 'R' as e from lineitem where l_shipdate is not null),
ties as (select key, lesson, s, count(*) filter (where e) as pos, count(*) as n from records group by 1, 2, 3),
run as (select *, sum(pos) over w as tp, sum(n) over w as k, coalesce(sum(n - pos) over (partition by key, lesson order by s rows between unbounded preceding and 1 preceding), 0) as below from ties window w as (partition by key, lesson order by s desc))
select key, lesson, round(case when sum(pos) > 0 and sum(pos) < sum(n) then sum(pos * tp / k) / sum(pos) end, 6) as ap,
  round(case when sum(pos) > 0 and sum(pos) < sum(n) then sum(pos * (2 * below + n - pos)) / (2 * sum(pos) * sum(n - pos)) end, 6) as auc from run group by 1, 2""")
def stream_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision and AUC from counts by score that a stream keeps, lesson by lesson."""
    root = f"{work.work_dir(spark)}/streams/{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/lineitem.parquet").schema
    lines = spark.readStream.schema(schema).parquet(f"{sf_dir}/lineitem.parque[t]").where("l_shipdate is not null")
    records = lines.select(F.col("l_linestatus").alias("key"), F.year("l_shipdate").alias("lesson"), F.col("l_extendedprice").cast("double").alias("s"), (F.col("l_returnflag") == "R").cast("int").alias("y"))

    def keep(rows: DataFrame, number: int) -> None:
        rows.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/number={number}")

    M.run_each_batch(M.score_counts(records), keep, f"{root}/checkpoint")
    counts = spark.read.parquet(f"{root}/out").groupBy("key", "lesson", "s").agg(*[F.max_by(c, "batch").alias(c) for c in ("pos", "n")])
    by = ["key", "lesson"]
    return rounded(S.precision_of(counts, by).join(S.auc_of(counts, by), by))


@query(f"""with {cells_sql((1,))} select arm, target, m0, count(*) as n, count(*) filter (where y > 0) as n_event, sum(crps) as crps, sum(ey) as ey, sum(y) as y,
  cast(round(sum((p - case when y > 0 then 1.0::double else 0.0::double end) ** 2) * 1000000) as bigint) as brier_millionths from cells group by arm, target, m0""")
def streamed_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the scores of every origin, its forecasts produced and stored one origin at a time."""
    root = f"{work.work_dir(spark)}/streams/{uuid.uuid4().hex}"
    known = work.table(truth(spark, sf_dir), "truth")
    strata = work.table(O.risk_stratum(known, origins(spark)), "strata")
    E.announce(origins(spark), f"{root}/origins")
    E.evaluate(spark, f"{root}/origins", lambda m0: X.predictions(spark, strata.where(F.col("m0") == m0), (1,)), f"{root}/store", f"{root}/checkpoint")
    cells = S.cell_scores(O.with_truth(E.read_store(spark, f"{root}/store"), known, "error"), "gate")
    event = F.col("y") > 0
    sums = [F.sum(c).alias(c) for c in ("crps", "ey", "y")]
    brier = F.round(F.sum(F.pow(F.col("p") - event.cast("double"), 2)) * 1_000_000).cast("long")
    return cells.groupBy("arm", "target", "m0").agg(F.count("*").alias("n"), F.count(F.when(event, 1)).alias("n_event"), *sums, brier.alias("brier_millionths"))
