"""Connected components on Spark by alternating stars (large-star and small-star steps)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnfield.llm.common import BROADCAST_ROWS, large, materialize

#: A node with over 1 / HOT_NODES of all link ends is hot: there are fewer than HOT_NODES of them, whatever the input.
HOT_NODES = 256


def _with_least(ends: DataFrame, least: DataFrame, size: int) -> DataFrame:
    """``ends`` (u, v) with the least neighbour m of u. The few hot nodes are broadcast, so no task gets all ends of one."""
    limit = max(1_000, size // HOT_NODES)
    hot = least.where(F.col("degree") > limit).select(F.col("u").alias("hot"), F.col("m").alias("hot_m"))
    rest = least.where(F.col("degree") <= limit).select(F.col("u").alias("rest"), F.col("m").alias("rest_m"))
    known = ends.join(F.broadcast(hot), ends.u == hot.hot, "left")
    # A hot end finds its value above; it is scattered by its other end, as its own key matches nothing here.
    key = F.when(F.col("hot").isNull(), F.struct("u", F.lit(0).cast("long").alias("k"))).otherwise(F.struct("u", F.col("v").alias("k")))
    other = rest.select(F.struct(F.col("rest").alias("u"), F.lit(0).cast("long").alias("k")).alias("_key"), "rest_m")
    other = large(other) if size > BROADCAST_ROWS else other
    both = known.withColumn("_own", key).join(other, F.col("_own") == F.col("_key"), "left")
    return both.select("u", "v", F.coalesce("hot_m", "rest_m").alias("m"))


def _large_star(links: DataFrame, size: int) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    ends = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(links.select("lo", "hi"))
    least = materialize(ends.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("degree")), "least")
    return _with_least(ends.where("v > u"), least, 2 * size).select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(links: DataFrame, size: int) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of these."""
    ends = links.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    least = materialize(ends.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")), "least")
    between = _with_least(ends, least, size).where("v != m").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    return between.union(least.select(F.col("u").alias("hi"), F.col("m").alias("lo"))).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that occurs in ``links``; ends are longs.

    Rounds of a large-star and a small-star step turn every component into a star around its smallest node; the number
    of rounds grows with the logarithm of the longest path, in whatever order the ids lie on it. Links never grow in
    number. Each step is cut from its lineage by a table in the shared folder; links never reach the driver.
    Rows with a null end are ignored; an empty table gives an empty result.
    """
    src, dst = F.col(a).cast("long"), F.col(b).cast("long")
    ends = links.select(F.greatest(src, dst).alias("hi"), F.least(src, dst).alias("lo")).where(src.isNotNull() & dst.isNotNull() & (src != dst))
    stars = materialize(ends.distinct(), "links")
    before = _state(stars)
    while before[0]:
        wide = materialize(_large_star(stars, before[0]), "links")
        stars = materialize(_small_star(wide, before[0]), "links")
        now = _state(stars)
        if now == before:
            break
        before = now
    centres = stars.select("lo").distinct().select(F.col("lo").alias("node"), F.col("lo").alias("component"))
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(centres)
