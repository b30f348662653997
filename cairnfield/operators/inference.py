"""Bootstraps and paired tests on keyed uniforms: partials first, replicates on the partials."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnfield.functions import keyed
from cairnfield.functions.scalars import erfc
from cairnfield.operators import order
from cairnfield.sources.work import checked, large


def paired_differences(cells: DataFrame, a: str, b: str, value: str = "crps") -> DataFrame:
    """(target, m0, h, unit, d): a's value minus b's on keys that both have. Rows pair by key, never by position."""
    key = ["target", "m0", "h", "unit"]
    left = cells.where(F.col("arm") == a).select(*key, F.col(value).alias("x"))
    right = cells.where(F.col("arm") == b).select(*key, F.col(value).alias("y"))
    return left.join(large(right), key).select(*key, (F.col("x") - F.col("y")).alias("d"))


def block_bootstrap(diffs: DataFrame, by: Sequence[str], *, block: str, replicates: int, level: float, seed: str) -> DataFrame:
    """(by, n, blocks, mean, low, high, p): whole blocks drawn with replacement.

    Cells are summed to blocks first; a replicate then picks as many blocks as there are, by keyed integers. p is twice
    the smaller share of replicates on either side of zero, at most 1.
    """
    sums = diffs.groupBy(*by, block).agg(F.sum("d").alias("s"), F.count("*").alias("c"))
    blocks = checked(sums.withColumn("i", F.row_number().over(W.partitionBy(*by).orderBy(block)) - 1), "blocks")
    size = blocks.groupBy(*by).agg(F.count("*").alias("blocks"), F.sum("s").alias("total"), F.sum("c").alias("n"))
    picks = size.select(*by, "blocks", "n", "total", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep")).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("slot"))
    chosen = picks.withColumn("i", keyed.integer(F.lit(seed), F.col("rep"), F.col("slot")) % F.col("blocks"))
    drawn = chosen.join(blocks.select(*by, "i", "s", "c"), [*by, "i"]).groupBy(*by, "blocks", "n", "total", "rep").agg((F.sum("s") / F.sum("c")).alias("m"))
    return _interval(drawn, [*by, "blocks", "n", "total"], level).select(*by, "n", "blocks", (F.col("total") / F.col("n")).alias("mean"), "low", "high", "p")


#: Replicates whose weights come from one digest, by two bytes each.
DIGEST_WEIGHTS = 8


def poisson_weights() -> np.ndarray:
    """The Poisson(1) count of each of the 65,536 values of two bytes, as a level of its distribution; at most 8."""
    levels = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])
    return np.searchsorted(levels, (np.arange(65_536) + 0.5) / 65_536, side="right").astype(np.float64)


def iid_bootstrap(diffs: DataFrame, by: Sequence[str], *, key: Sequence[str], replicates: int, level: float, seed: str) -> DataFrame:
    """(by, n, mean, low, high, p): cells drawn independently, as Poisson(1) counts from digests of their key.

    Every task keeps two vectors for each group, the weighted sums and the weights of all replicates, and adds its cells to them;
    only these vectors are shuffled. No cell is copied for a replicate.
    """
    blocks = -(-replicates // DIGEST_WEIGHTS)
    keys = F.concat_ws(":", *[F.col(k).cast("string") for k in key])
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in diffs.select(*by).schema)

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = poisson_weights()
        heads = [hashlib.md5(f"{seed}:{b}:".encode()) for b in range(blocks)]
        sums: dict[tuple, np.ndarray] = {}
        like = None

        def digests(k: bytes) -> Iterator[bytes]:
            for head in heads:
                h = head.copy()
                h.update(k)
                yield h.digest()

        def flush() -> pa.RecordBatch:
            groups = [pa.array([g[i] for g in sums], like.field(i).type) for i in range(len(by))]
            vectors = [pa.array([list(v[r]) for v in sums.values()], pa.list_(pa.float64())) for r in (0, 1)]
            return pa.RecordBatch.from_arrays([*groups, *vectors], names=[*by, "s", "w"])

        for batch in batches:
            like = batch.schema
            if not batch.num_rows:
                continue
            groups: dict[tuple, list[int]] = {}
            for i, g in enumerate(zip(*(batch.column(c).to_pylist() for c in range(len(by))), strict=True) if by else [()] * batch.num_rows):
                groups.setdefault(g, []).append(i)
            names, d = batch.column(len(by)).to_pylist(), batch.column(len(by) + 1).to_numpy(zero_copy_only=False)
            for g, at in groups.items():
                for lo in range(0, len(at), 1_000):
                    some = at[lo : lo + 1_000]
                    raw = b"".join(x for i in some for x in digests(names[i].encode()))
                    weights = counts[np.frombuffer(raw, ">u2").reshape(len(some), -1)[:, :replicates]]
                    sums.setdefault(g, np.zeros((2, replicates)))
                    sums[g] += [d[some] @ weights, weights.sum(0)]
        if sums:
            yield flush()

    rows = diffs.where(F.col("d").isNotNull()).select(*by, keys.alias("_key"), F.col("d").cast("double").alias("d"))
    vectors = rows.mapInArrow(partials, ", ".join(filter(None, [kinds, "s array<double>, w array<double>"])))
    each = vectors.select(*by, F.posexplode(F.arrays_zip("s", "w")).alias("rep", "z"))
    drawn = each.groupBy(*by, "rep").agg((F.sum("z.s") / F.sum("z.w")).alias("m"))
    plain = diffs.groupBy(*by).agg(F.count("*").alias("n"), F.avg("d").alias("mean"))
    return plain.join(_interval(drawn, list(by), level), list(by)).select(*by, "n", "mean", "low", "high", "p")


def _interval(drawn: DataFrame, by: Sequence[str], level: float) -> DataFrame:
    a = (1 - level) / 2
    below, above = F.avg((F.col("m") <= 0).cast("double")), F.avg((F.col("m") >= 0).cast("double"))
    return drawn.groupBy(*by).agg(F.percentile("m", a).alias("low"), F.percentile("m", 1 - a).alias("high"), F.least(F.lit(1.0), 2 * F.least(below, above)).alias("p"))


def minimum_effect(block: DataFrame, iid: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, block_half, iid_half, inflation): half-widths of both intervals; differences below the first cannot be told."""
    half = (F.col("high") - F.col("low")) / 2
    joined = block.select(*by, half.alias("block_half")).join(iid.select(*by, half.alias("iid_half")), list(by))
    return joined.withColumn("inflation", F.when(F.col("iid_half") > 0, F.col("block_half") / F.col("iid_half")))


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the standard normal; null for NaN."""
    return F.when(~F.isnan(z), erfc(F.abs(z) / math.sqrt(2)))


def signed_ranks(diffs: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, n, w_plus, z): the signed-rank statistic; zeros are ranked and split, ties take average ranks."""
    d = F.col("d")
    ties = diffs.groupBy(*by, F.abs(d).alias("a")).agg(F.count("*").alias("t"), F.count(F.when(d > 0, 1)).alias("up"), F.count(F.when(d == 0, 1)).alias("flat"))
    t = F.col("t")
    rank = F.col("t_before") + (t + 1) / 2.0
    s = order.before(ties, by, "a", ["t"]).groupBy(*by).agg(F.sum("t").alias("n"), F.sum(rank * (F.col("up") + F.col("flat") / 2)).alias("w_plus"), F.sum("flat").alias("zeros"), F.sum(F.when(F.col("a") > 0, t * t * t - t)).alias("tie"))
    n, m0 = F.col("n").cast("double"), F.col("zeros").cast("double")
    var = (n * (n + 1) * (2 * n + 1) - m0 * (m0 + 1) * (2 * m0 + 1) - F.coalesce("tie", F.lit(0)) / 2) / 24
    return s.select(*by, "n", "w_plus", F.when(var > 0, (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(F.when(var > 0, var).otherwise(1.0))).alias("z"))


def paired_significance(diffs: DataFrame, by: Sequence[str], *, key: Sequence[str], replicates: int, seed: str, alpha: float = 0.05) -> DataFrame:
    """(by, n, mean, low, high, wilcoxon_p, significant): an interval without zero and a small signed-rank p, both."""
    ci = iid_bootstrap(diffs, by, key=key, replicates=replicates, level=1 - alpha, seed=seed).drop("p")
    both = ci.join(signed_ranks(diffs, by).select(*by, normal_tail(F.col("z")).alias("wilcoxon_p")), list(by))
    apart = (F.col("low") > 0) | (F.col("high") < 0)
    return both.withColumn("significant", apart & F.coalesce(F.col("wilcoxon_p") < alpha, F.lit(False)))


def stratified_test(diffs: DataFrame, strata: DataFrame, by: Sequence[str], *, replicates: int, seed: str, level: float = 0.95) -> DataFrame:
    """The block test on cells that were active before their origin."""
    active = diffs.join(large(strata.where("active").select("m0", "unit", "target")), ["m0", "unit", "target"], "left_semi")
    return block_bootstrap(active, by, block="m0", replicates=replicates, level=level, seed=seed)
