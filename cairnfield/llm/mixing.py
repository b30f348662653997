"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Documents are counted into cells (source, language, topic). The cells' token weights are raked until their margins
agree with the targets; a cell's keep probability is its calibrated weight over its raw one, scaled so that the
expected tokens meet the budget, with probabilities capped at 1 and the rest scaled up in turn; where a cap binds, the
margins stay that much short of a target that asks for more tokens than there are. A document is kept when
a uniform number made from its id and text by hashing lies below its cell's probability, so the choice depends neither
on partitions nor on the run.

Targets are given by margin: shares by value, ``"equal"`` for equal shares, or nothing for tempered ones (raw shares to the power
``TEMPER``). Raking goes on until every margin is met within ``TOLERANCE`` or, where the targets contradict each other, until
the largest gap stops falling; that gap is the ``residual``.

The default topic comes from the content: whole texts become vectors of hashed word counts, the mean of their language is taken off
so that topics cut across languages (or else the two margins would contradict each other), and spherical k-means over all
documents gives ``TOPICS`` centres; every document gets the nearest. Sums are of whole numbers, so they are the same in any order.

Up to ``DRIVER_CELLS`` cells are raked in the driver after they were counted; more are raked by Spark with the same
steps. Defined cases: nulls are values of their own in each dimension; texts without words are the topic ``empty``, have no tokens
and get their cell's probability (0 tokens in a whole cell: probability 1, they cost nothing); equal rows share their fate; an
empty table gives an empty result; other columns are ignored; ``sample`` adds mix_topic, mix_tokens and mix_weight and replaces columns
of these names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from cairnfield.llm.common import SPACE, lean_batches, materialize, small

DIMENSIONS = ("source", "lang", "topic")
#: Without targets a margin's raw shares are raised to this power and scaled to 1, which lifts what is rare.
TEMPER = 0.5
#: Share of the tokens to keep.
BUDGET = 0.5
TOLERANCE = 1e-9
#: Raking stops when a round takes less than this share off the largest gap.
STALL = 1e-4
TOPICS, WIDTH = 8, 256
#: Vectors are packed as whole numbers of 1 / SCALE and summed as whole numbers of 1 / FINE.
SCALE, FINE = 32_767, 1 << 20
#: k-means ends when a round adds less than this share to the summed similarity, or after ROUNDS.
GAIN, ROUNDS = 1e-4, 25
DRIVER_CELLS = 50_000
SEED = 7

Targets = Mapping[str, Mapping[str | None, float] | str]
#: Targets of op6_mixing: sources share equally, languages as given, topics are tempered.
TARGETS: Targets = {"source": "equal", "lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}}


_PLACES: dict[str, int] = {}


def vector(text: str) -> np.ndarray | None:
    """Unit vector of the logarithms of hashed word counts; None without words."""
    counts = Counter(text.lower().split())
    if not counts:
        return None
    if len(_PLACES) > 200_000:
        _PLACES.clear()
    at = np.empty(len(counts), np.int64)
    for i, w in enumerate(counts):
        if (place := _PLACES.get(w)) is None:
            place = _PLACES[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) % WIDTH
        at[i] = place
    v = np.bincount(at, np.log1p(np.fromiter(counts.values(), float, len(counts))), WIDTH)
    return v / np.linalg.norm(v)


def packed(texts: pa.Array) -> pa.Array:
    """The vector of each text as int16 of SCALE, in bytes; null without words."""
    found = [vector(t.as_py() or "") for t in texts]
    return pa.array([None if v is None else np.rint(v * SCALE).astype(np.int16).tobytes() for v in found], pa.binary())


def _unpacked(column: pa.Array) -> np.ndarray:
    """Packed vectors, none of them null, as rows of numbers."""
    return np.frombuffer(b"".join(x.as_buffer() for x in column), np.int16).reshape(-1, WIDTH).astype(float)


def _summed(vectors: DataFrame, name: str, kind: str, group: Callable[[np.ndarray, list], tuple[list, np.ndarray]]) -> dict:
    """Count and sum of the integer rows that ``group`` makes of each batch's vectors and languages, by the group it names.

    Every task adds up what it reads and Spark adds up the tasks; sums are of integers, so they are exact in any order.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            names, rows = group(_unpacked(batch.column(1)), batch.column(0).to_pylist())
            number = {x: i for i, x in enumerate(dict.fromkeys(names))}
            of = np.fromiter((number[x] for x in names), np.int64, len(names))
            for x, i in number.items():
                mine = of == i
                n, total = sums.get(x, (0, 0))
                sums[x] = n + int(mine.sum()), total + rows[mine].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa_kind), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([x.tobytes() for _, x in sums.values()], pa.binary())], names=[name, "n", "s"])

    def merge(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in rows.column("s"))
        return pa.table({name: rows.column(name).slice(0, 1), "n": [sum(rows.column("n").to_pylist())], "s": pa.array([total.tobytes()], pa.binary())})

    pa_kind = pa.string() if kind == "string" else pa.int32()
    schema = f"{name} {kind}, n long, s binary"
    merged = vectors.mapInArrow(partial, schema).groupBy(name).applyInArrow(merge, schema)
    return {r[name]: (r["n"], np.frombuffer(r["s"], np.int64)) for r in merged.collect()}


class Topics:
    """Mean vectors of the languages and centres of what is left when they are taken off."""

    def __init__(self, means: dict[str | None, np.ndarray], centres: np.ndarray):
        self.means, self.centres = means, centres

    def rest(self, v: np.ndarray, langs: list[str | None]) -> np.ndarray:
        """Unit vectors of what is left of packed vectors."""
        nothing = np.zeros(WIDTH)
        left = v / SCALE - np.array([self.means.get(x, nothing) for x in langs]).reshape(-1, WIDTH)
        return left / np.maximum(1e-12, np.sqrt((left * left).sum(1, keepdims=True)))

    def at(self, v: np.ndarray, langs: list[str | None]) -> np.ndarray:
        """The number of each packed vector's topic."""
        return (self.rest(v, langs) @ self.centres.T).argmax(1) if len(self.centres) else np.zeros(len(v), int)

    def named(self, column: pa.Array, langs: list[str | None]) -> pa.Array:
        """The topic of each packed vector; ``empty`` where it is null."""
        there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
        said = np.full(len(column), "empty", object)
        if len(there):
            said[there] = [f"topic{i}" for i in self.at(_unpacked(column.take(pa.array(there))), [langs[i] for i in there])]
        return pa.array(said, pa.string())


def fit_vectors(vectors: DataFrame, topics: int = TOPICS) -> Topics:
    """Topics from all rows of a table (lang, v): language means, then spherical k-means over every vector.

    The starts are the means of the cells that fixed random planes cut, so no row is drawn; rounds end when the summed similarity
    of the vectors to their centres grows by less than GAIN.
    """
    fitted = Topics({x: s / n / SCALE for x, (n, s) in _summed(vectors, "lang", "string", lambda v, langs: (langs, v.astype(np.int64))).items()}, np.zeros((0, WIDTH)))
    planes = np.random.default_rng(SEED).standard_normal((max(1, (topics - 1).bit_length()), WIDTH))
    whole = lambda rest: np.rint(rest * FINE).astype(np.int64)

    def cells(v: np.ndarray, langs: list) -> tuple[list, np.ndarray]:
        rest = fitted.rest(v, langs)
        return (((rest @ planes.T > 0) @ (1 << np.arange(len(planes)))) % topics).tolist(), whole(rest)

    last = 0.0
    sums = _summed(vectors, "topic", "int", cells)
    fitted.centres = np.array([sums[i][1] for i in sorted(sums)], float).reshape(-1, WIDTH)
    for _ in range(ROUNDS):
        size = np.sqrt((fitted.centres**2).sum(1, keepdims=True))
        if not size.any() or size.sum() <= (1 + GAIN) * last:
            break
        last = float(size.sum())
        fitted.centres = (fitted.centres / np.maximum(size, 1e-12))[size[:, 0] > 0]
        sums = _summed(vectors, "topic", "int", lambda v, langs: (fitted.at(v, langs).tolist(), whole(fitted.rest(v, langs))))
        # A centre that no vector is nearest to is given up.
        fitted.centres = np.array([sums[i][1] for i in sorted(sums)], float).reshape(-1, WIDTH)
    fitted.centres = fitted.centres / np.maximum(np.sqrt((fitted.centres**2).sum(1, keepdims=True)), 1e-12)
    return fitted


def _with_vectors(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with the packed vector ``v`` in place of the text."""
    at = docs.columns.index(text_col)
    kept = [i for i in range(len(docs.columns)) if i != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), packed(batch.column(at))], names=[*(batch.schema.names[i] for i in kept), "v"])

    return lean_batches(docs).mapInArrow(run, StructType([*(docs.schema.fields[i] for i in kept), StructField("v", BinaryType())]))


def fit_topics(docs: DataFrame, text_col: str) -> Topics:
    """Topics from the texts of all rows."""
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col(text_col).alias("text"))
    return fit_vectors(materialize(_with_vectors(rows, "text").where("v is not null"), "vectors"))


def _languages(column: pa.Array) -> list[str | None]:
    return [None if x is None else str(x) for x in column.to_pylist()]


def with_topic(docs: DataFrame, text_col: str, fitted: Topics, name: str) -> DataFrame:
    """``docs`` with the topic of each text as one more column."""
    at, of = docs.columns.index(text_col), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, fitted.named(packed(batch.column(at)), _languages(batch.column(of)))], names=[*batch.schema.names, name])

    return lean_batches(docs).mapInArrow(run, StructType([*docs.schema.fields, StructField(name, StringType())]))


def _vectors_to_topics(rows: DataFrame, fitted: Topics) -> DataFrame:
    """(doc_id, source, lang, tokens, u, v) with the topic in place of v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], fitted.named(batch.column(5), _languages(batch.column(2)))], names=[*batch.schema.names[:-1], "topic"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], StructField("topic", StringType())])).select("doc_id", "source", "lang", "topic", "tokens", "u")


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) from the hash of the keys."""
    return F.shiftrightunsigned(F.xxhash64(*keys, F.lit(SEED)), 11) / F.lit(float(1 << 53))


def words(text: Column) -> Column:
    """How many runs of anything but space the text has."""
    return F.length(F.regexp_replace(F.regexp_replace(text, f"[^{SPACE}]+", "x"), f"[{SPACE}]+", "")).cast("long")


def counted(docs: DataFrame, id_col: str, text_col: str, topic: Column | None = None) -> DataFrame:
    """(doc_id, source, lang, tokens, u) and the topic, or the text where none is given."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    last = text.alias("text") if topic is None else topic.cast("string").alias("topic")
    return docs.select(F.col(id_col).alias("doc_id"), F.col("source").alias("source"), F.col("lang").alias("lang"), words(text).alias("tokens"), uniform(F.col(id_col), F.col(text_col)).alias("u"), last)


def _tempered(share: np.ndarray) -> np.ndarray:
    t = np.where(share > 0, share, 0) ** TEMPER * (share > 0)
    return t / t.sum() if t.sum() else share


def _wanted(values: list, shares: np.ndarray, targets: Mapping | None) -> np.ndarray:
    """Target shares of a margin's values, scaled to 1 over those that have tokens."""
    if targets is None:
        return _tempered(shares)
    if targets == "equal":
        return (shares > 0) / max(1, (shares > 0).sum())
    t = np.array([targets.get(v, 0.0) for v in values]) * (shares > 0)
    return t / t.sum() if t.sum() else shares


def rake(cells: list[tuple], tokens: np.ndarray, targets: Targets | None = None) -> tuple[np.ndarray, float]:
    """Calibrated shares of the cells (tuples of values, one for each dimension), by iterative proportional fitting, and the largest gap that is left."""
    if not len(cells):
        return tokens, 0.0
    raw = tokens / tokens.sum() if tokens.sum() else tokens
    w = raw.copy()
    margins = []
    for d, name in enumerate(DIMENSIONS):
        values = sorted({c[d] for c in cells}, key=lambda v: (v is not None, str(v)))
        number = {v: i for i, v in enumerate(values)}
        at = np.array([number[c[d]] for c in cells], int)
        margins.append((at, _wanted(values, np.bincount(at, raw, len(values)), (targets or {}).get(name))))
    last = float("inf")
    while True:
        worst = 0.0
        for at, want in margins:
            now = np.bincount(at, w, len(want))
            worst = max(worst, float(np.abs(now - want).max()))
            w = w * np.divide(want, now, out=np.zeros_like(want), where=now > 0)[at]
        if worst < TOLERANCE or worst > (1 - STALL) * last:
            return w, worst
        last = worst


def probabilities(tokens: np.ndarray, w: np.ndarray, budget: float = BUDGET) -> np.ndarray:
    """Keep probabilities in proportion to w / raw share, capped at 1, whose expected tokens meet the budget."""
    total = tokens.sum()
    p = np.ones(len(tokens))
    if not total:
        return p
    ratio = np.divide(w, tokens / total, out=np.zeros(len(w)), where=tokens > 0)
    free = (tokens > 0) & (ratio > 0)
    p[(tokens > 0) & (ratio == 0)] = 0.0
    left = budget * total
    while free.any():
        scale = left / (tokens[free] @ ratio[free])
        over = free & (scale * ratio >= 1)
        if not over.any():
            p[free] = scale * ratio[free]
            break
        left -= tokens[over].sum()
        free &= ~over
        if left <= 0:
            p[free] = 0.0
            break
    return p


def rake_distributed(cells: DataFrame, targets: Targets | None = None, budget: float = BUDGET) -> tuple[DataFrame, float]:
    """The same steps on Spark, for more cells than the driver should hold: (source, lang, topic, weight, probability), and the gap."""
    spark = cells.sparkSession
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    state = cells.withColumn("w", F.col("tokens") / F.lit(float(max(1, total))))
    wants = {}
    for d in DIMENSIONS:
        share = state.groupBy(d).agg(F.sum("w").alias("share"))
        goal = (targets or {}).get(d)
        if goal is None:
            raised = share.withColumn("t", F.pow("share", F.lit(TEMPER)))
        elif goal == "equal":
            raised = share.withColumn("t", (F.col("share") > 0).cast("double"))
        else:
            kind = cells.schema[d].dataType
            given = spark.createDataFrame([(k, float(v)) for k, v in goal.items()], f"v {kind.simpleString()}, t double")
            raised = share.join(given, F.col(d).eqNullSafe(F.col("v")), "left").select(d, "share", F.when(F.col("share") > 0, F.coalesce("t", F.lit(0.0))).otherwise(0.0).alias("t"))
        norm = raised.agg(F.sum("t")).first()[0] or 1.0
        wants[d] = materialize(raised.select(F.col(d).alias("v"), (F.col("t") / norm).alias("want")), "wants")
    last = float("inf")
    while True:
        worst = 0.0
        for d in DIMENSIONS:
            now = state.groupBy(F.col(d).alias("_v")).agg(F.sum("w").alias("now"))
            step = materialize(now.join(wants[d], F.col("_v").eqNullSafe(F.col("v"))).select("_v", "now", "want"), "step")
            worst = max(worst, step.agg(F.max(F.abs(F.col("now") - F.col("want")))).first()[0] or 0.0)
            joined = state.join(step, F.col(d).eqNullSafe(F.col("_v")))
            state = materialize(joined.select(*DIMENSIONS, "tokens", F.when(F.col("now") > 0, F.col("w") * F.col("want") / F.col("now")).otherwise(0.0).alias("w")), "cells")
        if worst < TOLERANCE or worst > (1 - STALL) * last:
            break
        last = worst
    ratio = F.when(F.col("tokens") > 0, F.col("w") * float(max(1, total)) / F.col("tokens")).otherwise(F.lit(None))
    state = materialize(state.withColumn("ratio", ratio).withColumn("free", F.col("ratio") > 0), "cells")
    left, cut = budget * total, None  # cells whose ratio is at least cut are kept whole
    while True:
        free = state.where("free") if cut is None else state.where(F.col("free") & (F.col("ratio") < cut))
        mass, top = free.agg(F.sum(F.col("tokens") * F.col("ratio")), F.max("ratio")).first()
        if not mass:
            scale = 0.0
            break
        whole = 0.0 if cut is None else state.where(F.col("free") & (F.col("ratio") >= cut)).agg(F.sum("tokens")).first()[0] or 0.0
        scale = max(0.0, left - whole) / mass
        if scale * top < 1:
            break
        cut = 1 / scale
    p = F.when(F.col("tokens") == 0, 1.0).when(F.col("ratio") == 0, 0.0)
    p = (p if cut is None else p.when(F.col("ratio") >= cut, 1.0)).otherwise(F.col("ratio") * scale)
    return state.select(*DIMENSIONS, "w", p.alias("probability")), worst


def cell_probabilities(cells: DataFrame, targets: Targets | None = None, budget: float = BUDGET, driver_cells: int = DRIVER_CELLS) -> tuple[DataFrame, float]:
    """(_source, _lang, _topic, probability) for each cell of (source, lang, topic, tokens), and the largest gap of a margin."""
    if cells.count() <= driver_cells:
        found = cells.orderBy(*DIMENSIONS).collect()
        tokens = np.array([r["tokens"] for r in found], float)
        w, gap = rake([tuple(r[d] for d in DIMENSIONS) for r in found], tokens, targets)
        p = probabilities(tokens, w, budget)
        schema = ", ".join(f"{d} {cells.schema[d].dataType.simpleString()}" for d in DIMENSIONS)
        table = cells.sparkSession.createDataFrame([(*(r[d] for d in DIMENSIONS), float(x)) for r, x in zip(found, p, strict=True)], schema + ", probability double")
    else:
        table, gap = rake_distributed(cells, targets, budget)
    return small(table.select(*[F.col(d).alias(f"_{d}") for d in DIMENSIONS], "probability")), gap


def _same_cell(rows: DataFrame, table: DataFrame) -> Column:
    source, lang, topic = (rows[d].eqNullSafe(table[f"_{d}"]) for d in DIMENSIONS)
    return source & lang & topic


def _cells(rows: DataFrame) -> DataFrame:
    return materialize(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")


def weigh(docs: DataFrame, targets: Targets | None = None, budget: float = BUDGET, id_col: str = "doc_id", text_col: str = "text", topic: Column | None = None, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, weight, probability, residual, kept) for each row; weight is 1 / probability."""
    rows = counted(docs, id_col, text_col, topic)
    if topic is None:
        # The texts are read once: their vectors are fitted and then named.
        vectors = materialize(_with_vectors(rows, "text"), "vectors")
        rows = _vectors_to_topics(vectors, fit_vectors(vectors.where("v is not null").select(F.col("lang").cast("string").alias("lang"), "v")))
    rows = materialize(rows, "tokens")
    table, gap = cell_probabilities(_cells(rows), targets, budget, driver_cells)
    joined = rows.join(table, _same_cell(rows, table))
    weight = F.when(F.col("probability") > 0, F.lit(1.0) / F.col("probability"))
    return joined.select("doc_id", *DIMENSIONS, "tokens", weight.alias("weight"), "probability", F.lit(gap).alias("residual"), (F.col("u") < F.col("probability")).alias("kept"))


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return weigh(spark.read.parquet(f"{sf_dir}/documents.parquet"), TARGETS)


def sample(docs: DataFrame, targets: Targets | None = None, budget: float = BUDGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept rows of ``docs`` with mix_topic, mix_tokens and mix_weight beside their own columns. Topics are found again beside the row."""
    fitted = fit_topics(docs, text_col)
    table, _ = cell_probabilities(_cells(with_topic(counted(docs, id_col, text_col), "text", fitted, "topic")), targets, budget)
    own = [c for c in docs.columns if c not in ("mix_topic", "mix_tokens", "mix_weight")]
    rows = with_topic(docs.select(*own), text_col, fitted, "mix_topic")
    cells = table.toDF("mix__source", "mix__lang", "mix__topic", "mix__p")
    at = rows["source"].eqNullSafe(cells["mix__source"]) & rows["lang"].eqNullSafe(cells["mix__lang"]) & (rows["mix_topic"] == cells["mix__topic"])
    kept = rows.join(small(cells), at).where(uniform(rows[id_col], rows[text_col]) < cells["mix__p"])
    return kept.select(*[rows[c] for c in own], rows["mix_topic"], words(F.coalesce(rows[text_col], F.lit(""))).alias("mix_tokens"), (F.lit(1.0) / cells["mix__p"]).alias("mix_weight"))
