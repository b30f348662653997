"""Quality classifier: random Fourier features over document statistics, ridge regression, isotonic calibration.

Statistics of the whole text (shares of symbols, capitals, digits and punctuation, repetition of words and lines,
lengths) are standardised and mapped to cosines of random projections, whose inner products approximate a Gaussian
kernel. Each partition sums its part of the normal equations; the sums are added and solved for ridge scores, which
isotonic regression turns into probabilities.

Labels are learned from at most ``SAMPLE`` labelled rows, chosen by the hash of their id, never from held-out ones, so
what the driver gets is bounded: ``PARTS`` matrices and ``BINS`` score counts. Language, source and id are no inputs.

Defined cases: null texts count as empty and are scored as such; a document labelled twice takes the mean of its labels
and null labels are ignored; without labelled rows every score is 0.5; repeated rows stay repeated; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnfield.llm.common import held_out, lean_batches, materialize

SAMPLE = 40_000
PARTS = 12
FOURIER = 200
#: Width of the Gaussian kernel, in standard deviations of the statistics.
WIDTH = 4.0
RIDGE = 1.0
BINS = 2_000
SEED = 17

_DELETE = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "symbol": b"#*$%&|<>",
    "pipe": b"|",
    "digit": b"0123456789",
    "stop": b".",
    "comma": b",;:",
    "shout": b"!?",
    "space": b" \t\n\r\v\f",
    "ascii": bytes(range(128)),
}
STATISTICS = ("words", "chars", "word_len", *(k for k in _DELETE), "unique", "top_word", "runs", "dup_lines", "line_len", "sentence_len", "long_words", "capital_words")


def statistics(text: str) -> list[float]:
    data = text.encode("utf-8", "surrogatepass")
    size = max(1, len(data))
    words = text.split()
    n = len(words)
    shares = [(len(data) - len(data.translate(None, cut))) / size for cut in _DELETE.values()]
    lines = [x for x in text.split("\n") if x.strip()]
    counts = Counter(words)
    top = max(counts.values(), default=0) / max(1, n)
    runs = sum(map(eq, words, words[1:])) / max(1, n)
    dup_lines = 1 - len(set(lines)) / len(lines) if lines else 0.0
    return [
        math.log1p(n),
        math.log1p(len(text)),
        len(text) / max(1, n),
        *shares,
        len(counts) / max(1, n),
        top,
        runs,
        dup_lines,
        math.log1p(n / max(1, len(lines))),
        math.log1p(n / (1 + text.count("."))),
        max(map(len, counts), default=0) / 100,
        sum(map(str.isupper, words)) / max(1, n),
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(t.as_py() or "") for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of each row's text."""
    only = lean_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return only.mapInArrow(_measure, f"doc_id {only.schema['doc_id'].dataType.simpleString()}, x array<double>")


def _matrix(column) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, len(STATISTICS))


class Features:
    """Standardised statistics, a constant and random Fourier features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        self.mean, self.scale = mean, scale
        rng = np.random.default_rng(SEED)
        self.w = rng.normal(0, 1 / WIDTH, (len(mean), FOURIER))
        self.b = rng.uniform(0, 2 * np.pi, FOURIER)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.ones((len(z), 1)), z / len(self.mean), math.sqrt(2 / FOURIER) * np.cos(z @ self.w + self.b)])


def training_rows(labels: DataFrame, label_col: str, id_col: str = "doc_id", size: int = SAMPLE) -> DataFrame:
    """(doc_id, y): at most ``size`` labelled ids that are not held out, by hash of the id; y is the mean label."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    one = known.groupBy(F.col(id_col).alias("doc_id")).agg(F.avg(label_col).cast("double").alias("y"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    s = np.zeros((3, len(STATISTICS)))
    for batch in batches:
        x = _matrix(batch.column(0))
        s += [np.full(x.shape[1], len(x)), x.sum(0), (x * x).sum(0)]
    yield pa.RecordBatch.from_arrays([pa.array([s.ravel().tolist()], pa.list_(pa.float64()))], names=["s"])


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: block centres and their increasing means. ``score`` ascends."""
    blocks: list[list[float]] = []
    for s, v, w in zip(score, y, weight, strict=True):
        blocks.append([s * w, v * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


class Model:
    def __init__(self, features: Features, w: np.ndarray):
        self.features, self.w = features, w
        self.knots, self.values = np.array([0.0, 1.0]), np.array([0.001, 0.999])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.w

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0.001, 0.999)


def train(measured: DataFrame, rows: DataFrame) -> Model | None:
    """The classifier from ``measured`` (doc_id, x) and ``rows`` (doc_id, y); None without rows."""
    data = materialize(measured.join(F.broadcast(rows.withColumnRenamed("doc_id", "_id")), F.col("doc_id") == F.col("_id")).select("x", "y").repartition(PARTS), "training")
    n, total, squares = sum(np.array(r["s"]).reshape(3, -1) for r in data.select("x").mapInArrow(_sums, "s array<double>").collect()) if data.limit(1).count() else np.zeros((3, len(STATISTICS)))
    if not n[0]:
        return None
    mean = total / n
    features = Features(mean, np.sqrt(np.maximum(squares / n - mean**2, 1e-8)))

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 + len(STATISTICS) + FOURIER
        a = np.zeros((size, size + 1))
        for batch in batches:
            z, y = features(_matrix(batch.column(0))), batch.column(1).to_numpy()
            a += z.T @ np.hstack([z, y[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary())], names=["a"])

    size = 1 + len(STATISTICS) + FOURIER
    a = sum(np.frombuffer(r["a"]).reshape(size, size + 1) for r in data.mapInArrow(normal, "a binary").toLocalIterator())
    model = Model(features, np.linalg.solve(a[:, :size] + RIDGE * np.eye(size), a[:, size]))

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.clip((model.raw(_matrix(batch.column(0))) + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1)], names=["bin", "y"])

    counts = data.mapInArrow(bins, "bin int, y double").groupBy("bin").agg(F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    centre = np.array([(r["bin"] + 0.5) / BINS * 2 - 0.5 for r in counts])
    model.knots, model.values = isotonic(centre, np.array([r["y"] for r in counts]), np.array([r["n"] for r in counts], float))
    return model


def score(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``."""
    measured = materialize(measure(docs, id_col, text_col), "statistics")
    model = train(measured, training_rows(labels, label_col))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.score(_matrix(batch.column(1))) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    kind = measured.schema["doc_id"].dataType.simpleString()
    scored = measured.mapInArrow(apply, f"doc_id {kind}, score double, predicted int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op7_quality(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the classifier rejects (predicted 0). Statistics are computed again beside the row."""
    known = training_rows(labels, "quality")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = train(measure(texts.join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")), known)
    if model is None:
        return docs
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array([statistics(t.as_py() or "") for t in batch.column(at)])
                yield batch.filter(pa.array(model.score(x) >= 0.5))

    return lean_batches(docs).mapInArrow(keep, docs.schema)
