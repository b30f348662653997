"""Whitening of embeddings: streamed covariance, symmetric QR, projection on the leading components.

Each entry c of a vector becomes the long x = floor(64 c) + 1,000,000; the model is fitted on the list of distinct
x-vectors, so copies weigh nothing. Every partition streams over its part of the list with Welford's rank-one updates
(``Moments.add``); the states of partitions are merged by the parallel update formula (``Moments.merge``), first in
``MERGERS`` tasks, then those few on the driver, so what arrives there has a fixed size for a given dimension. The
covariance (divisor n) is reduced to tridiagonal form by Householder reflections and diagonalised by implicit QR steps
with Wilkinson shifts (``symmetric_eigen``). A second pass streams over the whitened fit list and returns how far
its covariance is from the identity.

Defined cases: rows are dropped whose vector is null or empty or holds an entry that is null, not finite or too large for a
long (from 2^57 on); so are vectors of another length than the most frequent one (ties: the shorter). Repeated rows
stay repeated in the output and count once in the fit. A component without variance (eigenvalue at most 1e-13 of the
trace) has a null ``whitened`` and no part in the identity error; a table of copies of one vector has null ``explained`` too.
Equal eigenvalues keep the order in which the solver leaves them. An empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnfield.llm.common import lean_batches, materialize, table

COMPONENTS = 16
#: Tasks that merge the states of partitions before the driver merges theirs.
MERGERS = 32
#: Entries are counted in steps of 1 / GRID from -OFFSET / GRID on.
GRID, OFFSET = 64, 1_000_000
#: Eigenvalues up to this share of the trace are rounding errors.
FLAT = 1e-13
_LONG = 2**63 - 1


class Moments:
    """Count, mean, centred second moments and exact sums of integer vectors, as a stream sees them."""

    def __init__(self, size: int):
        self.n, self.mean, self.m2, self.sums = 0, np.zeros(size), np.zeros((size, size)), [0] * size

    def add(self, row: np.ndarray) -> None:
        """Welford's update: the deviations before and after the mean moves make a rank-one term."""
        self.n += 1
        before = row - self.mean
        self.mean += before / self.n
        self.m2 += np.multiply.outer(before, row - self.mean)

    def merge(self, other: Moments) -> Moments:
        """The parallel update formula: both second moments and the spread between the two means."""
        if other.n:
            n, apart = self.n + other.n, other.mean - self.mean
            self.m2 += other.m2 + np.multiply.outer(apart, apart) * (self.n * other.n / n)
            self.mean += apart * (other.n / n)
            self.n, self.sums = n, [a + b for a, b in zip(self.sums, other.sums, strict=True)]
        return self

    def covariance(self) -> np.ndarray:
        return (self.m2 + self.m2.T) / (2 * max(1, self.n))

    def record(self, part: int) -> pa.RecordBatch:
        cells = ([part], [self.n], [self.mean.tobytes()], [self.m2.tobytes()], [[str(s) for s in self.sums]])
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=["part", "n", "mean", "m2", "sums"])

    @classmethod
    def load(cls, n: int, mean: bytes, m2: bytes, sums: list[str]) -> Moments:
        state = cls(len(sums))
        state.n, state.mean, state.m2 = n, np.frombuffer(mean).copy(), np.frombuffer(m2).reshape(len(sums), -1).copy()
        state.sums = [int(s) for s in sums]
        return state


_STATE = "part long, n long, mean binary, m2 binary, sums array<string>"


def _rows(column) -> np.ndarray:
    """A list column without nulls, of vectors of one length, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(x: np.ndarray) -> list[int]:
    if np.issubdtype(x.dtype, np.floating):
        return [0] * x.shape[1]
    safe = max(abs(int(x.min())), abs(int(x.max()))) * len(x) <= _LONG
    return [int(s) for s in (x if safe else x.astype(object)).sum(0)]


def moments(vectors: DataFrame, size: int, offset: int = 0) -> Moments:
    """The moments of the only column of ``vectors``, arrays of ``size`` longs or doubles. Mean and second moments are those of the
    entries less ``offset``, so that a large common part costs no digits; the sums are those of the entries themselves."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state = Moments(size)
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch.column(0))
                state.sums = [a + b for a, b in zip(state.sums, _sums(x), strict=True)]
                for row in (x - offset).astype(np.float64):
                    state.add(row)
        if state.n:
            yield state.record(TaskContext.get().partitionId())

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, first = Moments(size), -1
        for batch in batches:
            for row in batch.to_pylist():
                first = max(first, row.pop("part"))
                state.merge(Moments.load(**row))
        if state.n:
            yield state.record(first)

    parts = vectors.mapInArrow(stream, _STATE)
    merged = parts.repartition(MERGERS, F.col("part") % MERGERS).sortWithinPartitions("part").mapInArrow(together, _STATE)
    state = Moments(size)
    for row in sorted(merged.collect(), key=lambda r: r["part"]):
        state.merge(Moments.load(row["n"], row["mean"], row["m2"], row["sums"]))
    return state


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and q with a = q t q', by Householder reflections."""
    a, size = a.copy(), len(a)
    q = np.eye(size)
    for k in range(size - 2):
        v = a[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        if not length:
            continue
        v[0] += np.copysign(length, v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :] -= 2 * np.outer(v, v @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def symmetric_eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in columns: implicit QR steps with Wilkinson shifts on the tridiagonal form."""
    d, e, q = tridiagonal(a)
    vectors = np.ascontiguousarray(q.T)  # a row for each vector: rotations touch two rows
    hi = len(d) - 1
    while hi > 0:
        small = np.abs(e[:hi]) <= np.finfo(float).eps * (np.abs(d[:hi]) + np.abs(d[1 : hi + 1]))
        e[:hi][small] = 0.0
        if small[hi - 1]:
            hi -= 1
            continue
        zeros = np.flatnonzero(small)
        lo = int(zeros[-1]) + 1 if len(zeros) else 0
        half = (d[hi - 1] - d[hi]) / 2
        shift = d[hi] - e[hi - 1] ** 2 / (half + np.copysign(np.hypot(half, e[hi - 1]), half))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            below, above, between = d[k], d[k + 1], e[k]
            d[k] = c * c * below + 2 * c * s * between + s * s * above
            d[k + 1] = s * s * below - 2 * c * s * between + c * c * above
            e[k] = c * s * (above - below) + (c * c - s * s) * between
            if k < hi - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            first = vectors[k].copy()
            vectors[k] = c * first + s * vectors[k + 1]
            vectors[k + 1] = c * vectors[k + 1] - s * first
    order = np.argsort(-d, kind="stable")
    vectors = vectors[order]
    return d[order], (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).T


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over dimensions of (n x - S)^2 for each row, exact; None where a long cannot hold it."""
    most = max(abs(int(x.min())), abs(int(x.max())))
    if n * most + max(map(abs, sums)) <= _LONG:
        apart = x * n - np.array(sums)
        if max(abs(int(apart.min())), abs(int(apart.max()))) ** 2 * x.shape[1] <= _LONG:
            return (apart * apart).sum(1).tolist()
    apart = x.astype(object) * n - np.array(sums, object)
    return [s if s <= _LONG else None for s in (apart * apart).sum(1)]


class Whitening:
    """Mean, components and scales of a fit list; picklable."""

    def __init__(self, state: Moments, components: int = COMPONENTS):
        self.n, self.sums = state.n, state.sums
        self.mean = np.array([(s - OFFSET * state.n) / state.n for s in state.sums])
        v = state.covariance()
        values, vectors = symmetric_eigen(v)
        k = min(components, len(values))
        trace = float(np.trace(v))
        self.explained = (values[:k] / trace).tolist() if trace > 0 else [None] * k
        self.live = values[:k] > FLAT * trace
        self.scale = np.where(self.live, 1 / np.sqrt(np.where(self.live, values[:k], 1.0)), 0.0)
        self.vectors = vectors[:, :k]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return ((x - OFFSET) - self.mean) @ self.vectors * self.scale


def grid(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows that are kept; x counts grid steps."""
    c = lambda e: e.cast("double")
    good = embeddings.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("_v")).where(
        F.col("_v").isNotNull() & F.coalesce(F.forall("_v", lambda e: e.isNotNull() & ~F.isnan(c(e)) & (F.abs(c(e)) < float(2**57))), F.lit(False))
    )
    sizes = good.where(F.size("_v") > 0).groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    size = sizes[0]["d"] if sizes else 0
    return good.where((F.size("_v") == size) & (F.size("_v") > 0)).select("vec_id", F.transform("_v", lambda e: F.floor(c(e) * GRID) + OFFSET).alias("x"))


def whiten(embeddings: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n, deviation, whitened, explained, identity_error) for each row that is kept; ``whitened`` and ``explained`` are
    arrays over the components, by falling eigenvalue."""
    rows = grid(embeddings, id_col, vector_col)
    fit = materialize(rows.select("x").distinct(), "fit-list")
    one = fit.limit(1).collect()
    size = len(one[0]["x"]) if one else 0
    state = moments(fit, size, OFFSET) if size else Moments(0)
    model = Whitening(state, components) if size else None

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = model(_rows(batch.column(0)))
                yield pa.RecordBatch.from_arrays([pa.array(list(flat), pa.list_(pa.float64()))], names=["w"])

    off = None
    if model is not None and model.live.any():
        spread = moments(fit.mapInArrow(project, "w array<double>"), len(model.live)).covariance()[np.ix_(model.live, model.live)]
        off = float(np.abs(spread - np.eye(len(spread))).max())

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch.column(1))
                shown = [[v if ok else None for v, ok in zip(row, model.live, strict=True)] for row in model(x).tolist()]
                cells = (pa.array([model.n] * len(x), pa.int64()), pa.array(_deviation(x, model.n, model.sums), pa.int64()), pa.array(shown, pa.list_(pa.float64())))
                tail = (pa.array([model.explained] * len(x), pa.list_(pa.float64())), pa.array([off] * len(x), pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), *cells, *tail], names=["vec_id", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return lean_batches(rows).mapInArrow(apply, f"vec_id {kind}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double")


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    """A row for each kept vector and component."""
    white = whiten(table(spark, sf_dir, "embeddings"))
    each = white.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
