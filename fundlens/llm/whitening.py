"""Embedding whitening by incremental eigendecomposition.

Vectors are fitted as integers: each entry c becomes floor(256 * c). The fit list has each distinct
integer vector once. Every partition of it keeps its number of rows, their mean and the spectrum of
their scatter matrix, which grows by rank-one updates only: the eigenvalues of
``diag(values) + rho * z z'`` are the roots of a secular equation, one between each two old ones, and
the eigenvectors follow from them. Entries of z that are nothing and eigenvalues that are equal are
deflated before, so that they stay as they are. Rows arrive in blocks: a block's centred rows are
turned by QR into at most as many rows as there are dimensions, with the same scatter, and each of
these is one update; a last one moves the mean. Spectra of partitions are combined in the same way,
by one update for each eigenpair and one for the distance of the means, in a tree of ``FAN_IN``.

Updates add up rounding errors, so a last pass refines: the fit list, centred, is projected on the
spectrum's basis, the covariance of the projections is summed in the same tree, and its own
eigenvectors turn the basis (Rayleigh-Ritz over all dimensions). What goes through the driver has
the size of one covariance matrix.

Cases: a row is left out if its vector is null, empty, or has an entry that is null, not finite or
of 2**54 or more, whose integer is no long; so is one whose length isn't the most frequent (of
equally frequent ones the least). Repeated rows are repeated in the result and count once in the
fit. A row without id is whitened. A component with no variance to speak of (under ``LEAST`` of the
first one's) can't be whitened and has no rows; a single distinct vector has no components, an
empty table no rows. A deviation beyond a long is null. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundlens.session import materialise

SCALE = 256
BLOCK = 4096  # rows that become one block of updates
FAN_IN = 16  # partitions whose spectra are combined in one task
LEAST = 1e-12
EPS = np.finfo(np.float64).eps


def secular_roots(poles: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum(z2 / (poles - x)), as (nearest pole, distance from it).

    ``poles`` rise strictly, ``z2`` is positive. Root i lies between pole i and the next one, the
    last one within rho * sum(z2) of the last pole. Halved intervals, measured from the nearer pole,
    keep the distances exact where a root almost meets a pole.
    """
    n = len(poles)
    width = np.append(np.diff(poles), rho * z2.sum())
    gap = poles[None, :] - poles[:, None]  # [i, j]: pole j seen from pole i
    value = lambda shift, x: 1 + rho * (z2 / (shift - x[:, None])).sum(1)
    # The function rises between two poles: a negative value in the middle puts the root beyond it.
    beyond = (value(gap, width / 2) < 0) & (np.arange(n) < n - 1)
    nearest = np.arange(n) + beyond
    shift = gap[nearest]
    low, high = np.where(beyond, -width / 2, 0.0), np.where(beyond, 0.0, width / 2)
    last = value(gap[-1:], width[-1:] / 2)[0] < 0
    low[-1], high[-1] = (width[-1] / 2, width[-1]) if last else (0.0, width[-1] / 2)
    for _ in range(64):
        middle = (low + high) / 2
        up = value(shift, middle) < 0
        low, high = np.where(up, middle, low), np.where(up, high, middle)
    return nearest, (low + high) / 2


def rank_one_update(values: np.ndarray, vectors: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of ``vectors @ diag(values) @ vectors.T + x x'``; values rise."""
    z = vectors.T @ x
    rho = float(z @ z)
    if rho == 0:
        return values, vectors
    z /= math.sqrt(rho)
    small = 8 * EPS * max(abs(values[-1]), abs(values[0]), rho)
    vectors = vectors.copy()
    live = rho * np.abs(z) > small
    # Of two equal eigenvalues a rotation takes all of z to one.
    kept = np.flatnonzero(live).tolist()
    at = kept[0] if kept else 0
    for j in kept[1:]:
        if values[j] - values[at] <= small:
            r = math.hypot(z[at], z[j])
            c, s = z[j] / r, z[at] / r
            vectors[:, [at, j]] = vectors[:, [at, j]] @ np.array([[c, s], [-s, c]])
            z[at], z[j], live[at] = 0.0, r, False
        at = j
    if not live.any():
        return values, vectors
    poles, part = values[live], z[live]
    nearest, offset = secular_roots(poles, part * part, rho)
    # Distance of every root from every pole, and z anew from them: its eigenvectors are orthogonal.
    away = (poles[nearest][:, None] - poles[None, :]) + offset[:, None]
    n = len(poles)
    gaps = poles[None, :] - poles[:, None]
    np.fill_diagonal(gaps, 1.0)
    logs = np.log(np.maximum(np.abs(away), np.finfo(float).tiny)).sum(0) - np.log(np.abs(gaps)).sum(1)
    fresh = np.sign(part) * np.exp((logs - logs.max()) / 2)
    turn = fresh[:, None] / -np.where(away == 0, EPS * small, away).T
    turn /= np.sqrt((turn * turn).sum(0))
    out = values.copy()
    out[live] = poles[nearest] + offset
    vectors[:, live] = vectors[:, live] @ turn if n > 1 else vectors[:, live]
    order = np.argsort(out, kind="stable")
    return out[order], vectors[:, order]


class Spectrum:
    """Number of rows, mean, and eigenpairs of the scatter round the mean."""

    def __init__(self, rows: int, mean: np.ndarray, values: np.ndarray, vectors: np.ndarray):
        self.rows, self.mean, self.values, self.vectors = rows, mean, values, vectors

    @classmethod
    def empty(cls, size: int) -> Spectrum:
        return cls(0, np.zeros(size), np.zeros(size), np.eye(size))

    @classmethod
    def read(cls, raw: bytes) -> Spectrum:
        flat = np.frombuffer(raw, np.float64)
        size = math.isqrt(len(flat))  # rows + mean + values + vectors: 1 + 2 d + d * d
        d = size - 1
        return cls(int(flat[0]), flat[1 : d + 1], flat[d + 1 : 2 * d + 1], flat[2 * d + 1 :].reshape(d, d))

    def write(self) -> bytes:
        return np.concatenate(([self.rows], self.mean, self.values, self.vectors.ravel())).tobytes()

    def _add(self, x: np.ndarray) -> None:
        self.values, self.vectors = rank_one_update(self.values, self.vectors, x)

    def _move(self, rows: int, mean: np.ndarray) -> None:
        total = self.rows + rows
        self._add((mean - self.mean) * math.sqrt(self.rows * rows / total))
        self.mean = self.mean + (mean - self.mean) * (rows / total)
        self.rows = total

    def add_rows(self, x: np.ndarray) -> None:
        """A block of rows: updates with the rows of its triangular factor, then with its mean."""
        mean = x.mean(0)
        centred = x - mean
        for row in centred if len(x) <= x.shape[1] else np.linalg.qr(centred, mode="r"):
            self._add(row)
        self._move(len(x), mean)

    def add(self, other: Spectrum) -> None:
        """Another spectrum: one update for each of its eigenpairs, then for the means."""
        if not other.rows:
            return
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self._add(math.sqrt(value) * vector)
        self._move(other.rows, other.mean)


def integer_vectors(embeddings: DataFrame, vector_column: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """(vec_id, x) of the rows whose vector has only finite entries and the most frequent length."""
    v = F.col(vector_column)
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) < float(1 << 54), F.lit(False)))
    rows = embeddings.where(usable).select(
        F.col(id_column).cast("long").alias("vec_id"), F.transform(v, lambda c: F.floor(SCALE * c.cast("double"))).alias("x")
    )
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("x") == (lengths[0].d if lengths else 0))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, d)


def _folded(parts: DataFrame, combine: Callable[[list[bytes]], bytes]) -> bytes | None:
    """One value of rows (at, part), combined in the order of ``at``, ``FAN_IN`` in a task."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), pa.schema([("up", pa.int64()), ("at", pa.int64()), ("part", pa.binary())]))
        if not table.num_rows:
            return
        groups: dict[int, list[bytes]] = {}
        for row in table.sort_by("at").to_pylist():
            groups.setdefault(row["up"], []).append(row["part"])
        for up, found in groups.items():
            yield pa.RecordBatch.from_arrays([pa.array([up]), pa.array([combine(found)], pa.binary())], ["at", "part"])

    while True:
        parts = materialise(parts, "spectra")
        n = parts.agg(F.max("at").alias("n")).first().n
        if n is None:
            return None
        if n == 0:
            return parts.first().part
        up = F.floor(F.col("at") / FAN_IN)
        # A task gets a few groups of FAN_IN at most: as many partitions as groups.
        parts = parts.select(up.alias("up"), "at", "part").repartition(int(n // FAN_IN) + 1, "up").mapInArrow(fold, "at long, part binary")


def _per_partition(fit: DataFrame, work: Callable[[Iterator[np.ndarray]], bytes | None], d: int) -> DataFrame:
    """(at, part): ``work`` on the rows of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = work(_matrix(b.column(0), d) for b in batches if b.num_rows)
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([part], pa.binary())], ["at", "part"])

    return fit.select("x").mapInArrow(run, "at long, part binary")


def _sum(found: list[bytes]) -> bytes:
    return sum(np.frombuffer(x, np.float64) for x in found).tobytes()


def exact_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows, and the sum of each dimension, exact: upper and lower halves are summed apart."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), d)
            n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        at = np.arange(d + 1, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(high, 0)), pa.array(np.append(low, n))], ["at", "high", "low"])

    parts = fit.select("x").mapInArrow(add, "at int, high long, low long")
    sums = parts.groupBy("at").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]).collect()
    total = {r["at"]: (int(r.high) << 32) + int(r.low) for r in sums}
    return total.get(d, 0), [total.get(i, 0) for i in range(d)]


class Whitening:
    """Rows and sums of the fit list, eigenvalues by size, and their unit eigenvectors as columns."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray):
        self.n, self.sums, self.values, self.vectors = n, sums, values, vectors
        self.mean = np.array([s / n for s in sums]) if n else np.zeros(len(sums))
        self.components = int((values > LEAST * max(values[0], 0)).sum()) if len(values) and values[0] > 0 else 0

    def whiten(self, x: np.ndarray, components: int) -> np.ndarray:
        """Integer vectors, centred, projected on the first components, each of variance one."""
        return (x - self.mean) @ self.vectors[:, :components] / np.sqrt(self.values[:components])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """sum((n * x - sums)**2) of each row, exact; None beyond a long."""
        rough = ((self.n * x.astype(np.float64) - np.array(self.sums, np.float64)) ** 2).sum(1)
        if len(rough) == 0 or rough.max() < 2.0**62:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(1).tolist()
        out = [sum((self.n * c - s) ** 2 for c, s in zip(row, self.sums)) for row in x.tolist()]
        return [v if v < 1 << 63 else None for v in out]


def fit_whitening(fit: DataFrame) -> Whitening:
    """The principal axes of distinct integer vectors (x), read from a stored table."""
    first = fit.select(F.size("x").alias("d")).first()
    if first is None:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)))
    d = first.d
    n, sums = exact_sums(fit, d)
    mean = np.array([s / n for s in sums])

    def spectrum(blocks: Iterator[np.ndarray]) -> bytes | None:
        out = Spectrum.empty(d)
        for x in blocks:
            for lo in range(0, len(x), BLOCK):
                out.add_rows(x[lo : lo + BLOCK].astype(np.float64))
        return out.write() if out.rows else None

    def combined(found: list[bytes]) -> bytes:
        out = Spectrum.empty(d)
        for raw in found:
            out.add(Spectrum.read(raw))
        return out.write()

    basis = np.linalg.qr(Spectrum.read(_folded(_per_partition(fit, spectrum, d), combined)).vectors)[0]

    def projected(blocks: Iterator[np.ndarray]) -> bytes | None:
        total = np.zeros((d, d))
        for x in blocks:
            y = (x - mean) @ basis
            total += y.T @ y
        return total.tobytes()

    ritz = np.frombuffer(_folded(_per_partition(fit, projected, d), _sum), np.float64).reshape(d, d) / n
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    return Whitening(n, sums, values[::-1].copy(), (basis @ turn)[:, ::-1].copy())


def identity_error(fit: DataFrame, model: Whitening, components: int) -> float:
    """Largest entry of the whitened fit list's covariance less the identity, measured over all its rows."""
    d = len(model.sums)

    def covariance(blocks: Iterator[np.ndarray]) -> bytes | None:
        total = np.zeros((components, components))
        for x in blocks:
            z = model.whiten(x, components)
            total += z.T @ z
        return total.tobytes()

    found = np.frombuffer(_folded(_per_partition(fit, covariance, d), _sum), np.float64).reshape(components, components) / model.n
    return float(np.abs(found - np.eye(components)).max())


def whiten_embeddings(embeddings: DataFrame, components: int = 4, vector_column: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable row and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = integer_vectors(embeddings, vector_column, id_column)
    fit = materialise(rows.select("x").distinct(), "whitening-fit")
    model = fit_whitening(fit)
    k = min(components, model.components)
    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(fit, model, k)
    explained = model.values[:k] / model.values.sum()
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = _matrix(batch.column(1), len(model.sums))
            deviation = pa.array(model.deviations(x), pa.int64())
            z = model.whiten(x, k)
            for c in range(k):
                columns = [np.full(m, c + 1, np.int32), np.full(m, model.n), deviation, np.ascontiguousarray(z[:, c]), np.full(m, explained[c]), np.full(m, error)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], [f.split()[0] for f in schema.split(", ")])

    return rows.select("vec_id", "x").mapInArrow(whiten, schema)
