"""Embedding whitening by incremental eigendecomposition.

Vectors become integers, floor(256 * entry).  The fit list is each distinct
integer vector once.  A task keeps the spectrum (mean, eigenvalues,
eigenvectors) of the rows it has seen; a new row changes the scatter matrix by
a rank-one term of the row centred on the mean so far, and the new spectrum
comes from the roots of the secular equation

    1 + rho * sum_i z_i**2 / (d_i - x) = 0,        z = U' (row - mean).

Deflation: a direction that the row does not touch keeps its eigenpair, and
equal eigenvalues are turned by a reflection so that the row touches only one.
Spectra of tasks are combined in groups, round after round, by the rank-one
terms of the smaller one and one term for the difference of their means.

The combined eigenvectors are then refined: tasks project the centred rows on
them, the sums of products of the projections are added up (distributed
Rayleigh-Ritz), and the small matrix is solved.  The refinement is exact to
double precision, also where rank-one steps have lost a few digits.

The driver holds a few matrices of dimension x dimension, never rows.

Defined cases: rows whose vector is null, empty, or holds a null, NaN or
infinite entry are dropped, and so are rows of another dimension than the most
frequent one (the larger among equals); repeated rows count once in the fit
list and are each returned; directions without variance are no components, so
a table of one distinct vector gives no rows, and neither does an empty table;
ties of eigenvalues are broken arbitrarily, but the same for all rows; a
null vec_id stays null; a deviation beyond a long is null; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statline.llm.components import stored

SCALE = 256
# Spectra that one task combines in a round.
GROUP = 16
_EPS = np.finfo(np.float64).eps
# Roots are sought to this part of the equation's size: the refinement mends
# what is left, and eigenvectors are orthogonal for any roots.
ROOT_ERROR = 1e-11


def secular_roots(d: np.ndarray, z2: np.ndarray, rho: float, error: float = ROOT_ERROR):
    """Roots of 1 + rho * sum(z2 / (d - x)) for ascending distinct d and
    positive z2, rho.  Returns each root's nearest pole and its distance from
    it: root j lies between d[j] and d[j+1].

    An iteration keeps the nearest pole's weight and fits the next pole's
    weight and a constant to the value and the slope; a step that leaves the
    bracket is replaced by its middle."""
    n = len(d)
    gap = np.append(np.diff(d), rho * z2.sum())
    col = np.arange(n)
    mid = d[:, None] - (d + gap / 2)[None, :]
    left = 1 + rho * (z2[:, None] / mid).sum(axis=0) > 0
    left[-1] = True
    near = np.where(left, col, np.minimum(col + 1, n - 1))
    delta = d[:, None] - d[near][None, :]
    other = np.where(left, gap, -gap)
    other[-1] *= 2  # there is no pole beyond the last one
    lo = np.where(left, 0.0, -gap / 2)
    hi = np.where(left, gap / 2, 0.0)
    hi[-1] = gap[-1]
    weights = rho * z2[:, None]
    weight = rho * z2[near]
    x = (lo + hi) / 2
    for _ in range(60):
        away = delta - x
        part = weights / away
        f = 1 + part.sum(axis=0)
        size = 1 + np.abs(part).sum(axis=0)
        done = np.abs(f) <= error * size
        if done.all():
            break
        part /= away
        slope = part.sum(axis=0)
        up = f < 0  # f grows from -inf to inf between poles
        lo, hi = np.where(up, x, lo), np.where(up, hi, x)
        # f = c + weight / (0 - x) + w / (other - x), slope alike
        far = other - x
        w = (slope - weight / x**2) * far**2
        c = f + weight / x - w / far
        # c x (other - x) - weight (other - x) + w x = 0
        b = -(c * other + weight + w)
        q = weight * other
        root = np.sqrt(np.maximum(b * b - 4 * c * q, 0))
        t = -(b + np.copysign(root, b)) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            one, two = t / c, q / t
        step = np.where((one >= lo) & (one <= hi), one, two)
        inside = (step >= lo) & (step <= hi) & (step != 0)
        new = np.where(done, x, np.where(inside, step, (lo + hi) / 2))
        if (new == x).all():
            break
        x = new
    return near, x


class Spectrum:
    """Eigenvalues (ascending) and eigenvectors of the scatter matrix of the
    rows seen so far, with their number, mean and exact sum."""

    def __init__(self, dimension: int):
        self.n, self.mean = 0, np.zeros(dimension)
        self.sum = np.zeros(dimension, dtype=np.int64)
        self.values, self.vectors = np.zeros(dimension), np.eye(dimension)

    def add(self, row: np.ndarray) -> None:
        """A new row: its centred rank-one term and the new mean."""
        self.n += 1
        self.sum += row
        v = row - self.mean
        if self.n > 1:
            self.rank_one((self.n - 1) / self.n, v)
        self.mean += v / self.n

    def merge(self, other: Spectrum) -> None:
        """The rows of another spectrum, by successive rank-one terms."""
        if not other.n:
            return
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.rank_one(value, vector)
        between = other.mean - self.mean
        n = self.n + other.n
        if self.n:
            self.rank_one(self.n * other.n / n, between)
        self.mean += between * (other.n / n)
        self.n, self.sum = n, self.sum + other.sum

    def rank_one(self, rho: float, v: np.ndarray) -> None:
        """The spectrum of the matrix plus rho v v'."""
        z = v @ self.vectors
        norm = float(z @ z)
        if norm == 0:
            return
        d = self.values
        tiny = 8 * _EPS * max(d[-1], rho * norm)
        close = np.flatnonzero(np.diff(d) <= tiny)
        if len(close):
            self._reflect(z, close)
        live = np.flatnonzero(rho * np.abs(z) * np.sqrt(norm) > tiny)
        if not len(live):
            return
        poles, z2 = d[live], z[live] ** 2
        near, x = secular_roots(poles, z2, rho)
        # distances of poles and roots, in full relative precision
        away = (poles[:, None] - poles[near][None, :]) - x[None, :]
        # weights for which the computed roots are exact (they keep the
        # eigenvectors orthogonal)
        below = poles[:, None] - poles[None, :]
        np.fill_diagonal(below, 1.0)
        ratio = away / below
        exact = np.sqrt(np.abs(ratio.prod(axis=1)))
        turn = np.copysign(exact, z[live])[:, None] / away
        turn /= np.sqrt((turn * turn).sum(axis=0))
        self.values = d.copy()
        self.values[live] = poles[near] + x
        self.vectors[:, live] = self.vectors[:, live] @ turn
        if (np.diff(self.values) < 0).any():
            order = np.argsort(self.values, kind="stable")
            self.values, self.vectors = self.values[order], self.vectors[:, order]

    def _reflect(self, z: np.ndarray, close: np.ndarray) -> None:
        """Turns each run of equal eigenvalues so that z has one entry there."""
        cut = np.flatnonzero(np.diff(close) > 1) + 1
        for run in np.split(close, cut):
            a, b = int(run[0]), int(run[-1]) + 2
            h = z[a:b].copy()
            size = np.sqrt(h @ h)
            if size == 0 or np.count_nonzero(h) == 1:
                continue
            h[-1] += np.copysign(size, h[-1])
            part = self.vectors[:, a:b]
            part -= np.outer(part @ h, h * (2 / (h @ h)))
            z[a:b] = 0
            z[b - 1] = -np.copysign(size, h[-1])
            self.values[a:b] = self.values[a:b].mean()

    _FIELDS = "n long, sum binary, mean binary, vals binary, vectors binary"

    def row(self) -> dict:
        return {"n": self.n, "sum": self.sum.tobytes(), "mean": self.mean.tobytes(),
                "vals": self.values.tobytes(), "vectors": self.vectors.tobytes()}

    @staticmethod
    def of(row) -> Spectrum:
        out = Spectrum(len(row["mean"]) // 8)
        out.n = int(row["n"])
        out.sum = np.frombuffer(row["sum"], np.int64).copy()
        out.mean, out.values = (np.frombuffer(row[c]).copy() for c in ("mean", "vals"))
        out.vectors = np.frombuffer(row["vectors"]).reshape(len(out.mean), -1).copy()
        return out


def integers(name: str = "embedding") -> Column:
    """The vector in units of 1/SCALE, or null where an entry is unusable."""
    entry = F.col(name)
    usable = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c.cast("double"))
                      & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return F.when((F.size(entry) > 0) & usable, F.transform(
        entry, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("long")))


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), dimension)


def spectrum(vectors: DataFrame, dimension: int) -> Spectrum | None:
    """The spectrum of all rows of column x; None for an empty table."""
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spectrum(dimension)
        for batch in batches:
            for row in matrix(batch.column("x"), dimension):
                own.add(row)
        if own.n:
            yield pa.RecordBatch.from_pylist([own.row()])

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, Spectrum] = {}
        for batch in batches:
            for row in batch.to_pylist():
                part = Spectrum.of(row)
                if row["slot"] not in own:
                    own[row["slot"]] = part
                else:
                    small, large = sorted((part, own[row["slot"]]), key=lambda s: s.n)
                    large.merge(small)
                    own[row["slot"]] = large
        for part in own.values():
            yield pa.RecordBatch.from_pylist([part.row()])

    have = stored(vectors.mapInArrow(local, Spectrum._FIELDS), "spectra")
    count = have.count()
    while count > 1:
        slots = -(-count // GROUP)
        slot = F.pmod(F.xxhash64(F.col("mean")), F.lit(slots)).cast("long")
        have = stored(have.withColumn("slot", slot).repartition(slots, "slot")
                      .mapInArrow(combined, Spectrum._FIELDS), "spectra")
        count = have.count()
    rows = have.collect()
    return Spectrum.of(rows[0]) if rows else None


def _products(vectors: DataFrame, dimension: int, centre: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Sums of products of the rows, centred and projected on the basis."""
    size = basis.shape[1]
    above = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            y = (matrix(batch.column("x"), dimension) - centre) @ basis
            total += y.T @ y
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(above[0]), dtype=np.int32)), pa.array(total[above])],
            names=["cell", "total"])

    cells = vectors.mapInArrow(run, "cell int, total double").groupBy("cell").agg(F.sum("total").alias("total"))
    out = np.zeros((size, size))
    for r in cells.collect():
        i, j = above[0][r.cell], above[1][r.cell]
        out[i, j] = out[j, i] = r.total
    return out


class Whitening:
    """n, exact sums, centre, components (columns) by falling variance, their
    variances, the trace of the covariance and the identity error."""

    def __init__(self, n: int, sums: np.ndarray, components: np.ndarray, variances: np.ndarray,
                 trace: float, identity_error: float):
        self.n, self.sums, self.components, self.variances = n, sums, components, variances
        self.trace, self.identity_error = trace, identity_error
        self.centre = sums / n

    def deviation(self, x: np.ndarray) -> list:
        """Exact sum of (n x - sum)**2 of every row; None beyond a long."""
        bound = self.n * max(1, int(np.abs(x).max(initial=0))) + int(np.abs(self.sums).max(initial=0))
        if bound * bound * x.shape[1] < 1 << 62:
            return (((self.n * x - self.sums) ** 2).sum(axis=1)).tolist()
        far = self.n * x.astype(object) - self.sums.astype(object)
        return [v if v < 1 << 63 else None for v in (far * far).sum(axis=1)]


def fit(vectors: DataFrame, dimension: int) -> Whitening | None:
    """Whitening of the distinct rows of column x (None without rows)."""
    found = spectrum(vectors, dimension)
    if found is None:
        return None
    centre = found.sum / found.n
    basis, _ = np.linalg.qr(found.vectors)
    values, turn = np.linalg.eigh(_products(vectors, dimension, centre, basis) / found.n)
    values, components = values[::-1], (basis @ turn)[:, ::-1]
    trace = float(values.sum())
    some = values > dimension * _EPS * max(values[0], 0) * 16
    values, components = values[some], components[:, some]
    first = min(4, len(values))
    error = 0.0
    if first:
        white = components[:, :first] / np.sqrt(values[:first])
        error = float(np.abs(_products(vectors, dimension, centre, white) / found.n - np.eye(first)).max())
    return Whitening(found.n, found.sum, components, values, trace, error)


def usable(table: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Rows (vec_id, x) that remain, the stored fit list, and the dimension."""
    rows = (table.select(F.col("vec_id").cast("long").alias("vec_id"), integers().alias("x"))
            .filter("x is not null"))
    distinct = stored(rows.select("x").groupBy("x").agg(F.lit(1).alias("one")).select("x"), "fit_list")
    sizes = rows.groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("rows"))
    most = sizes.orderBy(F.desc("rows"), F.desc("size")).first()
    dimension = int(most["size"]) if most else 0
    return (rows.filter(F.size("x") == dimension), distinct.filter(F.size("x") == dimension), dimension)


_OUT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
        "identity_error double")


def whitened(table: DataFrame, components: int = 4) -> DataFrame:
    """One row for every remaining row and component."""
    rows, vectors, dimension = usable(table)
    model = fit(vectors, dimension) if dimension else None
    if model is None:
        return rows.sparkSession.createDataFrame([], _OUT)
    k = min(components, len(model.variances))
    white = model.components[:, :k] / np.sqrt(model.variances[:k])
    explained = model.variances[:k] / model.trace if k else np.zeros(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), dimension)
            y = (x - model.centre) @ white
            n = len(x)
            each = pa.array(np.repeat(np.arange(n), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                 pa.array(np.full(n * k, model.n, dtype=np.int64)),
                 pa.array(model.deviation(x), pa.int64()).take(each), pa.array(y.ravel()),
                 pa.array(np.tile(explained, n)), pa.array(np.full(n * k, model.identity_error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained",
                       "identity_error"])

    return rows.mapInArrow(run, _OUT)
