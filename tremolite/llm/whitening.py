"""Whitening of vectors: exact centred scatter, eigenvectors by cyclic Jacobi rotations, a broadcast projection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged

#: Steps of the integer grid in a unit, and the offset that the grid's numbers get.
GRID, OFFSET = 1024, 100_000
#: Grid numbers are held within this distance of the offset.
REACH = 1 << 40
#: Entries of vectors that a task works on at a time.
CELLS = 1 << 20
_EPS = np.finfo(float).eps
_EXACT, _LONG = 1 << 53, 1 << 62


def jacobi(a: np.ndarray, sweeps: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric positive semidefinite matrix.

    Sweeps go through all pairs in turn, half of the rows at a time against the other half (disjoint pairs, so their
    rotations commute), until no entry is more than rounding beside the diagonal entries of its row and column. This
    keeps small eigenvalues as accurate as large ones. An eigenvector's entry of largest magnitude is positive.
    """
    n = len(a)
    a, v = np.array(a, np.float64), np.eye(n)
    floor = _EPS * np.trace(a) / 1024
    seats = np.arange(n + n % 2)
    half = len(seats) // 2
    for _ in range(sweeps):
        turned = False
        for _ in range(max(0, len(seats) - 1)):
            one, two = seats[:half], seats[half:][::-1]
            p, q = np.minimum(one, two), np.maximum(one, two)
            p, q = p[q < n], q[q < n]
            off, pp, qq = a[p, q], a[p, p], a[q, q]
            far = np.abs(off) > np.maximum(floor, _EPS * np.sqrt(np.abs(pp * qq)))
            seats[1:] = np.roll(seats[1:], 1)
            if not far.any():
                continue
            turned = True
            p, q, off, pp, qq = p[far], q[far], off[far], pp[far], qq[far]
            theta = (qq - pp) / (2 * off)
            t = np.where(theta < 0, -1.0, 1.0) / (np.abs(theta) + np.hypot(1, theta))
            c = 1 / np.hypot(1, t)
            s = t * c
            for m in (a, v):
                left, right = m[:, p], m[:, q]
                m[:, p], m[:, q] = c * left - s * right, s * left + c * right
            up, down = a[p], a[q]
            a[p], a[q] = c[:, None] * up - s[:, None] * down, s[:, None] * up + c[:, None] * down
            a[p, p], a[q, q] = pp - t * off, qq + t * off
            a[p, q] = a[q, p] = 0
        if not turned:
            break
    order = np.argsort(-a.diagonal(), kind="stable")
    v = v[:, order]
    sign = np.sign(v[np.abs(v).argmax(0), np.arange(n)]) if n else np.ones(0)
    return np.maximum(0, a.diagonal()[order]), v * sign


@dataclass
class Whitening:
    """What was fitted: the number of vectors, exact sums of their grid numbers, eigenvalues (falling) and eigenvectors
    (columns) of the covariance, and its trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def centre(self) -> list[int]:
        """The grid number next to each dimension's mean."""
        return [(2 * s + self.n) // (2 * self.n) for s in self.sums]

    def projection(self, k: int) -> np.ndarray:
        """The whitening matrix of the first k components; a component without variance projects to 0."""
        e = self.values[:k]
        some = e > _EPS * self.trace
        return self.vectors[:, :k] * np.where(some, 1 / np.sqrt(np.where(some, e, 1)), 0)


def _parts(column: pa.Array, width: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, grid numbers less OFFSET) of the vectors of a length, or of every length in turn; vectors that are null,
    empty, or hold null or non-finite entries are left out."""
    column = column.cast(pa.large_list(pa.float64()))
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for w in [width] if width else np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == w)
        for i in range(0, len(rows), max(1, CELLS // w)):
            some = rows[i : i + max(1, CELLS // w)]
            flat = pc.list_flatten(column.take(pa.array(some)))
            x = pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False).reshape(-1, w)
            ok = np.isfinite(x).all(1)
            with np.errstate(over="ignore"):
                yield some[ok], np.clip(np.floor(GRID * x[ok]), -REACH, REACH).astype(np.int64)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per length and dimension: vectors and sum of grid numbers, one row for each in a partition."""
    held: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        for rows, x in _parts(batch.column(0)):
            n, s = held.get(x.shape[1], (0, 0))
            held[x.shape[1]] = (n + len(rows), s + x.sum(0).astype(object))
    for w, (n, s) in held.items():
        total = [int(v) + n * OFFSET for v in s]
        yield pa.RecordBatch.from_arrays([pa.array([w] * w, pa.int32()), pa.array(range(w), pa.int32()), pa.array([n] * w, pa.int64()), pa.array(list(map(Decimal, total)), pa.decimal128(38, 0))], ["width", "dim", "n", "s"])


def _scatter(centre: list[int]):
    """Products of centred grid numbers, summed exactly over a partition (within double precision for entries so
    large that a block's products pass 2^53)."""
    width = len(centre)
    shift = np.array([c - OFFSET for c in centre], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, bound = np.zeros((width, width), object), np.zeros((width, width), np.int64), 0
        for batch in batches:
            for rows, x in _parts(batch.column(0), width):
                if not len(rows):
                    continue
                y = x - shift
                most = int(np.abs(y).max()) ** 2 * len(rows)
                y = y.astype(np.float64)
                if most >= _EXACT:
                    total += np.vectorize(int, otypes=[object])(y.T @ y)
                    continue
                if bound + most >= _LONG:
                    total, held, bound = total + held.astype(object), np.zeros_like(held), 0
                held += (y.T @ y).astype(np.int64)
                bound += most
        total = total + held.astype(object)
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(int(v)) for v in total[i, j]], pa.decimal128(38, 0))], ["i", "j", "v"])

    return run


def _centred(model: Whitening):
    """A function from grid numbers less OFFSET to n * x - S, in long integers where these hold it, else in Python's."""
    n = model.n
    shift = np.array([c - OFFSET for c in model.centre], np.int64)
    rest = np.array([s - n * c for s, c in zip(model.sums, model.centre, strict=True)], object)

    def run(x: np.ndarray) -> np.ndarray:
        y = x - shift
        if n * (int(np.abs(y).max(initial=0)) + 1) < _LONG:
            return n * y - rest.astype(np.int64)
        return n * y.astype(object) - rest

    return run


def _vectors(df: DataFrame, vector_col: str) -> DataFrame:
    return df.select(F.col(vector_col).cast("array<double>").alias("vector"))


def fit_whitening(df: DataFrame, vector_col: str = "embedding") -> Whitening | None:
    """Fit on all usable vectors of ``df``: those not null or empty and without null or non-finite entries.

    Every entry c, in double precision, becomes the grid number floor(1024 c) + 100,000; beyond 2^40 grid steps
    from 0 it is held there. One pass sums the grid numbers exactly; a second one subtracts the integer next to
    the mean and sums the products of what is left, exactly too, so the covariance (divisor n) is that of exact
    arithmetic, rounded once, however the rows lie in partitions. Only sums for each pair of dimensions reach
    the driver, which diagonalises by ``jacobi``.

    Vectors of other lengths than the commonest (the shorter of equals) have no place in one covariance: they are
    neither fitted nor whitened. Repeated rows count each. None if no vector is usable. Other columns are ignored.
    """
    rows = _vectors(df, vector_col)
    sums = rows.mapInArrow(_sums, "width int, dim int, n long, s decimal(38,0)").groupBy("width", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    sums = staged(sums)
    top = sums.where("dim = 0").orderBy(F.desc("n"), "width").first()
    if top is None:
        return None
    found = {r["dim"]: int(r["s"]) for r in sums.where(F.col("width") == top["width"]).collect()}
    n, s = top["n"], [found[d] for d in range(top["width"])]
    model = Whitening(n, s, np.zeros(0), np.zeros((0, 0)), 0.0)
    centre = model.centre
    cells = rows.mapInArrow(_scatter(centre), "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    rest, v = [a - n * c for a, c in zip(s, centre, strict=True)], np.zeros((len(s), len(s)))
    for i, j, x in cells:
        v[i, j] = v[j, i] = (n * int(x) - rest[i] * rest[j]) / (n * n)
    model.values, model.vectors = jacobi(v)
    model.trace = float(np.trace(v))
    return model


def whiten(df: DataFrame, model: Whitening, k: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, ``deviation`` (sum over dimensions of (n x - S)^2, exact) and ``whitened`` (the first ``k`` components, as
    many as there are dimensions at most) of every row that could be fitted.

    Rows keep their ids, null or repeated; the other rows are left out. A component without variance is 0 in every row.
    A deviation of more than 38 digits is null. Nothing is shuffled. Empty table: empty result.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    kind, width, centred = rows.schema["id"].dataType.simpleString(), len(model.sums), _centred(model)
    n, sent = model.n, df.sparkSession.sparkContext.broadcast(model.projection(k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _parts(batch.column(1), width):
                z = centred(x)
                if z.dtype != object and int(np.abs(z).max(initial=0)) ** 2 * width < _LONG:
                    deviation = pa.array((z * z).sum(1)).cast(pa.decimal128(38, 0))
                else:
                    exact = (z.astype(object) ** 2).sum(1)
                    deviation = pa.array([Decimal(d) if d < 10**38 else None for d in exact], pa.decimal128(38, 0))
                w = (z.astype(np.float64) / n) @ sent.value
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), deviation, lists], ["id", "deviation", "whitened"])

    return rows.mapInArrow(run, f"id {kind}, deviation decimal(38,0), whitened array<double>").withColumnRenamed("id", id_col)


def identity_error(whitened: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the covariance (divisor n) of ``whitened`` rows less the identity, over components
    with variance. Sums for pairs of components are all that leaves a task."""
    some = np.flatnonzero(model.values > _EPS * model.trace)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            if not len(column):
                continue
            w = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
            w = np.hstack([w, np.ones((len(w), 1))])
            i, j = np.triu_indices(w.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array((w.T @ w)[i, j])], ["i", "j", "v"])

    sums = whitened.select("whitened").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    found = {(r["i"], r["j"]): r["v"] for r in sums}
    k = max([0, *(j for _, j in found)])
    error = 0.0
    for i, j in found:
        if j < k and i in some and j in some:
            mean = found[i, k] / model.n * (found[j, k] / model.n)
            error = max(error, abs(found[i, j] / model.n - mean - (i == j)))
    return error
