"""Vectors, matrices and index sets: arrays as column expressions, large matrices in long form (i, j, v)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

ARRAY = ArrayType(DoubleType())


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def norm(x: Column) -> Column:
    """2-norm."""
    return F.sqrt(_total(F.transform(x, lambda v: v * v)))


def p_norm(x: Column, p: float) -> Column:
    """p-norm; p = 0 gives the largest absolute component."""
    if p == 0:
        return F.array_max(F.transform(x, F.abs))
    return F.pow(_total(F.transform(x, lambda v: F.pow(F.abs(v), F.lit(float(p))))), F.lit(1 / p))


def normalized(x: Column) -> Column:
    """x over its norm; a zero vector stays."""
    n = norm(x)
    return F.transform(x, lambda v: F.when(n > 0, v / n).otherwise(v))


def zero(x: Column) -> Column:
    return F.transform(x, lambda v: F.lit(0.0))


def resized(x: Column, size: int) -> Column:
    """The first ``size`` components, zeros after the end."""
    return F.slice(F.concat(x, F.array_repeat(F.lit(0.0), size)), 1, size)


def combined(x: Column, a: float, y: Column, b: float) -> Column:
    """a x + b y."""
    return F.zip_with(x, y, lambda u, v: u * a + v * b)


def gathered(x: Column, at: Column) -> Column:
    """Components at 0-based places; null out of bounds."""
    return F.transform(at, lambda i: F.get(x, i))


def placed(x: Column, y: Column, offset: int, factor: float = 1.0) -> Column:
    """x with factor y added from ``offset`` on; what falls outside is left out."""
    return F.transform(x, lambda v, i: v + F.coalesce(F.when(i >= offset, F.get(y, i - offset)), F.lit(0.0)) * factor)


def extracted(x: Column, offset: int, size: int) -> Column:
    return F.slice(x, offset + 1, size)


def scaled(x: Column, op: str, value: float) -> Column:
    """x with a number added, subtracted, multiplied or divided, component by component."""
    return F.transform(x, {"+": lambda v: v + value, "-": lambda v: v - value, "*": lambda v: v * value, "/": lambda v: v / value}[op])


def dot(x: Column, y: Column) -> Column:
    return _total(F.zip_with(x, y, lambda u, v: u * v))


def outer(x: Column, y: Column) -> Column:
    """Matrix of products, row by row."""
    return F.transform(x, lambda u: F.transform(y, lambda v: u * v))


def equals(x: Column, value: float) -> Column:
    """Whether all components are the value."""
    return F.forall(x, lambda v: v == value)


def mat_vec(m: Column, x: Column) -> Column:
    """Matrix times vector, the matrix as an array of rows."""
    return F.transform(m, lambda row: dot(row, x))


def transposed(m: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(m[0]) - 1), lambda j: F.transform(m, lambda row: F.get(row, j)))


# index sets


def inserted(ids: Column, value: Column) -> Column:
    """Sorted set with a value in it once."""
    return F.array_sort(F.array_distinct(F.concat(ids, F.array(value))))


def location(ids: Column, value: Column) -> Column:
    """0-based place of a value, -1 if absent."""
    return (F.array_position(ids, value) - 1).cast("int")


def without(ids: Column, value: Column) -> Column:
    return F.array_remove(ids, value)


def unique(ids: Column) -> Column:
    return F.array_sort(F.array_distinct(ids))


def filled(value: Column, size: int) -> Column:
    return F.array_repeat(value, size)


def before(a: Column, b: Column) -> Column:
    """Lexical order of two index sets."""
    return a < b


# long form


def assemble(entries: DataFrame, dof_map: DataFrame, by: list[str], value: str = "v") -> DataFrame:
    """Scatter-add of element vectors: entries (element, local, v) go to the equations of ``dof_map``
    (element, local, equation >= 0) and add up, with partial sums before the shuffle."""
    rows = entries.join(dof_map.where("equation >= 0"), by)
    return rows.groupBy("equation").agg(F.sum(value).alias("value"))


def assemble_matrix(entries: DataFrame, dof_map: DataFrame, transpose: bool = False) -> DataFrame:
    """Scatter-add of element matrices (element, i, j, v) into (row, col, value)."""
    rows = dof_map.where("equation >= 0")
    at = lambda c, to: rows.select("element", F.col("local").alias(c), F.col("equation").alias(to))
    r, c = ("col", "row") if transpose else ("row", "col")
    joined = entries.join(at("i", r), ["element", "i"]).join(at("j", c), ["element", "j"])
    return joined.groupBy("row", "col").agg(F.sum("v").alias("value"))


def multiply(a: DataFrame, b: DataFrame, transpose_a: bool = False) -> DataFrame:
    """Product of long matrices (i, j, v), or of a's transpose with b."""
    i, k = ("j", "i") if transpose_a else ("i", "j")
    left = a.select(F.col(i).alias("i"), F.col(k).alias("k"), F.col("v").alias("u"))
    right = b.select(F.col("i").alias("k"), "j", "v")
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("u") * F.col("v")).alias("v"))


def triple(t: DataFrame, b: DataFrame, c: DataFrame | None = None) -> DataFrame:
    """tᵀ b t, or tᵀ b c."""
    return multiply(t, multiply(b, t if c is None else c), transpose_a=True)


def added(a: DataFrame, fa: float, b: DataFrame, fb: float, transpose_b: bool = False) -> DataFrame:
    """fa a + fb b of long matrices."""
    i, j = ("j", "i") if transpose_b else ("i", "j")
    both = a.select("i", "j", (F.col("v") * fa).alias("v")).unionByName(b.select(F.col(i).alias("i"), F.col(j).alias("j"), (F.col("v") * fb).alias("v")))
    return both.groupBy("i", "j").agg(F.sum("v").alias("v"))


def times_vector(a: DataFrame, x: DataFrame, transpose: bool = False) -> DataFrame:
    """Long matrix times vector (i, v)."""
    i, k = ("j", "i") if transpose else ("i", "j")
    rows = a.select(F.col(i).alias("i"), F.col(k).alias("k"), F.col("v").alias("u")).join(x.select(F.col("i").alias("k"), "v"), "k")
    return rows.groupBy("i").agg(F.sum(F.col("u") * F.col("v")).alias("v"))


def diagonal(a: DataFrame) -> DataFrame:
    return a.where("i = j").select("i", "v")


def sub_matrix(a: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """Entries whose row and column are listed."""
    return a.join(rows.select("i"), "i", "left_semi").join(cols.select("j"), "j", "left_semi")


# small dense systems, one per row, in Arrow batches


def _stack(m: pd.Series) -> list[np.ndarray]:
    return [np.array([np.asarray(r, float) for r in x], float) for x in m]


@F.pandas_udf(ARRAY)
def solved(m: pd.Series, b: pd.Series) -> pd.Series:
    """x of m x = b; null if m is singular."""

    def one(a: np.ndarray, y: np.ndarray) -> list[float] | None:
        try:
            return np.linalg.solve(a, np.asarray(y, float)).tolist()
        except np.linalg.LinAlgError:
            return None

    return pd.Series([one(a, y) for a, y in zip(_stack(m), b, strict=True)])


@F.pandas_udf(ArrayType(ARRAY))
def inverted(m: pd.Series) -> pd.Series:
    """Inverse of a square matrix; null if it is singular."""

    def one(a: np.ndarray) -> list[list[float]] | None:
        try:
            return np.linalg.inv(a).tolist()
        except np.linalg.LinAlgError:
            return None

    return pd.Series([one(a) for a in _stack(m)])


@F.pandas_udf(ARRAY)
def eigenvalues(m: pd.Series) -> pd.Series:
    """Eigenvalues of a symmetric matrix, rising."""
    return pd.Series([np.linalg.eigvalsh(a).tolist() for a in _stack(m)])


def rotation(axis: Column, angle: Column) -> Column:
    """Rotation matrix of an axis (not zero) and an angle, by Rodrigues' formula."""
    u = normalized(axis)
    x, y, z = (F.get(u, F.lit(i)) for i in range(3))
    c, s = F.cos(angle), F.sin(angle)
    t = 1 - c
    return F.array(F.array(c + x * x * t, x * y * t - z * s, x * z * t + y * s), F.array(y * x * t + z * s, c + y * y * t, y * z * t - x * s), F.array(z * x * t - y * s, z * y * t + x * s, c + z * z * t))


def versor(axis: Column, angle: Column) -> Column:
    """Unit quaternion (scalar first) of an axis and an angle."""
    u, half = normalized(axis), angle / 2
    return F.concat(F.array(F.cos(half)), F.transform(u, lambda v: v * F.sin(half)))


def versor_product(p: Column, q: Column) -> Column:
    """Product of two quaternions, scalar first."""
    a, b = [p[i] for i in range(4)], [q[i] for i in range(4)]
    return F.array(
        a[0] * b[0] - a[1] * b[1] - a[2] * b[2] - a[3] * b[3], a[0] * b[1] + a[1] * b[0] + a[2] * b[3] - a[3] * b[2],
        a[0] * b[2] - a[1] * b[3] + a[2] * b[0] + a[3] * b[1], a[0] * b[3] + a[1] * b[2] - a[2] * b[1] + a[3] * b[0],
    )


def cross(x: Column, y: Column) -> Column:
    """Vector product in space."""
    return F.array(x[1] * y[2] - x[2] * y[1], x[2] * y[0] - x[0] * y[2], x[0] * y[1] - x[1] * y[0])
