"""Roots along lines for every row of a table, and response surfaces fitted by distributed sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .parallel import written


def line_root(g: Callable[[Column], Column], low: float | Column, high: float | Column, steps: int = 104) -> Column:
    """Where g changes its sign between ``low`` and ``high``, as one column expression; null if it has one sign at both
    ends, or is null or not a number there.

    ``g`` gives the value at a distance and may look at the row's columns. All rows step alike: a false position and
    a halving in turn, each keeping the half whose ends differ in sign, so the bracket shrinks by 2^-52 at least
    in the default number of steps. The steps run over an array inside the expression, and the plan doesn't grow with them.
    """
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    state = lambda a, fa, b, fb: F.struct(a.alias("a"), fa.alias("fa"), b.alias("b"), fb.alias("fb"))

    def halved(s: Column, k: Column) -> Column:
        middle = (s["a"] + s["b"]) / 2
        secant = s["a"] - s["fa"] * (s["b"] - s["a"]) / F.nullif(s["fb"] - s["fa"], F.lit(0.0))
        inside = (secant > F.least(s["a"], s["b"])) & (secant < F.greatest(s["a"], s["b"]))
        at = F.when((k % 2 == 1) & inside, secant).otherwise(middle)
        return F.struct(s["a"].alias("a"), s["fa"].alias("fa"), s["b"].alias("b"), s["fb"].alias("fb"), at.alias("m"))

    def valued(s: Column) -> Column:
        return F.struct(*(s[c].alias(c) for c in ("a", "fa", "b", "fb", "m")), g(s["m"]).alias("fm"))

    def kept(s: Column) -> Column:
        left = F.signum(s["fm"]) * F.signum(s["fa"]) <= 0
        pick = lambda yes, no: F.when(left, yes).otherwise(no)
        return state(pick(s["a"], s["m"]), pick(s["fa"], s["fm"]), pick(s["m"], s["b"]), pick(s["fm"], s["fb"]))

    # one-element arrays name what a step computes, so that g is worked out once in it
    step = lambda s, k: F.get(F.transform(F.transform(F.transform(F.array(s), lambda x: halved(x, k)), valued), kept), F.lit(0))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state(low, g(low), high, g(high)), step, lambda s: (s["a"] + s["b"]) / 2)
    crosses = F.signum(g(low)) * F.signum(g(high)) <= 0
    return F.when(crosses & ~F.isnan(g(low)) & ~F.isnan(g(high)), found)


def roots(g: Callable[..., np.ndarray], low: np.ndarray, high: np.ndarray, steps: int = 55) -> np.ndarray:
    """Where ``g`` changes its sign between ``low`` and ``high``, for many rows in lockstep; NaN where it has one sign at both
    ends, or is not a number there.

    ITP steps: a false position, pushed a little towards the middle so that the root gets between it and the nearer end, and held so
    near the middle that the bracket shrinks by 2^-52 at least in the default number of steps, as by halving; near a
    simple root a few do. Ends when every bracket is that narrow or has met its root.
    """
    a, b = np.array(low, float), np.array(high, float)
    fa, fb = g(a), g(b)
    with np.errstate(all="ignore"):
        wide = np.abs(b - a)
        unit = wide * 2.0**-52
        ok = np.sign(fa) * np.sign(fb) <= 0
        for k in range(steps):
            width = b - a
            if not np.any(ok & (np.abs(width) > unit)):
                break
            middle = a + width / 2
            secant = a - fa * width / (fb - fa)
            secant = np.where(np.isfinite(secant), secant, middle)
            aside = np.maximum(0.2 * width * width / wide, unit / 2)
            pushed = np.where(np.abs(middle - secant) <= aside, middle, secant + np.sign(middle - secant) * aside)
            spare = np.maximum(unit / 2 * 2.0 ** (steps - 1 - k) - np.abs(width) / 2, 0.0)
            m = np.where(np.abs(pushed - middle) <= spare, pushed, middle + np.sign(pushed - middle) * spare)
            fm = g(m)
            left, met = np.sign(fm) * np.sign(fa) <= 0, fm == 0
            a, fa, b, fb = (np.where(met, x, np.where(left, y, z)) for x, y, z in ((m, a, m), (fm, fa, fm), (m, m, b), (fm, fm, fb)))
        return np.where(ok, (a + b) / 2, np.nan)


def line_roots(g: Callable[..., np.ndarray], low: float, high: float, *columns: str | Column) -> Column:
    """``roots`` of g(distances, *values of the columns) for every row, a batch of rows at a time; null where there is none or a value
    is null. For millions of rows: ``line_root`` takes any expression, but evaluates it row by row."""

    def each(*values: pd.Series) -> pd.Series:
        at = [v.to_numpy(float, na_value=np.nan) for v in values]
        n = len(values[0])
        found = roots(lambda r: g(r, *at), np.full(n, float(low)), np.full(n, float(high)))
        return pd.Series(found)

    return F.pandas_udf(each, "double")(*columns)


def _products(terms: list[Column], y: Column, weight: Column | None) -> list[Column]:
    """Sums of the products of terms with one another and with y."""
    w = F.lit(1.0) if weight is None else weight
    k = len(terms)
    own = [F.sum(w * terms[i] * terms[j]) for i in range(k) for j in range(i, k)]
    return [F.array(*own).alias("__g"), F.array(*(F.sum(w * t * y) for t in terms)).alias("__v")]


def _solved(k: int):
    """Coefficients of every group's normal equations, scaled by their diagonals; the least ones where a term adds nothing new."""
    i, j = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            of = lambda c, m: np.array(batch.column(c).to_pylist(), float).reshape(n, m)  # noqa: B023, E731
            names = batch.schema.names
            flat, v = of(names.index("__g"), len(i)), of(names.index("__v"), k)
            a = np.zeros((n, k, k))
            a[:, i, j] = a[:, j, i] = flat
            scale = np.sqrt(np.maximum(a[:, range(k), range(k)], 0))
            scale[scale == 0] = 1
            a /= scale[:, :, None] * scale[:, None]
            c = (np.linalg.pinv(a, rcond=1e-13, hermitian=True) @ (v / scale)[:, :, None])[:, :, 0] / scale
            keep = [x for x in range(len(names)) if names[x] not in ("__g", "__v")]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in keep), pa.array(c.tolist(), pa.list_(pa.float64()))], [*(names[x] for x in keep), "coefficients"])

    return run


def least_squares(rows: DataFrame, by: list[str], terms: list[Column], y: Column, weight: Column | None = None) -> DataFrame:
    """by, ``n`` and ``coefficients`` (one for each term) of the least squares of y on the terms in every group.

    A row whose y or any term is null counts for nothing; groups without rows give none. Only sums of products leave
    a task, whatever the size of a group; terms that depend on one another share their effect.
    """
    whole = y.isNotNull()
    for t in terms:
        whole &= t.isNotNull()
    sums = rows.where(whole).groupBy(*by).agg(F.count("*").alias("n"), *_products(terms, y, weight))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.schema if f.name not in ("__g", "__v"))
    return sums.mapInArrow(_solved(len(terms)), f"{schema}, coefficients array<double>")


def response_surface(rows: DataFrame, by: list[str], xs: list[str], y: str, width: float = 1.0, tol: float = 1e-3, rounds: int = 12) -> DataFrame:
    """by, ``n``, ``coefficients`` of 1, every x and every x squared, ``point``, ``beta`` and ``rounds`` of each group.

    The first surface is fitted to all rows alike. Its design point, the one next to the origin where the surface's
    tangent is 0, is the centre of the next fit, in which rows count by exp(-d^2 / 2 width^2) of their distance d
    from it; and so on until the point moves by ``tol`` at most, or for ``rounds``. Every round sums over all rows
    of the groups that still move. A surface without slope keeps its point. xs are standard normal variables.
    """
    k = len(xs)
    origin = F.array(*(F.lit(0.0) for _ in xs))
    terms = [F.lit(1.0), *(F.col(x) for x in xs), *(F.col(x) * F.col(x) for x in xs)]
    open_, done = None, None
    for turn in range(1, rounds + 1):
        if open_ is None:
            fit = least_squares(rows, by, terms, F.col(y)).withColumn("__c", origin)
        else:
            centres = open_.select(*by, F.col("point").alias("__c"))
            distance = sum(((F.col(x) - F.get("__c", F.lit(i))) ** 2 for i, x in enumerate(xs)), F.lit(0.0))
            fit = least_squares(rows.join(centres, by), [*by, "__c"], terms, F.col(y), F.exp(-distance / (2 * width * width)))
        b = lambda i: F.get("coefficients", F.lit(i))
        c = lambda i: F.get("__c", F.lit(i))
        fit = fit.withColumn("__s", F.array(*(b(1 + i) + 2 * b(1 + k + i) * c(i) for i in range(k))))
        s = lambda i: F.get("__s", F.lit(i))
        value = sum((b(1 + i) * c(i) + b(1 + k + i) * c(i) * c(i) for i in range(k)), b(0))
        slope2 = sum((s(i) * s(i) for i in range(k)), F.lit(0.0))
        reach = (sum((s(i) * c(i) for i in range(k)), F.lit(0.0)) - value) / slope2
        fit = fit.withColumn("point", F.when(slope2 > 0, F.array(*(reach * s(i) for i in range(k)))).otherwise(F.col("__c")))
        p = lambda i: F.get("point", F.lit(i))
        fit = fit.withColumn("__moved", F.sqrt(sum(((p(i) - c(i)) ** 2 for i in range(k)), F.lit(0.0))))
        fit = written(fit.select(*by, "n", "coefficients", "point", "__moved", F.sqrt(sum((p(i) * p(i) for i in range(k)), F.lit(0.0))).alias("beta"), F.lit(turn).alias("rounds")))
        still = F.col("__moved") > tol
        ended = fit if turn == rounds else fit.where(~still | F.col("__moved").isNull())
        done = ended if done is None else done.unionByName(ended)
        open_ = fit.where(still)
        if open_.isEmpty():
            break
    return done.drop("__moved")
