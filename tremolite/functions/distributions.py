"""Random-variable distributions: density, cumulative probability and its inverse as column expressions.

All but beta, gamma and chi-square are plain expressions; those three, and distributions given as
Python functions, run in Arrow-batched pandas functions.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import normal, special

#: Euler's constant, a fixed value.
EULER = 0.57721566490153286


def _from(edge: float, x: Column, value: Column, strict: bool = True) -> Column:
    return F.when((x > edge) if strict else (x >= edge), value).otherwise(F.lit(0.0))


def _gamma(x: float) -> float:
    return math.gamma(x)


@dataclass(frozen=True)
class Distribution:
    """A distribution with fixed parameters; x and p are columns."""

    def pdf(self, x: Column) -> Column:
        raise NotImplementedError

    def cdf(self, x: Column) -> Column:
        raise NotImplementedError

    def inverse(self, p: Column) -> Column:
        raise NotImplementedError

    @property
    def parameters(self) -> dict[str, float]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


@dataclass(frozen=True)
class Normal(Distribution):
    mean: float = 0.0
    stdv: float = 1.0

    def pdf(self, x: Column) -> Column:
        return normal.pdf((x - self.mean) / self.stdv) / self.stdv

    def cdf(self, x: Column) -> Column:
        return normal.cdf((x - self.mean) / self.stdv)

    def inverse(self, p: Column) -> Column:
        return self.mean + self.stdv * normal.inverse(p)


@dataclass(frozen=True)
class Lognormal(Distribution):
    """exp of a normal with mean ``lam`` and deviation ``zeta``; ``positive=False`` mirrors it about 0."""

    lam: float
    zeta: float
    positive: bool = True

    @property
    def mean(self) -> float:
        return (1 if self.positive else -1) * math.exp(self.lam + self.zeta**2 / 2)

    @property
    def stdv(self) -> float:
        return abs(self.mean) * math.sqrt(math.exp(self.zeta**2) - 1)

    def pdf(self, x: Column) -> Column:
        y = x if self.positive else -x
        return _from(0, y, normal.pdf((F.log(y) - self.lam) / self.zeta) / (self.zeta * y))

    def cdf(self, x: Column) -> Column:
        y = x if self.positive else -x
        below = _from(0, y, normal.cdf((F.log(y) - self.lam) / self.zeta))
        return below if self.positive else 1 - below

    def inverse(self, p: Column) -> Column:
        return F.exp(self.lam + self.zeta * normal.inverse(p)) if self.positive else -F.exp(self.lam + self.zeta * normal.inverse(1 - p))


@dataclass(frozen=True)
class Uniform(Distribution):
    a: float = 0.0
    b: float = 1.0

    @property
    def mean(self) -> float:
        return (self.a + self.b) / 2

    @property
    def stdv(self) -> float:
        return (self.b - self.a) / math.sqrt(12)

    def pdf(self, x: Column) -> Column:
        return F.when(x.between(self.a, self.b), F.lit(1 / (self.b - self.a))).otherwise(F.lit(0.0))

    def cdf(self, x: Column) -> Column:
        return F.when(x < self.a, F.lit(0.0)).when(x > self.b, F.lit(1.0)).otherwise((x - self.a) / (self.b - self.a))

    def inverse(self, p: Column) -> Column:
        return p * (self.b - self.a) + self.a


@dataclass(frozen=True)
class ShiftedExponential(Distribution):
    lam: float
    x0: float = 0.0

    @property
    def mean(self) -> float:
        return self.x0 + 1 / self.lam

    @property
    def stdv(self) -> float:
        return 1 / self.lam

    def pdf(self, x: Column) -> Column:
        return _from(self.x0, x, self.lam * F.exp(-self.lam * (x - self.x0)), strict=False)

    def cdf(self, x: Column) -> Column:
        return _from(self.x0, x, 1 - F.exp(-self.lam * (x - self.x0)), strict=False)

    def inverse(self, p: Column) -> Column:
        return self.x0 - F.log(1 - p) / self.lam


class Exponential(ShiftedExponential):
    """Exponential from 0; its density is 0 at negative x."""


@dataclass(frozen=True)
class ShiftedRayleigh(Distribution):
    u: float
    x0: float = 0.0

    @property
    def mean(self) -> float:
        return self.x0 + 0.5 * self.u * math.sqrt(math.pi)

    @property
    def stdv(self) -> float:
        return 0.5 * self.u * math.sqrt(4 - math.pi)

    def pdf(self, x: Column) -> Column:
        y = (x - self.x0) / self.u
        return _from(self.x0, x, 2 * y / self.u * F.exp(-y * y))

    def cdf(self, x: Column) -> Column:
        y = (x - self.x0) / self.u
        return _from(self.x0, x, 1 - F.exp(-y * y))

    def inverse(self, p: Column) -> Column:
        return self.x0 + self.u * F.sqrt(-F.log(1 - p))


class Rayleigh(ShiftedRayleigh):
    """Rayleigh from 0."""


@dataclass(frozen=True)
class Gumbel(Distribution):
    """Largest value, type 1."""

    u: float
    alpha: float

    @property
    def mean(self) -> float:
        return self.u + EULER / self.alpha

    @property
    def stdv(self) -> float:
        return math.pi / (math.sqrt(6) * self.alpha)

    def pdf(self, x: Column) -> Column:
        y = -self.alpha * (x - self.u)
        return self.alpha * F.exp(y - F.exp(y))

    def cdf(self, x: Column) -> Column:
        return F.exp(-F.exp(-self.alpha * (x - self.u)))

    def inverse(self, p: Column) -> Column:
        return self.u - F.log(-F.log(p)) / self.alpha


class Type1LargestValue(Gumbel):
    """The same law by its other name."""


@dataclass(frozen=True)
class Type1SmallestValue(Distribution):
    u: float
    alpha: float

    @property
    def mean(self) -> float:
        return self.u - EULER / self.alpha

    @property
    def stdv(self) -> float:
        return math.pi / (math.sqrt(6) * self.alpha)

    def pdf(self, x: Column) -> Column:
        y = self.alpha * (x - self.u)
        return self.alpha * F.exp(y - F.exp(y))

    def cdf(self, x: Column) -> Column:
        return 1 - F.exp(-F.exp(self.alpha * (x - self.u)))

    def inverse(self, p: Column) -> Column:
        return self.u + F.log(-F.log(1 - p)) / self.alpha


@dataclass(frozen=True)
class Type2LargestValue(Distribution):
    u: float
    k: float

    @property
    def mean(self) -> float:
        return self.u * _gamma(1 - 1 / self.k)

    @property
    def stdv(self) -> float:
        return self.u * math.sqrt(_gamma(1 - 2 / self.k) - _gamma(1 - 1 / self.k) ** 2)

    def pdf(self, x: Column) -> Column:
        y = self.u / x
        return _from(0, x, self.k / self.u * F.pow(y, F.lit(self.k + 1.0)) * F.exp(-F.pow(y, F.lit(float(self.k)))))

    def cdf(self, x: Column) -> Column:
        return _from(0, x, F.exp(-F.pow(self.u / x, F.lit(float(self.k)))))

    def inverse(self, p: Column) -> Column:
        return self.u * F.pow(-F.log(p), F.lit(-1.0 / self.k))


@dataclass(frozen=True)
class Type3SmallestValue(Distribution):
    eps: float
    u: float
    k: float

    @property
    def mean(self) -> float:
        return self.eps + (self.u - self.eps) * _gamma(1 + 1 / self.k)

    @property
    def stdv(self) -> float:
        return (self.u - self.eps) * math.sqrt(_gamma(1 + 2 / self.k) - _gamma(1 + 1 / self.k) ** 2)

    def _scaled(self, x: Column) -> Column:
        return (x - self.eps) / (self.u - self.eps)

    def pdf(self, x: Column) -> Column:
        y = self._scaled(x)
        return _from(self.eps, x, self.k / (self.u - self.eps) * F.pow(y, F.lit(self.k - 1.0)) * F.exp(-F.pow(y, F.lit(float(self.k)))))

    def cdf(self, x: Column) -> Column:
        return _from(self.eps, x, 1 - F.exp(-F.pow(self._scaled(x), F.lit(float(self.k)))))

    def inverse(self, p: Column) -> Column:
        return self.eps + (self.u - self.eps) * F.pow(-F.log(1 - p), F.lit(1.0 / self.k))


class Weibull(Type3SmallestValue):
    """Smallest value, type 3, from 0."""

    def __init__(self, u: float, k: float):
        super().__init__(0.0, u, k)


@dataclass(frozen=True)
class Laplace(Distribution):
    alpha: float
    beta: float

    @property
    def mean(self) -> float:
        return self.alpha

    @property
    def stdv(self) -> float:
        return math.sqrt(2) / self.beta

    def pdf(self, x: Column) -> Column:
        return 0.5 * self.beta * F.exp(-self.beta * F.abs(x - self.alpha))

    def cdf(self, x: Column) -> Column:
        tail = 0.5 * F.exp(-self.beta * F.abs(x - self.alpha))
        return F.when(x < self.alpha, tail).otherwise(1 - tail)

    def inverse(self, p: Column) -> Column:
        return self.alpha + F.when(p < 0.5, F.log(2 * p)).otherwise(-F.log(2 * (1 - p))) / self.beta


@dataclass(frozen=True)
class Pareto(Distribution):
    k: float
    u: float

    @property
    def mean(self) -> float:
        return self.k * self.u / (self.k - 1)

    @property
    def stdv(self) -> float:
        return self.u / (self.k - 1) * math.sqrt(self.k / (self.k - 2))

    def pdf(self, x: Column) -> Column:
        return _from(self.u, x, self.k / self.u * F.pow(self.u / x, F.lit(self.k + 1.0)), strict=False)

    def cdf(self, x: Column) -> Column:
        return _from(self.u, x, 1 - F.pow(self.u / x, F.lit(float(self.k))), strict=False)

    def inverse(self, p: Column) -> Column:
        return self.u * F.pow(1 - p, F.lit(-1.0 / self.k)) if self.k > 0 else F.lit(0.0)


def _vectorised(fn: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    """An Arrow-batched double function of one double column; null in, null out."""

    @F.pandas_udf(DoubleType())
    def run(x: pd.Series) -> pd.Series:
        out = np.asarray(fn(x.to_numpy(dtype=float)), dtype=float)
        return pd.Series(out).where(x.notna().to_numpy())

    return run


@dataclass(frozen=True)
class Gamma(Distribution):
    k: float
    lam: float

    @property
    def mean(self) -> float:
        return self.k / self.lam

    @property
    def stdv(self) -> float:
        return math.sqrt(self.k) / self.lam

    def pdf(self, x: Column) -> Column:
        return _from(0, x, self.lam / _gamma(self.k) * F.pow(self.lam * x, F.lit(self.k - 1.0)) * F.exp(-self.lam * x))

    def cdf(self, x: Column) -> Column:
        return _vectorised(lambda v: special.gamma_integral(self.k, self.lam * v))(x)

    def inverse(self, p: Column) -> Column:
        top = self.mean + 40 * self.stdv
        return _vectorised(lambda v: special.inverted(lambda x: special.gamma_integral(self.k, self.lam * x), v, 0.0, top))(p)


class ChiSquare(Gamma):
    """Gamma with k = nu / 2 and rate 1/2."""

    def __init__(self, nu: float):
        super().__init__(nu / 2, 0.5)


@dataclass(frozen=True)
class Beta(Distribution):
    """On [a, b] with shapes q and r."""

    a: float
    b: float
    q: float
    r: float

    @property
    def mean(self) -> float:
        return self.a + (self.b - self.a) * self.q / (self.q + self.r)

    @property
    def stdv(self) -> float:
        return (self.b - self.a) / (self.q + self.r) * math.sqrt(self.q * self.r / (self.q + self.r + 1))

    def pdf(self, x: Column) -> Column:
        scale = _gamma(self.q) * _gamma(self.r) / _gamma(self.q + self.r) * (self.b - self.a) ** (self.q + self.r - 1)
        low = x > self.a if self.q < 1 else x >= self.a
        high = x < self.b if self.r < 1 else x <= self.b
        return F.when(low & high, F.pow(x - self.a, F.lit(self.q - 1.0)) * F.pow(self.b - x, F.lit(self.r - 1.0)) / scale).otherwise(F.lit(0.0))

    def cdf(self, x: Column) -> Column:
        return _vectorised(lambda v: special.beta_integral(self.q, self.r, (v - self.a) / (self.b - self.a)))(x)

    def inverse(self, p: Column) -> Column:
        return _vectorised(lambda v: self.a + (self.b - self.a) * special.inverted(lambda z: special.beta_integral(self.q, self.r, z), v, 0.0, 1.0))(p)


@dataclass(frozen=True)
class UserDefined(Distribution):
    """A density that is linear between points (x, f); few points, given by the user."""

    points: tuple[tuple[float, float], ...]

    def _pieces(self) -> list[tuple[float, float, float, float, float]]:
        """(x0, x1, f0, slope, probability before x0)."""
        out, total = [], 0.0
        for (x0, f0), (x1, f1) in zip(self.points, self.points[1:], strict=False):
            out.append((x0, x1, f0, (f1 - f0) / (x1 - x0), total))
            total += (f0 + f1) / 2 * (x1 - x0)
        return out

    def _by_piece(self, x: Column, value, below: float, above: float) -> Column:
        pieces = self._pieces()
        out = F.when(x < pieces[0][0], F.lit(below))
        for x0, x1, f0, slope, before in pieces:
            out = out.when(x <= x1, value(x - x0, f0, slope, before))
        return out.when(x.isNotNull(), F.lit(above))

    def pdf(self, x: Column) -> Column:
        return self._by_piece(x, lambda d, f0, slope, before: f0 + slope * d, 0.0, 0.0)

    def cdf(self, x: Column) -> Column:
        return self._by_piece(x, lambda d, f0, slope, before: before + (f0 + slope * d / 2) * d, 0.0, 1.0)

    def inverse(self, p: Column) -> Column:
        pieces = self._pieces()
        out = F.when((p < 0) | (p > 1), F.lit(0.0)).when(p == 0, F.lit(pieces[0][0]))
        for x0, x1, f0, slope, before in pieces:
            after = before + (f0 + slope * (x1 - x0) / 2) * (x1 - x0)
            rest = p - before
            within = rest / f0 if slope == 0 else (F.sqrt(f0 * f0 + 2 * slope * rest) - f0) / slope
            out = out.when(p <= after, x0 + within)
        return out.when(p.isNotNull(), F.lit(pieces[-1][1]))


@dataclass(frozen=True)
class FromPython(Distribution):
    """A distribution whose three functions are Python functions on numpy arrays."""

    pdf_of: Callable
    cdf_of: Callable
    inverse_of: Callable

    def pdf(self, x: Column) -> Column:
        return _vectorised(self.pdf_of)(x)

    def cdf(self, x: Column) -> Column:
        return _vectorised(self.cdf_of)(x)

    def inverse(self, p: Column) -> Column:
        return _vectorised(self.inverse_of)(p)


#: Distributions by the names that models use.
DISTRIBUTIONS: dict[str, type] = {
    "beta": Beta, "chiSquare": ChiSquare, "exponential": Exponential, "gamma": Gamma, "gumbel": Gumbel, "laplace": Laplace, "lognormal": Lognormal,
    "normal": Normal, "pareto": Pareto, "python": FromPython, "rayleigh": Rayleigh, "shiftedExponential": ShiftedExponential, "shiftedRayleigh": ShiftedRayleigh,
    "type1LargestValue": Type1LargestValue, "type1SmallestValue": Type1SmallestValue, "type2LargestValue": Type2LargestValue, "type3SmallestValue": Type3SmallestValue,
    "uniform": Uniform, "userdefined": UserDefined, "weibull": Weibull,
}


def distribution(name: str, *parameters, **named) -> Distribution:
    """The distribution ``name`` with its parameters."""
    if name not in DISTRIBUTIONS:
        raise ValueError(f"unknown distribution {name!r}; known: {', '.join(DISTRIBUTIONS)}")
    return DISTRIBUTIONS[name](*parameters, **named)
