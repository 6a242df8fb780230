"""The standard normal law as plain arithmetic, the same text for Spark SQL and for a test database."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hart's rational approximation of the normal integral, as published by West (2005), by rising power.
HART_TOP = (220.206867912376, 221.213596169931, 112.079291497871, 33.912866078383, 6.37396220353165, 0.700383064443688, 0.0352624965998911)
HART_BOTTOM = (440.413735824752, 793.826512519948, 637.333633378831, 296.564248779674, 86.7807322029461, 16.064177579207, 1.75566716318264, 0.0883883476483184)
#: Acklam's rational approximation of the inverse, by falling power; its lower break.
ACKLAM_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
ACKLAM_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
ACKLAM_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
ACKLAM_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
ACKLAM_LOW = 0.02425
SQRT_2PI = 2.5066282746310002


def _horner(falling: tuple[float, ...], x: str) -> str:
    out = f"({falling[0]!r}e0)"
    for c in falling[1:]:
        out = f"({out} * {x} + ({c!r}e0))"
    return out


def pdf_sql(z: str) -> str:
    """Density at the SQL expression z."""
    return f"(exp(-0.5e0 * ({z}) * ({z})) / {SQRT_2PI}e0)"


def cdf_sql(z: str) -> str:
    """Integral at z, to about 15 digits."""
    a = f"abs({z})"
    body = f"exp(-0.5e0 * {a} * {a}) * {_horner(HART_TOP[::-1], a)} / {_horner(HART_BOTTOM[::-1], a)}"
    tail = f"exp(-0.5e0 * {a} * {a}) / ({a} + 1e0 / ({a} + 2e0 / ({a} + 3e0 / ({a} + 4e0 / ({a} + 0.65e0))))) / {SQRT_2PI}e0"
    upper = f"(CASE WHEN {a} > 37e0 THEN 0e0 WHEN {a} < 7.07106781186547e0 THEN {body} ELSE {tail} END)"
    return f"(CASE WHEN ({z}) > 0e0 THEN 1e0 - {upper} ELSE {upper} END)"


def inverse_sql(p: str) -> str:
    """Acklam's inverse at p in (0, 1), to 1.15e-9 of its value."""
    q = f"(({p}) - 0.5e0)"
    low = f"sqrt(-2e0 * ln({p}))"
    high = f"sqrt(-2e0 * ln(1e0 - ({p})))"
    side = lambda r: f"({_horner(ACKLAM_C, r)} / {_horner(ACKLAM_D, r)})"
    middle = f"({q} * {_horner(ACKLAM_A, f'({q} * {q})')} / {_horner(ACKLAM_B, f'({q} * {q})')})"
    return f"(CASE WHEN ({p}) < {ACKLAM_LOW}e0 THEN {side(low)} WHEN ({p}) <= {1 - ACKLAM_LOW}e0 THEN {middle} ELSE -{side(high)} END)"


def _poly(falling: tuple[float, ...], x: Column) -> Column:
    out = F.lit(falling[0])
    for c in falling[1:]:
        out = out * x + F.lit(c)
    return out


def pdf(z: Column) -> Column:
    return F.exp(-0.5 * z * z) / F.lit(SQRT_2PI)


def cdf(z: Column) -> Column:
    a = F.abs(z)
    bell = F.exp(-0.5 * a * a)
    upper = F.when(a > 37, F.lit(0.0)).when(a < 7.07106781186547, bell * _poly(HART_TOP[::-1], a) / _poly(HART_BOTTOM[::-1], a)).otherwise(bell / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / F.lit(SQRT_2PI))
    return F.when(z > 0, 1 - upper).otherwise(upper)


def inverse(p: Column) -> Column:
    q = p - 0.5
    low, high = F.sqrt(-2 * F.log(p)), F.sqrt(-2 * F.log(1 - p))
    side = lambda r: _poly(ACKLAM_C, r) / _poly(ACKLAM_D, r)
    return F.when(p < ACKLAM_LOW, side(low)).when(p <= 1 - ACKLAM_LOW, q * _poly(ACKLAM_A, q * q) / _poly(ACKLAM_B, q * q)).otherwise(-side(high))
