"""Gamma and beta integrals on numpy arrays, from published series and continued fractions."""

from __future__ import annotations

import math

import numpy as np

#: Lanczos coefficients for g = 7.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma(x) for x > 0."""
    x = np.asarray(x, float) - 1
    total = LANCZOS[0] + sum(c / (x + i) for i, c in enumerate(LANCZOS[1:], 1))
    t = x + 7.5
    return 0.5 * math.log(2 * math.pi) + (x + 0.5) * np.log(t) - t + np.log(total)


def _fraction(term, first: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """A continued fraction first + term(1) / (b_1 + term(2) / (b_2 + ...)), by forward steps until none changes it; ``term``
    gives (numerator, b) of a step."""
    tiny = 1e-300
    f = np.where(first == 0, tiny, first)
    c, d, n = f.copy(), np.zeros_like(f), 0
    live = np.isfinite(shape)
    while live.any():
        n += 1
        a, b = term(n)
        d = b + a * d
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        c = b + a / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        step = np.where(live, c * d, 1.0)
        f = f * step
        live = live & (np.abs(step - 1) > 1e-15)
    return f


#: Shapes from which the gamma integral takes its form for large ones.
LARGE = 1e5
#: Coefficients of the uniform expansion in eta, for powers 0 and 1 of 1 / a.
UNIFORM = ((-1 / 3, 1 / 12, -2 / 135, 1 / 864, 1 / 2835, -139 / 777600), (-1 / 540, -1 / 288, 1 / 378))
_erfc = np.frompyfunc(math.erfc, 1, 1)


def gamma_integral(a: float, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma integral P(a, x): a series below a + 1 and a continued fraction above, both
    until nothing changes, and the uniform expansion for shapes of LARGE and more."""
    x = np.maximum(np.asarray(x, float), 0.0)
    with np.errstate(all="ignore"):
        mu = (x - a) / a
        half = mu - np.log1p(mu)  # half the square of eta
        if a >= LARGE:
            eta = np.sign(mu) * np.sqrt(2 * half)
            near = np.clip(eta, -1, 1)
            rest = sum(sum(c * near**k for k, c in enumerate(row)) / a**n for n, row in enumerate(UNIFORM))
            rest = np.where(np.isfinite(half), np.exp(-a * half), 0.0) / math.sqrt(2 * math.pi * a) * rest
            return np.clip(_erfc(-eta * math.sqrt(a / 2)).astype(float) / 2 - rest, 0.0, 1.0)
        if a >= 50:
            front = np.exp(-a * half) * math.sqrt(a / (2 * math.pi)) * math.exp(-(1 / (12 * a) - 1 / (360 * a**3) + 1 / (1260 * a**5)))
        else:
            front = np.exp(np.where(x > 0, a * np.log(np.where(x > 0, x, 1)), -np.inf) - x - log_gamma(a))
        below = x < a + 1
        low = np.where(below, x, 0.0)
        term = total = np.full_like(x, 1 / a)
        n = 0
        while (term > 1e-17 * total).any():
            n += 1
            term = term * low / (a + n)
            total = total + term
        high = np.where(below, np.inf, x)
        some = np.where(below, a + 2, np.minimum(x, 1e300))
        upper = front / _fraction(lambda n: (n * (a - n), some + 2 * n + 1 - a), some + 1 - a, np.where(np.isinf(high), np.nan, some))
    return np.clip(np.where(below, front * total, 1 - np.where(np.isfinite(upper), upper, 0.0)), 0.0, 1.0)


def beta_integral(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta integral I_x(a, b), by a continued fraction until nothing changes."""
    x = np.clip(np.asarray(x, float), 0.0, 1.0)

    def fraction(p: float, q: float, z: np.ndarray, live: np.ndarray) -> np.ndarray:
        def term(n: int) -> tuple[np.ndarray, np.ndarray]:
            m = n // 2
            d = m * (q - m) * z / ((p + n - 1) * (p + n)) if n % 2 == 0 else -(p + m) * (p + q + m) * z / ((p + n - 1) * (p + n))
            return d, np.ones_like(z)

        front = np.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * np.log(z) + q * np.log1p(-z))
        return front / (p * _fraction(term, np.ones_like(z), np.where(live, z, np.nan)))

    with np.errstate(all="ignore"):
        inside, low = (x > 0) & (x < 1), x < (a + 1) / (a + b + 2)
        return np.clip(np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(low, fraction(a, b, x, inside & low), 1 - fraction(b, a, 1 - x, inside & ~low)))), 0.0, 1.0)


def inverted(cdf, p: np.ndarray, low: float, high: float, rounds: int = 200) -> np.ndarray:
    """Where a rising cdf reaches p, by bisection between low and high."""
    lo, hi = np.full_like(p, low, dtype=float), np.full_like(p, high, dtype=float)
    for _ in range(rounds):
        mid = (lo + hi) / 2
        below = cdf(mid) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2
