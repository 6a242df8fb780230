"""Time-series factors, filters, modulating functions and spectra as column expressions.

Every function takes the time (or frequency) column and parameters, and returns the factor.
Unless said otherwise a factor is 0 outside [start, finish], both ends included.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = math.pi


def _within(t: Column, start: float, finish: float, value: Column) -> Column:
    return F.when(t.between(start, finish), value).otherwise(F.lit(0.0))


def _phase(t: Column, start: float, period: float, shift: float) -> Column:
    """Where t lies in its period, 0 to 1."""
    turns = (t + F.lit(shift) - F.lit(start)) / F.lit(period)
    return turns - F.floor(turns)


def constant(t: Column, factor: float = 1.0) -> Column:
    """The factor at every time."""
    return F.when(t.isNotNull(), F.lit(factor))


def linear(t: Column, factor: float = 1.0) -> Column:
    """Factor times t, without bounds."""
    return t * factor


def rectangular(t: Column, start: float, finish: float, factor: float = 1.0) -> Column:
    """The factor inside the bounds."""
    return _within(t, start, finish, F.lit(factor))


def trigonometric(t: Column, start: float, finish: float, period: float, phase: float = 0.0, factor: float = 1.0, zero: float = 0.0) -> Column:
    """A sine raised by ``zero``, its phase moved back so that the raised curve keeps its zero crossing."""
    moved = phase - period / (2 * PI) * math.asin(zero / factor)
    return _within(t, start, finish, factor * F.sin(2 * PI * (t - start) / period + moved) + zero)


def triangle(t: Column, start: float, finish: float, period: float, phase: float = 0.0, factor: float = 1.0, zero: float = 0.0) -> Column:
    """A triangle wave: up for a quarter period, down for a half, up again."""
    slope = factor / (period / 4)
    k = _phase(t, start, period, phase - zero / slope)
    wave = F.when(k < 0.25, slope * k * period).when(k < 0.75, factor - slope * (k - 0.25) * period).otherwise(slope * (k - 0.75) * period - factor)
    return _within(t, start, finish, wave + zero)


def pulse(t: Column, start: float, finish: float, period: float, width: float = 0.5, phase: float = 0.0, factor: float = 1.0, zero: float = 0.0) -> Column:
    """``factor + zero`` for the first ``width`` of each period, ``zero`` for the rest."""
    return _within(t, start, finish, F.when(_phase(t, start, period, phase) < width, F.lit(factor + zero)).otherwise(F.lit(zero)))


def ramp(t: Column, start: float, length: float, smooth: float = 0.0, offset: float = 0.0, factor: float = 1.0) -> Column:
    """From ``offset`` up by ``factor`` over ``length``, with a share ``smooth`` of it rounded; constant before and after."""
    s = (t - start) / length
    bend = 2 / (smooth * (2 - smooth)) if smooth else 0.0
    rise = (
        F.when(s <= 0, F.lit(0.0)).when(s <= smooth / 2, s * s * bend)
        .when(s <= 1 - smooth / 2, 0.5 + (s - 0.5) * (2 / (2 - smooth))).when(s <= 1, 1 - (s - 1) * (s - 1) * bend).otherwise(F.lit(1.0))
    )
    return offset + factor * rise


def velocity_pulse(t: Column, start: float, finish: float, period: float, gamma: float, nu: float, amplitude: float) -> Column:
    """Acceleration of the Mavroeidis-Papageorgiou velocity pulse; ``nu`` in degrees."""
    carrier = 2 * PI * t / period - PI * gamma + nu * PI / 180
    envelope = 2 * PI * t / (period * gamma)
    return _within(t, start, finish, amplitude * PI / (period * gamma) * (F.sin(envelope) * F.cos(carrier) - gamma * F.sin(carrier) * (1 - F.cos(envelope))))


def delta_filter(t: Column, dt: float) -> Column:
    """A triangle of half-width dt about 0."""
    return F.when(F.abs(t) > dt + 1e-14, F.lit(0.0)).otherwise(1 - F.abs(t) / dt)


def koo_filter(t: Column, wn: float, xi: float) -> Column:
    """Response of the Koo filter at t >= 0."""
    damped = math.sqrt(1 - xi * xi)
    return F.when(t < 0, F.lit(0.0)).otherwise(-(wn / damped * F.sin(wn * damped * t) + 2 * xi * wn * F.cos(wn * damped * t)) * F.exp(-xi * wn * t))


def oscillator_filter(t: Column, wn: float, xi: float, response: str = "displacement") -> Column:
    """Unit-impulse response of a damped oscillator at t >= 0, up to a constant: displacement, velocity or acceleration."""
    wd = wn * math.sqrt(1 - xi * xi)
    a, b = {"displacement": (1.0, 0.0), "velocity": (-xi * wn, wd), "acceleration": (xi * xi * wn * wn - wd * wd, -2 * xi * wn * wd)}[response]
    return F.when(t < 0, F.lit(0.0)).otherwise((a * F.sin(wd * t) + b * F.cos(wd * t)) * F.exp(-xi * wn * t))


def constant_modulation(t: Column, amplitude: float) -> Column:
    return F.when(t.isNotNull(), F.lit(amplitude))


def gamma_modulation(t: Column, a: float, b: float, c: float) -> Column:
    """a t^b e^(-ct)."""
    return a * F.pow(t, F.lit(b)) * F.exp(-c * t)


def trapezoid_modulation(t: Column, t1: float, t2: float, t3: float, t4: float, amplitude: float) -> Column:
    """Up from t1 to t2, level to t3, down to t4."""
    return F.when(t < t1, F.lit(0.0)).when(t < t2, amplitude * (t - t1) / (t2 - t1)).when(t < t3, F.lit(amplitude)).when(t < t4, amplitude * (1 - (t - t3) / (t4 - t3))).otherwise(F.lit(0.0))


#: Fixed values of the Koo modulation: the divisor of its rise and the time from which it decays.
KOO_RISE, KOO_DECAY = 25.0, 10.0


def koo_modulation(t: Column, t1: float, t2: float) -> Column:
    return F.when(t < 0, F.lit(0.0)).when(t < t1, t * t / KOO_RISE).when(t < t2, F.lit(1.0)).otherwise(F.exp(-0.5 * (t - KOO_DECAY)))


#: Fixed values of the Jonswap spectrum: its width below and above the peak.
JONSWAP_BELOW, JONSWAP_ABOVE = 0.07, 0.09


def jonswap_spectrum(w: Column, low: float, high: float, alpha: float, wp: float, gamma: float) -> Column:
    sigma = F.when(w < wp, F.lit(JONSWAP_BELOW)).otherwise(F.lit(JONSWAP_ABOVE))
    peak = F.exp(-(w - wp) * (w - wp) / (2 * sigma * sigma * wp * wp))
    return F.when((w < low) | (w > high), F.lit(0.0)).otherwise(F.pow(F.lit(gamma), peak) * alpha * F.pow(w, F.lit(-5.0)) * F.exp(-1.25 * F.pow(w / wp, F.lit(-4.0))))


def narrow_band_spectrum(w: Column, low: float, high: float, amplitude: float) -> Column:
    return F.when((w < low) | (w > high), F.lit(0.0)).otherwise(F.lit(amplitude))


def points_spectrum(w: Column, points: list[tuple[float, float]]) -> Column:
    """Linear between a few points, 0 outside; at the first frequency its own amplitude."""
    out = F.when((w < points[0][0]) | (w > points[-1][0]), F.lit(0.0)).when(w == points[0][0], F.lit(points[0][1]))
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        out = out.when(w <= x1, y0 + (y1 - y0) / (x1 - x0) * (w - x0))
    return out


#: Series by the names that models use.
SERIES: dict[str, Callable] = {"Constant": constant, "Linear": linear, "Rectangular": rectangular, "Trig": trigonometric, "Sine": trigonometric, "Triangle": triangle, "Pulse": pulse, "Ramp": ramp, "MPAcc": velocity_pulse}
FILTERS: dict[str, Callable] = {"delta": delta_filter, "Koo": koo_filter, "standardSDOF": oscillator_filter}
MODULATIONS: dict[str, Callable] = {"constant": constant_modulation, "gamma": gamma_modulation, "trapezoidal": trapezoid_modulation, "Koo": koo_modulation}
SPECTRA: dict[str, Callable] = {"jonswap": jonswap_spectrum, "narrowband": narrow_band_spectrum, "points": points_spectrum}


def factor(kind: str, t: Column, **parameters: float) -> Column:
    """The factor of the series named ``kind`` at t."""
    if kind not in SERIES:
        raise ValueError(f"unknown series {kind!r}; known: {', '.join(SERIES)}")
    return SERIES[kind](t, **parameters)
