"""Sampled time series: interpolation, integration, differentiation, peaks, motions and response spectra."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .accumulators import folded
from .ranks import ranked

#: Most rows of a list that is sent to all tasks as one value.
SHORT = 100_000


def _ordered(by: list[str], order: str):
    return Window.partitionBy(*by).orderBy(order)


def interpolate(
    times: DataFrame, path: DataFrame, by: list[str], dt: float, time: str = "t", index: str = "i", value: str = "v",
    factor: float = 1.0, start: float = 0.0, use_last: bool = False, prepend_zero: bool = False,
) -> DataFrame:
    """Linear values at ``times`` of a record sampled every dt from ``start`` on (after a zero sample, if one is
    prepended): 0 before it; from its last sample on 0, or that sample's value with ``use_last``.

    The interval is an equality on floor((t - start) / dt), so this is one equi join, never a range join.
    """
    shift = int(prepend_zero)
    right = F.lead(value).over(_ordered(by, index))
    held = F.when(F.lit(use_last), F.col(value))
    pieces = path.select(*by, (F.col(index).cast("long") + shift).alias("__i"), F.col(value).alias("__a"), right.alias("__b"))
    if prepend_zero:
        first = path.where(F.col(index) == 0).select(*by, F.lit(0).cast("long").alias("__i"), F.lit(0.0).alias("__a"), F.col(value).alias("__b"))
        pieces = pieces.unionByName(first)
    at = (F.col(time) - start) / dt
    joined = times.withColumn("__at", at).withColumn("__i", F.when(F.col("__at") >= 0, F.floor("__at")).cast("long")).join(pieces, [*by, "__i"], "left")
    found = factor * (F.col("__a") + (F.col("__at") - F.col("__i")) * (F.col("__b") - F.col("__a")))
    after = F.lit(0.0)
    if use_last:
        ends = path.groupBy(*by).agg(F.max(F.col(index).cast("long") + shift).alias("__n"), F.max_by(held, index).alias("__last"))
        joined = joined.join(ends, by, "left")
        after = F.when(F.col("__i") >= F.col("__n"), factor * F.col("__last")).otherwise(F.lit(0.0))
    return joined.withColumn("factor", F.coalesce(found, after, F.lit(0.0))).drop("__at", "__i", "__a", "__b", "__n", "__last")


def interpolate_times(times: DataFrame, path: DataFrame, by: list[str], time: str = "t", value: str = "v", use_last: bool = False) -> DataFrame:
    """Linear values at ``times`` of a record with times of its own: points and questions are merged in
    order, and each question looks to the last point before and the first after it (the last one in
    descending order, so both frames grow row by row)."""
    points = path.select(*by, F.col(time), F.col(value).alias("__v"), F.lit(0).alias("__q"))
    asked = times.select(*by, F.col(time), F.lit(None).cast("double").alias("__v"), F.lit(1).alias("__q")).distinct()
    grown = lambda *order: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    back, ahead = grown(time, "__q"), grown(F.desc(time), F.desc("__q"))
    point = F.when(F.col("__q") == 0, F.struct(F.col(time).alias("t"), F.col("__v").alias("v")))
    merged = points.unionByName(asked).withColumn("__0", F.last(point, ignorenulls=True).over(back)).withColumn("__1", F.last(point, ignorenulls=True).over(ahead))
    merged = merged.select("*", F.col("__0.t").alias("__t0"), F.col("__0.v").alias("__v0"), F.col("__1.t").alias("__t1"), F.col("__1.v").alias("__v1"))
    inside = F.col("__v0") + F.when(F.col("__t1") > F.col("__t0"), (F.col(time) - F.col("__t0")) / (F.col("__t1") - F.col("__t0")) * (F.col("__v1") - F.col("__v0")))
    after = F.when(F.col("__t1").isNull() & F.lit(use_last), F.col("__v0"))
    exact = F.when(F.col("__t0") == F.col(time), F.col("__v0"))
    return merged.where("__q = 1").select(*by, time, F.coalesce(exact, inside, after, F.lit(0.0)).alias("factor"))


def integrate_trapezoid(rows: DataFrame, by: list[str], order: str, value: str, dt: float) -> DataFrame:
    """Cumulative trapezoid integral; the value before the first counts as 0, so the first half-step is halved."""
    if dt <= 0:
        raise ValueError("the step must be positive")
    w = _ordered(by, order)
    area = 0.5 * dt * (F.lag(value, 1, 0.0).over(w) + F.col(value))
    return rows.withColumn("__area", area).withColumn("integral", F.sum("__area").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__area")


def differentiate_trapezoid(rows: DataFrame, by: list[str], order: str, value: str, dt: float) -> DataFrame:
    """The derivative whose trapezoid integral is the series: f_n = 2 (F_n - F_(n-1)) / dt - f_(n-1).

    The recurrence unrolls into a sum of alternating signs, so it is a window sum; cancellation
    grows with the length of the series.
    """
    if dt <= 0:
        raise ValueError("the step must be positive")
    w = _ordered(by, order)
    sign = F.when(F.row_number().over(w) % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    step = 2 / dt * (F.col(value) - F.lag(value, 1, 0.0).over(w))
    rows = rows.withColumn("__sign", sign).withColumn("__step", sign * step)
    return rows.withColumn("derivative", F.col("__sign") * F.sum("__step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__sign", "__step")


def integrate_simpson(rows: DataFrame, by: list[str], order: str, value: str, dt: float) -> DataFrame:
    """F_k = F_(k-2) + dt / 3 (f_(k-2) + 4 f_(k-1) + f_k) from zeros: two interleaved cumulative sums."""
    if dt <= 0:
        raise ValueError("the step must be positive")
    w = _ordered(by, order)
    area = dt / 3 * (F.lag(value, 2, 0.0).over(w) + 4 * F.lag(value, 1, 0.0).over(w) + F.col(value))
    rows = rows.withColumn("__area", area).withColumn("__odd", F.row_number().over(w) % 2)
    total = F.sum("__area").over(Window.partitionBy(*by, "__odd").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("integral", total).drop("__area", "__odd")


def differentiate_simpson(rows: DataFrame, by: list[str], order: str, value: str, dt: float) -> DataFrame:
    """f_k = 3 (F_k - F_(k-2)) / dt - f_(k-2) - 4 f_(k-1), from zeros. The recurrence is unstable and has two
    terms, so each series is stepped through as a stream."""

    def start() -> Callable[[float], float]:
        made, seen = (0.0, 0.0), (0.0, 0.0)

        def step(now: float) -> float:
            nonlocal made, seen
            made, seen = (made[1], 3 * (now - seen[0]) / dt - made[0] - 4 * made[1]), (seen[1], now)
            return made[1]

        return step

    return folded(rows, by, order, [value], start, "derivative")


def numbered(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """(by, i, v): a record's samples numbered from 0."""
    return rows.select(*by, F.col(value).alias("v"), (F.row_number().over(_ordered(by, order)) - 1).alias("i"))


def resampled(rows: DataFrame, by: list[str], order: str, value: str, dt: float, delta: float) -> DataFrame:
    """A record sampled every dt, read every delta: (by, i, t, v) at n = duration / delta + 1 points, i from 0; what
    integration runs on when its step is not the record's. The last sample holds at its own time."""
    samples = numbered(rows, by, order, value)
    points = samples.groupBy(*by).agg(F.floor((F.max("i") * F.lit(dt)) / delta + 1e-9).cast("long").alias("__n"))
    points = points.select(*by, F.explode(F.expr("sequence(0L, __n)")).alias("k"))
    asked = points.withColumn("t", F.col("k") * F.lit(delta))
    near = asked.withColumn("t", F.when(F.abs(F.col("t") / dt - F.round(F.col("t") / dt)) < 1e-9, F.round(F.col("t") / dt) * dt).otherwise(F.col("t")))
    return interpolate(near, samples, by, dt, use_last=True).select(*by, F.col("k").alias("i"), (F.col("k") * F.lit(delta)).alias("t"), F.col("factor").alias("v"))


def peak_factor(rows: DataFrame, by: list[str], value: str, dt: float, factor: float = 1.0) -> DataFrame:
    """Largest absolute factor of a record, and its duration."""
    return rows.groupBy(*by).agg((factor * F.max(F.abs(F.col(value)))).alias("peak"), (F.count(value) * F.lit(dt)).alias("duration"))


def ground_motion(motion: DataFrame, by: list[str], order: str, value: str, dt: float, given: str = "acceleration") -> DataFrame:
    """A motion given as acceleration, velocity or displacement, with the others derived: velocity and
    displacement by integration, acceleration (and velocity) by differentiation, all by the trapezoid rule."""
    names = ["displacement", "velocity", "acceleration"]
    out, at = motion.withColumn(given, F.col(value)), names.index(given)
    for here, there in zip(names[at:0:-1], names[at - 1 :: -1] if at else [], strict=False):
        out = integrate_trapezoid(out, by, order, here, dt).withColumnRenamed("integral", there)
    for here, there in zip(names[at:], names[at + 1 :], strict=False):
        out = differentiate_trapezoid(out, by, order, here, dt).withColumnRenamed("derivative", there)
    return out


def motion_peaks(motion: DataFrame, by: list[str]) -> DataFrame:
    """Largest absolute acceleration, velocity and displacement of each motion."""
    return motion.groupBy(*by).agg(*(F.max(F.abs(F.col(n))).alias(f"peak_{n}") for n in ("acceleration", "velocity", "displacement")))


def combined_motion(motions: DataFrame, weights: DataFrame, by: list[str], motion: str = "motion", time: str = "t", value: str = "v") -> DataFrame:
    """Weighted sum of motions at each time; nothing before 0. ``weights`` has (motion, weight)."""
    return motions.where(F.col(time) >= 0).join(weights, motion).groupBy(*by, time).agg(F.sum(F.col("weight") * F.col(value)).alias("value"))


def combined_peak(combined: DataFrame, by: list[str], value: str = "value", time: str = "t") -> DataFrame:
    """Largest value (by sign, not size) of combined motions, and the longest duration."""
    return combined.groupBy(*by).agg(F.greatest(F.max(value), F.lit(0.0)).alias("peak"), F.max(time).alias("duration"))


def applied_loads(loads: DataFrame, times: DataFrame, factor: Column, pattern: str = "pattern") -> DataFrame:
    """Every load of a pattern at every one of the pattern's times, times its factor there."""
    return times.withColumn("__factor", factor).join(loads, pattern).withColumn("load", F.col("value") * F.col("__factor")).drop("__factor")


def uniform_excitation(masses: DataFrame, motion: DataFrame, by: list[str], time: str = "t", value: str = "value") -> DataFrame:
    """Loads of a ground acceleration: -mass times acceleration, for every dof with mass in the motion's direction.

    ``masses`` has (by, node, mass) with mass 0 for dofs the motion doesn't move, ``motion`` (by, t, value): by names
    the direction, so one motion meets the dofs of its own direction only."""
    moved = masses.where("mass <> 0")
    return motion.join(moved, by).withColumn("load", -F.col("mass") * F.col(value)).drop(value, "mass")


def multi_support(supports: DataFrame, motions: DataFrame, time: str = "t", value: str = "value") -> DataFrame:
    """Imposed values of supports (node, dof, motion), each from its own motion (motion, t, value); several motions of
    a support add up, as in combined motions."""
    return motions.join(supports, "motion").groupBy("node", "dof", time).agg(F.sum(value).alias("imposed"))


def spectrum_value(period: Column, points: list[tuple[float, float]]) -> Column:
    """Spectral acceleration at a period: linear between few sorted points, held at both ends.

    No points give 0; an interval without width takes the middle of its two values.
    """
    if not points:
        return F.when(period.isNotNull(), F.lit(0.0))
    out = F.when(period <= points[0][0], F.lit(points[0][1]))
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        out = out.when(period <= x1, y0 + ((period - x0) / (x1 - x0) if x1 > x0 else F.lit(0.5)) * (y1 - y0))
    return out.when(period.isNotNull(), F.lit(points[-1][1]))


def spectrum_join(rows: DataFrame, spectrum: DataFrame, by: list[str], period: str = "period") -> DataFrame:
    """The same for spectra that are tables (by, tn, sa): each row of ``rows`` meets its own spectrum's sorted points."""
    points = spectrum.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("tn", "sa"))).alias("__points"))
    p, t = F.col("__points"), F.col(period)
    below = F.filter(p, lambda x: x["tn"] < t)
    above = F.filter(p, lambda x: x["tn"] >= t)
    a, b = F.get(below, F.size(below) - 1), F.get(above, F.lit(0))
    sa = F.when(F.size(below) == 0, b["sa"]).when(F.size(above) == 0, a["sa"]).otherwise(a["sa"] + (t - a["tn"]) / (b["tn"] - a["tn"]) * (b["sa"] - a["sa"]))
    return rows.join(points, by, "left").withColumn("sa", F.coalesce(sa, F.lit(0.0))).drop("__points")


def modal_displacements(modes: DataFrame, vectors: DataFrame, spectrum: list[tuple[float, float]]) -> DataFrame:
    """u = V * participation * Sa(T) / lambda of every mode and node dof, with T = 2 pi / sqrt(lambda); modes aren't combined."""
    period = 2 * math.pi / F.sqrt("lam")
    scaled = modes.select("mode", (F.col("participation") * spectrum_value(period, spectrum) / F.col("lam")).alias("__scale"))
    return vectors.join(scaled, "mode").withColumn("u", F.col("v") * F.col("__scale")).drop("__scale")


def modal_properties(vectors: DataFrame, masses: DataFrame, direction: str = "r") -> DataFrame:
    """Generalised mass, participation factor, effective mass, its share and the running share of each mode.

    ``vectors`` has (mode, node, dof, v); ``masses`` has (node, dof, mass, r), r the rigid motion.
    """
    joined = vectors.join(masses, ["node", "dof"])
    v, m, r = F.col("v"), F.col("mass"), F.col(direction)
    modes = joined.groupBy("mode").agg(F.sum(v * m * v).alias("generalised_mass"), F.sum(v * m * r).alias("__l"))
    total = masses.agg(F.sum(m * r * r).alias("__total"))
    modes = modes.withColumn("participation", F.col("__l") / F.col("generalised_mass")).withColumn("effective_mass", F.col("__l") * F.col("__l") / F.col("generalised_mass"))
    modes = modes.join(F.broadcast(total)).withColumn("ratio", F.col("effective_mass") / F.col("__total")).drop("__l", "__total")
    before = ranked(modes, ["mode"], weight="ratio", name="__before")
    return before.withColumn("cumulative", F.col("__before") + F.col("ratio")).drop("__before")


def _short(df: DataFrame, what: str) -> DataFrame:
    """``df`` if it has no more rows than a task may hold and the driver may send to all."""
    if df.limit(SHORT + 1).count() > SHORT:
        raise ValueError(f"more than {SHORT} {what}")
    return df


def random_process(times: DataFrame, pulses: DataFrame, modulation: Column, response: Callable[[Column], Column], mean: float = 0.0, factor: float = 1.0, time: str = "t") -> DataFrame:
    """Discretised random process: mean + factor * modulation(t) * sum of u_i * response(t - t_i) over pulses
    up to the first later than t; 0 at t = 0. ``pulses`` has (ti, u), at most SHORT rows, that every time meets.

    ``response`` gives the expression of a lag, ``modulation`` is one of the time. Every row of ``times`` gives a row;
    nothing but the pulses moves.
    """
    w = Window.orderBy("ti")
    listed = _short(pulses, "pulses").withColumn("before", F.lag("ti").over(w)).agg(F.collect_list(F.struct("ti", "u", "before")).alias("__pulses"))
    t = F.col(time)
    counted = lambda p: p["before"].isNull() | (t >= p["before"])
    total = F.aggregate("__pulses", F.lit(0.0), lambda s, p: s + F.when(counted(p), p["u"] * response(t - p["ti"])).otherwise(0.0))
    rows = times.join(F.broadcast(listed))
    return rows.withColumn("factor", F.when(t == 0, F.lit(0.0)).otherwise(mean + factor * modulation * total)).drop("__pulses")


def spectral_process(times: DataFrame, waves: DataFrame, density: Column, low: float, dw: float, mean: float = 0.0, time: str = "t") -> DataFrame:
    """Simulated random process: mean + sum of sqrt(2 S(w_i) dw) a_i cos(w_i t + phase_i), w_i = (i + 1/2) dw + low; 0 at 0.

    ``waves`` has (i, a, phase), at most SHORT rows; ``density`` is an expression of a column named ``w``.
    """
    listed = _short(waves, "waves").withColumn("w", (F.col("i") + 0.5) * dw + low).withColumn("__s", F.sqrt(2 * density * dw) * F.col("a"))
    listed = listed.agg(F.collect_list(F.struct("w", "__s", "phase")).alias("__waves"))
    total = F.aggregate("__waves", F.lit(0.0), lambda s, x: s + x["__s"] * F.cos(x["w"] * F.col(time) + x["phase"]))
    return times.join(F.broadcast(listed)).withColumn("factor", F.when(F.col(time) == 0, F.lit(0.0)).otherwise(mean + total)).drop("__waves")
