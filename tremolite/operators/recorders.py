"""Recorders: standing queries over committed steps, on a long table of responses.

A response table has one row per (run, step, entity, dof): key columns, a time and a value. ``by``
names the key columns of a series; every window is partitioned by them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .accumulators import folded
from .parallel import written

GATE_TOLERANCE = 1e-5


def project(responses: DataFrame, entities: DataFrame | None, dofs: list, by: list[str], entity: str = "entity_tag", dof: str = "dof", value: str = "value", time: str | None = None) -> DataFrame:
    """One row per step with a column for each wanted dof of each entity row: the node and element recorder.

    Entities that aren't in ``entities`` are dropped by a semi join; ``time`` adds a leading column.
    The list of dofs is given, so the pivot needs no pass of its own.
    """
    rows = responses.where(F.col(dof).isin(dofs))
    if entities is not None:
        rows = rows.join(entities, entity, "left_semi")
    columns = [F.max(F.when(F.col(dof) == F.lit(d), F.col(value))).alias(f"{value}_{d}") for d in dofs]
    lead = [F.min(time).alias(time)] if time else []
    return rows.groupBy(*by, entity).agg(*lead, *columns)


def with_series(responses: DataFrame, value: str, factor: Column) -> DataFrame:
    """A recorded value with a time series added to it, as a recorder of absolute motion does."""
    return responses.withColumn(value, F.col(value) + factor)


def envelope(responses: DataFrame, by: list[str], value: str = "value", time: str | None = None) -> DataFrame:
    """Least, largest and largest absolute value of every series, with the times when each first occurs if ``time`` is named."""
    v = F.col(value)
    found = [F.min(v).alias("v_min"), F.max(v).alias("v_max"), F.max(F.abs(v)).alias("v_absmax")]
    if time:
        first = lambda x: F.max_by(time, F.struct(x, -F.col(time)))
        found += [first(-v).alias("t_min"), first(v).alias("t_max"), first(F.abs(v)).alias("t_absmax")]
    return responses.groupBy(*by).agg(*found)


def rms(responses: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Root mean square of every series."""
    return responses.groupBy(*by).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"), F.count(value).alias("n"))


def norm(responses: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """2-norm over the components that share the key ``by`` (which includes the step)."""
    return responses.groupBy(*by).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("norm"))


def norm_envelope(responses: DataFrame, step_keys: list[str], by: list[str], value: str = "value") -> DataFrame:
    """Envelope over steps of the norm in each step."""
    return envelope(norm(responses, step_keys, value), by, "norm")


def drift(responses: DataFrame, pairs: DataFrame, by: list[str], entity: str = "entity_tag", value: str = "value") -> DataFrame:
    """(value of j - value of i) / length in every step, for rows (i, j, length) of ``pairs``."""
    at = lambda name: responses.select(*by, F.col(entity).alias(name), F.col(value).alias(f"v_{name}"))
    joined = pairs.join(at("i"), "i").join(at("j"), [*by, "j"])
    return joined.select(*by, "i", "j", ((F.col("v_j") - F.col("v_i")) / F.col("length")).alias("drift"))


def drift_envelope(responses: DataFrame, pairs: DataFrame, by: list[str], entity: str = "entity_tag", value: str = "value") -> DataFrame:
    """Envelope of each pair's drift over all steps."""
    return envelope(drift(responses, pairs, by, entity, value), ["i", "j"], "drift")


def max_abs(entities: DataFrame, responses: DataFrame, entity: str, value: str = "value") -> DataFrame:
    """Largest absolute value of each listed entity; 0 for one without responses."""
    found = responses.groupBy(entity).agg(F.max(F.abs(F.col(value))).alias("m"))
    return entities.select(entity).join(found, entity, "left").select(entity, F.coalesce("m", F.lit(0.0)).alias("max_abs"))


def gate(responses: DataFrame, by: list[str], dt: float, time: str = "t", tolerance: float = GATE_TOLERANCE) -> DataFrame:
    """Flag ``emitted``: the time has come to dT past the last emitted time, within a tolerance of dT.

    The next threshold follows from the actual time last emitted, so this is a recurrence along each series
    in time order: sorted partitions are read as a stream with one state at a time, whatever the length
    of a series. A dT of 0 emits every row; rows of equal time share their flag.
    """
    if dt == 0:
        return responses.withColumn("emitted", F.lit(True))

    def start() -> Callable[[float], float]:
        due, last = 0.0, None

        def step(t: float) -> float:
            nonlocal due, last
            if t == last:
                return 1.0
            ready = t - due >= -dt * tolerance
            if ready:
                due, last = t + dt, t
            return float(ready)

        return step

    return folded(responses, by, time, [time], start, "emitted").withColumn("emitted", F.col("emitted") == 1.0)


def pattern_factor(responses: DataFrame, by: list[str], dt: float, time: str = "t", value: str = "value") -> DataFrame:
    """Load factor over time. While the gate is closed a row is still written, with 0."""
    return gate(responses, by, dt, time).withColumn(value, F.when(F.col("emitted"), F.col(value)).otherwise(F.lit(0.0)))


def held_when_closed(rows: DataFrame, by: list[str], value: str, time: str = "t") -> DataFrame:
    """Rows of a gated recorder that repeats its last value while the gate is closed."""
    w = Window.partitionBy(*by).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(F.when(F.col("emitted"), F.col(value)), ignorenulls=True).over(w))


def removed(entities: DataFrame, links: DataFrame, responses: DataFrame, limit: float, tag: str = "tag", value: str = "value", chained: bool = False) -> DataFrame:
    """Entities left after those whose absolute response passed ``limit``, and what hangs on them by ``links``
    (tag, dependant), are gone; with ``chained`` also what hangs on that, to the end of every chain."""
    gone = responses.where(F.abs(F.col(value)) > limit).select(F.col("entity_tag").alias(tag)).distinct()
    if chained:
        gone = reached(links.select(F.col(tag).alias("tag"), "dependant"), gone.withColumnRenamed(tag, "tag")).withColumnRenamed("tag", tag)
    else:
        gone = gone.unionByName(links.join(gone, tag, "left_semi").select(F.col("dependant").alias(tag))).distinct()
    return entities.join(gone, tag, "left_anti")


def reached(links: DataFrame, start: DataFrame) -> DataFrame:
    """All tags reachable from ``start`` (tag) by ``links`` (tag, dependant), itself included; cycles end.

    A round follows links only from tags that the round before found, and leaves out those found earlier; the number
    of rounds is the length of the longest shortest chain.
    """
    links = written(links.where("dependant is not null").distinct())
    found = last = written(start.where("tag is not null").distinct())
    rounds = 0
    while True:
        rounds += 1
        last = written(links.join(last, "tag", "left_semi").select(F.col("dependant").alias("tag")).distinct().join(found, "tag", "left_anti"))
        if last.isEmpty():
            return found
        found = found.unionByName(last)
        if rounds % 32 == 0:
            found = written(found)


def increments(iterations: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Change of a solution value from one iteration to the next; the first counts from 0."""
    before = F.lag(value, 1, 0.0).over(Window.partitionBy(*by).orderBy(order))
    return iterations.withColumn("increment", F.col(value) - before)


def composite(*responses: Column) -> Column:
    """Several array responses as one."""
    return F.concat(*responses)
