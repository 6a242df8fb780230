"""Recorders over streams: the sampling gate and envelopes as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.recorders import GATE_TOLERANCE


def gate_stream(rows: DataFrame, key: str, dt: float, time: str = "t", tolerance: float = GATE_TOLERANCE, idle_ms: int | None = None) -> DataFrame:
    """Rows that a sampling gate lets through, one state (the next time) for each key.

    Times of a key arrive in order across micro-batches, as a simulation's do; inside one they are
    sorted. ``idle_ms`` drops the state of keys not seen for so long.
    """
    schema = StructType(rows.schema.fields)

    def step(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        due = state.get[0] if state.exists else 0.0
        pdf = pd.concat(list(parts), ignore_index=True).sort_values(time)
        keep = []
        for t in pdf[time]:
            ready = dt == 0 or t - due >= -dt * tolerance
            keep.append(ready)
            if ready:
                due = t + dt
        state.update((float(due),))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pdf[keep]

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return rows.groupBy(key).applyInPandasWithState(step, schema, "next double", "append", timeout)


def envelope_stream(rows: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Running envelope of every series; write it in update or complete mode."""
    v = F.col(value)
    return rows.groupBy(*by).agg(F.min(v).alias("v_min"), F.max(v).alias("v_max"), F.max(F.abs(v)).alias("v_absmax"))


def windowed_envelope(rows: DataFrame, by: list[str], event_time: str, width: str, late: str, value: str = "value") -> DataFrame:
    """Envelope of every series in tumbling windows of event time; state goes once the watermark passes."""
    v = F.col(value)
    return rows.withWatermark(event_time, late).groupBy(*by, F.window(event_time, width)).agg(F.min(v).alias("v_min"), F.max(v).alias("v_max"), F.max(F.abs(v)).alias("v_absmax"))
