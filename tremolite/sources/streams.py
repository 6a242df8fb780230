"""Sinks of recorder streams by name, and a socket sink."""

from __future__ import annotations

import socket
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

SINKS = ("console", "noop", "memory", "parquet", "csv", "json", "text")


def write_stream(df: DataFrame, sink: str, checkpoint: str | None = None, mode: str = "append", **options: str) -> DataStreamWriter:
    """A writer of a streaming DataFrame to a named sink; start it to run."""
    if sink not in SINKS:
        raise ValueError(f"unknown sink {sink!r}; known: {', '.join(SINKS)}")
    writer = df.writeStream.format(sink).outputMode(mode).options(**options)
    return writer.option("checkpointLocation", checkpoint) if checkpoint else writer


def send_rows(host: str, port: int) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that sends rows as tab-separated lines, each partition over a connection of its own."""

    def each(batch: DataFrame, _: int) -> None:
        def send(rows) -> None:
            with socket.create_connection((host, port)) as s:
                for row in rows:
                    s.sendall(("\t".join("" if v is None else str(v) for v in row) + "\n").encode())

        batch.foreachPartition(send)

    return each
