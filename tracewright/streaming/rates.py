"""Streaming forms of two operators: windowed rates, and inter-arrival times with state.

Windows of a stream are aligned to the epoch, not to a trace's start, and late events beyond the watermark are left
out; so a closed trace is better measured by the batch operators.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_rates(events: DataFrame, width: str, delay: str, at: str = "at") -> DataFrame:
    """Packets and bytes per trace, direction and tumbling window of event time."""
    return (
        events.withWatermark(at, delay)
        .groupBy(F.window(at, width), "trace_id", "direction")
        .agg(F.count("*").alias("packets"), F.sum("frame_length").alias("bytes"))
        .select("trace_id", "direction", F.col("window.start").alias("window_start"), "packets", "bytes")
    )


def sessions(events: DataFrame, gap: str, delay: str, at: str = "at") -> DataFrame:
    return (
        events.withWatermark(at, delay).groupBy(F.session_window(at, gap), "trace_id").agg(F.count("*").alias("packets"), F.sum("frame_length").alias("bytes"))
        .select("trace_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "packets", "bytes")
    )


def streaming_iats(events: DataFrame) -> DataFrame:
    """Inter-arrival microseconds of events(trace_id, seq, ts_us) that arrive in order of seq; the last time is the state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("seq")
        times = rows["ts_us"].tolist()
        before = [last, *times[:-1]]
        state.update((times[-1],))
        found = [(key[0], s - 1, t - b) for s, t, b in zip(rows["seq"].tolist(), times, before, strict=True) if b is not None]
        yield pd.DataFrame(found, columns=["trace_id", "seq", "iat_us"])

    return events.groupBy("trace_id").applyInPandasWithState(step, "trace_id string, seq bigint, iat_us bigint", "last bigint", "append", GroupStateTimeout.NoTimeout)
