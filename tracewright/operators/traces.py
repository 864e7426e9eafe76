"""The canonical trace: one row per event, ordered by seq within trace_id.

ts_us is the time in whole microseconds (exact) and ts the same in seconds as a double; direction is 0 outbound or 1
inbound. Equal times are legal, so order is seq and never time alone.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ordered import join_few, lagged, numbered

SCHEMA = "trace_id string, seq bigint, ts double, direction tinyint, frame_length bigint"
LABELS = ("outbound", "inbound")
LONGEST, SHORTEST = 2**32 - 1, 14


def from_events(spark: SparkSession, trace_id: str, events: Iterable[tuple[float, int | str, int]]) -> DataFrame:
    """A trace from (seconds, direction, length) rows in order."""
    rows = [(trace_id, i, float(t), LABELS.index(d) if isinstance(d, str) else d, n) for i, (t, d, n) in enumerate(events, 1)]
    return spark.createDataFrame(rows, SCHEMA)


def to_events(trace: DataFrame) -> list[tuple[float, int, int]]:
    """The rows of one small trace, in order."""
    return [(r.ts, r.direction, r.frame_length) for r in trace.orderBy("seq").collect()]


def from_event_table(events: DataFrame) -> DataFrame:
    """Two interleaved traces from an event log: even ids are the reference, odd ones the generated trace."""
    rows = events.select(
        F.when(F.col("event_id") % 2 == 0, "reference").otherwise("generated").alias("trace_id"),
        "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        (F.col("user_id") % 2).cast("tinyint").alias("direction"),
        (60 + F.rint(F.col("value") * 100).cast("bigint") % 1455).alias("frame_length"),
    )
    first = rows.groupBy("trace_id").agg(F.min("at").alias("first"))
    shifted = rows.join(F.broadcast(first), "trace_id").select(
        "trace_id", "event_id", (F.col("at") - F.col("first")).alias("ts_us"), "direction", "frame_length"
    )  # one row per trace is broadcast
    return numbered(shifted, "trace_id", "event_id").select(
        "trace_id", "seq", "ts_us", (F.col("ts_us") / 1e6).alias("ts"), "direction", "frame_length"
    )


def validation(trace: DataFrame) -> DataFrame:
    """Per trace: rows and counts of each kind of violation, in one pass."""
    near = lagged(trace, "trace_id", {"__before": "ts"})
    n = F.col("frame_length")
    return near.groupBy("trace_id").agg(
        F.count("*").alias("events"),
        F.count_if(F.col("ts").isNull() | F.isnan("ts") | (F.abs("ts") == float("inf"))).alias("nonfinite"),
        F.count_if(F.col("ts") < 0).alias("negative"),
        F.count_if(F.col("ts") < F.col("__before")).alias("decreasing"),
        F.count_if(~F.coalesce(F.col("direction").isin(0, 1), F.lit(False))).alias("bad_direction"),
        F.count_if(F.coalesce((n <= 0) | (n > LONGEST), F.lit(True))).alias("bad_length"),
        F.count_if(n < SHORTEST).alias("short_frames"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def require_valid(trace: DataFrame, minimum: int = 1, window: float | None = None, fitting: bool = False, encoding: bool = False) -> None:
    """Raise if a trace breaks the model; fitting and encoding add their own conditions."""
    for r in validation(trace).collect():
        bad = [k for k in ("nonfinite", "negative", "decreasing", "bad_direction", "bad_length") if r[k]]
        if r.events < minimum:
            bad.append(f"fewer than {minimum} events")
        if (fitting or encoding) and r.short_frames:
            bad.append(f"frames under {SHORTEST} bytes")
        if fitting and (r.first_ts != 0 or r.last_ts != window or r.events < 2):
            bad.append("must start at 0 and end at the window")
        if encoding and window is not None and r.last_ts > window:
            bad.append("ends after the window")
        if bad:
            raise ValueError(f"invalid trace {r.trace_id}: {', '.join(bad)}")


def normalize(trace: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trace shifted to start at 0, (trace_id, w)); w, the span, must be positive."""
    time = [c for c in ("ts_us", "ts") if c in trace.columns]
    ends = trace.groupBy("trace_id").agg(*(f(c).alias(f"__{k}_{c}") for c in time for k, f in (("first", F.min), ("last", F.max))))
    shifted = join_few(trace, ends, ["trace_id"])
    for c in time:
        shifted = shifted.withColumn(c, F.col(c) - F.col(f"__first_{c}"))
    span = F.col(f"__last_{time[-1]}") - F.col(f"__first_{time[-1]}") if time == ["ts"] else (F.col("__last_ts_us") - F.col("__first_ts_us")) / 1e6
    meta = ends.select("trace_id", F.when(span > 0, span).otherwise(F.raise_error(F.lit("a reference must span a positive time")).cast("double")).alias("w"))
    return shifted.select(*trace.columns), meta


def window_of(trace: DataFrame) -> float:
    """The observation window of one normalized reference."""
    w = trace.agg(F.max("ts")).first()[0]
    if w is None or w <= 0:
        raise ValueError("a reference must span a positive time")
    return float(w)


def align(trace: DataFrame, window: float) -> DataFrame:
    """Each trace shifted to its own start, with events up to and including the window. The window is a literal, so the filter is pushed."""
    time = [c for c in ("ts_us", "ts") if c in trace.columns]
    first = trace.groupBy("trace_id").agg(*(F.min(c).alias(f"__{c}") for c in time))
    shifted = join_few(trace, first, ["trace_id"])
    for c in time:
        shifted = shifted.withColumn(c, F.col(c) - F.col(f"__{c}"))
    return shifted.select(*trace.columns).where(F.col("ts") <= window)


def towards(trace: DataFrame, direction: int) -> DataFrame:
    return trace.where(F.col("direction") == direction)


def iats(trace: DataFrame) -> DataFrame:
    """Times between neighbours, zeros kept: one row fewer than events; seq counts from 1 again."""
    exact = "ts_us" in trace.columns
    near = lagged(trace, "trace_id", {"__us": "ts_us"} if exact else {"__ts": "ts"}).where("seq > 1")
    value = [(F.col("ts_us") - F.col("__us")).alias("iat_us"), ((F.col("ts_us") - F.col("__us")) / 1e6).alias("iat")] if exact else [(F.col("ts") - F.col("__ts")).alias("iat")]
    more = [c for c in ("comparison",) if c in trace.columns]
    return near.select("trace_id", *more, (F.col("seq") - 1).alias("seq"), *value, "direction", "frame_length")


def equal(left: DataFrame, right: DataFrame) -> bool:
    """Whether two traces have the same rows in the same order, names aside."""
    columns = ["seq", "ts", "direction", "frame_length"]
    a, b = left.select(*columns), right.select(*columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def piece(trace: DataFrame, start: int, stop: int) -> DataFrame:
    """Rows start to stop, exclusive, counted from 0."""
    return trace.where(F.col("seq").between(start + 1, stop))


def short_sequences(lineitem: DataFrame) -> DataFrame:
    """Many short traces: the lines of each order."""
    return lineitem.select(
        F.col("l_orderkey").cast("string").alias("trace_id"),
        F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("bigint").alias("seq"),
        F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double").alias("ts"),
        (F.col("l_linenumber") % 2).cast("tinyint").alias("direction"),
        (F.col("l_quantity") * 10 + 14).cast("bigint").alias("frame_length"),
    )
