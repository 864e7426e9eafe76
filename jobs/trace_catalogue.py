"""Catalogue of conversations as traffic traces: which are fit for study, what they hold, and how unlike the training set each is.

A conversation is a trace: its turns are events in order, a user's turn is outbound, any other known role's inbound, and an
event's length is its text's bytes and a header. Each conversation gets one row: whether it is valid and, if not, why; packets
and bytes by direction; the figures of its lengths; how often the side changes; and the Kolmogorov-Smirnov distance of its
lengths from those of all valid training conversations together. Of invalid ones only the counts are given.

Output: Parquet, partitioned by status (valid, invalid) and split (training, held_out). A run replaces the whole catalogue,
so a rerun on the same table gives the same rows. Rows without a conversation or a turn belong to no trace; they are counted in the log.

    python -m jobs.trace_catalogue --conversations PATH --output PATH [--config jobs/trace_catalogue.toml]
"""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import ordered, similarity, study

from .common import configuration, log, session

CONFIG = Path(__file__).with_suffix(".toml")
DEFAULTS = {"outbound_roles": ["user"], "inbound_roles": ["assistant", "system", "tool"], "header": 54, "quantile": 0.95, "held_out": "01", "minimum_events": 2}
FAULTS = ("repeated_turns", "missing_turns", "unknown_roles", "too_few_events")


def turns_of(conversations: DataFrame, c: dict) -> DataFrame:
    """One row per turn: trace_id, split, turn, direction (null for an unknown role), frame_length."""
    role = F.lower(F.trim("role"))
    direction = F.when(role.isin(c["outbound_roles"]), 0).when(role.isin(c["inbound_roles"]), 1).cast("tinyint")
    first = F.substring(F.sha2(F.col("conv_id").cast("string").cast("binary"), 256), 1, 1)
    return conversations.select(
        F.col("conv_id").cast("string").alias("trace_id"),
        F.when(first.isin(list(c["held_out"])), "held_out").otherwise("training").alias("split"),
        F.col("turn").cast("bigint").alias("turn"),
        direction.alias("direction"),
        (F.octet_length(F.coalesce("text", F.lit(""))) + c["header"]).cast("bigint").alias("frame_length"),
    )


def judged(events: DataFrame, c: dict) -> DataFrame:
    """Per trace: events, side changes and faults."""
    near = ordered.lagged(events, "trace_id", {"turn_before": "turn", "side_before": "direction"})
    step = F.col("turn") - F.col("turn_before")
    per = near.groupBy("trace_id", "split").agg(
        F.count("*").alias("events"),
        F.count_if(step == 0).alias("repeated_turns"),
        (F.coalesce(F.sum(F.when(step > 1, step - 1)), F.lit(0)) + F.min("turn")).alias("missing_turns"),
        F.count_if(F.col("direction").isNull()).alias("unknown_roles"),
        F.count_if(F.col("direction") != F.col("side_before")).alias("side_changes"),
    )
    per = per.withColumn("too_few_events", (F.col("events") < c["minimum_events"]).cast("int"))
    faults = F.array_join(F.filter(F.array(*(F.when(F.col(f) != 0, f) for f in FAULTS)), lambda x: x.isNotNull()), ",")
    return per.select("trace_id", "split", "events", "side_changes", faults.alias("faults"), F.when(faults == "", "valid").otherwise("invalid").alias("status"))


def catalogue(conversations: DataFrame, c: dict, kept: list[DataFrame]) -> DataFrame:
    """The rows of the catalogue. What is kept in memory for them is added to kept."""
    turns = turns_of(conversations, c).where("trace_id IS NOT NULL AND turn IS NOT NULL")
    events = ordered.numbered(turns, "trace_id", "turn").persist()
    traces = judged(events, c).persist()
    valid = events.join(traces.where("status = 'valid'").select("trace_id"), "trace_id").withColumn("comparison", F.col("trace_id")).persist()
    kept += [events, traces, valid]
    sides = study.direction_values(valid)
    lengths = study.sample_record(valid, ["trace_id"], "frame_length", c["quantile"])
    lengths = lengths.select("trace_id", *(F.col(n).alias(f"length_{n}") for n in ("minimum", "median", "quantile", "maximum")))
    unlike = similarity.ks(valid.where("split = 'training'"), valid, "frame_length").select(F.col("comparison").alias("trace_id"), F.round("distance", 9).alias("length_distance"))
    figures = sides.join(lengths, "trace_id").join(unlike, "trace_id", "left")
    out = traces.withColumn("side_changes", F.when(F.col("status") == "valid", F.col("side_changes"))).join(figures, "trace_id", "left")
    return out.withColumnRenamed("trace_id", "conversation")


def run(spark: SparkSession, conversations: str, output: str, c: dict | None = None) -> DataFrame:
    """Write the catalogue of the table at conversations to output; the output, read back."""
    c = DEFAULTS | (c or {})
    table = spark.read.parquet(conversations)
    read, unplaced = table.agg(F.count("*"), F.count_if(F.col("conv_id").isNull() | F.col("turn").isNull())).first()
    log.info("read %d turns from %s, of which %d belong to no trace", read, conversations, unplaced)
    kept: list[DataFrame] = []
    catalogue(table, c, kept).write.mode("overwrite").partitionBy("status", "split").parquet(output)
    for frame in kept:
        frame.unpersist()
    written = spark.read.parquet(output)
    for r in written.groupBy("status", "split").agg(F.count("*").alias("n"), F.sum("events").alias("events")).orderBy("status", "split").collect():
        log.info("wrote %d %s traces of %d events to split %s of %s", r.n, r.status, r.events, r.split, output)
    return written


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("--conversations", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--config", default=str(CONFIG))
    a = parser.parse_args()
    spark = session("trace catalogue")
    try:
        run(spark, a.conversations, a.output, configuration(a.config, DEFAULTS))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
