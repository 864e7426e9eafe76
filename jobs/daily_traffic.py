"""Daily traffic report, kept up to date: takes the event files that are new since the last run and redoes only the days they touch.

A file stream with a checkpoint finds the new files. Each batch first lands: its events go, with the columns that count, to
``landed``, partitioned by day and batch. Then the report of every day that the batch touches is made from all that has landed
for that day, and replaces that day's partition alone. A late event so mends its day, and other days aren't read.

A batch that is repeated after a failure has the same number and the same files: it replaces what it wrote before. An event that
comes twice (the same event_id within a day, in one file or in several) counts once, with the least of its values. Events without
a time or an id can't be placed; they are counted in the log.

Per day and type of event, one trace: packets and bytes by direction, figures of lengths and of times between events, and the
packets of the busiest bin.

    python -m jobs.daily_traffic --events PATH --output PATH --checkpoint PATH [--config jobs/daily_traffic.toml]
"""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import ordered, study

from .common import configuration, log, session

CONFIG = Path(__file__).with_suffix(".toml")
DEFAULTS = {"quantile": 0.95, "bin_seconds": 60, "files_per_batch": 1000}
SECOND, DAY = 1_000_000, 86_400_000_000
LANDED = "event_id bigint, ts_us bigint, event_type string, direction tinyint, frame_length bigint, day date, batch bigint"


def landed_of(events: DataFrame, batch: int) -> DataFrame:
    """The columns that count: time in microseconds, direction by user, length by value."""
    ts_us = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.where("ts IS NOT NULL AND event_id IS NOT NULL").select(
        F.col("event_id").cast("bigint").alias("event_id"),
        ts_us.alias("ts_us"),
        F.coalesce("event_type", F.lit("")).alias("event_type"),
        F.coalesce(F.pmod("user_id", F.lit(2)), F.lit(0)).cast("tinyint").alias("direction"),
        (60 + F.pmod(F.rint(F.coalesce("value", F.lit(0.0)) * 100).cast("bigint"), F.lit(1455))).alias("frame_length"),
        F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ts_us / DAY).cast("int")).alias("day"),
        F.lit(batch).cast("bigint").alias("batch"),
    )


def report(landed: DataFrame, c: dict, kept: list[DataFrame]) -> DataFrame:
    """One row per day and type, from the landed events of whole days. What is kept in memory for it is added to kept."""
    one = landed.groupBy("day", "event_id").agg(F.min(F.struct("ts_us", "event_type", "direction", "frame_length")).alias("e"))
    events = one.select("day", "event_id", "e.*").withColumn("trace_id", F.to_json(F.struct(F.col("day").cast("string").alias("d"), F.col("event_type").alias("t"))))
    # a chunk of the numbering is a minute; equal times may take any order, as the gaps between them are 0 in each
    events = ordered.numbered(events, "trace_id", "ts_us", chunk=60 * SECOND).persist()
    kept.append(events)
    gaps = ordered.lagged(events, "trace_id", {"before": "ts_us"}).where("before IS NOT NULL").select("trace_id", (F.col("ts_us") - F.col("before")).alias("gap_us"))
    names = events.groupBy("trace_id").agg(F.first("day").alias("day"), F.first("event_type").alias("event_type"), F.count("*").alias("packets"), F.sum("frame_length").alias("bytes"))
    bins = events.groupBy("trace_id", F.floor(F.col("ts_us") / (c["bin_seconds"] * SECOND))).agg(F.count("*").alias("n"))
    figures = lambda rows, value, name, *kept: study.sample_record(rows, ["trace_id"], value, c["quantile"]).select("trace_id", *(F.col(k).alias(f"{name}_{k}") for k in kept))
    found = names.join(study.direction_values(events), "trace_id").join(figures(events, "frame_length", "length", "minimum", "median", "quantile", "maximum"), "trace_id")
    found = found.join(bins.groupBy("trace_id").agg(F.max("n").alias("busiest_bin")), "trace_id")
    return found.join(figures(gaps, "gap_us", "gap", "median", "quantile", "maximum", "zero_count"), "trace_id", "left").drop("trace_id")


def days_of(landed: DataFrame, batch: int) -> list:
    """The days that a batch touches: as many as the calendar has, however many events there are."""
    return [r.day for r in landed.where(F.col("batch") == batch).select("day").distinct().orderBy("day").collect()]


def of_days(landed: DataFrame, days: list) -> DataFrame:
    """What has landed for these days; literals, so other days' partitions aren't listed for reading."""
    return landed.where(F.col("day").isin(days))


def watched(path: str) -> str:
    """path as a pattern that matches just itself: so a file stream takes a folder of files and a single file alike."""
    path = path.rstrip("/")
    return path if set("*?[{") & set(path) else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, events: str, output: str, checkpoint: str, c: dict | None = None) -> DataFrame:
    """Take the new files of events, wait until they are done, and read the whole report back."""
    c, landing, place = DEFAULTS | (c or {}), f"{output}/landed", f"{output}/report"

    def take(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        count, unplaced = batch.agg(F.count("*"), F.count_if(F.col("ts").isNull() | F.col("event_id").isNull())).first()
        log.info("batch %d: read %d events, of which %d have no time or id", number, count, unplaced)
        landed_of(batch, number).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(landing)
        landed = own.read.schema(LANDED).parquet(landing)
        days = days_of(landed, number)
        if days:
            kept: list[DataFrame] = []
            rows = report(of_days(landed, days), c, kept)
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(place)
            for frame in kept:
                frame.unpersist()
        log.info("batch %d: wrote the report of %d days to %s", number, len(days), place)

    table = spark.read.parquet(events)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", c["files_per_batch"]).parquet(watched(events))
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("took %d new batches of %s", len({p["batchId"] for p in query.recentProgress if p["numInputRows"]}), events)
    return spark.read.parquet(place)


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("events", "output", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", default=str(CONFIG))
    a = parser.parse_args()
    spark = session("daily traffic")
    try:
        run(spark, a.events, a.output, a.checkpoint, configuration(a.config, DEFAULTS))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
