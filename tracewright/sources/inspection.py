"""Counts of what a capture holds, by dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import direction, mac_text, network, uint


def observations(packets: DataFrame, mac: str) -> DataFrame:
    """One row per packet with everything that is counted."""
    f = F.col("frame")
    side = F.when(direction(f, F.lit(mac)) == 0, "outbound").otherwise("inbound")
    return packets.select(
        "trace_id", side.alias("direction"), mac_text(F.substring(f, 7, 6)).alias("source_mac"), mac_text(F.substring(f, 1, 6)).alias("destination_mac"),
        uint(f, 12, 2).cast("string").alias("ethertype"), network(f).alias("net"),
    ).select("trace_id", "direction", "source_mac", "destination_mac", "ethertype", F.col("net.source").alias("source_address"), F.col("net.destination").alias("destination_address"), F.col("net.protocol").alias("protocol"))


DIMENSIONS = ("direction", "source_mac", "destination_mac", "ethertype", "source_address", "destination_address", "protocol")
#: Keys that are reported even if no packet has them.
ALWAYS = {"direction": ("outbound", "inbound"), "protocol": ("tcp", "udp", "other")}


def dimension_counts(rows: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, always: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(trace_id, dimension, key, count), from one pass; null keys aren't counted."""
    keys = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("key")) for d in dimensions))
    long = rows.select("trace_id", F.explode(keys).alias("k")).select("trace_id", "k.dimension", "k.key").where("key is not null")
    zero = F.array(*(F.struct(F.lit(d).alias("dimension"), F.lit(k).alias("key")) for d, ks in (ALWAYS if always is None else always).items() for k in ks))
    names = rows.select("trace_id").distinct().select("trace_id", F.explode(zero).alias("k")).select("trace_id", "k.dimension", "k.key", F.lit(0).alias("n"))
    return long.withColumn("n", F.lit(1)).unionByName(names).groupBy("trace_id", "dimension", "key").agg(F.sum("n").alias("count"))


def inspect(packets: DataFrame, mac: str) -> DataFrame:
    return dimension_counts(observations(packets, mac))
