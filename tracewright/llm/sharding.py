"""Shard placement by a permutation-filled lookup table, in DataFrame functions only.

Each shard's name gives it a permutation of the slots of a table of prime size (offset and skip from its hash). Shards
take turns; in its turn a shard claims the next free slot of its permutation. So slots differ by at most one between
shards, and when a shard leaves, few other slots change owner. A row's slot is a hash of its key; the table, whose
size is a parameter, is broadcast, and placing a row is one hash lookup. No row moves.

Edge cases: a null key counts as the empty string; equal keys share a shard; an empty table gives an empty result;
the slot and the shard take the place of input columns of the names in ``columns``; any other names are safe.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

SHARDS, SLOTS = 64, 16381


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """Owner, as an index into shards, of each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and not empty")
    if not is_prime(slots) or slots < len(shards):
        raise ValueError("the table's size must be a prime, at least the number of shards")
    walks = []
    for name in shards:
        h = hashlib.sha256(name.encode()).digest()
        walks.append((int.from_bytes(h[:8], "big") % slots, int.from_bytes(h[8:16], "big") % (slots - 1) + 1))
    owner, turn, free = [-1] * slots, [0] * len(shards), slots
    while free:
        for i, (offset, skip) in enumerate(walks):
            while owner[slot := (offset + turn[i] * skip) % slots] >= 0:
                turn[i] += 1
            owner[slot] = i
            free -= 1
            if not free:
                break
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return (F.conv(digits, 16, 10).cast("bigint") % slots).cast("int")


def assign(df: DataFrame, key: Column, shards: list[str], slots: int = SLOTS, columns: tuple[str, str] = ("slot", "shard")) -> DataFrame:
    """df with a slot and a shard column. The broadcast side has exactly ``slots`` rows of two integers."""
    spark = df.sparkSession
    owners = ",".join(map(str, lookup_table(shards, slots)))
    table = spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "owner"))
    table = table.select("slot", F.element_at(F.array(*map(F.lit, shards)), F.col("owner").cast("int") + 1).alias("shard"))
    kept = [c for c in df.columns if c.lower() not in {n.lower() for n in columns}]
    row = F.struct(*(F.col(f"`{c}`") for c in kept), F.lit(0).alias("")).alias("row")  # a struct isn't empty
    placed = df.select(row, slot_of(key, slots).alias("slot")).join(F.broadcast(table), "slot")
    return placed.select(*(F.col("row").getField(c).alias(c) for c in kept), F.col("slot").alias(columns[0]), F.col("shard").alias(columns[1]))


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:03d}" for i in range(n)]


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id")
    return assign(docs, F.col("doc_id"), shard_names())


def op6_sql() -> str:
    """The lookup table is given as a list, built here by the definition: at each turn the first unclaimed slot of a walk."""
    names, slots = shard_names(), SLOTS
    orders = []
    for name in names:
        h = hashlib.sha256(name.encode()).hexdigest()
        a, b = int(h[:16], 16) % slots, int(h[16:32], 16) % (slots - 1) + 1
        orders.append(iter([(a + j * b) % slots for j in range(slots)]))
    taken: dict[int, int] = {}
    while len(taken) < slots:
        for i, order in enumerate(orders):
            if len(taken) < slots:
                taken[next(s for s in order if s not in taken)] = i
    owners = ",".join(str(taken[s]) for s in range(slots))
    return f"""
WITH d AS (
  SELECT doc_id, (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {slots})::INTEGER AS slot
  FROM documents),
t AS (SELECT unnest(range({slots}))::INTEGER AS slot, unnest([{owners}]) AS owner)
SELECT doc_id, d.slot AS slot, 'shard-' || lpad(CAST(owner AS VARCHAR), 3, '0') AS shard FROM d JOIN t ON d.slot = t.slot
"""
