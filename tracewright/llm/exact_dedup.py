"""Exact deduplication with a heavy-hitter split, in DataFrame functions only.

1. Every row becomes (key, uid, SHA-256 of its normalised text); this narrow table is written to the shared folder.
2. A Misra-Gries summary (Spark's approx_top_k keeps a mergeable one of fixed size) names at most ``k`` digests that
   may be frequent. Whatever it misses is rarer than about N / tracked and needs no special care.
3. The named digests are verified: one aggregation over only their rows finds the exact winner and group size. The
   result has at most ``k`` rows, so broadcasting it is bounded by a parameter, not by the data.
4. Rows of verified digests are decided map-side by that broadcast; all others take an ordinary shuffle by digest.

Edge cases: a null text counts as the empty string; a null key orders after all others; of rows that repeat key and
text alike, the first read stays (drop_copies, which reads its input twice, leaves the first of its second reading); an empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, materialize, read_table, text_or_empty

K, TRACKED = 1024, 8192


def normalised(column: str):
    return F.regexp_replace(text_or_empty(column), SPACE, " ")


def _digest(column: str):
    return F.unhex(F.sha2(normalised(column).cast("binary"), 256))


def _winners(keys: DataFrame, k: int, tracked: int) -> DataFrame:
    """(digest, first, copies): exact figures of the at most k digests that the summary names and that do repeat."""
    named = keys.agg(F.expr(f"approx_top_k(hex(digest), {k}, {tracked})").alias("top"))
    named = named.select(F.explode("top").alias("t")).where("t.count > 1").select(F.unhex("t.item").alias("digest"))
    exact = (
        keys.join(F.broadcast(named), "digest")
        .groupBy("digest")
        .agg(F.min(_order()).alias("first"), F.count("*").alias("copies"))
        .where("copies > 1")
    )
    return materialize(exact, "exact-winners")


def _order():
    return F.struct(F.col("key").isNull().alias("missing"), F.col("key"), F.col("uid"))


def decide(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = K, tracked: int = TRACKED) -> DataFrame:
    """One row per row of docs: key, keep_id, group_size, kept, digest (binary)."""
    keys = docs.select(F.col(key).alias("key"), _digest(text).alias("digest"))
    keys = materialize(keys.withColumn("uid", F.monotonically_increasing_id()), "exact-keys")
    joined = keys.join(F.broadcast(_winners(keys, k, tracked)), "digest", "left")
    hot = joined.where("first is not null").select(
        "key", F.col("first.key").alias("keep_id"), F.col("copies").alias("group_size"),
        (F.col("uid") == F.col("first.uid")).alias("kept"), "digest",
    )
    alike = Window.partitionBy("digest")
    ranked = alike.orderBy(F.col("key").isNull(), "key", "uid")
    rest = joined.where("first is null").select(
        "key",
        F.first("key").over(ranked).alias("keep_id"),
        F.count("*").over(alike).alias("group_size"),
        (F.row_number().over(ranked) == 1).alias("kept"),
        "digest",
    )
    return hot.unionByName(rest)


def drop_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = K, tracked: int = TRACKED) -> DataFrame:
    """docs without its later copies, columns unchanged. Copies of a frequent text leave map-side, before the shuffle."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    tagged = docs.select(row, F.col(key).alias("key"), _digest(text).alias("digest"), F.monotonically_increasing_id().alias("uid"))
    keys = materialize(tagged.select("key", "digest", "uid"), "exact-keys")
    won = F.broadcast(_winners(keys, k, tracked).select("digest", F.col("first.key").alias("winner"), F.lit(True).alias("hot")))
    left = tagged.join(won, "digest", "left").where("hot is null or key <=> winner")
    first = F.row_number().over(Window.partitionBy("digest").orderBy(F.col("key").isNull(), "key", "uid"))
    return left.select("row", first.alias("n")).where("n = 1").select("row.*")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(read_table(spark, sf_dir, "documents")).select(
        F.col("key").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept,
       text_sha256
FROM d
"""
