"""The jobs as registered queries, each run twice into one new folder, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.sources.shared import new_folder

from . import daily_traffic, trace_catalogue
from .common import configuration


def job1_trace_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    place, c = new_folder(spark, "trace-catalogue"), configuration(trace_catalogue.CONFIG, trace_catalogue.DEFAULTS)
    for _ in range(2):
        found = trace_catalogue.run(spark, f"{sf_dir}/conversations.parquet", place, c)
    return found.withColumn("length_median", F.round("length_median", 9))


def job2_daily_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    place, c = new_folder(spark, "daily-traffic"), configuration(daily_traffic.CONFIG, daily_traffic.DEFAULTS)
    for _ in range(2):
        found = daily_traffic.run(spark, f"{sf_dir}/events.parquet", f"{place}/output", f"{place}/checkpoint", c)
    return found.withColumn("day", F.col("day").cast("string"))


QUERIES = {f.__name__: f for f in (job1_trace_catalogue, job2_daily_traffic)}

SQL = {
    "job1_trace_catalogue": """
WITH t AS (
  SELECT CAST(conv_id AS VARCHAR) AS conversation, turn, strlen(coalesce(text, '')) + 54 AS n,
         CASE WHEN lower(trim(role)) = 'user' THEN 0 WHEN lower(trim(role)) IN ('assistant', 'system', 'tool') THEN 1 END AS d
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
s AS (SELECT *, lag(turn) OVER o AS turn_before, lag(d) OVER o AS d_before FROM t WINDOW o AS (PARTITION BY conversation ORDER BY turn)),
per AS (
  SELECT conversation, CASE WHEN sha256(conversation)[1] IN ('0', '1') THEN 'held_out' ELSE 'training' END AS split, count(*) AS events,
         count(*) FILTER (turn = turn_before) AS repeated_turns, coalesce(sum(turn - turn_before - 1) FILTER (turn - turn_before > 1), 0) + min(turn) AS missing_turns,
         count(*) FILTER (d IS NULL) AS unknown_roles, count(*) FILTER (d <> d_before) AS side_changes
  FROM s GROUP BY conversation),
j AS (
  SELECT *, array_to_string(list_filter([CASE WHEN repeated_turns <> 0 THEN 'repeated_turns' END, CASE WHEN missing_turns <> 0 THEN 'missing_turns' END,
           CASE WHEN unknown_roles <> 0 THEN 'unknown_roles' END, CASE WHEN events < 2 THEN 'too_few_events' END], lambda x: x IS NOT NULL), ',') AS faults FROM per),
v AS (SELECT t.*, split FROM t JOIN j USING (conversation) WHERE faults = ''),
f AS (
  SELECT conversation, count(*) FILTER (d = 0) AS outbound_packets, count(*) FILTER (d = 1) AS inbound_packets,
         CAST(coalesce(sum(n) FILTER (d = 0), 0) AS BIGINT) AS outbound_bytes, CAST(coalesce(sum(n) FILTER (d = 1), 0) AS BIGINT) AS inbound_bytes,
         min(n) AS length_minimum, round(median(n), 9) AS length_median, CAST(quantile_disc(n, 0.95) AS DOUBLE) AS length_quantile, max(n) AS length_maximum
  FROM v GROUP BY conversation),
pool AS (SELECT n, count(*) AS a FROM v WHERE split = 'training' GROUP BY n),
own AS (SELECT conversation, n, count(*) AS b FROM v GROUP BY ALL),
grid AS (SELECT n, sum(a) AS a FROM (SELECT n, a FROM pool UNION ALL SELECT DISTINCT n, 0 FROM own) GROUP BY n),
below AS (SELECT n, a, sum(a) OVER (ORDER BY n) AS ca, sum(a) OVER () AS na FROM grid),
k AS (SELECT conversation, n, b, sum(b) OVER (PARTITION BY conversation ORDER BY n) AS cb, sum(b) OVER (PARTITION BY conversation) AS nb FROM own),
dist AS (
  SELECT conversation, round(max(greatest(abs(ca / na - cb / nb), abs((ca - a) / na - (cb - b) / nb))), 9) AS length_distance
  FROM k JOIN below USING (n) WHERE na > 0 GROUP BY conversation)
SELECT conversation, events, CASE WHEN faults = '' THEN side_changes END AS side_changes, faults, CASE WHEN faults = '' THEN 'valid' ELSE 'invalid' END AS status, split,
       f.* EXCLUDE (conversation), length_distance
FROM j LEFT JOIN f USING (conversation) LEFT JOIN dist USING (conversation)
""",
    "job2_daily_traffic": """
WITH e AS (
  SELECT event_id, epoch_us(ts) AS us, coalesce(event_type, '') AS event_type, coalesce(user_id % 2, 0) AS d,
         60 + CAST(round_even(coalesce(value, 0) * 100, 0) AS BIGINT) % 1455 AS n, CAST(ts AS DATE) AS day
  FROM events WHERE ts IS NOT NULL AND event_id IS NOT NULL),
one AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY day, event_id ORDER BY us, event_type, d, n) = 1),
g AS (SELECT *, us - lag(us) OVER (PARTITION BY day, event_type ORDER BY us, event_id) AS gap FROM one),
bins AS (SELECT day, event_type, max(c) AS busiest_bin FROM (SELECT day, event_type, us // 60000000, count(*) AS c FROM one GROUP BY ALL) GROUP BY ALL)
SELECT CAST(day AS VARCHAR) AS day, event_type, count(*) AS packets, CAST(sum(n) AS BIGINT) AS bytes,
       count(*) FILTER (d = 0) AS outbound_packets, count(*) FILTER (d = 1) AS inbound_packets,
       CAST(coalesce(sum(n) FILTER (d = 0), 0) AS BIGINT) AS outbound_bytes, CAST(coalesce(sum(n) FILTER (d = 1), 0) AS BIGINT) AS inbound_bytes,
       min(n) AS length_minimum, median(n) AS length_median, CAST(quantile_disc(n, 0.95) AS DOUBLE) AS length_quantile, max(n) AS length_maximum,
       median(gap) AS gap_median, CAST(quantile_disc(gap, 0.95) AS DOUBLE) AS gap_quantile, max(gap) AS gap_maximum,
       CASE WHEN count(gap) > 0 THEN count(*) FILTER (gap = 0) END AS gap_zero_count, any_value(busiest_bin) AS busiest_bin
FROM g JOIN bins USING (day, event_type) GROUP BY day, event_type
""",
}
