"""Registered queries on the pseudo-traces of the event table, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import similarity as S
from ..operators import study
from ..operators import traces as T
from ..operators.ordered import numbered, order_figures

LAGS, FRACTIONS, QUANTILE = (1, 4, 16, 64), (1024, 128, 16), 0.95
LAG_WEIGHTS, SCALE_WEIGHTS = (0.4, 0.3, 0.2, 0.1), (0.5, 0.25, 0.25)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.from_event_table(read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value"))


def pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, float]:
    """Normalized reference, aligned generated trace, and the window (one number). The traces are kept: every measure reads them."""
    both = trace(spark, sf_dir).persist()
    reference, _ = T.normalize(both.where("trace_id = 'reference'"))
    w = T.window_of(reference)
    return reference, T.align(both.where("trace_id = 'generated'"), w), w


def settings(w: float) -> S.Settings:
    return S.Settings(lags=LAGS, lag_weights=LAG_WEIGHTS, widths=tuple(w / f for f in FRACTIONS), scale_weights=SCALE_WEIGHTS, quantile=QUANTILE)


def gaps(frame: DataFrame) -> DataFrame:
    return T.iats(frame)


def nine(c: str):
    return F.round(F.col(c), 9).alias(c)


def normalize(spark, sf_dir):
    shifted, meta = T.normalize(trace(spark, sf_dir))
    return shifted.join(F.broadcast(meta), "trace_id").groupBy("trace_id").agg(
        F.count("*").alias("events"), F.max("seq").alias("last_seq"), F.max("ts_us").alias("last_us"), F.sum("frame_length").alias("bytes"), F.max("w").alias("w")
    )


def align(spark, sf_dir):
    return pair(spark, sf_dir)[1].select("seq", "ts_us", F.col("direction").cast("int").alias("direction"), "frame_length")


def iats(spark, sf_dir):
    return gaps(trace(spark, sf_dir)).select("trace_id", "seq", "iat_us")


def trace_validation(spark, sf_dir):
    return T.validation(trace(spark, sf_dir)).select("trace_id", "events", "negative", "decreasing", "bad_direction", "bad_length", "short_frames", "last_ts")


def direction_totals(spark, sf_dir):
    return trace(spark, sf_dir).groupBy("trace_id").agg(
        *(e for d, n in enumerate(T.LABELS) for e in (F.count_if(F.col("direction") == d).alias(f"{n}_packets"), F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("frame_length"))), F.lit(0)).alias(f"{n}_bytes")))
    )


def multiscale_cells(spark, sf_dir):
    reference, generated, w = pair(spark, sf_dir)
    s = settings(w)
    rows = reference.unionByName(generated)
    cells = S.rate_cells(rows, w, s.widths, s.max_cells, ["trace_id"])
    return cells.select("trace_id", "scale", F.col("direction").cast("int").alias("direction"), "bin", "packets", F.col("bytes").cast("bigint").alias("bytes"))


def multiscale_score(spark, sf_dir):
    reference, generated, w = pair(spark, sf_dir)
    s = settings(w)
    found = S.multiscale_score(S.scale_discrepancies(reference, generated, w, s.widths, s.max_cells), s)
    return found.select(nine("packet_discrepancy"), nine("byte_discrepancy"), nine("score"))


def frame_size_ks(spark, sf_dir):
    reference, generated, _ = pair(spark, sf_dir)
    return S.frame_size_ks(reference, generated).select(
        "distance", "reference_count", "generated_count", "reference_minimum_length", "reference_maximum_length", "generated_minimum_length", "generated_maximum_length", "score"
    )


def iat_ks(spark, sf_dir):
    reference, generated, _ = pair(spark, sf_dir)
    return S.iat_ks(gaps(reference), gaps(generated), QUANTILE).select("distance", "reference_count", "generated_count", "score")


def iat_diagnostics(spark, sf_dir):
    reference, generated, _ = pair(spark, sf_dir)
    both = gaps(reference).unionByName(gaps(generated))
    return S.iat_record(both, ["trace_id"], "iat_us", QUANTILE, "iat")


def acf(spark, sf_dir):
    reference, generated, _ = pair(spark, sf_dir)
    return S.acf_table(reference, generated, gaps(reference), gaps(generated), LAGS).select("feature", "lag", "reference_acf", "generated_acf")


def acf_score(spark, sf_dir):
    reference, generated, w = pair(spark, sf_dir)
    found = S.acf_score(S.acf_table(reference, generated, gaps(reference), gaps(generated), LAGS), settings(w))
    return found.select(nine("iat_discrepancy"), nine("size_discrepancy"), nine("score"))


def compare_traces(spark, sf_dir):
    reference, generated, w = pair(spark, sf_dir)
    return S.compare(reference, generated, w, settings(w)).select("method", nine("score"), "weight")


def aggregate_score(spark, sf_dir):
    reference, generated, w = pair(spark, sf_dir)
    return S.aggregate(S.compare(reference, generated, w, settings(w))).select(*(nine(m) for m in S.METHODS), nine("aggregate_score"))


def trace_summary(spark, sf_dir):
    both = trace(spark, sf_dir)
    figures = lambda f, c, p, *more: order_figures(f, ["trace_id"], c, 0.95).select("trace_id", *(F.col(n).alias(f"{p}_{n}") for n in ("minimum", "median", "quantile", "maximum", *more)))
    size = both.groupBy("trace_id").agg(F.count("*").alias("packets"), F.sum("frame_length").alias("bytes"))
    return size.join(figures(both, "frame_length", "length"), "trace_id").join(figures(gaps(both), "iat_us", "iat", "zeros"), "trace_id")


def short_sequences(spark, sf_dir):
    rows = T.short_sequences(read(spark, sf_dir, "lineitem"))
    return rows.groupBy("trace_id").agg(F.count("*").alias("events"), F.max("seq").alias("last_seq"), F.sum("frame_length").alias("bytes"), F.count_if(F.col("direction") == 1).alias("inbound"))


def quantized(spark, sf_dir):
    """Timestamp quantization of scaled times."""
    from ..functions.numeric import microsecond_ticks

    return trace(spark, sf_dir).select("trace_id", "seq", microsecond_ticks(F.col("ts") * 0.7).alias("ticks"))


def crowd(spark, sf_dir):
    """A hundred traces of the odd events, by user."""
    rows = read(spark, sf_dir, "events").where("event_id % 2 = 1").select(
        F.concat(F.lit("user "), F.col("user_id") % 100).alias("trace_id"),
        "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        (F.floor(F.col("event_id") / 2) % 2).cast("tinyint").alias("direction"),
        (60 + F.rint(F.col("value") * 100).cast("bigint") % 1455).alias("frame_length"),
    )
    return numbered(rows, "trace_id", "event_id").select("trace_id", "seq", "ts_us", (F.col("ts_us") / 1e6).alias("ts"), "direction", "frame_length")


def many_comparisons(spark, sf_dir):
    """A hundred traces against one reference, without a copy of it for each."""
    reference, _, w = pair(spark, sf_dir)
    s = settings(w)
    generated = T.align(crowd(spark, sf_dir), w).withColumn("comparison", F.col("trace_id")).persist()
    size = S.frame_size_ks(reference, generated).select("comparison", F.col("distance").alias("size_distance"), "generated_count", "generated_minimum_length", "generated_maximum_length")
    time = S.iat_ks(gaps(reference), gaps(generated), QUANTILE).select("comparison", F.col("distance").alias("iat_distance"), "generated_median", "generated_zeros")
    rate = S.multiscale_score(S.scale_discrepancies(reference, generated, w, s.widths, s.max_cells), s)
    rate = rate.select("comparison", nine("packet_discrepancy"), nine("byte_discrepancy"))
    return size.join(time, "comparison").join(rate, "comparison")


VARIED = S.Settings(lags=(1, 2, 4, 8), lag_weights=LAG_WEIGHTS, widths=(1 / 64, 1 / 16, 1 / 4), scale_weights=SCALE_WEIGHTS, quantile=QUANTILE)


def repeats(spark, sf_dir):
    """Three traces for each type of event, by user: (traces, runs)."""
    rows = read(spark, sf_dir, "events").select(
        F.concat_ws("/", "event_type", (F.col("user_id") % 3).cast("string")).alias("trace_id"),
        F.col("event_type").alias("workload"),
        (F.col("user_id") % 3).cast("int").alias("repeat"),
        "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        (F.floor(F.col("user_id") / 3) % 2).cast("tinyint").alias("direction"),
        (60 + F.rint(F.col("value") * 100).cast("bigint") % 1455).alias("frame_length"),
    )
    traces = numbered(rows, "trace_id", "event_id").withColumn("ts", F.col("ts_us") / 1e6).persist()
    return traces.select("trace_id", "seq", "ts_us", "ts", "direction", "frame_length"), traces.select("workload", "repeat", "trace_id").distinct()


def pair_scores(spark, sf_dir):
    """All four scores of every pair of repeats, in both directions, each under its reference's window."""
    traces, runs = repeats(spark, sf_dir)
    a, b = runs.alias("a"), runs.alias("b")
    pairs = a.join(b, (F.col("a.workload") == F.col("b.workload")) & (F.col("a.repeat") != F.col("b.repeat"))).select(F.col("a.trace_id").alias("reference"), F.col("b.trace_id").alias("generated"))
    found = S.aggregate(S.compare_pairs(traces, pairs, VARIED))
    return found.select("reference", F.col("comparison").alias("generated"), *(nine(m) for m in S.METHODS), nine("aggregate_score"))


def symmetric_scores(spark, sf_dir):
    traces, runs = repeats(spark, sf_dir)
    a, b = runs.alias("a"), runs.alias("b")
    pairs = a.join(b, (F.col("a.workload") == F.col("b.workload")) & (F.col("a.repeat") != F.col("b.repeat"))).select(F.col("a.trace_id").alias("reference"), F.col("b.trace_id").alias("generated"))
    return S.symmetric_scores(S.aggregate(S.compare_pairs(traces, pairs, VARIED))).select("left", "right", nine("symmetric"))


def score_variation(spark, sf_dir):
    """Natural variation of real scores: the mean symmetric score of each workload's three pairs."""
    traces, runs = repeats(spark, sf_dir)
    return study.variation_of(traces, runs, VARIED).select("workload", "pairs", nine("mean"), nine("minimum"), nine("maximum"))


QUERIES = {
    f.__name__: f
    for f in (normalize, align, iats, trace_validation, direction_totals, multiscale_cells, multiscale_score, frame_size_ks, iat_ks, iat_diagnostics, acf, acf_score, compare_traces, aggregate_score, trace_summary, short_sequences, quantized, many_comparisons, pair_scores, symmetric_scores, score_variation)
}

# The same in SQL.

TRACE = """
ev AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'reference' ELSE 'generated' END AS trace_id, event_id, epoch_us(ts) AS us0,
  CAST(user_id % 2 AS INTEGER) AS direction, 60 + CAST(round_even(value * 100, 0) AS BIGINT) % 1455 AS frame_length FROM events),
trace AS (SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY event_id) AS seq,
  us0 - min(us0) OVER (PARTITION BY trace_id) AS ts_us, direction, frame_length FROM ev),
win AS (SELECT max(ts_us) AS w_us, max(ts_us) / 1e6 AS w FROM trace WHERE trace_id = 'reference'),
both_ AS (SELECT trace.* FROM trace, win WHERE trace_id = 'reference' OR ts_us <= w_us),
gap AS (SELECT trace_id, seq - 1 AS seq, ts_us - before AS iat_us FROM
  (SELECT *, lag(ts_us) OVER (PARTITION BY trace_id ORDER BY seq) AS before FROM both_) WHERE before IS NOT NULL)"""


def _ks(source: str, x: str) -> str:
    return f"""k1 AS (SELECT {x} AS x, count(*) FILTER (WHERE trace_id = 'reference') AS a, count(*) FILTER (WHERE trace_id = 'generated') AS b FROM {source} GROUP BY {x}),
k2 AS (SELECT sum(a) OVER (ORDER BY x) AS ca, sum(b) OVER (ORDER BY x) AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM k1),
ks AS (SELECT max(abs(ca / na - cb / nb)) AS distance, CAST(max(na) AS BIGINT) AS reference_count, CAST(max(nb) AS BIGINT) AS generated_count FROM k2)"""


SCALES = "scales AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {f}, CAST({w} AS DOUBLE))" for i, (f, w) in enumerate(zip(FRACTIONS, SCALE_WEIGHTS, strict=True))) + ") AS t(scale, fraction, weight))"
SNAP = "CASE WHEN abs({q} - round_even({q}, 0)) <= 4 * (nextafter({q}, CAST('infinity' AS DOUBLE)) - {q}) THEN round_even({q}, 0) ELSE {q} END"
CELLS = f"""{SCALES},
ex AS (SELECT trace_id, scale, weight, direction, frame_length, (ts_us / 1e6) / (w / fraction) AS q, w / (w / fraction) AS qw FROM both_, win, scales),
cells AS (SELECT trace_id, scale, direction, CAST(least(floor({SNAP.format(q="q")}), ceil({SNAP.format(q="qw")}) - 1) AS BIGINT) AS bin, count(*) AS packets,
  CAST(sum(frame_length) AS BIGINT) AS bytes FROM ex GROUP BY ALL)"""
MULTI = f"""{CELLS},
m1 AS (SELECT scale, direction, bin, sum(CASE WHEN trace_id = 'reference' THEN packets ELSE 0 END) AS pa, sum(CASE WHEN trace_id = 'generated' THEN packets ELSE 0 END) AS pb,
  sum(CASE WHEN trace_id = 'reference' THEN bytes ELSE 0 END) AS ba, sum(CASE WHEN trace_id = 'generated' THEN bytes ELSE 0 END) AS bb FROM cells GROUP BY ALL),
m2 AS (SELECT scale, CAST(sum(abs(pa - pb)) AS DOUBLE) / CAST(sum(pa + pb) AS DOUBLE) AS packet, CAST(sum(abs(ba - bb)) AS DOUBLE) / CAST(sum(ba + bb) AS DOUBLE) AS byte FROM m1 GROUP BY scale),
multi AS (SELECT sum(weight * packet) AS packet_discrepancy, sum(weight * byte) AS byte_discrepancy FROM m2 JOIN scales USING (scale))"""
ACF = f"""series AS (SELECT trace_id, 'iat' AS feature, seq, CAST(iat_us AS HUGEINT) AS x FROM gap UNION ALL SELECT trace_id, 'size', seq, CAST(frame_length AS HUGEINT) FROM both_),
whole AS (SELECT trace_id, feature, CAST(count(*) AS HUGEINT) AS n, CAST(sum(x) AS HUGEINT) AS s, CAST(sum(x * x) AS HUGEINT) AS ss FROM series GROUP BY ALL),
lags AS (SELECT * FROM (VALUES {", ".join(f"({k}, CAST({w} AS DOUBLE))" for k, w in zip(LAGS, LAG_WEIGHTS, strict=True))}) AS t(lag, weight)),
pairs AS (SELECT a.trace_id, a.feature, lag, CAST(count(*) AS HUGEINT) AS m, CAST(sum(a.x * b.x) AS HUGEINT) AS xy, CAST(sum(a.x) AS HUGEINT) AS sa, CAST(sum(b.x) AS HUGEINT) AS sb
  FROM series a, lags, series b WHERE a.trace_id = b.trace_id AND a.feature = b.feature AND b.seq = a.seq + lag GROUP BY ALL),
r AS (SELECT trace_id, feature, lag, CASE WHEN n * (n * ss - s * s) = 0 THEN 0.0 ELSE CAST(n * n * xy - n * s * (sa + sb) + m * s * s AS DOUBLE) / CAST(n * (n * ss - s * s) AS DOUBLE) END AS acf FROM pairs JOIN whole USING (trace_id, feature)),
acf AS (SELECT feature, lag, max(CASE WHEN trace_id = 'reference' THEN acf END) AS reference_acf, max(CASE WHEN trace_id = 'generated' THEN acf END) AS generated_acf FROM r GROUP BY ALL),
acfd AS (SELECT sum(CASE WHEN feature = 'iat' THEN weight * abs(reference_acf - generated_acf) / 2 END) AS iat, sum(CASE WHEN feature = 'size' THEN weight * abs(reference_acf - generated_acf) / 2 END) AS size FROM acf JOIN lags USING (lag))"""
ALL = f"""{TRACE}, {ACF}, {MULTI}, {_ks("both_", "frame_length")},
{_ks("gap", "iat_us").replace("k1", "j1").replace("k2", "j2").replace("ks AS", "jks AS")},
four AS (SELECT 'autocorrelation' AS method, 1 - (0.5 * iat + 0.5 * size) AS score FROM acfd UNION ALL SELECT 'frame_size_ks', 1 - distance FROM ks
  UNION ALL SELECT 'iat_ks', 1 - distance FROM jks UNION ALL SELECT 'multiscale_rate', 1 - (0.5 * packet_discrepancy + 0.5 * byte_discrepancy) FROM multi)"""
#: Every pair of a reference and another trace, written out: samples (pr, trace_id 'a' or 'b', seq, ts_us, ...), w by pair.
PAIRED = """
gap AS (SELECT pr, trace_id, seq - 1 AS seq, ts_us - before AS iat_us FROM
  (SELECT *, lag(ts_us) OVER (PARTITION BY pr, trace_id ORDER BY seq) AS before FROM samples) WHERE before IS NOT NULL)"""


def _paired_ks(name: str, source: str, x: str) -> str:
    return f"""{name}1 AS (SELECT pr, {x} AS x, count(*) FILTER (WHERE trace_id = 'a') AS a, count(*) FILTER (WHERE trace_id = 'b') AS b FROM {source} GROUP BY ALL),
{name}2 AS (SELECT pr, sum(a) OVER (PARTITION BY pr ORDER BY x) AS ca, sum(b) OVER (PARTITION BY pr ORDER BY x) AS cb, sum(a) OVER (PARTITION BY pr) AS na, sum(b) OVER (PARTITION BY pr) AS nb FROM {name}1),
{name} AS (SELECT pr, max(abs(ca / na - cb / nb)) AS distance, CAST(max(nb) AS BIGINT) AS n FROM {name}2 GROUP BY pr)"""


def _paired_rates(scales: list[tuple[float, float]]) -> str:
    return f"""scales AS (SELECT * FROM (VALUES {", ".join(f"({i}, CAST({f!r} AS DOUBLE), CAST({w} AS DOUBLE))" for i, (f, w) in enumerate(scales))}) AS t(scale, share, weight)),
ex AS (SELECT pr, trace_id, scale, direction, frame_length, (ts_us / 1e6) / (w * share) AS q, w / (w * share) AS qw FROM samples, scales),
m1 AS (SELECT pr, scale, direction, CAST(least(floor({SNAP.format(q="q")}), ceil({SNAP.format(q="qw")}) - 1) AS BIGINT) AS bin,
  count(*) FILTER (trace_id = 'a') AS pa, count(*) FILTER (trace_id = 'b') AS pb,
  coalesce(sum(frame_length) FILTER (trace_id = 'a'), 0) AS ba, coalesce(sum(frame_length) FILTER (trace_id = 'b'), 0) AS bb FROM ex GROUP BY ALL),
m2 AS (SELECT pr, scale, CAST(sum(abs(pa - pb)) AS DOUBLE) / CAST(sum(pa + pb) AS DOUBLE) AS packet, CAST(sum(abs(ba - bb)) AS DOUBLE) / CAST(sum(ba + bb) AS DOUBLE) AS byte FROM m1 GROUP BY ALL),
multi AS (SELECT pr, sum(weight * packet) AS packet_discrepancy, sum(weight * byte) AS byte_discrepancy FROM m2 JOIN scales USING (scale) GROUP BY pr)"""


CROWD = f"""{TRACE.split("both_ AS")[0]}
own AS (SELECT 'user ' || CAST(user_id % 100 AS VARCHAR) AS pr, event_id, epoch_us(ts) AS us0, CAST((event_id // 2) % 2 AS INTEGER) AS direction,
  60 + CAST(round_even(value * 100, 0) AS BIGINT) % 1455 AS frame_length FROM events WHERE event_id % 2 = 1),
shifted AS (SELECT pr, row_number() OVER (PARTITION BY pr ORDER BY event_id) AS seq, us0 - min(us0) OVER (PARTITION BY pr) AS ts_us, direction, frame_length FROM own),
samples AS (SELECT pr, 'b' AS trace_id, seq, ts_us, direction, frame_length, w FROM shifted, win WHERE ts_us <= w_us
  UNION ALL SELECT pr, 'a', seq, ts_us, direction, frame_length, w FROM trace, win, (SELECT DISTINCT pr FROM own) WHERE trace_id = 'reference')"""
REPEATS = """
ev AS (SELECT event_type || '/' || CAST(user_id % 3 AS VARCHAR) AS id, event_type AS workload, CAST(user_id % 3 AS INTEGER) AS repeat, event_id, epoch_us(ts) AS us0,
  CAST((user_id // 3) % 2 AS INTEGER) AS direction, 60 + CAST(round_even(value * 100, 0) AS BIGINT) % 1455 AS frame_length FROM events),
tr AS (SELECT id, workload, repeat, row_number() OVER (PARTITION BY id ORDER BY event_id) AS seq, us0 - min(us0) OVER (PARTITION BY id) AS ts_us, direction, frame_length FROM ev),
ends AS (SELECT id, workload, repeat, max(ts_us) AS w_us, max(ts_us) / 1e6 AS w FROM tr GROUP BY ALL),
prs AS (SELECT a.id AS reference, b.id AS generated, a.id || '>' || b.id AS pr, a.workload, a.w_us, a.w FROM ends a JOIN ends b ON a.workload = b.workload AND a.repeat <> b.repeat),
samples AS (SELECT pr, 'a' AS trace_id, seq, ts_us, direction, frame_length, w FROM prs JOIN tr ON id = reference
  UNION ALL SELECT pr, 'b', seq, ts_us, direction, frame_length, w FROM prs JOIN tr ON id = generated AND ts_us <= w_us)"""
PAIRED_ACF = f"""series AS (SELECT pr, trace_id, 'iat' AS feature, seq, CAST(iat_us AS HUGEINT) AS x FROM gap UNION ALL SELECT pr, trace_id, 'size', seq, CAST(frame_length AS HUGEINT) FROM samples),
whole AS (SELECT pr, trace_id, feature, CAST(count(*) AS HUGEINT) AS n, CAST(sum(x) AS HUGEINT) AS s, CAST(sum(x * x) AS HUGEINT) AS ss FROM series GROUP BY ALL),
lags AS (SELECT * FROM (VALUES {", ".join(f"({k}, CAST({w} AS DOUBLE))" for k, w in zip(VARIED.lags, LAG_WEIGHTS, strict=True))}) AS t(lag, weight)),
products AS (SELECT a.pr, a.trace_id, a.feature, lag, CAST(count(*) AS HUGEINT) AS m, CAST(sum(a.x * b.x) AS HUGEINT) AS xy, CAST(sum(a.x) AS HUGEINT) AS sa, CAST(sum(b.x) AS HUGEINT) AS sb
  FROM series a, lags, series b WHERE a.pr = b.pr AND a.trace_id = b.trace_id AND a.feature = b.feature AND b.seq = a.seq + lag GROUP BY ALL),
r AS (SELECT pr, trace_id, feature, lag, CASE WHEN n * (n * ss - s * s) = 0 THEN 0.0 ELSE CAST(n * n * xy - n * s * (sa + sb) + m * s * s AS DOUBLE) / CAST(n * (n * ss - s * s) AS DOUBLE) END AS acf FROM products JOIN whole USING (pr, trace_id, feature)),
acf AS (SELECT pr, feature, lag, max(CASE WHEN trace_id = 'a' THEN acf END) AS x, max(CASE WHEN trace_id = 'b' THEN acf END) AS y FROM r GROUP BY ALL),
acfd AS (SELECT pr, sum(CASE WHEN feature = 'iat' THEN weight * abs(x - y) / 2 END) AS iat, sum(CASE WHEN feature = 'size' THEN weight * abs(x - y) / 2 END) AS size FROM acf JOIN lags USING (lag) GROUP BY pr)"""
SCORED = f"""{REPEATS}, {PAIRED}, {_paired_ks("k", "samples", "frame_length")}, {_paired_ks("j", "gap", "iat_us")}, {_paired_rates(list(zip(VARIED.widths, SCALE_WEIGHTS, strict=True)))}, {PAIRED_ACF},
scored AS (SELECT reference, generated, workload, 1 - (0.5 * iat + 0.5 * size) AS autocorrelation, 1 - k.distance AS frame_size_ks, 1 - j.distance AS iat_ks,
  1 - (0.5 * packet_discrepancy + 0.5 * byte_discrepancy) AS multiscale_rate FROM prs JOIN acfd USING (pr) JOIN k USING (pr) JOIN j USING (pr) JOIN multi USING (pr)),
total AS (SELECT *, 0.25 * autocorrelation + 0.25 * frame_size_ks + 0.25 * iat_ks + 0.25 * multiscale_rate AS aggregate_score FROM scored),
sym AS (SELECT workload, least(reference, generated) AS "left", greatest(reference, generated) AS "right", avg(aggregate_score) AS mean_score FROM total GROUP BY ALL)"""
RECORD = "CAST(quantile_disc({x}, 0.95) AS DOUBLE)"

SQL = {
    "normalize": f"WITH {TRACE} SELECT trace_id, count(*) AS events, max(seq) AS last_seq, max(ts_us) AS last_us, CAST(sum(frame_length) AS BIGINT) AS bytes, max(ts_us) / 1e6 AS w FROM trace GROUP BY 1",
    "align": f"WITH {TRACE} SELECT seq, ts_us, direction, frame_length FROM both_ WHERE trace_id = 'generated'",
    "iats": f"WITH {TRACE}, g AS (SELECT trace_id, seq - 1 AS seq, ts_us - lag(ts_us) OVER (PARTITION BY trace_id ORDER BY seq) AS iat_us FROM trace) SELECT * FROM g WHERE iat_us IS NOT NULL",
    "trace_validation": f"""WITH {TRACE}, v AS (SELECT *, ts_us / 1e6 AS ts, lag(ts_us / 1e6) OVER (PARTITION BY trace_id ORDER BY seq) AS before FROM trace)
        SELECT trace_id, count(*) AS events, count(*) FILTER (ts < 0) AS negative, count(*) FILTER (ts < before) AS decreasing, count(*) FILTER (direction NOT IN (0, 1)) AS bad_direction,
        count(*) FILTER (frame_length <= 0 OR frame_length > 4294967295) AS bad_length, count(*) FILTER (frame_length < 14) AS short_frames, max(ts) AS last_ts FROM v GROUP BY 1""",
    "direction_totals": f"WITH {TRACE} SELECT trace_id, "
    + ", ".join(f"count(*) FILTER (direction = {d}) AS {n}_packets, CAST(coalesce(sum(frame_length) FILTER (direction = {d}), 0) AS BIGINT) AS {n}_bytes" for d, n in enumerate(T.LABELS))
    + " FROM trace GROUP BY 1",
    "multiscale_cells": f"WITH {TRACE}, {CELLS} SELECT * FROM cells",
    "multiscale_score": f"WITH {TRACE}, {MULTI} SELECT round(packet_discrepancy, 9) AS packet_discrepancy, round(byte_discrepancy, 9) AS byte_discrepancy, round(1 - (0.5 * packet_discrepancy + 0.5 * byte_discrepancy), 9) AS score FROM multi",
    "frame_size_ks": f"""WITH {TRACE}, {_ks("both_", "frame_length")}, x AS (SELECT min(frame_length) FILTER (trace_id = 'reference') AS reference_minimum_length, max(frame_length) FILTER (trace_id = 'reference') AS reference_maximum_length,
        min(frame_length) FILTER (trace_id = 'generated') AS generated_minimum_length, max(frame_length) FILTER (trace_id = 'generated') AS generated_maximum_length FROM both_) SELECT *, 1 - distance AS score FROM ks, x""",
    "iat_ks": f"WITH {TRACE}, {_ks('gap', 'iat_us')} SELECT *, 1 - distance AS score FROM ks",
    "iat_diagnostics": f"WITH {TRACE} SELECT trace_id, median(iat_us) AS iat_median, {RECORD.format(x='iat_us')} AS iat_quantile, count(*) FILTER (iat_us = 0) AS iat_zeros FROM gap GROUP BY 1",
    "acf": f"WITH {TRACE}, {ACF} SELECT feature, lag, reference_acf, generated_acf FROM acf",
    "acf_score": f"WITH {TRACE}, {ACF} SELECT round(iat, 9) AS iat_discrepancy, round(size, 9) AS size_discrepancy, round(1 - (0.5 * iat + 0.5 * size), 9) AS score FROM acfd",
    "compare_traces": f"WITH {ALL} SELECT method, round(score, 9) AS score, CAST(0.25 AS DOUBLE) AS weight FROM four",
    "aggregate_score": f"WITH {ALL} SELECT "
    + ", ".join(f"round(max(CASE WHEN method = '{m}' THEN score END), 9) AS {m}" for m in S.METHODS)
    + ", round(sum(0.25 * score), 9) AS aggregate_score FROM four",
    "trace_summary": f"""WITH {TRACE}, g AS (SELECT trace_id, ts_us - lag(ts_us) OVER (PARTITION BY trace_id ORDER BY seq) AS iat_us FROM trace),
        a AS (SELECT trace_id, count(*) AS packets, CAST(sum(frame_length) AS BIGINT) AS bytes, min(frame_length) AS length_minimum, median(frame_length) AS length_median, {RECORD.format(x="frame_length")} AS length_quantile, max(frame_length) AS length_maximum FROM trace GROUP BY 1),
        b AS (SELECT trace_id, min(iat_us) AS iat_minimum, median(iat_us) AS iat_median, {RECORD.format(x="iat_us")} AS iat_quantile, max(iat_us) AS iat_maximum, count(*) FILTER (iat_us = 0) AS iat_zeros FROM g WHERE iat_us IS NOT NULL GROUP BY 1) SELECT * FROM a JOIN b USING (trace_id)""",
    "many_comparisons": f"""WITH {CROWD}, {PAIRED}, {_paired_ks("k", "samples", "frame_length")}, {_paired_ks("j", "gap", "iat_us")}, {_paired_rates([(1 / f, w) for f, w in zip(FRACTIONS, SCALE_WEIGHTS, strict=True)])},
        x AS (SELECT pr, min(frame_length) AS generated_minimum_length, max(frame_length) AS generated_maximum_length FROM samples WHERE trace_id = 'b' GROUP BY pr),
        y AS (SELECT pr, median(iat_us) AS generated_median, count(*) FILTER (iat_us = 0) AS generated_zeros FROM gap WHERE trace_id = 'b' GROUP BY pr)
        SELECT pr AS comparison, k.distance AS size_distance, k.n AS generated_count, generated_minimum_length, generated_maximum_length, j.distance AS iat_distance, generated_median, generated_zeros,
        round(packet_discrepancy, 9) AS packet_discrepancy, round(byte_discrepancy, 9) AS byte_discrepancy FROM k JOIN j USING (pr) JOIN multi USING (pr) JOIN x USING (pr) JOIN y USING (pr)""",
    "pair_scores": f"WITH {SCORED} SELECT reference, generated, " + ", ".join(f"round({m}, 9) AS {m}" for m in (*S.METHODS, "aggregate_score")) + " FROM total",
    "symmetric_scores": f'WITH {SCORED} SELECT "left", "right", round(mean_score, 9) AS "symmetric" FROM sym',
    "score_variation": f"WITH {SCORED} SELECT workload, count(*) AS pairs, round(avg(mean_score), 9) AS mean, round(min(mean_score), 9) AS minimum, round(max(mean_score), 9) AS maximum FROM sym GROUP BY workload",
    "short_sequences": """SELECT CAST(l_orderkey AS VARCHAR) AS trace_id, count(*) AS events, count(*) AS last_seq, CAST(sum(CAST(l_quantity * 10 + 14 AS BIGINT)) AS BIGINT) AS bytes, count(*) FILTER (l_linenumber % 2 = 1) AS inbound FROM lineitem GROUP BY 1""",
    "quantized": f"WITH {TRACE}, q AS (SELECT trace_id, seq, (ts_us / 1e6) * 0.7 * 1e6 AS x FROM trace) SELECT trace_id, seq, CAST(floor({SNAP.format(q='x')}) AS BIGINT) AS ticks FROM q",
}
