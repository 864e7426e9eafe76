"""The trace model and the order-dependent operators."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewright.functions import numeric
from tracewright.operators import ordered
from tracewright.operators import traces as T


def test_closed_window(spark):
    t = T.from_events(spark, "g", [(5.0, "outbound", 60), (7.0, "inbound", 70), (7.5, 0, 80)])
    kept = T.align(t, 2.0).orderBy("seq").collect()
    assert [(r.ts, r.direction, r.frame_length) for r in kept] == [(0.0, 0, 60), (2.0, 1, 70)]


def test_normalize(spark):
    shifted, meta = T.normalize(T.from_events(spark, "r", [(10.0, 0, 60), (11.0, 1, 100), (20.0, 0, 60)]))
    assert T.to_events(shifted) == [(0.0, 0, 60), (1.0, 1, 100), (10.0, 0, 60)] and meta.first().w == 10.0
    with pytest.raises(Exception, match="positive time"):
        T.normalize(T.from_events(spark, "r", [(1.0, 0, 60), (1.0, 0, 60)]))[1].collect()


def test_validation(spark):
    bad = T.from_events(spark, "b", [(0.0, 0, 60), (-1.0, 0, 10), (2.0, 1, 0)])
    r = T.validation(bad).first()
    assert (r.events, r.negative, r.decreasing, r.bad_length, r.short_frames) == (3, 1, 1, 1, 2)
    with pytest.raises(ValueError, match="decreasing"):
        T.require_valid(bad)
    T.require_valid(T.from_events(spark, "g", [(0.0, 0, 60), (0.0, 1, 60), (3.0, 0, 60)]), minimum=2, window=3.0, fitting=True)
    with pytest.raises(ValueError, match="after the window"):
        T.require_valid(T.from_events(spark, "g", [(0.0, 0, 60), (3.0, 0, 60)]), window=2.0, encoding=True)


def test_iats_keep_zeros_and_ties(spark):
    gaps = T.iats(T.from_events(spark, "t", [(0.0, 0, 60), (0.0, 0, 61), (1.5, 0, 62)])).orderBy("seq").collect()
    assert [(r.seq, r.iat) for r in gaps] == [(1, 0.0), (2, 1.5)]


def test_equality_and_pieces(spark):
    a = T.from_events(spark, "a", [(0.0, 0, 60), (1.0, 1, 70), (2.0, 0, 80)])
    assert T.equal(a, a.withColumn("trace_id", F.lit("b")))
    assert not T.equal(a, a.withColumn("frame_length", F.col("frame_length") + 1))
    assert T.to_events(T.piece(a, 1, 3)) == [(1.0, 1, 70), (2.0, 0, 80)]
    assert T.to_events(T.towards(a, 1)) == [(1.0, 1, 70)]


@pytest.mark.parametrize("chunk", [1, 2, 3, 100])
def test_chunks_change_nothing(spark, chunk):
    rows = spark.createDataFrame([("a", i, (i * 7) % 11) for i in range(1, 24)] + [("b", i, i) for i in range(1, 4)], "trace_id string, seq bigint, x bigint")
    got = {(r.trace_id, r.seq): r.before for r in ordered.lagged(rows, "trace_id", {"before": "x"}, chunk=chunk).collect()}
    assert got == {("a", i): (i * 7 - 7) % 11 if i > 1 else None for i in range(1, 24)} | {("b", i): i - 1 or None for i in range(1, 4)}
    lags = [1, 2] if chunk > 1 else [1]
    sums = {(r.trace_id, r.lag): (r.m, int(r.xy)) for r in ordered.lag_products(rows, ["trace_id"], "x", lags, chunk=chunk).collect()}
    a = [(i * 7) % 11 for i in range(1, 24)]
    for k in lags:
        assert sums["a", k] == (23 - k, sum(p * q for p, q in zip(a, a[k:], strict=False)))
    shuffled = rows.drop("seq").withColumn("id", F.when(F.col("trace_id") == "a", F.col("x") * 100 + F.rand(1)).otherwise(F.col("x")).cast("bigint"))
    numbered = ordered.numbered(shuffled.dropDuplicates(["trace_id", "id"]), "trace_id", "id", chunk=chunk * 50)
    for name in "ab":
        seqs = [r.seq for r in numbered.where(F.col("trace_id") == name).orderBy("id").collect()]
        assert seqs == list(range(1, len(seqs) + 1))


def test_running_totals(spark):
    rows = spark.createDataFrame([("k", x * x, 1) for x in range(20)] + [("one", 5, 3)], "k string, x bigint, n bigint")
    for ranges in (1, 3, 256):
        got = {(r.k, r.x): r.total_n for r in ordered.running_totals(rows, ["k"], "x", ["n"], ranges, direct=0).collect()}
        assert got == {("k", x * x): x + 1 for x in range(20)} | {("one", 5): 3}


@settings(derandomize=True, max_examples=3, deadline=None)
@given(st.lists(st.floats(1e-300, 1e300), min_size=200, max_size=200))
def test_ulp(spark, values):
    import math

    values += [2.0**k * (1 - s * 2.0**-53) for k in range(-60, 60) for s in (0, 1)]
    rows = spark.createDataFrame([(v,) for v in values], "q double").select("q", numeric.ulp(F.col("q")).alias("u")).collect()
    assert all(r.u == math.ulp(r.q) for r in rows)


def test_snap_reflect_and_genes(spark):
    q = spark.createDataFrame([(0.3 / 0.1,), (2.1 / 0.3,), (2.5,), (0.0,)], "q double")
    assert [r[0] for r in q.select(numeric.snap(F.col("q"))).collect()] == [3.0, 7.0, 2.5, 0.0]
    z = spark.createDataFrame([(-0.25,), (1.25,), (2.5,), (0.5,)], "z double")
    assert [r[0] for r in z.select(numeric.reflect(F.col("z"))).collect()] == [0.25, 0.75, 0.5, 0.5]
    one = spark.range(1)
    got = one.select(
        numeric.decode_gene("integer", F.lit(0.5), F.lit(1), F.lit(4)).alias("a"), numeric.decode_gene("log", F.lit(1.0), F.lit(0.5), F.lit(1.5)).alias("b"),
        numeric.encode_gene("log", F.lit(0.5), F.lit(0.5), F.lit(1.5)).alias("c"), numeric.microsecond_ticks(F.lit(0.3)).alias("d"), numeric.round_half_up(F.lit(2.5)).alias("e"),
    ).first()
    assert (got.a, got.b, got.c, got.d, got.e) == (3, 1.5, 0.0, 300000, 3)
    with pytest.raises(Exception, match="outside"):
        one.select(numeric.clamp(F.lit(1.5), 0.0, 1.0, 1e-12, "x")).collect()


def test_lag_sums_are_exact(spark):
    """Sums of products of whole numbers of any size and sign, taken as longs within a chunk."""
    rng = random.Random(11)
    series = {"long": [rng.randrange(-(2**58), 2**58) for _ in range(60)], "times": [rng.randrange(-5, 2**44) for _ in range(150)], "ends": [2**62, -(2**62), -1, 0, 1, 2**21, 2**42, -(2**42)], "one": [-7]}
    rows = spark.createDataFrame([(t, i, x) for t, xs in series.items() for i, x in enumerate(xs, 1)], "trace_id string, seq bigint, x bigint")
    got = {(r.trace_id, r.lag): tuple(int(v) for v in (r.m, r.xy, r.sa, r.sb, r.n, r.s, r.ss)) for r in ordered.lag_sums(rows, ["trace_id"], "x", [1, 4, 16], chunk=32).collect()}
    want = {}
    for t, xs in series.items():
        for k in (1, 4, 16):
            if pairs := list(zip(xs, xs[k:], strict=False)):
                want[t, k] = (len(pairs), sum(a * b for a, b in pairs), sum(a for a, _ in pairs), sum(b for _, b in pairs), len(xs), sum(xs), sum(x * x for x in xs))
    assert got == want
