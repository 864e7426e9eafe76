"""Hand-computed values of the measures, agreement of both forms, and symmetries."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewright.functions import kernels
from tracewright.functions.kernels import Arrays
from tracewright.operators import ordered
from tracewright.operators import similarity as S
from tracewright.operators import traces as T
from tracewright.plans import diagnostics
from tracewright.plans.stages import microseconds


def frame(spark, name, times, lengths=None, directions=None):
    n = len(times)
    return microseconds(T.from_events(spark, name, zip(times, directions or [0] * n, lengths or [60] * n, strict=True)))


@pytest.mark.parametrize(("a", "b", "d"), [([1, 1, 2], [1, 2, 2], 1 / 3), ([1, 2], [1, 3], 0.5), ([1], [2], 1.0), ([5, 5], [5], 0.0)])
def test_ks(spark, a, b, d):
    assert kernels.ks_distance(np.array(a), np.array(b)) == pytest.approx(d, abs=1e-15)
    left = frame(spark, "reference", range(len(a)), a)
    right = frame(spark, "generated", range(len(b)), b)
    assert S.frame_size_ks(left, right).first().distance == pytest.approx(d, abs=1e-15)


def test_iat_ks_and_record(spark):
    a, b = frame(spark, "reference", [0, 0, 1]), frame(spark, "generated", [0, 1, 2])
    row = S.iat_ks(T.iats(a), T.iats(b), 0.5).first()
    assert (row.distance, row.reference_zeros) == (0.5, 1)
    gaps = T.iats(frame(spark, "t", [0, 1, 3, 6, 10]))
    row = S.iat_record(gaps, [], "iat", 0.5, "x").first()
    assert (row.x_median, row.x_quantile) == (2.5, 2.0)


def test_autocorrelation(spark):
    assert kernels.autocorrelations(np.array([1, 2, 1]), [1]) == pytest.approx([-2 / 3])
    assert kernels.autocorrelations(np.array([4, 4, 4]), [1, 2]) == [0.0, 0.0]
    rows = frame(spark, "t", [0, 1, 3], [1, 2, 1]).withColumn("k", F.lit("a"))
    assert S.autocorrelations(rows, ["k"], "frame_length", [1]).first().acf == pytest.approx(-2 / 3)


def test_acf_similarity(spark):
    s = S.Settings(lags=(1, 2), lag_weights=(0.25, 0.75), iat_weight=0.4, size_weight=0.6)
    a = frame(spark, "reference", [0, 1, 3, 6, 10], [1, 2, 1, 2, 1])
    b = frame(spark, "generated", [0, 1, 4, 6, 10], [1, 1, 2, 2, 1])
    found = S.acf_score(S.acf_table(a, b, T.iats(a), T.iats(b), s.lags), s).first().score
    assert found == pytest.approx(111 / 200, abs=1e-12)
    events = [[(t, 0, n) for t, n in zip(ts, ns, strict=True)] for ts, ns in (((0, 1, 3, 6, 10), (1, 2, 1, 2, 1)), ((0, 1, 4, 6, 10), (1, 1, 2, 2, 1)))]
    assert kernels.acf_score(*map(Arrays.of, events), s) == pytest.approx(found, abs=1e-12)


def test_bins():
    assert S.bin_counts(2.1, (0.3,), 100) == [7]
    packets, _ = kernels.cells(Arrays.of([(0.3, 0, 60)]), 0.1, 10)
    assert packets.argmax() == 3
    with pytest.raises(ValueError, match="cap"):
        S.bin_counts(10.0, (0.1,), 100)
    with pytest.raises(ValueError, match="widths"):
        S.bin_counts(1.0, (2.0,), 100)


def test_bins_in_spark(spark):
    row = S.rate_cells(frame(spark, "t", [0.0, 0.3]), 2.1, (0.1, 0.3), 1000, []).where("scale = 0 and bin > 0").collect()
    assert [(r.bin, r.packets) for r in row] == [(3, 1)]
    last = S.rate_cells(frame(spark, "t", [0.0, 2.1]), 2.1, (0.3,), 1000, []).agg(F.max("bin")).first()[0]
    assert last == 6  # the window's end belongs to the last bin


def test_l1():
    assert kernels.l1(np.array([1, 1]), np.array([1, 0])) == pytest.approx(1 / 3)
    assert kernels.l1(np.array([0, 0]), np.array([0, 0])) == 0.0


REFERENCE = [(0.0, 0, 60), (1.0, 1, 100), (3.0, 0, 140), (6.0, 1, 100), (10.0, 0, 60)]
GENERATED = [(0.0, 0, 60), (3.522005, 1, 100), (5.802501, 1, 100)]


def small_settings():
    return S.Settings(lags=(1,), lag_weights=(1.0,), widths=(1.0, 5.0), scale_weights=(0.5, 0.5))


def test_published_scores(spark):
    a, b = microseconds(T.from_events(spark, "reference", REFERENCE)), microseconds(T.from_events(spark, "generated", GENERATED))
    row = S.aggregate(S.compare(a, b, 10.0, small_settings())).first()
    assert row.frame_size_ks == pytest.approx(0.8, abs=1e-12)
    assert row.iat_ks == pytest.approx(0.5, abs=1e-12)
    assert row.autocorrelation == pytest.approx(0.756547619047619, abs=1e-12)


def test_record_and_recheck(spark):
    a, b = microseconds(T.from_events(spark, "reference", REFERENCE)), microseconds(T.from_events(spark, "generated", GENERATED))
    s = S.Settings(lags=(1,), lag_weights=(1.0,), widths=(0.1, 1.0), scale_weights=(0.5, 0.5), quantile=0.95)
    got = diagnostics.comparison(a, b, 10.0, s)
    diagnostics.recheck(got)
    m = {k: v["diagnostics"] for k, v in got["methods"].items()}
    assert got["aggregate_score"] == pytest.approx(0.5662202380952381, abs=1e-12)
    assert m["multiscale_rate"]["scales"][0]["reference_totals"] == {"packet": {"outbound": 3, "inbound": 2}, "byte": {"outbound": 260, "inbound": 200}}
    assert m["multiscale_rate"]["direction_bin_cell_counts"] == [200, 20] and m["multiscale_rate"]["discrepancy"] == pytest.approx(0.7916666666666667)
    assert m["iat_ks"]["generated_quantile_iat_seconds"] == 3.522005 and m["iat_ks"]["reference_median_iat_seconds"] == 2.5
    assert m["frame_size_ks"]["distance"] == 0.19999999999999996 and m["autocorrelation"]["size"]["discrepancy"] == pytest.approx(0.11190476190476194)
    got["methods"]["iat_ks"]["score"] += 1e-9
    with pytest.raises(ValueError, match="iat_ks score"):
        diagnostics.recheck(got)


def test_same_traces_score_one(spark):
    a = microseconds(T.from_events(spark, "reference", REFERENCE))
    row = S.aggregate(S.compare(a, a.withColumn("trace_id", F.lit("generated")), 10.0, small_settings())).first()
    assert row.aggregate_score == pytest.approx(1.0, abs=1e-12)


def test_many_comparisons_at_once(spark):
    a = microseconds(T.from_events(spark, "reference", REFERENCE))
    b = microseconds(T.from_events(spark, "g1", GENERATED)).withColumn("comparison", F.lit("g1"))
    c = a.withColumn("trace_id", F.lit("g2")).withColumn("comparison", F.lit("g2"))
    found = {r.comparison: r.aggregate_score for r in S.aggregate(S.compare(a, b.unionByName(c), 10.0, small_settings())).collect()}
    alone = S.aggregate(S.compare(a, b.drop("comparison"), 10.0, small_settings())).first().aggregate_score
    assert found["g2"] == pytest.approx(1.0) and found["g1"] == pytest.approx(alone)


events = st.lists(st.tuples(st.integers(0, 1_000_000), st.integers(0, 1), st.integers(14, 1500)), min_size=4, max_size=12)


@settings(derandomize=True, max_examples=100, deadline=None)
@given(events, events)
def test_kernel_bounds(a, b):
    x, y = (Arrays.of(sorted((t / 1e6, d, n) for t, d, n in e)) for e in (a, b))
    scores = kernels.compare(x, y, 1.0, S.Settings(lags=(1, 2), lag_weights=(0.5, 0.5), widths=(0.1, 0.4), scale_weights=(0.5, 0.5)))
    assert all(0 <= v <= 1 and math.isfinite(v) for v in scores.values())
    assert kernels.compare(x, x, 1.0, S.Settings(lags=(1,), lag_weights=(1.0,), widths=(0.1,), scale_weights=(1.0,)))["aggregate_score"] == pytest.approx(1.0)


def test_both_forms_agree(spark):
    """Twelve random pairs through one job, against the kernels."""
    rng = np.random.default_rng(5)
    make = lambda n: sorted((int(t) / 1e6, int(d), int(k)) for t, d, k in zip(rng.integers(0, 10**7, n), rng.integers(0, 2, n), rng.integers(14, 1500, n), strict=True))
    reference = make(60)
    reference = [(t - reference[0][0], d, n) for t, d, n in reference]
    w = reference[-1][0]
    s = S.Settings(lags=(1, 3), lag_weights=(0.5, 0.5), widths=(w / 9, w / 2), scale_weights=(0.25, 0.75))
    made, frames = {}, None
    for i in range(12):
        e = make(40)
        e = [(round(t - e[0][0], 6), d, n) for t, d, n in e if t - e[0][0] <= w]
        made[f"g{i}"] = kernels.compare(Arrays.of(reference), Arrays.of(e), w, s)
        f = T.from_events(spark, f"g{i}", e).withColumn("comparison", F.lit(f"g{i}"))
        frames = f if frames is None else frames.unionByName(f)
    rows = S.aggregate(S.compare(microseconds(T.from_events(spark, "reference", reference)), microseconds(frames), w, s)).collect()
    assert len(rows) == 12
    for r in rows:
        for m, v in made[r.comparison].items():
            assert r[m] == pytest.approx(v, abs=1e-9), (r.comparison, m)


def test_settings_are_checked():
    with pytest.raises(ValueError, match="weights"):
        S.Settings(lags=(1,), lag_weights=(0.9,), widths=(1.0,), scale_weights=(1.0,)).check(10.0)
    with pytest.raises(ValueError, match="lags"):
        S.Settings(lags=(1, 1), lag_weights=(0.5, 0.5), widths=(1.0,), scale_weights=(1.0,)).check(10.0)


def test_traces_without_microseconds(spark):
    """compare takes the canonical schema, whose times are doubles, and finds what it finds for whole microseconds."""
    rng = random.Random(4)
    events = {n: [(t, rng.randrange(2), rng.randint(60, 200)) for t in sorted(rng.randrange(10**7) / 1e6 for _ in range(300))] for n in "ab"}
    frames = {n: T.normalize(T.from_events(spark, n, e))[0] for n, e in events.items()}
    s = S.Settings(lags=(1, 4), lag_weights=(0.5, 0.5), widths=(0.5,), scale_weights=(1.0,))
    exact = {n: f.withColumn("ts_us", F.rint(F.col("ts") * 1e6).cast("bigint")) for n, f in frames.items()}
    found = [{r.method: r.score for r in S.compare(f["a"], T.align(f["b"], 10.0), 10.0, s).collect()} for f in (frames, exact)]
    assert found[0]["autocorrelation"] == pytest.approx(found[1]["autocorrelation"]) and found[0]["multiscale_rate"] == pytest.approx(found[1]["multiscale_rate"])
    assert found[0].keys() == found[1].keys() and all(0 <= v <= 1 for f in found for v in f.values())
    flat = spark.createDataFrame([("x", i, 0.1) for i in range(1, 40)], "f string, seq bigint, x double")
    assert [r.acf for r in S.autocorrelations(flat, ["f"], "x", [1, 2]).collect()] == [0.0, 0.0]


def test_autocorrelations_of_large_values(spark):
    """Terms beyond 38 digits are taken as centred doubles."""
    rng = np.random.default_rng(1)
    x = rng.integers(0, 10**15, 3000) + 10**15
    series = spark.createDataFrame([("x", i + 1, int(v)) for i, v in enumerate(x)], "f string, seq bigint, x bigint")
    got = {r.lag: r.acf for r in S.autocorrelations(series, ["f"], "x", [1, 7]).collect()}
    c = x - x.mean()
    assert got == pytest.approx({k: float((c[:-k] * c[k:]).sum() / (c * c).sum()) for k in (1, 7)})


def test_order_figures_with_an_outlier(spark):
    rng = np.random.default_rng(2)
    x = np.append(rng.integers(0, 50_000, 20_000), 10**15)
    rows = spark.createDataFrame(pd.DataFrame({"g": "a", "x": x}))
    r = ordered.order_figures(rows, ["g"], "x", 0.95).first()
    n = len(x)
    assert (r["count"], r.minimum, r.median, r.quantile, r.maximum, r.zeros) == (n, x.min(), np.median(x), np.sort(x)[int(np.ceil(0.95 * n)) - 1], 10**15, (x == 0).sum())
    counts = rows.groupBy("g", "x").count()
    totals = ordered.running_totals(counts, ["g"], "x", ["count"], ranges=16, direct=0)
    assert {r.x: r.total_count for r in totals.collect()} == {int(v): int((x <= v).sum()) for v in np.unique(x)}


# Many comparisons, and references with windows of their own


def crowd(seed, n=7):
    """Traces of different sizes and spans, one of them shorter than the others, times in whole microseconds."""
    rng = np.random.default_rng(seed)
    made = {}
    for i in range(n):
        size = 12 + 9 * i
        ts = np.round(np.concatenate(([0.0], np.cumsum(rng.choice([0.0, 0.25, 0.5, 1.75], size - 1)) + 0.5)), 6)
        made[f"t{i}"] = list(zip(ts.tolist(), rng.integers(0, 2, size).tolist(), rng.choice([60, 61, 900, 1514], size).tolist(), strict=True))
    return made


def tables(spark, made):
    out = None
    for name, events in made.items():
        one = microseconds(T.from_events(spark, name, events))
        out = one if out is None else out.unionByName(one)
    return out.persist()


WIDE = dict(lags=(1, 2, 3), lag_weights=(0.5, 0.25, 0.25), scale_weights=(0.25, 0.75))


def test_comparisons_equal_single_ones(spark):
    """All comparisons at once, without the reference copied, against the NumPy kernels one by one."""
    made = crowd(4)
    all_ = tables(spark, made)
    reference, _ = T.normalize(all_.where("trace_id = 't3'"))
    w = T.window_of(reference)
    s = S.Settings(widths=(w / 8, w / 2), **WIDE)
    got = {r.comparison: r for r in S.aggregate(S.compare(reference, T.align(all_, w).withColumn("comparison", F.col("trace_id")), w, s)).collect()}
    ours = Arrays.of(made["t3"])
    assert set(got) == set(made) and got["t3"].aggregate_score == 1.0
    for name, events in made.items():
        want = kernels.compare(ours, Arrays.of([e for e in events if e[0] <= w]), w, s)
        assert {m: got[name][m] for m in S.METHODS} == pytest.approx({m: want[m] for m in S.METHODS}, abs=1e-12)


def test_pairs_have_their_own_windows(spark):
    made = crowd(9)
    all_ = tables(spark, made)
    pairs = [(a, b) for a in ("t2", "t5", "t0") for b in made if a != b]
    s = S.Settings(widths=(1 / 8, 1 / 2), **WIDE)
    got = {(r.reference, r.comparison): r for r in S.aggregate(S.compare_pairs(all_, spark.createDataFrame(pairs + pairs[:2], "reference string, generated string"), s)).collect()}
    assert set(got) == set(pairs)
    for a, b in pairs:
        w = made[a][-1][0]
        literal = S.Settings(widths=(w / 8, w / 2), **WIDE)
        want = kernels.compare(Arrays.of(made[a]), Arrays.of([e for e in made[b] if e[0] <= w]), w, literal)
        assert {m: got[a, b][m] for m in S.METHODS} == pytest.approx({m: want[m] for m in S.METHODS}, abs=1e-12)


def test_variation_of_repeats(spark):
    from tracewright.operators import study

    made = crowd(2, 5)
    all_ = tables(spark, made)
    runs = spark.createDataFrame([("x", i, f"t{i}") for i in range(3)] + [("y", i, f"t{i + 3}") for i in range(2)], "workload string, repeat int, trace_id string")
    s = S.Settings(widths=(1 / 8, 1 / 2), **WIDE)
    got = {r.workload: r for r in study.variation_of(all_, runs, s).collect()}

    def score(a, b):
        w = made[a][-1][0]
        one = kernels.compare(Arrays.of(made[a]), Arrays.of([e for e in made[b] if e[0] <= w]), w, S.Settings(widths=(w / 8, w / 2), **WIDE))
        return sum(0.25 * one[m] for m in S.METHODS)

    both = lambda a, b: (score(a, b) + score(b, a)) / 2
    x = [both("t0", "t1"), both("t0", "t2"), both("t1", "t2")]
    assert (got["x"].pairs, got["y"].pairs) == (3, 1)
    assert (got["x"]["mean"], got["x"].minimum, got["x"].maximum) == pytest.approx((sum(x) / 3, min(x), max(x)), abs=1e-12)
    assert got["y"]["mean"] == pytest.approx(both("t3", "t4"), abs=1e-12)


def test_preconditions_are_named(spark):
    """A trace too short for a measure is an error that names the trace and what it lacks."""
    reference = frame(spark, "reference", range(20), [60, 70] * 10)
    s = S.Settings(lags=(1, 4), lag_weights=(0.5, 0.5), widths=(2.0,), scale_weights=(1.0,))
    for times, method in (([0, 1, 2, 3], "autocorrelation"), ([0], "autocorrelation")):
        with pytest.raises(Exception, match=f"comparison generated has no {method}: it needs more inter-arrival times than the longest lag"):
            S.aggregate(S.compare(reference, frame(spark, "g", times), 19.0, s)).collect()
    several = frame(spark, "g", range(12), [60] * 12).withColumn("comparison", F.lit("long")).unionByName(frame(spark, "h", [0]).withColumn("comparison", F.lit("short")))
    with pytest.raises(Exception, match="comparison short has no"):
        S.aggregate(S.compare(reference, several, 19.0, s)).collect()


@pytest.mark.parametrize("by", [[], ["g"]])
def test_totals_by_window_and_by_ranges(spark, by):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(k, int(x), int(n), 1) for k in "ab" for x, n in zip(rng.permutation(4000)[:900], rng.integers(1, 9, 900), strict=True)], "g string, x bigint, n bigint, m bigint")
    rows = rows.groupBy(*by, "x").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    one, other = (sorted(map(tuple, ordered.running_totals(rows, by, "x", ["n", "m"], 16, direct=d).select(*by, "x", "n", "total_n", "total_m").collect())) for d in (0, 10**6))
    assert one == other and len(one) == rows.count()


@pytest.mark.parametrize("ranges", [1, 2, 7, 16, 256])
def test_totals_of_long_and_short_groups(spark, ranges):
    """Long groups are cut at quantiles, short ones beside them aren't; both get their group's total."""
    rng = np.random.default_rng(4)
    made = {g: rng.permutation(10_000)[:k] - 5_000 for g, k in (("long", 3_000), ("short", 90), ("one", 1))}
    made["crowd"] = np.append(np.arange(1_500), 10**15)
    rows = spark.createDataFrame([(g, int(v), int(v) % 7 + 1) for g, x in made.items() for v in x], "g string, x bigint, n bigint")
    got = {(r.g, r.x): (r.total_n, r.whole_n) for r in ordered.running_totals(rows, ["g"], "x", ["n"], ranges, direct=500).collect()}
    expected = {}
    for g, x in made.items():
        x = np.sort(x)
        for v, t in zip(x, np.cumsum(x % 7 + 1), strict=True):
            expected[g, int(v)] = (int(t), int((x % 7 + 1).sum()))
    assert got == expected


def test_long_groups_are_not_gathered(spark, monkeypatch):
    """The figures of a long sample, and the KS distances of long ones, take no shuffle by group alone of its values."""
    rng = np.random.default_rng(5)
    x = {g: rng.integers(0, 10**9, 4_000) for g in ("a", "b", "r")}
    rows = spark.createDataFrame([(g, int(v)) for g in x for v in x[g]], "comparison string, x bigint")
    reference, generated = rows.where("comparison = 'r'").select("x"), rows.where("comparison <> 'r'")
    monkeypatch.setattr(ordered.running_totals, "__defaults__", (*ordered.running_totals.__defaults__[:-1], 500))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        figures, distances = ordered.order_figures(rows, ["comparison"], "x", 0.95), S.ks(reference, generated, "x")
        for frame in (figures, distances):
            plan = frame._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and not re.search(r"(SortMerge|ShuffledHash)Join \[[^,\]]*comparison#\d+\]", plan)
        for r in figures.collect():
            v = np.sort(x[r.comparison])
            assert (r["count"], r["median"], r["quantile"]) == (len(v), np.median(v), v[int(np.ceil(0.95 * len(v))) - 1])
        for r in distances.collect():
            assert r.distance == pytest.approx(kernels.ks_distance(x["r"], x[r.comparison]), abs=1e-12) and (r.reference_count, r.generated_count) == (4_000, 4_000)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
