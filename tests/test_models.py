"""Models, generators, the genetic search and its files: literal draws, published results and limits."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.functions import kernels, passing
from tracewright.functions.kernels import Arrays
from tracewright.functions.passing import Passing
from tracewright.operators import fitting, models, scoring, study
from tracewright.operators import traces as T
from tracewright.operators.models import Limits, Markov, Marks, Mmpp, Poisson
from tracewright.operators.similarity import Settings
from tracewright.plans import model_queries
from tracewright.plans.genetic import Engine, Operators, Search, checkpoint, load_checkpoint
from tracewright.sources import artifacts

# The published reference of this search, as (seconds, direction, length).
EVENTS = [
    (20.0, 0, 60), (20.4, 1, 96), (20.9, 0, 128),
    (21.5, 0, 256), (22.0, 1, 96), (22.4, 1, 512),
    (23.0, 0, 60), (23.5, 1, 128), (24.0, 0, 256),
    (24.6, 1, 96), (25.0, 0, 512), (25.4, 0, 60),
    (26.0, 1, 128), (26.5, 0, 256), (27.0, 1, 96),
    (27.6, 1, 512), (28.0, 0, 60), (28.4, 1, 128),
    (29.0, 0, 256), (29.5, 1, 96), (30.0, 0, 512),
]
# The published history of this search.
HISTORY = """generation,scope,family,candidate_count,valid_count,best_fitness,mean_fitness,best_birth_generation,best_birth_index
0,family,markov_renewal,2,2,0.6398099054770963,0.6089338854071218,0,1
0,family,mmpp,2,2,0.6193079369462571,0.6160744619158594,0,5
0,family,poisson_empirical,2,2,0.6517147621427798,0.648179719179514,0,2
0,overall,,6,6,0.6517147621427798,0.6243960221674983,0,2
1,family,markov_renewal,1,1,0.6398099054770963,0.6398099054770963,0,1
1,family,mmpp,2,2,0.6193079369462571,0.6160744619158594,0,5
1,family,poisson_empirical,3,3,0.6517147621427798,0.6455322855394217,0,2
1,overall,,6,6,0.6517147621427798,0.6347592809878466,0,2
"""


def reference() -> Arrays:
    a = Arrays.of(EVENTS)
    return Arrays(a.ts - a.ts[0], a.direction, a.length)


def search(**more) -> Search:
    # The published bounds of this search.
    bounds = {
        "poisson_empirical": {"c_lambda": (0.5, 1.5)},
        "markov_renewal": {"q1": (0.15, 0.45), "q2": (0.55, 0.9), "alpha": (0.05, 1.5), "r": (1, 4), "c_t": (0.5, 1.5)},
        "mmpp": {"q01": (0.2, 2.0), "q10": (0.2, 2.0), "lambda0": (0.5, 3.0), "lambda1": (3.0, 8.0)},
    }
    m = more.pop("mutation", 0.0)
    ops = {"poisson_empirical": Operators(0.35, m, 0.07), "markov_renewal": Operators(1.0, m, 0.06), "mmpp": Operators(0.45, m, 0.08)}
    base = {"population": 6, "generations": 1, "tournament": 2, "elites": 1, "seeds": (17,), "master_seed": 73, "final_seed": 97, "limits": Limits(500, 1_000_000, 5.0)}
    return Search(bounds, ops, **(base | more))


def engine(s: Search) -> Engine:
    return Engine(s, reference(), 10.0, Settings(lags=(1,), lag_weights=(1.0,), widths=(1.0, 2.5), scale_weights=(0.5, 0.5), quantile=0.75, max_cells=100))


def test_published_history(spark):
    e = engine(search())
    assert e.priority == ("markov_renewal", "poisson_empirical", "mmpp")
    state = e.run(spark)
    assert artifacts.history_csv(list(state.history)).decode() == HISTORY
    assert state == e.run(None)  # the job gives what this process gives
    assert 0 < e.final(spark, state)["aggregate_score"] < 1


def test_resume_equals_one_run():
    s = search(generations=3, mutation=0.4, population=8, seeds=(17, 19))
    saved = []
    whole = engine(s).run(None, publish=saved.append)
    again = engine(s).run(None, load_checkpoint(checkpoint(s, saved[1]), s))
    assert again.history == whole.history and again.population == whole.population
    with pytest.raises(ValueError, match="another search"):
        load_checkpoint(checkpoint(s, saved[1]), search())


def test_early_stop():
    state = engine(search(generations=9, stop_after=2, tolerance=1.0)).run(None)
    assert (state.generation, state.reason) == (2, "early_stop")


def test_search_is_checked():
    with pytest.raises(ValueError, match="fresh"):
        search(seeds=(97,))
    with pytest.raises(ValueError, match="population"):
        search(population=3)


def test_poisson_replay():
    p = Poisson(0.4, 0.4, Marks(((0, 60, 2), (1, 100, 2), (0, 140, 1))))
    out = p.generate(54321, 10.0)
    assert out.complete and len(out.events) == 3
    assert round(float(np.median(Arrays.of(out.events).iats)), 6) == 2.901251
    assert out.events == p.generate(54321, 10.0).events


def test_limits_give_incomplete_results():
    p = Poisson(50.0, 50.0, Marks(((0, 100, 1),)))
    assert p.generate(1, 10.0, Limits(5, 10**6, 1.0)).reason == "max_packets"
    assert p.generate(1, 10.0, Limits(10**6, 450, 1.0)).reason == "max_output_bytes"
    ticks = iter(range(100))
    assert p.generate(1, 10.0, Limits(10**6, 10**6, 3.0), clock=lambda: float(next(ticks))).reason == "max_wall_seconds"


def test_markov_fit_and_payload():
    t = reference()
    m = models.fit("markov_renewal", (0.3, 0.7, 0.5, 2, 1.0), t, 10.0)
    assert len(m.global_iats) == 20 and sum(map(len, m.lengths)) == 21
    assert all(abs(sum(r) - 1) < 1e-12 for r in m.rows)
    assert sum(len(x) for row in m.edge_iats for x in row) == 20
    for family, genes in (("markov_renewal", (0.3, 0.7, 0.5, 2, 1.0)), ("mmpp", (0.5, 0.5, 1.0, 4.0)), ("poisson_empirical", (1.0,))):
        made = models.fit(family, genes, t, 10.0)
        again = models.restore(family, artifacts.strict_json(artifacts.canonical(models.payload(made))))
        assert again == made and again.generate(3, 10.0).events == made.generate(3, 10.0).events
    assert m.pick((0.25, 0.25, 0.5), 0.25) == 1 and Markov.pick((1.0,), 0.99) == 0


def test_repair():
    t = reference()
    assert models.repair("mmpp", (9.0, 0.1, 5.0, 1.0), search().bounds["mmpp"], t) == (2.0, 0.2, 1.0, 5.0)
    assert models.repair("markov_renewal", (0.8, 0.2, 9.0, 2.5, 1.0), search().bounds["markov_renewal"], t)[:4] == (0.2, 0.8, 1.5, 3)
    with pytest.raises(models.RepairError):
        models.repair("mmpp", (1.0, 1.0, 1.0, 1.0), {"q01": (0, 2), "q10": (0, 2), "lambda0": (1, 2), "lambda1": (1, 2)}, t)


def test_mmpp_moments():
    m = Mmpp(0.5, 0.5, 2.0, 10.0, Marks(((0, 60, 1),)))
    n = [len(m.generate(s, 200.0).events) for s in range(20)]
    assert abs(np.mean(n) / 200 - 6.0) < 0.6
    alone = Mmpp(1e-9, 1e-9, 3.0, 3.0 + 1e-9, Marks(((0, 60, 1),)))
    gaps = [0.2, 0.5, 0.1]
    assert models.mmpp_log_likelihood(alone, gaps, 0.3) == pytest.approx(3 * np.log(3.0) - 3.0 * (sum(gaps) + 0.3), abs=1e-6)


def test_generation_job(spark):
    p = Poisson(2.0, 2.0, Marks(((0, 60, 1), (1, 100, 1))))
    asked = spark.createDataFrame([("a", "m", 1), ("b", "m", 2)], "comparison string, model string, seed bigint")
    made = models.generate(asked, {"m": p}, 10.0)
    for name, seed in (("a", 1), ("b", 2)):
        assert T.to_events(made.where(F.col("comparison") == name)) == p.generate(seed, 10.0).events
    with pytest.raises(Exception, match="max_packets"):
        models.generate(asked, {"m": p}, 10.0, Limits(3, 10**6, 1.0)).collect()


def test_fit_statistics_match_the_model(spark):
    t = reference()
    frame = T.from_events(spark, "r", zip(t.ts.tolist(), t.direction.tolist(), t.length.tolist(), strict=True))
    m = models.fit("markov_renewal", (0.3, 0.7, 0.5, 2, 1.0), t, 10.0)
    cut = fitting.type7_thresholds(frame, 0.3, 0.7)
    assert (cut.first().t1, cut.first().t2) == pytest.approx(m.thresholds)
    stated = fitting.states(frame, cut)
    steps = fitting.transitions(stated)
    counts = fitting.transition_counts(steps, stated)
    rows = {(r.source, r.destination): (r.n, r.p) for r in fitting.transition_rows(counts, 0.5).collect()}
    for (i, j), (n, p) in rows.items():
        assert n == len(m.edge_iats[i][j]) and p == pytest.approx(m.rows[i][j])
    marks = fitting.marks(frame).orderBy("first_seq").collect()
    assert tuple((r.direction, r.frame_length, r["count"]) for r in marks) == Marks.of(t).entries
    assert fitting.flow_consistent(fitting.flow(counts, stated)).first().consistent
    assert fitting.connected(counts).first().connected
    usage = fitting.tier_usage(fitting.timing_tiers(counts, 2)).first()
    assert usage.transition_count + usage.source_count + usage.global_count == 20
    lists = {(r.source, r.destination): r.iats for r in fitting.iat_samples(steps, ["source", "destination"]).collect()}
    assert all(lists[k] == pytest.approx(list(m.edge_iats[k[0]][k[1]])) for k in lists)
    sample = steps.select("iat")
    assert fitting.same_multiset(sample, steps.orderBy("iat").select("iat"))


def test_bootstrap(spark):
    assert study.bootstrap_interval([1, 2, 4, 8]) == pytest.approx((1.5, 6.5))
    assert study.bootstrap_interval([3.0, 3.0]) == (3.0, 3.0)
    rows = spark.createDataFrame([("a", float(x)) for x in (1, 2, 4, 8)] + [("b", 3.0)], "k string, x double")
    got = {r.k: (r.lower_bound, r.upper_bound) for r in study.bootstrap(rows, ["k"], "x").collect()}
    assert got == {"a": pytest.approx((1.5, 6.5)), "b": (3.0, 3.0)}


@pytest.mark.parametrize("family, genes, other", [("poisson_empirical", (1.5,), "mmpp"), ("mmpp", (0.5, 0.25, 1.0, 4.0), "poisson_empirical"), ("markov_renewal", (0.3, 0.7, 0.5, 2, 1.0), "mmpp")])
def test_model_file(family, genes, other):
    """A model file of each family is read, restored and written back byte for byte; files that contradict themselves aren't."""
    t = Arrays.of([(i * 0.5, i * i % 2, (60, 900, 1514)[i * 7 % 3]) for i in range(21)])
    model = dict.fromkeys(artifacts.BEST_MODEL_KEYS, 1)
    model |= {"family": family, "fitted": models.payload(models.fit(family, genes, t, 10.0)), "estimator_choices": models.ESTIMATORS[family], "seed_policy": models.SEEDS}
    model |= {k: {"size": 1, "sha256": "0" * 64} for k in ("reference_identity", "capture_identity")}
    content = artifacts.render_best_model(model)
    found = artifacts.parse_best_model(content)
    made = models.restore(found["family"], found["fitted"])
    assert models.payload(made) == found["fitted"] and artifacts.render_best_model(found) == content
    for k, v in (("seed_policy", {}), ("estimator_choices", models.ESTIMATORS[other]), ("family", other), ("fitted", found["fitted"] | {"marks": []}), ("fitted", {}), ("capture_identity", {"size": 1, "sha256": "x"})):
        with pytest.raises(ValueError):
            artifacts.render_best_model(found | {k: v})


def test_wall_clock_is_the_default():
    p = Poisson(1e7, 1e7, Marks(((0, 60, 1),)))
    assert p.generate(1, 1e6, Limits(10**9, 10**12, 0.05)).reason == "max_wall_seconds"


def test_generated_rows_are_compact_and_spread(spark):
    """eight requests run in eight tasks, and events are columns, not tuples."""
    p = Poisson(2.0, 2.0, Marks(((0, 60, 1), (1, 100, 1))))
    asked = spark.range(8).select(F.concat(F.lit("r"), "id").alias("comparison"), F.lit("m").alias("model"), "id").withColumnRenamed("id", "seed")
    made = models.generate(asked, {"m": p}, 10.0).withColumn("task", F.spark_partition_id())
    assert made.select("task").distinct().count() == made.select("comparison").distinct().count() == 8
    events = p.generate(1, 10.0).events
    assert events[0] == (0.0, *events[0][1:]) and events.ts.itemsize + events.direction.itemsize + events.length.itemsize == 17
    assert model_queries._limits(3_000_000).max_wall_seconds > 30 == model_queries._limits(50_000).max_wall_seconds


def long_trace(spark, n: int = 150_000):
    """More than one chunk of arrays."""
    return spark.range(n).select(F.lit("r").alias("trace_id"), (F.col("id") + 1).alias("seq"), (F.col("id") * 0.5 + F.col("id") % 3 * 0.125).alias("ts"), (F.col("id") * 7 % 5 % 2).cast("tinyint").alias("direction"), (60 + F.col("id") * 31 % 1455).alias("frame_length"))


def test_stored_reference(spark, monkeypatch):
    """a fit and a search on a trace that stays in Spark give what its arrays give; its rows never reach the driver."""
    rows = long_trace(spark)
    t = Arrays.of([(r.ts, r.direction, r.frame_length) for r in rows.orderBy("seq").collect()])
    monkeypatch.setattr(T, "to_events", lambda trace: pytest.fail("the trace was collected"))
    kept = models.stored(rows)
    assert kept.chunks.count() == 3 and len(kept) == len(t)
    for q in (0.0, 0.15, 1 / 3, 0.5, 0.77, 2 / 3, 1.0):
        assert kept.length.quantile(q) == np.quantile(t.length, q)
    genes = (1 / 3, 2 / 3, 0.5, 4, 1.0)
    made = models.generate_fitted(kept, "markov_renewal", genes, [("a", 1), ("b", 2)], 2_000.0)
    for name, seed in (("a", 1), ("b", 2)):
        rows = made.where(F.col("comparison") == name).orderBy("seq").collect()
        assert [(r.ts, r.direction, r.frame_length) for r in rows] == models.fit("markov_renewal", genes, t, 2_000.0).generate(seed, 2_000.0).events
    with pytest.raises(Exception, match="max_packets"):
        models.generate_fitted(kept, "markov_renewal", genes, [("a", 1)], 2_000.0, Limits(3, 10**6, 9.0)).collect()
    s, w = search(limits=Limits(10**6, 10**10, 60.0)), float(t.ts[-1])
    how = Settings(lags=(1,), lag_weights=(1.0,), widths=(w / 64, w / 8), scale_weights=(0.5, 0.5))
    population = Engine(s, kept, w, how).first(models.rng_of(1))
    assert population == Engine(s, t, w, how).first(models.rng_of(1))
    few = [c for c in population if c.family == "markov_renewal"][:1]
    ours, theirs = Engine(s, kept, w, how).evaluate(spark, few)[0], Engine(s, t, w, how).evaluate(None, few)[0]
    # dot products differ in their last digits by where arrays lie in memory
    assert ours.status == theirs.status == "valid" and ours.genes == theirs.genes and ours.scores[0] == pytest.approx(theirs.scores[0], abs=1e-12)


def cut_up(t: Arrays, sizes) -> list[Arrays]:
    """The trace in parts; the last size repeats."""
    out, i, sizes = [], 0, list(sizes)
    while i < len(t):
        n = sizes.pop(0) if len(sizes) > 1 else sizes[0]
        out.append(Arrays(t.ts[i : i + n], t.direction[i : i + n], t.length[i : i + n]))
        i += n
    return out


def random_trace(seed: int, n: int, kind: int) -> Arrays:
    rng = np.random.default_rng(seed)
    gaps = (rng.exponential(0.01, n), rng.integers(0, 4, n) / 8, np.full(n, 0.25))[kind]
    return Arrays(np.cumsum(gaps) - gaps[0], rng.integers(0, 2, n), rng.integers(60, (1515, 64, 61)[kind], n))


@pytest.mark.parametrize("limits", [Limits(10**6, 10**9, 60.0), Limits(40, 10**9, 60.0), Limits(10**6, 4_000, 60.0)])
@pytest.mark.parametrize("family, genes", [("poisson_empirical", (1.5,)), ("mmpp", (0.5, 0.25, 1.0, 4.0)), ("markov_renewal", (0.3, 0.7, 0.5, 2, 1.0))])
def test_generated_in_parts(family, genes, limits):
    """parts are the whole trace, its counters and its reason, whatever their size; no part is longer than asked."""
    model = models.fit(family, genes, reference(), 10.0)
    whole = model.generate(5, 60.0, limits)
    for size in (1, 7, 1_000):
        made = models.Parts(model, 5, 60.0, limits, size)
        parts = list(made)
        assert [e for p in parts for e in zip(p.ts.tolist(), p.direction.tolist(), p.length.tolist(), strict=True)] == whole.events
        assert max(map(len, parts)) <= size and (made.reason, made.counters, made.run.taken) == (whole.reason, whole.counters, len(whole.events))


@pytest.mark.parametrize("sizes", [(1, 1, 5), (20, 1), (1_000,), (3,)])
def test_markov_gathered_from_parts(sizes):
    """a fit on parts has the samples of a fit on the whole, also where a state or an edge is seen once or last."""
    for t in (reference(), random_trace(1, 500, 0), Arrays.of([(0.0, 0, 60), (1.0, 0, 61), (3.0, 1, 900)])):
        for genes in ((0.3, 0.7, 0.5, 2, 1.0), (0.3, 0.7, 0.5, 50, 2.0)):
            cut = models.thresholds(t.length, *genes[:2])
            want, got = models.fit("markov_renewal", genes, t, 10.0), Markov.gather(cut_up(t, sizes), genes, cut)
            assert models.payload(got) == models.payload(want)
            assert got.generate(3, 10.0).events == want.generate(3, 10.0).events and got.generate(3, 10.0).counters == want.generate(3, 10.0).counters


@pytest.mark.parametrize("sizes", [(1, 2, 3), (1_000,), (97,), (10_000,)])
@pytest.mark.parametrize("kinds", [(0, 0), (0, 1), (1, 1), (2, 0), (2, 2)])
def test_measures_of_parts(kinds, sizes):
    """F1: scores from parts equal the kernels' on whole traces."""
    ours, theirs = random_trace(2, 700, kinds[0]), random_trace(3, 900, kinds[1])
    w = float(max(ours.ts[-1], theirs.ts[-1]))
    s = Settings(lags=(1, 4, 30), lag_weights=(0.5, 0.25, 0.25), widths=(w / 64, w / 8), scale_weights=(0.5, 0.5))
    want, limits = kernels.compare(ours, theirs, w, s), np.unique(ours.iats)
    a, b = Passing(w, s, (0.013, 700.0), limits), Passing(w, s, (None, None), limits)
    for p in cut_up(ours, sizes):
        a.add(p)
    for p in cut_up(theirs, sizes[::-1] if len(sizes) > 1 else sizes):
        b.add(p)
    acf = [[x.autocorrelations(s.lags) for x in side.sums] for side in (a, b)]
    assert passing.acf_score(*acf, s) == pytest.approx(want["autocorrelation"], abs=1e-12)
    assert 1 - passing.frame_size_distance(a.lengths, b.lengths) == want["frame_size_ks"]
    assert passing.multiscale_score(a.cells, b.cells, s) == want["multiscale_rate"]
    for side, t in ((a, ours), (b, theirs)):
        assert side.counts.tolist() == [[int((t.iats < x).sum()) for x in limits], [int((t.iats <= x).sum()) for x in limits]]


@pytest.mark.parametrize("limits, look", [(4, 10**6), (64, 100), (10**6, 10**6)])
def test_distance_in_looks(spark, limits, look):
    """the distance of inter-arrival times is exact to the last digit with few limits, small looks, and ties."""
    ours = random_trace(4, 3_000, 0)
    ours.ts[1_000:] += 5 - ours.ts[1_000] % 1
    frame = T.from_events(spark, "r", zip(ours.ts.tolist(), ours.direction.tolist(), ours.length.tolist(), strict=True))
    kept = models.stored(frame)
    x = np.sort(ours.iats)
    at = np.unique(x[np.linspace(0, len(x) - 1, min(limits, len(x))).astype(int)])
    about = scoring.Profile([], ((), ()), [], at, passing.counted(x, at), len(x))
    rows, counts, sizes, want = [], {}, {}, {}
    for i, y in enumerate((random_trace(5, 2_000, 0).iats, ours.iats[::2] * 1.01, np.append(ours.iats[:900], 7.0), np.full(50, float(x[40])), random_trace(6, 300, 1).iats)):
        want[i, 9] = kernels.ks_distance(ours.iats, y)
        rows += [(i, 9, np.sort(p).tobytes()) for p in np.array_split(y, 3)]
        counts[i, 9], sizes[i, 9] = passing.counted(np.sort(y), at), len(y)
    made = spark.createDataFrame(rows, "i bigint, seed bigint, gaps binary").repartition(3)
    assert scoring.distances(kept, about, made, counts, sizes, look) == want


def test_search_on_stored_reference(spark):
    """F1: all families' trials on a trace that stays in Spark, each in a task of its own, score as on its arrays."""
    rows = long_trace(spark, 70_000)
    t = Arrays.of([(r.ts, r.direction, r.frame_length) for r in rows.orderBy("seq").collect()])
    s, w = search(limits=Limits(90_000, 10**10, 60.0), seeds=(17, 19)), float(t.ts[-1])
    how = Settings(lags=(1, 4), lag_weights=(0.5, 0.5), widths=(w / 64, w / 8), scale_weights=(0.5, 0.5))
    kept, whole = Engine(s, models.stored(rows), w, how), Engine(s, t, w, how)
    population = kept.first(models.rng_of(1))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = kept.evaluate(spark, population)
    for a, b in zip(found, whole.evaluate(None, population), strict=True):
        assert (a.status, a.failure) == (b.status, b.failure) and a.genes == b.genes
        assert all(x == pytest.approx(y, abs=1e-12) and all(x[m] == y[m] for m in ("frame_size_ks", "iat_ks", "multiscale_rate")) for x, y in zip(a.scores, b.scores, strict=True))
    assert {c.failure and c.failure[0] for c in found} == {None, "incomplete_generation"}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    work = spark.createDataFrame([(k, str(k), k % 2 == 0) for k in range(6)], "slot int, work string, sampled boolean")
    dealt = models.beside(kept.reference, work, 6).select("slot", F.spark_partition_id().alias("task"), "chunk", F.col("ts").isNull().alias("alone")).collect()
    assert sorted({(r.slot, r.task) for r in dealt}) == [(k, k) for k in range(6)] and all(r.alone == (r.slot % 2 == 1) for r in dealt)


def test_memory_of_a_trial():
    """what a trial holds doesn't grow with the reference or the generated trace."""

    def peak(n: int) -> int:
        t = random_trace(7, 4_000, 0)
        parts = (Arrays(t.ts + i * t.ts[-1], t.direction, t.length) for i in range(n // 4_000))
        w = float(t.ts[-1]) * (n // 4_000)
        summary = models.Summary(models.Lengths(*np.unique(t.length, return_counts=True)), Marks.of(t))
        how = Settings(lags=(1,), lag_weights=(1.0,), widths=(w / 64, w / 8), scale_weights=(0.5, 0.5))
        about = scoring.Profile([[0.0], [0.0]], np.unique(t.length, return_counts=True), Passing(w, how, (None, None), np.zeros(1)).cells, np.sort(t.iats), None, n - 1)
        tracemalloc.start()
        try:
            model = models.fit("markov_renewal", (0.3, 0.7, 0.5, 2, 1.0), summary, w, parts)
            done = [r for _, r, _ in scoring.attempt(models.Parts(model, 1, w, Limits(10**7, 10**12, 600.0), 4_000), about, w, how) if r]
            assert done[0]["gaps"] > 0.9 * n and set(done[0]["scores"]) == {"autocorrelation", "frame_size_ks", "multiscale_rate"}
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    small, large = peak(20_000), peak(100_000)
    assert large < 1.3 * small
