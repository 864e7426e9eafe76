"""Stationary laws and the course of a search's history, against definitions."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tracewright.operators import fitting, selection


def rows_of(matrices):
    return [(name, i, j, float(p)) for name, m in matrices.items() for i, row in enumerate(m) for j, p in enumerate(row)]


def test_stationary_laws(spark):
    rng = np.random.default_rng(1)
    made = {f"t{k}": rng.dirichlet(np.ones(k), k) for k in range(1, 7)}
    made["swap"] = np.array([[0, 1], [1, 0]])  # has a period
    made["ring"] = np.roll(np.eye(5), 1, axis=1)
    made["slow"] = np.array([[1 - 1e-7, 1e-7], [3e-7, 1 - 3e-7]])
    made["sink"] = np.array([[0.5, 0.5, 0], [0, 0.5, 0.5], [0, 0, 1]])
    got: dict = {}
    for r in fitting.stationary(spark.createDataFrame(rows_of(made), "trace_id string, source int, destination int, p double")).collect():
        got.setdefault(r.trace_id, {})[r.state] = r.p
    for name, m in made.items():
        law = np.array([got[name][i] for i in range(len(m))])
        assert law.sum() == pytest.approx(1, abs=1e-12) and law @ m == pytest.approx(law, abs=1e-9), name
    p01, p10 = 1e-7, 3e-7
    assert [got["slow"][0], got["slow"][1]] == pytest.approx([p10 / (p01 + p10), p01 / (p01 + p10)], abs=1e-9)
    with pytest.raises(Exception, match="no single stationary law: trace two"):
        fitting.stationary(spark.createDataFrame(rows_of({"two": np.eye(2)}), "trace_id string, source int, destination int, p double")).collect()


PRIORITY = {"b": 0, "a": 1, "c": 2}
ROWS = "run int, generation int, scope string, family string, best_fitness double, best_birth_generation int, best_birth_index bigint"


def histories(seed):
    rng = random.Random(seed)
    out = []
    for run in range(6):
        for g in range(9):
            for f in "abc":
                if rng.random() < 0.9 or f == "a":
                    out.append((run, g, "family", f, rng.choice([0.2, 0.3, 0.3005, 0.5, 0.8]), rng.randint(0, g), rng.randint(0, 5)))
            out.append((run, g, "overall", None, 9.0, 0, 0))
    return out


def course(rows, tolerance, patience, generations):
    out, kept, streak = {}, None, 0
    for g in sorted({r[1] for r in rows}):
        now = min((-r[4], PRIORITY[r[3]], r[5], r[6], r[3]) for r in rows if r[1] == g and r[2] == "family")
        gained = kept is None or kept[0] - now[0] > tolerance
        streak = 0 if gained else streak + 1
        kept = now if kept is None else min(kept, now)
        state = "hard_limit" if g == generations else "early_stop" if patience and streak >= patience else "running"
        out[g] = (now[4], -now[0], now[2], now[3], kept[4], -kept[0], kept[2], kept[3], streak, state)
    return out


@pytest.mark.parametrize("patience", [0, 2])
def test_progress(spark, patience):
    data = histories(3)
    rows = spark.createDataFrame(data, ROWS)
    got = selection.progress(rows, PRIORITY, 0.001, patience, 8, ["run"])
    names = [f"{w}_{n}" for w in ("now", "kept") for n in ("family", "fitness", "birth_generation", "birth_index")]
    found = {(r.run, r.generation): (*(r[n] for n in names), r.streak, r.state) for r in got.collect()}
    want = {(run, g): v for run in range(6) for g, v in course([r for r in data if r[0] == run], 0.001, patience, 8).items()}
    assert found == want
    kept = {k: v[5] for k, v in found.items()}
    assert all(kept[r, g] >= kept[r, g - 1] for r, g in kept if g)


def test_progress_faults(spark):
    data = histories(5)
    rows = spark.createDataFrame(data, ROWS)
    args = (PRIORITY, 0.001, 0, 8, ["run"])
    stored = [list(r) for r in selection.progress(rows, *args).select("run", "generation", *selection.RETAINED).collect()]
    kind = "run int, generation int, kept_family string, kept_fitness double, kept_birth_generation int, kept_birth_index bigint, streak int"
    faults = lambda table, patience=0: {tuple(r) for r in selection.progress_faults(spark.createDataFrame(table, kind), rows, PRIORITY, 0.001, patience, 8, ["run"]).collect()}
    assert faults(stored) == set()
    at = {(r[0], r[1]): i for i, r in enumerate(stored)}
    bad = [list(r) for r in stored]
    bad[at[0, 4]][3] = 0.01  # a winner that worsens
    bad[at[1, 2]][5] += 1  # another winner of the same fitness
    bad[at[2, 3]][6] += 1
    del bad[at[3, 8]]
    assert faults(bad) == {(0, 4, "worsened"), (0, 4, "retained"), (1, 2, "retained"), (2, 3, "streak"), (3, 8, "missing")}
    want = {(run, g, "continued") for run in range(6) for s in [course([r for r in data if r[0] == run], 0.001, 2, 8)] for g in s if any(s[e][9] == "early_stop" for e in s if e < g)}
    assert want and faults(stored, 2) == want


# Payloads


@pytest.mark.parametrize("size, chunk", [(4, 3), (1, 1000), (1000, 7)])
def test_chunks_of_payloads(spark, size, chunk):
    from tracewright.operators import ordered

    rng = random.Random(size)
    data = [(k, rng.choice([0, 1, 2]), rng.randrange(-50, 60), i) for k in "ab" for i in range(90)] + [("one", 0, 5, 0)]
    rows = spark.createDataFrame(data, "k string, j int, at bigint, x int").repartition(5)
    got: dict = {}
    chunks = ordered.in_chunks(rows, ["k", "j"], "at", ["x"], size, chunk).persist()
    for r in chunks.orderBy("chunk").collect():
        assert r.first_rank == r.chunk * size + 1 and 1 <= len(r.entries) <= size
        got.setdefault((r.k, r.j), []).extend(e.x for e in r.entries)
    want: dict = {}
    for k, j, _, x in sorted(data, key=lambda r: (r[2], r[3])):
        want.setdefault((k, j), []).append(x)
    assert got == want
    asked = [(k, j, r) for (k, j) in want for r in (1, 3, len(want[k, j]), len(want[k, j]) + 1, 0)]
    found = ordered.entries_at(chunks, spark.createDataFrame(asked, "k string, j int, rank bigint"), ["k", "j"], size).collect()
    assert sorted((r.k, r.j, r["rank"], r.entry.x) for r in found) == sorted((k, j, r, want[k, j][r - 1]) for k, j, r in asked if 1 <= r <= len(want[k, j]))
