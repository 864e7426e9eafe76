"""Every registered query with SQL, against DuckDB, on the smallest tables; the others run."""

from __future__ import annotations

import os
from types import SimpleNamespace

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.functions.kernels import Arrays
from tracewright.operators import models, study
from tracewright.operators.traces import to_events
from tracewright.plans import genetic
from tracewright.plans.registry import QUERIES, SQL
from tracewright.plans.trace_queries import pair

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows(frame) -> list[str]:
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).values.tolist()))


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    found = QUERIES[name](spark, DATA).toPandas()
    assert len(found) or name in ("history_faults",)
    if name in SQL:
        assert rows(found) == rows(db.execute(SQL[name]).df())


# Whole tables: on 10,000 events and 15,000 orders, against SQL without its limits

WHOLE = "/root/testdata/sf0.01"


def whole(spark, name: str, *limits: str, after: str = "") -> bool:
    """Whether a query equals its SQL, less the named limits, on larger tables."""
    c, sql = duckdb.connect(), SQL[name]
    for f in os.listdir(WHOLE):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{WHOLE}/{f}'")
    for limit in limits:
        sql = sql.replace(limit, after)
    return rows(QUERIES[name](spark, WHOLE).toPandas()) == rows(c.execute(sql).df())


@pytest.mark.parametrize("name, family, genes", [("poisson_generate", "poisson_empirical", (1.0,)), ("mmpp_generate", "mmpp", (0.0002, 0.0004, 0.001, 0.01)), ("markov_generate", "markov_renewal", (1 / 3, 2 / 3, 0.5, 4, 1.0))])
def test_generate_whole(spark, name, family, genes):
    """A model fitted by brute force on all of the reference gives the same traces."""
    reference, _, _ = pair(spark, WHOLE)
    t = Arrays.of(to_events(reference))
    model, w = models.fit(family, genes, t, float(t.ts[-1])), float(t.ts[-1])
    wanted = []
    for i in range(8):
        made = model.generate(i + 17, w, models.Limits(max_packets=10**6, max_output_bytes=10**10)).events
        wanted.append((f"{family}-{i}", len(made), sum(e[2] for e in made), made[-1][0]))
    assert len(t) == 5000 and sorted(map(tuple, QUERIES[name](spark, WHOLE).collect())) == wanted


def test_genetic_search_whole(spark, monkeypatch):
    """The search reads the whole reference and its window."""
    seen = []
    monkeypatch.setattr(genetic.Engine, "run", lambda self, spark: seen.append((len(self.reference), self.window)) or SimpleNamespace(history=[]))
    QUERIES["genetic_search"](spark, WHOLE)
    assert seen == [(5000, pair(spark, WHOLE)[2])]


def test_bootstrap_ci_whole(spark):
    """All customers of each segment, against plain resampling of their values in order."""
    table = spark.read.parquet(f"{WHOLE}/customer.parquet").select("c_mktsegment", F.col("c_acctbal").cast("double").alias("x")).toPandas()
    wanted = {}
    for k, g in table.groupby("c_mktsegment"):
        x, rng = np.sort(g.x.to_numpy()), np.random.Generator(np.random.PCG64(study.BOOTSTRAP_SEED))
        means = [x[rng.integers(0, len(x), len(x))].mean() for _ in range(10_000)]
        wanted[k] = (len(x), *np.percentile(means, (2.5, 97.5)))
    found = {r.c_mktsegment: (r.sample_size, r.lower_bound, r.upper_bound) for r in QUERIES["bootstrap_ci"](spark, WHOLE).collect()}
    assert sum(v[0] for v in found.values()) == len(table) == 1500 and set(found) == set(wanted)
    assert all(found[k] == pytest.approx(wanted[k]) for k in wanted)


def test_pcapng_scan_whole(spark):
    assert whole(spark, "pcapng_scan", " WHERE seq <= 2000")


def test_candidate_trials_whole(spark):
    assert whole(spark, "candidate_trials", " WHERE generation = 0")


def test_duplicate_candidates_whole(spark):
    one = "generation = 1 AND (family, genes) IN (SELECT (family, genes) FROM c WHERE generation = 0)"
    assert whole(spark, "duplicate_candidates", one, after="(generation, family, genes) IN (SELECT (generation + 1, family, genes) FROM c)")
