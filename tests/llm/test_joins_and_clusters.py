"""Decontamination and clustering against slow definitions, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re

import duckdb
import numpy as np
import pytest

from tracewright.llm import decontaminate, delta_lloyd, queries

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(frame) -> list[str]:
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", ["op11_decontamination", "op12_clustering"])
def test_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    assert plain(queries.QUERIES[name](spark, SMALL).toPandas()) == plain(c.execute(queries.ORACLES[name]).df())


# Decontamination


def words_of(text) -> list[str]:
    return WORD.findall((text or "").translate(CAPITALS))


def slow_hits(docs, items, window, shingle, share):
    """{key: (words, hit places, items)} by trying every window at every place."""
    wanted = []
    for item, text in items:
        w = words_of(text)
        n = min(window, len(w))
        wanted += [("" if item is None else str(item), w[i : i + n]) for i in range(len(w) - n + 1) if n]
    found = {}
    for key, text in docs:
        w, places, names = words_of(text), set(), set()
        for item, v in wanted:
            n, k = len(v), min(shingle, len(v))
            own = {tuple(v[i : i + k]) for i in range(n - k + 1)}
            for i in range(len(w) - n + 1):
                there = {tuple(w[j : j + k]) for j in range(i, i + n - k + 1)}
                if w[i : i + n] == v if share == 1 else len(own & there) >= max(math.ceil(share * len(own) - 1e-9), 1):
                    places |= set(range(i, i + n))
                    names.add(item)
        found[key] = (len(w), places, sorted(names))
    return found


def random_tables(seed, size=60):
    rng = random.Random(seed)
    vocabulary = ["ab", "Ab", "c", "d9", "é", "你", "zz", "q", "long" * 20, "x"]
    gaps = [" ", "  ", "\n", "--", "_", "\x7f", ". "]

    def text(n):
        return "".join(rng.choice(vocabulary) + rng.choice(gaps) for _ in range(n))

    items = [(i, text(rng.choice([0, 1, 2, 3, 5, 12, 30]))) for i in range(25)] + [(7, "ab c"), (None, "zz q x x"), (90, None), (91, "..."), (92, "ab c"), (93, "x " * 20)]
    docs = [(i, text(rng.randint(0, size))) for i in range(40)]
    docs += [(100 + i, text(5) + (t or "") + text(5)) for i, (_, t) in enumerate(items)]
    docs += [(200, None), (201, ""), (202, "ab c"), (202, "ab c"), (203, "x " * 60), (204, "...")]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"shingle": 1}, {"window": 4, "shingle": 4}, {"share": 0.6}, {"share": 0.5, "shingle": 2, "window": 6}, {"block": 200}, {"stretch": 40}, {"block": 300, "stretch": 64, "share": 0.7}])
def test_decontamination(spark, options):
    docs, items = random_tables(3)
    docs = [(i, t) for i, (_, t) in enumerate(docs)]
    d = spark.createDataFrame([(i, t, 1, "s") for i, t in docs], "doc_id bigint, text string, spans int, items string").repartition(3)
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.contamination(d, b, **options).collect()
    want = slow_hits(docs, items, options.get("window", 10), options.get("shingle", 3), options.get("share", 1.0))
    assert len(got) == len(docs)
    for r in got:
        places = [p for s in r.spans for p in range(s["first"], s["stop"])]
        assert (r.n_words, places, r["items"]) == (want[r.doc_id][0], sorted(want[r.doc_id][1]), want[r.doc_id][2]), r.doc_id
        assert all(a["stop"] < b["first"] for a, b in zip(r.spans, r.spans[1:], strict=False))


def test_decontamination_of_nothing(spark):
    d = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert sorted((r.doc_id or 0, r.n_words, r.spans, r["items"]) for r in decontaminate.contamination(d, none).collect()) == [(0, 0, [], []), (1, 2, [], []), (1, 2, [], [])]
    assert decontaminate.contamination(d.limit(0), d.selectExpr("doc_id as item_id", "text")).count() == 0
    got = decontaminate.contamination(d, d.selectExpr("doc_id as item_id", "text")).collect()
    assert sorted((r.n_words, len(r.spans), r["items"]) for r in got) == [(0, 0, []), (2, 1, ["1"]), (2, 1, ["1"])]


def test_long_text(spark):
    """A text of three megabytes with a passage across each border of its stretches, and one word of two megabytes."""
    rng = random.Random(5)
    filler = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(5000)]
    passage = " ".join(f"passage{i}" for i in range(14))
    text = " ".join(rng.choice(filler) if i % 3000 else passage for i in range(1, 450_000))
    d = spark.createDataFrame([(1, text), (2, "y" * 2_000_000 + " " + passage)], "doc_id bigint, text string")
    b = spark.createDataFrame([(5, passage + " end")], "item_id bigint, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(d, b).collect()}
    w = words_of(text)
    assert got[1].n_words == len(w) and got[2].n_words == 15
    assert [s["first"] for s in got[1].spans] == [i for i, x in enumerate(w) if x == "passage0"] and all(s["stop"] - s["first"] == 14 for s in got[1].spans)
    assert [(s["first"], s["stop"]) for s in got[2].spans] == [(1, 15)]


def test_blocks_are_bounded(spark):
    pieces = spark.createDataFrame([(str(i), b"x" * 100) for i in range(200)], "item string, piece binary")
    found = list(decontaminate.blocks_of(pieces, 1000))
    assert sum(len(b) for b in found) == 200 and max(sum(len(p) + len(i) for i, p in b) for b in found) <= 1000
    assert list(decontaminate.blocks_of(pieces.limit(0), 1000)) == [[]]


# Clustering


def slow_lloyd(data, k, rounds, scale=256):
    """(key, cluster, distance) with Python integers, every vector against every centroid in every round."""
    rows = [(key, [math.floor(scale * x) for x in v]) for key, v in data]
    first = sorted(rows, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[1]))[:k]
    centroids = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in rows]
        for i in range(len(centroids)):
            members = [v for (_, v), o in zip(rows, own, strict=True) if o == i]
            if members:
                centroids[i] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    return sorted((str(key), *reversed(nearest(v))) for key, v in rows), centroids


@pytest.mark.parametrize("k, rounds, size", [(5, 5, 1.0), (3, 9, 0.02), (7, 1, 3e5), (4, 0, 1.0)])
def test_lloyd(spark, k, rounds, size):
    rng = np.random.default_rng(k + rounds)
    data = [(i, (size * rng.normal(i % 4, 1.0, 6)).tolist()) for i in range(300)]
    data += [(1000 + i, data[i][1]) for i in range(30)] + [(5, data[8][1]), (5, data[8][1]), (None, data[9][1])]
    bad = [(2000, [1.0] * 5), (2001, [float("nan")] + [0.0] * 5), (2002, [float("inf")] + [0.0] * 5), (2003, None), (2004, [None] + [0.0] * 5), (2005, [])]
    df = spark.createDataFrame([(i, v, 0, 0.0) for i, v in data + bad], "vec_id bigint, embedding array<double>, cluster int, distance double").repartition(3)
    rows, centroids = delta_lloyd.cluster(df, k=k, rounds=rounds, dims=6, rows=50)
    want, middle = slow_lloyd(data, k, rounds)
    assert sorted((str(r.key), r.cluster, r.distance) for r in rows.collect()) == want
    assert centroids.tolist() == middle
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("delta_lloyd")]


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id bigint, embedding array<float>")
    rows, centroids = delta_lloyd.cluster(df, dims=2)
    assert sorted((r.key, r.cluster, r.distance) for r in rows.collect()) == [(1, 0, 0), (2, 0, 0)] and len(centroids) == 2
    rows, centroids = delta_lloyd.cluster(df.limit(0), dims=2)
    assert rows.count() == 0 and rows.dtypes == [("key", "bigint"), ("cluster", "int"), ("distance", "bigint")] and len(centroids) == 0
    huge = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        delta_lloyd.cluster(huge, dims=2)


def test_assignment_compares_what_changed():
    """A vector whose owner stayed is compared with the changed centroids only, and results are those of a full comparison."""
    rng = np.random.default_rng(1)
    v, c = rng.integers(-50, 50, (500, 4)), rng.integers(-50, 50, (9, 4))
    owners, distances = delta_lloyd.assign(v, c, np.arange(9), None, None)
    c2 = c.copy()
    c2[[2, 5]] += 9
    got = delta_lloyd.assign(v, c2, np.array([2, 5], np.int32), owners, distances)
    full = delta_lloyd.assign(v, c2, np.arange(9), None, None)
    assert (got[0] == full[0]).all() and (got[1] == full[1]).all()
    moves = delta_lloyd.transfers(v, full[0], owners)
    for m in moves:
        new, old = v[full[0] == m["cluster"]], v[owners == m["cluster"]]
        assert m["sums"] == [*(new.sum(0) - old.sum(0)).tolist(), len(new) - len(old)]
