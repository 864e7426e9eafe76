"""Trials of models against one long trace that stays in Spark: fitted, generated and scored with a part in memory at a time.

The reference's figures are aggregated once, over its chunks. A trial is a task: it generates its trace in parts, sums up what
the measures need, and leaves only the inter-arrival times, sorted within each part, on disk. Their distance is found from
counts: at some 16,384 limits, quantiles of the reference, both distributions are counted exactly, in one pass. Between two
limits the distance can't exceed what the counts at both allow, so only the ranges that may hold a larger one than found so
far are looked at again, value by value of the reference, until none is left. The result is exact, whatever the limits are.
"""

from __future__ import annotations

import functools
import json
import math
import pickle
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.passing import Passing, Sums, acf_score, counted, frame_size_distance, multiscale_score
from .models import SAMPLED, Limits, Parts, Stored, arrays_of, beside, fit, in_slots
from .ordered import CHUNK
from .similarity import METHODS, Settings, bin_counts

#: Limits that inter-arrival times are counted at, values of a sample that they are chosen from, and values of the reference in a further look.
LIMITS, SAMPLE, LOOK = 16_384, 262_144, 1 << 20
#: Chunks, of some MB each at most, that go to a Python worker at once.
BATCH = 4
MADE = "i bigint, seed bigint, gaps binary, result string, counts binary"


@dataclass(frozen=True)
class Profile:
    """Figures of a reference: its size doesn't depend on the trace's, but for lengths and cells, which have bounds of their own."""

    acf: list[list[float]]
    lengths: tuple[np.ndarray, np.ndarray]
    cells: list[tuple[np.ndarray, np.ndarray]]
    limits: np.ndarray
    counts: np.ndarray
    gaps: int


def gaps_of(b: pa.RecordBatch, i: int) -> np.ndarray:
    """Inter-arrival times of a linked chunk, the one to the chunk before included, ascending."""
    before = b.column("before")[i].as_py()
    ts = arrays_of(b, i).ts
    return np.sort(np.diff(ts if before is None else np.append(before, ts)))


def row(names: str, *values) -> pa.RecordBatch:
    """A batch of one row; names as in a schema text."""
    kinds = {"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[k]) for v, (_, k) in zip(values, fields, strict=True)], [n for n, _ in fields])


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While this holds, jobs send BATCH rows at once to Python, where Spark's setting is larger; the setting is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), BATCH) if int(before) > 0 else BATCH))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def profile(trace: Stored, window: float, s: Settings) -> Profile:
    with small_batches(trace.chunks.sparkSession):
        return _profile(trace, window, s)


def _profile(trace: Stored, window: float, s: Settings) -> Profile:
    linked, n, length = trace.linked(), len(trace), trace.length
    most = max(1, SAMPLE // math.ceil(n / CHUNK))

    def sampled(batches):
        for b in batches:
            for i in range(len(b)):
                x = gaps_of(b, i)
                yield row("x binary", x[:: max(1, len(x) // most)].tobytes())

    found = np.sort(np.concatenate([np.frombuffer(r.x) for r in linked.mapInArrow(sampled, "x binary").collect()]))
    limits = np.unique(found[np.linspace(0, len(found) - 1, min(LIMITS, len(found))).astype(np.int64)])
    points = (window / (n - 1), float(round(float(np.average(length.values, weights=length.counts)))))

    def figures(batches):
        counts = np.zeros((2, len(limits)), np.int64)
        for b in batches:
            for i in range(len(b)):
                t, before = arrays_of(b, i), b.column("before")[i].as_py()
                gaps = np.diff(t.ts if before is None else np.append(before, t.ts))
                sums = [Sums.of(x, s.lags, p) if len(x) else None for x, p in zip((gaps, t.length), points, strict=True)]
                counts += counted(np.sort(gaps), limits)
                yield row("chunk bigint, data binary", b.column("chunk")[i].as_py(), pickle.dumps(sums))
        yield row("chunk bigint, data binary", -1, counts.tobytes())

    # a row for each chunk, and one for each task
    rows = sorted((r.chunk, bytes(r.data)) for r in linked.mapInArrow(figures, "chunk bigint, data binary").collect())
    counts = sum(np.frombuffer(d, np.int64).reshape(2, -1) for c, d in rows if c < 0)
    pieces = [pickle.loads(d) for c, d in rows if c >= 0]
    sums = [functools.reduce(lambda a, b: a.plus(b, s.lags), (p[k] for p in pieces if p[k] is not None)) for k in (0, 1)]
    return Profile([x.autocorrelations(s.lags) for x in sums], (length.values, length.counts), _cells(trace, window, s), limits, counts, n - 1)


def _cells(trace: Stored, window: float, s: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """Packets and bytes by direction and bin, of each width: added up in Spark, as many as the settings allow at most."""
    bins = bin_counts(window, s.widths, s.max_cells)
    names = ["scale", "cell", "packets", "bytes"]

    def hit(batches):
        for b in batches:
            for i in range(len(b)):
                t = arrays_of(b, i)
                for k, (width, n) in enumerate(zip(s.widths, bins, strict=True)):
                    packets, size = kernels.cells(t, width, n)
                    at = np.flatnonzero(packets)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.full(len(at), k), at, packets[at], size[at])], names)

    out = [(np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int64)) for n in bins]
    sums = trace.chunks.mapInArrow(hit, ", ".join(f"{c} bigint" for c in names)).groupBy("scale", "cell").agg(F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"))
    for r in sums.collect():
        out[r.scale][0][r.cell], out[r.scale][1][r.cell] = r.packets, r.bytes
    return out


def attempt(made: Parts, about: Profile, window: float, s: Settings) -> Iterator[tuple[np.ndarray | None, dict | None, np.ndarray | None]]:
    """Sorted inter-arrival times of each part, then the scores without that of theirs, or what failed, and their counts."""
    seen, wrong = Passing(window, s, (None, float(round(float(np.average(about.lengths[0], weights=about.lengths[1]))))), about.limits), None
    for part in made:
        if wrong is None:
            try:
                yield seen.add(part), None, None
            except ValueError as e:
                wrong = e
    if made.reason:
        yield None, {"kind": "incomplete_generation", "detail": made.reason}, None
        return
    try:
        kernels.require(made.run.taken, s)
        if wrong is not None:
            raise wrong
        found = {
            "autocorrelation": acf_score(about.acf, [x.autocorrelations(s.lags) for x in seen.sums], s),
            "frame_size_ks": 1 - frame_size_distance(about.lengths, seen.lengths),
            "multiscale_rate": multiscale_score(about.cells, seen.cells, s),
        }
    except ValueError as e:
        yield None, {"kind": "similarity_precondition", "detail": str(e)}, None
        return
    yield None, {"scores": found, "counters": made.counters, "gaps": made.run.taken - 1}, seen.counts


def trials(trace: Stored, about: Profile, todo: list[tuple[int, str, str, int]], window: float, s: Settings, limits: Limits) -> list[tuple[int, int, dict]]:
    """(i, seed, result) of each (i, family, genes, seed), each in a task of its own: the four scores and counters, or what failed."""
    with small_batches(trace.chunks.sparkSession):
        return _trials(trace, about, todo, window, s, limits)


def _trials(trace: Stored, about: Profile, todo: list[tuple[int, str, str, int]], window: float, s: Settings, limits: Limits) -> list[tuple[int, int, dict]]:
    spark, summary = trace.chunks.sparkSession, trace.summary
    shared = spark.sparkContext.broadcast(about)

    def run(batches):
        for work, parts in in_slots(batches):
            i, family, genes, seed = json.loads(work)
            try:
                model = fit(family, tuple(json.loads(genes)), summary, window, parts)
            except (ValueError, ArithmeticError) as e:
                yield row(MADE, i, seed, None, json.dumps({"kind": "fit", "detail": str(e)}), None)
                continue
            try:
                for gaps, result, counts in attempt(Parts(model, seed, window, limits), shared.value, window, s):
                    yield row(MADE, i, seed, None if gaps is None else gaps.tobytes(), result and json.dumps(result), None if counts is None else counts.tobytes())
            except (ValueError, ArithmeticError) as e:
                yield row(MADE, i, seed, None, json.dumps({"kind": "generation", "detail": str(e)}), None)

    work = spark.createDataFrame([(k, json.dumps(t), t[1] in SAMPLED) for k, t in enumerate(todo)], "slot int, work string, sampled boolean")
    made = beside(trace, work, len(todo)).mapInArrow(run, MADE).persist(StorageLevel.DISK_ONLY)
    try:
        rows = made.where("result is not null").select("i", "seed", "result", "counts").collect()
        results = {(r.i, r.seed): json.loads(r.result) for r in rows}
        counts = {(r.i, r.seed): np.frombuffer(r.counts, np.int64).reshape(2, -1) for r in rows if r.counts is not None}
        sizes = {k: results[k].pop("gaps") for k in counts}
        for k, d in distances(trace, about, made, counts, sizes).items():
            scores = results[k]["scores"] | {"iat_ks": 1 - d}
            results[k]["scores"] = {m: scores[m] for m in METHODS} | {"aggregate_score": min(1.0, math.fsum(s.method_weights[m] * scores[m] for m in METHODS))}
    finally:
        made.unpersist()
        shared.unpersist()
    for k, r in results.items():
        if "scores" in r and any(not math.isfinite(x) or not 0 <= x <= 1 for x in r["scores"].values()):
            results[k] = {"kind": "nonfinite_score", "detail": json.dumps(r["scores"])}
    return [(i, seed, r) for (i, seed), r in results.items()]


def distances(trace: Stored, about: Profile, made: DataFrame, counts: dict[tuple, np.ndarray], sizes: dict[tuple, int], look: int = LOOK) -> dict[tuple, float]:
    """kernels.ks_distance of the reference's inter-arrival times and those of each trial."""
    limits, na = about.limits, about.gaps
    ends = lambda c, n: (np.append(0, c[1]), np.append(c[0], n))
    a = ends(about.counts, na)
    best, open_ranges = {}, {}
    for k, c in counts.items():
        nb, b = sizes[k], ends(c, sizes[k])
        best[k] = max(float(np.max(np.abs(x / na - y / nb))) for x, y in zip(a, b, strict=True))
        # a range without values of both holds no other distance than those at its ends
        bound = np.where((a[1] > a[0]) & (b[1] > b[0]), np.maximum(np.abs(a[1] / na - b[0] / nb), np.abs(a[0] / na - b[1] / nb)), 0.0)
        open_ranges[k] = {int(j): float(bound[j]) for j in np.flatnonzero(bound > best[k])}
    while True:
        left = sorted((-x, k, j) for k, ranges in open_ranges.items() for j, x in ranges.items() if x > best[k])
        if not left:
            return best
        chosen: dict[tuple, list[int]] = {}
        room = look
        for _, k, j in left:
            size = int(a[1][j] - a[0][j])
            if chosen and size > room:
                break
            chosen.setdefault(k, []).append(j)
            room -= size
        values, n = _values(trace, limits, np.unique(np.concatenate(list(chosen.values()))))
        at = np.searchsorted(limits, values)
        upto = np.cumsum(n)
        upto += (a[0] - np.append(0, upto)[np.searchsorted(at, np.arange(len(limits) + 1))])[at]
        mine = {k: np.isin(at, js) for k, js in chosen.items()}
        for k, (below, within) in _counts(made, {k: values[m] for k, m in mine.items()}).items():
            u, m = upto[mine[k]], n[mine[k]]
            best[k] = max(best[k], *(float(np.max(np.abs(x / na - y / sizes[k]))) for x, y in ((u - m, below), (u, within))))
        for k, js in chosen.items():
            for j in js:
                del open_ranges[k][j]


def _values(trace: Stored, limits: np.ndarray, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The reference's distinct inter-arrival times strictly within some ranges between limits, ascending, and how often each occurs."""

    def within(batches):
        for b in batches:
            for i in range(len(b)):
                x = gaps_of(b, i)
                at = np.searchsorted(limits, x)
                x = x[np.isin(at, ranges) & (x != limits[np.minimum(at, len(limits) - 1)])]
                if len(x):
                    values, n = np.unique(x, return_counts=True)
                    yield row("x binary, n binary", values.tobytes(), n.astype(np.int64).tobytes())

    rows = trace.linked().mapInArrow(within, "x binary, n binary").collect()
    x, n = (np.concatenate([np.frombuffer(r[i], kind) for r in rows]) for i, kind in ((0, np.float64), (1, np.int64)))
    values, at = np.unique(x, return_inverse=True)
    total = np.zeros(len(values), np.int64)
    np.add.at(total, at, n)
    return values, total


def _counts(made: DataFrame, wanted: dict[tuple, np.ndarray]) -> dict[tuple, np.ndarray]:
    """For each trial: its inter-arrival times below, and up to, each of some values."""
    shared = made.sparkSession.sparkContext.broadcast(wanted)

    def look(batches):
        found: dict[tuple, np.ndarray] = {}
        for b in batches:
            for i, seed, gaps in zip(*(b.column(c) for c in ("i", "seed", "gaps")), strict=True):
                k = i.as_py(), seed.as_py()
                if k in shared.value:
                    found[k] = counted(np.frombuffer(gaps.as_buffer()), shared.value[k]) + found.get(k, 0)
        for k, c in found.items():
            yield row("i bigint, seed bigint, counts binary", *k, c.tobytes())

    try:
        out: dict[tuple, np.ndarray] = {}
        for r in made.where("gaps is not null").select("i", "seed", "gaps").mapInArrow(look, "i bigint, seed bigint, counts binary").collect():
            k = r.i, r.seed
            out[k] = np.frombuffer(r.counts, np.int64).reshape(2, -1) + out.get(k, 0)
        return out
    finally:
        shared.unpersist()
