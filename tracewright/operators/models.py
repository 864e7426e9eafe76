"""The three traffic models: genes, repair, fit, and generation by a fixed order of random draws.

A generator is sequential and owns one PCG64 stream, so work is parallel over (candidate, seed), never within a trace.
Every trace starts at 0 and holds all events up to and including the window; if a limit is met first, the result is
incomplete, never shorter. Long traces are generated and read in parts, so that a task holds one part at a time.
"""

from __future__ import annotations

import json
import math
import mmap
import tempfile
import time
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass, field
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import Arrays, Events
from ..sources.shared import new_folder
from .ordered import CHUNK, in_chunks

# Families, genes and how their coordinates are scaled.
GENES = {
    "markov_renewal": (("q1", "linear"), ("q2", "linear"), ("alpha", "linear"), ("r", "integer"), ("c_t", "log")),
    "mmpp": (("q01", "log"), ("q10", "log"), ("lambda0", "log"), ("lambda1", "log")),
    "poisson_empirical": (("c_lambda", "log"),),
}
Bounds = dict[str, tuple[float, float]]


class RepairError(ValueError):
    """Genes that no clamping makes valid for this reference."""


def rng_of(seed: int) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64(seed))


def place(rng: np.random.Generator, n: int) -> int:
    """The draw of rng.choice(n), the same from the same stream, without choice's checks, which take five times as long."""
    return int(rng.integers(0, n))


@dataclass(frozen=True)
class Limits:
    max_packets: int = 20_000
    max_output_bytes: int = 40_000_000
    max_wall_seconds: float = 30.0


@dataclass
class Guard:
    """Limits in their order: wall clock, packets, bytes. A trace that a limit ends is never taken for a whole one."""

    limits: Limits
    clock: Callable[[], float] = time.monotonic
    start: float = field(init=False)

    def __post_init__(self) -> None:
        self.start = self.last = self.clock()

    def late(self) -> bool:
        now = self.clock()
        back = now < self.last
        self.last = now
        return back or not math.isfinite(now) or now >= self.start + self.limits.max_wall_seconds

    def before(self, packets: int, size: int) -> str | None:
        if self.late():
            return "max_wall_seconds"
        return "max_packets" if packets >= self.limits.max_packets else "max_output_bytes" if size >= self.limits.max_output_bytes else None

    def adding(self, packets: int, size: int, length: int) -> str | None:
        if self.late():
            return "max_wall_seconds"
        return "max_packets" if packets + 1 > self.limits.max_packets else "max_output_bytes" if size + length > self.limits.max_output_bytes else None


@dataclass
class Generated:
    events: Events = field(default_factory=Events)
    reason: str | None = None
    counters: dict[str, int] = field(default_factory=dict)

    @property
    def complete(self) -> bool:
        return self.reason is None


class _Stop(Exception):
    pass


class _Run:
    """A trace being generated: draws are checked against the clock, events against the limits. part: events after which it's taken."""

    def __init__(self, window: float, limits: Limits, clock: Callable[[], float], part: float = math.inf):
        if not math.isfinite(window) or window <= 0:
            raise ValueError("the window must be positive and finite")
        self.guard, self.window, self.out, self.size, self.part, self.taken = Guard(limits, clock), window, Generated(), 0, part, 0

    def stop(self, reason: str | None) -> None:
        if reason:
            self.out.reason = reason
            raise _Stop

    def ready(self) -> None:
        self.stop(self.guard.before(self.taken + len(self.out.events), self.size))

    def drawn(self, value):
        self.stop("max_wall_seconds" if self.guard.late() else None)
        return value

    def emit(self, at: float, direction: int, length: int) -> bool:
        """Adds an event; whether the part is full."""
        events = self.out.events
        self.stop(self.guard.adding(self.taken + len(events), self.size, length))
        events.append((at, direction, length))
        self.size += length
        return len(events) >= self.part

    def take(self) -> Arrays:
        """The events since the last part."""
        found, self.out.events = Arrays.of(self.out.events), Events()
        self.taken += len(found)
        return found


class Model:
    """A fitted model: play() draws and emits events, and yields where a part is full."""

    def play(self, run: _Run, rng: np.random.Generator) -> Iterator[None]:
        raise NotImplementedError

    def _played(self, run: _Run, seed: int) -> Iterator[None]:
        try:
            yield from self.play(run, rng_of(seed))
        except _Stop:
            pass

    def generate(self, seed: int, window: float, limits: Limits = Limits(), clock: Callable[[], float] = time.monotonic) -> Generated:
        run = _Run(window, limits, clock)
        for _ in self._played(run, seed):
            pass
        return run.out


class Parts:
    """generate() some events at a time: the parts in order, then the reason and counters of the whole."""

    def __init__(self, model: Model, seed: int, window: float, limits: Limits = Limits(), size: int = CHUNK, clock: Callable[[], float] = time.monotonic):
        self.model, self.seed, self.run = model, seed, _Run(window, limits, clock, size)

    def __iter__(self) -> Iterator[Arrays]:
        for _ in self.model._played(self.run, self.seed):
            yield self.run.take()
        if len(self.run.out.events):
            yield self.run.take()

    @property
    def reason(self) -> str | None:
        return self.run.out.reason

    @property
    def counters(self) -> dict[str, int]:
        return self.run.out.counters


@dataclass(frozen=True)
class Marks:
    """Joint counts of direction and length, in order of first appearance."""

    entries: tuple[tuple[int, int, int], ...]

    @classmethod
    def of(cls, t: Arrays | Summary) -> Marks:
        if isinstance(t, Summary):
            return t.marks
        _, first, counts = np.unique(t.length * 2 + t.direction, return_index=True, return_counts=True)
        order = np.argsort(first)
        return cls(tuple((int(t.direction[i]), int(t.length[i]), int(c)) for i, c in zip(first[order], counts[order], strict=True)))

    @property
    def totals(self) -> np.ndarray:
        return np.cumsum([c for _, _, c in self.entries])

    def sampler(self) -> Callable[[np.random.Generator], tuple[int, int]]:
        """One integer draw, then the first entry whose running count exceeds it."""
        totals, kinds = self.totals.tolist(), [e[:2] for e in self.entries]
        return lambda rng: kinds[bisect_right(totals, place(rng, totals[-1]))]


def clamp(x: float, bound: tuple[float, float]) -> float:
    return min(max(x, bound[0]), bound[1])


@dataclass(frozen=True)
class Lengths:
    """The lengths of a trace as counts by value, ascending."""

    values: np.ndarray
    counts: np.ndarray

    def __len__(self) -> int:
        return int(self.counts.sum())

    def quantile(self, q: float) -> float:
        """np.quantile's linear one, with the same steps, so to the last digit."""
        at = (len(self) - 1) * q
        low = math.floor(at)
        a, b = (float(self.values[np.searchsorted(np.cumsum(self.counts), min(i, len(self) - 1), "right")]) for i in (low, low + 1))
        t = at - low
        return b - (b - a) * (1 - t) if t >= 0.5 else a + (b - a) * t


def thresholds(length: np.ndarray | Lengths, q1: float, q2: float) -> tuple[float, float]:
    if isinstance(length, Lengths):
        return length.quantile(q1), length.quantile(q2)
    a, b = np.quantile(length, (q1, q2), method="linear")
    return float(a), float(b)


def repair(family: str, genes: tuple, bounds: Bounds, reference: Arrays) -> tuple:
    if family == "poisson_empirical":
        return (clamp(genes[0], bounds["c_lambda"]),)
    if family == "mmpp":
        low, high = sorted(genes[2:])
        low, high = clamp(low, bounds["lambda0"]), clamp(high, bounds["lambda1"])
        if not low < high:
            raise RepairError("arrival rates must differ after repair")
        return (clamp(genes[0], bounds["q01"]), clamp(genes[1], bounds["q10"]), low, high)
    low, high = sorted(genes[:2])
    low, high = clamp(low, bounds["q1"]), clamp(high, bounds["q2"])
    if not 0 < low < high < 1:
        raise RepairError("quantiles must be in order after repair")
    t = thresholds(reference.length, low, high)
    if t[0] >= t[1]:
        raise RepairError("quantiles give equal length thresholds")
    return (low, high, clamp(genes[2], bounds["alpha"]), int(clamp(math.floor(genes[3] + 0.5), bounds["r"])), clamp(genes[4], bounds["c_t"]))


@dataclass(frozen=True)
class Summary:
    """What the driver and all tasks hold of a trace that stays in Spark: counts of its lengths and marks, of which there are few."""

    length: Lengths
    marks: Marks

    def __len__(self) -> int:
        return len(self.length)


@dataclass(frozen=True)
class Poisson(Model):
    base_rate: float
    rate: float
    marks: Marks

    @classmethod
    def fit(cls, t: Arrays, genes: tuple, window: float) -> Poisson:
        base = (len(t) - 1) / window
        return cls(base, base * genes[0], Marks.of(t))

    def play(self, run: _Run, rng: np.random.Generator) -> Iterator[None]:
        mark = self.marks.sampler()
        run.ready()
        full, now = run.emit(0.0, *run.drawn(mark(rng))), 0.0
        while True:
            if full:
                yield
            run.ready()
            now += run.drawn(rng.exponential(1 / self.rate))
            if now > run.window:
                return
            full = run.emit(now, *run.drawn(mark(rng)))


@dataclass(frozen=True)
class Mmpp(Model):
    q01: float
    q10: float
    lambda0: float
    lambda1: float
    marks: Marks

    @classmethod
    def fit(cls, t: Arrays, genes: tuple, window: float) -> Mmpp:
        return cls(*genes, Marks.of(t))

    def first_regime(self) -> float:
        """Probability of regime 0 at an arrival."""
        a, b = math.log(self.q10) + math.log(self.lambda0), math.log(self.q01) + math.log(self.lambda1)
        top = max(a, b)
        x, y = math.exp(a - top), math.exp(b - top)
        return x / (x + y)

    def play(self, run: _Run, rng: np.random.Generator) -> Iterator[None]:
        mark = self.marks.sampler()
        arrival, leaving = (self.lambda0, self.lambda1), (self.q01, self.q10)
        run.ready()
        regime = 0 if run.drawn(rng.random()) < self.first_regime() else 1
        full, now = run.emit(0.0, *run.drawn(mark(rng))), 0.0
        while True:
            if full:
                full = False
                yield
            run.ready()
            event = now + run.drawn(rng.exponential(1 / arrival[regime]))
            switch = now + run.drawn(rng.exponential(1 / leaving[regime]))
            now = event if event < switch else switch
            if now > run.window:
                return
            if event < switch:
                full = run.emit(now, *run.drawn(mark(rng)))
            else:
                regime = 1 - regime


class Scratch:
    """Numbers of one kind appended in order, then read at any place, in a file of the task's temp folder that goes with it."""

    def __init__(self, kind: str):
        self.kind, self.file = kind, tempfile.TemporaryFile()

    def add(self, x: np.ndarray) -> None:
        self.file.write(np.ascontiguousarray(x, self.kind))

    def read(self) -> array | memoryview:
        self.file.flush()
        if not self.file.tell():
            return array(self.kind)
        return memoryview(mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)).cast(self.kind)


@dataclass(frozen=True)
class Markov(Model):
    thresholds: tuple[float, float]
    states: tuple[tuple[int, int], ...]
    lengths: tuple[array, ...]
    rows: tuple[tuple[float, ...], ...]
    edge_iats: tuple[tuple[array, ...], ...]
    source_iats: tuple[array, ...]
    global_iats: array
    minimum_support: int
    time_scale: float
    alpha: float

    @classmethod
    def fit(cls, t: Arrays, genes: tuple, window: float) -> Markov:
        q1, q2, alpha, support, scale = genes
        cut = thresholds(t.length, q1, q2)
        code = t.direction * 3 + np.searchsorted(cut, t.length, "left")
        seen, first = np.unique(code, return_index=True)
        kinds = seen[np.argsort(first)].tolist()
        number = np.zeros(6, np.int64)
        number[kinds] = range(len(kinds))
        state = number[code]
        k, gaps, source, target = len(kinds), t.iats, state[:-1], state[1:]
        counts = np.zeros((k, k))
        np.add.at(counts, (source, target), 1)
        bottom = counts.sum(1) + alpha * k
        rows = [[1 / k] * k if b == 0 else ((c + alpha) / b).tolist() for c, b in zip(counts, bottom, strict=True)]
        packed = lambda kind, x: array(kind, x.tobytes())
        edges = tuple(tuple(packed("d", gaps[(source == i) & (target == j)]) for j in range(k)) for i in range(k))
        return cls(
            cut, tuple((c // 3, c % 3) for c in kinds), tuple(packed("q", t.length[state == i]) for i in range(k)), tuple(map(tuple, rows)),
            edges, tuple(packed("d", gaps[source == i]) for i in range(k)), packed("d", gaps), support, scale, alpha,
        )

    @classmethod
    def gather(cls, parts: Iterable[Arrays], genes: tuple, cut: tuple[float, float]) -> Markov:
        """fit() of a trace that comes in parts: the samples, which grow with it, lie in scratch files, not in memory."""
        _, _, alpha, support, scale = genes
        kinds: list[int] = []
        lengths, edges, sources, whole, last = {}, {}, {}, Scratch("d"), None
        for t in parts:
            code = t.direction * 3 + np.searchsorted(cut, t.length, "left")
            seen, first = np.unique(code, return_index=True)
            kinds += [c for c in seen[np.argsort(first)].tolist() if c not in kinds]
            for c in seen.tolist():
                lengths.setdefault(c, Scratch("q")).add(t.length[code == c])
            ts, all_codes = (t.ts, code) if last is None else (np.concatenate((last[:1], t.ts)), np.concatenate((last[1:].astype(np.int64), code)))
            last = np.array((t.ts[-1], code[-1]))
            gaps, source, target = np.diff(ts), all_codes[:-1], all_codes[1:]
            whole.add(gaps)
            for a in np.unique(source).tolist():
                mine = source == a
                sources.setdefault(a, Scratch("d")).add(gaps[mine])
                for b in np.unique(target[mine]).tolist():
                    edges.setdefault((a, b), Scratch("d")).add(gaps[mine & (target == b)])
        k = len(kinds)
        read = lambda kept, at, kind="d": kept[at].read() if at in kept else array(kind)
        conditional = tuple(tuple(read(edges, (a, b)) for b in kinds) for a in kinds)
        rows = []
        for counts in (np.array([len(x) for x in row], np.float64) for row in conditional):
            bottom = counts.sum() + alpha * k
            rows.append(tuple([1 / k] * k if bottom == 0 else ((counts + alpha) / bottom).tolist()))
        return cls(
            cut, tuple((c // 3, c % 3) for c in kinds), tuple(read(lengths, c, "q") for c in kinds), tuple(rows),
            conditional, tuple(read(sources, c) for c in kinds), whole.read(), support, scale, alpha,
        )

    def sample_for(self, i: int, j: int) -> tuple[str, array]:
        if len(self.edge_iats[i][j]) >= self.minimum_support:
            return "transition", self.edge_iats[i][j]
        return ("source", self.source_iats[i]) if len(self.source_iats[i]) else ("global", self.global_iats)

    @staticmethod
    def pick(weights, draw: float) -> int:
        """The first index whose running weight exceeds the draw."""
        goal, total = draw * sum(weights), 0.0
        for i, w in enumerate(weights[:-1]):
            total += w
            if goal < total:
                return i
        return len(weights) - 1

    def play(self, run: _Run, rng: np.random.Generator) -> Iterator[None]:
        seen = run.out.counters = {f"timing_tier_{t}_count": 0 for t in ("transition", "source", "global")} | {"uniform_unobserved_row_count": 0}
        run.ready()
        i = self.pick([float(len(n)) for n in self.lengths], run.drawn(rng.random()))
        full, now = run.emit(0.0, self.states[i][0], self.lengths[i][run.drawn(place(rng, len(self.lengths[i])))]), 0.0
        while True:
            if full:
                yield
            run.ready()
            j = self.pick(self.rows[i], run.drawn(rng.random()))
            tier, sample = self.sample_for(i, j)
            seen[f"timing_tier_{tier}_count"] += 1
            seen["uniform_unobserved_row_count"] += not len(self.source_iats[i])
            now += sample[run.drawn(place(rng, len(sample)))] * self.time_scale
            if now > run.window:
                return
            full = run.emit(now, self.states[j][0], self.lengths[j][run.drawn(place(rng, len(self.lengths[j])))])
            i = j


FAMILIES = {"markov_renewal": Markov, "mmpp": Mmpp, "poisson_empirical": Poisson}
#: Families whose models hold samples of the reference's events; the others need its marks and rates only.
SAMPLED = ("markov_renewal",)


def fit(family: str, genes: tuple, t: Arrays | Summary, window: float, parts: Iterable[Arrays] = ()):
    """Of a trace that stays in Spark t is the summary, and parts its events for the families that hold samples of them."""
    if family not in FAMILIES:
        raise KeyError(f"unknown model family {family}")
    if isinstance(t, Summary) and family in SAMPLED:
        return FAMILIES[family].gather(parts, genes, thresholds(t.length, *genes[:2]))
    return FAMILIES[family].fit(t, genes, window)


# What a model file says of each family's estimators, and of how seeds are used.
ESTIMATORS = {
    "poisson_empirical": {"first_event": "zero", "marks": "joint_empirical_first_appearance", "rate": "interval_count_over_window"},
    "mmpp": {"rates": "direct_genes", "initial_regime": "arrival_epoch", "marks": "joint_empirical_first_appearance", "tie": "regime_change", "first_event": "zero"},
    "markov_renewal": {"first_event": "zero", "quantile": "type7_linear", "state_order": "first_appearance", "timing": "conditional_source_global", "transition": "additive_uniform_empty_row"},
}
SEEDS = {"empirical": "choice_scalar_index", "exponential": "exponential_scale_inverse_rate", "generator": "numpy.random.Generator/PCG64", "weighted": "random_cumulative"}
SIDES = ("outbound", "inbound")


def payload(model) -> dict:
    """The fitted model as the JSON values of a model file."""
    if not isinstance(model, Markov):
        marks = [{"count": c, "direction": SIDES[d], "frame_length": n} for d, n, c in model.marks.entries]
        return asdict(model) | {"marks": marks}
    k = range(len(model.states))
    tiers = [[model.sample_for(i, j)[0] for j in k] for i in k]
    used = {t: sum(len(model.edge_iats[i][j]) for i in k for j in k if tiers[i][j] == t) for t in ("global", "source", "transition")}
    states = zip(model.states, model.lengths, model.source_iats, strict=True)
    return {
        "alpha": model.alpha, "conditional_iats": [[list(x) for x in row] for row in model.edge_iats], "global_iats": list(model.global_iats), "minimum_support": model.minimum_support,
        "states": [{"direction": SIDES[d], "frame_lengths": list(n), "size_bin": b, "source_iats": list(x)} for (d, b), n, x in states],
        "thresholds": list(model.thresholds), "time_scale": model.time_scale, "transition_rows": [list(r) for r in model.rows],
        "timing_diagnostics": {"reference_usage_counts": used, "transition_tiers": tiers, "unobserved_rows": [i for i in k if not model.source_iats[i]]},
    }


def restore(family: str, values: dict):
    """The model of a payload, which must be exactly what payload() gives for it."""
    frozen = lambda v: tuple(map(frozen, v)) if isinstance(v, (list, tuple)) else v
    try:
        if family == "markov_renewal":
            s, times = values["states"], lambda v: array("d", v)
            model = Markov(
                frozen(values["thresholds"]), tuple((SIDES.index(x["direction"]), x["size_bin"]) for x in s), tuple(array("q", x["frame_lengths"]) for x in s), frozen(values["transition_rows"]),
                tuple(tuple(map(times, row)) for row in values["conditional_iats"]), tuple(times(x["source_iats"]) for x in s), times(values["global_iats"]), values["minimum_support"], values["time_scale"], values["alpha"],
            )
        else:
            marks = tuple((SIDES.index(m["direction"]), m["frame_length"], m["count"]) for m in values["marks"])
            model = FAMILIES[family](**{k: v for k, v in values.items() if k != "marks"}, marks=Marks(marks))
        same = payload(model) == values
    except (KeyError, TypeError, IndexError, AttributeError, OverflowError) as e:
        raise ValueError(f"no payload of {family}: {e}") from e
    if not same or family != "markov_renewal" and (not marks or len({m[:2] for m in marks}) < len(marks) or min(m[2] for m in marks) < 1):
        raise ValueError(f"a {family} payload has other fields")
    return model


GENERATED = "comparison string, trace_id string, seq bigint, ts double, direction tinyint, frame_length bigint"


def generate(requests: DataFrame, models: dict[str, object], window: float, limits: Limits = Limits()) -> DataFrame:
    """Events of every request (comparison, model, seed); models are few and small, and travel with the code.

    Requests are independent and spread over tasks; a limit met raises, as a shortened trace is never returned.
    """

    def run(frames):
        for frame in frames:
            for r in frame.itertuples():
                yield from rows_of(r.comparison, Parts(models[r.model], int(r.seed), window, limits))

    asked = requests.select(F.col("comparison").cast("string"), F.col("model").cast("string"), F.col("seed").cast("bigint"))
    # by a number of partitions, as few small rows would be put into one
    return asked.repartitionByRange(max(1, min(asked.count(), 2_000)), "comparison").mapInPandas(run, GENERATED)


def rows_of(comparison: str, made: Parts) -> Iterator[pd.DataFrame]:
    """The events of a whole result, a part at a time."""
    done = 0
    for e in made:
        yield pd.DataFrame({"comparison": comparison, "trace_id": comparison, "seq": np.arange(done + 1, done + len(e) + 1), "ts": e.ts, "direction": e.direction.astype(np.int8), "frame_length": e.length})
        done += len(e)
    if made.reason:
        raise ValueError(f"{comparison}: {made.reason}")


# One trace of any size inside tasks, a part at a time, never on the driver


@dataclass(frozen=True)
class Stored:
    """One trace that stays in Spark, in chunks of arrays; the driver has counts of its lengths and marks, of which there are few."""

    chunks: DataFrame
    summary: Summary

    def __len__(self) -> int:
        return len(self.summary)

    @property
    def length(self) -> Lengths:
        return self.summary.length

    def linked(self) -> DataFrame:
        """The chunks with the time of the last event before each (before; null in the first): a row for each chunk is broadcast."""
        last = self.chunks.select((F.col("chunk") + 1).alias("chunk"), F.element_at("ts", -1).alias("before"))
        return self.chunks.join(F.broadcast(last), "chunk", "left")


def stored(trace: DataFrame) -> Stored:
    """The chunks are written to the shared folder, so that the many jobs that read them don't carry the plan that made them."""
    spark, place = trace.sparkSession, new_folder(trace.sparkSession, "trace")
    chunks = in_chunks(trace, ["trace_id"], "seq", ["ts", "direction", "frame_length"], CHUNK)
    chunks = chunks.select("chunk", F.col("entries.ts").alias("ts"), F.col("entries.direction").cast("array<tinyint>").alias("direction"), F.col("entries.frame_length").cast("array<bigint>").alias("length"))
    # readers hold the rows of a file at once
    chunks.write.option("maxRecordsPerFile", 64).parquet(place)
    found = trace.groupBy("direction", "frame_length").agg(F.count("*").alias("n"), F.min("seq").alias("first")).toPandas().sort_values("first")
    counts = found.groupby("frame_length")["n"].sum()
    marks = Marks(tuple((int(d), int(x), int(n)) for d, x, n in zip(found["direction"], found["frame_length"], found["n"], strict=True)))
    return Stored(spark.read.parquet(place), Summary(Lengths(counts.index.to_numpy(np.int64), counts.to_numpy(np.int64)), marks))


def beside(trace: Stored, work: DataFrame, n: int) -> DataFrame:
    """For each of the n rows (slot, work, sampled), a partition of its own: with a copy of the trace's chunks, in order, if sampled."""
    with_chunks = trace.chunks.crossJoin(F.broadcast(work.where("sampled")))
    kinds = {c: t for c, t in trace.chunks.dtypes if c != "chunk"}
    alone = work.where("not sampled").select(F.lit(0).cast("bigint").alias("chunk"), *(F.lit(None).cast(t).alias(c) for c, t in kinds.items()), "slot", "work", "sampled")
    return with_chunks.unionByName(alone).repartitionById(n, F.col("slot")).sortWithinPartitions("slot", "chunk")


def in_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[Arrays]]]:
    """(work, the trace in parts) for each slot of what beside() deals out; the parts must be read before the next slot is."""
    rows = ((b.column("slot")[i].as_py(), b.column("work")[i].as_py(), b, i) for b in batches for i in range(len(b)))
    for _, group in groupby(rows, key=lambda r: r[0]):
        first = next(group)
        yield first[1], (arrays_of(b, i) for _, _, b, i in chain((first,), group) if b.column("ts")[i].is_valid)


def arrays_of(b: pa.RecordBatch, i: int) -> Arrays:
    """A chunk of a stored trace."""
    return Arrays(*(b.column(c)[i].values.to_numpy(zero_copy_only=False).astype(k) for c, k in (("ts", np.float64), ("direction", np.int64), ("length", np.int64))))


def generate_fitted(trace: Stored, family: str, genes: tuple, requests: list[tuple[str, int]], window: float, limits: Limits = Limits()) -> DataFrame:
    """generate() for a model that holds its reference's own samples: every request (comparison, seed) fits it where it runs."""
    summary = trace.summary

    def run(batches):
        for work, parts in in_slots(batches):
            comparison, seed = json.loads(work)
            for frame in rows_of(comparison, Parts(fit(family, genes, summary, window, parts), seed, window, limits)):
                yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    work = trace.chunks.sparkSession.createDataFrame([(i, json.dumps(r), family in SAMPLED) for i, r in enumerate(requests)], "slot int, work string, sampled boolean")
    return beside(trace, work, len(requests)).mapInArrow(run, GENERATED)


# Probes


def mmpp_log_likelihood(model: Mmpp, iats, terminal: float) -> float:
    """Scaled forward likelihood of arrivals and a last silence; the 2x2 matrix exponential has a closed form."""
    l0, l1, a, b = model.lambda0, model.lambda1, model.q01, model.q10
    d0 = np.array(((-a - l0, a), (b, -b - l1)))
    mid, half = (d0[0, 0] + d0[1, 1]) / 2, math.sqrt(((d0[0, 0] - d0[1, 1]) / 2) ** 2 + a * b)
    shifted, d1 = d0 - mid * np.eye(2), np.diag((l0, l1))

    def expm(t: float) -> np.ndarray:
        up, down = math.exp((mid + half) * t) / 2, math.exp((mid - half) * t) / 2
        return (up + down) * np.eye(2) + ((up - down) / half if half else t * math.exp(mid * t)) * shifted

    p = model.first_regime()
    forward, total = np.array((p, 1 - p)), 0.0
    for t in iats:
        forward = forward @ expm(t) @ d1
        size = float(forward.sum())
        total += math.log(size)
        forward = forward / size
    return total + math.log(float(forward @ expm(terminal) @ np.ones(2)))
