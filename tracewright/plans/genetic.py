"""The genetic search: one sequential random stream on the driver, one Spark job per generation.

Selection, crossover and mutation consume the stream in a fixed order, so they stay on the driver; evaluating a
generation consumes none of it and is a job over candidates and seeds. Already valid candidates aren't evaluated again.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

import numpy as np
from pyspark.sql import SparkSession

from ..functions import kernels
from ..functions.kernels import Arrays
from ..operators.models import GENES, Bounds, Limits, RepairError, Stored, fit, repair, rng_of
from ..operators.scoring import profile, trials
from ..operators.similarity import Settings

KINDS = ("repair", "fit", "generation", "incomplete_generation", "similarity_precondition", "nonfinite_score")


@dataclass(frozen=True)
class Candidate:
    birth: tuple[int, int]
    family: str
    genes: tuple | None
    status: str = "pending"
    fitness: float = 0.0
    failure: tuple[str, str] | None = None
    scores: tuple = ()
    attempts: tuple[str, ...] = ()


@dataclass(frozen=True)
class Operators:
    crossover: float
    mutation: float
    scale: float


@dataclass(frozen=True)
class Search:
    """All that a run depends on; two runs with equal values give equal results."""

    bounds: dict[str, Bounds]
    operators: dict[str, Operators]
    population: int
    generations: int
    tournament: int
    elites: int
    seeds: tuple[int, ...]
    master_seed: int
    final_seed: int
    duplicate_attempts: int = 1
    stop_after: int = 0
    tolerance: float = 0.0
    limits: Limits = field(default_factory=Limits)

    def __post_init__(self) -> None:
        if set(self.bounds) != set(self.operators) or not set(self.bounds) <= set(GENES):
            raise ValueError("bounds and operators must name the same known families")
        if not 1 <= self.elites < self.population or self.population < self.elites + len(self.bounds):
            raise ValueError("the population must hold elites and a champion of each family")
        if not 2 <= self.tournament <= self.population:
            raise ValueError("a tournament takes 2 or more members of the population")
        if len(set(self.seeds)) < len(self.seeds) or not self.seeds or self.final_seed in self.seeds:
            raise ValueError("trial seeds must be unique, and the final seed fresh")

    @property
    def priority(self) -> tuple[str, ...]:
        """A neutral order of families, from a stream of its own."""
        return tuple(str(x) for x in rng_of(self.master_seed).permutation(np.array(sorted(self.bounds))))


@dataclass(frozen=True)
class State:
    generation: int
    population: tuple[Candidate, ...]
    history: tuple[dict, ...]
    rng: dict
    best: tuple[int, int]
    best_fitness: float
    stagnation: int
    reason: str


def rank(priority: tuple[str, ...]) -> Callable[[Candidate], tuple]:
    return lambda c: (-c.fitness, priority.index(c.family), c.birth)


# Coordinates


def encode(kind: str, bound: tuple[float, float], x: float) -> float:
    a, b = (math.log(v) for v in bound) if kind == "log" else bound
    return ((math.log(x) if kind == "log" else x) - a) / (b - a)


def decode(kind: str, bound: tuple[float, float], z: float):
    if z in (0.0, 1.0):
        return bound[int(z)]
    if kind == "integer":
        return bound[0] + math.floor(z * (bound[1] - bound[0]) + 0.5)
    if kind == "log":
        a, b = (math.log(v) for v in bound)
        return math.exp(a + z * (b - a))
    return bound[0] + z * (bound[1] - bound[0])


def reflect(z: float) -> float:
    r = z % 2.0
    return r if r <= 1.0 else 2.0 - r


def stepped(kind: str, bound, before, epsilon: float, after):
    """An integer gene that a mutation left in place moves by one, and bounces at its bounds."""
    if kind != "integer" or after != before:
        return after
    moved = before + (1 if epsilon >= 0 else -1)
    return bound[1] - 1 if moved > bound[1] else bound[0] + 1 if moved < bound[0] else moved


class Engine:
    def __init__(self, search: Search, reference: Arrays | Stored, window: float, settings: Settings):
        """A stored reference stays in Spark, and tasks see it in parts; one in arrays travels with the code."""
        settings.check(window)
        # the reference must fit the settings itself
        if isinstance(reference, Arrays):
            kernels.compare(reference, reference, window, settings)
        else:
            kernels.require(len(reference), settings)
        self.search, self.reference, self.window, self.settings = search, reference, window, settings
        self.priority, self.about = search.priority, None

    # Variation

    def born(self, birth: tuple[int, int], family: str, genes: tuple, attempts: tuple[str, ...] = ()) -> Candidate:
        try:
            return Candidate(birth, family, repair(family, genes, self.search.bounds[family], self.reference), attempts=attempts)
        except RepairError as e:
            return Candidate(birth, family, None, "invalid", failure=("repair", str(e)), attempts=attempts)

    def first(self, rng: np.random.Generator) -> list[Candidate]:
        """Families fill adjoining slots in priority order; remainders go to the first ones."""
        share, more = divmod(self.search.population, len(self.priority))
        out: list[Candidate] = []
        for i, family in enumerate(self.priority):
            for _ in range(share + (i < more)):
                genes = []
                for name, kind in GENES[family]:
                    bound = self.search.bounds[family][name]
                    genes.append(int(rng.integers(*bound, endpoint=True)) if kind == "integer" else decode(kind, bound, rng.random()))
                out.append(self.born((0, len(out)), family, tuple(genes)))
        return out

    def select(self, population, rng: np.random.Generator) -> Candidate:
        drawn = [population[int(rng.integers(0, len(population)))] for _ in range(self.search.tournament)]
        return min(drawn, key=rank(self.priority))

    def mutate(self, genes: tuple, family: str, rng: np.random.Generator, force: bool, step: bool) -> tuple:
        """All choices are drawn before any offset; if force and none is chosen, one gene is."""
        ops, out = self.search.operators[family], list(genes)
        coordinates = [(kind, self.search.bounds[family][name]) for name, kind in GENES[family]]
        chosen = [i for i in range(len(out)) if rng.random() < ops.mutation]
        forced = not chosen and force
        for i in [int(rng.integers(0, len(out)))] if forced else chosen:
            kind, bound = coordinates[i]
            epsilon = rng.normal(0.0, ops.scale)
            after = decode(kind, bound, reflect(encode(kind, bound, out[i]) + epsilon))
            out[i] = stepped(kind, bound, out[i], epsilon, after) if step or forced else after
        return tuple(out)

    def child(self, a: Candidate, b: Candidate, birth: tuple[int, int], existing: list[Candidate], rng: np.random.Generator) -> Candidate:
        source, cross = min(a, b, key=rank(self.priority)), a.family != b.family
        family, missing = source.family, Candidate(birth, source.family, None, "invalid", failure=("repair", "a selected parent has no genes"))
        if source.genes is None:
            return missing
        genes = source.genes
        if not cross and rng.random() < self.search.operators[family].crossover:
            if a.genes is None or b.genes is None:
                return missing
            genes = tuple(y if rng.random() < 0.5 else x for x, y in zip(a.genes, b.genes, strict=True))
        made = self.born(birth, family, self.mutate(genes, family, rng, cross, cross))
        return self.distinct(made, source, cross, existing, rng)

    def distinct(self, made: Candidate, source: Candidate, cross: bool, existing: list[Candidate], rng: np.random.Generator) -> Candidate:
        """A child that equals another is mutated again, a bounded number of times; if that fails it stays as it was."""

        def known(genes: tuple) -> bool:
            return (cross and genes == source.genes) or any(c.genes is not None and c.family == made.family and c.genes == genes for c in existing)

        if made.genes is None or not known(made.genes):
            return made
        tried, genes, most = [], made.genes, self.search.duplicate_attempts
        for n in range(1, most + 1):
            again = self.born(made.birth, made.family, self.mutate(genes, made.family, rng, True, True), tuple(tried))
            if again.genes is not None:
                if not known(again.genes):
                    return again
                genes = again.genes
            tried.append("exhausted" if n == most else "invalid" if again.genes is None else "duplicate")
        return replace(made, attempts=tuple(tried) or ("exhausted",))

    def next(self, population: tuple[Candidate, ...], generation: int, rng: np.random.Generator) -> list[Candidate]:
        ordered = sorted(population, key=rank(self.priority))
        out = ordered[: self.search.elites]
        for family in self.priority:
            best = next((c for c in ordered if c.family == family), None)
            if best is not None and best not in out:
                out.append(best)
        n = 0
        while len(out) < self.search.population:
            a, b = self.select(population, rng), self.select(population, rng)
            out.append(self.child(a, b, (generation, n), out, rng))
            n += 1
        return out

    # Evaluation

    def trial(self, family: str, genes: tuple, seed: int) -> dict:
        """Scores of one fitted candidate under one seed, or what failed."""
        try:
            model = fit(family, genes, self.reference, self.window)
        except (ValueError, ArithmeticError) as e:
            return {"kind": "fit", "detail": str(e)}
        try:
            made = model.generate(seed, self.window, self.search.limits)
        except (ValueError, ArithmeticError) as e:
            return {"kind": "generation", "detail": str(e)}
        if not made.complete:
            return {"kind": "incomplete_generation", "detail": made.reason}
        try:
            scores = kernels.compare(self.reference, Arrays.of(made.events), self.window, self.settings)
        except ValueError as e:
            return {"kind": "similarity_precondition", "detail": str(e)}
        if any(not math.isfinite(x) or not 0 <= x <= 1 for x in scores.values()):
            return {"kind": "nonfinite_score", "detail": json.dumps(scores)}
        return {"scores": scores, "counters": made.counters}

    def evaluate(self, spark: SparkSession | None, population: list[Candidate], seeds: tuple[int, ...] | None = None) -> tuple[Candidate, ...]:
        """All pending candidates under all seeds, as one job; without a session in this process."""
        seeds = seeds or self.search.seeds
        todo = [(i, c.family, json.dumps(c.genes), s) for i, c in enumerate(population) if c.status == "pending" for s in seeds]
        if spark is None or not todo:
            results = [(i, s, self.trial(f, tuple(json.loads(g)), s)) for i, f, g, s in todo]
        else:
            results = self._job(spark, todo)
        by: dict[int, dict[int, dict]] = {}
        for i, s, r in results:
            by.setdefault(i, {})[s] = r
        out = list(population)
        for i, found in by.items():
            runs = [found[s] for s in seeds]
            bad = next((r for r in runs if "kind" in r), None)
            if bad:
                out[i] = replace(out[i], status="invalid", fitness=0.0, failure=(bad["kind"], bad["detail"]))
            else:
                mean = math.fsum(r["scores"]["aggregate_score"] for r in runs) / len(runs)
                out[i] = replace(out[i], status="valid", fitness=mean, scores=tuple(r["scores"] for r in runs))
        return tuple(out)

    def _job(self, spark: SparkSession, todo: list[tuple]) -> list[tuple[int, int, dict]]:
        import pandas as pd

        if isinstance(self.reference, Stored):
            if self.about is None:
                self.about = profile(self.reference, self.window, self.settings)
            return trials(self.reference, self.about, todo, self.window, self.settings, self.search.limits)
        engine, slots = self, min(len(todo), spark.sparkContext.defaultParallelism)

        def run(frames):
            for frame in frames:
                done = [json.dumps(engine.trial(r.family, tuple(json.loads(r.genes)), int(r.seed))) for r in frame.itertuples()]
                yield pd.DataFrame({"i": frame["i"], "seed": frame["seed"], "result": done})

        rows = spark.createDataFrame(todo, "i bigint, family string, genes string, seed bigint")
        # a population is a few dozen rows by configuration
        return [(r.i, r.seed, json.loads(r.result)) for r in rows.repartition(slots).mapInPandas(run, "i bigint, seed bigint, result string").collect()]

    # The run

    def summary(self, generation: int, population: tuple[Candidate, ...]) -> list[dict]:
        def row(members: list[Candidate], family: str | None) -> dict:
            best = min(members, key=rank(self.priority))
            return {
                "generation": generation, "scope": "family" if family else "overall", "family": family, "candidate_count": len(members),
                "valid_count": sum(c.status == "valid" for c in members), "best_fitness": best.fitness,
                "mean_fitness": math.fsum(c.fitness for c in members) / len(members), "best_birth_generation": best.birth[0], "best_birth_index": best.birth[1],
            }

        rows = [row([c for c in population if c.family == f], f) for f in sorted(self.search.bounds)]
        whole = row(list(population), None)
        whole["mean_fitness"] = math.fsum(r["mean_fitness"] * r["candidate_count"] for r in rows) / len(population)
        return [*rows, whole]

    def finish(self, spark, population: list[Candidate], rng: np.random.Generator, generation: int, before: State | None) -> State:
        done = self.evaluate(spark, population)
        best, idle = min(done, key=rank(self.priority)), 0
        if before is not None:
            idle = 0 if best.fitness - before.best_fitness > self.search.tolerance else before.stagnation + 1
            best = min(best, next(c for c in before.population if c.birth == before.best), key=rank(self.priority))
        reason = "hard_limit" if generation == self.search.generations else "early_stop" if 0 < self.search.stop_after <= idle else "running"
        history = (before.history if before else ()) + tuple(self.summary(generation, done))
        return State(generation, done, history, rng.bit_generator.state, best.birth, best.fitness, idle, reason)

    def run(self, spark: SparkSession | None, resume: State | None = None, publish: Callable[[State], None] = lambda s: None) -> State:
        rng, state = rng_of(self.search.master_seed), resume
        if state is None:
            state = self.finish(spark, self.first(rng), rng, 0, None)
            publish(state)
        else:
            rng.bit_generator.state = state.rng
        while state.reason == "running":
            state = self.finish(spark, self.next(state.population, state.generation + 1, rng), rng, state.generation + 1, state)
            publish(state)
        return state

    def final(self, spark: SparkSession | None, state: State) -> dict:
        """The winner once more under the final, fresh seed."""
        winner = replace(next(c for c in state.population if c.birth == state.best), status="pending")
        checked = self.evaluate(spark, [winner], (self.search.final_seed,))[0]
        if checked.status != "valid":
            raise ValueError(f"final validation failed: {checked.failure}")
        return checked.scores[0]


def checkpoint(search: Search, state: State) -> bytes:
    """The state with what it depends on, as canonical JSON."""
    return (json.dumps({"search": asdict(search), "state": asdict(state)}, sort_keys=True, separators=(",", ":"), allow_nan=False) + "\n").encode()


def load_checkpoint(content: bytes, search: Search) -> State:
    """The state of a checkpoint of the very same search."""
    found = json.loads(content)
    if found["search"] != json.loads(json.dumps(asdict(search))):
        raise ValueError("the checkpoint belongs to another search")
    s = found["state"]
    people = tuple(
        Candidate(tuple(c["birth"]), c["family"], None if c["genes"] is None else tuple(c["genes"]), c["status"], c["fitness"], c["failure"] and tuple(c["failure"]), tuple(c["scores"]), tuple(c["attempts"]))
        for c in s["population"]
    )
    return State(s["generation"], people, tuple(s["history"]), s["rng"], tuple(s["best"]), s["best_fitness"], s["stagnation"], s["reason"])
