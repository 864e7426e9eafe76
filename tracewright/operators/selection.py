"""Ranking, selection and history of search candidates, as windows and grouping sets.

Candidates: generation, birth_generation, birth_index, family, priority (the family's place in the neutral order),
status, fitness. The order is total: fitness down, then priority, then birth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ID = ["birth_generation", "birth_index"]


def order(*first):
    return [*first, F.col("fitness").desc(), "priority", *ID]


def ranked(candidates: DataFrame, by: tuple[str, ...] = ("generation",)) -> DataFrame:
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order())))


def elites(candidates: DataFrame, k: int) -> DataFrame:
    return ranked(candidates).where(F.col("rank") <= k)


def champions(candidates: DataFrame) -> DataFrame:
    return ranked(candidates, ("generation", "family")).where("rank = 1").drop("rank")


def retained(candidates: DataFrame, k: int) -> DataFrame:
    """Elites, then the champions that aren't among them, in priority order; slot is the place."""
    top = elites(candidates, k)
    rest = champions(candidates).join(top.select("generation", *ID), ["generation", *ID], "left_anti")
    later = rest.withColumn("slot", k + F.row_number().over(Window.partitionBy("generation").orderBy("priority")))
    return top.withColumnRenamed("rank", "slot").unionByName(later)


def history(candidates: DataFrame) -> DataFrame:
    """Per generation: a row per family and an overall one, whose mean is the families' weighted by their size."""
    best = F.max_by(F.struct(*ID), F.struct("fitness", -F.col("priority"), -F.col("birth_generation"), -F.col("birth_index")))
    grouped = candidates.groupingSets([["generation", "family"], ["generation"]], "generation", "family").agg(
        F.grouping("family").alias("overall"), F.count("*").alias("candidate_count"), F.count_if(F.col("status") == "valid").alias("valid_count"),
        F.max("fitness").alias("best_fitness"), F.avg("fitness").alias("mean_fitness"), best.alias("best"),
    )
    scope = F.when(F.col("overall") == 1, "overall").otherwise("family")
    return grouped.select("generation", scope.alias("scope"), "family", "candidate_count", "valid_count", "best_fitness", "mean_fitness", F.col("best.birth_generation").alias("best_birth_generation"), F.col("best.birth_index").alias("best_birth_index"))


def stagnation(overall: DataFrame, tolerance: float) -> DataFrame:
    """Per generation: best so far, and how many generations in a row have not beaten it by more than tolerance.

    overall is one row per generation, a few thousand at most, so one task orders it.
    """
    before = Window.orderBy("generation").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.orderBy("generation").rowsBetween(Window.unboundedPreceding, 0)
    previous = F.max("best_fitness").over(before)
    gained = F.coalesce(F.col("best_fitness") - previous > tolerance, F.lit(True))
    marked = overall.select("generation", F.greatest("best_fitness", previous).alias("retained_best"), gained.alias("gained"))
    last = F.max(F.when(F.col("gained"), F.col("generation"))).over(upto)
    return marked.select("generation", "retained_best", (F.col("generation") - last).alias("streak"))


def history_faults(rows: DataFrame) -> DataFrame:
    """Generations whose family rows don't add up to the overall one, or whose mean exceeds the best."""
    family = rows.where("scope = 'family'").groupBy("generation").agg(F.sum("candidate_count").alias("c"), F.sum("valid_count").alias("v"), F.max("best_fitness").alias("b"))
    overall = rows.where("scope = 'overall'")
    wrong = (F.col("c") != F.col("candidate_count")) | (F.col("v") != F.col("valid_count")) | (F.col("b") != F.col("best_fitness")) | (F.col("mean_fitness") > F.col("best_fitness"))
    return overall.join(family, "generation", "full").where(F.coalesce(wrong, F.lit(True))).select("generation")


def progress(rows: DataFrame, priority: dict[str, int], tolerance: float, patience: int, generations: int, by: list[str] | None = None) -> DataFrame:
    """Per run (by) and generation of a history: its winner, the retained winner, the streak without gain, and the state reached.

    The retained winner is a running arg-max under the candidates' own order (fitness, family priority, birth), so a later
    equal never takes its place. state is hard_limit, early_stop (patience generations without a gain above tolerance; 0 never
    stops) or running. One task orders a run's generations, some thousands at most.
    """
    by = by or []
    place = F.element_at(F.create_map(*(F.lit(x) for item in priority.items() for x in item)), F.col("family"))
    key = F.struct(F.col("best_fitness").alias("fitness"), (-place).alias("place"), (-F.col("best_birth_generation")).alias("born"), (-F.col("best_birth_index")).alias("index"), F.col("family"))
    winner = rows.where("scope = 'family' AND best_birth_index IS NOT NULL").groupBy(*by, "generation").agg(F.max(key).alias("now"))
    upto = Window.partitionBy(*by).orderBy("generation").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("generation").rowsBetween(Window.unboundedPreceding, -1)
    kept = winner.withColumn("kept", F.max("now").over(upto)).withColumn("past", F.max("now").over(before))
    gained = F.coalesce(F.col("now.fitness") - F.col("past.fitness") > tolerance, F.lit(True))
    last = F.max(F.when(gained, F.col("generation"))).over(upto)
    kept = kept.withColumn("streak", F.col("generation") - last)
    state = F.when(F.col("generation") == generations, "hard_limit").when(F.lit(patience > 0) & (F.col("streak") >= patience), "early_stop").otherwise("running")
    out = [f(name) for name in ("now", "kept") for f in (
        lambda n: F.col(f"{n}.family").alias(f"{n}_family"), lambda n: F.col(f"{n}.fitness").alias(f"{n}_fitness"),
        lambda n: (-F.col(f"{n}.born")).alias(f"{n}_birth_generation"), lambda n: (-F.col(f"{n}.index")).alias(f"{n}_birth_index"),
    )]
    return kept.select(*by, "generation", *out, "streak", state.alias("state"))


RETAINED = ("kept_family", "kept_fitness", "kept_birth_generation", "kept_birth_index", "streak")


def progress_faults(stored: DataFrame, rows: DataFrame, priority: dict[str, int], tolerance: float, patience: int, generations: int, by: list[str] | None = None) -> DataFrame:
    """(by, generation, fault) where what a run stored of its progress (RETAINED, by generation) isn't what its history implies.

    worsened: the retained winner is worse than an earlier one; retained, streak: it or the streak differs; missing: one side
    lacks the generation; continued: generations follow one that stopped early.
    """
    by = by or []
    keys = [*by, "generation"]
    before = Window.partitionBy(*by).orderBy("generation").rowsBetween(Window.unboundedPreceding, -1)
    want = progress(rows, priority, tolerance, patience, generations, by)
    want = want.withColumn("stopped", F.coalesce(F.max((F.col("state") == "early_stop").cast("int")).over(before), F.lit(0)) == 1)
    held = stored.select(*keys, *RETAINED).withColumn("best_before", F.max("kept_fitness").over(before))
    a, b = want.alias("a"), held.alias("b")
    both = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full")
    here = F.col("a.streak").isNotNull() & F.col("b.best_before").isNotNull() | F.col("a.streak").isNotNull() & F.col("b.streak").isNotNull()
    differ = ~(F.col("a.kept_family").eqNullSafe(F.col("b.kept_family")) & F.col("a.kept_fitness").eqNullSafe(F.col("b.kept_fitness")) & F.col("a.kept_birth_generation").eqNullSafe(F.col("b.kept_birth_generation")) & F.col("a.kept_birth_index").eqNullSafe(F.col("b.kept_birth_index")))
    faults = F.array(
        F.when(~here, "missing"), F.when(here & (F.col("b.kept_fitness") < F.col("b.best_before")), "worsened"), F.when(here & differ, "retained"),
        F.when(here & ~F.col("a.streak").eqNullSafe(F.col("b.streak")), "streak"), F.when(F.col("a.stopped"), "continued"),
    )
    named = [F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys]
    return both.select(*named, F.explode(F.filter(faults, lambda x: x.isNotNull())).alias("fault"))


def duplicates(children: DataFrame, existing: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Children whose family and genes are already present, among those of equal by."""
    keys = [*by, "family", "genes"]
    return children.join(existing.select(*keys), keys, "left_semi")


def new_candidates(candidates: DataFrame, evaluated: DataFrame) -> DataFrame:
    return candidates.join(evaluated.select(*ID), ID, "left_anti")


def trials(candidates: DataFrame, seeds: list[int]) -> DataFrame:
    """Every candidate with every trial seed."""
    return candidates.withColumn("seed", F.explode(F.array(*(F.lit(s).cast("bigint") for s in seeds))))


def fitness(trial_scores: DataFrame) -> DataFrame:
    """Mean aggregate per candidate; any failed trial makes it invalid with fitness 0."""
    ok = F.bool_and(F.col("aggregate_score").isNotNull())
    return trial_scores.groupBy(*ID, "family").agg(F.when(ok, F.avg("aggregate_score")).otherwise(F.lit(0.0)).alias("fitness"), F.when(ok, "valid").otherwise("invalid").alias("status"))


def with_quotas(families: DataFrame, size: int) -> DataFrame:
    """families(family, priority) with the slots of each."""
    n = F.count("*").over(Window.partitionBy(F.lit(0)))
    return families.withColumn("slots", F.floor(F.lit(size) / n).cast("int") + (F.col("priority") < F.lit(size) % n).cast("int"))
