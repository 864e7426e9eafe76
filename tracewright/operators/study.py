"""Statistics of repeated runs: descriptive figures, intervals, natural variation and weight analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import in_chunks, order_figures
from .similarity import METHODS, Settings, aggregate, compare_pairs

BOOTSTRAP_SEED = 1729


def sample_record(rows: DataFrame, by: list[str], value: str, q: float) -> DataFrame:
    """Count, minimum, median, nearest-rank quantile, maximum and zeros."""
    return order_figures(rows, by, value, q).withColumnRenamed("zeros", "zero_count")


def descriptive_statistics(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    x = F.col(value)
    return rows.groupBy(*by).agg(
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.min(x).alias("minimum"), F.max(x).alias("maximum"),
        (F.max(x) - F.min(x)).alias("range"), F.var_samp(x).alias("sample_variance"), F.stddev_samp(x).alias("sample_stdev"),
    )


def bootstrap(rows: DataFrame, by: list[str], value: str, seed: int = BOOTSTRAP_SEED, resamples: int = 10_000, confidence: float = 0.95) -> DataFrame:
    """Percentile-bootstrap interval of the mean per group, over its values in order, so partitioning doesn't matter; a task holds one group."""
    import pandas as pd

    key = ", ".join(f"{rows.schema[c].name} {rows.schema[c].dataType.simpleString()}" for c in by)

    def run(keys, frame):
        low, high = bootstrap_interval(frame["__x"].sort_values().to_numpy(), seed, resamples, confidence)
        return pd.DataFrame([(*keys, len(frame), low, high)])

    picked = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__x"))
    return picked.groupBy(*by).applyInPandas(run, f"{key}, sample_size bigint, lower_bound double, upper_bound double")


def bootstrap_interval(values, seed: int = BOOTSTRAP_SEED, resamples: int = 10_000, confidence: float = 0.95) -> tuple[float, float]:
    import numpy as np

    x = np.asarray(values, dtype=np.float64)
    if not len(x) or not np.all(np.isfinite(x)):
        raise ValueError("a bootstrap sample must be finite and not empty")
    if np.all(x == x[0]):
        return float(x[0]), float(x[0])
    rng = np.random.Generator(np.random.PCG64(seed))
    means, step = np.empty(resamples), max(1, 1_000_000 // len(x))
    for i in range(0, resamples, step):
        n = min(step, resamples - i)
        means[i : i + n] = x[rng.integers(0, len(x), (n, len(x)))].mean(axis=1)
    tail = (1 - confidence) / 2
    return float(np.percentile(means, 100 * tail)), float(np.percentile(means, 100 * (1 - tail)))


def direction_values(trace: DataFrame) -> DataFrame:
    out = [F.count_if(F.col("direction") == d).alias(f"{n}_packets") for d, n in enumerate(("outbound", "inbound"))]
    out += [F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("frame_length"))), F.lit(0)).alias(f"{n}_bytes") for d, n in enumerate(("outbound", "inbound"))]
    return trace.groupBy("trace_id").agg(*out)


def repeat_pairs(runs: DataFrame) -> DataFrame:
    """Unordered pairs of a workload's repeats, each in both directions."""
    a, b = runs.alias("a"), runs.alias("b")
    one = a.join(b, (F.col("a.workload") == F.col("b.workload")) & (F.col("a.repeat") < F.col("b.repeat")))
    one = one.select(F.col("a.workload").alias("workload"), F.col("a.repeat").alias("reference"), F.col("b.repeat").alias("generated"))
    return one.unionByName(one.select("workload", F.col("generated").alias("reference"), F.col("reference").alias("generated")))


def natural_variation(scores: DataFrame) -> DataFrame:
    """scores(workload, reference, generated, score) of repeat_pairs: mean over both directions, pairs and workload."""
    pair = scores.groupBy("workload", F.least("reference", "generated").alias("left"), F.greatest("reference", "generated").alias("right")).agg(F.avg("score").alias("symmetric"))
    return pair.groupBy("workload").agg(F.count("*").alias("pairs"), F.avg("symmetric").alias("mean"), F.min("symmetric").alias("minimum"), F.max("symmetric").alias("maximum"))


def variation_of(traces: DataFrame, runs: DataFrame, settings: Settings) -> DataFrame:
    """natural_variation of the aggregate score between the repeats of each workload, all pairs in one comparison.

    runs has workload, repeat and trace_id; widths in settings are shares of a reference's window.
    """
    pairs = repeat_pairs(runs)
    named = lambda side: runs.select("workload", F.col("repeat").alias(side), F.col("trace_id").alias(f"{side}_trace"))
    pairs = pairs.join(named("reference"), ["workload", "reference"]).join(named("generated"), ["workload", "generated"])
    scores = aggregate(compare_pairs(traces, pairs.select(F.col("reference_trace").alias("reference"), F.col("generated_trace").alias("generated")), settings))
    scores = scores.select(F.col("reference").alias("reference_trace"), F.col("comparison").alias("generated_trace"), F.col("aggregate_score").alias("score"))
    return natural_variation(pairs.join(scores, ["reference_trace", "generated_trace"]))


def weighted(weights: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for m in METHODS:
        total = total + F.lit(float(weights[m])) * F.col(m)
    return total


def controlled_reweighting(components: DataFrame, alternatives: dict[str, dict[str, float]]) -> DataFrame:
    """The same component scores under other method weights; alternatives are a few named weightings."""
    cases = F.array(*(F.struct(F.lit(name).alias("weighting"), weighted(w).alias("aggregate")) for name, w in alternatives.items()))
    keys = [c for c in components.columns if c not in METHODS]
    return components.select(*keys, F.explode(cases).alias("x")).select(*keys, "x.weighting", "x.aggregate")


def score_means(scores: DataFrame, by: list[str]) -> DataFrame:
    return scores.groupBy(*by).agg(*(F.avg(m).alias(m) for m in METHODS), F.avg("aggregate_score").alias("aggregate_score"))


def score_delta(source: DataFrame, reproduction: DataFrame, by: list[str]) -> DataFrame:
    """Reproduction minus source, per metric."""
    b = reproduction.select(*by, *(F.col(m).alias(f"__{m}") for m in METHODS))
    return source.join(b, by).select(*by, *((F.col(f"__{m}") - F.col(m)).alias(m) for m in METHODS))


def training_selection(runs: DataFrame) -> DataFrame:
    """The best repeat of each workload: fitness down, then the earlier repeat."""
    place = F.row_number().over(Window.partitionBy("workload").orderBy(F.col("fitness").desc(), "repeat"))
    return runs.withColumn("__place", place).where("__place = 1").drop("__place")


def family_champions(candidates: DataFrame, by: list[str]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by, "family").orderBy(F.col("fitness").desc(), "birth_generation", "birth_index"))
    return candidates.where("status = 'valid'").withColumn("__place", place).where("__place = 1").drop("__place")


def workload_summary(champions: DataFrame, families: list[str]) -> DataFrame:
    """Per workload: mean champion fitness of each family, and how often each wins a run."""
    wins = F.row_number().over(Window.partitionBy("workload", "repeat").orderBy(F.col("fitness").desc(), "family")) == 1
    marked = champions.withColumn("__win", wins.cast("int"))
    out = [F.avg(F.when(F.col("family") == f, F.col("fitness"))).alias(f"{f}_mean") for f in families]
    out += [F.coalesce(F.sum(F.when(F.col("family") == f, F.col("__win"))), F.lit(0)).alias(f"{f}_wins") for f in families]
    return marked.groupBy("workload").agg(*out)


def winner_variance(summary: DataFrame, families: list[str]) -> DataFrame:
    """Sample variance of the families' win counts, zeros included."""
    long = summary.select("workload", F.explode(F.array(*(F.col(f"{f}_wins") for f in families))).alias("wins"))
    return long.groupBy("workload").agg(F.var_samp("wins").alias("win_variance"))


def invalid_report(candidates: DataFrame, by: list[str]) -> DataFrame:
    """Failures of invalid candidates, by run."""
    entry = F.struct("birth_generation", "birth_index", "family", "failure_kind", "detail")
    return candidates.where("status = 'invalid'").groupBy(*by).agg(F.count("*").alias("failures"), F.array_sort(F.collect_list(entry)).alias("diagnostics"))


def invalid_chunks(candidates: DataFrame, by: list[str], size: int = 4096) -> DataFrame:
    """Failures of invalid candidates by run, in arrays of at most size, in the order of birth."""
    order = F.col("birth_generation").cast("bigint") * (1 << 40) + F.col("birth_index")
    failed = candidates.where("status = 'invalid'").withColumn("__order", order)
    return in_chunks(failed, by, "__order", ["birth_generation", "birth_index", "family", "failure_kind", "detail"], size)


def lag_one_covariance(series: DataFrame, by: list[str], value: str, seq: str = "seq") -> DataFrame:
    from .ordered import join_few, lagged

    first = series.withColumn("__trace", F.concat_ws("/", *by))
    near = lagged(first, "__trace", {"__before": value}, seq)
    mean = series.groupBy(*by).agg(F.avg(value).alias("__mean"))
    gap = (F.col(value) - F.col("__mean")) * (F.col("__before") - F.col("__mean"))
    return join_few(near, mean, by).where("__before is not null").groupBy(*by).agg((F.sum(gap) / F.count("*")).alias("covariance"))
