"""Statistics that the three traffic models are fitted from, as aggregations over traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import size_bin, timing_tier
from .ordered import in_chunks, join_few, lagged


def marks(trace: DataFrame) -> DataFrame:
    """Joint counts of (direction, length) in order of first appearance."""
    return trace.groupBy("trace_id", "direction", "frame_length").agg(F.count("*").alias("count"), F.min("seq").alias("first_seq"))


def mark_distribution(trace: DataFrame) -> DataFrame:
    """Per trace: the marks as one array, sorted by first appearance."""
    entry = F.struct("first_seq", "direction", "frame_length", "count")
    return marks(trace).groupBy("trace_id").agg(F.array_sort(F.collect_list(entry)).alias("marks"))


def mark_chunks(trace: DataFrame, size: int = 4096) -> DataFrame:
    """The marks of each trace by first appearance, in arrays of at most size: for traces with very many."""
    return in_chunks(marks(trace), ["trace_id"], "first_seq", ["direction", "frame_length", "count", "first_seq"], size)


def type7_thresholds(trace: DataFrame, q1: float, q2: float) -> DataFrame:
    """Two linearly interpolated quantiles of length per trace, from counts by length.

    Model fits that must be exact to the last digit interpolate on the driver, from the same counts.
    """
    counts = trace.groupBy("trace_id", F.col("frame_length").cast("double").alias("x")).agg(F.count("*").alias("n"))
    return counts.groupBy("trace_id").agg(*(F.expr(f"percentile(x, {q}, n)").alias(f"t{i}") for i, q in ((1, q1), (2, q2))))


def states(trace: DataFrame, thresholds: DataFrame) -> DataFrame:
    """trace with its state: the place of (direction, size bin) in order of first appearance."""
    code = F.col("direction").cast("int") * 3 + size_bin(F.col("frame_length"), F.col("t1"), F.col("t2"))
    coded = join_few(trace, thresholds, ["trace_id"]).withColumn("code", code).drop("t1", "t2")
    first = coded.groupBy("trace_id", "code").agg(F.min("seq").alias("__first"))
    # at most six codes per trace
    order = first.select("trace_id", "code", (F.dense_rank().over(Window.partitionBy("trace_id").orderBy("__first")) - 1).alias("state"))
    return join_few(coded, order, ["trace_id", "code"])


def transitions(stated: DataFrame) -> DataFrame:
    """Per step: source and destination state and the time between, with the source's seq."""
    time = "ts_us" if "ts_us" in stated.columns else "ts"
    near = lagged(stated, "trace_id", {"source": "state", "__at": time})
    return near.where("source is not null").select("trace_id", (F.col("seq") - 1).alias("seq"), "source", F.col("state").alias("destination"), (F.col(time) - F.col("__at")).alias("iat"))


def transition_counts(steps: DataFrame, stated: DataFrame) -> DataFrame:
    """The full count matrix of each trace, zeros included: at most 36 cells."""
    k = stated.select("trace_id", "state").distinct()
    grid = k.withColumnRenamed("state", "source").join(k.withColumnRenamed("state", "destination"), "trace_id")
    seen = steps.groupBy("trace_id", "source", "destination").agg(F.count("*").alias("n"))
    return grid.join(seen, ["trace_id", "source", "destination"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def transition_rows(counts: DataFrame, alpha: float) -> DataFrame:
    """Smoothed probabilities; a row without any mass is uniform."""
    row = Window.partitionBy("trace_id", "source")
    total, k = F.sum("n").over(row), F.count("*").over(row)
    bottom = total + F.lit(alpha) * k
    return counts.withColumn("p", F.when(bottom == 0, 1 / k).otherwise((F.col("n") + F.lit(alpha)) / bottom))


def stationary(rows: DataFrame, tolerance: float = 1e-12, squarings: int = 40) -> DataFrame:
    """(trace_id, state, p): the stationary law of each trace's chain, from transition_rows, in one pass.

    A trace has at most 36 cells, so its matrix is one array. The chain that stays put every other step has the same law and
    no period; n squarings of its matrix, each scaled to rows of sum 1, are 2^n steps, after which all rows are the law. A
    chain with several closed classes has no one law: an error.
    """
    cells = rows.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("source", "destination", "p"))).alias("cells"))
    stay = lambda c: F.when(c["source"] == c["destination"], F.lit(0.5)).otherwise(F.lit(0.0))
    cells = cells.select("trace_id", F.sqrt(F.size("cells")).cast("int").alias("k"), F.transform("cells", lambda c: c["p"].cast("double") / 2 + stay(c)).alias("m"))
    k = F.col("k")
    places, line = F.sequence(F.lit(0), k * k - 1), F.sequence(F.lit(0), k - 1)
    start = lambda x: F.floor(x / k).cast("int") * k

    def square(m: Column) -> Column:
        product = F.transform(places, lambda x: F.aggregate(line, F.lit(0.0), lambda s, i: s + m[start(x) + i] * m[i * k + x % k]))
        scaled = lambda q: F.transform(places, lambda x: q[x] / F.aggregate(line, F.lit(0.0), lambda s, i: s + q[start(x) + i]))
        return F.transform(F.array(product), scaled)[0]

    last = cells.select("trace_id", "k", F.aggregate(F.sequence(F.lit(1), F.lit(squarings)), F.col("m"), lambda m, _: square(m)).alias("m"))
    apart = F.exists(places, lambda x: F.abs(F.col("m")[x] - F.col("m")[x % k]) > tolerance)
    law = F.when(apart, F.raise_error(F.concat(F.lit("no single stationary law: trace "), "trace_id")).cast("array<double>")).otherwise(F.slice("m", F.lit(1), k))
    return last.select("trace_id", F.posexplode(law).alias("state", "p"))


def iat_samples(steps: DataFrame, by: list[str]) -> DataFrame:
    """Inter-arrival samples in order, as arrays, by edge, source or whole trace: the models' own payload."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "iat")))
    return steps.groupBy("trace_id", *by).agg(F.transform(ordered, lambda x: x["iat"]).alias("iats"))


def iat_chunks(steps: DataFrame, by: list[str], size: int = 4096) -> DataFrame:
    """iat_samples in arrays of at most size, so that a sample of any size can be drawn from by rank."""
    return in_chunks(steps, ["trace_id", *by], "seq", ["iat", "seq"], size)


def timing_tiers(counts: DataFrame, minimum: int) -> DataFrame:
    """Per edge: the tier whose sample a step over it draws from."""
    row = Window.partitionBy("trace_id", "source")
    return counts.withColumn("tier", timing_tier(F.col("n"), F.lit(minimum), F.sum("n").over(row)))


def tier_usage(tiers: DataFrame) -> DataFrame:
    sums = [F.coalesce(F.sum(F.when(F.col("tier") == t, F.col("n"))), F.lit(0)).alias(f"{t}_count") for t in ("transition", "source", "global")]
    return tiers.groupBy("trace_id").agg(*sums)


def poisson_rates(trace: DataFrame, scale: float) -> DataFrame:
    """Intervals per second of the whole window, and that rate scaled."""
    base = (F.count("*") - 1) / (F.max("ts") - F.min("ts"))
    return trace.groupBy("trace_id").agg(base.alias("base_rate")).withColumn("rate", F.col("base_rate") * F.lit(scale))


def flow(counts: DataFrame, stated: DataFrame) -> DataFrame:
    """Per state: packets and steps out and in; each differs by at most one from packets, once in all."""
    packets = stated.groupBy("trace_id", "state").agg(F.count("*").alias("packets"))
    out = counts.groupBy("trace_id", F.col("source").alias("state")).agg(F.sum("n").alias("outgoing"))
    into = counts.groupBy("trace_id", F.col("destination").alias("state")).agg(F.sum("n").alias("incoming"))
    return packets.join(out, ["trace_id", "state"]).join(into, ["trace_id", "state"])


def flow_consistent(flows: DataFrame) -> DataFrame:
    gap_out, gap_in = F.col("packets") - F.col("outgoing"), F.col("packets") - F.col("incoming")
    ok: Column = F.bool_and(gap_out.isin(0, 1) & gap_in.isin(0, 1)) & (F.sum(gap_out) == 1) & (F.sum(gap_in) == 1)
    return flows.groupBy("trace_id").agg(ok.alias("consistent"))


def connected(counts: DataFrame) -> DataFrame:
    """Whether the states of each trace (six at most, so a set is a number's bits) form one component under its steps."""
    cells = counts.groupBy("trace_id").agg(
        F.collect_list(F.when(F.col("n") > 0, F.struct(F.col("source").cast("int").alias("a"), F.col("destination").cast("int").alias("b")))).alias("edges"),
        F.bit_or(F.pow(F.lit(2), F.col("source")).cast("int")).alias("all"),
    )

    def bit(state: Column) -> Column:
        return F.pow(F.lit(2), state).cast("int")

    def grow(reached: Column, edge: Column) -> Column:
        ends = bit(edge["a"]).bitwiseOR(bit(edge["b"]))
        return F.when(reached.bitwiseAND(ends) != 0, reached.bitwiseOR(ends)).otherwise(reached)

    start = F.col("all").bitwiseAND(-F.col("all"))
    reached = F.aggregate(F.sequence(F.lit(1), F.lit(6)), start, lambda r, _: F.aggregate(F.col("edges"), r, grow))
    return cells.select("trace_id", (reached == F.col("all")).alias("connected"))


def same_multiset(left: DataFrame, right: DataFrame) -> bool:
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()
