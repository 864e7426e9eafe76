"""The four similarity measures and their weighted aggregate, as aggregations.

Traces come as two frames, reference and generated, both aligned to the window. A column ``comparison`` in the generated
frame compares many traces with one reference at once: reference figures are aggregated once and reused.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ACF_TOLERANCE, L1_TOLERANCE, WEIGHT_TOLERANCE, clamp, snap
from .ordered import join_few, lag_products, lag_sums, lagged, order_figures, running_totals, whole_numbers
from .traces import align, iats, normalize, window_of

METHODS = ("autocorrelation", "frame_size_ks", "iat_ks", "multiscale_rate")


@dataclass(frozen=True)
class Settings:
    lags: tuple[int, ...] = (1, 4, 16, 64)
    lag_weights: tuple[float, ...] = (0.25, 0.25, 0.25, 0.25)
    iat_weight: float = 0.5
    size_weight: float = 0.5
    widths: tuple[float, ...] = ()
    scale_weights: tuple[float, ...] = ()
    packet_weight: float = 0.5
    byte_weight: float = 0.5
    max_cells: int = 1_000_000
    quantile: float = 0.95
    method_weights: dict[str, float] = field(default_factory=lambda: dict.fromkeys(METHODS, 0.25))

    def check(self, window: float) -> None:
        """Everything that needs no data: weights, lags, widths and the cell cap, before any job."""
        valid_weights(self.lag_weights, len(self.lags))
        valid_weights(self.scale_weights, len(self.widths))
        valid_weights((self.iat_weight, self.size_weight), 2)
        valid_weights((self.packet_weight, self.byte_weight), 2)
        valid_weights([self.method_weights[m] for m in METHODS], 4)
        if not self.lags or len(set(self.lags)) < len(self.lags) or min(self.lags) < 1:
            raise ValueError("lags must be unique positive integers")
        if not 0 < self.quantile <= 1:
            raise ValueError("the diagnostic quantile must be in (0, 1]")
        bin_counts(window, self.widths, self.max_cells)


def valid_weights(weights, n: int) -> None:
    if len(weights) != n or any(not math.isfinite(w) or w < 0 for w in weights) or abs(math.fsum(weights) - 1) > WEIGHT_TOLERANCE:
        raise ValueError(f"expected {n} nonnegative weights that sum to 1")


def bin_counts(window: float, widths, max_cells: int) -> list[int]:
    """Bins per direction of each width, from the window; refuses more cells in all than max_cells."""
    if not math.isfinite(window) or window <= 0:
        raise ValueError("the window must be positive and finite")
    if not widths or any(not math.isfinite(w) or not 0 < w <= window for w in widths) or any(a >= b for a, b in zip(widths, widths[1:], strict=False)):
        raise ValueError("widths must be finite, increasing and no larger than the window")
    counts = []
    for w in widths:
        q = window / w
        counts.append(math.ceil(round(q) if abs(q - round(q)) <= 4 * math.ulp(q) else q))
    if 2 * sum(counts) > max_cells:
        raise ValueError("more direction-bin cells than the cap")
    return counts


def _named(generated: DataFrame) -> DataFrame:
    """generated with a comparison column."""
    return generated if "comparison" in generated.columns else generated.withColumn("comparison", F.lit("generated"))


def _alone(generated: DataFrame) -> bool:
    """Whether there is one comparison, unnamed: what has a row per comparison then has one row, and is broadcast."""
    return "comparison" not in generated.columns


def _few(frame: DataFrame, alone: bool) -> DataFrame:
    return F.broadcast(frame) if alone else frame


def _keys(frame: DataFrame) -> list[str]:
    """The columns that name a comparison: its own reference, if each has one, and the generated trace."""
    return [c for c in ("reference", "comparison") if c in frame.columns]


def _of(frame: DataFrame) -> list[str]:
    return ["reference"] if "reference" in frame.columns else []


# Kolmogorov-Smirnov


def ks(reference: DataFrame, generated: DataFrame, value: str) -> DataFrame:
    """Per comparison: distance, and the counts of both samples. Values are counted before anything is ordered.

    Both distribution functions are steps. Between two neighbouring values of a comparison its own is constant and the
    reference's doesn't fall, so the largest gap lies at one of its own values or just before one: the reference is looked up
    there in its running totals, and no comparison needs a copy of it.
    """
    alone, generated, of = _alone(generated), _named(generated), _of(generated)
    zero = F.lit(0).cast("bigint")
    ours = reference.groupBy(*of, F.col(value).alias("x")).agg(F.count("*").alias("a"))
    theirs = generated.where("comparison is not null").groupBy(*of, "comparison", F.col(value).alias("x")).agg(F.count("*").alias("b"))
    at = lambda a, b: F.abs(a / F.col("na") - b / F.col("nb"))
    na = F.col("whole_a")
    if alone:
        one = ours.select("x", "a", zero.alias("b")).unionByName(theirs.select("x", zero.alias("a"), "b"))
        one = one.groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).withColumn("comparison", F.lit("generated"))
        totals, gap = running_totals(one, ["comparison"], "x", ["a", "b"]), at(F.col("total_a"), F.col("total_b"))
    else:
        values = ours.unionByName(theirs.select(*of, "x", zero.alias("a"))).groupBy(*of, "x").agg(F.sum("a").alias("a"))
        below = running_totals(values, of, "x", ["a"])
        totals = running_totals(theirs, [*of, "comparison"], "x", ["b"]).join(below, [*of, "x"])
        gap = F.greatest(at(F.col("total_a"), F.col("total_b")), at(F.col("total_a") - F.col("a"), F.col("total_b") - F.col("b")))
        totals, na = (totals.where("whole_a > 0"), na) if of else (totals, F.nullif(na, F.lit(0)))
    # the groups' totals are the sample sizes
    return totals.withColumn("na", na).withColumn("nb", F.col("whole_b")).groupBy(*of, "comparison").agg(
        F.max(gap).alias("distance"), F.first("na").alias("reference_count"), F.first("nb").alias("generated_count")
    )


def frame_size_ks(reference: DataFrame, generated: DataFrame) -> DataFrame:
    alone, of = _alone(generated), _of(generated)
    length = [F.min("frame_length").alias("minimum_length"), F.max("frame_length").alias("maximum_length")]
    ours = reference.groupBy(*of).agg(*length).toDF(*of, "reference_minimum_length", "reference_maximum_length")
    theirs = _named(generated).groupBy(*of, "comparison").agg(*length).toDF(*of, "comparison", "generated_minimum_length", "generated_maximum_length")
    found = ks(reference, generated, "frame_length").join(_few(theirs, alone), [*of, "comparison"])
    found = found.join(ours, of) if of else found.crossJoin(F.broadcast(ours))
    return found.withColumn("score", 1 - F.col("distance"))


def iat_record(samples: DataFrame, by: list[str], value: str, q: float, prefix: str) -> DataFrame:
    """Median, nearest-rank quantile and zeros of a sample."""
    return order_figures(samples, by, value, q).select(*by, *(F.col(c).alias(f"{prefix}_{c}") for c in ("median", "quantile", "zeros")))


def _time(frame: DataFrame) -> str:
    return "iat_us" if "iat_us" in frame.columns else "iat"


def iat_ks(reference: DataFrame, generated: DataFrame, q: float) -> DataFrame:
    """Takes inter-arrival times of both sides."""
    alone, of, time = _alone(generated), _of(generated), _time(reference)
    found, ours = ks(reference, generated, time), iat_record(reference, of, time, q, "reference")
    found = found.join(_few(iat_record(_named(generated), [*of, "comparison"], time, q, "generated"), alone), [*of, "comparison"])
    return (found.join(ours, of) if of else found.crossJoin(F.broadcast(ours))).withColumn("score", 1 - F.col("distance"))


# Autocorrelation


def autocorrelations(series: DataFrame, by: list[str], value: str, lags: list[int], few: bool = False) -> DataFrame:
    """Per series and lag; 0 for constant series, and no row where a lag doesn't fit.

    Sums over integers are exact, and shifted by the whole part of the mean; where even so the quotient's terms pass 38
    digits, they are taken as doubles, of which the shift leaves no digits to cancel. Doubles are centred by their mean
    first. few says that the series are a handful, so that their sums are broadcast; else Spark chooses by size.
    """
    few_of = F.broadcast if few else lambda frame: frame
    if series.schema[value].dataType.typeName() == "double":
        means = series.groupBy(*by).agg(F.avg(value).alias("__mean"), (F.min(value) == F.max(value)).alias("__flat"))
        series = series.join(few_of(means), by).withColumn(value, F.when(F.col("__flat"), F.lit(0.0)).otherwise(F.col(value) - F.col("__mean"))).drop("__mean", "__flat")
        kind, exact = "double", False
    else:
        kind, exact = "decimal(19,0)", True
    if whole_numbers(series, value):
        joined = lag_sums(series, by, value, lags)
    else:
        x = F.col(value).cast(kind)
        whole = series.groupBy(*by).agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("ss"))
        joined = lag_products(series, by, value, lags).join(few_of(whole), by)
    number = lambda c: c.cast("decimal(38,0)" if exact else "double")
    n, s, ss, m, xy, sa, sb = (number(F.col(c)) for c in ("n", "s", "ss", "m", "xy", "sa", "sb"))
    c = number(F.floor(s / n)) if exact else F.lit(0.0)
    ss, xy, ab = number(ss - number(number(c + c) * s) + number(number(c * c) * n)), number(xy - number(c * number(sa + sb)) + number(number(c * c) * m)), number(number(sa + sb) - number(number(c + c) * m))
    s = number(s - number(c * n))
    d = {k: v.cast("double") for k, v in {"n": n, "s": s, "ss": ss, "m": m, "xy": xy, "ab": ab}.items()}
    mean = d["s"] / d["n"]
    top, bottom = d["xy"] - mean * d["ab"] + d["m"] * mean * mean, d["ss"] - mean * d["s"]
    r = F.when(bottom <= 0, F.lit(0.0)).otherwise(top / bottom)
    if exact:
        times, less, plus = F.try_multiply, F.try_subtract, F.try_add
        over = plus(less(times(number(n * n), xy), times(number(n * s), ab)), times(m, number(s * s)))
        under = times(n, less(times(n, ss), number(s * s)))
        r = F.coalesce(F.when(under == 0, F.lit(0.0)).otherwise(over.cast("double") / under.cast("double")), r)
    return joined.select(*by, "lag", F.col("n").alias("sample_count"), clamp(r, -1.0, 1.0, ACF_TOLERANCE, "autocorrelation").alias("acf"))


def features(trace: DataFrame, gaps: DataFrame, by: list[str]) -> DataFrame:
    """The series of both features: inter-arrival times and lengths, whole numbers if times are in microseconds."""
    time = _time(gaps)
    size = trace.select(*by, F.lit("size").alias("feature"), "seq", F.col("frame_length").cast("bigint" if time == "iat_us" else "double").alias("x"))
    return gaps.select(*by, F.lit("iat").alias("feature"), "seq", F.col(time).alias("x")).unionByName(size)


def acf_table(reference: DataFrame, generated: DataFrame, reference_gaps: DataFrame, generated_gaps: DataFrame, lags) -> DataFrame:
    """Per comparison, feature and lag: both autocorrelations."""
    alone, of = _alone(generated), _of(generated)
    ours = autocorrelations(features(reference, reference_gaps, of), [*of, "feature"], "x", list(lags), few=not of)
    generated, generated_gaps = _named(generated), _named(generated_gaps)
    theirs = autocorrelations(features(generated, generated_gaps, [*of, "comparison"]), [*of, "comparison", "feature"], "x", list(lags), few=alone)
    ours = ours.select(*of, "feature", "lag", F.col("acf").alias("reference_acf"))
    return theirs.select(*of, "comparison", "feature", "lag", F.col("acf").alias("generated_acf")).join(ours if of else F.broadcast(ours), [*of, "feature", "lag"])


def _at(map_column: Column, keys, weights) -> Column:
    """The fixed-order weighted sum of a map's values; null where a key is absent."""
    total = F.lit(0.0)
    for k, w in zip(keys, weights, strict=True):
        total = total + F.lit(float(w)) * F.element_at(map_column, F.lit(k))
    return total


def acf_score(table: DataFrame, s: Settings) -> DataFrame:
    gap, keys = F.abs(F.col("reference_acf") - F.col("generated_acf")) / 2, _keys(table)
    per = table.groupBy(*keys, "feature").agg(F.map_from_entries(F.collect_list(F.struct("lag", gap))).alias("gaps"))
    per = per.select(*keys, "feature", _at(F.col("gaps"), s.lags, s.lag_weights).alias("d"))
    of = lambda feature: F.coalesce(F.max(F.when(F.col("feature") == feature, F.col("d"))), missing(keys, "autocorrelation"))
    whole = per.groupBy(*keys).agg(of("iat").alias("iat"), of("size").alias("size"))
    d = clamp(F.lit(s.iat_weight) * F.col("iat") + F.lit(s.size_weight) * F.col("size"), 0.0, 1.0, ACF_TOLERANCE, "autocorrelation discrepancy")
    return whole.select(*keys, F.col("iat").alias("iat_discrepancy"), F.col("size").alias("size_discrepancy"), (1 - d).alias("score"))


# Multiscale rates


def rate_cells(trace: DataFrame, window: float, widths, max_cells: int, by: list[str]) -> DataFrame:
    """Packets and exact bytes per (by, scale, direction, bin)."""
    counts = bin_counts(window, widths, max_cells)
    return cells_of(trace, by, [(F.lit(float(w)), F.lit(b)) for w, b in zip(widths, counts, strict=True)])


def cells_of(trace: DataFrame, by: list[str], scales: list[tuple[Column, Column]]) -> DataFrame:
    """The same for scales as (width, bins), which may be columns. Each row is expanded by the few scales, then pre-aggregated."""
    expanded = F.array(*(F.struct(F.lit(i).alias("scale"), w.alias("width"), b.cast("bigint").alias("bins")) for i, (w, b) in enumerate(scales)))
    rows = trace.select(*by, "ts", "direction", "frame_length", F.explode(expanded).alias("k"))
    place = F.least(F.floor(snap(F.col("ts") / F.col("k.width"))), F.col("k.bins") - 1).cast("bigint")
    return rows.groupBy(*by, F.col("k.scale").alias("scale"), "direction", place.alias("bin")).agg(
        F.count("*").alias("packets"), F.sum(F.col("frame_length").cast("decimal(20,0)")).alias("bytes")
    )


def scale_discrepancies(reference: DataFrame, generated: DataFrame, window: float, widths, max_cells: int) -> DataFrame:
    """Per comparison and scale: packet and byte discrepancy. Absent cells count as 0, so no dense grid is made."""
    ours = rate_cells(reference, window, widths, max_cells, [])
    return cell_discrepancies(ours, rate_cells(_named(generated), window, widths, max_cells, ["comparison"]))


def cell_discrepancies(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Per comparison and scale, the normalized L1 distance |a - b| / (a + b) over the cells of either side.

    A cell that only the reference has adds a: so the sum is the reference's total plus |a - b| - a over a comparison's own
    cells. Those alone are looked up; the reference is shuffled once, however many comparisons there are.
    """
    of = _of(theirs)
    a, b = ours.alias("a"), theirs.alias("b")
    keys = [*of, "scale", "direction", "bin"]
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    cells = b.join(a, on, "left").select(
        *(F.col(f"b.{c}") for c in (*of, "comparison", "scale")), *(F.coalesce(F.col(f"{side}.{c}").cast("decimal(30,0)"), F.lit(0).cast("decimal(30,0)")).alias(f"{c}_{side}") for c in ("packets", "bytes") for side in ("a", "b"))
    )
    more = lambda c: F.sum(F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")) - F.col(f"{c}_a"))
    own = cells.groupBy(*of, "comparison", "scale").agg(*(e for c in ("packets", "bytes") for e in (more(c).alias(f"{c}_gap"), F.sum(f"{c}_b").alias(f"{c}_sum"))))
    whole = ours.groupBy(*of, "scale").agg(*(F.sum(F.col(c).cast("decimal(30,0)")).alias(f"{c}_whole") for c in ("packets", "bytes")))
    found = own.join(whole if of else F.broadcast(whole), [*of, "scale"])  # without references of their own: a row per scale

    def share(c: str) -> Column:
        total = F.col(f"{c}_whole") + F.col(f"{c}_sum")
        return F.when(total == 0, F.lit(0.0)).otherwise((F.col(f"{c}_whole") + F.col(f"{c}_gap")).cast("double") / total.cast("double"))

    return found.select(*of, "comparison", "scale", share("packets").alias("packet"), share("bytes").alias("byte"))


def multiscale_score(table: DataFrame, s: Settings) -> DataFrame:
    """Features are summed over scales before feature weights apply."""
    keys, scales = _keys(table), range(len(s.widths))
    maps = table.groupBy(*keys).agg(*(F.map_from_entries(F.collect_list(F.struct("scale", c))).alias(c) for c in ("packet", "byte")))
    totals = maps.select(*keys, *(clamp(_at(F.col(c), scales, s.scale_weights), 0.0, 1.0, L1_TOLERANCE, c).alias(c) for c in ("packet", "byte")))
    d = clamp(F.lit(s.packet_weight) * F.col("packet") + F.lit(s.byte_weight) * F.col("byte"), 0.0, 1.0, L1_TOLERANCE, "multiscale discrepancy")
    return totals.select(*keys, F.col("packet").alias("packet_discrepancy"), F.col("byte").alias("byte_discrepancy"), (1 - d).alias("score"))


# All four


#: What a trace must have for each measure.
NEEDS = {
    "autocorrelation": "it needs more inter-arrival times than the longest lag",
    "frame_size_ks": "it needs an event",
    "iat_ks": "it needs two events",
    "multiscale_rate": "it needs an event",
}


def missing(keys: list[str], method: str) -> Column:
    """An error that names the comparison, the measure and what it needs."""
    return F.raise_error(F.concat(F.lit("comparison "), F.concat_ws(" with ", *keys), F.lit(f" has no {method}: {NEEDS[method]}"))).cast("double")


def united(found: dict[str, DataFrame], s: Settings) -> DataFrame:
    out = None
    for name in METHODS:
        rows = found[name].select(*_keys(found[name]), F.lit(name).alias("method"), "score", F.lit(float(s.method_weights[name])).alias("weight"))
        out = rows if out is None else out.unionByName(rows)
    return out


def compare(reference: DataFrame, generated: DataFrame, window: float, s: Settings) -> DataFrame:
    """(comparison, method, score, weight): all four, whatever their weights. Both frames must be aligned."""
    s.check(window)
    reference_gaps, generated_gaps = iats(reference).persist(), iats(generated).persist()
    return united(
        {
            "autocorrelation": acf_score(acf_table(reference, generated, reference_gaps, generated_gaps, s.lags), s),
            "frame_size_ks": frame_size_ks(reference, generated),
            "iat_ks": iat_ks(reference_gaps, generated_gaps, s.quantile),
            "multiscale_rate": multiscale_score(scale_discrepancies(reference, generated, window, s.widths, s.max_cells), s),
        },
        s,
    )


def compare_pairs(traces: DataFrame, pairs: DataFrame, s: Settings) -> DataFrame:
    """(reference, comparison, method, score, weight) for each row (reference, generated) of pairs, two ids of traces.

    Every reference has its own window, its span, so windows, widths and cells are columns, not literals, and all pairs
    are scored together. widths are shares of the window here. A generated trace is cut to each of its references' windows.
    """
    s.check(1.0)
    shifted, spans = normalize(traces)
    time = "ts_us" if "ts_us" in shifted.columns else "ts"
    gap = F.col(time) - F.col("__before")
    rows = lagged(shifted, "trace_id", {"__before": time}).withColumn("gap", gap if time == "ts" else gap.cast("bigint")).drop("__before").persist()
    pairs = pairs.select("reference", "generated").distinct()
    wanted = pairs.join(spans.withColumnRenamed("trace_id", "reference"), "reference")
    ours = join_few(rows.withColumnRenamed("trace_id", "reference"), wanted.select("reference", "w").distinct(), ["reference"])
    theirs = join_few(rows.withColumnRenamed("trace_id", "comparison"), wanted.withColumnRenamed("generated", "comparison"), ["comparison"]).where(F.col("ts") <= F.col("w"))
    name = "iat_us" if time == "ts_us" else "iat"
    gaps = lambda f: f.where("seq > 1").withColumn("seq", F.col("seq") - 1).withColumnRenamed("gap", name)
    scales = []
    for share in s.widths:
        width = F.col("w") * F.lit(float(share))
        scales.append((width, F.ceil(snap(F.col("w") / width))))
    return united(
        {
            "autocorrelation": acf_score(acf_table(ours, theirs, gaps(ours), gaps(theirs), s.lags), s),
            "frame_size_ks": frame_size_ks(ours, theirs),
            "iat_ks": iat_ks(gaps(ours), gaps(theirs), s.quantile),
            "multiscale_rate": multiscale_score(cell_discrepancies(cells_of(ours, ["reference"], scales), cells_of(theirs, ["reference", "comparison"], scales)), s),
        },
        s,
    )


def aggregate(scores: DataFrame) -> DataFrame:
    """Per comparison: the four scores and their weighted sum, in fixed order. A measure without a score is an error that names it."""
    keys = _keys(scores)
    by = scores.groupBy(*keys).agg(*(F.max(F.when(F.col("method") == m, F.col("score"))).alias(m) for m in METHODS), *(F.max(F.when(F.col("method") == m, F.col("weight"))).alias(f"w_{m}") for m in METHODS))
    by = by.select(*keys, *(F.coalesce(m, missing(keys, m)).alias(m) for m in METHODS), *(f"w_{m}" for m in METHODS))
    total = F.lit(0.0)
    for m in METHODS:
        total = total + F.col(f"w_{m}") * F.col(m)
    return by.select(*keys, *METHODS, clamp(total, 0.0, 1.0, WEIGHT_TOLERANCE, "aggregate").alias("aggregate_score"))


def symmetric_scores(scores: DataFrame) -> DataFrame:
    """(left, right, symmetric): the mean of both directions of aggregate's rows for pairs, each under its own window."""
    pair = scores.groupBy(F.least("reference", "comparison").alias("left"), F.greatest("reference", "comparison").alias("right"))
    return pair.agg(F.avg("aggregate_score").alias("symmetric"))


def symmetric_score(left: DataFrame, right: DataFrame, settings_for) -> float:
    """Mean of both directions, each under its own window; settings_for(window) gives the settings."""
    total = []
    for a, b in ((left, right), (right, left)):
        reference, _ = normalize(a)
        w = window_of(reference)
        total.append(aggregate(compare(reference, align(b, w), w, settings_for(w))).first().aggregate_score)
    return sum(total) / 2
