"""Order-dependent operators that don't gather a trace in one task.

A trace's rows are numbered by seq from 1 without gaps. Rows belong to chunks of seq; a window over (trace, chunk)
sees a bounded number of rows, and what it needs from the neighbouring chunk comes as a halo: copies of that chunk's
rows at the border. One shuffle serves all lags, and one long trace is as parallel as many short ones.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 65536
#: Rows of a group that one sorted window may see.
DIRECT = 1_000_000


def numbered(rows: DataFrame, trace: str, order: str, seq: str = "seq", chunk: int = CHUNK) -> DataFrame:
    """rows with seq, the place by order in their trace. order is an integer; its ranges are counted first."""
    part = F.floor(F.col(order) / chunk)
    sizes = rows.groupBy(trace, part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(trace).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(trace, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    own = F.row_number().over(Window.partitionBy(trace, "__part").orderBy(order))
    return rows.withColumn("__part", part).join(starts, [trace, "__part"]).withColumn(seq, (F.col("__start") + own).cast("bigint")).drop("__part", "__start")


def in_chunks(rows: DataFrame, by: list[str], order: str, entry: list[str], size: int = 4096, chunk: int = CHUNK) -> DataFrame:
    """(by, chunk, first_rank, entries): each group's rows in ascending order, as arrays of at most size entries.

    The row of rank r, from 1, is entry (r - 1) % size of chunk (r - 1) // size, so any rank is found without reading the group.
    No task and no array grows with a group: ranks come from counts by ranges of order, an integer. Rows alike in order are in
    the order of their entries.
    """
    part = F.floor(F.col(order) / chunk)
    sizes = rows.groupBy(*by, part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*by, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    own = F.row_number().over(Window.partitionBy(*by, "__part").orderBy(order, *entry))
    ranked = rows.withColumn("__part", part).join(starts, [*by, "__part"]).withColumn("__rank", F.col("__start") + own)
    packed = ranked.groupBy(*by, F.floor((F.col("__rank") - 1) / size).alias("chunk"))
    listed = packed.agg(F.min("__rank").alias("first_rank"), F.array_sort(F.collect_list(F.struct("__rank", F.struct(*entry).alias("e")))).alias("__entries"))
    return listed.select(*by, "chunk", "first_rank", F.transform("__entries", lambda x: x["e"]).alias("entries"))


def entries_at(chunks: DataFrame, wanted: DataFrame, by: list[str], size: int = 4096) -> DataFrame:
    """wanted (by, rank) with the entry of each rank; ranks that a group doesn't have are left out."""
    place = wanted.withColumn("chunk", F.floor((F.col("rank") - 1) / size))
    found = place.join(chunks, [*by, "chunk"]).withColumn("entry", F.get("entries", (F.col("rank") - F.col("first_rank")).cast("int")))
    return found.where("entry IS NOT NULL").drop("chunk", "first_rank", "entries")


def join_few(rows: DataFrame, few: DataFrame, keys: list[str], most: int = 1_000_000) -> DataFrame:
    """rows with the columns of few, one row per key: broadcast if a count shows at most that many, else shuffled.

    Long traces are few, so a shuffle by trace would gather them; where traces are very many, each is short.
    """
    few = few.persist()
    return rows.join(F.broadcast(few) if few.limit(most + 1).count() <= most else few, keys)


def _chunked(rows: DataFrame, seq: str, chunk: int) -> tuple[DataFrame, Column]:
    at = F.col(seq) - 1
    return rows.withColumn("__chunk", F.floor(at / chunk)).withColumn("__own", F.lit(True)), F.pmod(at, F.lit(chunk))


def lagged(rows: DataFrame, trace: str, columns: dict[str, Column | str], seq: str = "seq", chunk: int = CHUNK) -> DataFrame:
    """rows with, for each name, the value of a column one row before in the trace (null in the first)."""
    own, place = _chunked(rows, seq, chunk)
    halo = own.where(place == chunk - 1).withColumn("__chunk", F.col("__chunk") + 1).withColumn("__own", F.lit(False))
    window = Window.partitionBy(trace, "__chunk").orderBy(seq)
    out = own.unionByName(halo)
    for name, column in columns.items():
        out = out.withColumn(name, F.lag(column).over(window))
    return out.where("__own").drop("__own", "__chunk")


def _led(series: DataFrame, by: list[str], value: str, lags: list[int], seq: str, chunk: int) -> DataFrame:
    """(by, __chunk, x, y1, y4, ...): each row's value and, for each lag, the value that many rows later (null past the end)."""
    most = max(lags)
    if most > chunk:
        raise ValueError("a lag is longer than a chunk")
    own, place = _chunked(series, seq, chunk)
    halo = own.where((place < most) & (F.col("__chunk") > 0)).withColumn("__chunk", F.col("__chunk") - 1).withColumn("__own", F.lit(False))
    window = Window.partitionBy(*by, "__chunk").orderBy(seq)
    rows = own.unionByName(halo).select(*by, "__chunk", "__own", F.col(value).alias("x"), *(F.lead(value, k).over(window).alias(f"y{k}") for k in lags))
    return rows.where("__own").drop("__own")


def lag_products(series: DataFrame, by: list[str], value: str, lags: list[int], seq: str = "seq", chunk: int = CHUNK) -> DataFrame:
    """Per series and lag: pairs, sums of products, of first and of second members.

    Sums of an integer value are exact decimals, those of a double are doubles. Series shorter than a lag have no row for it.
    """
    if whole_numbers(series, value):
        return lag_sums(series, by, value, lags, seq, chunk).drop("n", "s", "ss")
    rows = _led(series, by, value, lags, seq, chunk)
    pairs = rows.select(*by, "x", F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"y{k}").alias("y")) for k in lags))).alias("p"))
    kind = "double" if series.schema[value].dataType.typeName() == "double" else "decimal(19,0)"
    x, y = F.col("x").cast(kind), F.col("p.y").cast(kind)
    return pairs.where("p.y is not null").groupBy(*by, F.col("p.lag").alias("lag")).agg(
        F.count("*").alias("m"), F.sum(x * y).alias("xy"), F.sum(x).alias("sa"), F.sum(y).alias("sb")
    )


def whole_numbers(series: DataFrame, value: str) -> bool:
    return series.schema[value].dataType.typeName() in ("byte", "short", "integer", "long")


#: Bits of a digit, and of the lower half of a value whose sum is taken: sums over a chunk then fit a long.
DIGIT, HALF = 21, 32


def lag_sums(series: DataFrame, by: list[str], value: str, lags: list[int], seq: str = "seq", chunk: int = CHUNK) -> DataFrame:
    """lag_products of a whole number with the series' own count n, sum s and sum of squares ss (those of lag 0), all exact, in one pass.

    Values are cut into three digits of 21 bits, so that products are summed as longs within a chunk; only the chunks'
    sums are decimals.
    """
    if chunk > CHUNK:
        raise ValueError("sums over a longer chunk may not fit a long")
    digits = lambda c: (c.bitwiseAND((1 << DIGIT) - 1), F.shiftright(c, DIGIT).bitwiseAND((1 << DIGIT) - 1), F.shiftright(c, 2 * DIGIT))
    halves = lambda name, c: [F.sum(c.bitwiseAND((1 << HALF) - 1)).alias(f"{name}_0"), F.sum(F.shiftright(c, HALF)).alias(f"{name}_1")]
    rows = _led(series, by, value, lags, seq, chunk)
    pairs = rows.select(*by, "__chunk", "x", F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"y{k}" if k else "x").alias("y")) for k in (0, *lags)))).alias("p"))
    pairs = pairs.where("p.y is not null or p.lag = 0")
    x, y = F.col("x").cast("bigint"), F.col("p.y").cast("bigint")
    (l, m, h), (r, q, p) = digits(x), digits(y)
    products = [F.sum(t).alias(f"xy_{i}") for i, t in enumerate((l * r, m * r + l * q, h * r + m * q + l * p, h * q + m * p, h * p))]
    sums = pairs.groupBy(*by, F.col("p.lag").alias("lag"), "__chunk").agg(F.count("*").alias("m"), *products, *halves("sa", x), *halves("sb", y))

    def joined(name: str, parts: int, bits: int) -> Column:
        total = F.sum(F.col(f"{name}_0").cast("decimal(20,0)")).cast("decimal(38,0)")
        for i in range(1, parts):
            total = (total + F.sum((F.col(f"{name}_{i}").cast("decimal(20,0)") * F.lit(Decimal(1 << bits * i))).cast("decimal(38,0)"))).cast("decimal(38,0)")
        return total.alias(name)

    found = sums.groupBy(*by, "lag").agg(F.sum("m").alias("m"), joined("xy", 5, DIGIT), joined("sa", 2, HALF), joined("sb", 2, HALF))
    own = lambda c: F.max(F.when(F.col("lag") == 0, F.col(c))).over(Window.partitionBy(*by))
    return found.select("*", own("m").alias("n"), own("sa").alias("s"), own("xy").alias("ss")).where("lag > 0")


def running_totals(rows: DataFrame, by: list[str], order: str, values: list[str], ranges: int = 256, direct: int = DIRECT) -> DataFrame:
    """rows with, of each value, the inclusive running total in ascending order within by (total_) and the group's total (whole_).

    Where a count shows that no group has more than ``direct`` rows, a window per group does, in one shuffle. Else the groups that do are cut where approximate quantiles of order lie, so an outlier or a crowd of near values doesn't fill a part;
    totals of the parts before a row's own part are added to those within it. rows is read three times, so it is kept.
    Groups of so many rows are few, so their limits are broadcast: a shuffle by group would gather a long one in a task.
    """
    rows = rows.persist()
    counts, group = rows.groupBy(*by).count(), Window.partitionBy(*by)
    if (counts.agg(F.max("count")).first()[0] or 0) <= direct:
        upto = group.orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
        return rows.select("*", *(F.sum(v).over(upto).alias(f"total_{v}") for v in values), *(F.sum(v).over(group).alias(f"whole_{v}") for v in values))
    long = rows.join(F.broadcast(counts.where(F.col("count") > direct)), by, "left_semi") if by else rows
    step = max(1, math.isqrt(ranges))
    limits = F.percentile_approx(order, [i / ranges for i in range(1, max(2, ranges))], 100 * ranges)
    spans = F.broadcast(long.groupBy(*by).agg(limits.alias("__limits")).withColumn("__steps", F.filter("__limits", lambda x, i: i % step == step - 1)))
    # limits below a value: whole steps of them, then those of the next step
    below = lambda limits: F.size(F.filter(limits, lambda x: x < F.col(order)))
    cut = (rows.join(spans, by, "left") if by else rows.crossJoin(spans)).withColumn("__part", below(F.col("__steps")) * step)
    part = F.col("__part") + below(F.slice("__limits", F.col("__part") + 1, F.lit(step)))
    cut = cut.withColumn("__part", F.when(F.col("__limits").isNull(), 0).otherwise(part)).drop("__limits", "__steps")
    before = group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*by, "__part").agg(*(F.sum(v).alias(f"__{v}") for v in values))
    totals = totals.select(*by, "__part", *(F.coalesce(F.sum(f"__{v}").over(before), F.lit(0)).alias(f"__{v}") for v in values), *(F.sum(f"__{v}").over(group).alias(f"whole_{v}") for v in values))
    within = Window.partitionBy(*by, "__part").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    summed = cut.join(totals, [*by, "__part"])
    for v in values:
        summed = summed.withColumn(f"total_{v}", F.col(f"__{v}") + F.sum(v).over(within))
    return summed.drop("__part", *(f"__{v}" for v in values))


def order_figures(samples: DataFrame, by: list[str], value: str, q: float) -> DataFrame:
    """Per by: count, minimum, median, nearest-rank quantile, maximum and zeros of a sample's values that aren't null.

    Values are counted first; ranks are running totals of the counts, so no task holds a sample's distinct values. Rows without
    a by are left out.
    """
    for c in (value, *by):
        samples = samples.where(F.col(c).isNotNull())
    counts = samples.groupBy(*by, F.col(value).alias("x")).agg(F.count("*").alias("n"))
    size = F.col("whole_n")
    at = lambda rank: F.min(F.when(F.col("total_n") >= rank, F.col("x")))
    return running_totals(counts, by, "x", ["n"]).groupBy(*by).agg(
        F.max(size).alias("count"), F.min("x").alias("minimum"),
        ((at(F.floor((size + 1) / 2)) + at(F.floor(size / 2) + 1)) / 2).cast("double").alias("median"),
        at(F.ceil(F.lit(q) * size)).cast("double").alias("quantile"), F.max("x").alias("maximum"),
        F.coalesce(F.sum(F.when(F.col("x") == 0, F.col("n"))), F.lit(0)).cast("bigint").alias("zeros"),
    )
