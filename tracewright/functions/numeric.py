"""Scalar functions of the engine as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEIGHT_TOLERANCE = 1e-12
ACF_TOLERANCE = 1e-15
L1_TOLERANCE = 3e-12


def ulp(q: Column) -> Column:
    """Distance from a nonnegative double to the next larger one. log2 may round across a power of two; that is mended."""
    p = F.pow(F.lit(2.0), F.floor(F.log2(q)))
    exact = F.when(p > q, p / 2).when(p * 2 <= q, p * 2).otherwise(p)
    return F.when(q == 0, F.lit(5e-324)).otherwise(exact * F.pow(F.lit(2.0), F.lit(-52.0)))


def snap(q: Column) -> Column:
    """The nearest integer if q is within four ULPs of it, else q."""
    return F.when(F.abs(q - F.rint(q)) <= 4 * ulp(q), F.rint(q)).otherwise(q)


def clamp(x: Column, low: float, high: float, tolerance: float, name: str) -> Column:
    """x, moved into [low, high] if it misses by at most tolerance; an error beyond."""
    return (
        F.when(x.between(low, high), x)
        .when((x < low) & (x >= low - tolerance), F.lit(low))
        .when((x > high) & (x <= high + tolerance), F.lit(high))
        .otherwise(F.raise_error(F.lit(f"{name} outside [{low}, {high}]")).cast("double"))
    )


def microsecond_ticks(ts: Column) -> Column:
    """Whole microseconds of a time in seconds: floor, but the nearest if within four ULPs."""
    return F.floor(snap(ts * 1e6)).cast("bigint")


def encode_gene(kind: str, value: Column, low: Column, high: Column) -> Column:
    if kind == "log":
        return (F.ln(value) - F.ln(low)) / (F.ln(high) - F.ln(low))
    return (value - low) / (high - low)


def decode_gene(kind: str, z: Column, low: Column, high: Column) -> Column:
    inner = {
        "log": F.exp(F.ln(low) + z * (F.ln(high) - F.ln(low))),
        "linear": low + z * (high - low),
        "integer": low + F.floor(z * (high - low) + 0.5),
    }[kind]
    return F.when(z == 0, low).when(z == 1, high).otherwise(inner)


def reflect(z: Column) -> Column:
    """A coordinate folded back into [0, 1]."""
    r = F.pmod(z, F.lit(2.0))
    return F.when(r <= 1, r).otherwise(2 - r)


def mutate_gene(kind: str, value: Column, epsilon: Column, low: Column, high: Column) -> Column:
    return decode_gene(kind, reflect(encode_gene(kind, value, low, high) + epsilon), low, high)


def stationary_probability(q01: Column, q10: Column) -> Column:
    """Long-run probability of regime 0, scaled so that extreme rates don't overflow."""
    top = F.greatest(q01, q10)
    return (q10 / top) / (q01 / top + q10 / top)


def arrival_epoch_probability(q01: Column, q10: Column, lambda0: Column, lambda1: Column) -> Column:
    """Probability of regime 0 at an arrival, by log weights."""
    a, b = F.ln(q10) + F.ln(lambda0), F.ln(q01) + F.ln(lambda1)
    top = F.greatest(a, b)
    return F.exp(a - top) / (F.exp(a - top) + F.exp(b - top))


def timing_tier(support: Column, minimum: Column, source: Column) -> Column:
    return F.when(support >= minimum, "transition").when(source > 0, "source").otherwise("global")


def size_bin(length: Column, lower: Column, upper: Column) -> Column:
    return F.when(length <= lower, 0).when(length <= upper, 1).otherwise(2)


def quotas(size: Column, families: int, index: Column) -> Column:
    """Slots of the family at index in priority order."""
    return F.floor(size / families).cast("int") + (index < F.pmod(size, F.lit(families))).cast("int")


def repair_clamped(value: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(value, low), high)


def repair_sorted(a: Column, b: Column, low: tuple[Column, Column], high: tuple[Column, Column]) -> Column:
    """Struct of the pair sorted, then clamped each, and whether it is still in strict order."""
    x = repair_clamped(F.least(a, b), low[0], high[0])
    y = repair_clamped(F.greatest(a, b), low[1], high[1])
    return F.struct(x.alias("first"), y.alias("second"), (x < y).alias("valid"))


def round_half_up(value: Column) -> Column:
    return F.floor(value + 0.5)
