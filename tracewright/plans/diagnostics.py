"""The full record of one comparison: every figure its four scores come from, and a check that they agree.

Spark aggregates both traces to a few rows; the last sums over lags, scales and methods, in fixed order, are the driver's.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import similarity as S
from ..operators.traces import LABELS, iats

TOLERANCE = 1e-12


def _totals(trace: DataFrame) -> dict:
    rows = {r.direction: r for r in trace.groupBy("direction").agg(F.count("*").alias("p"), F.sum("frame_length").alias("b")).collect()}
    pick = lambda f: {n: int(getattr(rows[d], f)) if d in rows else 0 for d, n in enumerate(LABELS)}
    return {"packet": pick("p"), "byte": pick("b")}


def comparison(reference: DataFrame, generated: DataFrame, w: float, s: S.Settings) -> dict:
    """The record of two aligned traces with ts_us."""
    s.check(w)
    reference, generated = reference.persist(), generated.persist()
    gaps = iats(reference).persist(), iats(generated).persist()
    try:
        methods = {
            "autocorrelation": _acf(S.acf_table(reference, generated, *gaps, s.lags).collect(), (gaps[0].count(), gaps[1].count()), (reference.count(), generated.count()), w, s),
            "frame_size_ks": _size(S.frame_size_ks(reference, generated).first(), w),
            "iat_ks": _iat(S.iat_ks(*gaps, s.quantile).first(), w, s),
            "multiscale_rate": _multiscale(S.scale_discrepancies(reference, generated, w, s.widths, s.max_cells).collect(), _totals(reference), _totals(generated), w, s),
        }
    finally:
        for f in (reference, generated, *gaps):
            f.unpersist()
    for m, (score, d) in list(methods.items()):
        methods[m] = {"score": score, "weight": s.method_weights[m], "diagnostics": d}
    total = math.fsum(methods[m]["weight"] * methods[m]["score"] for m in S.METHODS)
    return {"aggregate_score": min(1.0, total), "observation_window_seconds": w, "methods": methods}


def _acf(rows, gap_counts, size_counts, w: float, s: S.Settings) -> tuple[float, dict]:
    d: dict = {"observation_window_seconds": w, "lags": list(s.lags), "lag_weights": list(s.lag_weights), "feature_weights": {"iat": s.iat_weight, "size": s.size_weight}}
    for feature, counts in (("iat", gap_counts), ("size", size_counts)):
        by = {r.lag: r for r in rows if r.feature == feature}
        if set(by) != set(s.lags):
            raise ValueError("every lag must be shorter than every sample")
        ours, theirs = [by[k].reference_acf for k in s.lags], [by[k].generated_acf for k in s.lags]
        gaps = [abs(a - b) for a, b in zip(ours, theirs, strict=True)]
        d[feature] = {
            "reference_acf": ours, "generated_acf": theirs, "absolute_differences": gaps, "reference_sample_count": counts[0], "generated_sample_count": counts[1],
            "discrepancy": math.fsum(x * g / 2 for x, g in zip(s.lag_weights, gaps, strict=True)),
        }
    d["discrepancy"] = math.fsum((s.iat_weight * d["iat"]["discrepancy"], s.size_weight * d["size"]["discrepancy"]))
    return 1 - d["discrepancy"], d


def _size(r, w: float) -> tuple[float, dict]:
    names = ("distance", "reference_count", "generated_count", "reference_minimum_length", "reference_maximum_length", "generated_minimum_length", "generated_maximum_length")
    return 1 - r.distance, {"observation_window_seconds": w} | {n: r[n] for n in names}


def _iat(r, w: float, s: S.Settings) -> tuple[float, dict]:
    d = {"observation_window_seconds": w, "diagnostic_quantile": s.quantile, "distance": r.distance}
    for side in ("reference", "generated"):
        d |= {
            f"{side}_iat_count": r[f"{side}_count"], f"{side}_median_iat_seconds": r[f"{side}_median"] / 1e6,
            f"{side}_quantile_iat_seconds": r[f"{side}_quantile"] / 1e6, f"{side}_zero_iat_count": r[f"{side}_zeros"],
        }
    return 1 - r.distance, d


def _multiscale(rows, ours: dict, theirs: dict, w: float, s: S.Settings) -> tuple[float, dict]:
    by, bins = {r.scale: r for r in rows}, S.bin_counts(w, s.widths, s.max_cells)
    weights, scales = {"packet": s.packet_weight, "byte": s.byte_weight}, []
    for i, width in enumerate(s.widths):
        own = {"packet": by[i].packet, "byte": by[i].byte}
        scales.append({
            "width_seconds": width, "bins_per_direction": bins[i], "direction_bin_cell_count": 2 * bins[i], "reference_totals": ours, "generated_totals": theirs,
            "feature_discrepancies": own, "discrepancy": math.fsum(weights[f] * own[f] for f in ("packet", "byte")),
        })
    features = {f: math.fsum(x * k["feature_discrepancies"][f] for x, k in zip(s.scale_weights, scales, strict=True)) for f in ("packet", "byte")}
    whole = math.fsum((s.packet_weight * features["packet"], s.byte_weight * features["byte"]))
    d = {
        "observation_window_seconds": w, "widths": list(s.widths), "scale_weights": list(s.scale_weights), "feature_weights": weights, "direction_bin_cell_counts": [2 * b for b in bins],
        "total_direction_bin_cells": 2 * sum(bins), "scales": scales, "scale_discrepancies": [k["discrepancy"] for k in scales], "feature_discrepancies": features, "discrepancy": whole,
    }
    return 1 - whole, d


def recheck(result: dict) -> None:
    """Recompute every derived figure of a record from those it rests on; an error where they differ."""

    def same(what: str, a: float, b: float) -> None:
        if not math.isfinite(a) or abs(a - b) > TOLERANCE:
            raise ValueError(f"{what}: {a} is not {b}")

    if set(result["methods"]) != set(S.METHODS):
        raise ValueError("a comparison has exactly the four methods")
    m = {k: v["diagnostics"] for k, v in result["methods"].items()}
    for name, v in result["methods"].items():
        d = m[name]
        same(f"{name} score", v["score"], 1 - d.get("distance", d.get("discrepancy")))
        same(f"{name} window", d["observation_window_seconds"], result["observation_window_seconds"])
    a = m["autocorrelation"]
    for f in ("iat", "size"):
        for x, y, g in zip(a[f]["reference_acf"], a[f]["generated_acf"], a[f]["absolute_differences"], strict=True):
            same(f"{f} difference", g, abs(x - y))
        same(f"{f} discrepancy", a[f]["discrepancy"], math.fsum(w * g / 2 for w, g in zip(a["lag_weights"], a[f]["absolute_differences"], strict=True)))
    same("autocorrelation discrepancy", a["discrepancy"], math.fsum(a["feature_weights"][f] * a[f]["discrepancy"] for f in ("iat", "size")))
    for k in ("frame_size_ks", "iat_ks"):
        n = "count" if k == "frame_size_ks" else "iat_count"
        if min(m[k][f"reference_{n}"], m[k][f"generated_{n}"]) < 1 or not 0 <= m[k]["distance"] <= 1:
            raise ValueError(f"{k}: counts are positive, distances in [0, 1]")
    r = m["multiscale_rate"]
    for k, cells, d in zip(r["scales"], r["direction_bin_cell_counts"], r["scale_discrepancies"], strict=True):
        same("scale", k["discrepancy"], math.fsum(r["feature_weights"][f] * k["feature_discrepancies"][f] for f in ("packet", "byte")))
        same("scale list", d, k["discrepancy"])
        if cells != 2 * k["bins_per_direction"]:
            raise ValueError("cells are two directions of bins")
    for f in ("packet", "byte"):
        same(f, r["feature_discrepancies"][f], math.fsum(w * k["feature_discrepancies"][f] for w, k in zip(r["scale_weights"], r["scales"], strict=True)))
    same("multiscale discrepancy", r["discrepancy"], math.fsum(r["feature_weights"][f] * r["feature_discrepancies"][f] for f in ("packet", "byte")))
    same("aggregate", result["aggregate_score"], min(1.0, math.fsum(result["methods"][k]["weight"] * result["methods"][k]["score"] for k in S.METHODS)))
