"""The experiment file: strict sections, their bounds, and the rules across them."""

from __future__ import annotations

import math
from dataclasses import dataclass
from pathlib import Path

from ..operators.models import GENES, Limits
from ..operators.similarity import METHODS, Settings, valid_weights
from ..sources.artifacts import read_toml, render_toml
from ..sources.headers import is_url
from .genetic import Operators, Search

# The sections and keys of an experiment file.
SECTIONS = {
    "run": {"directory": str, "minimum_free_bytes": int, "master_seed": int, "final_seed": int},
    "target": {"image": str, "argv": list, "working_directory": str, "mounts": list, "environment": dict},
    "capture": {"image": str, "network_probe_url": str, "readiness_timeout_seconds": float, "workload_timeout_seconds": float, "flush_timeout_seconds": float, "total_timeout_seconds": float},
    "generation": {"trial": dict, "final": dict},
    "genetic": {
        "population_size": int, "generation_count": int, "tournament_size": int, "elite_count": int, "trial_seeds": list,
        "duplicate_mutation_attempts": int, "early_stopping_generations": int, "early_stopping_tolerance": float, "resume": bool,
    },
    "models": {"enabled": list},
    "similarity": {
        "iat_diagnostic_quantile": float, "acf_lags": list, "acf_lag_weights": list, "acf_iat_weight": float, "acf_size_weight": float,
        "multiscale_widths_seconds": list, "multiscale_scale_weights": list, "multiscale_packet_weight": float, "multiscale_byte_weight": float,
        "max_direction_bin_cells": int, "method_weights": dict,
    },
}
LIMITS = {"max_packets": int, "max_output_bytes": int, "max_wall_seconds": float}


class ConfigError(ValueError):
    pass


def _typed(section: str, values: dict, keys: dict[str, type], more: bool = False) -> None:
    unknown, missing = set(values) - set(keys), set(keys) - set(values)
    if missing or (unknown and not more):
        raise ConfigError(f"[{section}]: missing {sorted(missing)}, unknown {sorted(unknown)}")
    for k, kind in keys.items():
        v = values[k]
        if type(v) is not kind or kind is float and not math.isfinite(v):
            raise ConfigError(f"[{section}] {k} must be a {kind.__name__}")


@dataclass(frozen=True)
class Experiment:
    document: dict

    @property
    def seeds(self) -> tuple[int, ...]:
        return tuple(self.document["genetic"]["trial_seeds"])

    def limits(self, which: str) -> Limits:
        return Limits(**self.document["generation"][which])

    def similarity(self) -> Settings:
        s = self.document["similarity"]
        return Settings(
            lags=tuple(s["acf_lags"]), lag_weights=tuple(s["acf_lag_weights"]), iat_weight=s["acf_iat_weight"], size_weight=s["acf_size_weight"],
            widths=tuple(s["multiscale_widths_seconds"]), scale_weights=tuple(s["multiscale_scale_weights"]), packet_weight=s["multiscale_packet_weight"],
            byte_weight=s["multiscale_byte_weight"], max_cells=s["max_direction_bin_cells"], quantile=s["iat_diagnostic_quantile"], method_weights=dict(s["method_weights"]),
        )

    def search(self) -> Search:
        g, models = self.document["genetic"], self.document["models"]
        bounds = {f: {n: (models[f][n]["lower"], models[f][n]["upper"]) for n, _ in GENES[f]} for f in models["enabled"]}
        ops = {f: Operators(models[f]["crossover_probability"], models[f]["mutation_probability"], models[f]["mutation_scale"]) for f in models["enabled"]}
        return Search(
            bounds, ops, g["population_size"], g["generation_count"], g["tournament_size"], g["elite_count"], self.seeds, self.document["run"]["master_seed"],
            self.document["run"]["final_seed"], g["duplicate_mutation_attempts"], g["early_stopping_generations"], g["early_stopping_tolerance"], self.limits("trial"),
        )


def check(document: dict) -> Experiment:
    """The experiment, if every section and every rule across sections holds."""
    if set(document) != set(SECTIONS):
        raise ConfigError(f"an experiment has the sections {sorted(SECTIONS)}")
    for name, keys in SECTIONS.items():
        _typed(name, document[name], keys, more=name == "models")
    for which in ("trial", "final"):
        _typed(f"generation.{which}", document["generation"][which], LIMITS)
        if min(document["generation"][which].values()) <= 0:
            raise ConfigError("limits are positive")
    run, capture, genetic, models, similarity = (document[k] for k in ("run", "capture", "genetic", "models", "similarity"))
    if run["minimum_free_bytes"] < 1 or run["master_seed"] < 0 or run["final_seed"] < 0:
        raise ConfigError("[run]: seeds aren't negative, free bytes are positive")
    if not is_url(capture["network_probe_url"]):
        raise ConfigError("[capture] network_probe_url must name a DNS host over http or https")
    times = [capture[f"{k}_timeout_seconds"] for k in ("readiness", "workload", "flush", "total")]
    if min(times) <= 0 or times[3] < max(times[:3]):
        raise ConfigError("[capture]: timeouts are positive, and the total the longest")
    enabled = models["enabled"]
    if not enabled or len(set(enabled)) < len(enabled) or not set(enabled) <= set(GENES) or set(models) - {"enabled"} != set(enabled):
        raise ConfigError("[models]: exactly the enabled, known families have a table")
    for f in enabled:
        table, genes = models[f], dict(GENES[f])
        _typed(f"models.{f}", table, {"crossover_probability": float, "mutation_probability": float, "mutation_scale": float} | dict.fromkeys(genes, dict))
        if not all(0 <= table[p] <= 1 for p in ("crossover_probability", "mutation_probability")) or table["mutation_scale"] <= 0:
            raise ConfigError(f"[models.{f}]: probabilities and a positive scale")
        for n, kind in genes.items():
            _typed(f"models.{f}.{n}", table[n], dict.fromkeys(("lower", "upper"), int if kind == "integer" else float))
            low, high = table[n]["lower"], table[n]["upper"]
            if not low < high or kind == "log" and low <= 0 or kind == "integer" and low < 1 or n in ("q1", "q2") and not 0 < low < high < 1:
                raise ConfigError(f"[models.{f}.{n}]: bounds in order and in range")
    _typed("similarity.method_weights", similarity["method_weights"], dict.fromkeys(METHODS, float))
    trial, final = document["generation"]["trial"], document["generation"]["final"]
    if any(final[k] < trial[k] for k in LIMITS):
        raise ConfigError("final limits are no smaller than trial limits")
    experiment = Experiment(document)
    s = experiment.similarity()
    try:
        for w, n in ((s.lag_weights, len(s.lags)), (s.scale_weights, len(s.widths)), ((s.iat_weight, s.size_weight), 2), ((s.packet_weight, s.byte_weight), 2), (list(s.method_weights.values()), 4)):
            valid_weights(w, n)
        experiment.search()
    except ValueError as e:
        raise ConfigError(str(e)) from e
    if genetic["generation_count"] < 0 or genetic["duplicate_mutation_attempts"] < 0 or genetic["early_stopping_generations"] < 0 or genetic["early_stopping_tolerance"] < 0:
        raise ConfigError("[genetic]: counts and tolerance aren't negative")
    return experiment


def load(path: Path) -> Experiment:
    """The experiment of a file, its relative paths made absolute beside it."""
    document = read_toml(path)
    experiment = check(document)
    return Experiment(document | {"run": document["run"] | {"directory": str((path.parent / document["run"]["directory"]).resolve())}}) if experiment else experiment


def render(experiment: Experiment) -> bytes:
    return render_toml(experiment.document).encode()
