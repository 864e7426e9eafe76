"""The stages of a run on files: fit, generate, compare, and all three. Each checks its inputs' identities again at its end.

Capturing live traffic is not part of the engine: a run begins with capture.json and reference.pcapng in its folder.
"""

from __future__ import annotations

from dataclasses import asdict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import Arrays
from ..operators import models, similarity, traces
from ..sources import artifacts, pcapng
from .config import Experiment
from .diagnostics import comparison, recheck
from .genetic import Engine, checkpoint, load_checkpoint

FILES = ("experiment.toml", "capture.json", "reference.pcapng", "checkpoint.json", "ga_history.csv", "best_model.json", "generated.pcapng", "similarity.json", "run.log")
# Fixed values of the model file.
VERSION, SCHEMA_VERSION = 1, 4


class Run:
    def __init__(self, spark: SparkSession, experiment: Experiment):
        self.spark, self.experiment = spark, experiment
        self.folder = Path(experiment.document["run"]["directory"])
        self.mac = artifacts.capture_metadata(self.bytes("capture.json"))["target_mac"]

    def bytes(self, name: str) -> bytes:
        return (self.folder / name).read_bytes()

    def log(self, stage: str, event: str, **more) -> None:
        artifacts.append_run_log(self.folder / "run.log", {"event": event, "stage": stage, **more})

    def unchanged(self, before: dict[str, dict]) -> None:
        for name, was in before.items():
            if artifacts.identity(self.bytes(name)) != was:
                raise ValueError(f"{name} changed during the stage")

    def inputs(self, *names: str) -> dict[str, dict]:
        return {n: artifacts.identity(self.bytes(n)) for n in names}

    def reference(self) -> tuple[DataFrame, float]:
        """The normalized reference and its window."""
        raw = pcapng.read_trace(self.spark, str(self.folder / "reference.pcapng"), self.mac)
        trace, _ = traces.normalize(raw.withColumn("trace_id", F.lit("reference")))
        w = traces.window_of(trace)
        traces.require_valid(trace, minimum=2, window=w, fitting=True)
        return trace, w

    def engine(self) -> Engine:
        trace, w = self.reference()
        return Engine(self.experiment.search(), Arrays.of(traces.to_events(trace)), w, self.experiment.similarity())

    def fit(self) -> dict:
        before = self.inputs("capture.json", "reference.pcapng")
        engine, path = self.engine(), self.folder / "checkpoint.json"
        resume = None
        if path.exists():
            if not self.experiment.document["genetic"]["resume"]:
                raise FileExistsError("a checkpoint exists and resuming is off")
            resume = load_checkpoint(path.read_bytes(), engine.search)

        def save(state) -> None:
            artifacts.atomic_replace(path, checkpoint(engine.search, state), lambda b: load_checkpoint(b, engine.search))
            artifacts.atomic_replace(self.folder / "ga_history.csv", artifacts.history_csv(list(state.history)), artifacts.parse_history_csv)

        state = engine.run(self.spark, resume, save)
        engine.final(self.spark, state)
        winner = next(c for c in state.population if c.birth == state.best)
        fitted = models.fit(winner.family, winner.genes, engine.reference, engine.window)
        model = {
            "version": VERSION, "scientific_artifact_schema": SCHEMA_VERSION, "family": winner.family, "genes": list(winner.genes), "fitted": models.payload(fitted),
            "reference_identity": before["reference.pcapng"], "capture_identity": before["capture.json"], "final_seed": engine.search.final_seed,
            "final_limits": asdict(self.experiment.limits("final")), "observation_window_seconds": engine.window,
            "gene_bounds": {n: {"lower": a, "upper": b} for n, (a, b) in engine.search.bounds[winner.family].items()},
            "estimator_choices": models.ESTIMATORS[winner.family], "seed_policy": models.SEEDS,
        }
        self.unchanged(before)
        artifacts.publish(self.folder / "best_model.json", artifacts.render_best_model(model), artifacts.parse_best_model)
        self.log("fit", "complete", detail=winner.family, generation=state.generation)
        return model

    def made(self) -> tuple[dict, bytes]:
        """The stored model, and the capture it gives: always the same bytes."""
        stored = artifacts.parse_best_model(self.bytes("best_model.json"))
        if stored["reference_identity"] != artifacts.identity(self.bytes("reference.pcapng")) or stored["capture_identity"] != artifacts.identity(self.bytes("capture.json")):
            raise ValueError("the model was fitted from another capture")
        model, w = models.restore(stored["family"], stored["fitted"]), stored["observation_window_seconds"]
        out = model.generate(stored["final_seed"], w, models.Limits(**stored["final_limits"]))
        if not out.complete:
            raise ValueError(f"final generation hit {out.reason}")
        return stored, pcapng.encode(out.events, self.mac, w)[0]

    def generate(self) -> bytes:
        before = self.inputs("capture.json", "reference.pcapng", "best_model.json")
        _, content = self.made()
        self.unchanged(before)
        artifacts.publish(self.folder / "generated.pcapng", content, pcapng.parse)
        self.log("generate", "complete")
        return content

    def compare(self) -> dict:
        before = self.inputs("capture.json", "reference.pcapng", "best_model.json", "generated.pcapng")
        _, content = self.made()
        if content != self.bytes("generated.pcapng"):
            raise ValueError("the generated capture isn't what the model gives")
        reference, w = self.reference()
        generated = traces.align(pcapng.read_trace(self.spark, str(self.folder / "generated.pcapng"), self.mac).withColumn("trace_id", F.lit("generated")), w)
        result = compare_frames(reference, generated, w, self.experiment.similarity())
        result["input_identities"] = {n.replace(".", "_"): v for n, v in before.items() if n != "best_model.json"} | {"similarity_settings": artifacts.settings_identity(self.experiment.document["similarity"])}
        self.unchanged(before)
        artifacts.publish(self.folder / "similarity.json", artifacts.comparison_bytes(result), artifacts.parse_comparison)
        self.log("compare", "complete")
        return result

    def all(self) -> dict:
        self.fit()
        self.generate()
        return self.compare()


def microseconds(trace: DataFrame) -> DataFrame:
    """A trace with ts_us, from times that are whole microseconds but for rounding."""
    return trace.withColumn("ts_us", F.rint(F.col("ts") * 1e6).cast("bigint"))


def compare_frames(reference: DataFrame, generated: DataFrame, w: float, settings: similarity.Settings) -> dict:
    """The record of two aligned traces."""
    result = comparison(microseconds(reference), microseconds(generated), w, settings)
    recheck(result)
    return result


def held_out(spark: SparkSession, model: dict, reference: DataFrame, frozen_identity: dict, identity: dict, settings: similarity.Settings, seed: int) -> dict:
    """A frozen model against a capture it was not fitted from, under that capture's window."""
    if identity == frozen_identity:
        raise ValueError("a held-out capture must differ from the training one")
    trace, _ = traces.normalize(reference)
    w = traces.window_of(trace)
    made = models.restore(model["family"], model["fitted"]).generate(seed, w, models.Limits(**model["final_limits"]))
    if not made.complete:
        raise ValueError(made.reason)
    return compare_frames(trace, traces.from_events(spark, "generated", made.events), w, settings)
