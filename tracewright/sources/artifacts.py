"""Files of a run: strict JSON, TOML, CSV and JSON-lines codecs, identities, and publishing that never overwrites.

These are small files of fixed shape, read and written by the driver; analytics over many of them go through Spark's
readers with the schemas below.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import os
import re
import tempfile
import tomllib
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.models import ESTIMATORS, SEEDS, restore

RUN_LOG = "event string, stage string, status string, detail string, generation bigint, seed bigint, elapsed_seconds double"
HISTORY = "generation int, scope string, family string, candidate_count int, valid_count int, best_fitness double, mean_fitness double, best_birth_generation int, best_birth_index int"
HISTORY_COLUMNS = tuple(c.split()[0] for c in HISTORY.split(", "))
# The outer keys of a model file.
BEST_MODEL_KEYS = frozenset(
    "version scientific_artifact_schema family genes fitted reference_identity capture_identity final_seed final_limits observation_window_seconds gene_bounds estimator_choices seed_policy".split()
)
MAC = re.compile(r"[0-9a-f]{2}(:[0-9a-f]{2}){5}")
SHA256 = re.compile(r"[0-9a-f]{64}")


def strict_json(content: bytes):
    """JSON without repeated keys or non-finite numbers."""

    def pairs(items):
        keys = [k for k, _ in items]
        if len(set(keys)) < len(keys):
            raise ValueError("repeated key in JSON")
        return dict(items)

    def refuse(word):
        raise ValueError(f"non-finite number in JSON: {word}")

    return json.loads(content, object_pairs_hook=pairs, parse_constant=refuse)


def canonical(value) -> bytes:
    return (json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False, ensure_ascii=False) + "\n").encode()


# Capture metadata


def unicast_mac(text: str) -> str:
    mac = text.lower()
    if not MAC.fullmatch(mac) or int(mac[:2], 16) & 1 or not int(mac.replace(":", ""), 16):
        raise ValueError("a target is a nonzero unicast MAC address")
    return mac


def capture_metadata(content: bytes) -> dict[str, str]:
    found = strict_json(content)
    if not isinstance(found, dict) or set(found) != {"interface", "target_mac"} or found["interface"] != "eth0" or not isinstance(found["target_mac"], str):
        raise ValueError("capture metadata has an interface, eth0, and a target_mac")
    return {"interface": "eth0", "target_mac": unicast_mac(found["target_mac"])}


def render_capture_metadata(mac: str) -> bytes:
    return (json.dumps({"interface": "eth0", "target_mac": unicast_mac(mac)}, indent=2) + "\n").encode()


# Identities


def identity(content: bytes) -> dict:
    return {"sha256": hashlib.sha256(content).hexdigest(), "size": len(content)}


def settings_identity(settings: dict) -> dict:
    return identity(json.dumps(settings, sort_keys=True, separators=(",", ":"), allow_nan=False).encode())


def content_identities(files: DataFrame) -> DataFrame:
    """Size and SHA-256 of many files, from binaryFile rows."""
    return files.select("path", F.octet_length("content").cast("bigint").alias("size"), F.sha2("content", 256).alias("sha256"))


def directory_identity(spark: SparkSession, path: str) -> dict:
    """One identity of all files below path, names included. Hashing is parallel; the inventory of names is the driver's."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = path.rstrip("/").removeprefix("file://")
    rows = [{"path": r.path.split(root, 1)[-1].lstrip("/"), "sha256": r.sha256, "size": r.size} for r in content_identities(files).collect()]
    return identity(canonical(sorted(rows, key=lambda r: r["path"])))


def first_difference(expected: dict, actual: dict, path: str = "") -> str | None:
    """Where two nested values first differ in keys, types or values."""
    if type(expected) is not type(actual):
        return path or "."
    if isinstance(expected, dict):
        for k in sorted(set(expected) | set(actual)):
            if k not in expected or k not in actual:
                return f"{path}.{k}"
            if (found := first_difference(expected[k], actual[k], f"{path}.{k}")) is not None:
                return found
        return None
    return None if expected == actual else path or "."


def lineage(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Artifacts whose identity isn't the expected one: changed, missing or foreign."""
    e = expected.select("name", F.col("size").alias("expected_size"), F.col("sha256").alias("expected_sha256"))
    a = actual.select("name", F.col("size").alias("actual_size"), F.col("sha256").alias("actual_sha256"))
    same = F.col("expected_size").eqNullSafe(F.col("actual_size")) & F.col("expected_sha256").eqNullSafe(F.col("actual_sha256"))
    state = F.when(F.col("actual_sha256").isNull(), "missing").when(F.col("expected_sha256").isNull(), "foreign").otherwise("changed")
    return e.join(a, "name", "full").where(~same).select("name", state.alias("problem"))


def exact_set(found: DataFrame, names: list[str]) -> DataFrame:
    """Names missing from, or foreign to, an exact set."""
    want = found.sparkSession.createDataFrame([(n,) for n in names], "name string")
    have = found.select("name").distinct()
    return want.exceptAll(have).withColumn("problem", F.lit("missing")).unionByName(have.exceptAll(want).withColumn("problem", F.lit("foreign")))


# Results, models, history and log


def comparison_bytes(result: dict) -> bytes:
    return canonical(result)


def parse_comparison(content: bytes) -> dict:
    found = strict_json(content)
    methods = found.get("methods", {}) if isinstance(found, dict) else {}
    if set(methods) != {"autocorrelation", "frame_size_ks", "iat_ks", "multiscale_rate"}:
        raise ValueError("a comparison has exactly the four methods")
    total = sum(methods[m]["weight"] * methods[m]["score"] for m in sorted(methods))
    if abs(total - found["aggregate_score"]) > 1e-12 or canonical(found) != content:
        raise ValueError("a comparison is canonical, and its aggregate the weighted sum")
    return found


def parse_best_model(content: bytes) -> dict:
    found = strict_json(content)
    if not isinstance(found, dict) or set(found) != BEST_MODEL_KEYS:
        raise ValueError("a model file has exactly its outer keys")
    if not SHA256.fullmatch(found["reference_identity"]["sha256"]) or not SHA256.fullmatch(found["capture_identity"]["sha256"]):
        raise ValueError("identities are SHA-256")
    if found["family"] not in ESTIMATORS or found["estimator_choices"] != ESTIMATORS[found["family"]] or found["seed_policy"] != SEEDS:
        raise ValueError("estimator choices and seed policy are those of the family")
    restore(found["family"], found["fitted"])
    return found


def render_best_model(model: dict) -> bytes:
    content = canonical(model)
    parse_best_model(content)
    return content


def history_csv(rows: list[dict]) -> bytes:
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(HISTORY_COLUMNS)
    for r in rows:
        writer.writerow("" if r[c] is None else repr(r[c]) if isinstance(r[c], float) else r[c] for c in HISTORY_COLUMNS)
    content = out.getvalue().encode()
    if parse_history_csv(content) != [{c: r[c] for c in HISTORY_COLUMNS} for r in rows]:
        raise ValueError("the history can't be read back")
    return content


def parse_history_csv(content: bytes) -> list[dict]:
    def value(column: str, text: str):
        if column in ("best_fitness", "mean_fitness"):
            return float(text)
        return (text or None) if column in ("scope", "family") else int(text)

    rows = list(csv.reader(io.StringIO(content.decode(), newline="")))
    if tuple(rows[0]) != HISTORY_COLUMNS:
        raise ValueError("a history has its nine columns")
    return [{c: value(c, t) for c, t in zip(HISTORY_COLUMNS, r, strict=True)} for r in rows[1:]]


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY).csv(path, header=True, mode="FAILFAST")


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_LOG).json(path, mode="FAILFAST")


def append_run_log(path: Path, entry: dict) -> None:
    if not {"event", "stage"} <= set(entry):
        raise ValueError("a log entry has an event and a stage")
    with open(path, "ab") as f:
        f.write(canonical(entry))
        f.flush()
        os.fsync(f.fileno())


def parse_run_log(content: bytes) -> list[dict]:
    return [strict_json(line) for line in content.splitlines()]


# Writing


def atomic_replace(path: Path, content: bytes, check: Callable[[bytes], object] = lambda b: None) -> None:
    """Write beside, check what was written, then take its name; other readers see the old file or the new one."""
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        check(Path(name).read_bytes())
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise
    folder = os.open(path.parent, os.O_RDONLY)
    try:
        os.fsync(folder)
    finally:
        os.close(folder)


def publish(path: Path, content: bytes, check: Callable[[bytes], object] = lambda b: None) -> bool:
    """True if written; False if the same bytes are there already; an error if others are."""
    if path.exists():
        if path.read_bytes() == content:
            return False
        raise FileExistsError(f"{path} holds something else")
    atomic_replace(path, content, check)
    return True


# TOML


def read_toml(path: Path) -> dict:
    return tomllib.loads(path.read_text())


def render_toml(value: dict, prefix: tuple[str, ...] = ()) -> str:
    """Plain tables, scalars and arrays, in their order."""

    def scalar(x) -> str:
        if isinstance(x, bool):
            return "true" if x else "false"
        if isinstance(x, str):
            return json.dumps(x, ensure_ascii=False)
        if isinstance(x, (list, tuple)):
            return "[" + ", ".join(map(scalar, x)) + "]"
        return repr(x)

    own = [f"{k} = {scalar(v)}" for k, v in value.items() if not isinstance(v, dict)]
    out = "\n".join(([f"[{'.'.join(prefix)}]"] if prefix else []) + own) + "\n"
    return out + "".join("\n" + render_toml(v, (*prefix, k)) for k, v in value.items() if isinstance(v, dict))


def schema_documents() -> dict[str, str]:
    """The schemas above as Spark JSON schemas, by name."""
    from pyspark.sql.types import StructType

    from ..operators.models import GENERATED
    from ..operators.traces import SCHEMA
    from .pcapng import PACKETS

    return {n: StructType.fromDDL(d).json() for n, d in {"run_log": RUN_LOG, "history": HISTORY, "trace": SCHEMA, "generated": GENERATED, "packets": PACKETS}.items()}
