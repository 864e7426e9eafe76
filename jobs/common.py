"""What both jobs share: configuration files, the log, and a session for the command line."""

from __future__ import annotations

import logging
import tomllib
from pathlib import Path

from pyspark.sql import SparkSession

log = logging.getLogger("jobs")


def configuration(path: str | Path, defaults: dict) -> dict:
    """The values of a TOML file over the defaults; keys that aren't among them, and values of other types, are errors."""
    found = tomllib.loads(Path(path).read_text())
    for key, value in found.items():
        if key not in defaults:
            raise ValueError(f"{path}: unknown key {key}")
        if type(value) is not type(defaults[key]):
            raise ValueError(f"{path}: {key} must be of type {type(defaults[key]).__name__}")
    return defaults | found


def session(name: str) -> SparkSession:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return SparkSession.builder.appName(name).getOrCreate()
