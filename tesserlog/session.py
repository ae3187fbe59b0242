"""Session defaults and settings with environment overrides."""

from __future__ import annotations

import logging
import os
from dataclasses import dataclass, field, fields
from logging.handlers import TimedRotatingFileHandler

from pyspark.sql import SparkSession


def session(app: str = "tesserlog", master: str | None = None) -> SparkSession:
    """The active session, else a new one with adaptive execution and UTC. Never stops a borrowed session."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    return (builder.master(master) if master else builder).getOrCreate()


@dataclass(frozen=True)
class Settings:
    """Every field may be overridden by an environment variable TESSERLOG_<NAME>."""

    base_path: str = "data"
    min_support: float = 0.005
    min_confidence: float = 0.5
    max_pattern_length: int = 20
    top_k_patterns: int = 50
    clusters: int = 8
    cluster_iterations: int = 20
    seed: int = 42
    trees: int = 100
    tree_samples: int = 256
    pot_q0: float = 0.90
    pot_risk: float = 0.01
    fallback_percentile: float = 97.0
    least_tail: int = 10
    alert_threshold: int = 2
    retrain_every: int = 24
    trigger_seconds: int = 10
    max_offsets: int = 50_000
    high_risk: tuple[str, ...] = field(default=("E9", "E11", "E26", "E14", "E21"))
    dropped_events: tuple[str, ...] = field(default=("E7", "E8", "E13", "E15"))

    @classmethod
    def load(cls) -> "Settings":
        given = {}
        for f in fields(cls):
            value = os.environ.get(f"TESSERLOG_{f.name.upper()}")
            if value is not None:
                default = f.default
                given[f.name] = tuple(value.split(",")) if isinstance(default, tuple) else type(default)(value)
        return cls(**given)


def logger(name: str, folder: str | None = None, days: int = 30) -> logging.Logger:
    """A logger of the engine; with a local folder also a file for each day, kept for so many days."""
    log = logging.getLogger(f"tesserlog.{name}")
    if folder and not any(isinstance(h, TimedRotatingFileHandler) for h in log.handlers):
        os.makedirs(folder, exist_ok=True)
        handler = TimedRotatingFileHandler(os.path.join(folder, f"{name}.log"), when="midnight", backupCount=days, utc=True)
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
        log.addHandler(handler)
        log.setLevel(logging.INFO)
    return log
