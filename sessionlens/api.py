"""The public entry points: folders in, DataFrames out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.catalogue import ScanConfig
from .operators import audit, drift, provenance, rollups
from .operators.detectors import Sessions, detect
from .session import configure
from .sources.logs import list_logs, read_records, wire_frames
from .sources.tables import read_registry
from .sources.trees import read_trees


def read_sessions(
    spark: SparkSession, folder: str, pattern: str = "*.jsonl", tail_cap_bytes: int | None = None,
    config: ScanConfig = ScanConfig(),
) -> Sessions:
    """The logs of a folder, ready for the operators."""
    records = read_records(configure(spark), folder, pattern, tail_cap_bytes)
    return Sessions(wire_frames(records), config)


def list_sessions(spark: SparkSession, folder: str, limit: int = 10) -> DataFrame:
    """The newest logs by name."""
    return rollups.newest_sessions(list_logs(read_records(configure(spark), folder)), limit)


def analyze_session(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """All findings of one log, worst first."""
    found = detect(read_sessions(spark, folder, f"{name}.jsonl"))
    return found.orderBy(F.desc("severity"), F.coalesce("seq", F.lit(0)))


def gate_status(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Frames of one log the gate stopped."""
    return rollups.blocked_records(read_sessions(spark, folder, f"{name}.jsonl").frames)


def watch_drift(spark: SparkSession, folder: str, server_key: Column | None = None) -> DataFrame:
    """Drift of every server whose logs are in the folder."""
    records = read_records(configure(spark), folder)
    sessions = Sessions(wire_frames(records)).stored()
    prints = drift.fingerprints(sessions, server_key, list_logs(records))
    return drift.drift(prints, drift.fingerprint_items(sessions))


def audit_servers(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Findings and scores of every source tree below the folder."""
    sources = read_trees(configure(spark), folder)
    found = audit.audit_findings(sources)
    return found, audit.scores(sources, found)


def check_dependencies(spark: SparkSession, folder: str, registry: str, as_of: str) -> DataFrame:
    """Provenance findings of every source tree against stored registry answers."""
    deps = provenance.manifest_deps(read_trees(configure(spark), folder))
    return provenance.provenance(deps, read_registry(spark, registry), F.lit(as_of).cast("timestamp"))
