"""Analytics of recorded tool-call sessions on Spark."""

from .api import (
    analyze_session,
    audit_servers,
    check_dependencies,
    gate_status,
    list_sessions,
    read_sessions,
    watch_drift,
)
from .functions.catalogue import Pattern, ScanConfig
from .operators.detectors import DETECTORS, Sessions, detect

__all__ = [
    "DETECTORS", "Pattern", "ScanConfig", "Sessions", "analyze_session", "audit_servers",
    "check_dependencies", "detect", "gate_status", "list_sessions", "read_sessions", "watch_drift",
]
