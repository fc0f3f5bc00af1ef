"""Finance lakehouse work on Spark: ingest, conform, analyse, reconcile, classify."""

from ledgerloom.lake import Lake
from ledgerloom.session import session, tune

__all__ = ["Lake", "session", "tune"]
