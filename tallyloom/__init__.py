"""Ledger cleaning, anomaly rules, enrichment and reporting as Spark DataFrame functions."""

from tallyloom.config import BATCH, INTERACTIVE, LedgerConfig
from tallyloom.session import build_session

__all__ = ["BATCH", "INTERACTIVE", "LedgerConfig", "build_session"]
