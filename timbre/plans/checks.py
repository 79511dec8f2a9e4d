"""Fail-closed assertions: a report is either built whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame


class ContractViolation(ValueError):
    """Inputs that break the contract of a report."""


def require_empty(rows: DataFrame, message: str, show: int = 5) -> None:
    """Raise with the first few rows if there are any."""
    found = rows.limit(show).collect()
    if found:
        raise ContractViolation(f"{message}: " + "; ".join(", ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in found))
