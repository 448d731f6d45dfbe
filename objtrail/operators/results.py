"""Envelope of a computed fact: a status, and rows only where it was computed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

COMPUTED, UNAVAILABLE, INVALID_INPUT = "computed", "unavailable", "invalid_input"
STATUSES = (COMPUTED, UNAVAILABLE, INVALID_INPUT)


@dataclass(frozen=True)
class ComputationResult:
    """What one operator says; a fact that could not be computed has a reason and no rows."""

    operator: str
    status: str
    rows: DataFrame | None = None
    reason: str | None = None
    assumptions: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.status not in STATUSES:
            raise ValueError(f"ComputationResult.status must be one of {', '.join(STATUSES)}")
        if (self.rows is not None) != (self.status == COMPUTED):
            raise ValueError("ComputationResult.rows must be there if and only if it was computed")
        if self.status != COMPUTED and not self.reason:
            raise ValueError("ComputationResult.reason must say why it was not computed")


def computed(operator: str, rows: DataFrame, *assumptions: str) -> ComputationResult:
    return ComputationResult(operator, COMPUTED, rows, None, assumptions)


def unavailable(operator: str, reason: str) -> ComputationResult:
    return ComputationResult(operator, UNAVAILABLE, None, reason)
