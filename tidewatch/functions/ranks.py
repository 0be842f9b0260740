"""Severity orderings and weights, and small numeric helpers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("critical", "high", "medium", "low", "info")
#: The orderings and weights of the scoring rules; fixed values, in the order of SEVERITIES.
RANK_4 = (4, 3, 2, 1, 0)
RANK_5 = (5, 4, 3, 2, 1)
WEIGHT_COUNTRY = (100, 70, 40, 15, 5)
WEIGHT_THREAT = (5.0, 3.0, 1.5, 0.5, 0.1)
WEIGHT_ESCALATION = (4, 3, 2, 1, 0)
SCORE_RISK = (40, 30, 18, 8, 2)
WEIGHT_FEED = (1.0, 0.7, 0.4, 0.15, 0.05)
CONFIDENCE_STIX = (95, 80, 60, 30, 15)
WEIGHT_HEAT = (4.0, 3.0, 2.0, 1.0, 0.5)


def by_severity(values: tuple, severity: Column | str = "severity", default=None) -> Column:
    """The value of a severity label; others get the default."""
    column = F.col(severity) if isinstance(severity, str) else severity
    out = None
    for label, value in zip(SEVERITIES, values, strict=True):
        out = F.when(column == label, value) if out is None else out.when(column == label, value)
    return out if default is None else out.otherwise(default)


def severity_of(rank: Column, values: tuple = RANK_4) -> Column:
    """The label of a rank."""
    out = None
    for label, value in zip(SEVERITIES, values, strict=True):
        out = F.when(rank == value, label) if out is None else out.when(rank == value, label)
    return out


def js_round(x: Column) -> Column:
    """Rounds half up, toward positive infinity."""
    return F.floor(x + 0.5)


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def ladder(x: Column, steps: list[tuple], default) -> Column:
    """The label of the first bound that x reaches."""
    out = None
    for bound, label in steps:
        out = F.when(x >= bound, label) if out is None else out.when(x >= bound, label)
    return out.otherwise(default)


def hours_before(as_of: Column, hours: float) -> Column:
    return as_of - F.expr(f"INTERVAL {int(hours * 3600)} SECONDS")


def hours_between(later: Column, earlier: Column) -> Column:
    """Hours from one timestamp to a later one, as a double."""
    return F.timestamp_diff("SECOND", earlier, later) / F.lit(3600.0)
