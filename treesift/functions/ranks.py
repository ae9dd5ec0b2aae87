"""Ordered enums as columns.  Unknown values rank lowest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("low", "medium", "high", "critical")
CONFIDENCES = ("low", "medium", "high")
DISPOSITIONS = ("informational", "harden", "review", "block")


def _rank(column: Column | str, values: tuple[str, ...]) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    out = None
    for i, v in enumerate(values[1:], 2):
        out = F.when(c == v, i) if out is None else out.when(c == v, i)
    return out.otherwise(1)


def severity_rank(column: Column | str = "severity") -> Column:
    return _rank(column, SEVERITIES)


def confidence_rank(column: Column | str = "confidence") -> Column:
    return _rank(column, CONFIDENCES)


def disposition_rank(column: Column | str = "disposition") -> Column:
    return _rank(column, DISPOSITIONS)


def severity_of(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), rank)
