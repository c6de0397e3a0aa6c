"""Severity names, ranks and report levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings per rank; every other spelling ranks 1.
RANK3 = ("ERROR", "HIGH", "CRITICAL")
RANK2 = ("WARNING", "WARN", "MEDIUM")
RANK1 = ("INFO", "LOW", "NOTE")


def severity_rank(severity: Column) -> Column:
    name = F.upper(F.trim(severity))
    return (
        F.when(name.isin(*RANK3), 3).when(name.isin(*RANK2), 2).otherwise(1).cast("int")
    )


def parse_floor(level: str) -> int:
    """Rank of a minimum severity given by a user; unknown names are an error."""
    name = level.strip().upper()
    for rank, names in ((3, RANK3), (2, RANK2), (1, RANK1)):
        if name in names:
            return rank
    raise ValueError(f"unknown severity {level!r} (use error, warning or info)")


def report_level(severity: Column) -> Column:
    return (
        F.when(severity == "ERROR", "error")
        .when(severity == "WARNING", "warning")
        .otherwise("note")
    )


def security_score(severity: Column) -> Column:
    return (
        F.when(severity == "ERROR", "8.0").when(severity == "WARNING", "5.0").otherwise("3.0")
    )
