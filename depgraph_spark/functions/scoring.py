"""Risk classes, severities and thresholds as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class limits and weights that results must agree on.
RISK_LIMITS = [("HIGH", 10), ("MEDIUM", 5), ("LOW", 1)]
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
COUPLING_FLOOR = 0.3
COUPLING_MEDIUM = 0.5
ACTION_WARN = 0.3
ACTION_BLOCK = 0.7
SCORE_LEVELS = [("CRITICAL", 0.8), ("HIGH", 0.6), ("MEDIUM", 0.4)]
SCORE_WEIGHTS = {"fan_in": 0.30, "stability": 0.20, "complexity": 0.20, "cascade": 0.15, "pagerank": 0.15}


def _ladder(value: Column, limits: list[tuple[str, float]], below: str) -> Column:
    out = F.lit(below)
    for label, limit in reversed(limits):
        out = F.when(value >= limit, F.lit(label)).otherwise(out)
    return out


def classify_risk(count: Column) -> Column:
    """Impacted-file count -> HIGH / MEDIUM / LOW / NONE."""
    return _ladder(count, RISK_LIMITS, "NONE")


def map_severity(risk: Column) -> Column:
    """Warning risk -> issue severity; null (no issue) for anything else."""
    return F.when(risk.isin(SEVERITIES), risk)


def hub_severity(importers: Column) -> Column:
    return F.when(importers >= 10, F.lit("HIGH")).otherwise(F.lit("MEDIUM"))


def coupling_percent(confidence: Column) -> Column:
    """Whole percent, halves rounded up."""
    return F.floor(confidence * 100 + 0.5).cast("bigint")


def coupling_severity(confidence: Column) -> Column:
    """MEDIUM / LOW, null below the floor (no issue)."""
    return F.when(confidence >= COUPLING_MEDIUM, F.lit("MEDIUM")).when(confidence >= COUPLING_FLOOR, F.lit("LOW"))


def risk_action(score: Column) -> Column:
    """Composite score -> proceed / warn / block."""
    return (
        F.when(score < ACTION_WARN, F.lit("proceed")).when(score <= ACTION_BLOCK, F.lit("warn")).otherwise(F.lit("block"))
    )


def score_level(score: Column) -> Column:
    return _ladder(score, SCORE_LEVELS, "LOW")
