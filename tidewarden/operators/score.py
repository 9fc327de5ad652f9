"""Scores and decisions as column expressions."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewarden.functions import patterns as fixed

#: Steepness, bucket weights and factors of the score models.
STEEPNESS = 2.0
INJECTION_WEIGHTS = {"intent": 0.45, "payload": 0.25, "hijack": 0.20, "anomaly": 0.10}
ANOMALY_WEIGHTS = {"payload": 0.70, "anomaly": 0.30}
ANOMALY_MOST = {"payload": 1.45, "anomaly": 1.30}
MITIGATION = 0.55
NON_REDUCIBLE = ["system_exfil", "unicode_bidi", "spam_noise"]
#: Factors of the security levels for thresholds, counts and floors.
LEVEL_FACTORS = {"high": (0.9, 0.9, 1.05), "medium": (1.3, 1.3, 0.85), "low": (1.6, 1.6, 0.7)}


def level_threshold(value: float, level: str) -> float:
    return min(1.0, value * LEVEL_FACTORS[level][0])


def level_count(value: int, level: str) -> int:
    return max(1, round(value * LEVEL_FACTORS[level][1]))


def level_floor(value: float, level: str) -> float:
    return min(1.0, value * LEVEL_FACTORS[level][2])


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def points_to_score(points: Column, most: float) -> Column:
    return clamp(points / F.lit(most)) if most > 0 else F.lit(0.0)


def weighted_score(features: Mapping[str, Column], weights: Mapping[str, float], k: float = STEEPNESS) -> Column:
    """1 - exp(-k * weighted mean), to six places."""
    total = sum(weights.values())
    raw = F.lit(0.0)
    for name, weight in weights.items():
        raw = raw + F.lit(weight / total) * clamp(features.get(name, F.lit(0.0)))
    return F.round(clamp(1 - F.exp(-k * clamp(raw))), 6)


def noisy_or(severities: list[tuple[Column, float]]) -> Column:
    """One less the product of (1 - severity) over the signals that are true."""
    rest = F.lit(1.0)
    for flag, severity in severities:
        rest = rest * F.when(flag, F.lit(1.0 - severity)).otherwise(F.lit(1.0))
    return F.least(F.lit(1.0), 1 - rest)


def injection_score(signals: Mapping[str, Column], discussion: Column | None = None) -> Column:
    """Score of injection signals (booleans by name), less in a discussion context."""
    buckets: dict[str, list[tuple[Column, float]]] = {}
    for name, flag in signals.items():
        bucket, severity = fixed.SIGNALS[name]
        buckets.setdefault(bucket, []).append((flag, severity / 10))
    score = weighted_score({b: noisy_or(v) for b, v in buckets.items()}, INJECTION_WEIGHTS)
    if discussion is None:
        return score
    fixed_class = F.lit(False)
    for name in NON_REDUCIBLE:
        if name in signals:
            fixed_class = fixed_class | signals[name]
    return F.when(discussion & ~fixed_class, F.round(score * MITIGATION, 6)).otherwise(score)


def anomaly_score(points: Mapping[str, Column]) -> Column:
    """Score of anomaly detectors (booleans by name)."""
    sums = {b: F.lit(0.0) for b in ANOMALY_WEIGHTS}
    for name, flag in points.items():
        bucket, value = fixed.POINTS[name]
        sums[bucket] = sums[bucket] + F.when(flag, F.lit(value)).otherwise(F.lit(0.0))
    return weighted_score({b: points_to_score(s, ANOMALY_MOST[b]) for b, s in sums.items()}, ANOMALY_WEIGHTS)


def action_floor(action: Column, discussion: Column) -> Column:
    """Least risk that an action brings; in a discussion an action counts as sanitizing."""
    soft = F.when(discussion & action.isin("block", "review", "downgrade", "sanitize"), F.lit("sanitize")).otherwise(action)
    return (
        F.when(soft == "block", F.lit(0.95))
        .when(soft.isin("review", "sanitize"), F.when(discussion, F.lit(0.58)).otherwise(F.lit(0.85)))
        .when(soft == "downgrade", F.when(discussion, F.lit(0.62)).otherwise(F.lit(0.82)))
        .otherwise(F.lit(0.0))
    )


def final_action(*dispositions: Column) -> Column:
    """Block before sanitize before allow."""
    held = F.array(*dispositions)
    return F.when(F.array_contains(held, "block"), "block").when(F.array_contains(held, "sanitize"), "sanitize").otherwise("allow")


def stable_id(*parts: Column) -> Column:
    """SHA-256 of the parts as JSON with names in order."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])), 256)


def noisy_or_rows(severity: Column) -> Column:
    """Aggregate: noisy-or of a column of severities."""
    certain = F.max(F.when(severity >= 1, 1).otherwise(0)) == 1
    return F.when(certain, F.lit(1.0)).otherwise(1 - F.exp(F.sum(F.ln(F.when(severity < 1, 1 - severity).otherwise(F.lit(1.0))))))


def score_of(points: float, k: float = STEEPNESS) -> float:
    """The plain form of ``weighted_score`` for one feature."""
    return round(1 - math.exp(-k * min(1.0, max(0.0, points))), 6)
