"""Scores of candidate fixes: weighted criteria, impact, risk, deferral, recommendation classes. Expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.functions.scalars import clamp, literal_map, min_max, ratio, rounded

# Levels and weights.
LEVELS = {"low": 1.0, "medium": 2.0, "high": 3.0}
BASE_WEIGHTS = {"complexity": 0.2, "risk": 0.4, "impact": 0.4}
CRITERIA_WEIGHTS = {"impact": 0.40, "complexity": 0.25, "risk": 0.20, "dependency": 0.15, "model": 0.25}
SEVERITY_POINTS = {"critical": 1.0, "high": 0.85, "medium": 0.55, "low": 0.25}
RISK_BASE = {"low": 0.20, "medium": 0.50, "high": 0.80}
IMPACT_BASE = {"low": 0.30, "medium": 0.60, "high": 1.00}


def level(c: Column, default: float = 2.0) -> Column:
    return F.coalesce(F.try_element_at(literal_map(LEVELS), F.lower(c)), F.lit(default))


def base_score(complexity: Column, risk: Column, impact: Column, weights: dict[str, float] | None = None) -> Column:
    """Low complexity and risk and high impact score high, on the levels 1 to 3."""
    w = BASE_WEIGHTS | (weights or {})
    return w["complexity"] * (4 - level(complexity)) + w["risk"] * (4 - level(risk)) + w["impact"] * level(impact)


def impact_adjusted(score: Column, bonus: Column) -> Column:
    return score + 0.3 * F.coalesce(bonus, F.lit(0.0))


def model_adjusted(score: Column, confidence: Column, suitability: Column, quality: Column, risk: Column) -> Column:
    return score + 0.25 * F.coalesce(confidence, F.lit(0.0)) * F.coalesce(suitability + quality - risk, F.lit(0.0))


def criteria_score(complexity: Column, risk: Column, impact: Column, dependency: Column | None = None, weights: dict[str, float] | None = None) -> Column:
    """Weighted criteria on 0..1. dependency counts as clamped to 0..1; 0.5 without one."""
    w = CRITERIA_WEIGHTS | (weights or {})
    return (
        w["impact"] * min_max(level(impact))
        + w["complexity"] * min_max(4 - level(complexity))
        + w["risk"] * min_max(4 - level(risk))
        + w["dependency"] * (F.lit(0.5) if dependency is None else clamp(F.coalesce(dependency, F.lit(0.5))))
    )


def criteria_with_model(score: Column, confidence: Column, suitability: Column, quality: Column, risk: Column, weights: dict[str, float] | None = None) -> Column:
    """A criteria score moved by a model's judgement, in proportion to its confidence; without confidence the score stays."""
    weight = (CRITERIA_WEIGHTS | (weights or {}))["model"]
    judged = (clamp(suitability) + clamp(quality) + 1.0 - clamp(risk)) / 3
    return F.when(confidence > 0, clamp(score + (judged - 0.5) * 2 * clamp(confidence) * weight)).otherwise(score)


def magnitude(value: Column, limit: Column) -> Column:
    """How far a metric is over its limit, full at three times the limit; 0.5 if unknown."""
    return F.coalesce(clamp(ratio(value - limit, 2 * limit)), F.lit(0.5))


def reach(span: Column, lines: Column) -> Column:
    """The share of a file that an entity covers; 0.2 if unknown."""
    return F.coalesce(clamp(ratio(F.greatest(span, F.lit(0)), lines)), F.lit(0.2))


def severity_points(severity: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(SEVERITY_POINTS), F.lower(severity)), F.lit(SEVERITY_POINTS["low"]))


def band(rating: Column, default: Column | str = "medium") -> Column:
    """low, medium or high; others are the default."""
    low = F.lower(F.trim(rating))
    return F.when(low.isin("low", "medium", "high"), low).otherwise(F.lit(default) if isinstance(default, str) else default)


def base_of(rating: Column, base: dict[str, float]) -> Column:
    return F.element_at(literal_map(base), band(rating))


def quality_gain(severity: Column, size: Column, share: Column, impact: Column) -> Column:
    """Points that a fix may recover. impact: low, medium or high."""
    return 10 * severity_points(severity) * (0.4 + 0.6 * size) * (0.5 + 0.5 * share) * base_of(impact, IMPACT_BASE)


def risk_band(value: Column) -> Column:
    return F.when(value < 0.35, "low").when(value < 0.65, "medium").otherwise("high")


def change_risk(risk: Column, radius: Column, tested: Column) -> Column:
    """Grows by 0.15 for each further file that uses the entity, up to six, and by 0.35 without tests. With its band."""
    spread = 1 + 0.15 * F.least(F.greatest(radius - 1, F.lit(0)), F.lit(6))
    value = clamp(base_of(risk, RISK_BASE) * spread * F.when(F.coalesce(tested, F.lit(False)), 1.0).otherwise(1.35))
    return F.struct(rounded(value, 2).alias("value"), risk_band(value).alias("band"))


def deferral(potential: Column, churn: Column, severity: Column) -> Column:
    """(interest, pressure) of leaving a finding: what it is worth, times how often its file changes, times its urgency."""
    commits = F.greatest(F.coalesce(churn, F.lit(0)).cast("int"), F.lit(0))
    interest = rounded(potential * (1 + F.log1p(commits.cast("double"))) * severity_points(severity), 2)
    return F.struct(interest.alias("interest"), F.when(commits >= 10, "high").when(commits >= 3, "medium").otherwise("low").alias("pressure"))


def candidates(findings: DataFrame, catalogue: DataFrame, smell: str = "smell") -> DataFrame:
    """Findings with every catalogue row of their smell whose preconditions hold. A missing metric holds.

    catalogue: smell, refactoring, complexity, risk, impact, pos, preconditions array<struct<metric, least>>; findings: metrics map."""
    joined = findings.join(catalogue, smell)
    holds = F.forall("preconditions", lambda p: F.coalesce(F.try_element_at("metrics", p["metric"]) >= p["least"], F.lit(True)))
    return joined.filter(holds)
