"""The support score of a plan's steps: five weighted factors, gates before the score, and the plan's summary.

All are expressions over a step's columns, so a plan of any size is one pass. Every factor is on 0..1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.functions.scalars import clamp, literal_map, score_scale
from lintel.operators.scoring import IMPACT_BASE, RISK_BASE, band, base_of

# Points of the factors, thresholds, and how a developer's goal weighs risk and impact.
POINTS = {"quality": 35, "benefit": 25, "safety": 20, "strategy": 10, "feedback": 10}
RECOMMENDED_FROM, REVIEW_FROM = 80, 60
BENEFIT_REFERENCE = 8.0
LEAST_OBSERVATIONS, PRIOR_STRENGTH, DEFAULT_PRIOR = 5, 5.0, 0.5
RISK_FIT = {
    "safety_first": {"low": 1.0, "medium": 0.45, "high": 0.0},
    "balanced": {"low": 0.9, "medium": 0.7, "high": 0.3},
    "max_improvement": {"low": 0.7, "medium": 0.8, "high": 0.7},
}
IMPACT_FIT = {
    "safety_first": {"low": 0.5, "medium": 0.8, "high": 1.0},
    "balanced": {"low": 0.4, "medium": 0.7, "high": 1.0},
    "max_improvement": {"low": 0.2, "medium": 0.6, "high": 1.0},
}
RISK_SHARE = {"safety_first": 0.75, "balanced": 0.5, "max_improvement": 0.25}
GOAL_OF_TOLERANCE = {"conservative": "safety_first", "balanced": "balanced", "aggressive": "max_improvement"}
CATEGORIES = ("recommended", "review", "not_recommended", "manual_only")


def goal(stated: Column, tolerance: Column) -> Column:
    """A developer's goal: the stated one, or that of the risk tolerance, or balanced."""
    named = F.lower(F.trim(stated))
    by_tolerance = F.try_element_at(literal_map(GOAL_OF_TOLERANCE), F.lower(F.trim(tolerance)))
    return F.when(named.isin(*RISK_FIT), named).otherwise(F.coalesce(by_tolerance, F.lit("balanced")))


def selection_margin(chosen: Column, alternatives: Column) -> Column:
    """How far the chosen score (0..1) is above the best alternative's, in quarters of itself; 0.5 if there is nothing to compare."""
    best = F.array_max(F.transform(alternatives, lambda x: score_scale(x)["value"]))
    return F.when(best.isNull() | chosen.isNull() | (chosen <= 0), 0.5).otherwise(clamp((chosen - best) / (chosen * 0.25)))


def quality_factor(score: Column, alternatives: Column, impact: Column, risk: Column) -> Column:
    """Mostly the score, a little how clearly it won; without a score the ratings stand in, as if the margin were neutral."""
    value = score_scale(score)["value"]
    rated = clamp(base_of(impact, IMPACT_BASE) - (base_of(risk, RISK_BASE) - 0.2) * 0.5)
    return F.when(value.isNull(), 0.85 * rated + 0.15 * 0.5).otherwise(0.85 * value + 0.15 * selection_margin(value, alternatives))


def benefit_factor(gain: Column, maintainability: Column, cohesion: Column, coupling: Column, impact: Column) -> Column:
    """Projected gain in points and predicted changes, blended 65 to 35; one of them alone; or the impact rating at a discount."""
    record = clamp(gain / BENEFIT_REFERENCE)
    parts = F.filter(
        F.array(clamp(F.when(maintainability <= 1, maintainability).otherwise(maintainability / 100)), clamp(0.5 + cohesion / 10), clamp(0.5 - coupling / 10)),
        lambda x: x.isNotNull(),
    )
    predicted = F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts))
    return F.coalesce(0.65 * record + 0.35 * predicted, record, predicted, 0.7 * base_of(impact, IMPACT_BASE))


def effective_risk(risk: Column, record_band: Column, record_score: Column) -> Column:
    """(band, score): the worse of the step's own rating and the impact record's."""
    own = band(risk)
    recorded = band(record_band, own)
    worse = F.when((own == "high") | (recorded == "high"), "high").when((own == "medium") | (recorded == "medium"), "medium").otherwise("low")
    return F.struct(worse.alias("band"), F.greatest(base_of(own, RISK_BASE), F.coalesce(record_score, base_of(recorded, RISK_BASE))).alias("score"))


def safety_factor(risk_score: Column, radius: Column, validation: Column, capability: Column, mappable: Column) -> Column:
    """What the risk leaves, less for wide use, weak validation, missing capability and steps that no action fits.

    validation: names of the checks that would run."""
    files = F.coalesce(F.nullif(radius.cast("double"), F.lit(0.0)), F.lit(1.0))
    value = (1 - clamp(risk_score)) * F.when(files > 6, 0.75).when(files > 3, 0.85).otherwise(1.0)
    value = F.when(F.array_contains(validation, "behavioural"), clamp(value * 1.1)).when(F.size(validation) > 0, value * 0.95).otherwise(value)
    value = value * F.when(capability == "advisory", 0.5).when(capability == "unknown", 0.35).otherwise(1.0)
    return clamp(value * F.when(mappable, 1.0).otherwise(0.4))


def strategy_factor(goal_name: Column, risk: Column, impact: Column, preferred: Column) -> Column:
    """How well a step's risk and impact fit the developer's goal; a preferred fix gets a little more."""
    fit = lambda table, rating: F.element_at(literal_map({f"{g}/{r}": v for g, row in table.items() for r, v in row.items()}), F.concat_ws("/", goal_name, band(rating)))
    share = F.element_at(literal_map(RISK_SHARE), goal_name)
    value = share * fit(RISK_FIT, risk) + (1 - share) * fit(IMPACT_FIT, impact)
    return F.when(preferred, clamp(value + 0.15)).otherwise(value)


def feedback_factor(observations: Column, accepted: Column, prior: Column, others: list[Column]) -> Column:
    """The smoothed acceptance rate; with few observations the mean of the other factors, which neither helps nor hurts."""
    start = F.coalesce(prior, F.lit(DEFAULT_PRIOR))
    seen = F.coalesce(observations, F.lit(0))
    mean = sum(others[1:], others[0]) / len(others)
    smoothed = clamp((F.coalesce(accepted, F.lit(0)) + PRIOR_STRENGTH * start) / (seen + PRIOR_STRENGTH))
    return F.when(seen < LEAST_OBSERVATIONS, clamp(mean)).otherwise(smoothed)


def support_score(factors: dict[str, Column]) -> Column:
    """The sum of all factors' points (each to a digit) as a whole number, 0 to 100; halves go to the even number."""
    points = [F.round(POINTS[name] * value, 1) for name, value in factors.items()]
    return F.bround(F.round(sum(points[1:], points[0]), 1), 0).cast("int")


def category(score: Column, capability: Column, mappable: Column, risk: Column) -> Column:
    """Gates first, then the score's class. A high risk never rises above a review."""
    return (
        F.when(capability == "advisory", "manual_only")
        .when((capability == "unknown") | ~mappable, "not_recommended")
        .when(score < REVIEW_FROM, "not_recommended")
        .when((risk == "high") | (score < RECOMMENDED_FROM), "review")
        .otherwise("recommended")
    )


def plan_summary(steps: DataFrame, by: list[str]) -> DataFrame:
    """Steps per category, what the selectable ones would gain and cost, and the worst risk.

    steps: category, eligible, gain, minutes, risk; a null category is a step that was not assessed. Sums are null where nothing was known."""
    chosen = F.col("category").isNotNull() & F.coalesce(F.col("eligible"), F.lit(False))
    assessed = F.col("category").isNotNull()
    rank = F.when(assessed, F.when(F.col("risk") == "high", 2).when(F.col("risk") == "medium", 1).when(F.col("risk") == "low", 0))
    found = steps.groupBy(*by).agg(
        *[F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES],
        F.count_if(~assessed).alias("unclassified"),
        F.count(F.lit(1)).alias("total_steps"),
        F.count_if(chosen).alias("auto_selectable"),
        F.round(F.sum(F.when(chosen, F.col("gain"))), 2).alias("projected_quality_gain"),
        F.sum(F.when(chosen, F.col("minutes").cast("int"))).alias("estimated_review_minutes"),
        F.sum(F.when(assessed, F.col("minutes").cast("int"))).alias("total_review_minutes"),
        F.max(rank).alias("__worst"),
    )
    return found.withColumn("max_risk", F.try_element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("__worst") + 1)).drop("__worst")
