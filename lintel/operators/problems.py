"""What a finding's metrics say: severity, size categories, highlights, risk factors, predicted impact of a fix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lintel.functions.scalars import literal_map, rounded

# Points from a value up, largest first; levels from a sum of points up.
SEVERITY_STEPS = {
    "cyclomatic_complexity": ((15, 4), (10, 2), (5, 1)),
    "lines_of_code": ((200, 3), (100, 2), (50, 1)),
    "coupling": ((8, 3), (5, 1)),
    "method_count": ((20, 2), (10, 1)),
    "parameter_count": ((8, 2), (5, 1)),
}
SEVERITY_LEVELS = ((8, "critical"), (6, "high"), (3, "medium"))
SIZES = ((200, "very_large"), (100, "large"), (50, "medium"))
COMPLEXITIES = ((15, "very_high"), (10, "high"), (5, "moderate"))
COUPLINGS = ((8, "very_high"), (5, "high"), (2, "moderate"))
HIGHLIGHT_FROM = {"cyclomatic_complexity": 10, "lines_of_code": 100, "coupling": 5, "method_count": 10, "parameter_count": 5}
NO_RISK = "Standard refactoring complexity"

# Fix, share of complexity it removes, change of coupling, change of cohesion, gain of maintainability, risk.
IMPACT_RULES = {
    "Extract Method": (0.35, -2.0, 3.0, 0.25, 0.10),
    "Extract Class": (0.30, -5.0, 5.0, 0.35, 0.30),
    "Extract Subclass": (0.25, -3.0, 4.0, 0.30, 0.35),
    "Move Method": (0.15, -4.0, 3.0, 0.20, 0.15),
    "Replace Temp with Query": (0.20, -1.0, 1.0, 0.15, 0.10),
    "Introduce Parameter Object": (0.15, -3.0, 2.0, 0.20, 0.10),
    "Pull Up Method": (0.20, -2.0, 2.0, 0.20, 0.20),
    "Inline Class": (0.10, -3.0, 1.0, 0.15, 0.25),
    "Replace Conditional with Polymorphism": (0.40, -2.0, 4.0, 0.35, 0.30),
    "Collapse Hierarchy": (0.15, -2.0, 1.0, 0.15, 0.20),
    "Remove Dead Code": (0.10, -1.0, 0.5, 0.10, 0.05),
    "Replace Data Value with Object": (0.10, -1.0, 2.0, 0.15, 0.10),
    "Replace Parameter with Method Call": (0.10, -1.0, 1.0, 0.10, 0.05),
    "Hide Delegate": (0.10, -3.0, 1.0, 0.10, 0.05),
    "Rename Method": (0.0, 0.0, 0.5, 0.05, 0.02),
    "Introduce Constant": (0.05, 0.0, 1.0, 0.20, 0.05),
    "Introduce Facade": (0.15, -5.0, 2.0, 0.25, 0.20),
}
OTHER_RULE = (0.10, -1.0, 1.0, 0.10, 0.25)
SEVERITY_RISK = {"low": 0.0, "medium": 0.05, "high": 0.10, "critical": 0.15}


def stepped(value: Column, steps: tuple, otherwise) -> Column:
    """The result of the first step that the value reaches."""
    found = F.when(value >= steps[0][0], steps[0][1])
    for low, result in steps[1:]:
        found = found.when(value >= low, result)
    return found.otherwise(otherwise)


def metric(metrics: Column, name: str, default: float = 0.0) -> Column:
    """An entry of a map of metrics."""
    return F.coalesce(F.try_element_at(metrics, F.lit(name)).cast("double"), F.lit(float(default)))


def severity_points(metrics: Column) -> Column:
    points = [stepped(metric(metrics, name), steps, 0) for name, steps in SEVERITY_STEPS.items()]
    return sum(points[1:], points[0])


def metric_severity(metrics: Column) -> Column:
    """low to critical, by points over five metrics."""
    return stepped(severity_points(metrics), SEVERITY_LEVELS, "low")


def size_category(metrics: Column) -> Column:
    return stepped(metric(metrics, "lines_of_code"), SIZES, "small")


def complexity_category(metrics: Column) -> Column:
    return stepped(metric(metrics, "cyclomatic_complexity"), COMPLEXITIES, "low")


def coupling_category(metrics: Column) -> Column:
    return stepped(metric(metrics, "coupling"), COUPLINGS, "low")


def highlights(metrics: Column) -> Column:
    """A map of the metrics that reach their mark."""
    marks = literal_map({k: float(v) for k, v in HIGHLIGHT_FROM.items()})
    return F.map_filter(metrics, lambda k, v: F.coalesce(v >= F.try_element_at(marks, k), F.lit(False)))


def risk_factors(metrics: Column, smell: Column) -> Column:
    """Sentences for what makes a fix risky; one standard sentence if nothing does."""
    loc = metric(metrics, "lines_of_code")
    sentences = F.array(
        F.when(metric(metrics, "cyclomatic_complexity") >= 15, "High cyclomatic complexity increases refactoring risk"),
        F.when(loc >= 200, "Large code block is difficult to refactor safely"),
        F.when(metric(metrics, "coupling") >= 8, "High coupling means refactoring may break dependent code"),
        F.when((smell.contains("Long Method") | smell.contains("Long Function")) & (loc >= 150), "Consider extracting smaller methods incrementally"),
        F.when(smell.contains("God Class") & (metric(metrics, "method_count") >= 20), "Class has too many responsibilities to fix at once"),
    )
    found = F.array_compact(sentences)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(NO_RISK)))


def rationale(metrics: Column, severity: Column) -> Column:
    """[SEVERITY] and the reasons for it."""
    cc, loc, coupling = (metric(metrics, m).cast("int") for m in ("cyclomatic_complexity", "lines_of_code", "coupling"))
    reasons = F.array_compact(
        F.array(
            F.when(cc >= 15, F.format_string("Very high complexity (CC=%d, >15)", cc)).when(cc >= 10, F.format_string("High complexity (CC=%d, >10)", cc)),
            F.when(loc >= 200, F.format_string("Very long code block (LOC=%d, >200)", loc)).when(loc >= 100, F.format_string("Long code block (LOC=%d, >100)", loc)),
            F.when(coupling >= 8, F.format_string("High coupling (depends on %d other classes)", coupling)),
        )
    )
    text = F.when(F.size(reasons) > 0, F.array_join(reasons, "; ")).otherwise("Detected by static analysis")
    return F.concat(F.lit("["), F.upper(severity), F.lit("] "), text)


def predicted_impact(refactoring: Column, complexity: Column, severity: Column, rules: dict[str, tuple] | None = None) -> Column:
    """What a fix is expected to change: complexity after it, coupling, cohesion, maintainability, and its risk.

    Fixes without a rule have a careful one; a missing complexity counts as 10. rules: a table of one's own."""
    table = IMPACT_RULES if rules is None else rules
    part = lambda i: F.coalesce(F.try_element_at(literal_map({k: float(v[i]) for k, v in table.items()}), refactoring), F.lit(OTHER_RULE[i])) if table else F.lit(OTHER_RULE[i])
    bonus = F.coalesce(F.try_element_at(literal_map(SEVERITY_RISK), severity), F.lit(0.05))
    return F.struct(
        rounded(F.coalesce(complexity.cast("double"), F.lit(10.0)) * (1 - part(0)), 1).alias("complexity_after"),
        part(1).alias("coupling_change"),
        part(2).alias("cohesion_change"),
        rounded(part(3), 2).alias("maintainability_gain"),
        rounded(F.least(F.lit(1.0), part(4) + bonus), 2).alias("risk"),
    )


def impact_bonus(impact: Column, complexity: Column) -> Column:
    """A predicted impact as one number: what gets better, less the risk."""
    now = F.coalesce(complexity.cast("double"), F.lit(10.0))
    simpler = F.when(now > 0, (now - impact["complexity_after"]) / now).otherwise(0.0)
    looser = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), -impact["coupling_change"] / 10))
    tighter = F.least(F.lit(1.0), F.greatest(F.lit(0.0), impact["cohesion_change"] / 5))
    return simpler + looser + tighter + impact["maintainability_gain"] - impact["risk"]
