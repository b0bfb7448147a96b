"""Named preconditions of fixes, compiled to expressions with three values: true, false, and unknown, which passes.

A rule is a name and a condition over a finding's metrics, smell and location. A metric that is missing makes a condition
unknown; so is a name that no rule has. Callers replace rules or add their own by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Finding:
    """The columns that rules look at: metrics (map of numbers), location (map of texts) and lines (array of two numbers)."""

    metrics: Column
    location: Column
    lines: Column

    def metric(self, name: str) -> Column:
        return F.try_element_at(self.metrics, F.lit(name))

    def known(self, name: str) -> Column:
        """A metric that says something: above 0."""
        m = self.metric(name)
        return F.when(m > 0, m)

    def place(self, *names: str) -> Column:
        """The first of some entries of the location that isn't empty."""
        return F.coalesce(*[F.nullif(F.try_element_at(self.location, F.lit(n)), F.lit("")) for n in names])


Rule = Callable[[Finding], Column]


def least(name: str, bound: float) -> Rule:
    return lambda f: f.metric(name) >= bound


def known_least(name: str, bound: float) -> Rule:
    return lambda f: f.known(name) >= bound


def unknown(_: Finding) -> Column:
    return F.lit(None).cast("boolean")


# Names, metrics and bounds of the rules.
RULES: dict[str, Rule] = {
    "has_code_block": lambda f: F.when(F.size(f.lines) >= 2, F.try_element_at(f.lines, F.lit(2)) - F.try_element_at(f.lines, F.lit(1)) > 1),
    "has_temp_variables": known_least("lines_of_code", 11),
    "has_multiple_parameters": least("parameter_count", 3),
    "has_multiple_responsibilities": lambda f: F.coalesce(f.metric("method_count") >= 5, f.known("lines_of_code") >= 30),
    "has_external_field_access": least("external_field_accesses", 2),
    "has_parent_class": lambda f: f.place("parent_class", "superclass").isNotNull(),
    "has_thin_class": lambda f: F.when(f.known("lines_of_code").isNotNull(), (f.known("lines_of_code") < 50) | (F.coalesce(f.metric("method_count"), F.lit(0)) <= 3)),
    "has_type_checking": known_least("cyclomatic_complexity", 3),
    "has_primitive_fields": least("primitive_field_count", 2),
    "has_computable_parameter": unknown,
    "has_chain_calls": known_least("chain_length", 3),
    "has_magic_numbers": unknown,
    "has_multiple_dependencies": least("coupling", 3),
    "has_nesting": least("nesting_depth", 4),
    "is_class_method": lambda f: F.coalesce(~f.place("method", "entity", "source_method").isin("unknown", "null"), F.lit(False)),
    "has_valid_destination": unknown,
}


def truth(finding: Finding, rules: dict[str, Rule] | None = None) -> Column:
    """A map from rule to its value for a finding; unknown ones are left out. Rules of the caller's replace those of the same name."""
    every = {**RULES, **(rules or {})}
    entries = F.array(*[F.struct(F.lit(n).alias("key"), rule(finding).alias("value")) for n, rule in every.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def holds(names: Column, truths: Column) -> Column:
    """Do all named preconditions hold or stay unknown? Null names are none."""
    return F.coalesce(F.forall(names, lambda n: F.coalesce(F.try_element_at(truths, n), F.lit(True))), F.lit(True))


def failing(names: Column, truths: Column) -> Column:
    """The named preconditions that are false, in order."""
    return F.coalesce(F.filter(names, lambda n: ~F.coalesce(F.try_element_at(truths, n), F.lit(True))), F.array().cast("array<string>"))


def candidates(findings: DataFrame, catalogue: DataFrame, rules: dict[str, Rule] | None = None, smell: str = "smell") -> DataFrame:
    """Findings (smell, metrics, location, lines, ...) with every catalogue row (smell, refactoring, preconditions, ...) of their smell whose preconditions hold.

    Rules are evaluated once a finding, not once a candidate."""
    judged = findings.withColumn("__truths", truth(Finding(F.col("metrics"), F.col("location"), F.col("lines")), rules))
    return judged.join(catalogue, smell).filter(holds(F.col("preconditions"), F.col("__truths"))).drop("__truths")
