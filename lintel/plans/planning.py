"""From findings to an ordered plan of fixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.functions.scalars import severity_rank
from lintel.operators import grouped, ranking, scoring, sets


def plan(findings: DataFrame, catalogue: DataFrame, removing: list[str], needs: list[tuple[str, str]]) -> DataFrame:
    """findings (plan, id, smell, severity, entity, metrics, pos) and a catalogue (smell, refactoring, complexity, risk, impact, pos,
    preconditions) to one chosen fix per finding, without conflicts, in an order that respects the needs."""
    options = scoring.candidates(findings.withColumnRenamed("pos", "finding_pos"), catalogue)
    scored = options.withColumn("score", F.round(scoring.criteria_score(F.col("complexity"), F.col("risk"), F.col("impact")), 9))
    best = ranking.first_per_key(scored, ["plan", "id"], [F.desc("score"), F.col("pos")])
    steps = sets.prune_conflicts(best, "plan", "entity", "refactoring", "finding_pos", removing, smell="smell")
    inputs = steps.select("plan", "id", F.col("refactoring").alias("action"), severity_rank(F.col("severity")).alias("rank"), F.col("finding_pos").alias("pos"))
    order = grouped.sequence_steps(inputs, "plan", needs)
    return steps.join(order, ["plan", "id"]).select("plan", "step", "id", "smell", "entity", "severity", "refactoring", "score")
