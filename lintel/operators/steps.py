"""Steps of a plan: normalising, decisions, splits, digests, actions. A plan's steps are rows; expressions and grouped aggregates only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.operators import ranking, taxonomy
from lintel.operators.scoring import band

VERDICTS = {"approve": "approved", "reject": "rejected", "manual": "manual"}
#: Weights of the re-ranking by a developer's preferences.
IMPACT_WEIGHT = {"low": 1, "medium": 2, "high": 3}
RISK_WEIGHT = {"balanced": {"low": 3, "medium": 2, "high": 1}, "aggressive": {"low": 1, "medium": 2, "high": 3}, "conservative": {"low": 4, "medium": 2, "high": 0}}


def identity(smell_id: Column, refactoring: Column, file: Column) -> Column:
    """A step's name across revisions of a plan."""
    return F.concat_ws("|", *[F.coalesce(x.cast("string"), F.lit("")) for x in (smell_id, refactoring, file)])


def with_verdicts(steps: DataFrame, decisions: DataFrame, plan: str, step: str) -> DataFrame:
    """Append verdict: approved, rejected, manual, or pending without a decision. decisions: plan, step, decision; the last row of a step counts by pos."""
    said = decisions.groupBy(plan, step).agg(F.max_by("decision", "pos").alias("__decision"))
    verdict = F.coalesce(*[F.when(F.col("__decision") == k, v) for k, v in VERDICTS.items()], F.lit("pending"))
    return steps.join(said, [plan, step], "left").withColumn("verdict", verdict).drop("__decision")


def normalized(steps: DataFrame, by: list[str], impact: Column, risk: Column, known_high: Column | None = None) -> DataFrame:
    """A plan's totals: steps, steps of high impact (a number that the plan states wins), steps per risk."""
    high = F.count_if(F.lower(impact) == "high")
    stated = high if known_high is None else F.coalesce(F.max(known_high), high)
    return steps.groupBy(*by).agg(F.count(F.lit(1)).alias("total_steps"), stated.alias("high_impact"), *[F.count_if(F.lower(risk) == r).alias(f"risk_{r}") for r in ("low", "medium", "high")])


def approved_plan(steps: DataFrame, by: list[str], step: str, impact: Column, risk: Column) -> DataFrame:
    """Of steps with verdicts: counts and ids of each part, and totals of the approved part. Manual steps count as pending, for they aren't forwarded."""
    approved, rejected = F.col("verdict") == "approved", F.col("verdict") == "rejected"
    ids = lambda which: F.array_sort(F.collect_list(F.when(which, F.col(step))))  # noqa: E731  as many as a plan has steps
    return steps.groupBy(*by).agg(
        F.count(F.lit(1)).alias("original_total_steps"),
        F.count_if(approved).alias("approved_count"),
        F.count_if(rejected).alias("rejected_count"),
        ids(approved).alias("approved_ids"),
        ids(rejected).alias("rejected_ids"),
        ids(~approved & ~rejected).alias("pending_ids"),
        F.count_if(approved & (F.lower(impact) == "high")).alias("high_impact"),
        *[F.count_if(approved & (F.lower(risk) == r)).alias(f"risk_{r}") for r in ("low", "medium", "high")],
    )


def manual_only(steps: DataFrame) -> DataFrame:
    """Steps that a developer keeps for manual work."""
    return steps.filter("verdict = 'manual'")


def overrides(steps: DataFrame, by: list[str], category: Column) -> DataFrame:
    """How often a developer decided against the recommendation."""
    return steps.groupBy(*by).agg(
        F.count_if((F.col("verdict") == "approved") & category.isin("not_recommended", "manual_only")).alias("approved_not_recommended"),
        F.count_if((F.col("verdict") == "rejected") & (category == "recommended")).alias("rejected_recommended"),
    )


def fallback_plan(findings: DataFrame, by: list[str], smell: str, position: str) -> DataFrame:
    """A step for each finding by the table of fixes (a rename where it has none), numbered in order."""
    fix = taxonomy.fix_of(F.col(smell), taxonomy.DEFAULT_FIX)
    return ranking.renumber(findings.withColumn("__fix", fix).select(*findings.columns, "__fix.*"), by, [F.col(position)], "step_id")


def folded(steps: DataFrame, trace: DataFrame, on: list[str], columns: list[str], ratings: tuple[str, ...] = ("impact", "risk", "complexity")) -> DataFrame:
    """Columns of the trace fill what a step leaves open; ratings are brought to low, medium or high. A trace with several rows of a key counts by its first pos."""
    first = trace.groupBy(*on).agg(F.min_by(F.struct(*columns), "pos").alias("__t"))
    joined = steps.join(first, on, "left")
    value = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), band(F.col(f"__t.{c}"))) if c in ratings else F.coalesce(F.col(c), F.col(f"__t.{c}"))
    return joined.select(*[value(c).alias(c) if c in columns else F.col(c) for c in steps.columns])


def preference_score(impact: Column, risk: Column, refactoring: Column, decision: Column, tolerance: str = "balanced", focus: str = "high", preferred: list[str] | None = None) -> Column:
    """Whole-number score for re-ranking steps by a developer's preferences."""
    weight = lambda c, table, other: F.coalesce(*[F.when(F.lower(c) == k, v) for k, v in table.items()], F.lit(other))
    stated = F.lower(F.coalesce(impact, F.lit("medium")))
    return (
        4 * weight(stated, IMPACT_WEIGHT, 2)
        + 2 * weight(F.coalesce(risk, F.lit("medium")), RISK_WEIGHT.get(tolerance, RISK_WEIGHT["balanced"]), 2)
        + F.when(stated == focus, 3).otherwise(0)
        + (F.when(refactoring.isin(preferred), 4).otherwise(0) if preferred else 0)
        + F.when(decision == "approve", 10).when(decision == "reject", -50).otherwise(0)
    )


def reranked(steps: DataFrame, by: list[str], score: Column, decision: Column, position: str) -> DataFrame:
    """Steps that weren't rejected, numbered anew by score; of equal scores the earlier first."""
    kept = steps.withColumn("score", score).filter(F.coalesce(decision != "reject", F.lit(True)))
    return ranking.renumber(kept, by, [F.desc("score"), F.col(position)], "new_step")


def has(value: Column) -> Column:
    return F.coalesce(F.trim(value.cast("string")) != "", F.lit(False))


def missing(refactoring: Column, params: Column, target: Column) -> Column:
    """What a step's action still needs, as text; null if nothing. params and target: maps of strings."""
    p = lambda *names: _any([has(F.try_element_at(params, F.lit(n))) for n in names])
    t = lambda name: has(F.try_element_at(target, F.lit(name)))
    action = taxonomy.action_of(refactoring)
    lines = p("start_line", "source_line", "line") & p("end_line", "target_line") | p("source_lines", "lines")
    rules = {
        "rename_symbol": ((p("old_name", "method") | t("method") | t("class")) & p("new_name", "renamed_to"), "the old and new names"),
        "extract_method": ((p("method") | t("method")) & lines, "the method name and a source line range"),
        "extract_constant": (F.try_element_at(params, F.lit("literal_value")).isNotNull(), "the literal value"),
        "introduce_constant": (p("literal_value", "literal_values", "hint"), "a literal value, literal list, or hint"),
        "remove_dead_code": (p("method", "source_line", "line", "start_line", "source_lines", "lines") | t("method"), "the method name or a source line"),
        "replace_unsafe_function": ((p("unsafe_function") | t("method")) & p("safe_alternative"), "the unsafe function and its safe replacement"),
        "encapsulate_variable": (p("variable_name") | t("variable"), "the variable name"),
        "replace_literal": (p("old_literal") & p("new_literal"), "the old and new literals"),
        "fault_injection": (p("original_logic", "old_logic") & p("faulty_logic", "new_logic"), "the original and faulty logic"),
    }
    found = F.when(action.isNull(), "no action for this refactoring")
    for name, (given, text) in rules.items():
        found = found.when((action == name) & ~given, text)
    return found


def _any(columns: list[Column]) -> Column:
    found = columns[0]
    for c in columns[1:]:
        found = found | c
    return found


def mapped(refactoring: Column, params: Column, target: Column) -> Column:
    """(mappable, action, missing) of a step; the action of a step that lacks something is null."""
    lacks = missing(refactoring, params, target)
    return F.struct(lacks.isNull().alias("mappable"), F.when(lacks.isNull(), taxonomy.action_of(refactoring)).alias("action"), lacks.alias("missing"))


def plan_digest(steps: DataFrame, by: list[str], file: Column, refactoring: Column, detail: Column, position: Column, limit: int = 40) -> DataFrame:
    """Per plan: steps, steps per file and refactoring as sorted text, the first details and how many were left out. Sorted details are cut, so a plan's steps meet in one row."""
    rows = steps.select(*by, F.coalesce(file, F.lit("(module level)")).alias("__f"), F.coalesce(refactoring, F.lit("Unknown")).alias("__r"), detail.alias("__d"), position.alias("__p"))
    kinds = rows.groupBy(*by, "__r").agg(F.count(F.lit(1)).alias("__n")).groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "__r", "__n"))), ",").alias("refactorings"))
    files = rows.groupBy(*by, "__f").agg(F.count(F.lit(1)).alias("__n")).groupBy(*by).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("__n")).alias("n"), "__f"))), lambda x: F.concat_ws("=", x["__f"], -x["n"])), ",").alias("by_file")
    )
    first = ranking.top_per_key(rows, by, [F.col("__p")], limit).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "__d"))), lambda x: x["__d"]).alias("detail"))
    total = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total_steps"))
    joined = total.join(kinds, by).join(files, by).join(first, by)
    return joined.withColumn("omitted", F.greatest(F.lit(0), F.col("total_steps") - limit))


def decision_digest(steps: DataFrame, by: list[str], detail: Column, position: Column, limit: int = 40) -> DataFrame:
    """Per plan and verdict: number, the first details in order, how many were left out."""
    rows = steps.select(*by, "verdict", detail.alias("__d"), position.alias("__p"))
    first = ranking.top_per_key(rows, [*by, "verdict"], [F.col("__p")], limit).groupBy(*by, "verdict").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "__d"))), lambda x: x["__d"]).alias("detail"))
    n = rows.groupBy(*by, "verdict").agg(F.count(F.lit(1)).alias("n"))
    return n.join(first, [*by, "verdict"]).withColumn("omitted", F.greatest(F.lit(0), F.col("n") - limit))
