"""Checks of a transformation: confidence, rollback, comparison of behaviour, summaries and invariants of observed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.functions.scalars import clamp

# Fixed values.
CONFIDENCE_WEIGHTS = {"syntax": 0.35, "structural": 0.35, "behavioral": 0.30}
INVARIANT_WEIGHT, FAILURE_CAP = 0.15, 0.49
SETUP_ERRORS = ("CompilationError", "RuntimeUnavailable", "HarnessError", "RuntimeError", "ClassNotFoundException", "NoSuchMethodException")


def confidence(checks: dict[str, tuple[Column, Column]], behavioral_applies: Column, invariant: tuple[Column, Column] | None = None, weights: dict[str, float] | None = None) -> Column:
    """Weighted score of (score, passed) per check. A failed check gives 0 and caps the result; a behavioural check that
    doesn't apply is left out and the other weights grow to match. A null invariant score is no invariant check."""
    w = CONFIDENCE_WEIGHTS | (weights or {})
    credit = lambda c: F.when(c[1], clamp(c[0])).otherwise(0.0)
    fixed = [n for n in checks if n != "behavioral"]
    total = F.lit(sum(w[n] for n in fixed)) + F.when(behavioral_applies, w["behavioral"]).otherwise(0.0)
    score = sum((w[n] * credit(checks[n]) for n in fixed), F.lit(0.0)) + F.when(behavioral_applies, w["behavioral"] * credit(checks["behavioral"])).otherwise(0.0)
    score = F.when(total > 0, score / total).otherwise(0.0)
    failed = F.lit(False)
    for _, passed in checks.values():
        failed = failed | ~passed
    if invariant is not None:
        checked = invariant[0].isNotNull()
        score = F.when(checked, (1 - INVARIANT_WEIGHT) * score + INVARIANT_WEIGHT * credit(invariant)).otherwise(score)
        failed = failed | (checked & ~F.coalesce(invariant[1], F.lit(False)))
    return F.when(failed, F.least(clamp(score), F.lit(FAILURE_CAP))).otherwise(clamp(score))


def rollback(steps: DataFrame, by: list[str], name: str, passed: str, position: str, on_behavior: bool = True) -> DataFrame:
    """(needed, reason) per run: any failed check, but for the behavioural one if that is optional."""
    failed = ~F.col(passed) if on_behavior else ~F.col(passed) & (F.col(name) != "behavioral")
    names = F.transform(F.array_sort(F.collect_list(F.when(failed, F.struct(position, name)))), lambda x: x[name])  # as many as there are checks
    found = steps.groupBy(*by).agg(names.alias("__failed"))
    reason = F.when(F.size("__failed") > 0, F.concat(F.lit("Validation failed at stage(s): "), F.array_join("__failed", ", "))).otherwise("")
    return found.select(*by, (F.size("__failed") > 0).alias("rollback"), reason.alias("reason"))


def behaviour_verdict(a: str, b: str) -> Column:
    """Why the behaviour of the transformed code (struct column b) equals that of the original (a) or not; the first rule wins.

    Fields: timeout, success, exception_type, return_type, return_value, stdout."""
    x, y = (lambda f: F.col(f"{a}.{f}")), (lambda f: F.col(f"{b}.{f}"))
    true = lambda c: F.coalesce(c, F.lit(False))
    setup = true(x("exception_type").isin(*SETUP_ERRORS)) | true(y("exception_type").isin(*SETUP_ERRORS))
    ran = true(x("success")) & true(y("success"))
    return (
        F.when(true(x("timeout")) & true(y("timeout")), "both_timed_out")
        .when(true(x("timeout")), "original_timed_out")
        .when(true(y("timeout")), "transformed_timed_out")
        .when(setup, "fingerprint_execution_failed")
        .when(true(x("success")) & ~true(y("success")), "original_succeeds_transformed_fails")
        .when(true(y("success")) & ~true(x("success")), "transformed_succeeds_original_fails")
        .when(ran & ~x("return_type").eqNullSafe(y("return_type")), "return_type_mismatch")
        .when(ran & ~x("return_value").eqNullSafe(y("return_value")), "return_value_mismatch")
        .when(ran & ~x("stdout").eqNullSafe(y("stdout")), "stdout_mismatch")
        .when(ran, "match")
        .when(x("exception_type").eqNullSafe(y("exception_type")), "same_exception")
        .otherwise("exception_type_mismatch")
    )


def numeric_summary(df: DataFrame, by: list[str], value: Column, digits: int = 6) -> DataFrame:
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.round(F.min(value), digits).alias("min"), F.round(F.max(value), digits).alias("max"), F.round(F.avg(value), digits).alias("average"))


def length_summary(df: DataFrame, by: list[str], size: Column) -> DataFrame:
    """Of strings (their lengths) or collections (their sizes)."""
    return df.groupBy(*by).agg(F.count(size).alias("n"), F.min(size).alias("min_size"), F.max(size).alias("max_size"))


def boolean_summary(df: DataFrame, by: list[str], flag: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.count(flag).alias("n"), F.count_if(flag).alias("n_true"), F.count_if(~flag).alias("n_false"))


def number_invariants(x: Column) -> Column:
    """What holds of a number: null, truthy, finite, sign."""
    d = x.cast("double")
    sign = F.when(d < 0, "negative").when(d > 0, "positive").otherwise("zero")
    return F.struct(x.isNull().alias("is_null"), F.coalesce(d != 0, F.lit(False)).alias("truthy"), (~F.isnan(d) & (F.abs(d) < float("inf"))).alias("finite"), F.when(x.isNotNull(), sign).alias("sign"))


def string_invariants(x: Column) -> Column:
    """What holds of a string: null, truthy, length, number of lines."""
    lines = F.regexp_count(x, F.lit("\n")) + F.when(x != "", 1).otherwise(0)
    return F.struct(x.isNull().alias("is_null"), F.coalesce(x != "", F.lit(False)).alias("truthy"), F.char_length(x).alias("length"), lines.alias("line_count"))


def collection_invariants(items: Column) -> Column:
    """What holds of an array: size, empty, distinct items, all items equal."""
    distinct = F.size(F.array_distinct(items))
    return F.struct(F.size(items).alias("length"), (F.size(items) == 0).alias("empty"), distinct.alias("distinct"), (distinct == 1).alias("homogeneous"))


def located(findings: DataFrame, lines: DataFrame, by: list[str], window: int, pattern: str = "pattern") -> DataFrame:
    """Findings (by, id, start, end, pattern) against source lines (by, line, text): the line that matches, or why there is none.

    The stated line counts if it matches; else the only match within the window. Without a pattern the stated line stays.
    Lines are joined by file and a cell of 2 * window + 1 lines, so a long file costs its neighbourhood only."""
    width = 2 * window + 1
    last = lines.groupBy(*by).agg(F.max("line").alias("__last"))
    wanted = findings.join(last, by, "left").withColumn("end", F.greatest("start", F.coalesce("end", F.col("start"))))
    cells = wanted.filter(F.col(pattern).isNotNull()).withColumn("__cell", F.explode(F.sequence(F.floor((F.col("start") - window) / width), F.floor((F.col("start") + window) / width))))
    text = lines.select(*by, F.col("line").alias("__line"), F.col("text").alias("__text"), F.floor(F.col("line") / width).alias("__cell"))
    hits = cells.join(text, [*by, "__cell"]).filter((F.abs(F.col("__line") - F.col("start")) <= window) & F.expr(f"__text RLIKE `{pattern}`"))
    found = hits.groupBy(*by, "id").agg(F.max(F.col("__line") == F.col("start")).alias("__here"), F.count(F.lit(1)).alias("__n"), F.min("__line").alias("__at"))
    joined = wanted.join(found, [*by, "id"], "left")
    at = F.when(F.col(pattern).isNull() | F.col("__here"), F.col("start")).when(F.col("__n") == 1, F.col("__at"))
    why = F.when(F.col("start").isNull() | (F.col("start") < 1), "no source line").when(F.col("start") > F.coalesce("__last", F.lit(0)), "beyond the end of the file").when(at.isNull(), "not found near the line")
    return joined.select(*by, "id", F.when(why.isNull(), at).alias("found"), F.when(why.isNull(), F.least(F.col("__last"), at + F.col("end") - F.col("start"))).alias("found_end"), why.alias("unmapped"))
