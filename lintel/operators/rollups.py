"""Rollups of findings: scores, catalogues with zero rows, worst severities, shares, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lintel.functions.scalars import penalty, severity_rank


def quality_score(df: DataFrame, by: list[str], severity: Column) -> DataFrame:
    """100 less the severities' penalties, not under 0, to one digit; null severities are no findings."""
    cost = F.sum(F.when(severity.isNotNull(), penalty(severity)).otherwise(0))
    return df.groupBy(*by).agg(F.count(severity).alias("findings"), F.round(F.greatest(F.lit(0.0), 100.0 - cost), 1).alias("score"))


def catalogue(df: DataFrame, by: str, names: list[str]) -> DataFrame:
    """A row for each name, in the given order, with zero where there is none."""
    dim = df.sparkSession.createDataFrame([(i, n) for i, n in enumerate(names)], f"pos int, {by} string")
    counts = df.filter(F.col(by).isin(names)).groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return dim.join(counts, by, "left").select("pos", by, F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("present"))


def worst(df: DataFrame, by: list[str], severity: Column, item: Column, file: Column) -> DataFrame:
    """Count, worst severity, histogram, distinct files in order, ids in order."""
    level = F.lower(severity)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(level, F.struct(severity_rank(severity), level)).alias("worst"),
        *[F.count_if(level == s).alias(s) for s in ("high", "medium", "low")],
        F.array_sort(F.collect_set(file)).alias("files"),
        F.array_sort(F.collect_list(item)).alias("ids"),
    )


def share(df: DataFrame, by: str, digits: int = 1) -> DataFrame:
    """Rows per value, and percent of all rows."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), digits))


def primary(df: DataFrame, by: list[str], value: str, position: str, default: str) -> DataFrame:
    """The most frequent value per group; of equals the one seen first."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first"))
    return counts.groupBy(*by).agg(F.coalesce(F.max_by(value, F.struct(F.col("n"), -F.col("first"))), F.lit(default)).alias("primary"), F.count(value).alias("values"))


def pivoted(df: DataFrame, by: list[str], column: str, values: list[str]) -> DataFrame:
    """Counts of given values as columns, zero where there is none."""
    return df.groupBy(*by).pivot(column, values).count().fillna(0, subset=values)


def count_map(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Per group a map from value to count, from two grouped steps."""
    counts = df.groupBy(*by, F.coalesce(F.col(value), F.lit("unknown")).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    return counts.groupBy(*by).agg(F.sum("__n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("__v", "__n")))).alias(name))


def five_numbers(df: DataFrame, value: Column, by: list[str] | None = None, digits: int = 6) -> DataFrame:
    """n, median, mean, min and max of the values that are there."""
    return df.groupBy(*(by or [])).agg(
        F.count(value).alias("n"),
        F.round(F.median(value), digits).alias("median"),
        F.round(F.avg(value), digits).alias("mean"),
        F.round(F.min(value), digits).alias("min"),
        F.round(F.max(value), digits).alias("max"),
    )


def repository_summary(files: DataFrame, by: list[str] | None = None, missing: float | None = 100.0) -> DataFrame:
    """Files, findings, lines, severities and the mean score. Files without a score count as `missing`, or not at all if it is None."""
    score = F.col("score") if missing is None else F.coalesce("score", F.lit(missing))
    return files.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("findings").alias("findings"),
        F.sum("lines").alias("lines"),
        *[F.sum(s).alias(s) for s in ("high", "medium", "low")],
        F.round(F.coalesce(F.avg(score), F.lit(0.0)), 1).alias("score"),
    )


def metrics_before(df: DataFrame, by: list[str], severity: Column) -> DataFrame:
    """Complexity, duplication and maintainability estimates from counts per severity; rows without a severity count as findings."""
    n = {s: F.count_if(F.lower(severity) == s) for s in ("critical", "high", "medium", "low")}
    counted = df.groupBy(*by).agg(*[c.alias(s) for s, c in n.items()], F.count(F.lit(1)).alias("total"))
    complexity = F.least(F.lit(100), 30 + 15 * F.col("critical") + 8 * F.col("high") + 4 * F.col("medium") + F.col("low"))
    duplication = F.least(F.lit(100), 10 + 3 * F.col("total"))
    return counted.withColumns({"complexity": complexity, "duplication": duplication, "maintainability": F.greatest(F.lit(0), 100 - complexity - F.floor(duplication / 2))})


def metrics_after(before: DataFrame, resolved: Column) -> DataFrame:
    """metrics_before after that many findings are resolved: what is taken off is cut to whole numbers."""
    share = resolved / F.greatest(F.col("total"), F.lit(1))
    simpler = (F.col("complexity") * share * 0.7).cast("long")
    leaner = (F.col("duplication") * share * 0.6).cast("long")
    maintainability = F.least(F.lit(100), F.col("maintainability") + simpler + F.floor(leaner / 2))
    return before.withColumns(
        {
            "complexity_after": F.greatest(F.lit(5), F.col("complexity") - simpler),
            "duplication_after": F.greatest(F.lit(0), F.col("duplication") - leaner),
            "maintainability_after": maintainability,
            "total_after": F.greatest(F.lit(0), F.col("total") - resolved),
            **{f"{s}_after": F.greatest(F.lit(0), F.col(s) - (F.col(s) * share).cast("long")) for s in ("critical", "high", "medium", "low")},
        }
    )


def line_coverage(df: DataFrame, by: list[str], start: Column, end: Column, severity: Column, anchor: Column | None = None, longest: int = 2000) -> DataFrame:
    """A row per covered line with the number of findings, of findings anchored there, and the worst severity.

    A finding of more than `longest` lines after its first counts at its anchor (or first) line only; one that starts before line 1 not at all."""
    at = start if anchor is None else F.coalesce(F.nullif(anchor, F.lit(0)), start)
    lines = F.when(end - start > longest, F.array(at)).when(end >= start, F.sequence(start, end))
    spans = df.filter(start >= 1).select(*by, severity.alias("severity"), at.alias("__anchor"), F.explode(lines).alias("line"))
    return spans.groupBy(*by, "line").agg(
        F.count(F.lit(1)).alias("findings"), F.count_if(F.col("line") == F.col("__anchor")).alias("anchors"), F.min_by(F.lower("severity"), severity_rank(F.col("severity"))).alias("worst")
    )


def quality_before(reports: DataFrame, findings: DataFrame, by: list[str], stated: str, file: str, score: str, position: str) -> DataFrame:
    """The report's mean score, else the mean over files of the first score seen in each, else 0."""
    first = findings.filter(F.col(score).isNotNull()).groupBy(*by, file).agg(F.min_by(score, position).alias("__s"))
    means = first.groupBy(*by).agg(F.avg("__s").alias("__mean"))
    return reports.join(means, by, "left").select(*by, F.round(F.coalesce(F.col(stated).cast("double"), "__mean", F.lit(0.0)), 6).alias("quality_before"))


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls per column, as rows."""
    one = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in df.columns])
    return one.select(F.explode(pairs).alias("x"), "__rows").select("x.column", "x.nulls", F.col("__rows").alias("rows"))


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """The F statistic of a one-way analysis of variance, from group sums."""
    sums = df.filter(F.col(value).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(value).cast("double")).alias("s"), F.sum(F.col(value).cast("double") * F.col(value)).alias("q"))
    total = sums.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    between, within = F.col("b") - F.col("s") * F.col("s") / F.col("n"), F.col("q") - F.col("b")
    return total.select(F.col("k").alias("groups"), F.col("n").cast("long").alias("rows"), F.try_divide(between / (F.col("k") - 1), within / (F.col("n") - F.col("k"))).alias("f"))
