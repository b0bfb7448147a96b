"""Choosing findings: report filters and rebuilds, selections by file, id, line or entity, short ids, order checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rebuild_report(files: DataFrame, findings: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """Findings (path, id, pos, smell, severity) back into a nested row per file; files without selected findings stay, with an empty list.

    selected (id): which findings to keep; none given, or an empty table, keeps all."""
    rows = findings
    if selected is not None and not selected.isEmpty():
        rows = findings.join(selected.select("id").distinct(), "id", "left_semi")
    nested = rows.groupBy("path").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "id", "smell", "severity"))), lambda s: F.struct(s["id"], s["smell"], s["severity"])).alias("code_smells"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")],
    )
    empty = F.array().cast("array<struct<id: string, smell: string, severity: string>>")
    joined = files.select("path").distinct().join(nested, "path", "left")
    return joined.select("path", F.coalesce("code_smells", empty).alias("code_smells"), *[F.coalesce(s, F.lit(0)).alias(s) for s in ("high", "medium", "low")])


def resolve(findings: DataFrame, files: DataFrame | None = None, ids: DataFrame | None = None, lines: DataFrame | None = None, entities: DataFrame | None = None) -> DataFrame:
    """Ids of findings (id, path, smell, line, entity, pos) chosen by path, by id, by (path, smell, line), or by (path, smell, entity); each once, in order."""
    parts = []
    for chosen, keys in ((files, ["path"]), (ids, ["id"]), (lines, ["path", "smell", "line"]), (entities, ["path", "smell", "entity"])):
        if chosen is not None:
            parts.append(findings.join(chosen.select(*keys).distinct(), keys, "left_semi").select("id", "pos"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("id").agg(F.min("pos").alias("pos"))


def split_selection(findings: DataFrame, selected: DataFrame) -> DataFrame:
    """Append `selected` (boolean)."""
    marks = selected.select("id").distinct().withColumn("__chosen", F.lit(True))
    return findings.join(marks, "id", "left").withColumn("selected", F.coalesce("__chosen", F.lit(False))).drop("__chosen")


def payload(findings: DataFrame, selected: DataFrame, by: list[str]) -> DataFrame:
    """Per group: findings, chosen and excluded ones, files with a chosen one, chosen ones per severity."""
    marked, on = split_selection(findings, selected), F.col("selected")
    return marked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(on).alias("chosen"),
        F.count_if(~on).alias("excluded"),
        F.count_distinct(F.when(on, F.col("path"))).alias("files"),
        *[F.count_if(on & (F.lower("severity") == s)).alias(s) for s in ("high", "medium", "low")],
    )


def display_ids(df: DataFrame, by: list[str], order: list, name: str = "display_id") -> DataFrame:
    """S001, S002, ... in order, per report."""
    return df.withColumn(name, F.format_string("S%03d", F.row_number().over(Window.partitionBy(*by).orderBy(*order))))


def resolve_display_ids(tokens: DataFrame, shown: DataFrame, by: list[str], item: str) -> DataFrame:
    """tokens (by, token) such as S001 or s1 with the item of that place; null for tokens that name none."""
    number = lambda c: F.regexp_extract(c, r"^[Ss]0*(\d+)$", 1).try_cast("int")
    left = tokens.withColumn("__n", number(F.trim("token")))
    right = shown.select(*by, F.col(item).alias("found"), number(F.col("display_id")).alias("__n"))
    return left.join(right, [*by, "__n"], "left").drop("__n")


def order_violations(steps: DataFrame, plan: str, action: str, position: str, needs: list[tuple[str, str]]) -> DataFrame:
    """Per plan: pairs of steps where a needed action comes after the one that needs it, from counts of earlier steps; no pairs are built."""
    inside = Window.partitionBy(plan).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    total = F.lit(0)
    for dependent, needed in needs:
        before = F.coalesce(F.sum(F.when(F.col(action) == dependent, 1).otherwise(0)).over(inside), F.lit(0))
        total = total + F.when(F.col(action) == needed, before).otherwise(0)
    return steps.withColumn("__v", total).groupBy(plan).agg(F.sum("__v").alias("violations"))


def interactions(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """edges (kind, a, b) with what a selection means for them: clone with one side chosen, overlap with both, container chosen without its part."""
    chosen = selected.select(F.col("id").alias("__id"), F.lit(True).alias("__x")).distinct()
    one = edges.join(chosen.toDF("a", "has_a"), "a", "left").join(chosen.toDF("b", "has_b"), "b", "left").fillna(False, subset=["has_a", "has_b"])
    note = (
        F.when((F.col("kind") == "clone") & (F.col("has_a") != F.col("has_b")), "one clone of two")
        .when((F.col("kind") == "overlaps") & F.col("has_a") & F.col("has_b"), "overlapping changes")
        .when((F.col("kind") == "contains") & F.col("has_a") & ~F.col("has_b"), "container without part")
    )
    return one.withColumn("note", note).filter("note IS NOT NULL").select("kind", "a", "b", "note")
