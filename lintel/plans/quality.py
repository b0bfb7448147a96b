"""Repository quality report: files to findings to scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.functions import c_code, python_code
from lintel.functions.scalars import is_test_file
from lintel.operators import rollups
from lintel.session import written


def findings(files: DataFrame, repository: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, file facts) of a source tree (path, language, text): one parse of each file, then joins. Numbers in tests are no findings."""
    python = written(python_code.analyse(files.filter("language = 'python'"), repository=repository), "python-rows")
    other = written(c_code.analyse(files, repository=repository), "c-rows")
    rows = python_code.all_findings(python).unionByName(c_code.all_findings(other))
    rows = rows.filter(~((F.col("smell") == "MagicNumber") & is_test_file(F.col("path"))))
    facts = python.unionByName(other).filter("kind IN ('file', 'error')")
    return rows, facts.select("repository", "path", F.coalesce("smell", "kind").alias("fact"), "value", F.when(F.col("kind") == "error", F.col("detail")).alias("error"))


def file_report(files: DataFrame, found: DataFrame, facts: DataFrame, repository: str | None = None) -> DataFrame:
    """repository, path, language, lines, findings by severity, score, error; files without findings stay. Repositories may have equal paths."""
    key = ["repository", "path"]
    scores = rollups.quality_score(found, key, F.col("severity"))
    levels = found.groupBy(*key).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")])
    lines = facts.groupBy(*key).agg(F.max(F.when(F.col("fact") == "lines", F.col("value"))).alias("lines"), F.max("error").alias("error"))
    owner = F.lit("") if repository is None else F.coalesce(F.col(repository).cast("string"), F.lit(""))
    joined = files.select(owner.alias("repository"), "path", "language").join(lines.hint("merge"), key, "left").join(scores.hint("merge"), key, "left").join(levels.hint("merge"), key, "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("findings", "high", "medium", "low")}
    return joined.withColumns(zero | {"score": F.when(F.col("error").isNull(), F.coalesce("score", F.lit(100.0)))})


def repository_report(reports: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row: files with errors count as 100."""
    return rollups.repository_summary(reports, by)
