"""Open records: every field of a report is kept."""

from __future__ import annotations

import json

from lintel.sources import records
from pyspark.sql import functions as F

FINDING = {"type": "LargeClass", "severity": "HIGH", "line": 3, "entity": "K", "method_count": 17, "cyclomatic_complexity": "many", "unknown": {"a": [1, None]}, "other": "x"}
FILE = {"relative_path": "a\\K.py", "language": "Python", "metrics": {"lines_of_code": 9, "odd": 1}, "code_smells": [FINDING, {"line": None}, "no object"], "extra": [True]}


def reports(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "n int, report string")


def test_shapes_of_reports(spark):
    texts = [json.dumps(x) for x in ({"type": "repository", "report": {"files": [FILE, 3, None], "repo_name": "r"}}, {"repo_name": "s", "files": []}, FILE, [FILE], {"files": "none", "file": "b.c"})]
    rows = records.report_files(reports(spark, *texts, "not json", None, ""), "report", ["n"]).orderBy("n").collect()
    assert [(r["n"], r["repository"], r["path"], r["language"], r["score"], len(r["findings"])) for r in rows] == [(0, "r", "a/K.py", "python", 100.0, 2), (2, "a\\K.py", "a/K.py", "python", 100.0, 2), (4, "b.c", "b.c", "c", 100.0, 0)]
    assert records.report_files(reports(spark), "report").count() == 0


def test_findings_with_all_fields(spark):
    files = records.report_files(reports(spark, json.dumps(FILE)), "report")
    first, second = records.flat_findings(files).withColumn("all", F.to_json("finding")).orderBy("pos").collect()
    assert (first["id"], first["severity"], first["location"]["class"], first["location"]["method"], first["location"]["lines"]) == ("a/K.py:3:0", "high", "K", None, [3, 3])
    assert first["metrics"] == {"lines_of_code": 9.0, "blank_lines": 0.0, "comment_lines": 0.0, "functions": 0.0, "classes": 0.0, "quality_score": 100.0, "method_count": 17.0}
    assert json.loads(first["all"]) == FINDING
    assert (second["id"], second["smell"], second["severity"], second["location"]["class"], second["line"]) == ("a/K.py:0:1", "Unknown", "low", "K", 0)


def test_narrowed_reports_keep_unknown_keys(spark):
    files = records.report_files(reports(spark, json.dumps(FILE), json.dumps({"file": "empty.py"})), "report", ["n"])
    chosen = spark.createDataFrame([(0, "a/K.py:3:0"), (0, "a/K.py:3:0"), (1, "a/K.py:3:0")], "n int, id string")
    rows = records.narrowed(files, chosen, ["n"])
    back = {r["n"]: json.loads(r["report"]) for r in rows.collect()}
    assert back[0] == FILE | {"relative_path": "a/K.py", "code_smells": [FINDING], "smell_summary": {"high": 1, "medium": 0, "low": 0}}
    assert back[1] == {"file": "empty.py", "relative_path": "empty.py", "code_smells": [], "smell_summary": {"high": 0, "medium": 0, "low": 0}}
    assert json.loads(records.narrowed(files, None, ["n"]).orderBy("n").first()["report"])["code_smells"] == [FINDING, {"line": None}]
    total = {r["n"]: r for r in records.summary(rows, ["n"]).collect()}
    assert (total[0]["total_lines_of_code"], total[0]["total_code_smells"], total[0]["selected_file_count"], total[1]["selected_file_count"]) == (9, 1, 1, 0)


def test_reports_are_made_and_read_once(spark):
    """No filter makes and parses the text again, and findings that are no objects or have fields of other types stay what they were."""
    finding = F.struct(F.lit("X").alias("type"), F.lit("no number").alias("line"), F.col("id").alias("end_line"), F.lit(True).alias("parameter_count"))
    made = spark.range(4).select("id", F.to_json(F.struct(F.lit("a/b.py").alias("file"), F.lit("odd").alias("quality_score"), F.when(F.col("id") > 0, F.array(finding)).alias("code_smells"))).alias("report"))
    flat = records.flat_findings(records.report_files(made, "report", ["id"]), ["id"])
    steps = flat._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert sum("ToJson" in s or "to_json" in s for s in steps) == 1 and not any("Filter (size" in s for s in steps)
    got = [(r["id"], r["line"], r["location"]["lines"], r["metrics"]["quality_score"]) for r in flat.orderBy("id").collect()]
    assert [(k, line, lines, score) for k, line, lines, score in got] == [(i, 0, [0, i], 100.0) for i in (1, 2, 3)]
