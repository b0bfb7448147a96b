"""Selections and repository overviews on small tables."""

from __future__ import annotations

from lintel.operators import selection
from lintel.plans import overview, repository
from lintel.sources import files as sources
from pyspark.sql import functions as F

FINDINGS = [("a:1:0", "a", 0, "X", "high", 1, "f"), ("a:2:1", "a", 1, "Y", "low", 2, "g"), ("b:1:0", "b", 2, "X", "medium", 1, None)]
SCHEMA = "id string, path string, pos int, smell string, severity string, line int, entity string"


def test_rebuild_keeps_files(spark):
    found = spark.createDataFrame(FINDINGS, SCHEMA)
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    chosen = spark.createDataFrame([("a:2:1",)], "id string")
    rows = {r["path"]: r for r in selection.rebuild_report(files, found, chosen).collect()}
    assert [s["id"] for s in rows["a"]["code_smells"]] == ["a:2:1"] and rows["b"]["code_smells"] == [] and rows["c"]["low"] == 0
    everything = {r["path"]: len(r["code_smells"]) for r in selection.rebuild_report(files, found, chosen.limit(0)).collect()}
    assert everything == {"a": 2, "b": 1, "c": 0}


def test_resolve_and_display_ids(spark):
    found = spark.createDataFrame(FINDINGS, SCHEMA)
    one = spark.createDataFrame([("b", "X", 1, "f")], "path string, smell string, line int, entity string")
    got = selection.resolve(found, lines=one, ids=spark.createDataFrame([("a:1:0",), ("zz",)], "id string"), entities=one)
    assert [r["id"] for r in got.orderBy("pos").collect()] == ["a:1:0", "b:1:0"]
    shown = selection.display_ids(found, [], [F.col("pos")])
    tokens = spark.createDataFrame([("S001",), ("s3",), ("S9",), ("x",)], "token string")
    rows = {r["token"]: r["found"] for r in selection.resolve_display_ids(tokens, shown, [], "id").collect()}
    assert rows == {"S001": "a:1:0", "s3": "b:1:0", "S9": None, "x": None}


def test_interactions(spark):
    edges = spark.createDataFrame([("clone", "1", "2"), ("overlaps", "1", "3"), ("contains", "3", "4"), ("clone", "5", "6")], "kind string, a string, b string")
    rows = selection.interactions(edges, spark.createDataFrame([("1",), ("3",)], "id string")).collect()
    assert {(r["kind"], r["note"]) for r in rows} == {("clone", "one clone of two"), ("overlaps", "overlapping changes"), ("contains", "container without part")}


def test_overview(spark):
    rows = [
        ("app.py", "python", "import lib.util\nfrom lib import other\nif __name__ == '__main__': pass\n"),
        ("lib/util.py", "python", "x = 1\n"),
        ("lib/__init__.py", "python", ""),
        ("tests/test_a.py", "python", "import app\n"),
        ("j/Main.java", "java", "import k.Helper;\npublic static void main(String[] a) {}\n"),
        ("k/Helper.java", "java", "class Helper {}\n"),
        ("c/a.c", "c", '#include "a.h"\n#include <stdio.h>\n'),
        ("c/a.h", "c", "int a;\n"),
    ]
    files = spark.createDataFrame(rows, "path string, language string, text string")
    edges = overview.dependencies(files)
    assert {(r["src"], r["dst"]) for r in edges.collect()} == {("app.py", "lib/util.py"), ("app.py", "lib/__init__.py"), ("tests/test_a.py", "app.py"), ("j/Main.java", "k/Helper.java"), ("c/a.c", "c/a.h")}
    share = {r["language"]: (r["n"], r["percent"]) for r in overview.languages(files).collect()}
    assert share["python"] == (4, 50.0)
    known = repository.important_folders(spark.createDataFrame([("r", p) for p in ("api/a.py", "services/b.py", "models/c.py", "docs/d.md")] + [("s", "api/a.py")], "repository string, path string"))
    found = overview.clues(known, {"layers": ["API", "Service", "Data Model"], "other": ["Schema"]}).collect()
    assert [(r["repository"], r["clue"], r["found"]) for r in found] == [("r", "layers", 3)]
