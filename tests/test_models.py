"""Models and syntax trees."""

from __future__ import annotations

import random

import pytest
from lintel.functions import syntax_trees
from lintel.operators import models
from pyspark.sql import functions as F


def rows(spark, n=240):
    rng = random.Random(2)
    data = [(i, f"r{i % 12}", float(x := rng.randint(0, 50)), rng.random(), int(x > 25)) for i in range(n)]
    return spark.createDataFrame(data, "id int, repo string, loc double, noise double, y int")


def test_out_of_fold_and_groups(spark):
    df = models.with_logs(rows(spark), ["loc", "noise"])
    scored = models.out_of_fold(df, models.candidates(["loc", "noise"], "y")["logistic"], "repo", 3)
    assert scored.count() == 240
    assert scored.filter((F.col("probability1") > 0.5) == (F.col("y") == 1)).count() > 220
    assert scored.groupBy("repo").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0


def test_single_metric_rule(spark):
    best = models.single_metric_rule(rows(spark), ["noise", "loc"], "y").first()
    assert (best["feature"], best["direction"], best["threshold"], best["f1"]) == ("loc", ">=", 26.0, 1.0)


def test_tree_score(spark):
    tree = {"feature": "loc", "threshold": 25, "left": {"leaf": -40}, "right": {"leaf": 40}}
    got = rows(spark).select(models.tree_score([tree], {"loc": F.col("loc")}, 1.0).alias("p"), "y")
    assert got.filter((F.col("p") > 0.5) != (F.col("y") == 1)).count() == 0


def test_encoding(spark):
    df = spark.createDataFrame([("b", "high"), ("zz", "low"), (None, None)], "s string, severity string")
    got = models.encoded(df, {"s": ["a", "b"]}, "severity").collect()
    assert [(r["s_code"], r["severity_code"]) for r in got] == [(1.0, 2.0), (0.0, 0.0), (0.0, 0.0)]
    assert models.vocabulary(df, "s") == ["b", "zz"]


def test_syntax_trees(spark):
    a = "def f(x):\n    return x + 1\n"
    files = spark.createDataFrame([("a.py", "python", a), ("bad.py", "python", "def ("), ("a.c", "c", "int f(int a) { if (a) { a++; } return a; }")], "path string, language string, text string")
    tree = syntax_trees.nodes(files)
    by = {}
    for r in tree.collect():
        by.setdefault(r["path"], []).append(r)
    assert set(by) == {"a.py", "a.c"}
    root = [r for r in by["a.py"] if r["parent"] is None]
    assert len(root) == 1 and root[0]["type"] == "Module" and {"FunctionDef", "Return", "BinOp"} <= {r["type"] for r in by["a.py"]}
    assert [(r["type"], r["depth"]) for r in sorted(by["a.c"], key=lambda r: r["node"])] == [("File", 0), ("Function", 1), ("Block", 2)]
    assert {r["similarity"] for r in syntax_trees.structural_similarity(tree, tree).collect()} == {1.0} or all(abs(r["similarity"] - 1) < 1e-9 for r in syntax_trees.structural_similarity(tree, tree).collect())
    uses = spark.createDataFrame([("C", "a", "x"), ("C", "b", "x"), ("C", "c", "y")], "class string, method string, field string")
    assert [round(r["cohesion"], 6) for r in syntax_trees.cohesion(uses).collect()] == [round(1 / 3, 6)]


def test_saved_trees_and_empty_folds(spark, tmp_path):
    tree = {"feature": "loc", "threshold": 25, "left": {"leaf": -40}, "right": {"leaf": 40}}
    models.export_trees(f"{tmp_path}/m.json", {"A": {"trees": [tree], "rate": 1.0}, "B": {"trees": [tree], "enabled": False}})
    found = models.load_trees(f"{tmp_path}/m.json")
    assert models.learned_smells(found) == ["A"] and models.learned_smells(found, True) == ["A", "B"]
    got = models.model_findings(rows(spark), found, {"loc": F.col("loc")})
    assert got.filter("smell = 'A'").count() == rows(spark).filter("loc > 25").count() and models.model_findings(rows(spark), {}, {}).count() == 0
    (tmp_path / "m.json").write_text('{"format": "other"}')
    with pytest.raises(ValueError):
        models.load_trees(f"{tmp_path}/m.json")
    empty = models.with_logs(rows(spark).limit(0), ["loc", "noise"])
    assert models.out_of_fold(empty, models.candidates(["loc", "noise"], "y")["logistic"], "repo", 3).count() == 0
