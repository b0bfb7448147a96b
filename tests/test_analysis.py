"""Statistics, folds, fitted models as expressions, paths, preconditions, versions and references on small tables."""

from __future__ import annotations

import math
import random

import pytest
from lintel.operators import joins, models, preconditions, sets, statistics, versions
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import ChiSquareTest
from pyspark.sql import functions as F


def test_chi_squared_equals_the_library(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 4), rng.randint(0, 1), float(rng.randint(0, 3))) for _ in range(400)]
    df = spark.createDataFrame(rows, "a int, b int, y double")
    vectors = VectorAssembler(inputCols=["a"], outputCol="v").transform(df)
    want = ChiSquareTest.test(vectors, "v", "y").first()
    found = {r["column"]: r for r in statistics.chi_squared(df.withColumn("b", F.when(F.col("b") > 0, F.col("b"))).withColumn("c", F.lit(1)), ["a", "b", "c"], "y").collect()}
    assert found["a"]["freedom"] == want["degreesOfFreedom"][0] and found["a"]["statistic"] == pytest.approx(want["statistics"][0]) and found["a"]["p"] == pytest.approx(want["pValues"][0])
    assert (found["b"]["freedom"], found["c"]["freedom"], found["c"]["p"]) == (3, 0, None)
    four = spark.createDataFrame([("x", "p")] * 8 + [("x", "q")] * 2 + [("y", "p")] * 1 + [("y", "q")] * 5, "a string, y string")
    row = statistics.chi_squared(four, ["a"], "y").first()
    assert row["statistic"] == pytest.approx(16 * (8 * 5 - 2 * 1 - 8) ** 2 / (10 * 6 * 9 * 7)) and row["p"] == pytest.approx(math.erfc(math.sqrt(row["statistic"] / 2)))


def test_correlations(spark):
    df = spark.createDataFrame([(1, 2.0, None), (2, 4.0, 1.0), (3, 6.0, 0.0), (4, None, 5.0)], "a int, b double, c double")
    found = {(r["a"], r["b"]): r["correlation"] for r in statistics.correlations(df, ["a", "b", "c"]).collect()}
    assert found["a", "b"] == pytest.approx(1) and found["b", "c"] == pytest.approx(-1)
    assert statistics.largest(statistics.correlations(df, ["a", "b", "c"])).first()["a"] == "a"


def test_folds_have_their_share_of_each_class(spark):
    rng = random.Random(4)
    rows = [(f"g{g}", str(rng.choices("ab", (1 + g % 7, 3))[0])) for g in range(120) for _ in range(rng.randint(1, 30))] + [(None, "a"), ("g1", None)]
    df = spark.createDataFrame(rows, "repo string, y string")
    found = sets.stratified_folds(df, "repo", "y", 5, repeats=2).collect()
    fold = {(r["group"], r["repeat"]): r["fold"] for r in found}
    assert len(fold) == 2 * 121 and {k: v for k, v in fold.items() if k[1] == 0} != {(g, 0): f for (g, r), f in fold.items() if r == 1}
    for repeat in (0, 1):
        share = [[0, 0] for _ in range(5)]
        for g, y in rows:
            if y:
                share[fold[g or "", repeat]]["ab".index(y)] += 1
        whole = sum(a for a, _ in share) / sum(a + b for a, b in share)
        assert all(abs(a / (a + b) - whole) < 0.05 for a, b in share)
    many = sets.stratified_folds(df, "repo", "y", 5, part=10).collect()
    assert len(many) == 121 and {r["fold"] for r in many} == set(range(5))
    assert sets.stratified_folds(df.filter("1 = 0"), "repo", "y").count() == 0
    assert sets.dealt([("a", {"x": 4}), ("b", {"x": 2, "y": 2}), ("c", {"y": 3}), ("d", {})], 2) == [0, 1, 0, 1]


@pytest.fixture(scope="module")
def parts(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice").cast("double")
    return df.select(F.col("p_brand").alias("repo"), size.alias("size"), price.alias("price"), ((size * 7 + F.col("p_partkey") % 23 > 190) | (price > 1000)).cast("int").alias("y")).cache()


@pytest.mark.parametrize("kind", ["boosted", "forest"])
def test_fitted_models_as_expressions(spark, parts, kind, tmp_path):
    features = ["size", "price"]
    stage = GBTClassifier(featuresCol="raw", labelCol="y", maxIter=8, maxDepth=4, seed=1) if kind == "boosted" else RandomForestClassifier(featuresCol="raw", labelCol="y", numTrees=12, maxDepth=6, seed=1)
    model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw"), stage]).fit(parts)
    models.export_trees(f"{tmp_path}/m.json", {"X": models.fitted_classifier(model, features)})
    again = models.load_trees(f"{tmp_path}/m.json")["X"]
    both = model.transform(parts).select(vector_to_array("probability")[1].alias("p"), models.score_of(again, {f: F.col(f) for f in features}).alias("q"))
    assert both.filter(F.abs(F.col("p") - F.col("q")) > 1e-6).count() == 0 and both.select("q").distinct().count() > 3
    found = models.model_findings(parts, models.load_trees(f"{tmp_path}/m.json"), {f: F.col(f) for f in features})
    assert found.count() == both.filter("p >= 0.5").count()


def test_comparison_and_winner(spark, parts):
    raw = VectorAssembler(inputCols=["size"], outputCol="raw")
    fit = {"good": Pipeline(stages=[raw, RandomForestClassifier(featuresCol="raw", labelCol="y", numTrees=5, seed=1)])}
    rows = models.compared(parts, fit, "y", "repo", 3)
    found = {r["model"]: r for r in rows.collect()}
    assert set(found) == {"good", "majority"} and found["good"]["auc"] > 0.8 and found["good"]["rows"] == parts.count()
    assert models.winner(rows) == "good"
    worse = spark.createDataFrame([("a", 0.4, 0.9, 9), ("majority", 0.1, 0.9, 9)], "model string, auc double, accuracy double, rows long")
    assert models.winner(worse) == "majority"


def test_paths_by_their_ends(spark):
    files = spark.createDataFrame([(3, "ws\\a\\src\\B\\x.py"), (1, "ws/b/src/b/x.py"), (2, "/x.py"), (4, "c/X.py"), (5, None)], "pos int, file string")
    asked = spark.createDataFrame([("Src/B/x.py",), ("src/b/x.py",), ("rc/b/x.py",), ("x.py",), ("X.py",), ("q/b/x.py",), (None,), ("",)], "asked string")
    whole = {r["asked"]: r["match"] for r in joins.match_paths(asked, files, "asked", "file", "pos").collect()}
    assert whole == {"Src/B/x.py": "ws/b/src/b/x.py", "src/b/x.py": "ws/b/src/b/x.py", "rc/b/x.py": None, "x.py": "ws/b/src/b/x.py", "X.py": "c/X.py", "q/b/x.py": None, None: None, "": None}
    most = {r["asked"]: (r["match"], r["depth"]) for r in joins.match_paths(asked, files, "asked", "file", "pos", whole=False).collect()}
    assert most["q/b/x.py"] == ("ws/b/src/b/x.py", 2) and most["rc/b/x.py"][1] == 2
    plan = joins.match_paths(asked, files, "asked", "file", "pos")._jdf.queryExecution().toString()
    assert "Nested" not in plan and "Cartesian" not in plan and "EndsWith" not in plan


def test_preconditions_have_three_values(spark):
    rows = [({"parameter_count": 2.0, "lines_of_code": 0.0}, {"method": "unknown"}, [3, 4]), ({}, {}, None), (None, {"entity": "f", "superclass": "B"}, [3, 9])]
    df = spark.createDataFrame(rows, "metrics map<string,double>, location map<string,string>, lines array<int>")
    truths = df.select(preconditions.truth(preconditions.Finding(F.col("metrics"), F.col("location"), F.col("lines"))).alias("t")).collect()
    first, second, third = (r["t"] for r in truths)
    assert first == {"has_multiple_parameters": False, "has_parent_class": False, "is_class_method": False, "has_code_block": False}
    assert second == {"has_parent_class": False, "is_class_method": False} and third == {"has_parent_class": True, "is_class_method": True, "has_code_block": True}
    names = F.array(F.lit("has_multiple_parameters"), F.lit("nobody knows"))
    t = preconditions.truth(preconditions.Finding(F.col("metrics"), F.col("location"), F.col("lines")), {"nobody knows": preconditions.unknown})
    got = df.select(preconditions.holds(names, t), preconditions.failing(names, t), preconditions.holds(F.lit(None).cast("array<string>"), t)).collect()
    assert [tuple(r) for r in got] == [(False, ["has_multiple_parameters"], True), (True, [], True), (True, [], True)]


def test_versions_of_odd_files(spark):
    rows = [(1, "java", "class A { int f(int a) { } }", "class A { int f(int a) { } }"), (2, "java", None, ""), (3, "java", "a", None), (4, "c", "int f(void) { return 1; }", "int f() { }"), (5, "c", "", "int f(int a) { for (;;) ; }"), (6, "ruby", "x", "x")]
    files = spark.createDataFrame(rows, "n int, language string, before string, after string")
    got = {r["n"]: round(r["similarity"], 6) for r in versions.version_similarity(files, ["n"]).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 0.4, 4: 0.8, 5: 0.3}


def test_versions_are_measured_in_their_row(spark):
    """No shuffle of tokens; rows of one key, or without one, have measures of their own."""
    rows = [(1, "java", "a a b (", "a b b ("), (1, "java", "x", "y"), (None, "java", "class A x", "class B x"), (2, "c", "#define A 1\nint f(void) { return 1; }", "#define A 2\nint f() { if (1) return 1; }")]
    found = versions.version_similarity(spark.createDataFrame(rows, "n int, language string, before string, after string"), ["n"])
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted(((r["n"], round(r["similarity"], 6)) for r in found.collect()), key=repr)
    assert got == [(1, 0.4), (1, round(0.6 * 5 / 6 + 0.4, 6)), (2, 0.85), (None, round(0.6 * 2 / 3 + 0.4, 6))]


def test_references_by_word(spark):
    files = spark.createDataFrame([("a", "Foo foo Foo. Bar"), ("b", "Foo"), ("c", "xFoo Foo_ Bar"), ("d", None)], "path string, text string")
    entities = spark.createDataFrame([("Foo", "a"), ("Foo", "z"), ("Bar", "c"), ("ab", "a"), ("a.b", "a"), (None, "a")], "name string, own string")
    got = {(r["name"], r["own"]): r["blast_radius"] for r in joins.token_references(entities, "name", files, "path", "text", "own").collect()}
    assert got == {("Foo", "a"): 2, ("Foo", "z"): 3, ("Bar", "c"): 2, ("ab", "a"): 1, ("a.b", "a"): 1, (None, "a"): 1}


def test_dead_code_steps_stay(spark):
    rows = [("p", "e", "Extract", 1, "DeadCode"), ("p", "e", "Move", 2, "LongMethod"), ("p", "e", "Remove", 3, None), ("q", "e", "Move", 1, "LongMethod")]
    steps = spark.createDataFrame(rows, "plan string, entity string, action string, pos int, smell string")
    kept = sets.prune_conflicts(steps, "plan", "entity", "action", "pos", ["Remove"], smell="smell").collect()
    assert sorted((r["plan"], r["pos"]) for r in kept) == [("p", 1), ("p", 3), ("q", 1)]
