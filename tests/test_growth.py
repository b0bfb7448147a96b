"""What grows with the input is dealt out, joined without broadcasts, and worked on in bounded pieces."""

from __future__ import annotations

import pytest
from lintel import queries  # isort: skip  (the other lists register with it)
from lintel import finding_queries, source_queries
from lintel.functions import c_code, copies, java_code, python_code
from lintel.operators import structure, versions
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("make", [finding_queries.python_sources, finding_queries.c_sources, finding_queries.rule_java_sources, source_queries.java_sources, queries.written_sources], ids=lambda f: f.__name__)
def test_sources_are_made_in_many_tasks(spark, make):
    found = make(spark, SMALL)
    sizes = [len(x) for x in found.rdd.glom().collect()]
    assert len(sizes) > 2 and max(sizes) <= 2 * min(sizes) and sum(sizes) == spark.read.parquet(f"{SMALL}/part.parquet").count()


def test_copies_are_analysed_once():
    calls = []

    def make(*texts):
        calls.append(texts)
        yield from [(len(t),) for t in texts]

    rows = copies.remembered(make, 16 * 600)
    assert [rows(t) for t in ("ab", "c", "ab", "c")] == [[(2,)], [(1,)], [(2,)], [(1,)]] and len(calls) == 2
    assert rows("x" * 600) == rows("x" * 600) and len(calls) == 4  # too long to keep
    for i in range(100):
        rows(str(i))
    assert rows("ab") == [(2,)] and len(calls) == 105  # it started anew meanwhile


def test_frames_hold_the_rows_of_many_texts():
    made = list(copies.framed(([(i, j) for j in range(3)] for i in range(10)), ["a", "b"], {"b": "Int32"}, least=7))
    assert [len(x) for x in made] == [9, 9, 9, 3] and [tuple(r) for x in made for r in x.to_numpy()] == [(i, j) for i in range(10) for j in range(3)]
    assert list(copies.framed([], ["a"])) == []


def test_versions_are_joined_without_broadcast(spark):
    files = spark.createDataFrame([(1, "c", "int f(int a)\n{\n return 0;\n}\n", "int f(int a)\n{\n return 1;\n}\n")], "k int, language string, before string, after string")
    found = versions.version_similarity(files, ["k"])
    assert "Broadcast" not in plan(found) and round(found.first()["similarity"], 6) == 1.0


@pytest.mark.parametrize("code", [c_code, python_code])
def test_references_are_joined_without_broadcast(spark, code):
    rows = spark.createDataFrame([("r", "p", "checked", "s", "low", "f", 1, 1, 1, "d")], "repository string, path string, kind string, smell string, severity string, name string, line int, end_line int, value int, detail string")
    assert "Broadcast" not in plan(code.all_findings(rows))


def test_types_in_types_however_deep(spark):
    """The type of the innermost class's field counts for every one of the eleven around it."""
    text = "".join(f"class C{i} {{\n" for i in range(12)) + "Deep d;\n" + "}\n" * 12
    files = spark.createDataFrame([(1, text)], "k int, text string")
    declared = java_code.java_declarations(files, ["k"])
    found = structure.type_names(declared, ["k"])
    assert found.filter("distinct_types = 1").count() == 12


def test_features_of_classes_have_no_broadcast_of_a_table(spark):
    files = spark.createDataFrame([(1, "class A { int a; int b() { return a; } class B { C c; } }")], "k int, text string")
    declared = java_code.java_declarations(files, ["k"])
    sizes = structure.span_sizes(structure.token_sums(java_code.java_tokens(files, ["k"]), ["k"]), declared.select("k", "id", "first", "last"), ["k"])
    found = structure.class_features(declared, sizes, ["k"])
    assert "Broadcast" not in plan(found) and "Broadcast" not in plan(sizes)
    assert {(r["name"], r["distinct_types"], r["fields"], r["tokens"]) for r in found.collect()} == {("A", 1, 1, 23), ("B", 1, 1, 7)}


def test_trees_come_in_few_frames(spark):
    from lintel.functions import syntax_trees

    files = spark.range(100).select(F.col("id").cast("string").alias("path"), F.lit("python").alias("language"), F.lit("a = 1\n").alias("text"))
    assert syntax_trees.nodes(files).groupBy("path").count().filter("count = 5").count() == 100


def test_archives_are_written_from_a_stream(spark, tmp_path):
    """No task holds the texts of an archive: the plan has no grouped function, and archives hold all of their members in order."""
    import zipfile

    from lintel.sources import archives

    files = spark.range(500).select((F.col("id") % 3).alias("a"), F.concat(F.lit("d/"), F.col("id"), F.lit(".py")).alias("path"), F.col("id").cast("string").alias("text"))
    made = archives.write_archives(files, str(tmp_path), "a")
    assert "FlatMapGroups" not in plan(made)
    assert {(r["archive"].rsplit("/")[-1], r["members"]) for r in made.collect()} == {("0.zip", 167), ("1.zip", 167), ("2.zip", 166)}
    for k in range(3):
        with zipfile.ZipFile(tmp_path / f"{k}.zip") as z:
            assert z.namelist() == sorted(f"d/{i}.py" for i in range(k, 500, 3)) and z.read(f"d/{k + 3}.py") == str(k + 3).encode()


def test_pairs_are_counted_in_more_tasks_if_there_are_more(spark, monkeypatch):
    from lintel.operators import joins

    seen = {}
    keep = joins.written
    monkeypatch.setattr(joins, "written", lambda df, name: seen.setdefault(name, df) and keep(df, name))
    rows = spark.range(400).select((F.col("id") % 40).alias("k"), F.floor(F.col("id") / 40).alias("i"))
    assert joins.frequent_pairs(rows, "k", "i", 2, task=200).count() == 780
    assert "hashpartitioning(first" in plan(seen["basket-pairs"]) and ", 39)" in plan(seen["basket-pairs"])


def test_counts_of_a_map_are_made_once(spark):
    """The cosine of two maps names each of them once, however many keys they have."""
    from lintel.functions import scalars

    rows = spark.createDataFrame([({"x": 3, "y": 4}, {"x": 3.0}), ({}, {}), ({"x": 1}, {}), ({"x": None}, {"x": 2.0}), (None, {"x": 1.0})], "a map<string,int>, b map<string,double>")
    found = rows.select(F.round(scalars.cosine_counts(F.map_concat("a", F.create_map(F.lit("q"), F.lit(0))), F.col("b")), 6).alias("c"), scalars.cosine_counts(F.col("a"), F.col("b")).alias("d"))
    assert plan(found).count("map_concat(") == 1
    assert [(r["c"], r["d"] and round(r["d"], 6)) for r in found.collect()] == [(0.6, 0.6), (0.0, 1.0), (0.0, 0.0), (0.0, 0.0), (0.0, 0.0)]
