"""Java declarations, their features by class, and sizes of spans."""

from __future__ import annotations

from lintel.functions import java_code
from lintel.operators import structure
from pyspark.sql import functions as F

SOURCE = """package a.b;
import java.util.*;
@Entity(name = "x") public abstract class Outer<T extends Comparable<T>> extends Base implements A, B<T> {
    private static final int MAX = 5, MIN = 1;
    private List<Map<String, T>> items = new ArrayList<>();
    protected String name;
    static { MAXIMUM = 7; }
    public Outer(String name, int... n) { super(n); this.name = name; }
    @Override public String getName() { return name; }
    public void setName(final String name) { this.name = name; }
    abstract void todo(int a);
    void work(Other other, int k) throws E, F {
        int a = 1, b = k; String s = other.getX().trim().toLowerCase();
        for (int i = 0; i < k; i++) { if (a > b && k != 0) { items.add(s); } else if (b == 2) return; else { other.y = 3; } }
        for (T t : list) helper.run(t);
        do { a += 1; } while (a < 10);
        while (true) { try { Thread.sleep(MAX); } catch (Exception e) { throw new RuntimeException(e); } finally { a = b; } }
        switch (k) { case 1: case 2: work(other, 1); break; default: this.todo(2); }
        Runnable r = () -> { this.name = "q"; foo(); };
        boolean z = a > b ? true : false;
        Other.STATIC.go(); int q = Other.CONST + other.field + this.items.size();
    }
    enum Kind { ONE(1) { void f() { } }, TWO; private int v; Kind() { } int v() { return v; } }
    interface Inner { int f(int x); default void g() { f(1); } }
}
class Second { int p; }
"""


def test_declarations_and_parents():
    rows = list(java_code.rows_of(SOURCE))
    names = {r[0]: r[3] for r in rows}
    assert [(r[2], r[3], names.get(r[1])) for r in rows if r[2] not in ("field",)] == [
        ("class", "Outer", None), ("constructor", "Outer", "Outer"), ("method", "getName", "Outer"), ("method", "setName", "Outer"), ("method", "todo", "Outer"), ("method", "work", "Outer"),
        ("enum", "Kind", "Outer"), ("constructor", "Kind", "Kind"), ("method", "v", "Kind"), ("interface", "Inner", "Outer"), ("method", "f", "Inner"), ("method", "g", "Inner"), ("class", "Second", None),
    ]
    assert [(r[3], r[9]) for r in rows if r[2] == "field"] == [("MAX", ["private", "static", "final"]), ("MIN", ["private", "static", "final"]), ("items", ["private"]), ("name", ["protected"]), ("v", ["private"]), ("p", [])]
    assert (rows[0][9], rows[0][10], rows[0][11], rows[0][12]) == (["public", "abstract"], ["Entity"], 1, 2)
    assert [(r[6], r[7]) for r in rows if r[3] == "work"] == [(12, 22)]


def test_counts_of_a_body():
    (row,) = [r for r in java_code.rows_of(SOURCE) if r[3] == "work"]
    counts = {k: v for k, v in row[14].items() if v}
    assert counts | {"statements": 0} == {
        "statements": 0, "local_vars": 8, "branches": 5, "loops": 4, "switch_cases": 2, "try": 1, "catch": 1, "returns": 1, "throws": 1, "assignments": 4, "bool_ops": 1, "lambdas": 1, "object_creations": 1, "method_calls": 11, "max_chain": 3,
        "max_nesting": 2, "complexity": 12, "own_calls": 3, "foreign_calls": 8, "foreign_accessor_calls": 1, "calls_on_params": 1, "calls_on_fields": 1, "calls_on_types": 2, "own_field_access": 4, "foreign_field_access": 2, "static_refs": 1,
    }
    assert row[15] == {"other": 3, "items": 1, "helper": 1} and row[16] == ["MAX", "items", "name"]
    assert {"Other", "String", "Exception", "RuntimeException", "T", "Runnable"} <= set(row[17]) and not {"Thread", "MAX"} & set(row[17])


def test_class_features_and_spans(spark):
    files = spark.createDataFrame([("x", SOURCE), ("y", ""), ("z", "class Open { void f() { if (a"), ("n", None)], "path string, text string")
    declared = java_code.java_declarations(files, ["path"]).cache()
    sums = structure.token_sums(java_code.java_tokens(files, ["path"]), ["path"])
    sizes = structure.span_sizes(sums, declared.select("path", "id", "name", "first", "last"), ["path"])
    rows = {(r["path"], r["name"]): r for r in structure.class_features(declared, sizes, ["path"]).collect()}
    assert set(rows) == {("x", "Outer"), ("x", "Kind"), ("x", "Inner"), ("x", "Second"), ("z", "Open")}
    outer = rows["x", "Outer"]
    assert (outer["methods"], outer["constructors"], outer["fields"], outer["inner_types"], outer["getters"], outer["setters"], outer["abstract_methods"], outer["overrides"]) == (4, 1, 4, 2, 1, 1, 1, 1)
    assert (outer["wmc"], outer["max_complexity"], outer["avg_complexity"], outer["foreign_targets"], outer["is_abstract"]) == (16, 12, 3.2, 3, 1)
    assert outer["cohesion"] == 1.0 and outer["using_fields_ratio"] == 1.0 and outer["weight_of_class"] == 0.0
    assert (rows["x", "Inner"]["public_methods"], rows["x", "Inner"]["is_nested"], rows["x", "Second"]["methods"]) == (2, 1, 0)
    spans = {r["name"]: r for r in sizes.filter("path = 'x'").collect()}
    assert (spans["getName"]["lines"], spans["getName"]["tokens"], spans["getName"]["sloc"], spans["work"]["sloc"]) == (1, 12, 1, 11)
    assert (spans["getName"]["identifiers"], spans["getName"]["literals"]) == (4, 0)


def test_long_java_files_take_time_in_proportion():
    import time

    def seconds(text):
        start = time.thread_time()
        list(java_code.rows_of(text))
        return time.thread_time() - start

    kinds = [
        lambda n: "class C { " + "void m(int a) { a = b.c(d); }\n" * n + "}",
        lambda n: "class C { " * n,
        lambda n: "class C { void m() { x" + ".y" * n + "; } }",
        lambda n: "class C { void m() { x" + ".y()" * n + "; } }",
        lambda n: "class C { void m() { " + "a = " * n + "1; } }",
        lambda n: "class C { int a" + ", a" * n + "; }",
        lambda n: "@A(" * n,
        lambda n: "class C { void m() { " + "case 1, " * n + "2: } }",
    ]
    for make in kinds:
        assert seconds(make(4000)) < 8 * seconds(make(1000)) + 0.5
