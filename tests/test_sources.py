"""Source trees, archives, reports, findings in code, sinks and streams."""

from __future__ import annotations

import io
import json
import zipfile

import pytest
from lintel.functions import c_code, python_code
from lintel.plans import quality
from lintel.sources import files, sinks
from lintel.streaming import jobs
from pyspark.sql import functions as F

LONG = "def long(a, b, c, d, e, f):\n" + "".join(f"    x{i} = {i + 10}\n" for i in range(32)) + "    return x0\n    print(1)\n"
CLASS = """
import os
LIMIT = 99
class Unused:
    def only(self, other):
        return other.a.b.c.d + other.e + other.f
def same_one(p, q, r):
    y = p
    if y:
        q(y)
    return r
def same_two(p, q, r):
    z = p
    if z:
        q(z)
    return r
try:
    same_one(1, 2, 3)
except:
    pass
"""
C_TEXT = """#include <stdio.h>
int counter = 0;
static int unused(int a) { return a + 42; } /* strcpy( */
int deep(int a, int b, int c, int d, int e, int f) {
  for (;;) { if (a) { while (b) { if (c) { gets("x { y"); } } } }
  return 0x1F;
}
"""


@pytest.fixture()
def tree(tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules" / "x").mkdir(parents=True)
    (tmp_path / "builder").mkdir()
    (tmp_path / "src" / "long.py").write_text(LONG)
    (tmp_path / "src" / "klass.py").write_text(CLASS)
    (tmp_path / "src" / "bad.py").write_text("def (:\n")
    (tmp_path / "src" / "a.c").write_text(C_TEXT)
    (tmp_path / "src" / "latin.py").write_bytes(b"# caf\xe9\n")
    (tmp_path / "src" / "note.txt").write_text("no source")
    (tmp_path / "node_modules" / "x" / "y.py").write_text("x = 1\n")
    (tmp_path / "builder" / "z.py").write_text("x = 1\n")
    return str(tmp_path)


def test_source_tree(spark, tree):
    rows = {r["path"]: r for r in files.source_tree(spark, tree).collect()}
    assert sorted(rows) == ["src/a.c", "src/bad.py", "src/klass.py", "src/latin.py", "src/long.py"]
    assert rows["src/latin.py"]["text"] == "# caf\ufffd\n" and rows["src/a.c"]["language"] == "c"
    assert {(r["folder"], r["files"]) for r in files.folders(files.source_tree(spark, tree)).collect()} == {("src", 5)}


def test_python_findings():
    found = {(r[1], r[3]) for r in python_code.rows_of(LONG) if r[0] == "finding"}
    assert {("LongMethod", "long"), ("TooManyParameters", "long"), ("UnreachableCode", "long"), ("UnusedVariable", "long"), ("MagicNumber", "long")} <= found
    smells = [r[1] for r in python_code.rows_of(CLASS) if r[0] == "finding"]
    assert {"BareExcept", "MessageChains", "LazyClass", "FeatureEnvy"} <= set(smells)
    assert "99" not in [r[7] for r in python_code.rows_of(CLASS) if r[1] == "MagicNumber"]


@pytest.mark.parametrize("lines,found", [(30, False), (31, True)])
def test_long_method_boundary(lines, found):
    text = "def f():\n" + '    """Says\n    what it does."""\n\n    # so\n' + "    pass\n" * lines  # the header, texts and comments don't count
    assert any(r[1] == "LongMethod" for r in python_code.rows_of(text)) == found


def test_c_text():
    masked = c_code.mask(C_TEXT)
    assert len(masked) == len(C_TEXT) and "strcpy" not in masked and "x { y" not in masked
    found = c_code.functions_of(masked)
    assert [(f["name"], f["parameters"]) for f in found] == [("unused", 1), ("deep", 6)]
    assert c_code.control_depth(found[1]["body"]) == 4 and c_code.brace_depth("{{}{{}}}") == 3
    assert [c_code.number_value(t) for t in ("0x1F", "010", "5f", "1.5e3", "7UL", "1_000", "09")] == [31.0, 8.0, 5.0, 1500.0, 7.0, 1000.0, None]
    smells = {(r[1], r[3]) for r in c_code.rows_of("a.c", C_TEXT, "c") if r[0] == "finding"}
    assert {("DeadCode", "unused"), ("DeepNesting", "deep"), ("TooManyParameters", "deep"), ("UnsafeFunctionUsage", "gets"), ("GlobalVariable", "counter"), ("MagicNumber", "unused")} <= smells
    assert c_code.split_top("a, f(b, c), d[e, f]") == ["a", " f(b, c)", " d[e, f]"] and c_code.parameter_count("void") == 0


RULES = """
from abc import ABC
import json
def loose(a, b):
    kept = 1
    total = 0
    total += a
    hint: int
    def inner():
        lost = kept
        return b
    _gone = 5
    _ = 6
    for i in a:
        continue
        b(i)
        b(7 * 3600)
    return json.loads(a).x.y.replace(1).strip()
class BaseThing: pass
class Thing(BaseThing): pass
class LonelyMixin: pass
class Oops(Exception): pass
class Record:
    a: int
    b: str = "x"
    c: float
    def __init__(self, other):
        self.d: bool = other._init
    def __eq__(self, other):
        return other._d == self.d
    def go(self, x=40, y=(41, 42)):
        assert x != 43
        MAX_SIZE = 44
        return x._hidden > 45
@loose
def decorated(): pass
"""


def test_python_rules():
    rows = [r for r in python_code.rows_of(RULES) if r[0] == "finding"]
    of = lambda smell: [(r[3], r[7]) for r in rows if r[1] == smell]
    assert of("UnusedVariable") == [("loose", "_gone"), ("inner", "lost"), ("go", "MAX_SIZE")]
    assert [r[5] - r[4] for r in rows if r[1] == "UnreachableCode"] == [0, 0] and {r[2] for r in rows if r[1] == "UnreachableCode"} == {"low"}
    assert of("MessageChains") == []
    assert {n for n, _ in of("LazyClass")} == {"Thing"} and [(r[2], r[6]) for r in rows if r[1] == "PrimitiveObsession"] == [("medium", 4)]
    assert of("InappropriateIntimacy") == [("Record", "_hidden")]
    assert sorted(d for _, d in of("MagicNumber")) == ["45", "5", "6", "7"]
    checked = {r[3] for r in python_code.rows_of(RULES) if r[0] == "checked"}
    assert checked == {"loose", "inner", "BaseThing", "Thing", "LonelyMixin", "Oops", "Record"}
    assert {r[3] for r in python_code.rows_of(RULES) if r[0] == "abstract"} == {"BaseThing", "LonelyMixin"}


def test_dead_code_of_one_repository(spark):
    rows = [("r", "a.py", "def f(): pass\n"), ("r", "b.py", "from a import f\n"), ("s", "a.py", "def f(): pass\nclass OneMixin: pass\n")]
    df = spark.createDataFrame(rows, "repo string, path string, text string")
    found = python_code.all_findings(python_code.analyse(df, repository="repo")).collect()
    assert {(r["repository"], r["smell"], r["name"]) for r in found} == {("s", "DeadCode", "f"), ("s", "DeadCode", "OneMixin"), ("s", "SpeculativeGenerality", "OneMixin")}


def test_c_and_java_rules(spark):
    body = "{ if (a) { } for (;;) { } switch (a) { case 1: break; } try { } catch (E e) { } int b = a ? 1 : 2; }"
    assert (c_code.complexity(body, "c"), c_code.complexity(body, "java")) == (5, 5)
    assert c_code.split_top("Map<A, B> m, int x") == ["Map<A", " B> m", " int x"]
    text = "#define N 77\nint twice(int a);\nint twice(int a) { return a * 60; }\nint used(void) { return 7; }\nint main(void) { const int k = 9; int t[] = {3, 5}; switch (k) { case 6: used(); } return used() - 8; }\n"
    rows = list(c_code.rows_of("x/a.c", text, "c"))
    assert [(r[3], r[7]) for r in rows if r[1] == "MagicNumber"] == [("used", "7"), ("main", "8")]
    df = spark.createDataFrame([("r", "a.c", "c", text), ("r", "b.c", "c", "int f(void) { return twice(1); }"), ("s", "a.c", "c", text)], "repo string, path string, language string, text string")
    found = c_code.all_findings(c_code.analyse(df, repository="repo")).filter("smell = 'DeadCode'").collect()
    assert {(r["repository"], r["name"]) for r in found} == {("r", "f"), ("s", "twice")}
    assert c_code.comment_lines("/* Copyright */\n/** doc\n */\n// a\nint x; /* b\nc */\n") == 3


def slowest(texts, language):
    import time

    start = time.thread_time()
    for text in texts:
        list(c_code.rows_of("a." + language, text, language))
    return time.thread_time() - start


@pytest.mark.parametrize("language", ["c", "java"])
def test_long_files_take_time_in_proportion(language):
    """Ten thousand functions, classes, open bodies, type words, calls: four times the text takes about four times as long."""
    kinds = [
        lambda n: "".join(f"int f{i}(int a) {{ int b = a; b++; return b + 7; }}\n" for i in range(n)),
        lambda n: "int f(int a) { f(a); return 7; }\n" * n,
        lambda n: "".join(f"class C{i} {{ void m{i}() {{ }} }}\n" for i in range(n)),
        lambda n: "class C {\n" * n,
        lambda n: "".join(f"int f{i}(int a) {{\n" for i in range(n)),
        lambda n: "int " * n,
        lambda n: "f(" * n,
        lambda n: "gets(" * n + "int a(int b);\n" * n,
        lambda n: "/*" * n + "\"" * n,
        lambda n: "int" + " *" * n + " x[" + "[" * n,
    ]
    for make in kinds:
        assert slowest([make(10_000)], language) < 8 * slowest([make(2_500)], language) + 0.5


def test_c_numbers_that_name_themselves():
    text = """enum { A = 5, B = 6 };
static int limits[] = {7, 8};
int f(int a) {
    const int k = 9; int MAX_ROWS = 11; int t[12]; int u[3][13] = {{14, 15}, {16}};
    mkdir("x", 0755); int mode = 0644; assert(a == 17); EXPECT_EQ(a, 18);
    switch (a) { case -19: break; case (20): break; }
    int s = a * 60, h = 3600 / a, d = a + 3600;
    return a - -21 + (-22) * a;
}
"""
    assert [r[7] for r in c_code.rows_of("a.c", text, "c") if r[1] == "MagicNumber"] == ["0644", "3600", "-21", "-22"]
    assert [r[7] for r in c_code.rows_of("test_a.c", text, "c") if r[1] == "MagicNumber"] == []


def test_c_globals_and_prototypes():
    text = "#define X int y = 1; \\\n int z;\nunsigned long *p[4] = 0;\nextern int e;\nint internal = 5;\nint g(int a);\nchar *gets(char *s);\nint used(void) { int local; return g(1); }\n"
    rows = [(r[1], r[3]) for r in c_code.rows_of("a.h", text, "c") if r[0] == "finding"]
    assert rows == [("GlobalVariable", "p"), ("GlobalVariable", "internal")]


def test_java_classes_hold_their_own_methods():
    inner = "class Inner {\n" + "void m() { }\n" * 16 + "}\n"
    text = "class Outer {\n Outer() { }\n @Override public String toString() throws A, B { return x; }\n" + inner + "void last() { }\n}\n"
    assert [(r[3], r[6]) for r in c_code.rows_of("A.java", text, "java") if r[1] == "LargeClass"] == [("Inner", 16)]
    assert [f["name"] for f in c_code.functions_of(text)][:2] == ["toString", "m"]


def test_python_clumps_once_a_pair():
    text = "def f(a, b, c): pass\ndef g(a, b, c): pass\ndef h(a, b, c, d): pass\ndef i(d, c, b): pass\nclass K:\n def f(self, x, y, z): pass\n def g(self, x, y, z): pass\n"
    assert [(r[3], r[7]) for r in python_code.rows_of(text) if r[1] == "DataClumps"] == [("f", "a,b,c"), ("h", "b,c,d")]


def test_quality_report(spark, tree):
    source = files.source_tree(spark, tree)
    found, facts = quality.findings(source)
    smells = {(r["path"], r["smell"], r["name"]) for r in found.collect()}
    assert ("src/klass.py", "DeadCode", "Unused") in smells and ("src/klass.py", "DuplicateCode", "same_one") in smells
    assert any(s[1] == "DataClumps" for s in smells) and not any(s[1] == "DeadCode" and s[2] == "same_one" for s in smells)
    reports = {r["path"]: r for r in quality.file_report(source, found, facts).collect()}
    assert reports["src/bad.py"]["error"] and reports["src/bad.py"]["score"] is None
    assert reports["src/latin.py"]["score"] == 100.0 and reports["src/long.py"]["score"] < 100
    total = quality.repository_report(quality.file_report(source, found, facts)).first()
    assert total["files"] == 5 and 0 < total["score"] < 100


def test_archives(spark):
    def packed(members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for k, v in members.items():
                z.writestr(k, v)
        return out.getvalue()

    df = spark.createDataFrame([("ok", packed({"top/a.py": "x", "top/b.txt": "y"})), ("bad", b"no zip"), ("slip", packed({"../e.py": "x"})), ("none", None)], "name string, content binary")
    broken = bytearray(packed({"a.py": "print('a text that is long enough to be packed, packed, packed')" * 9, "b.py": "y"}))
    broken[45:60] = b"\xff" * 15
    locked = bytearray(packed({"a.py": "x"}))
    locked[6] |= 1  # marked as encrypted
    locked[locked.index(b"PK\x01\x02") + 8] |= 1
    df = df.unionByName(spark.createDataFrame([("broken", bytes(broken)), ("locked", bytes(locked)), ("bomb", packed({"a.py": " " * 3_000_000, "b.py": "z"}))], df.schema))
    rows = {(r["name"], r["path"]): r for r in files.archive_members(df, largest_member=2_000_000).collect()}
    assert rows["ok", "a.py"]["text"] == "x" and rows["bomb", "b.py"]["text"] == "z" and rows["broken", "b.py"]["text"] == "y"
    assert rows["broken", "a.py"]["error"] and rows["locked", "a.py"]["error"] and "large" in rows["bomb", "a.py"]["error"]
    assert rows["bad", None]["error"] and rows["slip", "../e.py"]["error"] and rows["none", None]["error"]


def test_reviews(spark, tmp_path):
    text = "\ufeff" + ";".join(files.REVIEW_COLUMNS) + "\n1;r;c;p.java;a.B#m x;function;long method;major;3;9;l\n1;r;c;p.java;a.B#m x;function;long method;none;3;x;l\n;r;c;q;;;;;;;\n2;r;c;p.java;a.B;class;blob;;1;2;l\n"
    path = tmp_path / "reviews.csv"
    path.write_text(text, encoding="utf-8")
    rows = files.reviews(spark, str(path))
    assert rows.count() == 3 and rows.filter("end_line IS NULL").count() == 1
    assert files.detect_format(spark, str(path)) == "reviews"
    assert {(r["sample_id"], r["label"]) for r in files.voted(rows).collect()} == {("1", 0), ("2", 1)}
    assert files.unique_files(rows).count() == 1


def test_reports(spark):
    smell = {"type": "LongMethod", "severity": "HIGH", "line": 4}
    many = json.dumps({"files": [{"file": "a.py", "relative_path": "src\\a.py", "language": "python", "quality_score": 92.0, "code_smells": [smell, {"type": "X"}]}]})
    single = json.dumps({"file": "b.py", "code_smells": [smell]})
    df = spark.createDataFrame([(many,), (single,), ("junk",), (None,)], "j string")
    rows = {r["id"]: r for r in files.findings(files.reports(df, "j")).collect()}
    assert set(rows) == {"src/a.py:4:0", "src/a.py:0:1", "b.py:4:0"}
    assert rows["src/a.py:4:0"]["severity"] == "high" and rows["src/a.py:0:1"]["severity"] == "low"


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "log")
    df = spark.createDataFrame([("k", 1, "a"), ("j", 1, "b")], "key string, t int, v string")
    sinks.append(df, path)
    sinks.append(spark.createDataFrame([("k", 2, "c")], df.schema), path)
    assert {(r["key"], r["v"]) for r in sinks.current(spark, path, ["key"], "t", "v").collect()} == {("k", "c"), ("j", "b")}
    assert sinks.append_new(df.withColumn("key", F.concat("key", F.lit("x"))).unionByName(df), path, ["key"]).count() == 2
    assert sinks.delete_where(spark, path, "key = 'k'") == 2 and spark.read.parquet(path).count() == 3
    sinks.export_csv(df, str(tmp_path / "csv"), [F.col("key")])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    assert sinks.markdown(df).count("\n") == 3


def test_streams(spark, tmp_path):
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    rows = [("d1", "j1", "2024-01-01 00:00:00", "queued"), ("d1", "j1", "2024-01-01 00:00:00", "queued"), ("d2", "j1", "2024-01-01 00:05:00", "done")]
    df = spark.createDataFrame(rows, "delivery_id string, job string, ts string, status string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(source)
    stream = jobs.unique_deliveries(spark.readStream.schema(df.schema).parquet(source))
    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(jobs.apply_batch(log, ["job"], "ts", "delivery_id")).start()
    query.awaitTermination()
    latest = jobs.state(spark, log).collect()
    assert [(r["job"], r["status"]) for r in latest] == [("j1", "done")]
    counts = jobs.window_counts(df, "ts", "10 minutes", "1 hour", ["job"]).collect()
    assert [r["n"] for r in counts] == [3]
    assert spark.range(1).select(jobs.next_stage(F.lit("plan")), jobs.next_stage(F.lit("done")), jobs.next_stage(F.lit("x"))).first()[:] == ("approve", None, None)
    table = spark.createDataFrame([("a", "in_progress", 0), ("b", "in_progress", 4), ("c", "done", 1)], "id string, status string, attempts int").withColumn("due", F.to_timestamp(F.lit("2024-01-01")))
    after = {r["id"]: (r["status"], r["attempts"]) for r in jobs.retry(table, table.filter("id <> 'c'")).collect()}
    assert after == {"a": ("queued", 1), "b": ("failed", 5), "c": ("done", 1)}


def test_updates_by_new_versions(spark, tmp_path):
    path = f"{tmp_path}/log"
    sinks.append(spark.createDataFrame([("a", "queued", 1, 0), ("b", "done", 1, 1)], "id string, status string, t int, tie int"), path)
    now = lambda: {r["id"]: r["status"] for r in sinks.current(spark, path, ["id"], "t", "tie").collect()}
    assert sinks.update_rows(spark, path, ["id"], "t", "tie", "status = 'queued'", {"status": "it's"}, 2) == 1
    assert now() == {"a": "it's", "b": "done"} and spark.read.parquet(path).count() == 3
    assert not sinks.compare_and_set(spark, path, ["id"], "t", "tie", {"id": "a"}, {"status": "queued"}, {"status": "x"}, 3)
    assert sinks.compare_and_set(spark, path, ["id"], "t", "tie", {"id": "a"}, {"status": "it's"}, {"status": "x"}, 3) and now()["a"] == "x"


def test_feature_table(spark, tmp_path):
    (tmp_path / "f.csv").write_text("sample_id,fingerprint,x\n10,p,1\n9,p,2\n3,q,3\n,r,4\n")
    rows = {r["fingerprint"]: r["x"] for r in files.feature_table(spark, f"{tmp_path}/f.csv").collect()}
    assert rows == {"p": 2, "q": 3, "r": 4}


def test_polling(spark, tmp_path):
    spark.createDataFrame([(1,), (2,)], "id int").write.parquet(f"{tmp_path}/in")
    seen = []
    events = spark.readStream.schema("id int").parquet(f"{tmp_path}/in")
    query = jobs.poll(events, lambda batch, _: seen.extend(r["id"] for r in batch.collect()), f"{tmp_path}/point", once=True)
    query.awaitTermination(60)
    assert sorted(seen) == [1, 2]
