"""Queries of findings: a source file for each part, made of as many pieces as its numbers say, and the findings in SQL from the numbers alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.functions import c_code, python_code, python_scopes
from lintel.operators import moves
from lintel.plans import quality
from lintel.queries import query
from lintel.session import dealt, table, written

def numbers() -> tuple[Column, Column]:
    """A part's key and size, from which its file is made."""
    return F.col("p_partkey"), F.col("p_size")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and sizes, dealt out before texts are made of them."""
    return dealt(table(spark, sf_dir, "part").select(*numbers()))


def text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def times(n: Column, make) -> Column:
    """make(0) ... make(n - 1), one behind the other."""
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n.cast("int") - 1), make), "")).otherwise("")


def pick(key: Column, options: list[Column]) -> Column:
    found = F.lit(None).cast("string")
    for i, o in enumerate(options):
        found = F.when(key == i, o).otherwise(found)
    return found


def repeated(piece: str, n: Column) -> Column:
    return F.repeat(F.lit(piece), n.cast("int"))


def python_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen kinds of files by the part's key, each for one rule."""
    key, size = numbers()
    three = "    def a(self): pass\n    def b(self): pass\n    def c(self): pass\n"
    options = [
        text("def main(", F.array_join(F.transform(F.sequence(F.lit(0), (size % 9).cast("int")), lambda i: text("p", i)), ", "), "):\n    pass\n"),
        text("def main(a):\n    if a == 0:\n        pass\n", repeated("    elif a == 1:\n        pass\n", size % 7)),
        text("def main(a):\n    return a", repeated(".b()", size % 6), "\n"),
        text("def main(a):\n    return a\n", repeated("    a()\n", size % 4)),
        text("def main(a):\n", times(size % 4, lambda i: text("    v", i, " = a\n")), "    return a\n"),
        text("def main(a):\n    try:\n        a()\n    except", F.when(size % 2 == 0, " ValueError").otherwise(""), ":\n        pass\n"),
        text("def main(a):\n    return a + ", size, "\n"),
        text("class K:\n", times(size % 20 + 1, lambda i: text("    def m", i, "(self): pass\n")), "print(K)\n"),
        text("class K:\n", times(size % 7, lambda i: text("    f", i, ": int = 0\n")), three, "print(K)\n"),
        text("def main(a):\n    pass\n", repeated("    a()\n", size % 5), "def run(a):\n    pass\n", repeated("    a()\n", size % 5)),
        text("def main(a, b, c): pass\ndef run(z, b, ", F.when(size % 2 == 0, "c").otherwise("d"), ", a): pass\n"),
        text("class K:\n", three, "    def go(self, other): return self.a + self.b", times(size % 6, lambda i: text(" + other.x", i)), "\nprint(K)\n"),
        text("class K:\n", three, "    def go(self, other): return other.", F.when(size % 2 == 0, "_").otherwise(""), "x\nprint(K)\n"),
        text("class BaseK:\n", three, F.when(size % 2 == 0, "print(BaseK)\n").otherwise("")),
        text(repeated("x = a\n", F.lit(20)), repeated("# why\n", size)),
        text("def used(): pass\n", times(size % 3, lambda i: text("def spare", i, "(): pass\n")), "used()\n"),
    ]
    return parts(spark, sf_dir).select(key, key.alias("repository"), F.lit("src/code.py").alias("path"), F.lit("python").alias("language"), pick(key % 16, options).alias("text"))


@query(
    """WITH p AS (SELECT p_partkey AS k, p_size AS s, p_partkey % 16 AS kind FROM part)
SELECT k, 'TooManyParameters' AS smell, 'medium' AS severity, 'main' AS name, s % 9 + 1 AS value FROM p WHERE kind = 0 AND s % 9 + 1 > 5
UNION ALL SELECT k, 'SwitchStatements', 'medium', 'main', s % 7 FROM p WHERE kind = 1 AND s % 7 >= 4
UNION ALL SELECT k, 'MessageChains', 'low', 'main', s % 6 FROM p WHERE kind = 2 AND s % 6 >= 3
UNION ALL SELECT k, 'UnreachableCode', 'low', 'main', NULL FROM (SELECT k, s, unnest(range(s % 4)) FROM p WHERE kind = 3)
UNION ALL SELECT k, 'UnusedVariable', 'low', 'main', NULL FROM (SELECT k, unnest(range(s % 4)) FROM p WHERE kind = 4)
UNION ALL SELECT k, 'BareExcept', 'medium', 'main', NULL FROM p WHERE kind = 5 AND s % 2 = 1
UNION ALL SELECT k, 'MagicNumber', 'low', 'main', NULL FROM p WHERE kind = 6 AND s > 2
UNION ALL SELECT k, 'LargeClass', 'high', 'K', s % 20 + 1 FROM p WHERE kind = 7 AND s % 20 + 1 > 15
UNION ALL SELECT k, 'LazyClass', 'low', 'K', s % 20 + 1 FROM p WHERE kind = 7 AND s % 20 + 1 <= 2
UNION ALL SELECT k, 'PrimitiveObsession', 'medium', 'K', s % 7 FROM p WHERE kind = 8 AND s % 7 >= 4
UNION ALL SELECT k, 'DuplicateCode', 'medium', 'main', 2 FROM p WHERE kind = 9 AND s % 5 + 1 >= 3
UNION ALL SELECT k, 'DataClumps', 'medium', 'main', 3 FROM p WHERE kind = 10 AND s % 2 = 0
UNION ALL SELECT k, 'FeatureEnvy', 'medium', 'go', s % 6 FROM p WHERE kind = 11 AND s % 6 >= 3
UNION ALL SELECT k, 'InappropriateIntimacy', 'medium', 'K', NULL FROM p WHERE kind = 12 AND s % 2 = 0
UNION ALL SELECT k, unnest(['SpeculativeGenerality', 'DeadCode']), 'low', 'BaseK', NULL FROM p WHERE kind = 13 AND s % 2 = 1
UNION ALL SELECT k, 'Comments', 'low', NULL, s FROM p WHERE kind = 14 AND 20 + s > 50 AND s / (20 + s) > 0.3
UNION ALL SELECT k, 'DeadCode', 'low', 'spare' || i, NULL FROM (SELECT k, unnest(range(s % 3)) AS i FROM p WHERE kind = 15)"""
)
def python_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of finding in Python, a part's file being a repository of its own."""
    rows = written(python_code.analyse(python_sources(spark, sf_dir), repository="repository"), "python-rules")
    return python_code.all_findings(rows).select(F.col("repository").cast("long").alias("k"), "smell", "severity", "name", "value")


def c_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = numbers()
    calls = ["gets", "strcpy", "strcat", "sprintf", "scanf", "snprintf"]
    call = F.element_at(F.array(*[F.lit(c) for c in calls]), (size % 6 + 1).cast("int"))
    body = repeated("    a();\n", size % 5)
    options = [
        text("int main(void) {\n", repeated("    f();\n\n    // none\n", size), "}\n"),
        text("int main(", F.array_join(F.transform(F.sequence(F.lit(0), (size % 9).cast("int")), lambda i: text("int (*p", i, ")(int, int)")), ", "), ") {\n}\n"),
        text("int main(int a) {\n    {\n    ", repeated("if (a) { ", size % 7), repeated("} ", size % 7), "}\n}\n"),
        text("int main(void) {\n    char *p = \"gets(p)\"; ", call, "(p); x.gets(p);\n}\n"),
        text(F.when(size % 2 == 0, "static unsigned").otherwise("extern"), " int g", size, "[3];\nint main(void) { int local = 0; return local; }\n"),
        text("static int one(int a) { return a; }\nint two(int a);\nint two(int a) { return two(a); }\nint main(void) { return ", F.when(size % 2 == 0, "one(1)").otherwise("0"), "; }\n"),
        text("int one(void) {\n", body, "}\nint two(void) {\n", body, "}\nint main(void) { one(); two(); }\n"),
        repeated("int f(void);\n", size * 10),
        text("#define N 77\nint main(int a) {\n    const int k = 9; int t[12]; t[0] = a * 60;\n    switch (a) { case 13: break; }\n    return a - ", size, ";\n}\n"),
    ]
    path = F.when(key % 9 == 7, "src/code.h").otherwise("src/code.c")
    return parts(spark, sf_dir).select(key, key.alias("repository"), path.alias("path"), F.lit("c").alias("language"), pick(key % 9, options).alias("text"))


@query(
    """WITH p AS (SELECT p_partkey AS k, p_size AS s, p_partkey % 9 AS kind FROM part)
SELECT k, 'LongFunction' AS smell, 'high' AS severity, 'main' AS name, s + 1 AS value FROM p WHERE kind = 0 AND s + 1 > 40
UNION ALL SELECT k, 'Comments', 'low', NULL, s FROM p WHERE kind = 0 AND 3 * s + 3 > 50 AND s / (3 * s + 3) > 0.3
UNION ALL SELECT k, 'TooManyParameters', 'medium', 'main', s % 9 + 1 FROM p WHERE kind = 1 AND s % 9 + 1 > 5
UNION ALL SELECT k, 'DeepNesting', 'high', 'main', s % 7 FROM p WHERE kind = 2 AND s % 7 > 3
UNION ALL SELECT k, 'UnsafeFunctionUsage', 'high', (['gets', 'strcpy', 'strcat', 'sprintf', 'scanf'])[s % 6 + 1], NULL FROM p WHERE kind = 3 AND s % 6 < 5
UNION ALL SELECT k, 'GlobalVariable', 'medium', 'g' || s, NULL FROM p WHERE kind = 4 AND s % 2 = 0
UNION ALL SELECT k, 'DeadCode', 'medium', 'one', NULL FROM p WHERE kind = 5 AND s % 2 = 1
UNION ALL SELECT k, 'DeadCode', 'medium', 'two', NULL FROM p WHERE kind = 5
UNION ALL SELECT k, 'DuplicateCode', 'medium', unnest(['one', 'two']), 2 FROM p WHERE kind = 6 AND s % 5 >= 3
UNION ALL SELECT k, 'LargeHeaderFile', 'medium', NULL, s * 10 + 1 FROM p WHERE kind = 7 AND s * 10 + 1 > 300
UNION ALL SELECT k, 'MagicNumber', 'low', 'main', NULL FROM p WHERE kind = 8 AND s NOT IN (1, 2, 16, 32)"""
)
def c_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of finding in C, a part's file being a repository of its own."""
    rows = written(c_code.analyse(c_sources(spark, sf_dir), repository="repository"), "c-rules")
    return c_code.all_findings(rows).select(F.col("repository").cast("long").alias("k"), "smell", "severity", "name", "value")


def rule_java_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = numbers()
    options = [
        text("class K {\n    void run() {\n", repeated("        f();\n", size), "    }\n}\n"),
        text("class K {\n    K() { }\n", times(size % 25, lambda i: text("    void m", i, "() { }\n")), "    static class In {\n        void x() { }\n    }\n}\n"),
        text("class K {\n    static final int A = 5;\n    int run(int a", times(size % 8, lambda i: text(", Map<A, B> p", i)), ") {\n        return a + ", size, ";\n    }\n    public int hashCode() { return 31; }\n}\n"),
    ]
    return parts(spark, sf_dir).select(key, key.alias("repository"), F.lit("src/K.java").alias("path"), F.lit("java").alias("language"), pick(key % 3, options).alias("text"))


@query(
    """WITH p AS (SELECT p_partkey AS k, p_size AS s, p_partkey % 3 AS kind FROM part)
SELECT k, 'LongMethod' AS smell, 'high' AS severity, 'run' AS name, s + 1 AS value FROM p WHERE kind = 0 AND s + 1 > 30
UNION ALL SELECT k, 'LargeClass', 'high', 'K', s % 25 FROM p WHERE kind = 1 AND s % 25 > 15
UNION ALL SELECT k, 'MagicNumber', 'low', 'run', NULL FROM p WHERE kind = 2 AND s > 2
UNION ALL SELECT k, 'TooManyParameters', 'medium', 'run', (s % 8) * 2 + 1 FROM p WHERE kind = 2 AND (s % 8) * 2 + 1 > 5"""
)
def java_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in Java; a comma between type arguments counts as one between parameters, as in the rule."""
    rows = written(c_code.analyse(rule_java_sources(spark, sf_dir), repository="repository"), "java-rules")
    return c_code.all_findings(rows).select(F.col("repository").cast("long").alias("k"), "smell", "severity", "name", "value")


@query(
    """WITH p AS (SELECT p_partkey AS k, p_size AS s FROM part),
py AS (SELECT k, CASE WHEN k % 16 = 6 AND s > 2 THEN 1 WHEN k % 16 = 3 THEN s % 4 WHEN k % 16 = 15 THEN s % 3 ELSE 0 END AS low, (k % 16 = 7 AND s % 20 + 1 > 15)::INT AS high FROM p WHERE k % 16 IN (3, 6, 7, 15)),
c AS (SELECT k, (k % 9 = 8 AND s NOT IN (1, 2, 16, 32))::INT AS low, (k % 9 = 2 AND s % 7 > 3)::INT AS high FROM p WHERE k % 9 IN (2, 8)),
l AS (SELECT k, 'src/code.py' AS path, low + (k % 16 = 7 AND k IN (SELECT k FROM p WHERE s % 20 + 1 <= 2))::INT AS low, high FROM py UNION ALL SELECT k, 'src/code.c', low, high FROM c)
SELECT k, path, low, high, greatest(0, 100 - low - 8 * high)::DOUBLE AS score FROM l"""
)
def repository_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of files of many repositories that have equal paths."""
    key, _ = numbers()
    files = python_sources(spark, sf_dir).filter((key % 16).isin(3, 6, 7, 15)).unionByName(c_sources(spark, sf_dir).filter((key % 9).isin(2, 8)))
    files = written(files, "rule-sources")
    found, facts = quality.findings(files, "repository")
    report = quality.file_report(files, found, facts, "repository")
    return report.select(F.col("repository").cast("long").alias("k"), "path", "low", "high", "score")


@query(
    """WITH p AS (SELECT p_partkey AS k, p_size AS s, p_size % 4 AS own, p_size % 6 AS others, p_partkey % 5 AS kind FROM part)
SELECT k, CASE WHEN reason IS NULL THEN CASE WHEN kind = 2 THEN 'Line' ELSE 'Order' END END AS destination, CASE WHEN others >= 2 AND others > own AND kind <> 4 THEN CASE WHEN kind = 2 THEN 'item' ELSE 'order' END END AS parameter, others AS accesses, own AS self_accesses, reason
FROM (SELECT *, CASE WHEN kind = 4 AND others >= 0 THEN 'NO_FEATURE_ENVY_EVIDENCE' WHEN others < 2 OR others <= own THEN 'NO_FEATURE_ENVY_EVIDENCE' WHEN kind = 1 THEN 'AMBIGUOUS_DESTINATION_CLASS' WHEN kind = 2 AND s % 2 = 1 THEN 'NO_VALID_DESTINATION_CLASS' WHEN kind = 3 AND s % 2 = 1 THEN 'CALL_SITE_REWRITE_FAILED' END AS reason FROM p)"""
)
def move_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A method of as many uses of another object and of its own as the part's numbers say; five kinds of evidence."""
    key, size = numbers()
    parameter = pick(key % 5, [F.lit("order"), F.lit('order: "Line"'), F.lit("item"), F.lit("order"), F.lit("order, more")])
    name = F.when(key % 5 == 2, "item").otherwise("order")
    uses = F.concat(times(size % 6, lambda i: F.concat(F.lit(" + "), name, F.lit(".x"), i.cast("string"))), F.when(key % 5 == 4, times(size % 6, lambda i: text(" + more.x", i))).otherwise(""))
    tail = pick(key % 5, [F.lit("Basket().move(Order())\n"), F.lit(""), F.when(size % 2 == 0, "b = Basket()\nline = Line()\nb.move(line)\n").otherwise(""), F.when(size % 2 == 0, "").otherwise("other.move(Order())\n"), F.lit("")])
    source = text("class Order: pass\nclass Line: pass\nclass Basket:\n    def move(self, ", parameter, "):\n        return 0", uses, times(size % 4, lambda i: text(" + self.y", i)), "\n", tail)
    files = parts(spark, sf_dir).select(key.cast("string").alias("repository"), F.lit("shop.py").alias("path"), source.alias("text"))
    facts = written(python_scopes.scopes(files), "scopes")
    found, _ = moves.destinations(facts)
    return found.select(F.col("repository").cast("long").alias("k"), "destination", "parameter", "accesses", "self_accesses", "reason")
