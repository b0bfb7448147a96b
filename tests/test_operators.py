"""Operators on small hand-made tables."""

from __future__ import annotations

import itertools
import random
from pathlib import Path

import numpy as np
import pytest
from lintel.functions import scalars
from lintel.operators import events, grouped, joins, metrics, ranking, recommendation, rollups, scoring, sets
from lintel.operators.windows import running_totals
from lintel.plans import evaluation, planning
from lintel.session import written
from pyspark.sql import functions as F


def one(spark, **columns):
    row = spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()
    return row.asDict()


def test_scalars(spark):
    lit = F.lit
    r = one(
        spark,
        path=scalars.normalize_path(lit(r"C:\project\\src\main.py")),
        lang=scalars.detect_language(lit("a/b/Main.java")),
        none=scalars.detect_language(lit("a.b/readme")),
        test=scalars.is_test_file(lit("src/OrderTest.java")),
        not_test=scalars.is_test_file(lit("src/Testing.java")),
        py_test=scalars.is_test_file(lit("x/test_y.py")),
        by_folder=scalars.is_test_file(lit("tests/x.py")),
        severity=scalars.normalize_severity(lit(" HIGH ")),
        other=scalars.normalize_severity(lit("blocker")),
        method=scalars.entity_name(lit("a.b.C#run int"), lit("method")),
        klass=scalars.entity_name(lit("a.b.C"), lit("class")),
        name=scalars.normalize_name(lit("Extract-Method!")),
        zero=scalars.ratio(lit(1), lit(0)),
        zero0=scalars.ratio_or_zero(lit(1), lit(0)),
        nan=scalars.number(lit("NaN")),
        num=scalars.number(lit("1.5")),
        text=scalars.number(lit("x")),
        empty=scalars.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")),
        half=scalars.jaccard(F.array(lit("a"), lit("b")), F.array(lit("b"), lit("c"), lit("b"))),
        cos=scalars.cosine(F.array(lit(1.0), lit(0.0)), F.array(lit(1.0), lit(0.0))),
        cos0=scalars.cosine(F.array(lit(0.0)), F.array(lit(1.0))),
        counts=scalars.cosine_counts(F.create_map(lit("a"), lit(1)), F.create_map(lit("a"), lit(2))),
        near=scalars.count_similarity(lit(3), lit(4)),
        wait=scalars.backoff_seconds(lit(3)),
        most=scalars.backoff_seconds(lit(20)),
        ids=scalars.id_ranges(F.array(*[lit(i) for i in (3, 1, 2, 7)])),
        lines=scalars.line_summary(F.array(*[lit(i) for i in (9, 1, 1, 2, 3, 4, 5)])),
        scale=scalars.score_scale(lit(75.0)),
        when=scalars.minutes_between(scalars.parse_time(lit("2024-01-01T00:00:00Z")), scalars.parse_time(lit("2024-01-01T01:30:00Z"))),
        never=scalars.parse_time(lit("soon")),
    )
    assert r["path"] == "project/src/main.py" and (r["lang"], r["none"]) == ("java", None)
    assert (r["test"], r["not_test"], r["py_test"], r["by_folder"]) == (True, False, True, False)
    assert (r["severity"], r["other"]) == ("high", "low")
    assert (r["method"], r["klass"], r["name"]) == ("run", "C", "extract method")
    assert (r["zero"], r["zero0"], r["nan"], r["num"], r["text"]) == (None, 0.0, None, 1.5, None)
    assert (r["empty"], r["half"], r["cos"], r["cos0"], r["near"]) == (1.0, 1 / 3, 1.0, 0.0, 0.75)
    assert r["counts"] == pytest.approx(1.0)
    assert (r["wait"], r["most"], r["ids"], r["lines"]) == (120.0, 900.0, "1-3, 7", "1, 2, 3, 4, 5 and 1 more")
    assert r["scale"].asDict() == {"value": 0.75, "basis": "hundred"} and r["when"] == 90.0 and r["never"] is None


def test_confusion_rates(spark):
    rows = [(1, 1)] * 10 + [(0, 1)] * 2 + [(1, 0)] * 3 + [(0, 0)] * 85
    df = spark.createDataFrame(rows, "y int, p int")
    r = metrics.with_rates(metrics.confusion(df, F.col("y"), F.col("p"))).first()
    assert (r["precision"], r["recall"], r["accuracy"]) == (round(10 / 12, 6), round(10 / 13, 6), 0.95)
    none = metrics.with_rates(metrics.confusion(df.limit(0), F.col("y"), F.col("p"))).first()
    assert none["f1"] is None and none["accuracy"] is None
    zero = metrics.with_rates(metrics.confusion(df.limit(0), F.col("y"), F.col("p")), zero=True).first()
    assert zero["f1"] == 0.0


def test_macro_micro(spark):
    df = spark.createDataFrame([(10, 2, 2, 50), (5, 5, 0, 50)], "tp long, fp long, fn long, tn long")
    r = metrics.macro_micro(df).first()
    assert r["macro_f1"] == 0.75 and r["micro_precision"] == round(15 / 22, 6) and r["micro_recall"] == round(15 / 17, 6)


def test_quality_score(spark):
    df = spark.createDataFrame([("a", s) for s in ("high", "medium", "low", "unknown")] + [("b", "high")] * 20 + [("c", None)], "f string, s string")
    assert {r["f"]: r["score"] for r in rollups.quality_score(df, ["f"], F.col("s")).collect()} == {"a": 85.0, "b": 0.0, "c": 100.0}


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, descending):
    values = random.Random(1).sample(range(1000), 200)
    df = spark.createDataFrame([(v, v % 7) for v in values], "k int, v int")
    got = {r["k"]: r["run_v"] for r in running_totals(df, "k", ["v"], descending).collect()}
    total = 0
    for k in sorted(values, reverse=descending):
        total += k % 7
        assert got[k] == total


def test_lines_match(spark):
    rows = [("function", 10, 40, 14, 42, True), ("function", 10, 40, 30, 70, True), ("function", 10, 40, 46, 60, False), ("class", 10, 40, 39, 90, True), ("class", 10, 40, 51, 90, False), ("function", None, None, 5, 6, True), ("function", 10, 0, 15, 0, True)]
    df = spark.createDataFrame(rows, "kind string, a int, b int, c int, d int, want boolean")
    for r in df.withColumn("got", joins.lines_match(*[F.col(x) for x in ("kind", "a", "b", "c", "d")])).collect():
        plain = [float("nan") if r[x] is None else float(r[x]) for x in "abcd"]
        plain[1] = plain[1] if plain[1] else plain[0]
        assert r["got"] == r["want"] == bool(grouped.line_window(r["kind"], plain[0], plain[1], np.array([plain[2]]), np.array([plain[3]]))[0])


def test_overlap_edges_against_all_pairs(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 2), i, s := rng.randint(0, 300), s + rng.randint(0, 90)) for i in range(80)]
    df = spark.createDataFrame(rows, "f int, i int, s int, e int")
    got = {(r["a"], r["b"]): r["overlap"] for r in joins.overlap_edges(df, ["f"], "i", "s", "e", 40).collect()}
    want = {(a[1], b[1]): min(a[3], b[3]) - max(a[2], b[2]) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and a[3] >= b[2] and b[3] >= a[2]}
    assert got == want


def test_similar_pairs_against_all_pairs(spark):
    rng = random.Random(5)
    rows = [(i, [f"t{rng.randint(0, 14)}" for _ in range(rng.randint(0, 10))]) for i in range(60)]
    df = spark.createDataFrame([("x", *r) for r in rows], "g string, k int, t array<string>")
    got = {(r["first"], r["second"]) for r in joins.similar_pairs(df, ["g"], "k", F.col("t"), 0.5).collect()}
    assert got == {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if set(a[1]) and len(set(a[1]) & set(b[1])) >= 0.5 * len(set(a[1]) | set(b[1]))}


@pytest.mark.parametrize("postings", [500_000, 200])
def test_similar_pairs_leave_few_to_be_joined(spark, monkeypatch, postings):
    """Sets that share rare tokens but little else are excluded before pairs are written, in one part of an index and in many."""
    rng, rows = random.Random(6), []
    for i in range(300):
        rows.append((i, [f"t{x}" for x in rng.sample(range(400), 40)]) if i % 10 else (i, [*rows[-1][1][:36], f"u{i}"] if i else ["a"]))
    made = {}
    monkeypatch.setattr(joins, "written", lambda df, name: made.setdefault(name, written(df, name)))
    monkeypatch.setattr(joins, "POSTINGS", postings, raising=False)
    df = spark.createDataFrame([(g, i + 1000 * n, t) for n, g in enumerate(["x", "y", None]) for i, t in rows], "g string, k int, t array<string>")
    got = {(r["first"], r["second"]) for r in joins.similar_pairs(df, ["g"], "k", F.col("t"), 0.6).collect()}
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if len(set(a[1]) & set(b[1])) >= 0.6 * len(set(a[1]) | set(b[1]))}
    assert len(want) == 29 and got == want | {(a + 1000, b + 1000) for a, b in want}
    assert made["token-pairs"].count() <= 2 * len(got)


def test_similar_pairs_move_no_tokens_of_lone_sets(spark, monkeypatch):
    """Sets without a near one are written and shuffled as sketches only, which take less than a third of their tokens' bytes."""
    made, jvm = [], spark.sparkContext._jsc.sc()

    def shuffled():
        jvm.listenerBus().waitUntilEmpty(30_000)
        return jvm.statusStore().executorSummary("driver").totalShuffleWrite()

    monkeypatch.setattr(joins, "written", lambda df, name: made.append(written(df, name)) or made[-1])
    ids = F.transform(F.sequence(F.lit(0), F.lit(299)), lambda i: F.concat(F.pmod(F.xxhash64(i, F.col("id")), F.lit(4000)), F.lit("")))
    df = written(spark.range(3000).select(F.lit("x").alias("g"), F.col("id").alias("k"), ids.alias("t")), "test-sets")
    before = shuffled()
    assert joins.similar_pairs(df, ["g"], "k", F.col("t"), 0.6).collect() == []
    of_tables = sum(x.stat().st_size for t in made for x in Path(t.written_at.removeprefix("file://")).glob("*.parquet"))
    assert made and shuffled() - before + of_tables < 3000 * 300 * 8 / 3


@pytest.mark.parametrize(("block", "pairs"), [(1 << 18, 1 << 20), (500, 30)])
def test_similar_pairs_in_blocks(spark, monkeypatch, block, pairs):
    """Sets of 1 to 900 tokens with near and exact copies, in one block of a group and in many; rows of one key are told apart, and a set without tokens has no partner."""
    rng, rows = random.Random(8), []
    for i in range(300):
        t = [f"t{x}" for x in rng.sample(range(1200), rng.choice([1, 2, 5, 20, 60, 130, 300, 900]))]
        if i % 3 == 2:
            old = rng.choice(rows)[2]
            t = [*old[: rng.randint(len(old) // 2, len(old))], *t[: rng.choice([0, 0, 1, len(old) // 3])]]
        rows.append((rng.choice("xxy"), i // 2 if i < 40 else i, t))
    monkeypatch.setattr(joins, "BLOCK", block, raising=False)
    monkeypatch.setattr(joins, "PAIRS", pairs, raising=False)
    df = spark.createDataFrame([*rows, ("x", 900, None), ("x", None, ["t1"]), (None, 901, ["t1"])], "by string, k int, t array<string>")
    got = sorted(tuple(r) for r in joins.similar_pairs(df, ["by"], "k", F.col("t"), 0.6).collect())
    want = []
    for (g, a, s), (h, b, t) in itertools.combinations(rows, 2):
        common, total = len(set(s) & set(t)), len(set(s) | set(t))
        if g == h and a != b and total and 10 * common >= 6 * total:
            want.append((g, min(a, b), max(a, b), round(common / total, 6)))
    assert len(want) > 100 and got == sorted(want)


def test_hybrid_merge(spark):
    rules = spark.createDataFrame([("A", 1, 10, 20), ("A", 2, 15, 30), ("B", 3, 1, 5)], "smell string, id int, start int, end int")
    model = spark.createDataFrame([("A", 11, 16, 0.9), ("A", 12, 99, 0.7)], "smell string, id int, line int, score double")
    rows = {(r["id"], r["source"]) for r in joins.hybrid_merge(rules, model, ["smell"]).collect()}
    assert rows == {(1, "rule+ml"), (2, "rule"), (3, "rule"), (12, "ml")}


def test_paths_and_imports(spark):
    files = spark.createDataFrame([("a/b/x.py",), ("a/y.py",), ("c/y.py",), ("lib/__init__.py",)], "path string")
    named = spark.createDataFrame([("x.py",), ("y.py",), ("q/z.py",)], "f string")
    assert sorted(r["f"] for r in joins.restore_paths(named, "f", files, "path").collect()) == ["a/b/x.py", "q/z.py", "y.py"]
    imports = spark.createDataFrame([("a/y.py", "b.x"), ("a/y.py", "lib"), ("a/y.py", "os")], "src string, module string")
    assert {(r["module"], r["dst"]) for r in joins.resolve_imports(imports, files).collect()} == {("b.x", "a/b/x.py"), ("lib", "lib/__init__.py")}


def test_greedy_match_uses_each_prediction_once(spark):
    truth = spark.createDataFrame([("k", 1, "function", "f", 10, 20, 0), ("k", 2, "function", "f", 12, 20, 1), ("k", 3, "function", "g", 90, 95, 2), ("z", 4, "class", "", 1, 2, 3)], "key string, id int, kind string, name string, start int, end int, pos int")
    found = spark.createDataFrame([("k", 10, "f", 13, 20, 0), ("k", 11, "fx", 11, 20, 1), ("y", 12, "q", 1, 2, 2)], "key string, pid int, name string, start int, end int, pos int")
    rows = {(r["key"], r["id"], r["pid"]) for r in grouped.greedy_match(truth, found, ["key"]).collect()}
    assert rows == {("k", 1, 10), ("k", 2, 11), ("k", 3, None), ("z", 4, None), ("y", None, 12)}


def brute_matches(truth, found):
    """The rule, one pair at a time."""
    used, out = set(), []
    for kind, name, start, end in truth:
        hit = None
        for i, (other, a, b) in enumerate(found):
            fits = np.isnan(start) or np.isnan(a) or ((start <= a <= end or abs(start - a) <= 10) if kind == "class" else (abs(start - a) <= 5 or start <= b and a <= end))
            if i not in used and fits and grouped.names_match(name, other):
                hit = i
                used.add(i)
                break
        out.append(hit)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_matching_against_one_pair_at_a_time(seed):
    rng = random.Random(seed)
    line = lambda: float("nan") if rng.random() < 0.1 else float(rng.randint(1, 150))
    span = lambda: (a := line(), a + rng.randint(0, 30))
    truth = [(rng.choice(["class", "function"]), rng.choice(["", "f", "fg"]), *span()) for _ in range(40)]
    found = [(rng.choice(["", "f", "xfgy", "q"]), *span()) for _ in range(rng.randint(0, 40))]
    assert grouped.matched(truth, found) == brute_matches(truth, found)


@pytest.mark.parametrize("seed", range(4))
def test_knapsacks_are_optimal(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 9) for _ in range(30)]
    bounds = np.cumsum([0, *sizes])
    values = np.array([float(rng.randint(-3, 20)) for _ in range(bounds[-1])])
    costs = np.array([rng.randint(0, 30) for _ in range(bounds[-1])])
    chosen = grouped.knapsacks(values, costs, bounds, 20)
    for a, b in zip(bounds, bounds[1:]):
        items = range(a, b)
        best = max(sum(values[i] for i in c) for n in range(len(items) + 1) for c in itertools.combinations(items, n) if sum(costs[i] for i in c) <= 20)
        got = [i for i in items if chosen[i]]
        assert sum(values[i] for i in got) == best and sum(costs[i] for i in got) <= 20 and all(values[i] > 0 for i in got)


def test_groups_come_whole(spark):
    """Groups that lie across batches, long ones and null keys included."""
    rows = [(None if g == 3 else g, i, 1.0, 1) for g in range(40) for i in range(900 if g == 7 else g % 5 + 1)]
    df = spark.createDataFrame(rows, "g int, i int, v double, c int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = grouped.choose(df, "g", "i", "v", "c", 1000).groupBy("g").count().collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["g"]: r["count"] for r in got} == {(None if g == 3 else g): 900 if g == 7 else g % 5 + 1 for g in range(40)}


def test_sequencing(spark):
    assert grouped.ordered_steps(["Move", "Extract", "Rename"], [1, 2, 0], {"Move": {"Extract"}}) == [3, 2, 1]
    # one applied step of a needed kind is enough
    assert grouped.ordered_steps(["Move", "Extract", "Extract"], [0, 1, 2], {"Move": {"Extract"}}) == [2, 1, 3]
    assert grouped.ordered_steps(["Move", "Extract", "Rename"], [1, 2, 0], {"Move": {"Extract"}, "Extract": {"Move"}}) == [None, None, 1]
    df = spark.createDataFrame([("p", "a", "Move", 0, 0), ("p", "b", "Extract", 1, 1), ("q", "c", "Move", 0, 0), ("q", "d", None, None, 1)], "plan string, id string, action string, rank int, pos int")
    rows = {(r["plan"], r["id"]): r["step"] for r in grouped.sequence_steps(df, "plan", [("Move", "Extract")]).collect()}
    assert rows == {("p", "a"): 2, ("p", "b"): 1, ("q", "c"): 1, ("q", "d"): 2}


def test_bootstrap():
    assert grouped.bootstrap_f1((1, 1, 1, 1)) == (0.5, None, None)
    value, low, high = grouped.bootstrap_f1((60, 20, 20, 100))
    assert low < value < high and grouped.bootstrap_f1((60, 20, 20, 100)) == (value, low, high)


def test_latest_supersede_upsert(spark):
    df = spark.createDataFrame([("k", 1, "queued"), ("k", 2, "queued"), ("j", 1, "done")], "key string, t int, status string")
    assert {(r["key"], r["t"]) for r in ranking.latest_per_key(df, ["key"], "t", "status").collect()} == {("k", 2), ("j", 1)}
    assert {(r["t"], r["status"]) for r in ranking.supersede(df, ["key"], "t", "t", "status").collect() if r["key"] == "k"} == {(1, "superseded"), (2, "queued")}
    new = spark.createDataFrame([("k", 2, "new"), ("m", 1, "new")], df.schema)
    assert {(r["key"], r["status"]) for r in sets.upsert(df, new, ["key"], "t").collect()} == {("k", "new"), ("j", "done"), ("m", "new")}
    assert [r["key"] for r in sets.get_or_create(df, new, ["key"]).collect()] == ["m"]


def test_funnel_keeps_empty_stages(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "u int, s string")
    rows = [tuple(r)[1:] for r in events.funnel(df, [F.col("u")], "s", ["a", "x", "b"]).orderBy("pos").collect()]
    assert rows == [("a", 2, 1.0, None), ("x", 0, 0.0, 0.0), ("b", 1, 0.5, None)]


CATALOGUE = [("LongMethod", "Extract Method", "low", "low", "high", 0, [("lines", 20.0)]), ("LongMethod", "Inline", "low", "low", "high", 1, []), ("DeadCode", "Remove", "low", "low", "medium", 0, [])]
CATALOGUE_SCHEMA = "smell string, refactoring string, complexity string, risk string, impact string, pos int, preconditions array<struct<metric: string, least: double>>"


def test_plan(spark):
    findings = spark.createDataFrame(
        [("p", "1", "LongMethod", "medium", "f", {"lines": 40.0}, 0), ("p", "2", "LongMethod", "high", "g", {"lines": 5.0}, 1), ("p", "3", "DeadCode", "low", "f", {}, 2), ("p", "4", "LongMethod", "low", "h", {}, 3)],
        "plan string, id string, smell string, severity string, entity string, metrics map<string, double>, pos int",
    )
    rows = planning.plan(findings, spark.createDataFrame(CATALOGUE, CATALOGUE_SCHEMA), ["Remove"], [("Extract Method", "Remove")]).orderBy("step").collect()
    assert [(r["id"], r["refactoring"]) for r in rows] == [("2", "Inline"), ("3", "Remove"), ("4", "Extract Method")]


def test_evaluation(spark):
    truth = spark.createDataFrame([("py", "a", "S", 1, "function", "f", 1, 9, 0, 1), ("py", "a", "S", 2, "function", "g", 50, 60, 1, 0), ("py", "b", "S", 3, "class", "C", 1, 2, 2, 1)], "language string, path string, smell string, id int, kind string, name string, start int, end int, pos int, label int")
    found = spark.createDataFrame([("py", "a", "S", 7, "f", 2, 9, 0), ("py", "c", "S", 8, "q", 2, 9, 1)], "language string, path string, smell string, pid int, name string, start int, end int, pos int")
    rows = {(r["language"], r["smell"]): r for r in evaluation.evaluate(evaluation.outcomes(truth, found)).collect()}
    assert [rows[None, None][c] for c in ("tp", "fp", "fn", "tn")] == [1, 1, 1, 1]


def test_scores(spark):
    r = one(
        spark,
        base=scoring.base_score(F.lit("low"), F.lit("low"), F.lit("high")),
        criteria=scoring.criteria_score(F.lit("low"), F.lit("low"), F.lit("high")),
        known=scoring.magnitude(F.lit(60), F.lit(20)),
        unknown=scoring.magnitude(F.lit(None).cast("int"), F.lit(20)),
        risk=scoring.change_risk(F.lit("medium"), F.lit(1), F.lit(True)),
        spread=scoring.change_risk(F.lit("low"), F.lit(4), F.lit(False)),
        manual=recommendation.category(F.lit(95), F.lit("advisory"), F.lit(True), F.lit("low")),
        unknown_fix=recommendation.category(F.lit(95), F.lit("unknown"), F.lit(True), F.lit("low")),
        risky=recommendation.category(F.lit(95), F.lit("executable"), F.lit(True), F.lit("high")),
        margin=recommendation.selection_margin(F.lit(0.8), F.array().cast("array<double>")),
    )
    assert r["base"] == pytest.approx(3.0) and r["criteria"] == pytest.approx(0.925)
    assert (r["known"], r["unknown"], r["risk"]["value"], r["risk"]["band"]) == (1.0, 0.5, 0.5, "medium")
    assert (r["spread"]["value"], r["spread"]["band"]) == (0.39, "medium")  # 0.2 * 1.45 * 1.35
    assert (r["manual"], r["unknown_fix"], r["risky"], r["margin"]) == ("manual_only", "not_recommended", "review", 0.5)
