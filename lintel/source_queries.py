"""Queries of records, sources and code structure over the test tables, and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.finding_queries import parts
from lintel.functions import java_code
from lintel.operators import structure
from lintel.queries import query
from lintel.session import shared_dir, table, written
from lintel.sources import archives, records
from lintel.streaming import queue

# ---- Open records: an order is a report of one file, its items are findings with fields of their own

RECORD_SMELLS = ["LongMethod", "LargeClass", "MagicNumber", "", "DeadCode"]


def order_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON reports: an envelope, a repository's report or one file's, by the order's key."""
    items = table(spark, sf_dir, "lineitem")
    smell = F.element_at(F.array(*[F.lit(s) for s in RECORD_SMELLS]), (F.col("l_partkey") % len(RECORD_SMELLS) + 1).cast("int"))
    finding = F.struct(
        smell.alias("type"),
        F.when(F.col("l_returnflag") == "R", " HIGH").when(F.col("l_returnflag") == "A", "medium").otherwise("odd").alias("severity"),
        F.when(F.col("l_linenumber") > 1, F.col("l_linenumber") * 10).alias("line"),
        F.when(F.col("l_linestatus") == "O", F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int")).alias("end_line"),
        F.when(F.col("l_suppkey") % 3 > 0, F.concat(F.lit("e"), F.col("l_suppkey"))).alias("entity"),
        F.when(F.col("l_suppkey") % 2 > 0, F.col("l_quantity").cast("int")).alias("parameter_count"),
        F.struct(F.col("l_tax").alias("tax"), F.array("l_suppkey", "l_partkey").alias("keys")).alias("evidence"),
        F.concat(F.lit("note "), F.col("l_linenumber")).alias("note"),
    )
    per_order = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("x"), finding.alias("f")))).alias("items"))
    lines = F.size("items") * 100
    file = F.struct(
        F.concat(F.lit("src\\o"), F.col("l_orderkey"), F.lit(".java")).alias("relative_path"),
        F.struct(lines.alias("lines_of_code"), F.lit(3).alias("functions")).alias("metrics"),
        F.when(F.col("l_orderkey") % 4 > 0, F.lit(80.5)).alias("quality_score"),
        F.transform("items", lambda i: i["f"]).alias("code_smells"),
        F.lit("by hand").alias("reviewer"),
    )
    alone, many = F.to_json(file), F.concat(F.lit('{"repo_name":"r","files":['), F.to_json(file), F.lit(',"no object"]}'))
    shape = F.col("l_orderkey") % 3
    report = F.when(shape == 0, F.concat(F.lit('{"type":"repository","report":'), many, F.lit("}"))).when(shape == 1, many).otherwise(alone)
    return per_order.select("l_orderkey", report.alias("report"))


RECORDS_SQL = f"""i AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice) - 1 AS pos,
CASE WHEN l_linenumber > 1 THEN l_linenumber * 10 ELSE 0 END AS line, ({RECORD_SMELLS!r})[(l_partkey % 5 + 1)::INT] AS named,
CASE l_returnflag WHEN 'R' THEN 'high' WHEN 'A' THEN 'medium' ELSE 'low' END AS severity, 'e' || l_suppkey AS e, count(*) OVER (PARTITION BY l_orderkey) AS items FROM lineitem)"""


@query(
    f"""WITH {RECORDS_SQL}
SELECT l_orderkey, CASE WHEN l_orderkey % 3 = 2 THEN 'src\\o' || l_orderkey || '.java' ELSE 'r' END AS repository, 'src/o' || l_orderkey || '.java:' || line || ':' || pos AS id, CASE WHEN named = '' THEN 'Unknown' ELSE named END AS smell, severity,
CASE WHEN named = 'LargeClass' AND l_suppkey % 3 > 0 THEN e ELSE 'o' || l_orderkey END AS class, CASE WHEN named IN ('LongMethod', 'DeadCode') AND l_suppkey % 3 > 0 THEN e END AS method,
line AS start, CASE WHEN l_linestatus = 'O' THEN l_linenumber * 10 + l_quantity::INT ELSE line END AS end_line, 6 + (l_suppkey % 2) AS n_metrics, items * 100.0::DOUBLE AS lines,
CASE WHEN l_orderkey % 4 > 0 THEN 80.5 ELSE 100.0 END::DOUBLE AS score, CASE WHEN l_suppkey % 2 > 0 THEN l_quantity::INT::DOUBLE END AS parameters, l_tax AS tax, l_suppkey + l_partkey AS keys, 'note ' || l_linenumber AS note FROM i"""
)
def open_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the reports with their metrics; evidence and note are fields that the library knows nothing of."""
    flat = records.flat_findings(records.report_files(order_reports(spark, sf_dir), "report", ["l_orderkey"]), ["l_orderkey"])
    finding, metric = F.col("finding"), lambda k: F.try_element_at("metrics", F.lit(k))
    keys = records.get(finding, "$.evidence.keys", "array<long>")
    return flat.select(
        "l_orderkey", "repository", "id", "smell", "severity", "location.class", "location.method", F.col("location.lines")[0].alias("start"), F.col("location.lines")[1].alias("end_line"), F.size("metrics").alias("n_metrics"),
        metric("lines_of_code").alias("lines"), metric("quality_score").alias("score"), metric("parameter_count").alias("parameters"),
        records.get(finding, "$.evidence.tax", "double").alias("tax"), (keys[0] + keys[1]).alias("keys"), records.get(finding, "$.note", "string").alias("note"),
    )


@query(
    f"""WITH {RECORDS_SQL}
SELECT l_orderkey, count(*) FILTER (WHERE pos % 2 = 0) AS kept, count(*) FILTER (WHERE pos % 2 = 0 AND severity = 'high') AS high, max(items) * 100 AS lines, 'by hand' AS reviewer,
sum(l_tax) FILTER (WHERE pos % 2 = 0) AS tax, string_agg('note ' || l_linenumber, ',' ORDER BY pos) FILTER (WHERE pos % 2 = 0) AS notes, 'src/o' || l_orderkey || '.java' AS path FROM i GROUP BY l_orderkey"""
)
def narrowed_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second finding of each report is chosen; the written file is read again with all its fields."""
    files = written(records.report_files(order_reports(spark, sf_dir), "report", ["l_orderkey"]), "report-files")  # read three times, made once
    chosen = records.flat_findings(files, ["l_orderkey"]).filter("pos % 2 = 0").select("l_orderkey", "id")
    again = records.narrowed(files, chosen, ["l_orderkey"]).select("l_orderkey", F.size("kept").alias("kept"), F.parse_json("report").alias("v"))
    v = F.col("v")
    found = records.get(v, "$.code_smells", "array<variant>")
    return again.select(
        "l_orderkey", "kept", records.get(v, "$.smell_summary.high", "int").alias("high"), records.get(v, "$.metrics.lines_of_code", "int").alias("lines"), records.get(v, "$.reviewer", "string").alias("reviewer"),
        F.aggregate(found, F.lit(0.0), lambda a, f: a + records.get(f, "$.evidence.tax", "double")).alias("tax"),
        F.array_join(F.transform(found, lambda f: records.get(f, "$.note", "string")), ",").alias("notes"), records.get(v, "$.relative_path", "string").alias("path"),
    )


# ---- Archives: documents as source files in archives, read by member


@query(
    r"""SELECT doc_id, doc_id % 7 AS archive, length(text) AS chars, strlen(text)::BIGINT AS size, 'p' || (doc_id % 3) || '/d' || doc_id || '.py' AS path
FROM documents WHERE doc_id % 3 = 1 AND doc_id % 4 <> 0 AND text IS NOT NULL"""
)
def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven archives of documents; only the Python files of one folder are unpacked."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    key = F.col("doc_id")
    path = F.concat(F.lit("top/p"), key % 3, F.lit("/d"), key, F.when(key % 4 > 0, ".py").otherwise(".java"))
    folder = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    archives.write_archives(docs.select((key % 7).cast("int").alias("archive"), path.alias("path"), "text"), folder, "archive").count()
    found = archives.members(spark, folder).filter("path LIKE 'p1/%' AND language = 'python' AND error IS NULL")
    number = lambda c, pattern: F.regexp_extract(c, pattern, 1).cast("long")
    return found.select(number("path", r"/d(\d+)\.py$").alias("doc_id"), number("archive", r"(\d+)\.zip$").alias("archive"), F.char_length("text").alias("chars"), "size", "path")


# ---- A job queue: events of a user in a span of days are steps of a job

QUEUE_RULES = queue.Rules(lock_seconds=9 * 3600, most=2, first_wait=3600, longest_wait=5400)


@query(
    """WITH RECURSIVE e AS (SELECT user_id || '-' || (dayofmonth(ts) // 6) AS job, epoch(ts) AS t, event_id,
CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'view' THEN 'claim' WHEN 'click' THEN 'fail' WHEN 'purchase' THEN 'complete' ELSE 'claim' END AS kind, 'w' || (event_id % 2) AS w FROM events WHERE ts <= TIMESTAMP '2024-01-25'),
n AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY t, event_id) AS k FROM e),
s AS (SELECT DISTINCT job, 0::BIGINT AS k, NULL::VARCHAR AS status, 0 AS attempts, NULL::DOUBLE AS due, NULL::DOUBLE AS locked, NULL::VARCHAR AS worker, 0 AS refused FROM e
UNION ALL SELECT job, k, CASE WHEN takes THEN 'queued' WHEN claims THEN 'in_progress' WHEN kind = 'complete' AND owns THEN 'done' WHEN kind = 'fail' AND owns THEN CASE WHEN attempts >= 2 THEN 'failed' ELSE 'queued' END ELSE st END,
  attempts + claims::INT, CASE WHEN takes THEN t WHEN kind = 'fail' AND owns AND attempts < 2 THEN t + least(3600 * 2 ** greatest(0, attempts - 1), 5400) ELSE due END,
  CASE WHEN claims THEN t WHEN ends THEN NULL ELSE lk END, CASE WHEN claims THEN w WHEN ends THEN NULL ELSE worker END, refused + (NOT (takes OR claims OR ends))::INT
  FROM (SELECT *, kind = 'enqueue' AND st IS NULL AS takes, coalesce(kind = 'claim' AND st = 'queued' AND due <= t, false) AS claims, coalesce(st IN ('in_progress', 'queued') AND w = worker, false) AS owns, coalesce(kind IN ('complete', 'fail') AND owns, false) AS ends
    FROM (SELECT n.*, s.attempts, s.due, s.worker, s.refused, CASE WHEN s.status = 'in_progress' AND s.locked + 32400 < n.t THEN CASE WHEN s.attempts >= 2 THEN 'failed' ELSE 'queued' END ELSE s.status END AS st,
      CASE WHEN s.status = 'in_progress' AND s.locked + 32400 < n.t THEN NULL ELSE s.locked END AS lk FROM s JOIN n ON n.job = s.job AND n.k = s.k + 1))),
f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY job ORDER BY k DESC) = 1)
SELECT job, CASE WHEN status = 'in_progress' AND locked + 32400 < epoch(TIMESTAMP '2024-01-25') THEN CASE WHEN attempts >= 2 THEN 'failed' ELSE 'queued' END ELSE status END AS status, attempts, floor(due)::BIGINT AS due_seconds, worker, refused FROM f"""
)
def job_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of the jobs on a day: lost workers, waits, steps that come twice or from the wrong worker."""
    kinds = {"signup": "enqueue", "view": "claim", "click": "fail", "purchase": "complete"}
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("event_type")), F.lit("claim"))
    job = F.concat(F.col("user_id"), F.lit("-"), F.floor(F.dayofmonth("ts") / 6))
    steps = table(spark, sf_dir, "events").select(job.alias("job"), "ts", F.col("event_id").alias("seq"), kind.alias("kind"), F.concat(F.lit("w"), F.col("event_id") % 2).alias("worker"))
    until = F.lit("2024-01-25").cast("timestamp_ntz")
    return queue.job_states(steps, until, QUEUE_RULES).select("job", "status", "attempts", F.floor(F.col("due").cast("double")).alias("due_seconds"), "worker", "refused")


# ---- Java sources: a class for each part, of as many members as its numbers say


def java_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey and the text of a class with f fields, g getters, m methods of l loops, and a type inside every second one."""
    part = parts(spark, sf_dir)
    f, m, loops = F.col("p_size") % 5, F.col("p_partkey") % 3, (F.col("p_size") / 5).cast("int") % 3
    g = F.least(F.col("p_size") % 4, f)
    each = lambda n, make: F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), make), "")).otherwise("")
    field = each(f, lambda i: F.format_string("  private int f%s = %s;\n", i.cast("string"), i.cast("string")))
    getter = each(g, lambda i: F.format_string("  public int getF%s() { return f%s; }\n", i.cast("string"), i.cast("string")))
    loop = F.repeat(F.lit("    for (int i = 0; i < n; i++) { if (n > i) o.go(i).stop(); } // a loop\n"), loops)
    method = each(m, lambda j: F.concat(F.lit("  void m"), j.cast("string"), F.lit("(Other o, int n) {\n"), loop, F.when(f > 0, "    f0 = n;\n").otherwise(""), F.lit("  }\n")))
    inner = F.when(F.col("p_partkey") % 2 == 1, "  static class In { int z; void w() { if (z > 1) return; } }\n").otherwise("")
    text = F.concat(F.lit("class P"), "p_partkey", F.lit(" extends Base implements A, B {\n"), field, getter, method, inner, F.lit("}\n"))
    return part.select("p_partkey", text.alias("text"))


JAVA_SQL = """p AS (SELECT p_partkey, p_size % 5 AS f, least(p_size % 4, p_size % 5) AS g, (p_partkey % 3)::INT AS m, (p_size // 5) % 3 AS l, (p_partkey % 2)::INT AS odd, least(p_size % 5, 1) AS one FROM part)"""


@query(
    f"""WITH {JAVA_SQL}, q AS (SELECT *, g + m AS n, CASE WHEN one = 1 THEN m + least(g, 1) ELSE 0 END AS s FROM p)
SELECT p_partkey, 'P' || p_partkey AS name, n AS methods, f AS fields, odd AS inner_types, g AS public_methods, g AS getters, f AS private_fields, g + m * (1 + 2 * l) AS wmc, CASE WHEN n > 0 THEN (g + m * (1 + 2 * l)) / n END AS avg_complexity,
CASE WHEN m > 0 THEN 1 + 2 * l WHEN g > 0 THEN 1 ELSE 0 END AS max_complexity, CASE WHEN m > 0 AND l > 0 THEN 2 ELSE 0 END AS max_nesting, m * l AS loops, g + m * (3 * l + one) AS statements, 2 * m * l AS foreign_calls, m * l AS calls_on_params, g + m * one AS own_field_access,
least(m * l, 1) AS foreign_targets, CASE WHEN n > 1 THEN s * (s - 1) / (n * (n - 1)) ELSE 0 END::DOUBLE AS cohesion, CASE WHEN g + 0 > 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS weight_of_class, 2 + f + g + m * (2 + l + one) + odd AS sloc,
9 + 6 * f + 10 * g + m * (11 + 33 * l + 4 * one) + 22 * odd + 1 AS tokens, 2 AS interfaces, 1 AS has_superclass, 0 AS is_nested, least(m, 1) AS own_types FROM q
UNION ALL SELECT p_partkey, 'In', 1, 1, 0, 0, 0, 0, 2, 2.0, 2, 1, 0, 2, 0, 0, 1, 0, 0.0, 1.0, 1, 22, 0, 0, 1, 0 FROM q WHERE odd = 1"""
)
def java_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of every class from its declarations; the numbers follow from the part's."""
    files = written(java_sources(spark, sf_dir), "java-sources")
    declared = written(java_code.java_declarations(files, ["p_partkey"]), "java-declarations")
    sums = written(structure.token_sums(java_code.java_tokens(files, ["p_partkey"]), ["p_partkey"]), "java-tokens")
    sizes = structure.span_sizes(sums, declared.select("p_partkey", "id", "first", "last"), ["p_partkey"])
    found = structure.class_features(declared, sizes, ["p_partkey"])
    whole = ("methods", "fields", "inner_types", "public_methods", "getters", "private_fields", "wmc", "max_complexity", "max_nesting", "loops", "statements", "foreign_calls", "calls_on_params", "own_field_access", "foreign_targets", "sloc", "tokens", "interfaces", "has_superclass", "is_nested")
    return found.select("p_partkey", "name", *[F.col(c).cast("long").alias(c) for c in whole], F.when(F.col("methods") > 0, F.col("avg_complexity")).alias("avg_complexity"), "cohesion", "weight_of_class", F.col("distinct_types").cast("long").alias("own_types"))


@query(
    f"""WITH {JAVA_SQL}, k AS (SELECT p.*, unnest(range(m)) AS j FROM p)
SELECT p_partkey, 'm' || j AS name, 2 + l + one AS sloc, 11 + 33 * l + 4 * one AS tokens, 4 + 10 * l + 2 * one AS identifiers, 4 * l + one AS operators, l AS literals, 4 + CASE WHEN l > 0 THEN 3 ELSE 0 END + one AS different, 2 + f + g + j * (2 + l + one) AS line FROM k
UNION ALL SELECT p_partkey, 'getF' || j, 1, 10, 2, 0, 0, 2, 2 + f + j FROM (SELECT p.*, unnest(range(g)) AS j FROM p)"""
)
def token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the methods' spans from sums up to each token."""
    files = written(java_sources(spark, sf_dir), "java-sources")
    sums = written(structure.token_sums(java_code.java_tokens(files, ["p_partkey"]), ["p_partkey"]), "java-tokens")
    spans = java_code.java_declarations(files, ["p_partkey"]).filter("kind = 'method' AND name <> 'w'").select("p_partkey", "name", "first", "last")
    spans = written(spans, "java-spans")
    sizes = structure.span_sizes(sums, spans, ["p_partkey"]).join(structure.distinct_identifiers(sums, spans, ["p_partkey"]), ["p_partkey", "first", "last"])
    return sizes.select("p_partkey", "name", *[F.col(c).cast("long").alias(c) for c in ("sloc", "tokens", "identifiers", "operators", "literals", "line")], F.col("distinct").alias("different"))
