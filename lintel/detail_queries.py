"""Queries of single operators that the other lists don't reach, and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.finding_queries import numbers, parts, repeated, text
from lintel.functions import scalars, syntax_trees
from lintel.operators import joins, models, rollups, scoring, selection
from lintel.plans import overview
from lintel.queries import LABELLED_SQL, labelled, query
from lintel.session import shared_dir, table, written
from lintel.sources import files as sources
from lintel.sources import sinks
from lintel.streaming import jobs

# ---- Lines, selections, ids


@query(
    """WITH l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'class' ELSE 'method' END AS kind, CASE WHEN l_suppkey % 9 > 0 THEN l_suppkey % 40 END AS s, CASE WHEN l_suppkey % 4 > 0 THEN l_suppkey % 40 + l_quantity::INT % 12 ELSE 0 END AS e,
l_partkey % 50 AS os, CASE WHEN l_partkey % 3 > 0 THEN l_partkey % 50 + l_quantity::INT % 9 END AS oe FROM lineitem), f AS (SELECT *, coalesce(nullif(e, 0), s) AS en, coalesce(nullif(oe, 0), os) AS oen FROM l)
SELECT l_orderkey, l_linenumber, count(*) FILTER (WHERE s IS NULL OR CASE WHEN kind = 'class' THEN os BETWEEN s AND en OR abs(s - os) <= 10 ELSE abs(s - os) <= 5 OR (s <= oen AND os <= en) END) AS matches FROM f GROUP BY 1, 2"""
)
def line_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do two ranges mean the same entity, by kind, with and without ends."""
    q, supp, part = F.col("l_quantity").cast("int"), F.col("l_suppkey"), F.col("l_partkey")
    kind = F.when(F.col("l_linenumber") % 2 == 0, "class").otherwise("method")
    start, end = F.when(supp % 9 > 0, supp % 40), F.when(supp % 4 > 0, supp % 40 + q % 12).otherwise(0)
    same = joins.lines_match(kind, start, end, part % 50, F.when(part % 3 > 0, part % 50 + q % 9))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count_if(same).alias("matches"))


@query(
    """WITH e AS (SELECT DISTINCT (['clone', 'overlaps', 'contains', 'other'])[(l_linenumber % 4 + 1)::INT] AS kind, 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem),
n AS (SELECT *, substr(a, 2)::INT % 3 = 0 AS ha, substr(b, 2)::INT % 2 = 0 AS hb FROM e)
SELECT kind, a, b, CASE WHEN kind = 'clone' THEN 'one clone of two' WHEN kind = 'overlaps' THEN 'overlapping changes' ELSE 'container without part' END AS note FROM n
WHERE kind = 'clone' AND ha <> hb OR kind = 'overlaps' AND ha AND hb OR kind = 'contains' AND ha AND NOT hb"""
)
def selection_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What choosing every third part and every second supplier means for the edges between them."""
    items = table(spark, sf_dir, "lineitem")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("clone", "overlaps", "contains", "other")]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    edges = items.select(kind.alias("kind"), F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b")).distinct()
    chosen = items.filter("l_partkey % 3 = 0").select(F.concat(F.lit("p"), "l_partkey").alias("id")).unionByName(items.filter("l_suppkey % 2 = 0").select(F.concat(F.lit("s"), "l_suppkey").alias("id")))
    return selection.interactions(edges, chosen)


@query(
    """WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders), t AS (SELECT DISTINCT o_custkey, o_orderkey % 14 AS n FROM orders)
SELECT t.o_custkey, t.n, o.o_orderkey AS found FROM t LEFT JOIN o ON o.o_custkey = t.o_custkey AND o.n = t.n AND t.n % 5 <> 4"""
)
def resolved_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids as people write them (S003, s3, 3) to the rows that they were shown for."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    shown = selection.display_ids(orders, ["o_custkey"], [F.col("o_orderkey")])
    n = F.col("n")
    token = F.when(n % 5 == 0, F.format_string("S%03d", n)).when(n % 5 == 1, F.concat(F.lit(" s"), n)).when(n % 5 == 4, n.cast("string")).otherwise(F.concat(F.lit("S0"), n))
    asked = orders.select("o_custkey", (F.col("o_orderkey") % 14).alias("n")).distinct().withColumn("token", token)
    return selection.resolve_display_ids(asked, shown, ["o_custkey"], "o_orderkey").select("o_custkey", "n", "found")


# ---- Sources, folders, imports


def module_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python package of a module for each part that imports the one behind it, some Java classes and C files that do the same."""
    key, size = numbers()
    after = key + 1
    python = text("import os\nfrom pkg.m", after, " import x\nimport pkg.none as n\n", repeated("x = 1\n", size))
    java = text("package a;\nimport a.b.J", after, ";\nimport static java.util.List;\nclass J", key, " { }\n")
    c = text('#include "c', after, '.h"\n#include <stdio.h>\n', repeated("int a;\n", size))
    one = lambda language, path, body: F.struct(F.lit(language).alias("language"), path.alias("path"), body.alias("text"))
    files = F.array(one("python", text("pkg/m", key, ".py"), python), one("java", text("src/J", key, ".java"), java), one("c", text("inc/c", key, ".h"), c))
    return table(spark, sf_dir, "part").select(F.inline(files))


@query(
    """WITH p AS (SELECT p_partkey AS k FROM part), e AS (SELECT a.k, b.k AS n FROM p AS a JOIN p AS b ON b.k = a.k + 1)
SELECT 'pkg/m' || k || '.py' AS src, 'pkg/m' || n || '.py' AS dst FROM e UNION ALL SELECT 'src/J' || k || '.java', 'src/J' || n || '.java' FROM e UNION ALL SELECT 'inc/c' || k || '.h', 'inc/c' || n || '.h' FROM e"""
)
def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.dependencies(written(module_files(spark, sf_dir).select("path", "language", "text"), "modules"))


@query(
    """WITH p AS (SELECT p_size AS s FROM part), f AS (SELECT 'python' AS language, s + 4 AS lines FROM p UNION ALL SELECT 'java', 5 FROM p UNION ALL SELECT 'c', s + 3 FROM p)
SELECT language, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS percent, sum(lines)::BIGINT AS lines FROM f GROUP BY language"""
)
def language_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.languages(module_files(spark, sf_dir).select("path", "language", "text"))


@query(
    """WITH f AS (SELECT 'r/' || l_shipdate::DATE::VARCHAR || '/' || (l_suppkey % 5) || '/' || l_partkey || '.c' AS path FROM lineitem), s AS (SELECT string_split(path, '/') AS p FROM f),
u AS (SELECT array_to_string(p[:d], '/') AS folder, d FROM s, (SELECT unnest([1, 2, 3]) AS d))
SELECT folder, CASE WHEN d = 1 THEN '' ELSE regexp_replace(folder, '/[^/]*$', '') END AS parent, d AS depth, count(*) AS files FROM u GROUP BY folder, d"""
)
def folder_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", F.lit("r"), F.col("l_shipdate").cast("date").cast("string"), (F.col("l_suppkey") % 5).cast("string"), F.concat("l_partkey", F.lit(".c")))
    return sources.folders(table(spark, sf_dir, "lineitem").select(path.alias("path")))


@query(
    """SELECT o_custkey, count(*) AS files, sum(o_orderkey % 7)::BIGINT AS findings, sum(o_orderkey % 90)::BIGINT AS lines, sum(o_orderkey % 2)::BIGINT AS high, sum(o_orderkey % 3)::BIGINT AS medium, sum(o_orderkey % 5)::BIGINT AS low,
round(avg(CASE WHEN o_orderkey % 6 > 0 THEN o_orderkey % 100 ELSE 100 END)::DECIMAL(18, 9), 1)::DOUBLE AS score FROM orders GROUP BY o_custkey"""
)
def report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of repositories from those of files; files that couldn't be read count as 100."""
    key = F.col("o_orderkey")
    files = table(spark, sf_dir, "orders").select("o_custkey", (key % 7).alias("findings"), (key % 90).alias("lines"), (key % 2).alias("high"), (key % 3).alias("medium"), (key % 5).alias("low"), F.when(key % 6 > 0, (key % 100).cast("double")).alias("score"))
    return rollups.repository_summary(files, ["o_custkey"])


@query(
    """WITH p AS (SELECT p_partkey AS k, p_size % 5 AS n FROM part)
SELECT k, unnest(['Module', 'FunctionDef', 'arguments', 'arg', 'Return', 'BinOp', 'Name', 'Add', 'Load']) AS type, unnest([1, 1, 1, 1, 1, n, n + 1, n, n + 1]) AS nodes FROM p WHERE n > 0
UNION ALL SELECT k, unnest(['Module', 'FunctionDef', 'arguments', 'arg', 'Return', 'Name', 'Load']), 1 FROM p WHERE n = 0"""
)
def tree_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of nodes of functions that add up a name so many times."""
    key, size = numbers()
    files = parts(spark, sf_dir).select(key.cast("string").alias("path"), F.lit("python").alias("language"), text("def f(a):\n    return a", repeated(" + a", size % 5), "\n").alias("text"))
    return syntax_trees.histogram(syntax_trees.nodes(files)).select(F.col("path").cast("long").alias("k"), "type", "nodes")


# ---- Scores and features


@query(
    """SELECT l_orderkey, l_linenumber, round(l_quantity + 0.3 * CASE WHEN l_partkey % 3 > 0 THEN l_discount ELSE 0 END, 6) AS with_impact,
round(l_quantity + 0.25 * CASE WHEN l_suppkey % 4 > 0 THEN l_tax * (l_discount + 0.5 - l_tax) ELSE 0 END, 6) AS with_model FROM lineitem"""
)
def adjusted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, discount, tax = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    bonus, confidence = F.when(F.col("l_partkey") % 3 > 0, discount), F.when(F.col("l_suppkey") % 4 > 0, tax)
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", F.round(scoring.impact_adjusted(base, bonus), 6).alias("with_impact"), F.round(scoring.model_adjusted(base, confidence, discount, F.lit(0.5), tax), 6).alias("with_model"))


@query(
    """WITH b AS (SELECT (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[] AS h, (SELECT embedding FROM embeddings WHERE vec_id = 1)::DOUBLE[] AS l)
SELECT vec_id, round(greatest(0, least(1, 0.5 + 1.5 * (list_cosine_similarity(embedding::DOUBLE[], h) - list_cosine_similarity(embedding::DOUBLE[], l)))), 6) AS place FROM embeddings, b"""
)
def axis_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where vectors lie between the first two."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    ends = vectors.filter("vec_id < 2").agg(F.max(F.when(F.col("vec_id") == 0, F.col("embedding"))).alias("h"), F.max(F.when(F.col("vec_id") == 1, F.col("embedding"))).alias("l"))
    joined = vectors.crossJoin(F.broadcast(ends))  # one row
    return joined.select("vec_id", F.round(scalars.axis_projection(F.col("embedding"), F.col("h"), F.col("l")), 6).alias("place"))


@query(
    """SELECT l_orderkey, l_linenumber, round((x * u + CASE WHEN z > 2 THEN z * z ELSE 0 END) / (sqrt(x * x + y * y + CASE WHEN z > 2 THEN z * z ELSE 0 END) * sqrt(u * u + v * v + CASE WHEN z > 2 THEN z * z ELSE 0 END)), 6) AS cosine
FROM (SELECT *, l_quantity AS x, l_linenumber AS y, l_suppkey % 7 AS z, l_partkey % 9 + 1 AS u, l_suppkey % 5 + 1 AS v FROM lineitem)"""
)
def count_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of counts with keys that both have, one has, and one has sometimes."""
    entry = lambda k, v: F.struct(F.lit(k).alias("k"), v.cast("double").alias("v"))
    z = F.when(F.col("l_suppkey") % 7 > 2, entry("z", F.col("l_suppkey") % 7))
    a = F.map_from_entries(F.array_compact(F.array(entry("x", F.col("l_quantity")), entry("y", F.col("l_linenumber")), z)))
    b = F.map_from_entries(F.array_compact(F.array(entry("x", F.col("l_partkey") % 9 + 1), entry("v", F.col("l_suppkey") % 5 + 1), z)))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(scalars.cosine_counts(a, b), 6).alias("cosine"))


@query(
    """WITH t AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS c FROM (SELECT DISTINCT event_type FROM events WHERE event_type <> 'view'))
SELECT event_id, coalesce(c, 0)::DOUBLE AS type_code, CASE event_id % 4 WHEN 0 THEN 2.0 WHEN 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS severity_code FROM events LEFT JOIN t USING (event_type)"""
)
def encoded_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories as their places in a vocabulary that lacks one; severities by rank."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("type"))
    words = models.vocabulary(events.filter("type <> 'view'"), "type")
    level = F.when(F.col("event_id") % 4 == 0, "HIGH").when(F.col("event_id") % 4 == 1, "medium").when(F.col("event_id") % 4 == 2, "odd")
    return models.encoded(events.withColumn("severity", level), {"type": words}, "severity").select("event_id", "type_code", "severity_code")


@query(
    f"""WITH d AS (SELECT quality AS y, n_chars::DOUBLE AS a, (n_chars % 97)::DOUBLE AS b FROM {LABELLED_SQL}), v AS (SELECT 0 AS pos, 'n_chars' AS feature, a AS x, y FROM d UNION ALL SELECT 1, 'rest', b, y FROM d),
c AS (SELECT pos, feature, x, sum(y) AS ones, count(*) AS n FROM v GROUP BY ALL), r AS (
SELECT pos, feature, '>=' AS direction, x, sum(ones) OVER (PARTITION BY pos ORDER BY x DESC) AS ones, sum(n) OVER (PARTITION BY pos ORDER BY x DESC) AS n FROM c UNION ALL
SELECT pos, feature, '<=', x, sum(ones) OVER (PARTITION BY pos ORDER BY x), sum(n) OVER (PARTITION BY pos ORDER BY x) FROM c)
SELECT feature, direction, x AS threshold, round(2 * ones / (n + (SELECT sum(y) FROM d)), 6) AS f1 FROM r ORDER BY 2 * ones / (n + (SELECT sum(y) FROM d)) DESC, pos, direction DESC, x LIMIT 1"""
)
def best_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).select(F.col("quality").alias("y"), "n_chars", (F.col("n_chars") % 97).alias("rest"))
    return models.single_metric_rule(rows, ["n_chars", "rest"], "y").withColumn("f1", F.round("f1", 6))


# ---- Logs and jobs


@query(
    """WITH o AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1)
SELECT k, CASE WHEN k % 5 = 0 THEN 'updated' WHEN k = 2 THEN 'set' ELSE 'new' END AS status, CASE WHEN k % 5 = 0 THEN 2 WHEN k = 2 THEN 3 ELSE 1 END AS t, n FROM o WHERE k % 7 <> 0"""
)
def log_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows appended once a key, new versions of some, one by compare and set, and others deleted: what is current then."""
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    rows = written(counts.select("k", F.lit("new").alias("status"), F.lit(1).alias("t"), F.lit(0).alias("tie"), "n"), "log-rows")
    sinks.append(rows.filter("k % 3 = 0"), path)
    sinks.append_new(rows, path, ["k"])
    sinks.append_new(rows.withColumn("status", F.lit("twice")), path, ["k"])
    sinks.update_rows(spark, path, ["k"], "t", "tie", "k % 5 = 0", {"status": "updated"}, 2)
    sinks.compare_and_set(spark, path, ["k"], "t", "tie", {"k": 2}, {"status": "new"}, {"status": "set"}, 3)
    sinks.compare_and_set(spark, path, ["k"], "t", "tie", {"k": 4}, {"status": "old"}, {"status": "set"}, 3)
    sinks.delete_where(spark, path, "k % 7 = 0")
    return sinks.current(spark, path, ["k"], "t", "tie").select("k", "status", "t", "n")


@query(
    """WITH o AS (SELECT o_orderkey AS id, o_orderkey % 6 AS n, o_orderkey % 3 = 0 AS f, epoch(o_orderdate)::BIGINT AS due FROM orders)
SELECT id, CASE WHEN f THEN CASE WHEN n + 1 >= 5 THEN 'failed' ELSE 'queued' END ELSE 'in_progress' END AS status, CASE WHEN f THEN n + 1 ELSE n END AS attempts, due + CASE WHEN f AND n + 1 < 5 THEN least(30 * 2 ** n, 900) ELSE 0 END::BIGINT AS due_seconds,
(['select', 'plan', 'approve', 'transform', 'validate', 'done', NULL, NULL])[(id % 8 + 1)::INT] AS next_stage FROM o"""
)
def retried_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed jobs back in the queue with a longer wait, or failed for good; and the stage after each stage."""
    key = F.col("o_orderkey")
    table_ = table(spark, sf_dir, "orders").select(key.alias("id"), F.lit("in_progress").alias("status"), (key % 6).alias("attempts"), F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))).alias("due"))
    after = jobs.retry(table_, table_.filter("id % 3 = 0"))
    stage = F.element_at(F.array(*[F.lit(s) for s in (*jobs.STAGES, "unheard of")]), (F.col("id") % 8 + 1).cast("int"))
    return after.select("id", "status", "attempts", F.unix_timestamp("due").alias("due_seconds"), jobs.next_stage(stage).alias("next_stage"))


@query("SELECT o_orderkey, o_orderpriority, round(o_totalprice, 2) AS price, o_orderstatus, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders")
def exported_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordered export to CSV, by status, read again: the rows in the order of the files."""
    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.round("o_totalprice", 2).alias("price"), "o_orderstatus")
    sinks.export_csv(rows, f"{path}/csv", [F.col("o_orderkey")])
    sinks.export_json(rows.filter("o_orderkey % 2 = 0"), f"{path}/json")
    schema = "o_orderkey long, o_orderpriority string, price double, o_orderstatus string"
    csv = spark.read.schema(schema).option("header", True).csv(f"{path}/csv").withColumn("file", F.input_file_name())
    first = csv.groupBy("file").agg(F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"), F.count(F.lit(1)).alias("n")).orderBy("file").collect()  # a row a file
    if any(a["high"] >= b["low"] for a, b in zip(first, first[1:])):
        raise ValueError("files are not in the order of their rows")
    both = csv.filter("o_orderkey % 2 = 1").drop("file").unionByName(spark.read.schema(schema).json(f"{path}/json"))
    from lintel.operators.windows import running_totals

    return running_totals(both.withColumn("one", F.lit(1)), "o_orderkey", ["one"]).select("o_orderkey", "o_orderpriority", "price", "o_orderstatus", F.col("run_one").alias("place"))
