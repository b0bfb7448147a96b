"""Queries of statistics, preconditions, folds, paths and versions over the test tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.finding_queries import numbers, parts, text, times
from lintel.operators import grouped, joins, preconditions, sets, statistics, versions
from lintel.queries import LABELLED_SQL, labelled, poisson_sql, query
from lintel.session import table

# ---- Preconditions: a part is a finding, its numbers are metrics, some of them missing

FIXES = [
    ("Extract Method", ["has_code_block", "has_temp_variables"]),
    ("Introduce Parameter Object", ["has_multiple_parameters", "has_computable_parameter"]),
    ("Extract Class", ["has_multiple_responsibilities", "has_primitive_fields"]),
    ("Move Method", ["has_external_field_access", "is_class_method", "has_valid_destination"]),
    ("Pull Up Method", ["has_parent_class"]),
    ("Inline Class", ["has_thin_class", "has_multiple_dependencies"]),
    ("Replace Conditional", ["has_type_checking", "has_nesting"]),
    ("Hide Delegate", ["has_chain_calls", "never heard of"]),
    ("Own Rule", ["is_large", "has_magic_numbers"]),
]


@query(
    """WITH p AS (SELECT p_partkey AS k, p_size AS s, p_partkey % 2 = 0 AS e, p_partkey % 3 = 0 AS t, p_partkey % 5 = 0 AS f FROM part),
c AS (SELECT k, unnest([
  CASE WHEN (t OR s % 7 > 1) AND (NOT e OR s = 0 OR s > 10) THEN 'Extract Method' END,
  CASE WHEN NOT t OR s % 6 >= 3 THEN 'Introduce Parameter Object' END,
  CASE WHEN (CASE WHEN f THEN s % 9 >= 5 WHEN e AND s > 0 THEN s >= 30 ELSE true END) AND (NOT t OR s % 4 >= 2) THEN 'Extract Class' END,
  CASE WHEN (NOT e OR s % 5 >= 2) AND t THEN 'Move Method' END,
  CASE WHEN f THEN 'Pull Up Method' END,
  CASE WHEN (NOT e OR s = 0 OR s < 50 OR (CASE WHEN f THEN s % 9 ELSE 0 END) <= 3) AND (NOT f OR s % 5 >= 3) THEN 'Inline Class' END,
  CASE WHEN (NOT t OR s % 8 = 0 OR s % 8 >= 3) AND (NOT e OR s % 6 >= 4) THEN 'Replace Conditional' END,
  CASE WHEN NOT f OR s % 5 = 0 OR s % 5 >= 3 THEN 'Hide Delegate' END,
  CASE WHEN NOT e OR s > 40 THEN 'Own Rule' END]) AS refactoring FROM p)
SELECT k, refactoring FROM c WHERE refactoring IS NOT NULL"""
)
def named_preconditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixes of every part's finding; metrics and places that are missing leave a rule unknown, and one rule is the caller's."""
    key, size = numbers()
    even, third, fifth = key % 2 == 0, key % 3 == 0, key % 5 == 0
    metric = lambda name, there, value: F.when(there, F.struct(F.lit(name).alias("key"), value.cast("double").alias("value")))
    metrics = [
        metric("lines_of_code", even, size), metric("parameter_count", third, size % 6), metric("method_count", fifth, size % 9), metric("external_field_accesses", even, size % 5), metric("cyclomatic_complexity", third, size % 8),
        metric("primitive_field_count", third, size % 4), metric("chain_length", fifth, size % 5), metric("coupling", fifth, size % 5), metric("nesting_depth", even, size % 6),
    ]
    place = F.map_from_entries(F.array_compact(F.array(F.when(third, F.struct(F.lit("method"), F.lit("m"))), F.when(~third, F.struct(F.lit("entity"), F.lit("unknown"))), F.when(fifth, F.struct(F.lit("superclass"), F.lit("Base"))))))
    lines = F.when(third, F.array(F.lit(1))).otherwise(F.array(F.lit(10), 10 + (size % 7).cast("int")))
    findings = table(spark, sf_dir, "part").select(key.alias("k"), F.lit("any").alias("smell"), F.map_from_entries(F.array_compact(F.array(*metrics))).alias("metrics"), place.alias("location"), lines.alias("lines"))
    catalogue = spark.createDataFrame([("any", r, names) for r, names in FIXES], "smell string, refactoring string, preconditions array<string>")
    return preconditions.candidates(findings, catalogue, {"is_large": preconditions.least("lines_of_code", 41)}).select("k", "refactoring")


# ---- Statistics

SCREEN_SQL = "d AS (SELECT coalesce(lang, 'missing') AS lang, coalesce(source, 'missing') AS source, CASE WHEN n_chars > 2000 THEN 'c' WHEN n_chars > 500 THEN 'b' ELSE 'a' END AS size FROM documents)"


def screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select("lang", "source", F.when(n > 2000, "c").when(n > 500, "b").otherwise("a").alias("size"), n.alias("n_chars"))


@query(
    f"""WITH {SCREEN_SQL}, t AS (SELECT 'lang' AS "column", lang AS a, size AS b FROM d UNION ALL SELECT 'source', source, size FROM d),
r AS (SELECT "column", a, count(*) AS n FROM t GROUP BY 1, 2), c AS (SELECT "column", b, count(*) AS n FROM t GROUP BY 1, 2), n AS (SELECT "column", a, b, count(*) AS n FROM t GROUP BY 1, 2, 3), w AS (SELECT count(*) AS n FROM d),
x AS (SELECT r."column", sum((coalesce(n.n, 0) - r.n * c.n / w.n) ** 2 / (r.n * c.n / w.n)) AS statistic, (count(DISTINCT r.a) - 1) * (count(DISTINCT c.b) - 1) AS freedom
  FROM r JOIN c USING ("column") LEFT JOIN n ON n."column" = r."column" AND n.a = r.a AND n.b = c.b, w GROUP BY 1)
SELECT "column", round(statistic, 6) AS statistic, freedom, round(exp(-statistic / 2) * list_sum(list_transform(range(freedom // 2), lambda k: exp(k * ln(statistic / 2) - lgamma(k + 1)))), 6) AS p FROM x"""
)
def chi_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does the length class of a document depend on its language or source?"""
    found = statistics.chi_squared(screened(spark, sf_dir), ["lang", "source"], "size")
    return found.withColumns({"statistic": F.round("statistic", 6), "p": F.round("p", 6)})


@query(
    f"""WITH {SCREEN_SQL}, r AS (SELECT lang AS a, count(*) AS n FROM d GROUP BY 1), c AS (SELECT size AS b, count(*) AS n FROM d GROUP BY 1)
SELECT r.a, c.b, (SELECT count(*) FROM d WHERE lang = r.a AND size = c.b) AS n, round(r.n * c.n / (SELECT count(*) FROM d), 6) AS expected FROM r, c"""
)
def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.contingency(screened(spark, sf_dir), "lang", "size").withColumn("expected", F.round("expected", 6))


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS correlation FROM lineitem" for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]))
def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.correlations(table(spark, sf_dir, "lineitem"), NUMBERS).withColumn("correlation", F.round("correlation", 6))


@query(
    f"""WITH d AS (SELECT lang, CASE WHEN quality = 1 AND toxic = 1 THEN 1 ELSE 0 END AS tp, CASE WHEN quality = 0 AND toxic = 1 THEN 1 ELSE 0 END AS fp, CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END AS fn, {poisson_sql("doc_id")} AS w, round FROM {LABELLED_SQL}, (SELECT unnest(generate_series(1, 60)) AS round)),
s AS (SELECT lang, round, 2.0::DOUBLE * sum(tp * w) / nullif(sum((2 * tp + fp + fn) * w), 0) AS f1 FROM d GROUP BY 1, 2)
SELECT lang, count(f1) AS rounds, round(quantile_cont(f1, 0.025), 6) AS low, round(quantile_cont(f1, 0.975), 6) AS high FROM s GROUP BY lang"""
)
def row_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An interval a language when single rows are drawn."""
    y, p = F.col("quality") == 1, F.col("toxic") == 1
    rows = labelled(spark, sf_dir).select("lang", "doc_id", (y & p).cast("int").alias("tp"), (~y & p).cast("int").alias("fp"), (y & ~p).cast("int").alias("fn"))
    found = grouped.cluster_bootstrap(rows, "doc_id", 60, by=["lang"])
    return found.withColumns({"low": F.round("low", 6), "high": F.round("high", 6)})


# ---- Groups to folds, one at a time in SQL


@query(
    """WITH RECURSIVE c AS (SELECT coalesce(source, '') AS g, count(*) FILTER (WHERE quality = 1)::HUGEINT AS one, count(*) FILTER (WHERE quality = 0)::HUGEINT AS zero, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY n DESC, md5(g || '|0|7')) AS k FROM c), t AS (SELECT sum(one)::HUGEINT AS t1, sum(zero)::HUGEINT AS t0 FROM c),
s AS (SELECT 0::BIGINT AS k, [0, 0, 0, 0]::HUGEINT[] AS ones, [0, 0, 0, 0]::HUGEINT[] AS zeros, [0, 0, 0, 0]::BIGINT[] AS ns, NULL::VARCHAR AS g, NULL::INT AS f
UNION ALL SELECT k, list_transform(ones, lambda x, i: CASE WHEN i = f THEN x + one ELSE x END), list_transform(zeros, lambda x, i: CASE WHEN i = f THEN x + zero ELSE x END), list_transform(ns, lambda x, i: CASE WHEN i = f THEN x + n ELSE x END), g, f
  FROM (SELECT o.k, ones, zeros, ns, one, zero, n, o.g, list_sort(list_transform([1, 2, 3, 4], lambda i: {'cost': ones[i] * one * t0 * t0 + zeros[i] * zero * t1 * t1, 'n': ns[i], 'i': i}))[1].i AS f FROM s JOIN o ON o.k = s.k + 1, t))
SELECT g AS "group", 0 AS repeat, f - 1 AS fold FROM s WHERE k > 0"""
)
def grouped_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources dealt to four folds so that each has its share of good documents."""
    return sets.stratified_folds(labelled(spark, sf_dir), "source", "quality", 4)


# ---- Paths


@query(
    r"""WITH f AS (SELECT p_partkey AS pos, 'C:/ws/' || (CASE p_partkey % 3 WHEN 0 THEN 'Src/' WHEN 1 THEN 'src/app/' ELSE 'old/src/' END) || 'b' || (p_size % 7) || '/f' || (p_size % 11) || '.py' AS file FROM part),
a AS (SELECT DISTINCT 'src/' || (CASE WHEN p_size % 2 = 0 THEN '' ELSE 'APP/' END) || 'B' || (p_size % 9) || '/f' || (p_size % 13) || '.py' AS asked FROM part),
h AS (SELECT asked, file, pos FROM a JOIN f ON ends_with(lower(replace(file, '\', '/')), '/' || lower(asked)) AND regexp_extract(asked, '[^/]*$') = regexp_extract(file, '[^/]*$'))
SELECT asked, (SELECT file FROM h WHERE h.asked = a.asked ORDER BY pos LIMIT 1) AS match FROM a"""
)
def path_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked ends of paths and the first file that has them; folders in any letter case."""
    key, size = numbers()
    part = table(spark, sf_dir, "part")
    folder = F.when(key % 3 == 0, "Src/").when(key % 3 == 1, "src/app/").otherwise("old/src/")
    files = part.select(key.alias("pos"), text("C:/ws/", folder, "b", size % 7, "/f", size % 11, ".py").alias("file"))
    asked = part.select(text("src/", F.when(size % 2 == 0, "").otherwise("APP/"), "B", size % 9, "/f", size % 13, ".py").alias("asked")).distinct()
    return joins.match_paths(asked, files, "asked", "file", "pos").select("asked", "match")


# ---- Versions


@query(
    r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS a, replace(coalesce(text, ''), 'the', 'class The') AS b FROM documents),
t AS (SELECT doc_id, 'a' AS side, unnest(regexp_extract_all(a, '[A-Za-z_][A-Za-z0-9_]*|[{}();.,=+\-/*]')) AS w FROM d UNION ALL SELECT doc_id, 'b', unnest(regexp_extract_all(b, '[A-Za-z_][A-Za-z0-9_]*|[{}();.,=+\-/*]')) FROM d),
n AS (SELECT doc_id, w, count(*) FILTER (WHERE side = 'a')::DOUBLE AS a, count(*) FILTER (WHERE side = 'b')::DOUBLE AS b FROM t GROUP BY 1, 2),
c AS (SELECT doc_id, coalesce(sum(a * b) / nullif(sqrt(sum(a * a)) * sqrt(sum(b * b)), 0), 0) AS cosine FROM n GROUP BY 1),
m AS (SELECT doc_id, len(regexp_extract_all(a, '\bclass\s+[A-Za-z_][A-Za-z0-9_]*')) AS ca, len(regexp_extract_all(b, '\bclass\s+[A-Za-z_][A-Za-z0-9_]*')) AS cb,
  len(regexp_extract_all(a, '\b(?:public|private|protected)?\s*(?:static\s+)?[A-Za-z_][A-Za-z0-9_<>,\[\]]*\s+[A-Za-z_][A-Za-z0-9_]*\s*\(')) AS ma, len(regexp_extract_all(b, '\b(?:public|private|protected)?\s*(?:static\s+)?[A-Za-z_][A-Za-z0-9_<>,\[\]]*\s+[A-Za-z_][A-Za-z0-9_]*\s*\(')) AS mb FROM d)
SELECT doc_id, round(0.6 * coalesce(cosine, 1) + 0.2 * CASE WHEN greatest(ca, cb) = 0 THEN 1 ELSE 1 - abs(ca - cb) / greatest(ca, cb) END + 0.2 * CASE WHEN greatest(ma, mb) = 0 THEN 1 ELSE 1 - abs(ma - mb) / greatest(ma, mb) END, 6) AS similarity FROM m LEFT JOIN c USING (doc_id)"""
)
def java_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts against themselves with a word replaced, measured as Java."""
    files = table(spark, sf_dir, "documents").select("doc_id", F.lit("java").alias("language"), F.col("text").alias("before"), F.replace("text", F.lit("the"), F.lit("class The")).alias("after"))
    return versions.version_similarity(files, ["doc_id"]).select("doc_id", F.round("similarity", 6).alias("similarity"))


@query(
    """WITH p AS (SELECT p_partkey AS k, p_size % 4 AS f1, p_size % 5 AS f2, p_partkey % 3 AS m1, p_partkey % 4 AS m2 FROM part),
c AS (SELECT *, CASE WHEN greatest(f1, f2) = 0 THEN 1 ELSE least(f1, f2) / greatest(f1, f2) END AS f, CASE WHEN greatest(m1, m2) = 0 THEN 1 ELSE least(m1, m2) / greatest(m1, m2) END AS m FROM p)
SELECT k, round(CASE WHEN f1 = f2 AND m1 = m2 THEN greatest(0.6, s) ELSE s END, 6) AS similarity FROM (SELECT *, 0.35 * f + 0.2 * f + 0.2 * f + 0.15 * CASE WHEN greatest(f1, 2 * f2) = 0 THEN 1 ELSE least(f1, 2 * f2) / greatest(f1, 2 * f2) END + 0.1 * m AS s FROM c)"""
)
def c_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C files of some functions and macros against others of more or fewer, with twice the branches."""
    key, size = numbers()
    def source(functions, macros, branch: str):
        return text(times(macros, lambda i: text("#define M", i, " 1\n")), "/* return if */\n", times(functions, lambda i: text("int f", i, "(int a,\n   int b)\n{\n", branch, "  return 0; // return\n}\n")))

    files = parts(spark, sf_dir).select(key.alias("k"), F.lit("c").alias("language"), source(size % 4, key % 3, "  if (a) b = 1;\n").alias("before"), source(size % 5, key % 4, "  if (a) b = 1;\n  while (b) a = 1;\n").alias("after"))
    return versions.version_similarity(files, ["k"]).select("k", F.round("similarity", 6).alias("similarity"))
