"""Queries of plans, recommendations, taxonomy, checks and column functions over the test tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.functions import scalars
from lintel.operators import events, grouped, joins, metrics, models, problems, ranking, recommendation, rollups, scoring, selection, sets, steps, taxonomy, validation
from lintel.queries import query
from lintel.plans import repository
from lintel.session import table
from lintel.sources import files as sources
from lintel.streaming import jobs

SMELLS = [*taxonomy.FIX_OF, "RefusedBequest", "TemporaryField", "UnusedVariable", "No Such Smell"]
RATINGS = ["low", "medium", "high", "unheard of"]


def picked(values: list, key: Column) -> Column:
    """An element of a list by a whole number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def list_sql(values: list, key: str) -> str:
    return "([" + ", ".join("NULL" if v is None else repr(v) for v in values) + f"])[(({key}) % {len(values)} + 1)::INT]"


def values_sql(rows: list[tuple], names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in r) + ")" for r in rows) + f") AS v({names})"


def near(x: Column, digits: int = 6) -> Column:
    """Rounded twice, so that the last bits of a double don't decide a tie."""
    return F.round(F.round(x, 12), digits)


def near_sql(x: str, digits: int = 6) -> str:
    return f"round(({x})::DECIMAL(30, 12), {digits})::DOUBLE"


# ---- Taxonomy

CATEGORY_ROWS = [(s, c, taxonomy.PRIORITY[c]) for s, c in taxonomy.CATEGORY_OF.items()]
STAMPS = [None, "", "  ", "Own Category"]


def smelly_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", picked(SMELLS, key).alias("smell"), picked(STAMPS, key + F.col("p_size")).alias("stamped"))


PARTS_SQL = f"p AS (SELECT p_partkey, p_brand, p_size, {list_sql(SMELLS, 'p_partkey')} AS smell, {list_sql(STAMPS, 'p_partkey + p_size')} AS stamped FROM part)"
NAMED_SQL = f"c AS (SELECT p.*, CASE WHEN trim(stamped) <> '' THEN stamped ELSE coalesce(v.category, 'Uncategorized') END AS category, v.priority FROM p LEFT JOIN {values_sql(CATEGORY_ROWS, 'smell, category, priority')} USING (smell))"


@query(f"WITH {PARTS_SQL}, {NAMED_SQL} SELECT p_partkey, smell, category, CASE WHEN category = 'Own Category' THEN 'low' ELSE coalesce(priority, 'low') END AS priority FROM c")
def category_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = taxonomy.category(F.col("smell"), F.col("stamped"))
    return smelly_parts(spark, sf_dir).select("p_partkey", "smell", name.alias("category"), taxonomy.category_priority(name).alias("priority"))


@query(
    f"""WITH {PARTS_SQL}, {NAMED_SQL}, s AS (SELECT *, p_size % 5 AS l FROM c), l AS (SELECT *, CASE l WHEN 0 THEN 'HIGH' WHEN 1 THEN 'medium' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE 'low' END AS v FROM s),
n AS (SELECT *, lower(coalesce(nullif(v, ''), 'unknown')) AS level FROM l), h AS (SELECT p_brand, string_agg(level || '=' || n, ',' ORDER BY level) AS severities FROM (SELECT p_brand, level, count(*) AS n FROM n GROUP BY ALL) GROUP BY 1)
SELECT p_brand, count(*) AS total_smells, count(DISTINCT smell) AS type_count, count(DISTINCT category) AS category_count, any_value(severities) AS severities FROM n JOIN h USING (p_brand) GROUP BY p_brand"""
)
def taxonomy_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.when(F.col("p_size") % 5 == 0, "HIGH").when(F.col("p_size") % 5 == 1, "medium").when(F.col("p_size") % 5 == 2, "").when(F.col("p_size") % 5 == 4, "low")
    found = taxonomy.payload(smelly_parts(spark, sf_dir), ["p_brand"], F.col("smell"), F.col("stamped"), severity)
    return found.withColumn("severities", F.array_join(F.transform(F.array_sort(F.map_entries("severities")), lambda e: F.concat_ws("=", e["key"], e["value"])), ","))


EXPOSED = ["extract_method", "remove_dead_code", "rename_symbol"]
CAPABLE_SQL = (
    f"f AS (SELECT p.*, v.refactoring, v.risk, v.impact, lower(v.refactoring) AS k FROM p LEFT JOIN {values_sql([(s, *f) for s, f in taxonomy.FIX_OF.items()], 'smell, refactoring, risk, impact')} USING (smell)), "
    f"a AS (SELECT f.*, CASE WHEN k IN {tuple(taxonomy.BY_HAND)} THEN NULL ELSE v.action END AS action FROM f LEFT JOIN {values_sql(list(taxonomy.ACTION_OF.items()), 'k, action')} USING (k))"
)


@query(
    f"""WITH {PARTS_SQL}, {CAPABLE_SQL} SELECT p_partkey, smell, refactoring, action, coalesce(risk, 'medium') AS risk, coalesce(impact, 'medium') AS impact,
CASE WHEN refactoring IS NULL THEN 'unknown' WHEN action IS NULL THEN 'advisory' ELSE 'executable' END AS status,
CASE WHEN refactoring IS NULL THEN 'unknown' WHEN action IN ('extract_method', 'remove_dead_code', 'rename_symbol') THEN 'executable' ELSE 'advisory' END AS status_here FROM a"""
)
def capability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a transformer can do for a smell: by the tables alone, and for one that exposes three actions."""
    rows = smelly_parts(spark, sf_dir).withColumn("c", taxonomy.capability(F.col("smell")))
    return rows.select("p_partkey", "smell", "c.refactoring", "c.action", "c.risk", "c.impact", "c.status", taxonomy.capability(F.col("smell"), EXPOSED)["status"].alias("status_here"))


@query(
    f"""WITH {PARTS_SQL}, f AS (SELECT p.*, v.* EXCLUDE (smell) FROM p LEFT JOIN {values_sql([(s, *f) for s, f in taxonomy.FIX_OF.items()], 'smell, refactoring, risk, impact')} USING (smell)),
s AS (SELECT *, coalesce(refactoring, 'Rename Method') AS fix, coalesce(risk, 'low') AS r, coalesce(impact, 'low') AS i FROM f)
SELECT p_brand, p_partkey, smell, fix AS refactoring, r AS risk, i AS impact, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)::INT AS step_id FROM s"""
)
def fallback_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = steps.fallback_plan(smelly_parts(spark, sf_dir).drop("stamped", "p_size"), ["p_brand"], "smell", "p_partkey")
    return found.select("p_brand", "p_partkey", "smell", "refactoring", "risk", "impact", "step_id")


LANGUAGES = ["py", "Python3", " JAVA ", "c/c++", "h", "rust", None, "C", "cpp", "python", "Java"]


@query(
    f"""WITH l AS (SELECT p_partkey, {list_sql(LANGUAGES, 'p_partkey')} AS raw, {list_sql(list(problems.IMPACT_RULES), 'p_partkey // 3')} AS fix FROM part),
n AS (SELECT *, CASE WHEN lower(trim(raw)) IN ('py', 'python', 'python3') THEN 'python' WHEN lower(trim(raw)) = 'java' THEN 'java' WHEN lower(trim(raw)) IN ('c', 'h', 'c/c++') THEN 'c' ELSE '' END AS language FROM l)
SELECT p_partkey, fix, language, coalesce(list_position(['python', 'java'], lower(raw)), 0) AS part FROM n
WHERE NOT (lower(coalesce(raw, '')) IN ('c', 'cpp') AND fix IN ('Replace Parameter with Method Call', 'Replace Conditional with Polymorphism', 'Move Method'))"""
)
def language_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases of languages, fixes that C leaves out, and the parts of a Python-then-Java order."""
    rows = table(spark, sf_dir, "part").select("p_partkey", picked(LANGUAGES, F.col("p_partkey")).alias("raw"), picked(list(problems.IMPACT_RULES), F.floor(F.col("p_partkey") / 3)).alias("fix"))
    parts = taxonomy.by_language(rows, "raw").select("p_partkey", "part")
    kept = taxonomy.without_excluded(rows, "raw", "fix").join(parts, "p_partkey", "left")
    return kept.select("p_partkey", "fix", taxonomy.normalize_language(F.col("raw")).alias("language"), F.coalesce("part", F.lit(0)).alias("part"))


# ---- Problems and impact


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of an order as a finding with metrics; some are missing."""
    lines = table(spark, sf_dir, "lineitem")
    q, key = F.col("l_quantity").cast("int"), F.col("l_partkey")
    values = {"cyclomatic_complexity": q % 20, "lines_of_code": key * 7 % 290, "coupling": key % 11, "method_count": F.col("l_suppkey") * 3 % 26, "parameter_count": F.col("l_linenumber") + q % 4}
    entries = F.array(*[F.struct(F.lit(k).alias("k"), v.cast("double").alias("v")) for k, v in values.items()])
    known = F.filter(entries, lambda e: (e["k"] != "coupling") | (q % 3 != 0))
    smell = picked(["Long Method", "God Class", "Dead Code", "Long Function"], key)
    return lines.select("l_orderkey", "l_linenumber", F.map_from_entries(known).alias("metrics"), smell.alias("smell"))


MEASURED_SQL = f"""m AS (SELECT l_orderkey, l_linenumber, l_quantity::INT % 20 AS cc, l_partkey * 7 % 290 AS loc, CASE WHEN l_quantity::INT % 3 <> 0 THEN l_partkey % 11 END AS coupling,
l_suppkey * 3 % 26 AS methods, l_linenumber + l_quantity::INT % 4 AS params, {list_sql(["Long Method", "God Class", "Dead Code", "Long Function"], 'l_partkey')} AS smell FROM lineitem)"""
POINTS_SQL = """(CASE WHEN cc >= 15 THEN 4 WHEN cc >= 10 THEN 2 WHEN cc >= 5 THEN 1 ELSE 0 END + CASE WHEN loc >= 200 THEN 3 WHEN loc >= 100 THEN 2 WHEN loc >= 50 THEN 1 ELSE 0 END
+ CASE WHEN coupling >= 8 THEN 3 WHEN coupling >= 5 THEN 1 ELSE 0 END + CASE WHEN methods >= 20 THEN 2 WHEN methods >= 10 THEN 1 ELSE 0 END + CASE WHEN params >= 8 THEN 2 WHEN params >= 5 THEN 1 ELSE 0 END)"""


@query(
    f"""WITH {MEASURED_SQL}, p AS (SELECT *, {POINTS_SQL} AS points FROM m), s AS (SELECT *, CASE WHEN points >= 8 THEN 'critical' WHEN points >= 6 THEN 'high' WHEN points >= 3 THEN 'medium' ELSE 'low' END AS severity FROM p)
SELECT l_orderkey, l_linenumber, severity, CASE WHEN loc >= 200 THEN 'very_large' WHEN loc >= 100 THEN 'large' WHEN loc >= 50 THEN 'medium' ELSE 'small' END AS size,
CASE WHEN cc >= 15 THEN 'very_high' WHEN cc >= 10 THEN 'high' WHEN cc >= 5 THEN 'moderate' ELSE 'low' END AS complexity,
CASE WHEN coupling >= 8 THEN 'very_high' WHEN coupling >= 5 THEN 'high' WHEN coupling >= 2 THEN 'moderate' ELSE 'low' END AS coupling,
concat_ws(',', CASE WHEN coupling >= 5 THEN 'coupling' END, CASE WHEN cc >= 10 THEN 'cyclomatic_complexity' END, CASE WHEN loc >= 100 THEN 'lines_of_code' END, CASE WHEN methods >= 10 THEN 'method_count' END,
CASE WHEN params >= 5 THEN 'parameter_count' END) AS highlights,
'[' || upper(severity) || '] ' || coalesce(nullif(concat_ws('; ', CASE WHEN cc >= 15 THEN 'Very high complexity (CC=' || cc || ', >15)' WHEN cc >= 10 THEN 'High complexity (CC=' || cc || ', >10)' END,
CASE WHEN loc >= 200 THEN 'Very long code block (LOC=' || loc || ', >200)' WHEN loc >= 100 THEN 'Long code block (LOC=' || loc || ', >100)' END,
CASE WHEN coupling >= 8 THEN 'High coupling (depends on ' || coupling || ' other classes)' END), ''), 'Detected by static analysis') AS rationale,
coalesce(nullif(concat_ws('|', CASE WHEN cc >= 15 THEN 'High cyclomatic complexity increases refactoring risk' END, CASE WHEN loc >= 200 THEN 'Large code block is difficult to refactor safely' END,
CASE WHEN coupling >= 8 THEN 'High coupling means refactoring may break dependent code' END, CASE WHEN smell IN ('Long Method', 'Long Function') AND loc >= 150 THEN 'Consider extracting smaller methods incrementally' END,
CASE WHEN smell = 'God Class' AND methods >= 20 THEN 'Class has too many responsibilities to fix at once' END), ''), 'Standard refactoring complexity') AS risks FROM s"""
)
def metric_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, severity = F.col("metrics"), problems.metric_severity(F.col("metrics"))
    return measured(spark, sf_dir).select(
        "l_orderkey",
        "l_linenumber",
        severity.alias("severity"),
        problems.size_category(m).alias("size"),
        problems.complexity_category(m).alias("complexity"),
        problems.coupling_category(m).alias("coupling"),
        F.array_join(F.array_sort(F.map_keys(problems.highlights(m))), ",").alias("highlights"),
        problems.rationale(m, severity).alias("rationale"),
        F.array_join(problems.risk_factors(m, F.col("smell")), "|").alias("risks"),
    )


RULE_NAMES = [*problems.IMPACT_RULES, "Unheard Of"]
IMPACT_SEVERITIES = ["low", "medium", "high", "critical", "odd"]


@query(
    f"""WITH b AS (SELECT p_partkey, {list_sql(RULE_NAMES, 'p_partkey')} AS fix, {list_sql(IMPACT_SEVERITIES, 'p_partkey // 7')} AS severity, CASE WHEN p_size % 4 > 0 THEN p_size END AS cc FROM part),
r AS (SELECT b.*, coalesce(cc, 10)::DOUBLE AS now, coalesce(v.c, 0.1)::DOUBLE AS c, coalesce(v.k, -1.0)::DOUBLE AS k, coalesce(v.h, 1.0)::DOUBLE AS h, coalesce(v.m, 0.1)::DOUBLE AS m, coalesce(v.r, 0.25)::DOUBLE AS r
FROM b LEFT JOIN {values_sql([(n, *v) for n, v in problems.IMPACT_RULES.items()], 'fix, c, k, h, m, r')} USING (fix)),
p AS (SELECT *, {near_sql('now * (1 - c)', 1)} AS after, round((least(1.0, r + CASE severity WHEN 'low' THEN 0 WHEN 'medium' THEN 0.05 WHEN 'high' THEN 0.1 WHEN 'critical' THEN 0.15 ELSE 0.05 END))::DECIMAL(30, 12), 2)::DOUBLE AS risk FROM r)
SELECT p_partkey, after AS complexity_after, k AS coupling_change, h AS cohesion_change, round(m, 2) AS maintainability_gain, risk,
{near_sql("(now - after) / now + least(1.0, greatest(-1.0, -k / 10)) + least(1.0, greatest(0.0, h / 5)) + round(m, 2) - risk")} AS bonus FROM p"""
)
def predicted_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    complexity = F.when(F.col("p_size") % 4 > 0, F.col("p_size"))
    impact = problems.predicted_impact(picked(RULE_NAMES, F.col("p_partkey")), complexity, picked(IMPACT_SEVERITIES, F.floor(F.col("p_partkey") / 7)))
    rows = table(spark, sf_dir, "part").withColumn("i", impact)
    return rows.select("p_partkey", "i.*", near(problems.impact_bonus(F.col("i"), complexity)).alias("bonus"))


FINDING_SEVERITY = ["Critical", "high", "medium", "low", "odd", None]


@query(
    f"""WITH f AS (SELECT l_orderkey, l_linenumber, {list_sql(FINDING_SEVERITY, 'l_partkey')} AS severity, l_quantity AS v, l_suppkey % 40 AS span, l_partkey % 90 AS lines, {list_sql(RATINGS, 'l_partkey + l_linenumber')} AS rating,
l_linenumber * 2 - 1 AS radius, l_returnflag = 'R' AS tested, l_suppkey % 13 AS churn FROM lineitem),
p AS (SELECT *, CASE lower(severity) WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.85 WHEN 'medium' THEN 0.55 ELSE 0.25 END AS s, least(1, greatest(0, (v - 10) / 20)) AS m,
CASE WHEN lines = 0 THEN 0.2 ELSE least(1, greatest(0, span::DOUBLE / lines)) END AS r, CASE rating WHEN 'low' THEN 0.3 WHEN 'high' THEN 1.0 ELSE 0.6 END AS i, CASE rating WHEN 'low' THEN 0.2 WHEN 'high' THEN 0.8 ELSE 0.5 END AS b FROM f),
g AS (SELECT *, 10.0::DOUBLE * s * (0.4 + 0.6 * m) * (0.5 + 0.5 * r) * i AS gain, least(1, b * (1 + 0.15 * least(greatest(radius - 1, 0), 6)) * CASE WHEN tested THEN 1 ELSE 1.35 END) AS risk FROM p)
SELECT l_orderkey, l_linenumber, {near_sql("gain", 4)} AS gain, {near_sql("risk", 2)} AS risk, CASE WHEN risk < 0.35 THEN 'low' WHEN risk < 0.65 THEN 'medium' ELSE 'high' END AS band,
{near_sql(near_sql("gain", 2) + " * (1 + ln(1 + churn)) * s", 2)} AS interest, CASE WHEN churn >= 10 THEN 'high' WHEN churn >= 3 THEN 'medium' ELSE 'low' END AS pressure FROM g"""
)
def impact_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity, rating = picked(FINDING_SEVERITY, F.col("l_partkey")), picked(RATINGS, F.col("l_partkey") + F.col("l_linenumber"))
    gain = scoring.quality_gain(severity, scoring.magnitude(F.col("l_quantity"), F.lit(10)), scoring.reach(F.col("l_suppkey") % 40, F.col("l_partkey") % 90), rating)
    risk = scoring.change_risk(rating, F.col("l_linenumber") * 2 - 1, F.col("l_returnflag") == "R")
    rows = table(spark, sf_dir, "lineitem").withColumns({"g": gain, "r": risk})
    later = scoring.deferral(near(F.col("g"), 2), F.col("l_suppkey") % 13, severity)
    return rows.withColumn("d", later).select("l_orderkey", "l_linenumber", near(F.col("g"), 4).alias("gain"), F.col("r.value").alias("risk"), F.col("r.band").alias("band"), "d.interest", "d.pressure")


# ---- Recommendations

GOALS = ["safety_first", "balanced", "max_improvement"]
STATUS = ["executable", "executable", "executable", "advisory", "unknown"]
VALIDATION = [["syntax", "structural", "behavioural"], ["syntax", "structural"], []]


def factors() -> dict[str, Column]:
    key, line, q = F.col("l_partkey"), F.col("l_linenumber"), F.col("l_quantity")
    risk, impact = picked(RATINGS, key), picked(RATINGS, key + line)
    scale = F.when(line % 4 == 0, F.lit(None)).when(line % 4 == 1, q / 50).when(line % 4 == 2, q / 5).otherwise(q * 2)
    alternatives = F.when(F.col("l_suppkey") % 2 == 0, F.array(q / 60, q / 70))
    effective = recommendation.effective_risk(risk, picked(RATINGS, F.col("l_suppkey")), F.when(key % 3 == 0, F.col("l_discount") * 8))
    capability, mappable = picked(STATUS, F.col("l_suppkey")), key % 7 != 0
    checks = F.when(key % 3 == 0, F.array(*map(F.lit, VALIDATION[0]))).when(key % 3 == 1, F.array(*map(F.lit, VALIDATION[1]))).otherwise(F.array().cast("array<string>"))
    goal = recommendation.goal(picked([*GOALS, "odd"], line), picked(["conservative", "aggressive", "odd"], key))
    found = {
        "quality": recommendation.quality_factor(scale, alternatives, impact, risk),
        "benefit": recommendation.benefit_factor(F.when(key % 5 > 0, q / 6), F.when(line > 3, F.col("l_tax") * 4), F.when(line > 4, line * 1.0), F.when(line > 4, -line * 1.0), impact),
        "safety": recommendation.safety_factor(effective["score"], line * 2 - 1, checks, capability, mappable),
        "strategy": recommendation.strategy_factor(goal, effective["band"], impact, key % 10 == 0),
    }
    found["feedback"] = recommendation.feedback_factor(line * 3 - 2, line, F.when(key % 2 == 0, F.col("l_discount") * 5), list(found.values()))
    score = recommendation.support_score({k: F.round(v, 9) for k, v in found.items()})
    return found | {"score": score, "category": recommendation.category(score, capability, mappable, effective["band"]), "band": effective["band"]}


BASE_SQL = "CASE {0} WHEN 'low' THEN {1} WHEN 'high' THEN {3} ELSE {2} END"
FACTORS_SQL = f"""f AS (SELECT l_orderkey, l_linenumber AS line, l_partkey AS key, l_suppkey AS supp, l_quantity AS q, l_discount AS d, l_tax AS tax, {list_sql(RATINGS, 'l_partkey')} AS risk0, {list_sql(RATINGS, 'l_partkey + l_linenumber')} AS impact0,
{list_sql(RATINGS, 'l_suppkey')} AS rec0, {list_sql(STATUS, 'l_suppkey')} AS status, l_partkey % 7 <> 0 AS mappable,
CASE l_linenumber % 4 WHEN 0 THEN 'safety_first' WHEN 1 THEN 'balanced' WHEN 2 THEN 'max_improvement' ELSE CASE l_partkey % 3 WHEN 0 THEN 'safety_first' WHEN 1 THEN 'max_improvement' ELSE 'balanced' END END AS goal FROM lineitem),
b AS (SELECT *, CASE WHEN risk0 IN ('low', 'medium', 'high') THEN risk0 ELSE 'medium' END AS risk, CASE WHEN impact0 IN ('low', 'medium', 'high') THEN impact0 ELSE 'medium' END AS impact FROM f),
c AS (SELECT *, CASE WHEN rec0 IN ('low', 'medium', 'high') THEN rec0 ELSE risk END AS rec, CASE line % 4 WHEN 0 THEN NULL WHEN 1 THEN q / 50 WHEN 2 THEN q / 5 ELSE q * 2 END AS raw,
{BASE_SQL.format('risk', 0.2, 0.5, 0.8)} AS risk_base, {BASE_SQL.format('impact', 0.3, 0.6, 1.0)} AS impact_base FROM b),
e AS (SELECT *, CASE WHEN 'high' IN (risk, rec) THEN 'high' WHEN 'medium' IN (risk, rec) THEN 'medium' ELSE 'low' END AS band,
greatest(risk_base, coalesce(CASE WHEN key % 3 = 0 THEN d * 8 END, {BASE_SQL.format('rec', 0.2, 0.5, 0.8)})) AS risk_score,
CASE WHEN raw <= 1 THEN raw WHEN raw <= 10 THEN raw / 10 WHEN raw <= 100 THEN raw / 100 ELSE 1 END AS value, CASE WHEN supp % 2 = 0 THEN q / 60 END AS best FROM c),
m AS (SELECT *, CASE WHEN best IS NULL OR value <= 0 THEN 0.5 ELSE least(1, greatest(0, (value - best) / (value * 0.25))) END AS margin,
CASE WHEN key % 5 > 0 THEN least(1, q / 6 / 8.0) END AS record, CASE WHEN line > 4 THEN (tax * 4 + least(1, 0.5 + line / 10.0) + least(1, 0.5 + line / 10.0)) / 3 WHEN line > 3 THEN tax * 4 END AS predicted FROM e),
x AS (SELECT *, CASE WHEN raw IS NULL THEN 0.85 * least(1, greatest(0, impact_base - (risk_base - 0.2) * 0.5)) + 0.075 ELSE 0.85 * value + 0.15 * margin END AS quality,
coalesce(0.65 * record + 0.35 * predicted, record, predicted, 0.7 * impact_base) AS benefit,
(1 - least(1, risk_score)) * CASE WHEN line * 2 - 1 > 6 THEN 0.75 WHEN line * 2 - 1 > 3 THEN 0.85 ELSE 1 END AS s1,
CASE goal WHEN 'safety_first' THEN 0.75 WHEN 'balanced' THEN 0.5 ELSE 0.25 END AS share,
CASE goal WHEN 'safety_first' THEN {BASE_SQL.format('band', 1.0, 0.45, 0.0)} WHEN 'balanced' THEN {BASE_SQL.format('band', 0.9, 0.7, 0.3)} ELSE {BASE_SQL.format('band', 0.7, 0.8, 0.7)} END AS risk_fit,
CASE goal WHEN 'safety_first' THEN {BASE_SQL.format('impact', 0.5, 0.8, 1.0)} WHEN 'balanced' THEN {BASE_SQL.format('impact', 0.4, 0.7, 1.0)} ELSE {BASE_SQL.format('impact', 0.2, 0.6, 1.0)} END AS impact_fit FROM m),
y AS (SELECT *, least(1, CASE key % 3 WHEN 0 THEN least(1, s1 * 1.1) WHEN 1 THEN s1 * 0.95 ELSE s1 END * CASE status WHEN 'advisory' THEN 0.5 WHEN 'unknown' THEN 0.35 ELSE 1 END * CASE WHEN mappable THEN 1 ELSE 0.4 END) AS safety,
least(1, share * risk_fit + (1 - share) * impact_fit + CASE WHEN key % 10 = 0 THEN 0.15 ELSE 0 END) AS strategy FROM x),
z AS (SELECT *, CASE WHEN line * 3 - 2 < 5 THEN (quality + benefit + safety + strategy) / 4 ELSE least(1, (line + 5 * CASE WHEN key % 2 = 0 THEN d * 5 ELSE 0.5 END) / (line * 3 - 2 + 5)) END AS feedback FROM y)"""


@query(f"WITH {FACTORS_SQL} SELECT l_orderkey, line AS l_linenumber, " + ", ".join(f"{near_sql(n)} AS {n}" for n in ("quality", "benefit", "safety", "strategy", "feedback")) + ", band FROM z")
def recommendation_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = factors()
    names = ("quality", "benefit", "safety", "strategy", "feedback")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[near(found[n]).alias(n) for n in names], found["band"].alias("band"))


CLASS_SQL = "CASE WHEN {status} = 'advisory' THEN 'manual_only' WHEN {status} = 'unknown' OR NOT {mappable} OR {score} < 60 THEN 'not_recommended' WHEN {band} = 'high' OR {score} < 80 THEN 'review' ELSE 'recommended' END"


MODES = ["AIR", "RAIL", "SHIP", "TRUCK", "MAIL"]


def order_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as the steps of a plan."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority", F.expr("o_orderkey div 3").alias("supp"), (key % 7).alias("line"), picked(MODES, F.expr("o_orderkey div 5")).alias("mode"))


STEPS_SQL = f"o AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority, o_orderkey // 3 AS supp, o_orderkey % 7 AS line, {list_sql(MODES, 'o_orderkey // 5')} AS mode FROM orders)"


def classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, line = F.col("o_orderkey"), F.col("line")
    score, risk = (key % 101).cast("int"), picked(RATINGS[:3], key)
    found = recommendation.category(score, picked(STATUS, F.col("supp")), key % 11 != 0, risk)
    rows = order_steps(spark, sf_dir).withColumns({"category": F.when(line != 5, found), "risk": risk})
    return rows.withColumns({"eligible": F.col("category") == "recommended", "gain": F.when(key % 3 > 0, (key % 80) / 10), "minutes": F.when(key % 4 > 0, line * 5)})


CLASSED_SQL = f"""{STEPS_SQL}, c AS (SELECT o.*, {list_sql(RATINGS[:3], 'o_orderkey')} AS risk, CASE WHEN line <> 5 THEN
{CLASS_SQL.format(status=list_sql(STATUS, 'supp'), mappable='(o_orderkey % 11 <> 0)', score='(o_orderkey % 101)', band=list_sql(RATINGS[:3], 'o_orderkey'))} END AS category,
CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 80) / 10.0::DOUBLE END AS gain, CASE WHEN o_orderkey % 4 > 0 THEN line * 5 END AS minutes FROM o)"""


@query(
    f"""WITH {CLASSED_SQL} SELECT o_custkey, count(*) FILTER (WHERE category = 'recommended') AS recommended, count(*) FILTER (WHERE category = 'review') AS review,
count(*) FILTER (WHERE category = 'not_recommended') AS not_recommended, count(*) FILTER (WHERE category = 'manual_only') AS manual_only, count(*) FILTER (WHERE category IS NULL) AS unclassified, count(*) AS total_steps,
count(*) FILTER (WHERE category = 'recommended') AS auto_selectable, round(sum(gain) FILTER (WHERE category = 'recommended'), 2) AS projected_quality_gain,
sum(minutes) FILTER (WHERE category = 'recommended')::BIGINT AS estimated_review_minutes, sum(minutes) FILTER (WHERE category IS NOT NULL)::BIGINT AS total_review_minutes,
['low', 'medium', 'high'][max(list_position(['low', 'medium', 'high'], risk)) FILTER (WHERE category IS NOT NULL)] AS max_risk FROM c GROUP BY o_custkey"""
)
def recommendation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommendation.plan_summary(classed(spark, sf_dir), ["o_custkey"])


@query(f"WITH {CLASSED_SQL} SELECT o_custkey, o_orderkey, category, risk FROM c")
def recommendation_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classed(spark, sf_dir).select("o_custkey", "o_orderkey", "category", "risk")


# ---- Plans: orders are plans, their lines are steps

DECISIONS = ["approve", "reject", "manual", None]


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps with verdicts. A step's decisions come from an older and a newer row; the newer counts."""
    rows = classed(spark, sf_dir)
    both = F.array(F.struct(F.lit("reject").alias("decision"), F.lit(0).alias("pos")), F.struct(picked(DECISIONS, F.col("o_orderkey") + F.col("supp")).alias("decision"), F.lit(1).alias("pos")))
    said = rows.select("o_custkey", "o_orderkey", F.explode(both).alias("d")).select("o_custkey", "o_orderkey", "d.*")
    return steps.with_verdicts(rows, said, "o_custkey", "o_orderkey")


DECIDED_SQL = f"""{CLASSED_SQL}, v AS (SELECT c.*, CASE (o_orderkey + supp) % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' WHEN 2 THEN 'manual' ELSE 'pending' END AS verdict FROM c)"""


@query(
    f"""WITH {DECIDED_SQL} SELECT o_custkey, count(*) AS original_total_steps, count(*) FILTER (WHERE verdict = 'approved') AS approved_count, count(*) FILTER (WHERE verdict = 'rejected') AS rejected_count,
coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) FILTER (WHERE verdict = 'approved'), '') AS approved_ids, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) FILTER (WHERE verdict IN ('manual', 'pending')), '') AS pending_ids,
count(*) FILTER (WHERE verdict = 'approved' AND gain > 4) AS high_impact, count(*) FILTER (WHERE verdict = 'approved' AND risk = 'high') AS risk_high FROM v GROUP BY 1"""
)
def approved_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    impact = F.when(F.col("gain") > 4, "High").otherwise("low")
    found = steps.approved_plan(decided(spark, sf_dir), ["o_custkey"], "o_orderkey", impact, F.col("risk"))
    return found.select("o_custkey", "original_total_steps", "approved_count", "rejected_count", F.array_join("approved_ids", ",").alias("approved_ids"), F.array_join("pending_ids", ",").alias("pending_ids"), "high_impact", "risk_high")


@query(
    f"""WITH {DECIDED_SQL} SELECT o_custkey, count(*) FILTER (WHERE verdict = 'approved' AND category IN ('not_recommended', 'manual_only')) AS approved_not_recommended,
count(*) FILTER (WHERE verdict = 'rejected' AND category = 'recommended') AS rejected_recommended FROM v GROUP BY 1"""
)
def recommendation_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps.overrides(decided(spark, sf_dir), ["o_custkey"], F.col("category"))


@query(f"WITH {DECIDED_SQL} SELECT o_custkey, o_orderkey, mode, category FROM v WHERE verdict = 'manual'")
def manual_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps.manual_only(decided(spark, sf_dir)).select("o_custkey", "o_orderkey", "mode", "category")


@query(
    f"""WITH {DECIDED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, verdict ORDER BY o_custkey, o_orderkey) AS n FROM v)
SELECT o_orderpriority, verdict, count(*) AS n, string_agg(o_custkey || ':' || o_orderkey, ',' ORDER BY n) FILTER (WHERE n <= 5) AS detail, greatest(0, count(*) - 5) AS omitted FROM r GROUP BY ALL"""
)
def decision_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Here a priority is a plan, so that lists are cut."""
    found = steps.decision_digest(decided(spark, sf_dir), ["o_orderpriority"], F.concat_ws(":", "o_custkey", "o_orderkey"), F.struct("o_custkey", "o_orderkey"), 5)
    return found.withColumn("detail", F.array_join("detail", ","))


@query(
    f"""WITH {STEPS_SQL}, t AS (SELECT o_custkey, o_orderkey, coalesce(nullif(mode, 'AIR'), '(module level)') AS file, coalesce(nullif(o_orderstatus, 'P'), 'Unknown') AS fix FROM o),
k AS (SELECT o_custkey, string_agg(fix || '=' || n, ',' ORDER BY fix) AS refactorings FROM (SELECT o_custkey, fix, count(*) AS n FROM t GROUP BY ALL) GROUP BY 1),
b AS (SELECT o_custkey, string_agg(file || '=' || n, ',' ORDER BY n DESC, file) AS by_file FROM (SELECT o_custkey, file, count(*) AS n FROM t GROUP BY ALL) GROUP BY 1)
SELECT o_custkey, count(*) AS total_steps, any_value(refactorings) AS refactorings, any_value(by_file) AS by_file, string_agg(CASE WHEN n <= 3 THEN o_orderkey::VARCHAR END, ',' ORDER BY o_orderkey) AS detail,
greatest(0, count(*) - 3) AS omitted FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM t) JOIN k USING (o_custkey) JOIN b USING (o_custkey) GROUP BY o_custkey"""
)
def plan_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = steps.plan_digest(order_steps(spark, sf_dir), ["o_custkey"], F.nullif(F.col("mode"), F.lit("AIR")), F.nullif(F.col("o_orderstatus"), F.lit("P")), F.col("o_orderkey").cast("string"), F.col("o_orderkey"), 3)
    return found.withColumn("detail", F.array_join("detail", ","))


@query(
    """SELECT o_custkey, count(*) AS total_steps, coalesce(max(CASE WHEN o_custkey % 2 = 0 THEN 99 END), count(*) FILTER (WHERE o_orderstatus = 'F'))::BIGINT AS high_impact,
count(*) FILTER (WHERE o_totalprice > 100000) AS risk_low, 0::BIGINT AS risk_medium, count(*) FILTER (WHERE o_totalprice <= 100000) AS risk_high FROM orders GROUP BY 1"""
)
def plan_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    impact = F.when(F.col("o_orderstatus") == "F", "HIGH").otherwise("low")
    risk = F.when(F.col("o_totalprice") > 100000, "Low").otherwise("high")
    return steps.normalized(table(spark, sf_dir, "orders"), ["o_custkey"], impact, risk, F.when(F.col("o_custkey") % 2 == 0, F.lit(99).cast("long")))


@query(
    f"""WITH {STEPS_SQL}, s AS (SELECT o_custkey, o_orderkey, {list_sql(['low', '', None], 'o_orderkey')} AS risk, CASE WHEN supp % 2 = 0 THEN supp END AS score FROM o),
t AS (SELECT c_custkey AS o_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'High' WHEN 'MACHINERY' THEN 'low' ELSE c_mktsegment END AS p, c_nationkey AS score FROM customer WHERE c_nationkey > 4)
SELECT s.o_custkey, o_orderkey, coalesce(nullif(risk, ''), CASE WHEN lower(p) IN ('low', 'medium', 'high') THEN lower(p) ELSE 'medium' END) AS risk, coalesce(s.score, t.score) AS score FROM s LEFT JOIN t USING (o_custkey)"""
)
def fold_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer's segment and nation fill what an order leaves open."""
    rows = order_steps(spark, sf_dir).select("o_custkey", "o_orderkey", picked(["low", "", None], F.col("o_orderkey")).alias("risk"), F.when(F.col("supp") % 2 == 0, F.col("supp")).alias("score"))
    segment = F.when(F.col("c_mktsegment") == "BUILDING", "High").when(F.col("c_mktsegment") == "MACHINERY", "low").otherwise(F.col("c_mktsegment"))
    trace = table(spark, sf_dir, "customer").filter("c_nationkey > 4").select(F.col("c_custkey").alias("o_custkey"), segment.alias("risk"), F.col("c_nationkey").alias("score"), F.lit(0).alias("pos"))
    return steps.folded(rows, trace, ["o_custkey"], ["risk", "score"])


RANK_SQL = """(4 * CASE {impact} WHEN 'low' THEN 1 WHEN 'high' THEN 3 ELSE 2 END + 2 * CASE {risk} WHEN 'low' THEN 4 WHEN 'high' THEN 0 ELSE 2 END + CASE WHEN {impact} = 'medium' THEN 3 ELSE 0 END
+ CASE WHEN mode IN ('AIR', 'RAIL') THEN 4 ELSE 0 END + CASE {decision} WHEN 'approve' THEN 10 WHEN 'reject' THEN -50 ELSE 0 END)"""


@query(
    f"""WITH {STEPS_SQL}, s AS (SELECT o_custkey, o_orderkey, {RANK_SQL.format(impact=list_sql(RATINGS[:3], "o_orderkey"), risk=list_sql(RATINGS, "supp"), decision=list_sql(DECISIONS, "line"))} AS score,
{list_sql(DECISIONS, 'line')} AS d FROM o) SELECT o_custkey, o_orderkey, score, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderkey)::INT AS new_step FROM s WHERE d IS DISTINCT FROM 'reject'"""
)
def preference_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    decision = picked(DECISIONS, F.col("line"))
    score = steps.preference_score(picked(RATINGS[:3], F.col("o_orderkey")), picked(RATINGS, F.col("supp")), F.col("mode"), decision, "conservative", "medium", ["AIR", "RAIL"])
    return steps.reranked(order_steps(spark, sf_dir), ["o_custkey"], score, decision, "o_orderkey").select("o_custkey", "o_orderkey", "score", "new_step")


STEP_NAMES = ["Extract Method", "Rename Class", "Remove Dead Code", "Introduce Constant", "Replace Literal", "Move Method", "Encapsulate Variable", "Fault injection (x)", "extract constant", "Replace Unsafe Function", ""]


@query(
    f"""WITH s AS (SELECT p_partkey, p_size, {list_sql(STEP_NAMES, 'p_partkey')} AS fix, p_size % 2 = 0 AS e, p_size % 3 = 0 AS t, p_size % 5 > 0 AS m FROM part),
a AS (SELECT *, CASE WHEN lower(fix) LIKE 'fault injection%' THEN 'fault_injection' WHEN fix = 'Extract Method' THEN 'extract_method' WHEN fix = 'Rename Class' THEN 'rename_symbol' WHEN fix = 'Remove Dead Code' THEN 'remove_dead_code'
WHEN fix = 'Introduce Constant' THEN 'introduce_constant' WHEN fix = 'Replace Literal' THEN 'replace_literal' WHEN fix = 'Encapsulate Variable' THEN 'encapsulate_variable' WHEN fix = 'extract constant' THEN 'extract_constant'
WHEN fix = 'Replace Unsafe Function' THEN 'replace_unsafe_function' END AS action FROM s),
g AS (SELECT *, CASE action WHEN 'extract_method' THEN m AND e AND t WHEN 'rename_symbol' THEN m AND e WHEN 'remove_dead_code' THEN m OR e WHEN 'introduce_constant' THEN t WHEN 'extract_constant' THEN t
WHEN 'replace_literal' THEN false WHEN 'encapsulate_variable' THEN false WHEN 'fault_injection' THEN false WHEN 'replace_unsafe_function' THEN false ELSE false END AS ok FROM a)
SELECT p_partkey, ok AS mappable, CASE WHEN ok THEN action END AS action FROM g"""
)
def step_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps with some of the parameters: a new name and a first line, a last line and a literal, a method as the target."""
    size = F.col("p_size")
    entry = lambda on, k: F.when(on, F.struct(F.lit(k).alias("k"), F.lit("x").alias("v")))
    params = F.map_from_entries(F.array_compact(F.array(entry(size % 2 == 0, "new_name"), entry(size % 2 == 0, "start_line"), entry(size % 3 == 0, "end_line"), entry(size % 3 == 0, "literal_value"))))
    target = F.map_from_entries(F.array_compact(F.array(entry(size % 5 > 0, "method"))))
    rows = table(spark, sf_dir, "part").withColumn("m", steps.mapped(picked(STEP_NAMES, F.col("p_partkey")), params, target))
    return rows.select("p_partkey", "m.mappable", "m.action")


@query(
    f"""WITH {STEPS_SQL}, s AS (SELECT o_custkey, o_orderkey, CASE mode WHEN 'AIR' THEN '' WHEN 'RAIL' THEN 'unknown' ELSE mode END AS e, o_orderstatus AS a, CASE WHEN supp % 3 = 0 THEN supp % 4 END AS g,
a = 'F' OR o_orderkey % 13 = 5 AS removes FROM o),
d AS (SELECT DISTINCT o_custkey, e FROM s WHERE removes AND e NOT IN ('', 'unknown')), k AS (SELECT s.* FROM s LEFT JOIN d USING (o_custkey, e) WHERE d.e IS NULL OR removes),
n AS (SELECT * FROM k WHERE e <> '' QUALIFY row_number() OVER (PARTITION BY o_custkey, e, a ORDER BY o_orderkey) = 1 UNION ALL SELECT * FROM k WHERE e = '')
SELECT o_custkey, o_orderkey FROM n WHERE g IS NULL UNION ALL SELECT o_custkey, o_orderkey FROM (SELECT * FROM n WHERE g IS NOT NULL QUALIFY row_number() OVER (PARTITION BY o_custkey, g ORDER BY o_orderkey) = 1)"""
)
def prune_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as steps on a mode; finished ones and some of dead code remove it, some belong to groups of duplicates."""
    entity = F.when(F.col("mode") == "AIR", "").when(F.col("mode") == "RAIL", "unknown").otherwise(F.col("mode"))
    rows = order_steps(spark, sf_dir).select("o_custkey", "o_orderkey", entity.alias("e"), F.col("o_orderstatus").alias("a"), F.when(F.col("supp") % 3 == 0, F.col("supp") % 4).alias("g"), F.when(F.col("o_orderkey") % 13 == 5, "UnreachableCode").when(F.col("o_orderkey") % 13 == 6, "LongMethod").alias("smell"))
    return sets.prune_conflicts(rows, "o_custkey", "e", "a", "o_orderkey", ["F"], "g", "smell").select("o_custkey", "o_orderkey")


@query(
    """WITH RECURSIVE i AS (SELECT l_orderkey, l_linenumber, l_quantity::INT % 25 AS c, l_extendedprice AS v FROM lineitem WHERE l_returnflag <> 'N' AND l_discount <= 0.35 AND l_tax < 0.07),
n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM i),
s AS (SELECT DISTINCT l_orderkey, 0::BIGINT AS k, 0::DOUBLE AS v, 0 AS c FROM n
UNION ALL SELECT n.l_orderkey, n.k, CASE WHEN t.take THEN s.v + n.v ELSE s.v END, CASE WHEN t.take THEN s.c + n.c ELSE s.c END FROM s JOIN n ON n.l_orderkey = s.l_orderkey AND n.k = s.k + 1
CROSS JOIN (VALUES (true), (false)) AS t(take) WHERE NOT t.take OR s.c + n.c <= 20)
SELECT l_orderkey, round(max(v), 4) AS points FROM s GROUP BY 1 HAVING max(v) > 0"""
)
def knapsack_preset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best value of low-risk executable lines within 20 minutes."""
    status = F.when((F.col("l_returnflag") != "N") & (F.col("l_tax") < 0.07), "executable").otherwise("advisory")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", status.alias("status"), F.col("l_extendedprice").alias("points"), F.lit(0.0).alias("interest"), (F.col("l_quantity").cast("int") % 25).alias("cost"), F.col("l_discount").alias("risk"))
    found = grouped.choose_preset(rows, "l_orderkey", "l_linenumber", "cost", 20, "risk", "safe_wins")
    return found.groupBy("l_orderkey").agg(F.round(F.sum("points"), 4).alias("points"))


# ---- Checks

CHECKS_SQL = """c AS (SELECT l_orderkey, l_linenumber, l_quantity / 40 AS syntax, l_quantity <= 45 AS syntax_ok, 1 - l_discount AS shape, l_discount < 0.09 AS shape_ok, l_tax * 12 AS behaviour, l_tax > 0 AS behaviour_ok,
l_returnflag <> 'N' AS applies, CASE WHEN l_linenumber % 2 = 0 THEN l_tax * 10 END AS invariant, l_suppkey % 9 > 0 AS invariant_ok FROM lineitem)"""


@query(
    f"""WITH {CHECKS_SQL}, p AS (SELECT *, CASE WHEN syntax_ok THEN least(1, syntax) ELSE 0 END AS a, CASE WHEN shape_ok THEN least(1, shape) ELSE 0 END AS b, CASE WHEN behaviour_ok THEN least(1, behaviour) ELSE 0 END AS c FROM c),
s AS (SELECT *, CASE WHEN applies THEN 0.35 * a + 0.35 * b + 0.3 * c ELSE (0.35 * a + 0.35 * b) / 0.7 END AS base FROM p),
f AS (SELECT *, CASE WHEN invariant IS NULL THEN base ELSE 0.85 * base + 0.15 * CASE WHEN invariant_ok THEN least(1, invariant) ELSE 0 END END AS score,
NOT syntax_ok OR NOT shape_ok OR NOT behaviour_ok OR (invariant IS NOT NULL AND NOT invariant_ok) AS failed FROM s)
SELECT l_orderkey, l_linenumber, {near_sql("CASE WHEN failed THEN least(score, 0.49) ELSE score END")} AS confidence FROM f"""
)
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = {
        "syntax": (F.col("l_quantity") / 40, F.col("l_quantity") <= 45),
        "structural": (1 - F.col("l_discount"), F.col("l_discount") < 0.09),
        "behavioral": (F.col("l_tax") * 12, F.col("l_tax") > 0),
    }
    invariant = (F.when(F.col("l_linenumber") % 2 == 0, F.col("l_tax") * 10), F.col("l_suppkey") % 9 > 0)
    score = validation.confidence(checks, F.col("l_returnflag") != "N", invariant)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", near(score).alias("confidence"))


@query(
    f"""WITH {STEPS_SQL}, c AS (SELECT o_custkey, o_orderkey, CASE mode WHEN 'AIR' THEN 'behavioral' ELSE lower(mode) END AS name, line > 1 AS ok FROM o)
SELECT o_custkey, count(*) FILTER (WHERE NOT ok AND name <> 'behavioral') > 0 AS rollback,
coalesce('Validation failed at stage(s): ' || string_agg(name, ', ' ORDER BY o_orderkey) FILTER (WHERE NOT ok AND name <> 'behavioral'), '') AS reason FROM c GROUP BY 1"""
)
def rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("mode") == "AIR", "behavioral").otherwise(F.lower("mode"))
    rows = order_steps(spark, sf_dir).select("o_custkey", "o_orderkey", name.alias("name"), (F.col("line") > 1).alias("ok"))
    return validation.rollback(rows, ["o_custkey"], "name", "ok", "o_orderkey", on_behavior=False)


BEHAVIOUR_SQL = """b AS (SELECT l_orderkey, l_linenumber, l_partkey % 23 = 0 AS to1, l_suppkey % 19 = 0 AS to2, l_partkey % 5 > 0 AS ok1, l_suppkey % 5 > 0 AS ok2, CASE l_partkey % 4 WHEN 0 THEN 'ValueError' WHEN 1 THEN 'HarnessError' WHEN 2 THEN 'KeyError' END AS e1,
CASE l_suppkey % 4 WHEN 0 THEN 'ValueError' WHEN 2 THEN 'KeyError' END AS e2, CASE WHEN l_linenumber = 1 THEN 'int' END AS t1, CASE WHEN l_suppkey % 3 = 0 THEN 'str' WHEN l_linenumber = 1 THEN 'int' END AS t2,
l_returnflag AS v1, l_returnflag AS v2, l_linestatus AS o1, CASE WHEN l_tax > 0.06 THEN 'x' ELSE l_linestatus END AS o2 FROM lineitem)"""


@query(
    f"""WITH {BEHAVIOUR_SQL} SELECT l_orderkey, l_linenumber, CASE WHEN to1 AND to2 THEN 'both_timed_out' WHEN to1 THEN 'original_timed_out' WHEN to2 THEN 'transformed_timed_out' WHEN e1 = 'HarnessError' THEN 'fingerprint_execution_failed'
WHEN ok1 AND NOT ok2 THEN 'original_succeeds_transformed_fails' WHEN ok2 AND NOT ok1 THEN 'transformed_succeeds_original_fails' WHEN NOT ok1 THEN CASE WHEN e1 IS NOT DISTINCT FROM e2 THEN 'same_exception' ELSE 'exception_type_mismatch' END
WHEN t1 IS DISTINCT FROM t2 THEN 'return_type_mismatch' WHEN v1 <> v2 THEN 'return_value_mismatch' WHEN o1 <> o2 THEN 'stdout_mismatch' ELSE 'match' END AS verdict FROM b"""
)
def behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = lambda c, also: F.when(c % 4 == 0, "ValueError").when((c % 4 == 1) & also, "HarnessError").when(c % 4 == 2, "KeyError")
    key, supp, first = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber") == 1
    a = F.struct((key % 23 == 0).alias("timeout"), (key % 5 > 0).alias("success"), error(key, F.lit(True)).alias("exception_type"), F.when(first, "int").alias("return_type"), F.col("l_returnflag").alias("return_value"), F.col("l_linestatus").alias("stdout"))
    b = F.struct((supp % 19 == 0).alias("timeout"), (supp % 5 > 0).alias("success"), error(supp, F.lit(False)).alias("exception_type"), F.when(supp % 3 == 0, "str").when(first, "int").alias("return_type"), F.col("l_returnflag").alias("return_value"),
                 F.when(F.col("l_tax") > 0.06, "x").otherwise(F.col("l_linestatus")).alias("stdout"))
    return table(spark, sf_dir, "lineitem").withColumns({"a": a, "b": b}).select("l_orderkey", "l_linenumber", validation.behaviour_verdict("a", "b").alias("verdict"))


@query(
    """SELECT event_type, count(value) AS n, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS average, min(length(props)) AS shortest, max(length(props)) AS longest,
count(*) FILTER (WHERE value > 50) AS n_true, count(*) FILTER (WHERE NOT value > 50) AS n_false FROM events GROUP BY 1"""
)
def value_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, by = table(spark, sf_dir, "events"), ["event_type"]
    lengths = validation.length_summary(rows, by, F.char_length("props")).select("event_type", F.col("min_size").cast("long").alias("shortest"), F.col("max_size").cast("long").alias("longest"))
    flags = validation.boolean_summary(rows, by, F.col("value") > 50).drop("n")
    return validation.numeric_summary(rows, by, F.col("value")).join(lengths, by).join(flags, by)


@query(
    """SELECT doc_id, text IS NULL AS text_null, coalesce(text <> '', false) AS text_truthy, length(text)::INT AS text_length, (len(string_split(text, chr(10))) - 1 + (text <> '')::INT)::INT AS text_lines,
CASE WHEN n_chars - 200 < 0 THEN 'negative' WHEN n_chars > 200 THEN 'positive' ELSE 'zero' END AS sign, len(list_distinct(string_split(text, ' ')))::INT AS distinct_words, len(list_distinct(string_split(text, ' '))) = 1 AS homogeneous FROM documents"""
)
def value_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").withColumns({"s": validation.string_invariants(F.col("text")), "n": validation.number_invariants(F.col("n_chars") - 200), "c": validation.collection_invariants(F.split("text", " "))})
    return rows.select("doc_id", F.col("s.is_null").alias("text_null"), F.col("s.truthy").alias("text_truthy"), F.col("s.length").alias("text_length"), F.col("s.line_count").alias("text_lines"), "n.sign", F.col("c.distinct").alias("distinct_words"), "c.homogeneous")


@query(
    r"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS t FROM documents),
n AS (SELECT doc_id, max(line) AS last FROM l GROUP BY 1), f AS (SELECT doc_id, 1 + doc_id % 9 AS start, 1 + doc_id % 9 + doc_id % 3 AS stop, CASE WHEN doc_id % 4 > 0 THEN 'e[nr] ' END AS pattern FROM documents),
h AS (SELECT f.doc_id, max((line = start)::INT) = 1 AS here, count(*) AS n, min(line) AS spot FROM f JOIN l ON l.doc_id = f.doc_id AND abs(line - start) <= 2 AND regexp_matches(t, 'e[nr] ') WHERE pattern IS NOT NULL GROUP BY 1),
j AS (SELECT f.*, n.last, CASE WHEN pattern IS NULL OR here THEN start WHEN h.n = 1 THEN spot END AS found FROM f JOIN n USING (doc_id) LEFT JOIN h USING (doc_id))
SELECT doc_id, CASE WHEN start <= last THEN found END AS found, CASE WHEN start <= last AND found IS NOT NULL THEN least(last, found + stop - start) END AS found_end,
CASE WHEN start > last THEN 'beyond the end of the file' WHEN found IS NULL THEN 'not found near the line' END AS unmapped FROM j"""
)
def verify_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stated line of each document against its text."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "text")).select("doc_id", (F.col("p") + 1).cast("long").alias("line"), "text")
    start = 1 + F.col("doc_id") % 9
    wanted = docs.select("doc_id", F.col("doc_id").alias("id"), start.alias("start"), (start + F.col("doc_id") % 3).alias("end"), F.when(F.col("doc_id") % 4 > 0, "e[nr] ").alias("pattern"))
    return validation.located(wanted, lines, ["doc_id"], 2).drop("id")


# ---- Events and reports

ACTIONS = {"signup": "plan_generated", "view": "transformation_run", "click": "transformation_completed", "purchase": "transformation_accepted", "error": "other"}


@query(
    """WITH d AS (SELECT user_id, event_type, value, event_id FROM events),
c AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'signup' AND event_id % 3 = 0) AS plans_remote, count(*) FILTER (WHERE event_type = 'signup' AND event_id % 3 <> 0) AS plans_fallback, count(*) FILTER (WHERE event_type = 'view') AS runs,
count(*) FILTER (WHERE event_type = 'view' AND value > 20) AS run_successes, count(*) FILTER (WHERE event_type = 'view' AND value < 5) AS rollbacks, coalesce(sum(event_id % 10) FILTER (WHERE event_type = 'view'), 0)::BIGINT AS actions,
coalesce(sum(event_id % 5) FILTER (WHERE event_type = 'view'), 0)::BIGINT AS executable, coalesce(sum(event_id % 7) FILTER (WHERE event_type = 'click'), 0)::BIGINT AS passed, coalesce(sum(event_id % 3) FILTER (WHERE event_type = 'click'), 0)::BIGINT AS failed,
coalesce(sum(event_id % 4) FILTER (WHERE event_type = 'purchase'), 0)::BIGINT AS accepted, coalesce(sum(event_id % 2) FILTER (WHERE event_type = 'purchase'), 0)::BIGINT AS rejected FROM d GROUP BY 1)
SELECT *, round(plans_remote / nullif(plans_remote + plans_fallback, 0), 6) AS remote_rate, round(run_successes / nullif(runs, 0), 6) AS success_rate, round(rollbacks / nullif(runs, 0), 6) AS rollback_rate,
round(executable / nullif(actions, 0), 6) AS executable_rate, round(passed / nullif(passed + failed, 0), 6) AS step_pass_rate, round(accepted / nullif(accepted + rejected, 0), 6) AS file_acceptance_rate FROM c"""
)
def orchestration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("action", F.try_element_at(scalars.literal_map(ACTIONS), F.col("event_type")))
    key, zero = F.col("event_id"), F.lit(0)
    details = {"source": F.when(key % 3 == 0, "remote").otherwise("local"), "success": F.col("value") > 20, "rollback": F.col("value") < 5, "actions": key % 10, "executable": key % 5, "noops": zero, "files_sent": zero, "files_missing": zero}
    details |= {"passed": key % 7, "failed": key % 3, "accepted": key % 4, "rejected": key % 2}
    return events.orchestration(rows, ["user_id"], "action", details).drop("noops", "files_sent", "files_missing", "noop_rate", "resolution_rate")


@query(
    """SELECT l_suppkey, count(*) AS total, count(*) FILTER (WHERE l_quantity > 25) AS viable, count(DISTINCT l_orderkey) FILTER (WHERE l_quantity > 25) AS findings_with_viable,
round(count(*) FILTER (WHERE l_quantity > 25) / count(*), 4) AS pass_rate FROM lineitem GROUP BY 1"""
)
def precondition_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.precondition_rates(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_orderkey", F.col("l_quantity") > 25)


@query(
    """SELECT o_custkey, count(*) AS executed, count(*) FILTER (WHERE o_totalprice > 300000 OR o_orderstatus = 'F') AS successful,
round(count(*) FILTER (WHERE o_totalprice > 300000 OR o_orderstatus = 'F') / count(*), 4) AS success_rate FROM orders GROUP BY 1"""
)
def downstream_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "Applied").otherwise("skipped")
    return events.success_rates(table(spark, sf_dir, "orders"), ["o_custkey"], F.when(F.col("o_totalprice") > 300000, True), status)


@query("WITH g AS (SELECT user_id, event_type, count(*) AS entries, min(event_id) AS first FROM events GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first)::INT AS place FROM g")
def stage_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.by_stage(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


@query(
    """WITH f AS (SELECT c_nationkey, c_custkey, arg_min(o_totalprice, o_orderkey) AS s FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' GROUP BY ALL),
m AS (SELECT c_nationkey, avg(s) AS m FROM f GROUP BY 1)
SELECT n_nationkey, round(coalesce(CASE WHEN n_nationkey % 5 = 0 THEN n_nationkey::DOUBLE END, m, 0), 6) AS quality_before FROM nation LEFT JOIN m ON c_nationkey = n_nationkey"""
)
def quality_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as workflows, customers as files, orders as findings with a score."""
    found = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey")), "o_custkey")
    found = found.withColumn("score", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice").cast("double")))
    reports = table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 5 == 0, F.col("n_nationkey")).alias("stated"))
    return rollups.quality_before(reports, found, ["n_nationkey"], "stated", "o_custkey", "score", "o_orderkey")


@query(
    """WITH c AS (SELECT l_partkey, count(*) AS commits FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' - INTERVAL 90 DAY AND l_shipdate < DATE '1996-01-01' GROUP BY 1),
s AS (SELECT p_partkey FROM part) SELECT p_partkey, coalesce(commits, 0) AS churn FROM s LEFT JOIN c ON l_partkey = p_partkey"""
)
def churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments of a part in the 90 days before a date as changes of a file."""
    paths = table(spark, sf_dir, "part").select("p_partkey")
    changes = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_shipdate").alias("day"))
    return joins.churn(paths, changes, "p_partkey", "day", F.lit("1996-01-01").cast("date"), 90)


PATHS_SQL = "f AS (SELECT 'src/' || lower(replace(c_mktsegment, ' ', '_')) || '/m' || c_nationkey || '.py' AS path FROM customer UNION SELECT 'tests/test_m' || n_nationkey || '_' || lower(replace(n_name, ' ', '')) || '.py' FROM nation WHERE n_regionkey < 3)"


@query(
    rf"""WITH {PATHS_SQL}, s AS (SELECT path, regexp_replace(lower(regexp_extract(path, '[^/]*$')), '\.[^.]*$', '') AS stem FROM f)
SELECT s.path, length(s.stem) >= 3 AND EXISTS (SELECT 1 FROM f WHERE f.path <> s.path AND (lower(f.path) LIKE '%test%' OR lower(f.path) LIKE '%spec%') AND contains(lower(f.path), s.stem)) AS tested FROM s"""
)
def test_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "customer").select(F.concat(F.lit("src/"), F.lower(F.regexp_replace("c_mktsegment", " ", "_")), F.lit("/m"), "c_nationkey", F.lit(".py")).alias("path"))
    tests = table(spark, sf_dir, "nation").filter("n_regionkey < 3").select(F.concat(F.lit("tests/test_m"), "n_nationkey", F.lit("_"), F.lower(F.regexp_replace("n_name", " ", "")), F.lit(".py")).alias("path"))
    return joins.tested(sources.unionByName(tests).distinct(), "path")


@query(
    """WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY nullif(p_size, 0) DESC NULLS LAST, p_partkey) AS rank FROM part)
SELECT p_brand, round(avg((rank % 3 = p_partkey % 3)::INT), 6) AS accuracy, round(avg(p_partkey % 100), 6) AS latency, count(*) AS n, round(avg(1.0 / rank), 6) AS mrr,
round(avg(CASE WHEN rank <= 3 THEN 1.0 / log2(rank + 1.0) ELSE 0 END), 6) AS ndcg, round(avg((rank <= 3)::INT), 6) AS top_k, round(avg((rank = 1)::INT), 6) AS top_1 FROM r JOIN part USING (p_brand, p_partkey) GROUP BY 1"""
)
def system_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size", F.col("p_partkey").alias("pos"))
    ranked = ranking.rank_of_expected(parts, parts.select("p_brand", "p_partkey"), ["p_brand"], "p_partkey", "p_size", "pos")
    return metrics.system_comparison(ranked, ["p_brand"], F.col("rank") % 3, F.col("p_partkey") % 3, F.col("rank"), (F.col("p_partkey") % 100).cast("double"))


# ---- Column functions

PATH_FORMS = ["C:\\src\\A.java", "//a//b/test_x.py", "/tests/Helper.PY", "src/OrderTest.java", "src/Testing.java", "x/conftest.py", "lib.c", "y_tests.py", "inc/Z.H", "noext", "a/TestCase.java", "tests.py"]


@query(
    rf"""WITH p AS (SELECT p_partkey, {list_sql(PATH_FORMS, 'p_partkey')} AS raw FROM part), n AS (SELECT *, regexp_replace(regexp_replace(replace(raw, chr(92), '/'), '^([A-Za-z]:)?/+', ''), '/+', '/', 'g') AS path FROM p),
b AS (SELECT *, regexp_extract(path, '[^/]*$') AS base FROM n), s AS (SELECT *, regexp_replace(base, '\.[^.]*$', '') AS stem, lower(regexp_extract(base, '\.[^.]+$')) AS ext FROM b)
SELECT p_partkey, path, base, CASE ext WHEN '.py' THEN 'python' WHEN '.java' THEN 'java' WHEN '.c' THEN 'c' WHEN '.h' THEN 'c' END AS language,
CASE WHEN ext = '.java' THEN regexp_matches(stem, '^Test[A-Z]|[a-z0-9](Test|Tests|IT)$') ELSE regexp_matches(lower(stem), '^test_|_tests?$|^conftest$|^tests$') END AS is_test FROM s"""
)
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", picked(PATH_FORMS, F.col("p_partkey")).alias("raw"))
    path = scalars.normalize_path(F.col("raw"))
    return rows.select("p_partkey", path.alias("path"), scalars.file_name(path).alias("base"), scalars.detect_language(path).alias("language"), scalars.is_test_file(path).alias("is_test"))


NUMBERS = ["3.5", " 12 ", "abc", "", "1e3", "-7", "NaN", "Infinity", None, "0.25"]


@query(
    rf"""WITH p AS (SELECT p_partkey, p_size, {list_sql(NUMBERS, 'p_partkey')} AS raw FROM part), d AS (SELECT *, CASE WHEN regexp_matches(trim(raw), '^-?[0-9.]+(e[0-9]+)?$') THEN trim(raw)::DOUBLE END AS x FROM p)
SELECT p_partkey, x AS number, round(x / nullif(p_size % 4, 0), 6) AS ratio, round(coalesce(x / nullif(p_size % 4, 0), 0), 6) AS ratio_or_zero, round(100 * x / nullif(p_size % 4, 0), 1) AS percent, CASE WHEN x IS NOT NULL THEN least(1, greatest(0, x)) END AS clamped,
round(CASE WHEN x < 0 THEN 0 WHEN x <= 1 THEN x WHEN x <= 10 THEN x / 10 WHEN x <= 100 THEN x / 100 WHEN x IS NOT NULL THEN 1 END, 6) AS scaled, round((x - 1) / 2, 6) AS min_max,
round(CASE WHEN greatest(p_size, p_partkey % 50) = 0 THEN 1 ELSE 1 - abs(p_size - p_partkey % 50) / greatest(p_size, p_partkey % 50) END, 6) AS similar, least(30 * pow(2, greatest(0, p_size % 8 - 1)), 900) AS backoff FROM d"""
)
def number_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", scalars.number(picked(NUMBERS, F.col("p_partkey"))).alias("number"))
    x, four = F.col("number"), F.col("p_size") % 4
    return rows.select(
        "p_partkey",
        "number",
        F.round(scalars.ratio(x, four), 6).alias("ratio"),
        F.round(scalars.ratio_or_zero(x, four), 6).alias("ratio_or_zero"),
        scalars.percent(x, four).alias("percent"),
        scalars.clamp(x).alias("clamped"),
        F.round(scalars.score_scale(x)["value"], 6).alias("scaled"),
        F.round(scalars.min_max(x), 6).alias("min_max"),
        F.round(scalars.count_similarity(F.col("p_size"), F.col("p_partkey") % 50), 6).alias("similar"),
        scalars.backoff_seconds(F.col("p_size") % 8).alias("backoff"),
    )


CODE_NAMES = ["a.b.C#run x(int)", "pkg.Klass", "m.f", "a.B#go(", "Solo"]


@query(
    rf"""WITH p AS (SELECT p_partkey, p_name, p_size, {list_sql(CODE_NAMES, 'p_partkey')} AS code, {list_sql(['method', 'class', 'Function'], 'p_partkey')} AS kind, {list_sql([' High', 'LOW', 'odd', None, 'medium'], 'p_size')} AS severity FROM part)
SELECT p_partkey, CASE WHEN lower(kind) IN ('function', 'method') AND contains(code, '#') THEN regexp_extract(trim(split_part(code, '#', 2)), '^[^ (]*') ELSE regexp_extract(split_part(code, '#', 1), '[^.]*$') END AS entity,
trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS name, substr(sha1(p_name || '|' || p_size), 1, 20) AS content_key, substr(sha1(p_name), 1, 20) AS fingerprint, coalesce(p_partkey::VARCHAR, '') || '|' || code || '|' AS identity,
CASE WHEN lower(trim(severity)) IN ('high', 'medium', 'low') THEN lower(trim(severity)) ELSE 'low' END AS severity, CASE code WHEN 'Solo' THEN 'LongMethod' ELSE code END AS smell FROM p"""
)
def name_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, code = F.col("p_partkey"), picked(CODE_NAMES, F.col("p_partkey"))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        scalars.entity_name(code, picked(["method", "class", "Function"], key)).alias("entity"),
        scalars.normalize_name(F.col("p_name")).alias("name"),
        scalars.content_key(F.col("p_name"), F.col("p_size").cast("string")).alias("content_key"),
        scalars.token_fingerprint(F.split("p_name", " ")).alias("fingerprint"),
        steps.identity(key, code, F.lit(None).cast("string")).alias("identity"),
        scalars.normalize_severity(picked([" High", "LOW", "odd", None, "medium"], F.col("p_size"))).alias("severity"),
        scalars.canonical_smell(F.when(code == "Solo", "LongFunction").otherwise(code)).alias("smell"),
    )


@query(
    """WITH l AS (SELECT l_orderkey, list_sort(list_distinct(list(l_suppkey % 12))) AS a, list_sort(list_distinct(list(l_partkey % 9))) AS b, list(l_suppkey % 12) AS raw FROM lineitem GROUP BY 1),
u AS (SELECT l_orderkey, unnest(a) AS x, a FROM l), s AS (SELECT l_orderkey, x, row_number() OVER (PARTITION BY l_orderkey ORDER BY x) AS n FROM u WHERE NOT list_contains(a, x - 1)),
e AS (SELECT l_orderkey, x, row_number() OVER (PARTITION BY l_orderkey ORDER BY x) AS n FROM u WHERE NOT list_contains(a, x + 1)),
r AS (SELECT l_orderkey, string_agg(CASE WHEN s.x = e.x THEN s.x::VARCHAR ELSE s.x || '-' || e.x END, ', ' ORDER BY n) AS ranges FROM s JOIN e USING (l_orderkey, n) GROUP BY 1)
SELECT l_orderkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard, array_to_string(a[1:3], ', ') || CASE WHEN len(a) > 3 THEN ' and ' || (len(a) - 3) || ' more' ELSE '' END AS lines, ranges,
array_to_string(a[1:2], ',') AS first_two, greatest(0, len(a) - 2) AS omitted FROM l JOIN r USING (l_orderkey)"""
)
def list_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_suppkey") % 12).alias("raw"), F.collect_set(F.col("l_partkey") % 9).alias("b"))
    ordered = F.array_sort(F.array_distinct("raw"))
    cut = scalars.capped(ordered, 2)
    return rows.select(
        "l_orderkey",
        F.round(scalars.jaccard(F.array_distinct("raw"), F.col("b")), 6).alias("jaccard"),
        scalars.line_summary(F.col("raw"), 3).alias("lines"),
        scalars.id_ranges(F.col("raw"), 12).alias("ranges"),
        F.array_join(cut["items"], ",").alias("first_two"),
        cut["omitted"].alias("omitted"),
    )


@query(
    """WITH t AS (SELECT user_id, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1)
SELECT user_id, round(date_diff('microsecond', a, b) / 6e7, 6) AS minutes, strftime(a, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS stamp, strftime(a, '%Y-%m-%d %H:%M:%S.%f') AS parsed FROM t"""
)
def time_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    parsed = scalars.parse_time(F.date_format("a", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return rows.select("user_id", F.round(scalars.minutes_between(F.col("a"), F.col("b")), 6).alias("minutes"), scalars.stamp(F.col("a")).alias("stamp"), F.date_format(parsed, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("parsed"))


# ---- Sets


@query(
    """SELECT 0 AS part, doc_id, lang AS name FROM documents WHERE lang = 'en' UNION ALL SELECT 1, doc_id, lang FROM documents WHERE lang = 'de'"""
)
def union_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("name"))
    return sets.union_in_order(docs.filter("name = 'en'"), docs.filter("name = 'de'"))


@query("SELECT source AS name FROM documents UNION SELECT lang FROM documents UNION SELECT event_type FROM events")
def union_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sets.union_names(docs.select(F.col("source").alias("name")), docs.select(F.col("lang").alias("name")), table(spark, sf_dir, "events").select(F.col("event_type").alias("name")))


@query(
    """WITH p AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'Brand' ELSE 'x/' || p_type || '/' || p_name || '.c' END AS full, p_name || '.c' AS base, p_partkey FROM part),
u AS (SELECT base, min('x/' || p_type || '/' || p_name || '.c') AS full FROM (SELECT *, p_name || '.c' AS base FROM part) GROUP BY 1 HAVING count(DISTINCT 'x/' || p_type || '/' || p_name || '.c') = 1)
SELECT p_partkey, coalesce(u.full, p_name || '.c') AS path FROM part LEFT JOIN u ON u.base = p_name || '.c'"""
)
def restore_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base names of part files become the one path that ends in them."""
    parts = table(spark, sf_dir, "part")
    full = parts.select(F.concat(F.lit("x/"), "p_type", F.lit("/"), "p_name", F.lit(".c")).alias("path"))
    return joins.restore_paths(parts.select("p_partkey", F.concat("p_name", F.lit(".c")).alias("path")), "path", full.withColumnRenamed("path", "known"), "known")


@query(
    """WITH r AS (SELECT o_custkey AS k, o_orderkey AS id, o_orderkey % 90 AS a, o_orderkey % 90 + 10 AS b FROM orders WHERE o_orderstatus <> 'F'),
m AS (SELECT o_custkey AS k, o_orderkey AS id, o_orderkey % 97 AS line, o_totalprice AS score FROM orders WHERE o_orderstatus = 'F'),
f AS (SELECT m.k, m.id, min(r.id) AS rule, any_value(m.score) AS score FROM m JOIN r ON r.k = m.k AND m.line BETWEEN r.a AND r.b GROUP BY ALL)
SELECT r.k, r.id, CASE WHEN max(f.score) IS NULL THEN 'rule' ELSE 'rule+ml' END AS source, max(f.score) AS score FROM r LEFT JOIN f ON f.k = r.k AND f.rule = r.id GROUP BY ALL
UNION ALL SELECT m.k, m.id, 'ml', m.score FROM m LEFT JOIN f USING (k, id) WHERE f.id IS NULL"""
)
def hybrid_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's open orders as rule findings, finished ones as a model's."""
    orders, place = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 90
    rules = orders.filter("o_orderstatus <> 'F'").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), place.alias("start"), (place + 10).alias("end"))
    model = orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 97).alias("line"), F.col("o_totalprice").alias("score"))
    return joins.hybrid_merge(rules, model, ["k"])


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def distinct_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.distinct_in_order(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey")


@query("SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def get_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of ordered parts that are not among the large ones."""
    known = table(spark, sf_dir, "part").filter("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    return sets.get_or_create(known, table(spark, sf_dir, "lineitem").select("l_partkey"), ["l_partkey"])


@query(
    """SELECT 'l_orderkey' AS "column", 0::BIGINT AS nulls, count(*) AS "rows" FROM lineitem UNION ALL SELECT 'm', count(*) - count(nullif(l_returnflag, 'R')), count(*) FROM lineitem"""
)
def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.null_counts(table(spark, sf_dir, "lineitem").select("l_orderkey", F.nullif(F.col("l_returnflag"), F.lit("R")).alias("m")))


@query("SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O FROM orders GROUP BY 1 HAVING count(*) FILTER (WHERE o_orderstatus IN ('F', 'O', 'P')) > 0")
def decision_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.decision_crosstab(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", ["F", "O"])


@query("WITH s AS (SELECT n_chars / 5000.0 AS s, quality AS y FROM labels JOIN documents USING (doc_id)) SELECT round(avg((s - y) * (s - y)), 6) AS brier FROM s")
def brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    found = metrics.brier(table(spark, sf_dir, "labels").join(docs, "doc_id"), F.col("n_chars") / 5000, F.col("quality"))
    return found.select(F.round("brier", 6).alias("brier"))


# ---- Repositories: nations as repositories, customers as files

FILE_NAMES = ["README.md", "setup.py", "pom.xml", "main.py", "util.py", "OrderService.java", "Main.java", "store.c", "api.h", "Dockerfile", "test_x.py", "requirements.txt", "pytest.ini", "package.json", "notes.txt", "Makefile", "ci.yml", "user_dao.py"]
FOLDER_NAMES = ["", "src", "src/api", "src/models", "app/core", "docs", "tests", "build/x", "my_services", ".github/workflows", "lib", "tools/deploy", "module_a", "odd", "src/odd"]
FILE_TEXTS = ["", "if __name__ == '__main__':\n  go()", "public static void main(String[] a) {}", "int main(void) { return 0; }", "x = 1"]


def repository_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    folder = picked(FOLDER_NAMES, F.expr("c_custkey div 3"))
    path = F.concat_ws("/", F.nullif(folder, F.lit("")), picked(FILE_NAMES, key))
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("repository"), path.alias("path"), key, picked(FILE_TEXTS, F.expr("c_custkey div 5")).alias("text"))
    return rows.groupBy("repository", "path").agg(F.min_by("text", "c_custkey").alias("text"))


FILES_SQL = f"""q AS (SELECT c_nationkey AS repository, c_custkey, {list_sql(FOLDER_NAMES, 'c_custkey // 3')} AS folder, {list_sql(FILE_NAMES, 'c_custkey')} AS file,
{"CASE (c_custkey // 5) % 5 WHEN 1 THEN 'if __name__ == ''__main__'':' || chr(10) || '  go()' WHEN 2 THEN 'public static void main(String[] a) {}' WHEN 3 THEN 'int main(void) { return 0; }' WHEN 4 THEN 'x = 1' ELSE '' END"} AS text FROM customer),
f AS (SELECT repository, folder, file, CASE WHEN folder = '' THEN file ELSE folder || '/' || file END AS path, arg_min(text, c_custkey) AS text FROM q GROUP BY ALL)"""
ENTRY_SQL = r"""e AS (SELECT *, CASE WHEN (file LIKE '%.py' AND regexp_matches(text, 'if\s+__name__\s*==')) OR (file LIKE '%.java' AND contains(text, 'public static void main(String')) OR (file LIKE '%.c' AND (contains(text, 'int main(') OR contains(text, 'void main(')))
THEN 'high' WHEN file IN ('main.py') THEN 'medium' END AS confidence FROM f)"""


@query(
    f"""WITH {FILES_SQL}, h AS (SELECT repository, category, tool, path, CASE WHEN folder = '' THEN 0 ELSE 1 END AS depth, pos FROM f JOIN (SELECT * FROM {values_sql([(i, *t) for i, t in enumerate(repository.TOOLS)], 'pos, name, category, tool')}) ON name = lower(file)
WHERE folder = '' OR (NOT contains(folder, '/') AND folder NOT IN ('build', '.github')) UNION ALL SELECT repository, 'ci_cd', 'GitHub Actions', path, -1, 0 FROM f WHERE folder = '.github/workflows' AND file LIKE '%.yml'
UNION ALL SELECT repository, 'testing', 'pytest', path, 2, 0 FROM f WHERE folder = '' AND file LIKE 'test@_%.py' ESCAPE '@')
SELECT repository, category, tool, path AS evidence FROM h QUALIFY row_number() OVER (PARTITION BY repository, category, tool ORDER BY depth, path, pos) = 1"""
)
def project_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.artifacts(repository_files(spark, sf_dir))


@query(
    f"""WITH {FILES_SQL}, m AS (SELECT repository, folder, file AS build_file, CASE lower(file) WHEN 'pom.xml' THEN 'Maven module' WHEN 'package.json' THEN 'Node.js module' WHEN 'setup.py' THEN 'Python module' END AS type
FROM f WHERE folder NOT IN ('', 'build/x', '.github/workflows') AND lower(file) IN ('pom.xml', 'package.json', 'setup.py')),
o AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY repository, folder ORDER BY build_file) = 1)
SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY repository ORDER BY folder) <= 10"""
)
def subprojects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.subprojects(repository_files(spark, sf_dir))


@query(f"WITH {FILES_SQL}, {ENTRY_SQL} SELECT repository, path, confidence, row_number() OVER (PARTITION BY repository ORDER BY confidence = 'medium', path)::INT AS place FROM e WHERE confidence IS NOT NULL")
def entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.entry_points(repository_files(spark, sf_dir))


KNOWN_FOLDERS = {"src": ("Source", "high"), "src/api": ("API", "high"), "src/models": ("Data Model", "high"), "app": ("Application", "medium"), "app/core": ("Core", "high"), "docs": ("Documentation", "high"), "tests": ("Tests", "high"),
                 "my_services": ("Service", "medium"), "lib": ("Library", "high"), "tools": ("Utility", "medium")}
FOLDERS_SQL = f"""s AS (SELECT DISTINCT repository, d AS folder FROM (SELECT repository, unnest([split_part(folder, '/', 1), CASE WHEN folder LIKE 'src/%' OR folder LIKE 'app/%' THEN folder END]) AS d FROM f) WHERE d IS NOT NULL AND d <> ''),
c AS (SELECT repository, folder, bool_or(file LIKE 'test@_%' ESCAPE '@') AND bool_or(file LIKE '%.py') AS tests, bool_or(file LIKE '%.h') AS headers FROM f GROUP BY ALL),
k AS (SELECT s.repository, s.folder, coalesce(v.role, CASE WHEN tests THEN 'Tests' WHEN headers THEN 'Headers' END) AS role, coalesce(v.confidence, CASE WHEN tests THEN 'high' ELSE 'medium' END) AS confidence
FROM s LEFT JOIN {values_sql([(k, *v) for k, v in KNOWN_FOLDERS.items()], 'folder, role, confidence')} USING (folder) LEFT JOIN c USING (repository, folder) WHERE s.folder NOT IN ('build', '.github')),
i AS (SELECT *, row_number() OVER (PARTITION BY repository ORDER BY confidence <> 'high', folder)::INT AS place FROM k WHERE role IS NOT NULL)"""


@query(f"WITH {FILES_SQL}, {FOLDERS_SQL} SELECT * FROM i WHERE place <= 20")
def important_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.important_folders(repository_files(spark, sf_dir))


def marked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with a known role by name, in order of paths."""
    roles = {"README.md": "Documentation", "requirements.txt": "Dependency Manifest", "setup.py": "Build Configuration", "pom.xml": "Build Configuration", "pytest.ini": "Build Configuration"}
    role = F.try_element_at(scalars.literal_map(roles), scalars.file_name(F.col("path")))
    rows = repository_files(spark, sf_dir).select("repository", "path", role.alias("role"), F.when(scalars.file_name(F.col("path")) == "pytest.ini", "medium").otherwise("high").alias("importance")).filter("role IS NOT NULL")
    return ranking.renumber(rows, ["repository"], [F.col("path")], "pos")


@query(
    f"""WITH {FILES_SQL}, {ENTRY_SQL}, {FOLDERS_SQL}, n AS (SELECT repository, path, file, row_number() OVER (PARTITION BY repository ORDER BY path) AS pos FROM f WHERE file IN ('README.md', 'requirements.txt', 'setup.py', 'pom.xml', 'pytest.ini')),
p AS (SELECT repository, path, 1 AS part, pos FROM n WHERE file = 'README.md' QUALIFY row_number() OVER (PARTITION BY repository ORDER BY pos) = 1
UNION ALL SELECT repository, path, 2, pos FROM n WHERE file = 'requirements.txt' UNION ALL SELECT repository, path, 3, pos FROM n WHERE file IN ('setup.py', 'pom.xml')
UNION ALL SELECT repository, path, 4, row_number() OVER (PARTITION BY repository ORDER BY path) FROM e WHERE confidence = 'high'
UNION ALL SELECT repository, folder || '/', 5, list_position({list(repository.LAYERS)}, role) FROM i WHERE place <= 20 AND role IN {repository.LAYERS} QUALIFY row_number() OVER (PARTITION BY repository, role ORDER BY place) = 1),
o AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY repository, path ORDER BY part, pos) = 1)
SELECT repository, row_number() OVER (PARTITION BY repository ORDER BY part, pos, path)::INT AS step, path FROM o"""
)
def reading_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = repository_files(spark, sf_dir)
    return repository.reading_path(marked_files(spark, sf_dir), repository.entry_points(files), repository.important_folders(files))


@query(
    rf"""WITH {FILES_SQL}, {ENTRY_SQL}, d AS (SELECT repository, path, row_number() OVER (PARTITION BY repository ORDER BY path) AS n FROM f),
g AS (SELECT a.repository, a.path AS src, b.path AS dst FROM d a JOIN d b ON a.repository = b.repository AND b.n < a.n AND a.n % (b.n + 1) = 0),
fi AS (SELECT * FROM (SELECT repository, dst AS path, count(*) AS fan_in FROM g GROUP BY ALL HAVING count(*) >= 2) QUALIFY row_number() OVER (PARTITION BY repository ORDER BY fan_in DESC, path) <= 10),
fo AS (SELECT * FROM (SELECT repository, src AS path, count(*) AS fan_out FROM g GROUP BY ALL HAVING count(*) >= 3) QUALIFY row_number() OVER (PARTITION BY repository ORDER BY fan_out DESC, path) <= 10),
r AS (SELECT *, CASE WHEN file LIKE '%.h' THEN 'Header / Interface' WHEN confidence = 'high' OR (file = 'main.py' AND text <> '') THEN 'Entry Point' WHEN regexp_matches(lower(regexp_replace(file, '\.[^.]*$', '')), 'test|spec|mock|stub|fixture') THEN 'Tests'
WHEN contains(lower(file), 'service') THEN 'Service' WHEN file IN ('store.c', 'user_dao.py') THEN 'Repository' WHEN file = 'util.py' THEN 'Utility' WHEN file LIKE '%.py' OR file LIKE '%.java' OR file LIKE '%.c' THEN 'Application Source' ELSE 'Unknown' END AS role FROM e),
s AS (SELECT repository, path, role, (CASE WHEN confidence IS NOT NULL THEN 30 ELSE 0 END + coalesce(least(20, 4 * fan_in), 0) + CASE WHEN fan_out IS NOT NULL THEN 10 ELSE 0 END
+ CASE WHEN role IN ('Service', 'Repository') THEN 15 ELSE 0 END + CASE WHEN role = 'Entry Point' THEN 20 ELSE 0 END)::BIGINT AS score FROM r LEFT JOIN fi USING (repository, path) LEFT JOIN fo USING (repository, path))
SELECT *, CASE WHEN score >= 30 THEN 'high' WHEN score >= 15 THEN 'medium' ELSE 'low' END AS importance FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY repository ORDER BY score DESC, path) <= 15"""
)
def key_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = repository_files(spark, sf_dir)
    placed = ranking.renumber(files.select("repository", "path"), ["repository"], [F.col("path")], "n")
    a, b = placed.select("repository", F.col("path").alias("src"), F.col("n").alias("an")), placed.select("repository", F.col("path").alias("dst"), F.col("n").alias("bn"))
    edges = a.join(b, "repository").filter((F.col("bn") < F.col("an")) & (F.col("an") % (F.col("bn") + 1) == 0)).select("repository", "src", "dst")
    return repository.key_files(files, edges)


# ---- Selections, labels, models, jobs


@query(
    f"""WITH {STEPS_SQL}, m AS (SELECT *, o_orderkey % 3 = 0 AS chosen, {list_sql(RATINGS[:3], 'o_orderkey')} AS severity FROM o)
SELECT o_custkey, count(*) AS total, count(*) FILTER (WHERE chosen) AS chosen, count(*) FILTER (WHERE NOT chosen) AS excluded, count(DISTINCT mode) FILTER (WHERE chosen) AS files,
count(*) FILTER (WHERE chosen AND severity = 'high') AS high, count(*) FILTER (WHERE chosen AND severity = 'medium') AS medium, count(*) FILTER (WHERE chosen AND severity = 'low') AS low FROM m GROUP BY 1"""
)
def selection_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as findings, modes as files; every third order is chosen."""
    rows = order_steps(spark, sf_dir).select("o_custkey", F.col("o_orderkey").alias("id"), F.col("mode").alias("path"), picked(RATINGS[:3], F.col("o_orderkey")).alias("severity"))
    return selection.payload(rows, rows.filter("id % 3 = 0").select("id"), ["o_custkey"])


@query("""SELECT 'lang' AS "column", lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source""")
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.label_counts(table(spark, sf_dir, "documents"), ("lang", "source"))


TREES = {
    "LongMethod": {"trees": [{"feature": "size", "threshold": 30, "left": {"leaf": -1.5}, "right": {"feature": "price", "threshold": 1500, "left": {"leaf": 0.5}, "right": {"leaf": 2.0}}}], "rate": 1.0, "threshold": 0.6},
    "GodClass": {"trees": [{"feature": "price", "threshold": 1700, "left": {"leaf": -2}, "right": {"leaf": 3}}, {"leaf": 0.25}], "rate": 0.5, "start": 0.1, "threshold": 0.7},
    "Draft": {"trees": [{"leaf": 9.0}], "enabled": False},
}


@query(
    """WITH s AS (SELECT p_partkey, 'LongMethod' AS smell, 1 / (1 + exp(-CASE WHEN p_size <= 30 THEN -1.5 WHEN p_retailprice <= 1500 THEN 0.5 ELSE 2.0 END)) AS p, 0.6 AS least FROM part
UNION ALL SELECT p_partkey, 'GodClass', 1 / (1 + exp(-(0.1 + 0.5 * CASE WHEN p_retailprice <= 1700 THEN -2 ELSE 3 END + 0.125))), 0.7 FROM part) SELECT p_partkey, smell, round(p, 6) AS probability FROM s WHERE p >= least"""
)
def model_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = models.model_findings(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), TREES, {"size": F.col("p_size"), "price": F.col("p_retailprice")})
    return found.select("p_partkey", "smell", F.round("probability", 6).alias("probability"))


@query(
    """WITH j AS (SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'in_progress' ELSE 'done' END AS status, event_id % 6 AS attempts, ts AS due, ts AS locked_at FROM events),
f AS (SELECT *, CASE WHEN status = 'in_progress' AND locked_at < TIMESTAMP '2024-01-20' - INTERVAL 900 SECOND THEN CASE WHEN attempts >= 5 THEN 'failed' ELSE 'queued' END WHEN status = 'queued' AND attempts >= 5 THEN 'failed' ELSE status END AS now FROM j),
t AS (SELECT id, true AS mine FROM f WHERE now = 'queued' AND due <= TIMESTAMP '2024-01-20' ORDER BY due, id LIMIT 3)
SELECT id, CASE WHEN mine THEN 'in_progress' ELSE now END AS status, CASE WHEN mine THEN attempts + 1 ELSE attempts END AS attempts, CASE WHEN mine THEN 'w1' END AS locked_by FROM f LEFT JOIN t USING (id)"""
)
def claim_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.when(kind == "view", "queued").when(kind == "click", "in_progress").otherwise("done").alias("status"), (F.col("event_id") % 6).alias("attempts"), F.col("ts").alias("due"), F.col("ts").alias("locked_at"), F.lit(None).cast("string").alias("locked_by")
    )
    return jobs.claim(rows, "w1", F.lit("2024-01-20").cast("timestamp_ntz"), n=3).select("id", "status", "attempts", "locked_by")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'P') THEN NULL ELSE 'expected F or P, is ' || o_orderstatus END AS stage_error FROM orders")
def stage_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.at_stage(table(spark, sf_dir, "orders"), ["F", "P"], "o_orderstatus").select("o_orderkey", "stage_error")


# ---- Fixed tables, spelled out by hand in SQL


@query(
    """SELECT p_partkey, p_partkey % 14 AS n, CASE p_partkey % 14
WHEN 0 THEN 'Bloaters' WHEN 1 THEN 'Bloaters' WHEN 2 THEN 'Object-Orientation Abusers' WHEN 3 THEN 'Change Preventers' WHEN 4 THEN 'Change Preventers' WHEN 5 THEN 'Dispensables' WHEN 6 THEN 'Dispensables'
WHEN 7 THEN 'Couplers' WHEN 8 THEN 'Couplers' WHEN 9 THEN 'Security / Language-Specific' WHEN 10 THEN 'Security / Language-Specific' WHEN 11 THEN 'Bloaters' WHEN 12 THEN 'Dispensables' ELSE 'Uncategorized' END AS category,
CASE p_partkey % 14 WHEN 0 THEN 'critical' WHEN 1 THEN 'critical' WHEN 2 THEN 'medium' WHEN 3 THEN 'critical' WHEN 4 THEN 'critical' WHEN 5 THEN 'low' WHEN 6 THEN 'low'
WHEN 7 THEN 'medium' WHEN 8 THEN 'medium' WHEN 9 THEN 'critical' WHEN 10 THEN 'critical' WHEN 11 THEN 'critical' WHEN 12 THEN 'low' ELSE 'low' END AS priority,
CASE p_partkey % 14 WHEN 0 THEN 'Extract Method' WHEN 1 THEN 'Extract Class' WHEN 2 THEN 'Replace Conditional with Polymorphism' WHEN 3 THEN 'Extract Method' WHEN 5 THEN 'Remove Dead Code' WHEN 6 THEN 'Inline Class'
WHEN 7 THEN 'Move Method' WHEN 8 THEN 'Hide Delegate' WHEN 9 THEN 'Replace Magic Number with Symbolic Constant' WHEN 10 THEN 'Replace Nested Conditional with Guard Clauses' WHEN 11 THEN 'Introduce Parameter Object' END AS fix,
CASE WHEN p_partkey % 14 IN (0, 3, 5, 9) THEN 'executable' WHEN p_partkey % 14 IN (4, 12, 13) THEN 'unknown' ELSE 'advisory' END AS status FROM part"""
)
def known_smells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category, priority, fix and capability of a dozen smells and of one that nobody knows."""
    names = ["LongMethod", "LargeClass", "SwitchStatements", "DuplicateCode", "ShotgunSurgery", "DeadCode", "LazyClass", "FeatureEnvy", "MessageChains", "MagicNumber", "DeepNesting", "TooManyParameters", "DataClass", "Nothing Known"]
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 14).alias("n"), picked(names, F.col("p_partkey")).alias("smell"))
    name, can = taxonomy.category(F.col("smell")), taxonomy.capability(F.col("smell"))
    return rows.select("p_partkey", "n", name.alias("category"), taxonomy.category_priority(name).alias("priority"), can["refactoring"].alias("fix"), can["status"].alias("status"))


@query(
    """WITH f AS (SELECT p_partkey AS k, (['pom.xml', 'Makefile', 'sub/build.gradle', 'requirements.txt', 'PyProject.toml', 'b/Pipfile', 'tox.ini', 'Dockerfile', 'docker-compose.yml', 'Jenkinsfile', '.travis.yml', 'readme.md'])[(p_partkey % 12 + 1)::INT] AS path FROM part)
SELECT k, CASE k % 12 WHEN 0 THEN 'build_tools' WHEN 1 THEN 'build_tools' WHEN 2 THEN 'build_tools' WHEN 3 THEN 'dependency_managers' WHEN 4 THEN 'dependency_managers' WHEN 5 THEN 'dependency_managers' WHEN 6 THEN 'testing' WHEN 7 THEN 'deployment' WHEN 8 THEN 'deployment' ELSE 'ci_cd' END AS category,
CASE k % 12 WHEN 0 THEN 'Maven' WHEN 1 THEN 'Make' WHEN 2 THEN 'Gradle' WHEN 3 THEN 'pip' WHEN 4 THEN 'pip/Poetry' WHEN 5 THEN 'Pipenv' WHEN 6 THEN 'tox' WHEN 7 THEN 'Docker' WHEN 8 THEN 'Docker Compose' WHEN 9 THEN 'Jenkins' WHEN 10 THEN 'Travis CI' END AS tool FROM f WHERE k % 12 <> 11"""
)
def known_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a project that tell its tools; each part is a repository of one file."""
    names = ["pom.xml", "Makefile", "sub/build.gradle", "requirements.txt", "PyProject.toml", "b/Pipfile", "tox.ini", "Dockerfile", "docker-compose.yml", "Jenkinsfile", ".travis.yml", "readme.md"]
    paths = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("repository"), picked(names, F.col("p_partkey")).alias("path"))
    found = repository.artifacts(paths)
    return found.select(F.col("repository").alias("k"), "category", "tool")
