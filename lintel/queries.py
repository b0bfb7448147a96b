"""Queries of the operators over the test tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.functions import scalars
from lintel.operators import events, grouped, joins, metrics, ranking, rollups, scoring, selection, sets
from lintel.plans import quality
from lintel.session import dealt, prepare, table, written

EVENT_TYPES = ["signup", "view", "click", "purchase", "error"]
#: Severities of event types and order priorities.
EVENT_SEVERITY = {"error": "high", "purchase": "medium", "click": "low"}
PRIORITY_SEVERITY = {"1-URGENT": "high", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "low", "5-LOW": "low"}
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def case_sql(column: str, pairs: dict[str, str], other: str) -> str:
    return "CASE " + column + "".join(f" WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + f" ELSE {other} END"


RATES_SQL = """
round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall,
round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 6) AS accuracy,
round(tn / nullif(tn + fp, 0), 6) AS specificity, round(fp / nullif(fp + tn, 0), 6) AS false_positive_rate,
round(fn / nullif(fn + tp, 0), 6) AS false_negative_rate,
round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced_accuracy,
round((tp * tn - fp * fn) / nullif(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn), 0), 6) AS mcc"""
COUNTS_SQL = """count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS fp,
count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS fn, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS tn"""
LABELLED_SQL = "labels JOIN documents USING (doc_id)"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id")


@query(f"WITH c AS (SELECT {COUNTS_SQL} FROM labels) SELECT *, {RATES_SQL} FROM c")
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.with_rates(metrics.confusion(table(spark, sf_dir, "labels"), F.col("quality"), F.col("toxic")))


@query(
    f"""WITH c AS (SELECT lang, {COUNTS_SQL} FROM {LABELLED_SQL} GROUP BY lang),
m AS (SELECT tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f, * FROM c)
SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn,
round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(f), 6) AS macro_f1,
round(sum(tp) / nullif(sum(tp + fp), 0), 6) AS micro_precision, round(sum(tp) / nullif(sum(tp + fn), 0), 6) AS micro_recall,
round(2 * sum(tp) / nullif(sum(2 * tp + fp + fn), 0), 6) AS micro_f1 FROM m"""
)
def macro_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.macro_micro(metrics.confusion(labelled(spark, sf_dir), F.col("quality"), F.col("toxic"), ["lang"]))


@query(f"WITH c AS (SELECT lang, source, {COUNTS_SQL} FROM {LABELLED_SQL} GROUP BY CUBE (lang, source)) SELECT *, {RATES_SQL} FROM c")
def confusion_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.with_rates(metrics.confusion_cube(labelled(spark, sf_dir), F.col("quality"), F.col("toxic"), ["lang", "source"]))


@query(
    f"""WITH c AS (SELECT lang, count(*) AS n, avg((quality = toxic)::INT) AS o, avg(quality) AS a, avg(toxic) AS b FROM {LABELLED_SQL}
WHERE quality IN (0, 1) AND toxic IN (0, 1) GROUP BY lang), e AS (SELECT *, a * b + (1 - a) * (1 - b) AS e FROM c)
SELECT lang, n, round(o, 6) AS observed, round(e, 6) AS expected,
CASE WHEN n >= 5 THEN round(CASE WHEN e = 1 THEN 1.0 ELSE (o - e) / (1 - e) END, 6) END AS kappa FROM e"""
)
def cohens_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.cohens_kappa(labelled(spark, sf_dir), F.col("quality"), F.col("toxic"), ["lang"])


@query(
    """WITH c AS (SELECT event_type, user_id, count(*)::DOUBLE AS n, (count(*) FILTER (WHERE value > 50))::DOUBLE AS k FROM events GROUP BY ALL),
s AS (SELECT event_type, sum(n * (n - 1) / 2) AS pairs, sum(k * (k - 1) / 2 + (n - k) * (n - k - 1) / 2) AS agreeing,
sum((n - 1) * k) / nullif(sum((n - 1) * n), 0) AS p FROM c GROUP BY event_type), e AS (SELECT *, p * p + (1 - p) * (1 - p) AS e FROM s)
SELECT event_type, pairs::BIGINT AS pairs, round(agreeing / nullif(pairs, 0), 6) AS observed,
round(CASE WHEN e = 1 THEN 1.0 ELSE (agreeing / nullif(pairs, 0) - e) / nullif(1 - e, 0) END, 6) AS kappa FROM e"""
)
def pair_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pair_agreement(table(spark, sf_dir, "events"), ["user_id"], F.col("value") > 50, ["event_type"])


@query(
    """SELECT l_orderkey, count(*) AS votes, count(*) FILTER (WHERE l_returnflag = 'R') AS positive,
(2 * count(*) FILTER (WHERE l_returnflag = 'R') > count(*))::INT AS label FROM lineitem GROUP BY l_orderkey"""
)
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.majority(table(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_returnflag") == "R")


def event_severity() -> Column:
    return F.try_element_at(scalars.literal_map(EVENT_SEVERITY), F.col("event_type"))


SEVERITY_SQL = case_sql("event_type", EVENT_SEVERITY, "NULL")


@query(
    f"""WITH s AS (SELECT user_id, date_trunc('day', ts) AS day, {SEVERITY_SQL} AS s FROM events)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, count(s) AS findings,
round(greatest(0.0, 100.0 - sum(CASE s WHEN 'high' THEN 8 WHEN 'medium' THEN 4 WHEN 'low' THEN 1 ELSE 0 END)), 1)::DOUBLE AS score FROM s GROUP BY ALL"""
)
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), event_severity().alias("s"))
    return rollups.quality_score(df, ["user_id", "day"], F.col("s"))


CATEGORIES = ["error", "click", "refund", "signup", "login", "view", "purchase"]


@query(
    "WITH d AS (SELECT * FROM (VALUES "
    + ", ".join(f"({i}, '{n}')" for i, n in enumerate(CATEGORIES))
    + """) AS d(pos, event_type)), c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
SELECT d.pos, d.event_type, coalesce(c.n, 0) AS n, c.n IS NOT NULL AS present FROM d LEFT JOIN c USING (event_type)"""
)
def category_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.catalogue(table(spark, sf_dir, "events"), "event_type", CATEGORIES)


@query(
    f"""WITH s AS (SELECT *, {case_sql("o_orderpriority", PRIORITY_SEVERITY, "NULL")} AS s FROM orders)
SELECT o_custkey, count(*) AS n, CASE min(CASE s WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS worst,
count(*) FILTER (WHERE s = 'high') AS high, count(*) FILTER (WHERE s = 'medium') AS medium, count(*) FILTER (WHERE s = 'low') AS low,
string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS files, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS ids FROM s GROUP BY o_custkey"""
)
def worst_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.try_element_at(scalars.literal_map(PRIORITY_SEVERITY), F.col("o_orderpriority"))
    found = rollups.worst(table(spark, sf_dir, "orders"), ["o_custkey"], severity, F.col("o_orderkey"), F.col("o_orderstatus"))
    return found.withColumns({"files": F.array_join("files", ","), "ids": F.array_join("ids", ",")})


@query("SELECT lang, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS percent FROM documents GROUP BY lang")
def language_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.share(table(spark, sf_dir, "documents"), "lang")


@query("SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY o_custkey")
def severity_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.pivoted(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", ["F", "O", "P"])


@query(
    """WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)
SELECT o_orderstatus, sum(n)::BIGINT AS n, string_agg(o_orderpriority || '=' || n, ',' ORDER BY o_orderpriority) AS by_priority FROM c GROUP BY 1"""
)
def count_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rollups.count_map(table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_orderpriority", "m")
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return found.select("o_orderstatus", "n", shown.alias("by_priority"))


@query(
    """SELECT event_type, count(value) AS n, round(median(value), 6) AS median, round(avg(value), 6) AS mean, round(min(value), 6) AS min, round(max(value), 6) AS max
FROM events GROUP BY event_type"""
)
def five_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.five_numbers(table(spark, sf_dir, "events"), F.col("value"), ["event_type"])


@query(
    """WITH c AS (SELECT source, lang, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY ALL)
SELECT source, arg_max(lang, (n, -first)) AS primary, count(*) AS values FROM c GROUP BY source""".replace("AS values", 'AS "values"').replace("AS primary", 'AS "primary"')
)
def primary_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.primary(table(spark, sf_dir, "documents"), ["source"], "lang", "doc_id", "en")


BEFORE_SQL = f"""s AS (SELECT user_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, CASE WHEN event_type = 'error' AND value > 80 THEN 'critical' ELSE {SEVERITY_SQL} END AS s FROM events),
n AS (SELECT user_id, day, count(*) FILTER (WHERE s = 'critical') AS critical, count(*) FILTER (WHERE s = 'high') AS high, count(*) FILTER (WHERE s = 'medium') AS medium,
count(*) FILTER (WHERE s = 'low') AS low, count(*) AS total FROM s GROUP BY ALL),
c AS (SELECT *, least(100, 30 + 15 * critical + 8 * high + 4 * medium + low) AS complexity, least(100, 10 + 3 * total) AS duplication FROM n),
b AS (SELECT *, greatest(0, 100 - complexity - duplication // 2) AS maintainability FROM c)"""


@query(f"WITH {BEFORE_SQL} SELECT * FROM b")
def metrics_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events of a day as findings."""
    critical = (F.col("event_type") == "error") & (F.col("value") > 80)
    df = table(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.when(critical, "critical").otherwise(event_severity()).alias("s"))
    return rollups.metrics_before(df, ["user_id", "day"], F.col("s"))


@query(
    f"""WITH {BEFORE_SQL}, r AS (SELECT *, user_id % 4 AS resolved, (user_id % 4)::DOUBLE / greatest(total, 1) AS share FROM b),
t AS (SELECT *, trunc(complexity * share * 0.7)::BIGINT AS simpler, trunc(duplication * share * 0.6)::BIGINT AS leaner FROM r)
SELECT user_id, day, greatest(5, complexity - simpler) AS complexity_after, greatest(0, duplication - leaner) AS duplication_after, least(100, maintainability + simpler + leaner // 2) AS maintainability_after,
greatest(0, total - resolved) AS total_after, greatest(0, high - trunc(high * share)::BIGINT) AS high_after, greatest(0, low - trunc(low * share)::BIGINT) AS low_after FROM t"""
)
def metrics_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rollups.metrics_after(metrics_before(spark, sf_dir), F.col("user_id") % 4)
    return found.select("user_id", "day", "complexity_after", "duplication_after", "maintainability_after", "total_after", "high_after", "low_after")


@query("WITH g AS (SELECT lang, count(*)::DOUBLE AS n, sum(n_chars)::DOUBLE AS s, sum(n_chars::DOUBLE * n_chars) AS q FROM documents GROUP BY 1), t AS (SELECT count(*) AS k, sum(n) AS n, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b FROM g) SELECT k AS groups, n::BIGINT AS rows, round(((b - s * s / n) / (k - 1)) / ((q - b) / (n - k)), 4) AS f FROM t".replace("AS groups", 'AS "groups"').replace("AS rows", 'AS "rows"'))
def anova(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.anova(table(spark, sf_dir, "documents"), "lang", "n_chars").withColumn("f", F.round("f", 4))


@query(
    "WITH d AS (SELECT * FROM (VALUES "
    + ", ".join(f"({i}, '{n}')" for i, n in enumerate(EVENT_TYPES))
    + """) AS d(pos, event_type)), c AS (SELECT event_type, count(DISTINCT (user_id, date_trunc('day', ts))) AS n FROM events GROUP BY 1),
j AS (SELECT pos, event_type, coalesce(n, 0) AS reached FROM d LEFT JOIN c USING (event_type))
SELECT *, round(reached / nullif(first(reached) OVER (ORDER BY pos), 0), 6) AS share, round(reached / nullif(lag(reached) OVER (ORDER BY pos), 0), 6) AS conversion FROM j"""
)
def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.funnel(table(spark, sf_dir, "events"), [F.col("user_id"), F.date_trunc("day", F.col("ts"))], "event_type", EVENT_TYPES)


SPANS = [("signup", "view"), ("view", "click"), ("click", "purchase")]


@query(
    "WITH f AS (SELECT user_id, "
    + ", ".join(f"min(ts) FILTER (WHERE event_type = '{s}') AS t_{s}" for s in ("signup", "view", "click", "purchase"))
    + " FROM events GROUP BY 1), s AS ("
    + " UNION ALL ".join(f"SELECT '{a}_{b}' AS span, t_{a} AS a, t_{b} AS b FROM f" for a, b in SPANS)
    + """), m AS (SELECT span, date_diff('microsecond', a, b) / 6e7 AS m FROM s WHERE b >= a)
SELECT span, count(m) AS n, round(median(m), 4) AS median, round(avg(m), 4) AS mean, round(min(m), 4) AS min, round(max(m), 4) AS max FROM m GROUP BY span"""
)
def stage_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.stage_durations(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", SPANS)


@query(
    """SELECT user_id, event_type, min(ts) AS first, max(ts) AS last, count(ts) AS n,
CASE WHEN count(ts) > 1 THEN round(date_diff('microsecond', min(ts), max(ts)) / 6e7, 2) END AS minutes FROM events GROUP BY ALL"""
)
def session_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.session_span(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts")


@query(
    """WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 250000) AS accepted FROM orders GROUP BY ALL),
p AS (SELECT sum(accepted) / sum(n) AS p FROM c) SELECT o_orderstatus, o_orderpriority, n, accepted, round((accepted + 5 * p) / (n + 5), 6) AS smoothed FROM c, p"""
)
def acceptance_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.acceptance(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], F.col("o_totalprice") > 250000)


@query("SELECT event_type, count(r) AS n, round(avg(r), 6) AS mean, round(count(*) FILTER (WHERE r >= 4) / nullif(count(r), 0), 6) AS share_good FROM (SELECT event_type, event_id % 5 + 1 AS r FROM events) GROUP BY 1")
def satisfaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.satisfaction(table(spark, sf_dir, "events").withColumn("r", F.col("event_id") % 5 + 1), F.col("r"), ["event_type"])


@query(
    """WITH s AS (SELECT p_brand AS smell, p_type AS action, count(*) AS n, sum(p_size) AS size FROM part WHERE p_size > 30 GROUP BY ALL),
r AS (SELECT action, sum(n) AS n, sum(size) AS size FROM s GROUP BY 1), w AS (SELECT p_partkey, p_brand AS smell, p_type AS action FROM part WHERE p_size <= 30)
SELECT w.*, CASE WHEN s.n IS NOT NULL THEN 'exact' WHEN r.n IS NOT NULL THEN 'rolled' ELSE 'none' END AS match,
coalesce(s.n, r.n, 0)::BIGINT AS n, coalesce(s.size, r.size, 0)::BIGINT AS size FROM w LEFT JOIN s USING (smell, action) LEFT JOIN r USING (action)"""
)
def feedback_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").withColumns({"smell": F.col("p_brand"), "action": F.col("p_type")})
    stats = parts.filter("p_size > 30").groupBy("smell", "action").agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("size"))
    return joins.with_fallback(parts.filter("p_size <= 30").select("p_partkey", "smell", "action"), stats, "smell", "action", ["n", "size"])


@query("SELECT p_brand, p_partkey, p_size, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_retailprice DESC, p_partkey) = 1")
def argmax_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size", "p_retailprice")
    return ranking.first_per_key(parts, ["p_brand"], [F.desc("p_size"), F.desc("p_retailprice"), F.col("p_partkey")])


@query(
    """WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY nullif(p_size, 0) DESC NULLS LAST, p_partkey) AS rank FROM part),
e AS (SELECT p_brand, max(p_partkey) AS p_partkey FROM part GROUP BY 1 UNION ALL SELECT p_brand, min(p_partkey) FROM part GROUP BY 1)
SELECT count(*) AS n, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, round(avg(CASE WHEN rank <= 10 THEN 1.0 / log2(rank + 1.0) ELSE 0 END), 6) AS ndcg,
round(avg((coalesce(rank, 999999) <= 10)::INT), 6) AS top_k, round(avg((coalesce(rank, 0) = 1)::INT), 6) AS top_1 FROM e LEFT JOIN r USING (p_brand, p_partkey)"""
)
def mrr_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size", F.col("p_partkey").alias("pos"))
    ends = parts.groupBy("p_brand").agg(F.array(F.max("p_partkey"), F.min("p_partkey")).alias("x"))
    expected = ends.select("p_brand", F.explode("x").alias("p_partkey"))
    return metrics.ranking(ranking.rank_of_expected(parts, expected, ["p_brand"], "p_partkey", "p_size", "pos"), F.col("rank"), 10)


@query("SELECT user_id, event_id, ts, event_type, value, props FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.latest_per_key(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id")


JOB_STATUS = {"signup": "queued", "view": "queued", "click": "in_progress", "purchase": "done", "error": "failed"}


@query(
    f"""WITH j AS (SELECT event_id, user_id, ts, {case_sql("event_type", JOB_STATUS, "NULL")} AS status FROM events)
SELECT event_id, user_id, ts, CASE WHEN status = 'queued' AND event_id <> last(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
THEN 'superseded' ELSE status END AS status FROM j"""
)
def supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.try_element_at(scalars.literal_map(JOB_STATUS), F.col("event_type")).alias("status"))
    return ranking.supersede(jobs, ["user_id"], "ts", "event_id", "status").select("event_id", "user_id", "ts", "status")


@query(
    f"""WITH j AS (SELECT event_id, ts, {case_sql("event_type", JOB_STATUS, "NULL")} AS status FROM events)
SELECT event_id, ts, status FROM j WHERE (status = 'queued' AND ts <= TIMESTAMP '2024-01-20') OR (status = 'in_progress' AND ts < TIMESTAMP '2024-01-10') ORDER BY ts, event_id LIMIT 10"""
)
def claimable(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "events").select("event_id", "ts", F.try_element_at(scalars.literal_map(JOB_STATUS), F.col("event_type")).alias("status"))
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return ranking.claimable(jobs, "status", "ts", "ts", at("2024-01-20"), at("2024-01-10"), [F.col("ts"), F.col("event_id")])


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    minute = F.floor(F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")) / 60)
    length = F.bround("value").cast("long")
    return table(spark, sf_dir, "events").select("event_id", "user_id", minute.alias("start"), (minute + length).alias("stop"))


@query(
    """WITH i AS (SELECT event_id, user_id, date_diff('second', TIMESTAMP '1970-01-01', date_trunc('minute', ts)) // 60 AS start, round_even(value, 0)::BIGINT AS len FROM events),
e AS (SELECT event_id, user_id, start, start + len AS stop FROM i)
SELECT a.user_id, a.event_id AS a, b.event_id AS b, least(a.stop, b.stop) - greatest(a.start, b.start) AS overlap
FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.stop >= b.start AND b.stop >= a.start"""
)
def overlap_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.overlap_edges(intervals(spark, sf_dir), ["user_id"], "event_id", "start", "stop", 240)


@query(
    """WITH i AS (SELECT event_id, user_id, event_type, date_diff('second', TIMESTAMP '1970-01-01', date_trunc('minute', ts)) // 60 AS start, round_even(value, 0)::BIGINT AS len FROM events),
e AS (SELECT *, start + len AS stop FROM i)
SELECT a.user_id, a.event_id, b.event_id AS other, abs(a.start - b.start) + abs(a.stop - b.stop) AS distance FROM e a JOIN e b ON a.user_id = b.user_id
AND a.event_type = 'click' AND b.event_type = 'purchase' AND abs(a.start - b.start) <= 720 AND abs(a.stop - b.stop) <= 720
QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.start - b.start) + abs(a.stop - b.stop), b.event_id) = 1"""
)
def nearest_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "events").select("event_id", "event_type")
    rows = intervals(spark, sf_dir).join(kinds, "event_id").withColumnRenamed("stop", "end")
    right = rows.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("other"), "start", "end")
    return joins.nearest_interval(rows.filter("event_type = 'click'").select("user_id", "event_id", "start", "end"), right, ["user_id"], "event_id", 720)


@query(
    """SELECT o_orderkey, o_custkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey
AND l.l_shipdate BETWEEN o.o_orderdate AND o.o_orderdate + INTERVAL 90 DAY)"""
)
def range_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    inside = F.col("l_shipdate").between(F.col("o_orderdate"), F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS"))
    return joins.exists_in_range(orders, lines, ["o_orderkey"], inside).select("o_orderkey", "o_custkey")


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def dead_code_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.difference(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), table(spark, sf_dir, "labels"), ["doc_id"])


@query(
    """WITH r AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS i FROM lineitem)
SELECT a.k AS first, b.k AS second, count(*) AS shared, string_agg(a.i::VARCHAR, ',' ORDER BY a.i) AS items FROM r a JOIN r b ON a.i = b.i AND a.k < b.k GROUP BY ALL HAVING count(*) >= 2"""
)
def data_clumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = joins.frequent_pairs(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", 2)
    return found.withColumn("items", F.array_join("items", ","))


@query(
    r"""SELECT lang, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS fingerprint, count(*) AS members, min(doc_id) AS first FROM documents GROUP BY ALL HAVING count(*) >= 2"""
)
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    normal = F.md5(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")))
    return sets.duplicate_groups(table(spark, sf_dir, "documents"), ["lang"], "doc_id", normal)


@query(
    """WITH o AS (SELECT 's' || l_suppkey AS node, count(*) AS n FROM lineitem GROUP BY 1), i AS (SELECT 'p' || l_partkey AS node, count(*) AS n FROM lineitem GROUP BY 1)
SELECT coalesce(o.node, i.node) AS node, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out FROM o FULL JOIN i ON o.node = i.node"""
)
def fan_in_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))
    return joins.degrees(edges)


@query(
    r"""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(text, '[^A-Za-z0-9_]+')) AS w FROM documents),
e AS (SELECT DISTINCT regexp_extract(text, '[A-Za-z]+') AS name FROM benchmark)
SELECT name, 1 + count(w.doc_id) AS blast_radius FROM e LEFT JOIN w ON w.w = e.name AND length(name) >= 3 GROUP BY name"""
)
def blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "benchmark").select(F.regexp_extract("text", "[A-Za-z]+", 0).alias("name")).distinct()
    return joins.token_references(names, "name", table(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines, text FROM documents)
SELECT doc_id, len(lines) AS lines, len(list_filter(lines, lambda x: trim(x, ' ' || chr(9) || chr(13)) = '')) AS blank,
list_max(list_transform(lines, lambda x: length(x)))::BIGINT AS longest, len(regexp_extract_all(text, '[.!?](\s|$)')) AS sentences FROM l"""
)
def line_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("text", "\n")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.size(lines).cast("long").alias("lines"),
        F.size(F.filter(lines, lambda x: F.trim(F.translate(x, "\t\r", "  ")) == "")).cast("long").alias("blank"),
        F.array_max(F.transform(lines, F.char_length)).cast("long").alias("longest"),
        F.regexp_count("text", F.lit(r"[.!?](\s|$)")).cast("long").alias("sentences"),
    )


@query(
    """WITH t AS (SELECT doc_id, lang, source, list_distinct(string_split(text, ' ')) AS t FROM documents)
SELECT a.lang, a.source, a.doc_id AS first, b.doc_id AS second, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) AS similarity
FROM t a JOIN t b ON a.lang = b.lang AND a.source = b.source AND a.doc_id < b.doc_id AND len(list_intersect(a.t, b.t)) >= 0.6 * len(list_distinct(list_concat(a.t, b.t)))"""
)
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.similar_pairs(table(spark, sf_dir, "documents"), ["lang", "source"], "doc_id", F.split("text", " "), 0.6)


@query(
    """WITH p AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
c AS (SELECT label, i, avg(x) AS m FROM p GROUP BY ALL)
SELECT p.vec_id, p.label, round(sum(x * m) / nullif(sqrt(sum(x * x)) * sqrt(sum(m * m)), 0), 6) AS cosine FROM p JOIN c USING (label, i) GROUP BY ALL"""
)
def cosine_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    places = vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = places.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))  # as many entries as dimensions
    return vectors.join(centres, "label").select("vec_id", "label", F.round(scalars.cosine(F.col("embedding"), F.col("centre")), 6).alias("cosine"))


@query(
    f"""WITH s AS (SELECT n_chars AS threshold, sum(quality) AS ones, count(*) AS n FROM {LABELLED_SQL} GROUP BY 1),
r AS (SELECT threshold, sum(ones) OVER w AS tp, sum(n) OVER w AS called, sum(ones) OVER () AS t FROM s WINDOW w AS (ORDER BY threshold DESC))
SELECT threshold, tp::BIGINT AS tp, (called - tp)::BIGINT AS fp, (t - tp)::BIGINT AS fn, round(2 * tp / (called + t), 9) AS f1 FROM r"""
)
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.threshold_sweep(labelled(spark, sf_dir), F.col("n_chars"), F.col("quality"))


@query(
    f"""WITH s AS (SELECT n_chars AS s, sum(quality)::DOUBLE AS ones, (count(*) - sum(quality))::DOUBLE AS zeros FROM {LABELLED_SQL} GROUP BY 1),
r AS (SELECT *, coalesce(sum(zeros) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under FROM s)
SELECT round(sum(ones * (under + zeros / 2)) / (sum(ones) * sum(zeros)), 6) AS auc, sum(ones)::BIGINT AS positives, sum(zeros)::BIGINT AS negatives FROM r"""
)
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc_auc(labelled(spark, sf_dir), F.col("n_chars"), F.col("quality"))


@query(
    """WITH s AS (SELECT l_orderkey, l_linenumber - 1 AS a, l_linenumber - 1 + l_quantity::INT % 7 AS b, l_linenumber + 1 AS anchor,
CASE l_returnflag WHEN 'R' THEN 'high' WHEN 'A' THEN 'medium' ELSE 'low' END AS s FROM lineitem),
e AS (SELECT l_orderkey, s, anchor, unnest(CASE WHEN b - a > 4 THEN [anchor::BIGINT] ELSE generate_series(a, b) END) AS line FROM s WHERE a >= 1)
SELECT l_orderkey, line::BIGINT AS line, count(*) AS findings, count(*) FILTER (WHERE line = anchor) AS anchors,
CASE min(CASE s WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS worst FROM e GROUP BY ALL"""
)
def line_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of up to seven lines; more than five count at their anchor only."""
    start = F.col("l_linenumber") - 1
    severity = F.when(F.col("l_returnflag") == "R", "high").when(F.col("l_returnflag") == "A", "medium").otherwise("low")
    found = rollups.line_coverage(table(spark, sf_dir, "lineitem"), ["l_orderkey"], start, start + F.col("l_quantity").cast("int") % 7, severity, F.col("l_linenumber") + 1, longest=4)
    return found.withColumn("line", F.col("line").cast("long"))


@query(
    """SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS n_selected,
round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END), 4) AS points_selected, round(sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END), 4) AS points_skipped,
round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END), 4) AS cost_selected, round(max(l_discount) FILTER (WHERE l_linestatus = 'O'), 6) AS max_risk,
round(avg(l_discount) FILTER (WHERE l_linestatus = 'O'), 6) AS mean_risk, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / nullif(sum(l_quantity), 0), 6) AS capture
FROM lineitem GROUP BY l_suppkey"""
)
def impact_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.impact_totals(
        table(spark, sf_dir, "lineitem"), ["l_suppkey"], F.col("l_returnflag") == "R", F.col("l_linestatus") == "O", F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount")
    )


LEVEL_SQL = "(CASE WHEN {0} <= 15 THEN 1 WHEN {0} <= 35 THEN 2 ELSE 3 END)::DOUBLE"


@query(
    f"""WITH l AS (SELECT p_partkey, p_brand, p_size, {LEVEL_SQL.format("p_size")} AS c, {LEVEL_SQL.format("(p_partkey % 50)")} AS r, {LEVEL_SQL.format("(p_partkey * 7 % 50)")} AS i FROM part),
s AS (SELECT *, 0.4 * (i - 1) / 2 + 0.25 * (3 - c) / 2 + 0.2 * (3 - r) / 2 + 0.15 * least(1, greatest(0, p_size / 40.0 - 0.1)) AS criteria FROM l)
SELECT p_partkey, p_brand, round(0.2 * (4 - c) + 0.4 * (4 - r) + 0.4 * i, 6)::DOUBLE AS base, round(criteria, 6)::DOUBLE AS criteria,
round(CASE WHEN p_partkey % 3 > 0 THEN least(1, greatest(0, criteria + ((p_size / 50.0 + 0.5 + 1 - p_partkey % 11 / 10.0) / 3 - 0.5) * 2 * (p_partkey % 3 / 2.0) * 0.25)) ELSE criteria END, 6)::DOUBLE AS judged FROM s"""
)
def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = lambda c: F.when(c <= 15, "low").when(c <= 35, "medium").otherwise("high")
    key, size = F.col("p_partkey"), F.col("p_size")
    c, r, i = level(size), level(key % 50), level(key * 7 % 50)
    criteria = scoring.criteria_score(c, r, i, size / 40 - 0.1)
    judged = scoring.criteria_with_model(criteria, key % 3 / 2, size / 50, F.lit(0.5), key % 11 / 10)
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.round(scoring.base_score(c, r, i), 6).alias("base"), F.round(criteria, 6).alias("criteria"), F.round(judged, 6).alias("judged"))


@query("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    even = F.col("event_id") % 2 == 0
    return sets.upsert(rows.filter(even), rows.filter(~even), ["user_id", "event_type", "props"], "at").select("event_id", "user_id", "event_type")


@query(
    """WITH RECURSIVE i AS (SELECT event_id, user_id, event_type, date_diff('second', TIMESTAMP '1970-01-01', date_trunc('minute', ts)) // 60 AS start, round_even(value, 0)::BIGINT AS len FROM events),
t AS (SELECT user_id, event_id AS id, start, CASE WHEN start + len = 0 THEN start ELSE start + len END AS stop, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM i WHERE event_type = 'click'),
p AS (SELECT user_id, list({'id': event_id, 'a': start, 'b': start + len} ORDER BY event_id) AS ps FROM i WHERE event_type = 'view' GROUP BY 1),
r AS (SELECT user_id, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS id, NULL::BIGINT AS pid FROM (SELECT DISTINCT user_id FROM t)
UNION ALL SELECT m.user_id, m.k, CASE WHEN m.hit IS NULL THEN m.used ELSE list_append(m.used, m.hit) END, m.id, m.hit FROM (
SELECT t.user_id, t.k, r.used, t.id, list_filter(coalesce(p.ps, []), lambda x: (abs(t.start - x.a) <= 5 OR (t.start <= x.b AND x.a <= t.stop)) AND NOT list_contains(r.used, x.id))[1].id AS hit
FROM r JOIN t ON t.user_id = r.user_id AND t.k = r.k + 1 LEFT JOIN p ON p.user_id = t.user_id) m)
SELECT user_id, id, pid FROM r WHERE id IS NOT NULL
UNION ALL SELECT user_id, NULL, event_id FROM i WHERE event_type = 'view' AND event_id NOT IN (SELECT pid FROM r WHERE pid IS NOT NULL)"""
)
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as truth and views as predictions of a user, matched by minutes."""
    kinds = table(spark, sf_dir, "events").select("event_id", "event_type")
    rows = intervals(spark, sf_dir).join(kinds, "event_id").select("user_id", "event_type", "event_id", F.lit("").alias("name"), F.lit("function").alias("kind"), "start", F.col("stop").alias("end"), F.col("event_id").alias("pos"))
    truth = rows.filter("event_type = 'click'").withColumnRenamed("event_id", "id")
    found = rows.filter("event_type = 'view'").withColumnRenamed("event_id", "pid")
    return grouped.greedy_match(truth, found, ["user_id"])


@query(
    """WITH RECURSIVE g AS (SELECT l_orderkey, l_linenumber, sum(l_extendedprice) AS v, sum(l_quantity)::INT AS c FROM lineitem GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM g),
s AS (SELECT DISTINCT l_orderkey, 0::BIGINT AS k, 0::DOUBLE AS v, 0 AS c, []::BIGINT[] AS picked FROM n
UNION ALL SELECT n.l_orderkey, n.k, CASE WHEN t.take THEN s.v + n.v ELSE s.v END, CASE WHEN t.take THEN s.c + n.c ELSE s.c END, CASE WHEN t.take THEN list_append(s.picked, n.k) ELSE s.picked END
FROM s JOIN n ON n.l_orderkey = s.l_orderkey AND n.k = s.k + 1 CROSS JOIN (VALUES (true), (false)) AS t(take) WHERE NOT t.take OR s.c + n.c <= 60),
best AS (SELECT l_orderkey, unnest(arg_max(picked, v)) AS k FROM (SELECT *, max(k) OVER (PARTITION BY l_orderkey) AS last FROM s) WHERE k = last GROUP BY l_orderkey)
SELECT l_orderkey, n.l_linenumber, n.v AS points, n.c AS minutes FROM best JOIN n USING (l_orderkey, k)"""
)
def knapsack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best set of an order's lines for a budget of 60 quantity units."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_extendedprice").alias("l_extendedprice"), F.sum("l_quantity").alias("l_quantity"))
    return grouped.choose(lines, "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", 60)


@query(
    f"""WITH r AS (SELECT o_custkey, o_orderkey AS id, o_orderstatus AS s, row_number() OVER (PARTITION BY o_custkey
ORDER BY CASE {case_sql("o_orderpriority", PRIORITY_SEVERITY, "NULL")} WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, o_orderkey) AS place FROM orders),
f AS (SELECT *, min(place) FILTER (WHERE s = 'F') OVER w AS f, min(place) FILTER (WHERE s = 'O') OVER w AS o FROM r WINDOW w AS (PARTITION BY o_custkey)),
g AS (SELECT *, CASE WHEN place = f THEN 0 WHEN o IS NULL THEN 1 WHEN s <> 'P' AND place < o THEN 1 WHEN place = o THEN 2 ELSE 3 END AS stage FROM f)
SELECT o_custkey, id, row_number() OVER (PARTITION BY o_custkey ORDER BY stage, place)::INT AS step FROM g"""
)
def sequence_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as steps: open ones need a finished one before them, pending ones an open and a finished one; urgent ones first."""
    rank = scalars.severity_rank(F.try_element_at(scalars.literal_map(PRIORITY_SEVERITY), F.col("o_orderpriority")))
    steps = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("action"), rank.alias("rank"), F.col("o_orderkey").alias("pos"))
    return grouped.sequence_steps(steps, "o_custkey", [("O", "F"), ("P", "O"), ("P", "F")])


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped.bootstrap_ci(metrics.confusion(labelled(spark, sf_dir), F.col("quality"), F.col("toxic"), ["lang"]), ["lang"])


def poisson_sql(cluster: str, round_: str = "round", seed: int = 42) -> str:
    """Poisson(1) draws by hash, as in operators.grouped."""
    edges, p, total = [], 0.36787944117144233, 0.0
    for k in range(18):
        total += p
        edges.append(repr(total))
        p /= k + 1
    u = f"((('0x' || substr(md5({cluster}::VARCHAR || '|' || {round_}::VARCHAR || '|{seed}'), 1, 12))::BIGINT)::DOUBLE + 0.5) / {float(1 << 48)!r}"
    return f"len(list_filter([{', '.join(edges)}], lambda e: {u} > e))"


@query(
    f"""WITH c AS (SELECT source, {COUNTS_SQL} FROM {LABELLED_SQL} GROUP BY source),
d AS (SELECT *, {poisson_sql("source")} AS w FROM c, (SELECT unnest(generate_series(1, 200)) AS round)),
s AS (SELECT round, sum(tp * w) AS tp, sum(fp * w) AS fp, sum(fn * w) AS fn FROM d GROUP BY 1), f AS (SELECT 2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM s)
SELECT count(f1) AS rounds, round(quantile_cont(f1, 0.025), 6) AS low, round(quantile_cont(f1, 0.975), 6) AS high FROM f"""
)
def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grouped.cluster_bootstrap(metrics.confusion(labelled(spark, sf_dir), F.col("quality"), F.col("toxic"), ["source"]), "source")
    return found.withColumns({"low": F.round("low", 6), "high": F.round("high", 6)})


PAIR_SQL = """SELECT source, count(*) FILTER (WHERE quality = 1 AND n_chars > 500) AS a_tp, count(*) FILTER (WHERE quality = 0 AND n_chars > 500) AS a_fp, count(*) FILTER (WHERE quality = 1 AND n_chars <= 500) AS a_fn,
count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS b_tp, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS b_fp, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS b_fn"""
GAP_SQL = "coalesce(2.0::DOUBLE * sum(a_tp * w) / nullif(sum((2 * a_tp + a_fp + a_fn) * w), 0), 0) - coalesce(2.0::DOUBLE * sum(b_tp * w) / nullif(sum((2 * b_tp + b_fp + b_fn) * w), 0), 0)"


@query(
    f"""WITH c AS ({PAIR_SQL} FROM {LABELLED_SQL} GROUP BY source), d AS (SELECT *, {poisson_sql("source")} AS w FROM c, (SELECT unnest(generate_series(1, 200)) AS round)),
s AS (SELECT {GAP_SQL} AS d FROM d GROUP BY round HAVING sum((a_tp + a_fn) * w) > 0)
SELECT (SELECT round({GAP_SQL}, 6) FROM (SELECT *, 1 AS w FROM c)) AS difference, count(d) AS rounds, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high FROM s"""
)
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rules for good documents, length and absence of toxicity, compared on the same draws of sources."""
    rows = labelled(spark, sf_dir)
    a, b = (F.col("n_chars") > 500).cast("int"), (F.col("toxic") == 0).cast("int")
    counts = [metrics.confusion(rows, F.col("quality"), x, ["source"]).select("source", *[F.col(c).alias(f"{side}_{c}") for c in ("tp", "fp", "fn")]) for side, x in (("a", a), ("b", b))]
    found = grouped.paired_bootstrap(counts[0].join(counts[1], "source"), "source")
    return found.withColumns({c: F.round(c, 6) for c in ("difference", "low", "high")})


@query(
    f"""WITH s AS (SELECT n_chars AS s, sum(quality) AS ones, count(*) AS n FROM {LABELLED_SQL} GROUP BY 1),
r AS (SELECT *, sum(ones) OVER w AS hits, sum(n) OVER w AS called FROM s WINDOW w AS (ORDER BY s DESC))
SELECT round(sum(ones * hits::DOUBLE / called) / sum(ones), 6) AS pr_auc, sum(ones)::BIGINT AS positives FROM r"""
)
def pr_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pr_auc(labelled(spark, sf_dir), F.col("n_chars"), F.col("quality"))


@query("SELECT o_custkey, o_orderkey, 'S' || lpad(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::VARCHAR, 3, '0') AS display_id FROM orders")
def display_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return selection.display_ids(orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).drop("o_orderdate")


@query(
    """SELECT a.o_custkey, count(*) FILTER (WHERE a.o_orderstatus = 'F' AND b.o_orderstatus = 'O' AND b.o_orderkey < a.o_orderkey) AS violations
FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey GROUP BY 1"""
)
def order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.order_violations(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", "o_orderkey", [("O", "F")])


@query(
    """WITH s AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey % 10 = 3)
SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM s WHERE s.l_orderkey = l.l_orderkey AND s.l_linenumber = l.l_linenumber)) AS chosen FROM lineitem l GROUP BY 1"""
)
def selection_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id"), "l_orderkey", F.col("l_returnflag").alias("path"), F.col("l_suppkey").alias("smell"), F.col("l_linenumber").alias("pos")
    )
    by_file = spark.createDataFrame([("R",)], "path string")
    by_id = rows.filter(F.col("smell") % 10 == 3).select("id")
    marked = selection.split_selection(rows, selection.resolve(rows, by_file, by_id))
    return marked.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if("selected").alias("chosen"))


def written_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python file for each part: one function of as many lines as the part's size."""
    name = F.concat(F.lit("f"), F.col("p_partkey"))
    text = F.concat(F.lit("def "), name, F.lit("():\n"), F.repeat(F.lit("    pass\n"), F.greatest(F.col("p_size"), F.lit(1))))
    return dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select(F.concat(F.lit("src/"), name, F.lit(".py")).alias("path"), F.lit("python").alias("language"), text.alias("text"))


@query(
    """SELECT 'src/f' || p_partkey || '.py' AS path, 'LongMethod' AS smell, 'high' AS severity, 'f' || p_partkey AS name, p_size AS value FROM part WHERE p_size > 30
UNION ALL SELECT 'src/f' || p_partkey || '.py', 'DeadCode', 'low', 'f' || p_partkey, NULL FROM part"""
)
def python_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = quality.findings(written_sources(spark, sf_dir))
    return found.select("path", "smell", "severity", "name", "value")


@query(
    """SELECT 'src/f' || p_partkey || '.py' AS path, greatest(p_size, 1) + 1 AS lines, 1 + (p_size > 30)::INT AS findings,
CASE WHEN p_size > 30 THEN 91.0 ELSE 99.0 END::DOUBLE AS score FROM part"""
)
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = written(written_sources(spark, sf_dir), "sources")
    return quality.file_report(files, *quality.findings(files)).select("path", "lines", "findings", "score")


from lintel import detail_queries, finding_queries, model_queries, plan_queries, source_queries  # noqa: E402, F401  register more


def queries() -> dict:
    return {name: (lambda spark, sf_dir, f=f: f(prepare(spark), sf_dir)) for name, f in QUERIES.items()}
