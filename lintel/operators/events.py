"""Workflow event metrics: funnel, stage durations, acceptance and smoothing, decisions, satisfaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lintel.functions.scalars import ratio


def funnel(df: DataFrame, unit: list[Column], stage: str, stages: list[str]) -> DataFrame:
    """Distinct units that reach each stage, their share of the first stage's, and conversion from the stage before. Stages without units stay."""
    dim = df.sparkSession.createDataFrame([(i, s) for i, s in enumerate(stages)], f"pos int, {stage} string")
    reached = df.filter(F.col(stage).isin(stages)).groupBy(stage).agg(F.countDistinct(*unit).alias("reached"))
    all_ = dim.join(reached, stage, "left").withColumn("reached", F.coalesce("reached", F.lit(0)))
    order = Window.orderBy("pos")  # a row a stage
    first = F.first("reached").over(order)
    return all_.select("pos", stage, "reached", F.round(ratio(F.col("reached"), first), 6).alias("share"), F.round(ratio(F.col("reached"), F.lag("reached").over(order)), 6).alias("conversion"))


def stage_durations(df: DataFrame, unit: str, stage: str, time: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """Minutes between the first events of two stages per unit: n, median, mean, min, max per pair; negative spans count as missing."""
    names = sorted({s for p in pairs for s in p})
    firsts = df.groupBy(unit).agg(*[F.min(F.when(F.col(stage) == s, F.col(time))).alias(f"t_{s}") for s in names])
    spans = F.array(*[F.struct(F.lit(f"{a}_{b}").alias("span"), F.col(f"t_{a}").alias("a"), F.col(f"t_{b}").alias("b")) for a, b in pairs])
    long = firsts.select(F.explode(spans).alias("s")).select("s.*").filter("b >= a").withColumn("m", F.timestamp_diff("MICROSECOND", F.col("a"), F.col("b")) / 6e7)
    return long.groupBy("span").agg(
        F.count("m").alias("n"), F.round(F.median("m"), 4).alias("median"), F.round(F.avg("m"), 4).alias("mean"), F.round(F.min("m"), 4).alias("min"), F.round(F.max("m"), 4).alias("max")
    )


def acceptance(df: DataFrame, by: list[str], accepted: Column, strength: float = 5.0) -> DataFrame:
    """Rows, accepted rows, and the rate shrunk to the rate of all rows by `strength` pseudo-rows."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(accepted).alias("accepted"))
    prior = counts.agg(ratio(F.sum("accepted"), F.sum("n")).alias("prior"))
    return counts.crossJoin(F.broadcast(prior)).select(*by, "n", "accepted", F.round((F.col("accepted") + strength * F.col("prior")) / (F.col("n") + strength), 6).alias("smoothed"))  # prior: one row


def satisfaction(df: DataFrame, rating: Column, by: list[str] | None = None, good: int = 4) -> DataFrame:
    return df.groupBy(*(by or [])).agg(
        F.count(rating).alias("n"), F.round(F.avg(rating), 6).alias("mean"), F.round(ratio(F.count_if(rating >= good), F.count(rating)), 6).alias("share_good")
    )


def decision_crosstab(df: DataFrame, by: list[str], decision: str, decisions: list[str]) -> DataFrame:
    return df.groupBy(*by).pivot(decision, decisions).count().fillna(0, subset=decisions)


def session_span(df: DataFrame, by: list[str], time: str) -> DataFrame:
    """First and last event and minutes between; null with fewer than two events."""
    found = df.groupBy(*by).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count(time).alias("n"))
    return found.withColumn("minutes", F.when(F.col("n") > 1, F.round(F.timestamp_diff("MICROSECOND", F.col("first"), F.col("last")) / 6e7, 2)))


def impact_totals(df: DataFrame, by: list[str], selected: Column, executable: Column, points: Column, cost: Column, risk: Column) -> DataFrame:
    """Sums over selected, skipped and all; largest and mean risk of executable rows; share of points selected."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(selected).alias("n_selected"),
        F.round(F.sum(F.when(selected, points).otherwise(0)), 4).alias("points_selected"),
        F.round(F.sum(F.when(selected, 0).otherwise(points)), 4).alias("points_skipped"),
        F.round(F.sum(F.when(selected, cost).otherwise(0)), 4).alias("cost_selected"),
        F.round(F.max(F.when(executable, risk)), 6).alias("max_risk"),
        F.round(F.avg(F.when(executable, risk)), 6).alias("mean_risk"),
        F.round(ratio(F.sum(F.when(selected, points).otherwise(0)), F.sum(points)), 6).alias("capture"),
    )


def orchestration(df: DataFrame, by: list[str], action: str, details: dict[str, Column]) -> DataFrame:
    """Sums and rates over event details: plans by source, runs, actions, steps, reviewed files.

    details: source, success, rollback, actions, executable, noops, files_sent, files_missing, passed, failed, accepted, rejected."""
    of = lambda name: F.col(action) == name
    total = lambda event, name: F.coalesce(F.sum(F.when(of(event), details[name].cast("long"))), F.lit(0))
    run = "transformation_run"
    counts = {
        "plans_remote": F.count_if(of("plan_generated") & (details["source"] == "remote")),
        "plans_fallback": F.count_if(of("plan_generated") & ~F.coalesce(details["source"] == "remote", F.lit(False))),
        "runs": F.count_if(of(run)),
        "run_successes": F.count_if(of(run) & details["success"]),
        "rollbacks": F.count_if(of(run) & details["rollback"]),
        **{name: total(run, name) for name in ("actions", "executable", "noops", "files_sent", "files_missing")},
        **{name: total("transformation_completed", name) for name in ("passed", "failed")},
        **{name: total("transformation_accepted", name) for name in ("accepted", "rejected")},
    }
    found = df.groupBy(*by).agg(*[c.alias(name) for name, c in counts.items()])
    c = F.col
    rates = {
        "remote_rate": ratio(c("plans_remote"), c("plans_remote") + c("plans_fallback")),
        "success_rate": ratio(c("run_successes"), c("runs")),
        "rollback_rate": ratio(c("rollbacks"), c("runs")),
        "executable_rate": ratio(c("executable"), c("actions")),
        "noop_rate": ratio(c("noops"), c("actions")),
        "resolution_rate": ratio(c("files_sent") - c("files_missing"), c("files_sent")),
        "step_pass_rate": ratio(c("passed"), c("passed") + c("failed")),
        "file_acceptance_rate": ratio(c("accepted"), c("accepted") + c("rejected")),
    }
    return found.withColumns({k: F.round(v, 6) for k, v in rates.items()})


def precondition_rates(df: DataFrame, by: list[str], finding: str, holds: Column) -> DataFrame:
    """Candidates, those whose preconditions hold, their share, and findings with such a candidate."""
    found = df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(holds).alias("viable"), F.count_distinct(F.when(holds, F.col(finding))).alias("findings_with_viable"))
    return found.withColumn("pass_rate", F.round(F.coalesce(ratio(F.col("viable"), F.col("total")), F.lit(0.0)), 4))


def success_rates(df: DataFrame, by: list[str], success: Column, status: Column, done: tuple[str, ...] = ("success", "passed", "applied")) -> DataFrame:
    """Steps that say they succeeded, by flag or by status, out of all."""
    good = F.coalesce(success, F.lit(False)) | F.coalesce(F.lower(status).isin(*done), F.lit(False))
    found = df.groupBy(*by).agg(F.count(F.lit(1)).alias("executed"), F.count_if(good).alias("successful"))
    return found.withColumn("success_rate", F.round(ratio(F.col("successful"), F.col("executed")), 4))


def by_stage(df: DataFrame, by: list[str], stage: str, position: str) -> DataFrame:
    """Entries per stage, stages in the order in which they are first seen."""
    found = df.groupBy(*by, stage).agg(F.count(F.lit(1)).alias("entries"), F.min(position).alias("first"))
    return found.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("first")))


def log_of(df: DataFrame, workflow: str, wanted, time: str, tie: str) -> DataFrame:
    """A workflow's entries in order; equal times by the tie column."""
    return df.filter(F.col(workflow) == wanted).orderBy(time, tie)


def newest_first(df: DataFrame, time: str, tie: str) -> DataFrame:
    return df.orderBy(F.desc(time), F.desc(tie))
