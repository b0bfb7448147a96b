"""Top rows, latest rows, ranks of expected items, re-ranking and state by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_per_key(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row per key; the limit applies before the shuffle, so a hot key sends a row a task."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("__n = 1").drop("__n")


def top_per_key(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)


def latest_per_key(df: DataFrame, by: list[str], time: str, tie: str) -> DataFrame:
    """The newest row per key as a grouped maximum; ties of time go to the larger tie value."""
    rest = [c for c in df.columns if c not in by]
    newest = df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(time, tie)).alias("__row"))
    return newest.select(*by, *[F.col(f"__row.{c}").alias(c) for c in rest])


def supersede(df: DataFrame, by: list[str], created: str, tie: str, status: str, queued: str = "queued") -> DataFrame:
    """Queued rows that aren't the newest of their key become superseded."""
    newest = df.groupBy(*by).agg(F.max(F.struct(created, tie)).alias("__newest"))
    joined = df.join(newest, by)
    older = (F.col(status) == queued) & (F.struct(created, tie) < F.col("__newest"))
    return joined.withColumn(status, F.when(older, "superseded").otherwise(F.col(status))).drop("__newest")


def claimable(df: DataFrame, status: str, due: str, locked: str, now: Column, stale: Column, order: list[Column], limit: int = 10) -> DataFrame:
    """Jobs that a worker may take: queued and due, or in progress with a stale lock; the oldest first."""
    open_ = (F.col(status) == "queued") & (F.col(due) <= now) | (F.col(status) == "in_progress") & (F.col(locked) < stale)
    return df.filter(open_).orderBy(*order).limit(limit)


def rank_of_expected(ranked: DataFrame, expected: DataFrame, by: list[str], item: str, score: str, position: str) -> DataFrame:
    """expected (by, item) with the item's 1-based rank by score; missing and zero scores are last, ties by position."""
    order = Window.partitionBy(*by).orderBy(F.desc_nulls_last(F.nullif(F.col(score), F.lit(0))), position)
    places = ranked.withColumn("rank", F.row_number().over(order)).select(*by, item, "rank")
    return expected.join(places, [*by, item], "left")


def renumber(df: DataFrame, by: list[str], order: list[Column], name: str = "step") -> DataFrame:
    """1-based places in order, per key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
