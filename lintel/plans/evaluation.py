"""Detector evaluation: match predictions to labelled rows, then metrics by class and language."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.functions.scalars import canonical_smell, normalize_path
from lintel.operators import grouped, metrics
from lintel.session import written


def outcomes(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """A row per labelled row and per unmatched prediction with tp, fp, fn, tn flags.

    truth: language, path, smell, id, kind, name, start, end, pos, label; predictions: the keys, pid, name, start, end, pos."""
    keys = ["language", "path", "smell"]
    named = {"language": F.lower("language"), "path": normalize_path(F.col("path")), "smell": canonical_smell(F.col("smell"))}
    truth, predictions = truth.withColumns(named), predictions.withColumns(named)
    pairs = written(grouped.greedy_match(truth.drop("label"), predictions, keys), "matches")
    labels = truth.select(F.col("id"), "label")
    joined = pairs.join(labels, "id", "left")
    hit, positive = F.col("pid").isNotNull(), F.coalesce(F.col("label"), F.lit(0)) == 1
    flag = lambda c: c.cast("int")
    return joined.select(*keys, "id", "pid", flag(hit & positive).alias("tp"), flag(hit & ~positive).alias("fp"), flag(~hit & positive).alias("fn"), flag(~hit & ~positive).alias("tn"))


def evaluate(rows: DataFrame) -> DataFrame:
    """Metrics for every language, smell, both, and all."""
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")]
    return metrics.with_rates(rows.cube("language", "smell").agg(*sums))
