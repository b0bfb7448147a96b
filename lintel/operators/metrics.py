"""Classification, ranking and agreement metrics as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lintel.functions.scalars import ratio, ratio_or_zero
from lintel.operators.windows import running_totals


def confusion(df: DataFrame, truth: Column, predicted: Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn per group."""
    counts = [
        F.count_if((truth == 1) & (predicted == 1)).alias("tp"),
        F.count_if((truth == 0) & (predicted == 1)).alias("fp"),
        F.count_if((truth == 1) & (predicted == 0)).alias("fn"),
        F.count_if((truth == 0) & (predicted == 0)).alias("tn"),
    ]
    return df.groupBy(*(by or [])).agg(*counts)


def confusion_cube(df: DataFrame, truth: Column, predicted: Column, by: list[str]) -> DataFrame:
    """The same for every subset of the group columns; null stands for all."""
    counts = confusion(df, truth, predicted, by)
    return counts.cube(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])


def rates(tp: Column, fp: Column, fn: Column, tn: Column, zero: bool = False) -> dict[str, Column]:
    """Precision, recall, F1 and the rest; a zero denominator gives null, or 0 if zero is set."""
    tp, fp, fn, tn = (c.cast("double") for c in (tp, fp, fn, tn))
    div = ratio_or_zero if zero else ratio
    mcc = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    recall, specificity = div(tp, tp + fn), div(tn, tn + fp)
    return {
        "precision": div(tp, tp + fp),
        "recall": recall,
        "f1": div(2 * tp, 2 * tp + fp + fn),
        "accuracy": div(tp + tn, tp + fp + fn + tn),
        "specificity": specificity,
        "false_positive_rate": div(fp, fp + tn),
        "false_negative_rate": div(fn, fn + tp),
        "balanced_accuracy": (recall + specificity) / 2,
        "mcc": div(tp * tn - fp * fn, mcc),
    }


def with_rates(df: DataFrame, zero: bool = False, digits: int = 6) -> DataFrame:
    found = rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"), zero)
    return df.withColumns({k: F.round(v, digits) for k, v in found.items()})


def macro_micro(per_class: DataFrame, digits: int = 6) -> DataFrame:
    """Means of the classes' defined values, and the values of the pooled counts."""
    found = with_rates(per_class.select("tp", "fp", "fn", "tn"), digits=15)
    pooled = [F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")]
    one = found.agg(*pooled, *[F.round(F.avg(m), digits).alias(f"macro_{m}") for m in ("precision", "recall", "f1")])
    micro = rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    return one.withColumns({f"micro_{m}": F.round(micro[m], digits) for m in ("precision", "recall", "f1")})


def cohens_kappa(df: DataFrame, a: Column, b: Column, by: list[str] | None = None, least: int = 5) -> DataFrame:
    """Observed and expected agreement and kappa of two 0/1 raters; null under `least` rows, 1 if chance agrees always."""
    rated = df.filter(a.isin(0, 1) & b.isin(0, 1))
    n = F.count(F.lit(1)).cast("double")
    found = rated.groupBy(*(by or [])).agg(n.alias("n"), F.avg((a == b).cast("double")).alias("observed"), F.avg(a.cast("double")).alias("pa"), F.avg(b.cast("double")).alias("pb"))
    chance = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    kappa = F.when(chance == 1, 1.0).otherwise(ratio(F.col("observed") - chance, 1 - chance))
    return found.select(*(by or []), F.col("n").cast("long").alias("n"), F.round("observed", 6).alias("observed"), F.round(chance, 6).alias("expected"), F.when(F.col("n") >= least, F.round(kappa, 6)).alias("kappa"))


def pair_agreement(df: DataFrame, item: list[str], positive: Column, by: list[str] | None = None) -> DataFrame:
    """Agreement over all pairs of an item's ratings, from counts: n ratings with k positive hold k(k-1)/2 pairs that agree on it."""
    by = by or []
    counts = df.groupBy(*by, *item).agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_if(positive).cast("double").alias("k"))
    pairs = lambda x: x * (x - 1) / 2
    n, k = F.col("n"), F.col("k")
    summed = counts.groupBy(*by).agg(F.sum(pairs(n)).alias("pairs"), F.sum(pairs(k) + pairs(n - k)).alias("agreeing"), F.sum((n - 1) * k).alias("marks"), F.sum((n - 1) * n).alias("places"))
    p = ratio(F.col("marks"), F.col("places"))
    chance = p * p + (1 - p) * (1 - p)
    observed = ratio(F.col("agreeing"), F.col("pairs"))
    return summed.select(*by, F.col("pairs").cast("long").alias("pairs"), F.round(observed, 6).alias("observed"), F.round(F.when(chance == 1, 1.0).otherwise(ratio(observed - chance, 1 - chance)), 6).alias("kappa"))


def majority(df: DataFrame, by: list[str], positive: Column) -> DataFrame:
    """label 1 if more than half of the votes are positive; ties give 0."""
    counted = df.groupBy(*by).agg(F.count(F.lit(1)).alias("votes"), F.count_if(positive).alias("positive"))
    return counted.withColumn("label", (F.col("positive") * 2 > F.col("votes")).cast("int"))


def threshold_sweep(df: DataFrame, score: Column, truth: Column) -> DataFrame:
    """A row per distinct score: what predicting 1 from that score up gives. Cumulative counts over distinct scores only."""
    at = df.select(score.alias("threshold"), truth.alias("y")).filter("threshold IS NOT NULL AND y IS NOT NULL")
    by_score = at.groupBy("threshold").agg(F.sum("y").alias("ones"), F.count(F.lit(1)).alias("rows"))
    total = at.agg(F.sum("y").alias("all_ones"))
    running = running_totals(by_score, "threshold", ["ones", "rows"], descending=True).crossJoin(F.broadcast(total))  # one row
    tp, fp, ones = F.col("run_ones"), F.col("run_rows") - F.col("run_ones"), F.col("all_ones")
    return running.select("threshold", tp.alias("tp"), fp.alias("fp"), (ones - tp).alias("fn"), F.round(2 * tp / (tp + fp + ones), 9).alias("f1"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The row of the best F1; of equals, the highest threshold."""
    return sweep.orderBy(F.desc("f1"), F.desc("threshold")).limit(1)


def roc_auc(df: DataFrame, score: Column, truth: Column, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve by mean ranks, from counts per distinct score."""
    by = by or []
    at = df.select(*by, score.alias("s"), truth.alias("y")).filter("s IS NOT NULL AND y IS NOT NULL")
    counts = at.groupBy(*by, "s").agg(F.sum("y").cast("double").alias("ones"), F.count_if(F.col("y") == 0).cast("double").alias("zeros"))
    if by:
        below = Window.partitionBy(*by).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
        ranked = counts.withColumn("under", F.coalesce(F.sum("zeros").over(below), F.lit(0.0)))
    else:
        ranked = running_totals(counts, "s", ["zeros"]).withColumn("under", F.col("run_zeros") - F.col("zeros"))
    summed = ranked.groupBy(*by).agg(F.sum(F.col("ones") * (F.col("under") + F.col("zeros") / 2)).alias("u"), F.sum("ones").alias("p"), F.sum("zeros").alias("n"))
    return summed.select(*by, F.round(ratio(F.col("u"), F.col("p") * F.col("n")), 6).alias("auc"), F.col("p").cast("long").alias("positives"), F.col("n").cast("long").alias("negatives"))


def pr_auc(df: DataFrame, score: Column, truth: Column) -> DataFrame:
    """Average precision: precision at each distinct score, weighted by the recall that it adds."""
    at = df.select(score.alias("s"), truth.alias("y")).filter("s IS NOT NULL AND y IS NOT NULL")
    counts = at.groupBy("s").agg(F.sum("y").alias("ones"), F.count(F.lit(1)).alias("rows"))
    running = running_totals(counts, "s", ["ones", "rows"], descending=True)
    summed = running.agg(F.sum(F.col("ones") * ratio(F.col("run_ones"), F.col("run_rows"))).alias("a"), F.sum("ones").alias("positives"))
    return summed.select(F.round(ratio(F.col("a"), F.col("positives")), 6).alias("pr_auc"), "positives")


def system_comparison(df: DataFrame, by: list[str], expected: Column, predicted: Column, rank: Column, latency: Column, k: int = 3) -> DataFrame:
    """Per system: cases, accuracy, MRR and NDCG of the expected fix's rank, mean latency."""
    found = df.groupBy(*by).agg(F.round(F.avg((expected == predicted).cast("double")), 6).alias("accuracy"), F.round(F.avg(latency), 6).alias("latency"))
    return found.join(ranking(df, rank, k, by), by)


def brier(df: DataFrame, score: Column, truth: Column) -> DataFrame:
    return df.agg(F.avg((score - truth) * (score - truth)).alias("brier"))


def ranking(df: DataFrame, rank: Column, k: int = 3, by: list[str] | None = None) -> DataFrame:
    """MRR, NDCG@k and top-k accuracy over rows that hold the rank of the expected item, null if it isn't ranked."""
    hit = rank <= k
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.coalesce(1.0 / rank, F.lit(0.0))), 6).alias("mrr"),
        F.round(F.avg(F.when(hit, 1.0 / F.log2(rank + 1.0)).otherwise(0.0)), 6).alias("ndcg"),
        F.round(F.avg(F.when(hit, 1.0).otherwise(0.0)), 6).alias("top_k"),
        F.round(F.avg(F.when(rank == 1, 1.0).otherwise(0.0)), 6).alias("top_1"),
    )
