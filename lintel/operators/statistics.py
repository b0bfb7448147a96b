"""Does a column say anything about a label: contingency tables with chi-squared, and correlations."""

from __future__ import annotations

import math
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lintel.session import prepare, written


def contingency(df: DataFrame, a: str, b: str, missing: str = "missing") -> DataFrame:
    """(a, b, n, expected): every pair of values with its rows and the number that independence would give, pairs without rows too. Nulls are a value of their own."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(missing))
    cells = written(df.groupBy(value(a).alias("a"), value(b).alias("b")).agg(F.count(F.lit(1)).alias("n")), "cells")
    rows, columns = (cells.groupBy(c).agg(F.sum("n").alias(f"n_{c}")) for c in ("a", "b"))
    total = cells.agg(F.sum("n").cast("double").alias("total"))
    grid = rows.crossJoin(F.broadcast(total)).crossJoin(columns)  # a row for each pair of values: the table itself
    return grid.join(cells, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"), (F.col("n_a") * F.col("n_b") / F.col("total")).alias("expected"))


def upper_gamma(a: float, x: float) -> float:
    """The regularised incomplete gamma function Q(a, x) for a that is a multiple of one half: a finite sum."""
    if x <= 0:
        return 1.0
    half = a != int(a)
    total = math.erfc(math.sqrt(x)) if half else 0.0
    k = 0.5 if half else 0.0
    while k < a:
        total += math.exp(k * math.log(x) - x - math.lgamma(k + 1))
        k += 1
    return min(1.0, total)


@F.pandas_udf(DoubleType())
def chi2_tail(statistic: pd.Series, freedom: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(s) or not f > 0 else upper_gamma(f / 2, s / 2) for s, f in zip(statistic, freedom, strict=True)], dtype="float64")


def chi_squared(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(column, statistic, freedom, p) of each column against the label. A table with one row or one column has freedom 0, statistic 0 and no p.

    With one degree of freedom every difference is made smaller by one half, as is usual for tables of four cells."""
    prepare(df.sparkSession)
    found = None
    for c in columns:
        cells = contingency(df, c, label)
        freedom = ((F.countDistinct("a") - 1) * (F.countDistinct("b") - 1)).alias("freedom")
        gap = F.abs(F.col("n") - F.col("expected"))
        plain = F.sum(gap * gap / F.col("expected"))
        less = F.greatest(gap - F.least(F.lit(0.5), gap), F.lit(0.0))
        one = cells.agg(freedom, plain.alias("plain"), F.sum(less * less / F.col("expected")).alias("less"))
        row = one.select(F.lit(c).alias("column"), F.when(F.col("freedom") == 1, F.col("less")).otherwise(F.col("plain")).alias("statistic"), "freedom")
        found = row if found is None else found.unionByName(row)
    return found.withColumn("p", chi2_tail("statistic", F.col("freedom").cast("double")))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, correlation) of every pair of columns, a before b: all of them in one pass, a task keeps a few sums a pair. Rows without one of the two don't count."""
    pairs = list(combinations(columns, 2))
    value = lambda c: F.col(c).cast("double")
    one = df.agg(*[F.corr(F.when(value(b).isNotNull(), value(a)), F.when(value(a).isNotNull(), value(b))).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def largest(correlation: DataFrame) -> DataFrame:
    """The pair with the strongest correlation, of either sign."""
    return correlation.orderBy(F.desc_nulls_last(F.abs("correlation")), "a", "b").limit(1)

