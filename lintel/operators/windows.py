"""Running totals over a whole table without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lintel.session import written


def running_totals(df: DataFrame, order: str, values: list[str], descending: bool = False) -> DataFrame:
    """Append run_<value>: the sum over rows up to this one in order. Order values must be distinct.

    Rows are dealt to ranges of the order; totals of the ranges before, a row a range, are added to totals inside."""
    way = F.desc(order) if descending else F.asc(order)
    parts = written(df.repartitionByRange(way).withColumn("__p", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("__p").agg(*[F.sum(v).alias(f"__{v}") for v in values])
    offsets = sums.select("__p", *[F.coalesce(F.sum(f"__{v}").over(before), F.lit(0)).alias(f"__{v}") for v in values])
    inside = Window.partitionBy("__p").orderBy(way).rowsBetween(Window.unboundedPreceding, 0)
    made = parts.withColumns({f"run_{v}": F.sum(v).over(inside) for v in values})
    return made.join(F.broadcast(offsets), "__p").select(*df.columns, *[(F.col(f"run_{v}") + F.col(f"__{v}")).alias(f"run_{v}") for v in values])  # a row a range
