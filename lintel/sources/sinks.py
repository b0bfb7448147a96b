"""Writers: append-only logs with a latest-per-key view, deletes by rewrite, exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.operators.ranking import latest_per_key
from lintel.session import written


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("append").partitionBy(*(partition_by or [])).parquet(path)


def append_new(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Append rows whose key the table doesn't have yet, one per key; returns what was appended."""
    spark = df.sparkSession
    new = written(df.dropDuplicates(keys).join(spark.read.parquet(path).select(*keys), keys, "left_anti"), "append-new")
    append(new, path)
    return new


def current(spark: SparkSession, path: str, keys: list[str], time: str, tie: str) -> DataFrame:
    """The latest row per key of an append-only log: upserts are appends."""
    return latest_per_key(spark.read.parquet(path), keys, time, tie)


def update_rows(spark: SparkSession, path: str, keys: list[str], time: str, tie: str, condition: str, values: dict, at) -> int:
    """Append new versions, at time `at`, of the current rows for which the condition is true; returns how many."""
    found = current(spark, path, keys, time, tie).filter(F.coalesce(F.expr(condition), F.lit(False)))
    new = written(found.withColumns({**{k: F.lit(v).cast(found.schema[k].dataType) for k, v in values.items()}, time: F.lit(at).cast(found.schema[time].dataType)}), "update")
    n = new.count()
    if n:
        append(new.select(*spark.read.parquet(path).columns), path)
    return n


def compare_and_set(spark: SparkSession, path: str, keys: list[str], time: str, tie: str, key: dict, expected: dict, values: dict, at) -> bool:
    """update_rows of one key, only if its current row has the expected values. Parquet has no transactions: one writer at a time, a foreachBatch say."""
    same = " AND ".join(f"`{k}` <=> {literal(v)}" for k, v in {**key, **expected}.items())
    return update_rows(spark, path, keys, time, tie, same, values, at) > 0


def literal(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, int | float) else "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def replaced(df: DataFrame, path: str) -> None:
    """Put a frame's rows in the place of a table that it may be read from.

    The new table is written beside the old one and takes its name when it is whole; a failure before that leaves the old one as
    it was, a failure between the two renames leaves both, the old one as <path>.before-..."""
    spark = df.sparkSession
    mark = uuid.uuid4().hex
    new, old, place = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.new-{mark}", f"{path}.before-{mark}", path))
    df.write.parquet(new.toString())
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(place) and not store.rename(place, old) or not store.rename(new, place):
        raise OSError(f"{path} could not be replaced; the new table is {new.toString()}")
    store.delete(old, True)
    spark.catalog.refreshByPath(path)


def delete_where(spark: SparkSession, path: str, condition: str) -> int:
    """Rewrite a table without the rows for which the condition is true; returns how many rows went."""
    rows = spark.read.parquet(path)
    before = rows.count()
    replaced(rows.filter(~F.coalesce(F.expr(condition), F.lit(False))), path)
    return before - spark.read.parquet(path).count()


def export_csv(df: DataFrame, path: str, order: list | None = None, partition_by: list[str] | None = None) -> None:
    """CSV with a header; ordered exports are range partitioned, so that files in name order are in row order."""
    out = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    out.write.mode("overwrite").option("header", True).partitionBy(*(partition_by or [])).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def markdown(df: DataFrame, limit: int = 200) -> str:
    """A small result as a table of text; more than `limit` rows are counted, not shown."""
    rows = df.limit(limit + 1).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows[:limit]]
    return "\n".join(lines + (["", f"More than {limit} rows."] if len(rows) > limit else []))
