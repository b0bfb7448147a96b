"""Job events as streams: idempotent intake, state per job, windowed counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.operators.ranking import latest_per_key


# Stages of a workflow, in order.
STAGES = ("detect", "select", "plan", "approve", "transform", "validate", "done")


def unique_deliveries(events: DataFrame, key: str = "delivery_id", time: str = "ts", late: str = "1 day") -> DataFrame:
    """Each delivery once; state is dropped once the watermark has passed, so it stays bounded."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def window_counts(events: DataFrame, time: str, width: str, late: str, by: list[str]) -> DataFrame:
    """Events per window and key; rows later than the watermark are dropped by the engine in append mode."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), *by).agg(F.count(F.lit(1)).alias("n"))


def next_stage(stage: Column) -> Column:
    """The stage after this one; null after the last and for unknown ones."""
    names = F.array(*[F.lit(s) for s in STAGES])
    at = F.array_position(names, stage)
    return F.when(at > 0, F.try_element_at(names, (at + 1).cast("int")))


def at_stage(workflows: DataFrame, stages: list[str], stage: str = "stage") -> DataFrame:
    """Append `stage_error`: null for workflows at one of these stages, else what is wrong."""
    wrong = F.concat(F.lit("expected "), F.lit(" or ".join(stages)), F.lit(", is "), F.coalesce(F.col(stage), F.lit("none")))
    return workflows.withColumn("stage_error", F.when(F.coalesce(F.col(stage).isin(*stages), F.lit(False)), F.lit(None).cast("string")).otherwise(wrong))


def claim(jobs: DataFrame, worker: str, now: Column, lock_seconds: int = 900, most: int = 5, n: int = 1) -> DataFrame:
    """The jobs table (id, status, attempts, due, locked_at, locked_by) after a worker has taken its next `n` jobs.

    Jobs in progress whose lock is old come back, or fail for good once their attempts are used up; of the queued and due ones the
    oldest, by due time and id, are taken. One writer applies it to the state, in a foreachBatch say: the table itself has no lock."""
    stale = (F.col("status") == "in_progress") & (F.col("locked_at") < now - F.expr(f"INTERVAL {lock_seconds} SECONDS"))
    spent = F.col("attempts") >= most
    freed = jobs.withColumn("status", F.when(stale & spent, "failed").when(stale, "queued").when((F.col("status") == "queued") & spent, "failed").otherwise(F.col("status")))
    taken = freed.filter((F.col("status") == "queued") & (F.col("due") <= now)).orderBy("due", "id").limit(n).select("id", F.lit(True).alias("__mine"))
    mine = F.coalesce("__mine", F.lit(False))
    return freed.join(taken, "id", "left").select(
        "id",
        F.when(mine, "in_progress").otherwise(F.col("status")).alias("status"),
        F.when(mine, F.col("attempts") + 1).otherwise(F.col("attempts")).alias("attempts"),
        "due",
        F.when(mine, now).otherwise(F.col("locked_at")).alias("locked_at"),
        F.when(mine, F.lit(worker)).otherwise(F.col("locked_by")).alias("locked_by"),
    )


def poll(events: DataFrame, handle, checkpoint: str, every: str = "5 seconds", once: bool = False):
    """Start handle(batch, id) on what has arrived, every so often; once: until all that is there is done."""
    writer = events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def versions(spark: SparkSession, state_path: str) -> dict[int, object]:
    """The finished versions of a state, by batch."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(state_path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return {}
    found = [s.getPath() for s in store.listStatus(folder) if s.getPath().getName().startswith("version=")]
    done = [p for p in found if store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return {int(p.getName().removeprefix("version=")): p for p in done}


def apply_batch(state_path: str, keys: list[str], time: str, tie: str):
    """For foreachBatch: the state's next version is the newest row per key of the version before and the batch.

    A version is named after its batch and made from an earlier one, so a batch that is repeated makes the same state. The two last
    versions are kept: a reader of the one before isn't disturbed."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [n for n in versions(spark, state_path) if n < batch_id]
        rows = batch.unionByName(spark.read.parquet(f"{state_path}/version={max(before)}")) if before else batch
        latest_per_key(rows, keys, time, tie).write.mode("overwrite").parquet(f"{state_path}/version={batch_id}")
        for n, path in versions(spark, state_path).items():
            if n < max(before, default=batch_id):
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return run


def state(spark: SparkSession, state_path: str) -> DataFrame:
    """The newest row per key of all batches so far."""
    return spark.read.parquet(f"{state_path}/version={max(versions(spark, state_path))}")


def retry(jobs: DataFrame, failed: DataFrame, most: int = 5) -> DataFrame:
    """Jobs with failed ones put back into the queue with a longer wait, or failed for good after `most` attempts."""
    from lintel.functions.scalars import backoff_seconds

    hit = jobs.join(failed.select("id").distinct().withColumn("__failed", F.lit(True)), "id", "left")
    attempts = F.col("attempts") + 1
    wait = F.timestamp_seconds(F.unix_timestamp("due") + backoff_seconds(attempts))
    again = F.coalesce("__failed", F.lit(False))
    return hit.select(
        "id",
        F.when(again, F.when(attempts >= most, "failed").otherwise("queued")).otherwise(F.col("status")).alias("status"),
        F.when(again, attempts).otherwise(F.col("attempts")).alias("attempts"),
        F.when(again & (attempts < most), wait).otherwise(F.col("due")).alias("due"),
    )


