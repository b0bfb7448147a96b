"""Sessions, table readers and the shared folder for materialised tables."""

from __future__ import annotations

import atexit
import os
import shutil
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cores: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lintel")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", "/tmp/lintel-warehouse")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package; on a cluster it is installed or sent with --py-files."""
    seen = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in seen:
        have = spark.sparkContext.environment.get("PYTHONPATH", "")
        if ROOT not in have.split(os.pathsep):
            spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, in local mode only, one of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = f"/tmp/lintel-shared/{spark.sparkContext.applicationId}"
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Parquet looks at the size of what it holds back after a hundred rows; rows of megabytes are looked at one by one.
LARGE_ROWS = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}


def written(df: DataFrame, name: str, large: bool = False) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors, and fixes the rows. large: rows may have megabytes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(LARGE_ROWS if large else {})).parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.written_at = path
    return made


def discard(*frames: DataFrame) -> None:
    """Delete tables that written() made and that nothing will read again; a frame derived from one fails after this."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def dealt(df: DataFrame, rows: int = 4096) -> DataFrame:
    """The rows of a table dealt evenly to tasks of `rows` each, and to every core if there are fewer.

    A table of keys and numbers is a split or two, however much work is made of a row: so its texts would all be made and read in one task."""
    n = df.count()
    return df.repartition(max(-(-n // rows), min(df.sparkSession.sparkContext.defaultParallelism, -(-n // 64)), 1))


def widened(df: DataFrame, columns: str) -> StructType:
    """The frame's schema with more columns, given as DDL; the frame's own schema object stays as it is."""
    return StructType([*df.schema.fields, *StructType.fromDDL(columns).fields])
