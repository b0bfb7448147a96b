"""Source trees, archives and report tables as DataFrames."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lintel.functions.scalars import detect_language
from lintel.operators.ranking import first_per_key
from lintel.session import prepare

# Fixed values.
SKIPPED_FOLDERS = (".git", "node_modules", "__pycache__", ".venv", "venv", "target", "build")
EXTENSIONS = ("py", "java", "c", "h")
LARGEST_ARCHIVE = 500 << 20


def in_skipped_folder(path: Column) -> Column:
    """A path whose folders begin with a skipped name; `builder/` counts, as the rule compares beginnings."""
    names = "|".join(n.replace(".", r"\.") for n in SKIPPED_FOLDERS)
    return path.rlike(f"^(?:{names})[^/]*/")


@F.pandas_udf(StringType())
def decoded(content: pd.Series) -> pd.Series:
    """UTF-8, with a replacement character for what isn't; null stays null."""
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "replace"))


def source_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, language, size, text) of the source files under a folder of any store that Spark reads."""
    prepare(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(EXTENSIONS) + "}").load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^[a-z0-9]+:/*", "/")
    full = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    path = F.regexp_replace(F.substr(full, F.length(base) + 1), "^/+", "")
    rows = files.select(path.alias("path"), F.col("length").alias("size"), "content")
    return rows.filter(~in_skipped_folder(F.col("path"))).select("path", detect_language(F.col("path")).alias("language"), "size", decoded("content").alias("text"))


def folders(paths: DataFrame, path: str = "path") -> DataFrame:
    """(folder, parent, depth, files below) of every folder that a path names."""
    parts = F.split(F.col(path), "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    rows = paths.filter(F.size(parts) > 1).select(F.explode(up).alias("folder"))
    depth = F.size(F.split("folder", "/"))
    return rows.groupBy("folder").agg(F.count(F.lit(1)).alias("files")).select("folder", F.array_join(F.slice(F.split("folder", "/"), 1, F.greatest(depth - 1, F.lit(0))), "/").alias("parent"), depth.alias("depth"), "files")


def archive_members(archives: DataFrame, name: str = "name", content: str = "content", largest_member: int = 64 << 20) -> DataFrame:
    """(name, path, text, error) of the source files in ZIP archives. Archives that are too large or broken give an error row, and so
    does each member that would leave the archive's folder, unpacks to more than largest_member bytes, or can't be read."""
    prepare(archives.sparkSession)
    columns = ["name", "path", "text", "error"]

    def text_of(z: zipfile.ZipFile, member: zipfile.ZipInfo) -> tuple[str | None, str | None]:
        try:
            with z.open(member) as f:
                data = f.read(largest_member + 1)  # what the archive says of sizes may be wrong
        except Exception as e:  # whatever a member holds, the others are read
            return None, f"{type(e).__name__}: {e}"
        return (None, "too large") if len(data) > largest_member else (data.decode("utf-8", "replace"), None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for n, data in zip(pdf["name"], pdf["content"], strict=True):
                try:
                    if data is None or len(data) > LARGEST_ARCHIVE:
                        raise ValueError("too large" if data is not None else "no content")
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        members = [i for i in z.infolist() if not i.is_dir()]
                        tops = {i.filename.split("/", 1)[0] for i in members}
                        top = tops.pop() + "/" if len(tops) == 1 and all("/" in i.filename for i in members) else ""
                        for i in sorted(members, key=lambda i: i.filename):
                            path = i.filename.replace("\\", "/")
                            if path.startswith("/") or ".." in path.split("/"):
                                yield pd.DataFrame([(n, path, None, "path leaves the archive")], columns=columns)
                            elif path.rsplit(".", 1)[-1].lower() in EXTENSIONS:
                                yield pd.DataFrame([(n, path.removeprefix(top), *text_of(z, i))], columns=columns)
                except (zipfile.BadZipFile, ValueError, NotImplementedError, OSError) as e:
                    yield pd.DataFrame([(n, None, None, str(e))], columns=columns)

    return archives.select(F.col(name).alias("name"), F.col(content).alias("content")).mapInPandas(run, "name string, path string, text string, error string")


REVIEW_COLUMNS = ("sample_id", "repository", "commit_hash", "path", "code_name", "type", "smell", "severity", "start_line", "end_line", "link")


def reviews(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """Review rows by header name: strings, trimmed; empty ids are dropped; lines are whole numbers or null."""
    raw = spark.read.option("sep", sep).option("header", True).option("encoding", "UTF-8").option("enforceSchema", False).csv(path)
    named = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    rows = named.select(*[(F.trim(F.col(c)) if c in named.columns else F.lit(None).cast("string")).alias(c) for c in REVIEW_COLUMNS])
    return rows.filter("sample_id IS NOT NULL AND sample_id <> ''").withColumns({c: F.col(c).try_cast("int") for c in ("start_line", "end_line")})


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Labelled rows of the standard form; rows without a 0 or 1 are dropped."""
    rows = spark.read.option("header", True).csv(path)
    return rows.filter(F.trim("ground_truth").isin("0", "1")).withColumn("ground_truth", F.trim("ground_truth").cast("int"))


def feature_table(spark: SparkSession, path: str, schema: str | None = None, key: str = "fingerprint", order: str = "sample_id") -> DataFrame:
    """Rows of a feature table, the first of each fingerprint by number of the sample; rows without a fingerprint stay."""
    reader = spark.read.option("header", True)
    rows = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    first = rows.filter(F.col(key).isNotNull())
    return first_per_key(first, [key], [F.col(order).try_cast("long").asc_nulls_last(), F.col(order)]).unionByName(rows.filter(F.col(key).isNull()))


def label_counts(rows: DataFrame, columns: tuple[str, ...] = ("language", "refactoring", "label")) -> DataFrame:
    """(column, value, n): one pass counts the values of every column."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in columns]))
    return rows.select(pairs.alias("x")).groupBy("x.column", "x.value").agg(F.count(F.lit(1)).alias("n"))


def detect_format(spark: SparkSession, path: str) -> str:
    """reviews or ground_truth, from the header line."""
    head = spark.read.text(path).limit(1).collect()
    line = head[0][0] if head else ""
    return "reviews" if "smell;" in line or "code_name" in line else "ground_truth"


def unique_files(rows: DataFrame) -> DataFrame:
    """One row per (repository, commit, path) with a stable key."""
    keys = ["repository", "commit_hash", "path"]
    return rows.select(*keys).distinct().withColumn("key", F.substring(F.sha1(F.concat_ws("|", *keys)), 1, 20))


def voted(rows: DataFrame) -> DataFrame:
    """Strict majority per (sample, smell): any severity but none is positive."""
    from lintel.operators.metrics import majority

    return majority(rows, ["sample_id", "smell"], F.lower(F.coalesce("severity", F.lit(""))) != "none")


FILE = (
    "STRUCT<file: STRING, relative_path: STRING, language: STRING, metrics: MAP<STRING, BIGINT>, quality_score: DOUBLE, error: STRING, "
    "code_smells: ARRAY<STRUCT<type: STRING, severity: STRING, message: STRING, line: INT, entity: STRING, start_line: INT, end_line: INT, category: STRING>>>"
)


def reports(df: DataFrame, column: str) -> DataFrame:
    """JSON reports as (file fields, findings array); text that isn't a report gives no files. A single file's report counts as one file."""
    many = F.from_json(column, f"STRUCT<files: ARRAY<{FILE}>>")["files"]
    alone = F.from_json(column, FILE)
    files = F.coalesce(many, F.when(alone["code_smells"].isNotNull(), F.array(alone)))
    return df.select(F.explode(files).alias("f")).select("f.*")


def findings(files: DataFrame) -> DataFrame:
    """One row per finding, with id path:line:place, normalised severity and filled line range."""
    from lintel.functions.scalars import normalize_path, normalize_severity

    path = normalize_path(F.coalesce("relative_path", "file"))
    rows = files.select(path.alias("path"), "language", "quality_score", F.posexplode("code_smells").alias("pos", "s"))
    return rows.select(
        F.format_string("%s:%d:%d", "path", F.coalesce("s.line", F.lit(0)), "pos").alias("id"),
        "path",
        "language",
        "quality_score",
        "pos",
        F.col("s.type").alias("smell"),
        normalize_severity(F.col("s.severity")).alias("severity"),
        F.col("s.message").alias("message"),
        F.coalesce("s.start_line", "s.line").alias("start"),
        F.coalesce("s.end_line", "s.start_line", "s.line").alias("end"),
        F.col("s.entity").alias("entity"),
    )
