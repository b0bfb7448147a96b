"""Reports with open records: files and findings as VARIANT, so that fields nobody has thought of are kept.

A report is JSON: an envelope with `report`, a repository's report with `files`, or one file's report. A file and a finding
are a VARIANT each beside the columns that the rules need, and a report is written from the VARIANTs again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.functions.scalars import file_name, normalize_path, normalize_severity

# Findings about a class, findings whose entity is a method, and a finding's numbers.
CLASS_LEVEL = ("LargeClass", "LazyClass", "PrimitiveObsession", "InappropriateIntimacy", "SpeculativeGenerality", "GodClass")
METHOD_LEVEL = ("LongMethod", "LongFunction", "TooManyParameters", "SwitchStatements", "MessageChains", "FeatureEnvy", "DuplicateCode", "DataClumps", "BareExcept", "DeadCode")
FILE_NUMBERS = ("lines_of_code", "blank_lines", "comment_lines", "functions", "classes")
FINDING_NUMBERS = ("cyclomatic_complexity", "parameter_count", "method_count", "primitive_field_count", "chain_length", "nesting_depth", "external_field_accesses", "self_field_accesses")
FULL_SCORE = 100.0
FILE = "struct<relative_path:string,file:string,language:string,quality_score:double,error:string,code_smells:array<variant>>"
FINDING = "struct<type:string,severity:string,message:string,line:int,start_line:int,end_line:int,entity:string,category:string,category_priority:string," + ",".join(f"{n}:double" for n in FINDING_NUMBERS) + ">"


def get(v: Column, path: str, kind: str) -> Column:
    """A field of a VARIANT as some type; null where it is missing, null, or nothing of that type."""
    return F.try_variant_get(v, path, kind)


def text(v: Column, path: str) -> Column:
    """A field as text; null for empty ones too."""
    return F.nullif(get(v, path, "string"), F.lit(""))


def is_object(v: Column) -> Column:
    """Whether a VARIANT is an object; one field is asked for, so its others aren't copied."""
    return get(v, "$", "struct<type:variant>").isNotNull()


def report_files(df: DataFrame, column: str, keep: list[str] | None = None) -> DataFrame:
    """One row a file of the JSON reports in a column: keep, repository, file_pos, path, language, score, error, file (VARIANT) and findings (array of VARIANT).

    What isn't JSON, isn't an object, or holds no object among its files gives no row; elements of a list that are no objects
    are left out. A file without a path is `unknown`, one without a language has its ending's, one without a score has 100."""
    keep = keep or []
    whole = F.try_parse_json(column)
    nested = get(whole, "$.report", "struct<type:variant>")
    body = F.when(nested.isNotNull(), F.try_variant_get(whole, "$.report", "variant")).otherwise(whole)
    rows = df.select(*keep, body.alias("__body"), whole.alias("__whole"))  # what is no object has no object below; a filter here would make and parse the text again
    listed = get(F.col("__body"), "$.files", "array<variant>")
    many = rows.withColumn("__files", F.coalesce(listed, F.array("__body")))
    name = F.when(listed.isNotNull(), F.coalesce(text(F.col("__body"), "$.repo_name"), text(F.col("__whole"), "$.repo_name"))).otherwise(F.coalesce(text(F.col("__body"), "$.relative_path"), text(F.col("__body"), "$.file")))
    objects = F.filter("__files", is_object)
    files = many.select(*keep, name.alias("repository"), F.posexplode(objects).alias("file_pos", "file"))
    files = files.withColumn("__v", get(F.col("file"), "$", FILE))  # all fields at once; one of another type is null
    v = F.col("__v")
    filled = lambda n: F.nullif(v[n], F.lit(""))
    path = F.replace(F.coalesce(filled("relative_path"), filled("file"), F.lit("unknown")), F.lit("\\"), F.lit("/"))
    ending = F.regexp_extract(file_name(path), r"[^.]\.([^.]+)$", 1)
    language = F.lower(F.coalesce(filled("language"), F.nullif(ending, F.lit("")), F.lit("unknown")))
    found = F.filter(F.coalesce(v["code_smells"], F.array()), is_object)
    score = F.coalesce(v["quality_score"], F.lit(FULL_SCORE))
    return files.select(*keep, "repository", "file_pos", path.alias("path"), language.alias("language"), score.alias("score"), filled("error").alias("error"), "file", found.alias("findings"))


def present(pairs: list[tuple[str, Column]]) -> Column:
    """A map of the pairs whose value isn't null."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), x.cast("double").alias("value")) for k, x in pairs])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def flat_findings(files: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row a finding of report_files(): id (path:line:place), what it says, where it is, metrics, and the finding itself.

    metrics are the file's numbers (0 where missing, the score 100) and the finding's own. A finding about a class has its
    entity as class, one about a method as method; the class is the file's stem otherwise. `finding` keeps every field."""
    numbers = get(F.col("file"), "$.metrics", f"struct<{','.join(f'{n}:double' for n in FILE_NUMBERS)}>")
    stem = F.regexp_replace(file_name(F.col("path")), r"(?<=.)\.[^.]*$", "")
    named = files.select(*(keep or []), "repository", "path", "language", "score", stem.alias("__stem"), numbers.alias("__numbers"), "findings")  # once a file
    # outer: the planner would look for files without findings first, and so read all findings twice
    rows = named.select("*", F.posexplode_outer("findings").alias("pos", "finding")).drop("findings").filter("pos IS NOT NULL")
    rows = rows.withColumn("__v", get(F.col("finding"), "$", FINDING))
    v, stem = F.col("__v"), F.col("__stem")
    line = F.coalesce(v["line"], F.lit(0))
    start = F.coalesce(F.nullif(v["start_line"], F.lit(0)), line)
    end = F.coalesce(F.nullif(v["end_line"], F.lit(0)), start)
    smell, entity = F.coalesce(F.nullif(v["type"], F.lit("")), F.lit("Unknown")), v["entity"]
    of_file = [(n, F.coalesce(F.col(f"__numbers.{n}"), F.lit(0.0))) for n in FILE_NUMBERS]
    metrics = present([*of_file, ("quality_score", F.col("score")), *[(n, v[n]) for n in FINDING_NUMBERS]])
    return rows.select(
        *(keep or []),
        "repository",
        F.format_string("%s:%d:%d", "path", line, "pos").alias("id"),
        "path",
        "pos",
        "language",
        smell.alias("smell"),
        normalize_severity(v["severity"]).alias("severity"),
        F.coalesce(v["message"], F.lit("")).alias("message"),
        line.alias("line"),
        entity.alias("entity"),
        v["category"].alias("category"),
        v["category_priority"].alias("category_priority"),
        F.struct(
            F.col("path").alias("file"),
            F.when(smell.isin(*CLASS_LEVEL), F.coalesce(F.nullif(entity, F.lit("")), stem)).otherwise(stem).alias("class"),
            F.when(smell.isin(*METHOD_LEVEL), entity).alias("method"),
            F.array(start, end).alias("lines"),
        ).alias("location"),
        metrics.alias("metrics"),
        "finding",
    )


def summary_of(severities: Column) -> Column:
    count = lambda level: F.size(F.filter(severities, lambda s: s == level)).alias(level)
    return F.struct(count("high"), count("medium"), count("low"))


def narrowed(files: DataFrame, chosen: DataFrame | None, by: list[str]) -> DataFrame:
    """report_files() rows with the findings whose id is in chosen (by, id), all of them without chosen: findings, kept, smell_summary, report (JSON of the file).

    Files stay, without findings too. Everything in a file and a finding stays as it is, but code_smells, smell_summary and the
    relative_path are written anew. by: columns that tell reports apart; with file_pos they are a file's key."""
    key = [*by, "file_pos"]
    ids = F.transform("findings", lambda v, i: F.format_string("%s:%d:%d", F.col("path"), F.coalesce(get(v, "$.line", "int"), F.lit(0)), i))
    rows = files.withColumn("__ids", ids)
    if chosen is not None:
        wanted = rows.select(*key, F.explode("__ids").alias("id")).join(chosen.select(*by, "id").distinct(), [*by, "id"], "left_semi")
        wanted = wanted.groupBy(*key).agg(F.collect_set("id").alias("__wanted"))  # no more than the file's findings
        rows = rows.join(wanted, key, "left").withColumn("__wanted", F.coalesce("__wanted", F.array().cast("array<string>")))
        mine = F.filter(F.arrays_zip("findings", "__ids"), lambda z: F.array_contains("__wanted", z["__ids"]))
    else:
        mine = F.arrays_zip("findings", "__ids")
    rows = rows.withColumn("__mine", mine)
    rows = rows.withColumns({"findings": F.transform("__mine", lambda z: z["findings"]), "kept": F.transform("__mine", lambda z: z["__ids"])})
    severities = F.transform("findings", lambda v: normalize_severity(get(v, "$.severity", "string")))
    rows = rows.withColumn("smell_summary", summary_of(severities))
    known = F.map_filter(get(F.col("file"), "$", "map<string,variant>"), lambda k, _: ~k.isin("code_smells", "smell_summary", "relative_path"))
    anew = F.create_map(F.lit("code_smells"), F.col("findings").cast("variant"), F.lit("smell_summary"), F.to_variant_object("smell_summary"), F.lit("relative_path"), F.col("path").cast("variant"))
    return rows.withColumn("report", F.to_json(F.map_concat(known, anew))).drop("__ids", "__wanted", "__mine")


def summary(files: DataFrame, by: list[str]) -> DataFrame:
    """A row a report of narrowed(): files, lines, findings, by severity, files with findings, and the mean score to one place."""
    count = lambda level: F.sum(F.col(f"smell_summary.{level}"))
    return files.groupBy(*by).agg(
        F.count(F.lit(1)).alias("files_analyzed"),
        F.sum(F.coalesce(get(F.col("file"), "$.metrics.lines_of_code", "long"), F.lit(0))).alias("total_lines_of_code"),
        F.sum(F.size("findings")).alias("total_code_smells"),
        *[count(level).alias(level) for level in ("high", "medium", "low")],
        F.count_if(F.size("findings") > 0).alias("selected_file_count"),
        F.round(F.avg("score"), 1).alias("average_quality_score"),
    )
