"""A corpus pipeline: documents to token ids, one operator a stage, each stage written and read again.

Every stage takes documents (doc_id, text, lang, source, n_chars; more columns pass through all stages but the last) and
works on whole texts of any length. An empty table gives an empty one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.llm import jaccard, language, line_dedup, mixing, sentencepieces
from lintel.llm.queries import MIX_BLOCK, MIX_POWER, piece_model
from lintel.session import prepare, table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language the evidence rejects; the others stay as they are.

    Null and empty texts, and texts without letters, are rejected. Null languages and sources give no evidence. Repeated
    rows have one fate, ties of languages go to the first; column names that begin with __ are reserved."""
    prepare(spark)
    found = language.identify(docs, "doc_id", declared="lang", host="source")
    return found.filter("language_kept").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later repeats of runs of 50 words or more; documents of which no line is left go, n_chars follows the text.

    Null texts, and texts without lines to delete, stay as they are; a run's first place by id and line keeps it. Rows of
    equal id and text count as one document and stay both. Null ids are one id, before all others."""
    prepare(spark)
    found = line_dedup.dedup_lines(docs)
    left = found.filter((F.col("lines_deleted") == 0) | (F.col("lines_deleted") < F.col("lines_before")))
    return left.withColumn("n_chars", F.when(F.col("lines_deleted") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: the one with the smallest id. Five-word shingles, similarity of 0.8 or more.

    Rows are compared by their texts, each for itself: rows of one id with different texts are different documents,
    and a null id is an id like others, after all of them. Rows without words have no near duplicates; of those
    that are equal in id and text one stays. Ties of ids are broken by hashes of the text and of the row."""
    prepare(spark)
    place = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), F.xxhash64(*docs.columns), "__row")
    # written, so that every later read finds the same numbers
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()).withColumn("__place", place), "pipeline-rows")
    found = jaccard.components_of(rows.select("__row", "text"), key="__row", size=5, least=80, scale=100)
    # merge joins: the lists of rows and of kept rows grow with the input
    placed = rows.select("__row", "doc_id", F.xxhash64("text").alias("__version"), "__place").join(found.hint("merge"), "__row")
    wordless = F.col("n_shingles") == 0
    group = [F.when(~wordless, F.col("component_id")).alias("component"), F.when(wordless, F.col("doc_id")).alias("id"), F.when(wordless, F.col("__version")).alias("version")]
    kept = placed.groupBy(*group).agg(F.min("__place").alias("first")).select(F.col("first.__row").alias("__row"))
    return rows.join(kept.hint("merge"), "__row", "left_semi").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, stored in the order of the Pfair schedule.

    A null source is a source of its own; texts are not looked at. Every row, repeated ones included, has one place; ties
    are broken by a hash of the id."""
    prepare(spark)
    mixed = mixing.mix(docs, power=MIX_POWER, block_docs=MIX_BLOCK)
    return mixed.repartitionByRange("mix_slot", "mix_place").sortWithinPartitions("mix_slot", "mix_place").select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_chars, token_ids and n_tokens of every document.

    Null and empty texts have no ids; null values of the other columns stay; every row gives one."""
    prepare(spark)
    return sentencepieces.encode(docs, piece_model()).select("doc_id", "source", "lang", "n_chars", "token_ids", "n_tokens")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("sentencepiece", tokenize),
]

#: Language models, pieces and schedules have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
