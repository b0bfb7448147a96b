"""Distinct rows in order, duplicate groups, differences, conflict pruning, splits by group."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.operators.ranking import first_per_key


def distinct_in_order(df: DataFrame, by: list[str], position: str) -> DataFrame:
    return df.groupBy(*by).agg(F.min(position).alias(position)).orderBy(position)


def duplicate_groups(df: DataFrame, by: list[str], item: str, fingerprint: Column, least: int = 2) -> DataFrame:
    """Fingerprints that at least `least` items of a key share: group size and first item. No list of members is built."""
    found = df.groupBy(*by, fingerprint.alias("fingerprint")).agg(F.count(F.lit(1)).alias("members"), F.min(item).alias("first"))
    return found.filter(F.col("members") >= least)


def difference(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return df.join(other.select(*on).distinct(), on, "left_anti")


#: Smells of which every fix removes the entity.
DEAD = ("Dead Code", "DeadCode", "UnreachableCode")


def prune_conflicts(steps: DataFrame, plan: str, entity: str, action: str, position: str, removing: list[str], group: str | None = None, smell: str | None = None) -> DataFrame:
    """Steps of a plan without conflicts: an entity that is to be removed keeps its removing steps only, of equal actions on
    an entity the first stays, and so does the first of a group of duplicates. Steps without an entity or group stay.

    Removing steps are those of a removing action and those of a smell in DEAD, whatever their action."""
    known = F.coalesce(F.nullif(F.nullif(F.trim(entity), F.lit("")), F.lit("unknown")))
    removes = F.col(action).isin(removing) | (F.col(smell).isin(*DEAD) if smell else F.lit(False))
    rows = steps.withColumn("__e", known).withColumn("__removes", F.coalesce(removes, F.lit(False)))
    gone = rows.filter("__e IS NOT NULL AND __removes").select(plan, F.col("__e")).distinct()
    rows = rows.join(gone.withColumn("__gone", F.lit(True)), [plan, "__e"], "left").filter("__gone IS NULL OR __removes")
    named = first_per_key(rows.filter(F.trim(entity) != ""), [plan, entity, action], [F.col(position)])
    kept = named.unionByName(rows.filter(F.coalesce(F.trim(entity), F.lit("")) == ""))
    if group:
        kept = first_per_key(kept.filter(F.col(group).isNotNull()), [plan, group], [F.col(position)]).unionByName(kept.filter(F.col(group).isNull()))
    return kept.select(*steps.columns)


def union_names(*frames: DataFrame) -> DataFrame:
    """Distinct rows of all frames, by column name."""
    found = frames[0]
    for f in frames[1:]:
        found = found.unionByName(f)
    return found.distinct()


def union_in_order(*frames: DataFrame) -> DataFrame:
    """All rows, with the number of the frame that a row is from."""
    numbered = [f.withColumn("part", F.lit(i)) for i, f in enumerate(frames)]
    found = numbered[0]
    for f in numbered[1:]:
        found = found.unionByName(f)
    return found


def split_by_group(df: DataFrame, group: str, percent: int = 20, seed: int = 7) -> DataFrame:
    """Append is_test: whole groups go to one side, by hash."""
    return df.withColumn("is_test", F.pmod(F.xxhash64(F.col(group), F.lit(seed)), F.lit(100)) < percent)


def folds_by_group(df: DataFrame, group: str, folds: int = 5, seed: int = 7) -> DataFrame:
    return df.withColumn("fold", F.pmod(F.xxhash64(F.col(group), F.lit(seed)), F.lit(folds)).cast("int"))


def dealt(groups: list[tuple[str, dict]], folds: int) -> list[int]:
    """A fold for each (name, rows by class) in order: where its classes are rarest so far, weighted by their share of all rows.

    A class's weight is 1 / its rows squared, so the sum that is made smallest is the spread of the classes' shares over the
    folds. Integers decide; ties go to the fold with fewer rows, then to the first."""
    totals: dict = {}
    for _, counts in groups:
        for c, n in counts.items():
            totals[c] = totals.get(c, 0) + n
    scale = math.lcm(*[n * n for n in totals.values()]) if totals else 1
    weight = {c: scale // (n * n) for c, n in totals.items()}
    held = [dict.fromkeys(totals, 0) for _ in range(folds)]
    rows, found = [0] * folds, []
    for _, counts in groups:
        f = min(range(folds), key=lambda f: (sum(held[f][c] * n * weight[c] for c, n in counts.items()), rows[f], f))
        for c, n in counts.items():
            held[f][c] += n
        rows[f] += sum(counts.values())
        found.append(f)
    return found


def stratified_folds(df: DataFrame, group: str, label: str, folds: int = 5, repeats: int = 1, seed: int = 7, part: int = 20_000) -> DataFrame:
    """(group, repeat, fold): whole groups dealt to folds so that each fold has about the same share of every class.

    The table is one row a group. Groups are cut by hash into parts of about `part`, and each part is dealt by itself, the largest
    groups first, ties in an order that the seed and the repeat shuffle: parts that are even are even together, and none needs to
    see another. Null groups are one group, null labels a class."""
    from lintel.session import prepare, written

    prepare(df.sparkSession)
    name = F.coalesce(F.col(group).cast("string"), F.lit(""))
    cells = df.groupBy(name.alias("group"), F.coalesce(F.col(label).cast("string"), F.lit("")).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    rows = written(cells.groupBy("group").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("class", "n")))).alias("counts"), F.sum("n").alias("rows")), "groups")
    parts = max(1, -(-rows.count() // part))
    spread = rows.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("part", F.pmod(F.xxhash64("group"), F.lit(parts)))
    order = F.md5(F.concat_ws("|", "group", F.col("repeat").cast("string"), F.lit(str(seed))))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rows", "order"], ascending=[False, True])
        return pd.DataFrame({"group": pdf["group"], "repeat": pdf["repeat"], "fold": dealt([(g, dict(c)) for g, c in zip(pdf["group"], pdf["counts"], strict=True)], folds)})

    return spread.withColumn("order", order).groupBy("repeat", "part").applyInPandas(run, "group string, repeat int, fold int")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], time: str) -> DataFrame:
    """The newest row per key of both; of equal times the new one."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return first_per_key(both, keys, [F.desc(time), F.desc("__new")]).drop("__new")


def get_or_create(existing: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows to append: wanted rows, once per key, whose key doesn't exist."""
    return wanted.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")
