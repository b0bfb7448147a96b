"""How alike two versions of a Java or C file are, by what they are made of: tokens, signatures, macros and counts.

Both versions of a file are in one row, so they are taken apart and laid side by side there, without a shuffle; column
expressions, and a counter of tokens in Arrow batches."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.session import prepare

# The measures of each language, their kind and weight; patterns of what they count; the least score of C files whose outside is the same.
MEASURES = {
    "java": {"tokens": ("cosine", 0.6), "classes": ("count", 0.2), "methods": ("count", 0.2)},
    "c": {"signatures": ("jaccard", 0.35), "functions": ("count", 0.20), "returns": ("count", 0.20), "control": ("count", 0.15), "macros": ("jaccard", 0.10)},
}
TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|[{}();.,=+\-/*]"
CLASS = r"\bclass\s+[A-Za-z_][A-Za-z0-9_]*"
METHOD = r"\b(?:public|private|protected)?\s*(?:static\s+)?[A-Za-z_][A-Za-z0-9_<>,\[\]]*\s+[A-Za-z_][A-Za-z0-9_]*\s*\("
FUNCTION = r"(?m)^[ \t]*(?:[A-Za-z_]\w*[\s*]+)+([A-Za-z_]\w*)\s*\(([^;{}]*)\)\s*\{"
MACRO = r"(?m)^\s*#\s*define\s+([A-Za-z_][A-Za-z0-9_]*)"
RETURN, CONTROL = r"\breturn\b", r"\b(?:if|for|while|switch|case|default|goto)\b"
NOT_FUNCTIONS = ("if", "for", "while", "switch", "case", "default")
SAME_OUTSIDE = 0.6


def all_of(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def without_comments(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)/\*.*?\*/|//[^\n]*", " ")


def token_sums(before: pa.Array, after: pa.Array) -> pa.Array:
    """Of the tokens' numbers in both texts: the sums of their products and squares, how many tokens are in both, and in any."""
    find, rows = re.compile(TOKEN).findall, []
    for one, two in zip(before, after, strict=True):
        a, b = Counter(find(one.as_py())), Counter(find(two.as_py()))
        shared = a.keys() & b.keys()
        rows.append((sum(a[t] * b[t] for t in shared), sum(n * n for n in a.values()), sum(n * n for n in b.values()), len(shared), len(a) + len(b) - len(shared)))
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], names=["ab", "aa", "bb", "both", "any"])


def number(text: Column, pattern: str, holds: str) -> Column:
    """How often the pattern is found in a text; `holds` is in every match, so texts without it aren't looked at."""
    return F.when(F.contains(text, F.lit(holds)), F.regexp_count(text, F.lit(pattern))).otherwise(0)


def measure(language: str, name: str, similarity: Column, both: Column, any: Column) -> Column:
    """A measure's row: 1 and the same if neither version has anything of it (any is 0)."""
    of = [F.lit(name).alias("measure"), F.lit(MEASURES[language][name][1]).alias("weight"), F.when(any == 0, 1.0).otherwise(similarity).alias("similarity")]
    return F.struct(*of, (both == any).alias("same"))


def counted(language: str, name: str, a: Column, b: Column) -> Column:
    return measure(language, name, F.when(F.greatest(a, b) > 0, 1 - F.abs(a - b) / F.greatest(a, b)), F.least(F.sign(a), F.sign(b)), F.sign(F.greatest(a, b)))


def overlapping(language: str, name: str, a: Column, b: Column) -> Column:
    both, any = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return measure(language, name, F.try_divide(both, any), both, any)


def measured(files: DataFrame, by: list[str]) -> DataFrame:
    """by, language and measures, an array, of files (by, language, before, after).

    A text is stripped of its comments, and its functions are looked for, once: each step is a column of its own."""
    prepare(files.sparkSession)
    known = files.select(*by, "language", *[F.coalesce(c, F.lit("")).alias(c) for c in ("before", "after")])
    sums_of = F.arrow_udf(token_sums, "ab long, aa long, bb long, both long, any long")
    java = known.filter("language = 'java'").withColumn("sums", sums_of("before", "after"))
    for side in ("before", "after"):
        java = java.withColumns({f"{side}_classes": number(F.col(side), CLASS, "class"), f"{side}_methods": number(F.col(side), METHOD, "(")})
    s = F.col("sums")
    cosine = F.coalesce(F.try_divide(s["ab"].cast("double"), F.sqrt(s["aa"]) * F.sqrt(s["bb"])), F.lit(0.0))
    of_java = [measure("java", "tokens", cosine, s["both"], s["any"]), *[counted("java", n, F.col(f"before_{n}"), F.col(f"after_{n}")) for n in ("classes", "methods")]]
    c = known.filter("language = 'c'").withColumns({side: without_comments(F.col(side)) for side in ("before", "after")})
    given = lambda p: F.trim(F.regexp_replace(F.when(F.trim(p["given"]) == "void", "").otherwise(p["given"]), r"\s+", " "))
    for side in ("before", "after"):
        text = F.col(side)
        c = c.withColumns({f"{side}_names": all_of(text, FUNCTION, 1), f"{side}_given": all_of(text, FUNCTION, 2)})
        functions = F.filter(F.arrays_zip(F.col(f"{side}_names").alias("name"), F.col(f"{side}_given").alias("given")), lambda p: ~p["name"].isin(*NOT_FUNCTIONS))
        c = c.withColumn(f"{side}_signatures", F.transform(functions, lambda p: F.concat(p["name"], F.lit(":"), given(p))))
        c = c.withColumns({f"{side}_macros": all_of(text, MACRO, 1), f"{side}_functions": F.size(f"{side}_signatures"), f"{side}_returns": F.regexp_count(text, F.lit(RETURN)), f"{side}_control": F.regexp_count(text, F.lit(CONTROL))})
    sides = lambda n: (F.col(f"before_{n}"), F.col(f"after_{n}"))
    of_c = [overlapping("c", n, *sides(n)) if kind == "jaccard" else counted("c", n, *sides(n)) for n, (kind, _) in MEASURES["c"].items()]
    return java.select(*by, "language", F.array(*of_java).alias("measures")).unionByName(c.select(*by, "language", F.array(*of_c).alias("measures")))


def version_measures(files: DataFrame, by: list[str]) -> DataFrame:
    """(by, language, measure, weight, similarity, same) of files (by, language, before, after); null texts are empty, other languages give no rows.

    A measure that neither version has anything of is 1. Rows of equal keys, or without one, are measured one by one."""
    return measured(files, by).select(*by, "language", F.inline("measures"))


def version_similarity(files: DataFrame, by: list[str]) -> DataFrame:
    """(by, language, similarity): the weighted measures; C files with the same signatures and macros have SAME_OUTSIDE at least."""
    total = F.aggregate("measures", F.lit(0.0), lambda s, m: s + m["weight"] * m["similarity"])
    same = F.forall("measures", lambda m: m["same"] | ~m["measure"].isin("signatures", "macros"))
    rows = measured(files, by).select(*by, "language", total.alias("s"), same.alias("same"))
    floor = (F.col("language") == "c") & F.col("same")
    return rows.select(*by, "language", F.when(floor, F.greatest("s", F.lit(SAME_OUTSIDE))).otherwise(F.col("s")).alias("similarity"))
