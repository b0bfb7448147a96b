"""Repository overview: languages, imports, dependencies, clues of its design. Roles and key files are in repository."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.functions.scalars import file_name
from lintel.operators import joins, rollups

def imports(files: DataFrame) -> DataFrame:
    """(src, module) of Python and Java imports and local C includes."""
    py = F.regexp_extract_all("text", F.lit(r"(?m)^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))"), F.lit(0))
    name = F.regexp_extract("found", r"(?:from|import)\s+([\w.]+)", 1)
    java = F.regexp_extract_all("text", F.lit(r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)\s*;"), F.lit(1))
    c = F.regexp_extract_all("text", F.lit(r'(?m)^\s*#\s*include\s+"([^"]+)"'), F.lit(1))
    python = files.filter("language = 'python'").select(F.col("path").alias("src"), F.explode(py).alias("found")).select("src", name.alias("module"), F.lit("python").alias("language"))
    other = lambda lang, x: files.filter(F.col("language") == lang).select(F.col("path").alias("src"), F.explode(x).alias("module"), F.lit(lang).alias("language"))
    return python.unionByName(other("java", java)).unionByName(other("c", c))


def dependencies(files: DataFrame) -> DataFrame:
    """(src, dst) between files: Python by module path, Java by class name, C by the including folder, then the root."""
    found = imports(files)
    python = joins.resolve_imports(found.filter("language = 'python'"), files).select("src", "dst")
    klass = F.concat(F.element_at(F.split("module", r"\."), -1), F.lit(".java"))
    names = files.filter("language = 'java'").groupBy(file_name(F.col("path")).alias("file")).agg(F.min("path").alias("dst"))
    java = found.filter("language = 'java'").withColumn("file", klass).join(names, "file").select("src", "dst")
    tries = F.array(F.concat(F.regexp_replace("src", "[^/]*$", ""), "module"), F.col("module"))
    near = found.filter("language = 'c'").select("src", "module", F.posexplode(tries).alias("p", "path"))
    c = near.join(files.select("path"), "path").groupBy("src", "module").agg(F.min_by("path", "p").alias("dst")).select("src", "dst")
    return python.unionByName(java).unionByName(c).filter("src <> dst")


def languages(files: DataFrame) -> DataFrame:
    """Files, lines and percent per language."""
    lines = files.select("language", F.size(F.split("text", "\n")).alias("lines"))
    counts = lines.groupBy("language").agg(F.sum("lines").alias("lines"))
    return rollups.share(lines, "language").join(counts, "language")


def clues(folders: DataFrame, needed: dict[str, list[str]], least: int = 3, by: str = "repository") -> DataFrame:
    """(by, clue, found) for sets of folder roles of which at least `least` occur in a repository. folders: (by, role), of repository.important_folders say."""
    rows = F.array(*[F.struct(F.lit(k).alias("clue"), F.array(*[F.lit(x) for x in v]).alias("roles")) for k, v in needed.items()])
    asked = folders.select(by, "role").distinct().select(by, "role", F.explode(rows).alias("r"))
    return asked.filter(F.array_contains("r.roles", F.col("role"))).groupBy(by, F.col("r.clue").alias("clue")).agg(F.count(F.lit(1)).alias("found")).filter(F.col("found") >= least)
