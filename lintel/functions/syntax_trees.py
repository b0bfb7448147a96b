"""Syntax trees as adjacency tables: one row a node, with parent, place, depth and path."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.functions import c_code
from lintel.functions.copies import framed, remembered
from lintel.session import prepare

COLUMNS = "node int, parent int, pos int, depth int, type string, name string, line int, tree_path string"


def python_nodes(text: str, deepest: int = 12) -> Iterator[tuple]:
    """Depth first; nodes below `deepest` are left out."""
    stack: list[tuple] = [(ast.parse(text), None, 0, 0, "")]
    number = 0
    while stack:
        node, parent, pos, depth, above = stack.pop()
        name = getattr(node, "name", None) or getattr(node, "id", None) or getattr(node, "attr", None) or getattr(node, "arg", None)
        path = f"{above}/{type(node).__name__}"
        yield number, parent, pos, depth, type(node).__name__, name if isinstance(name, str) else None, getattr(node, "lineno", None), path
        if depth < deepest:
            children = list(ast.iter_child_nodes(node))
            stack += [(c, number, i, depth + 1, path) for i, c in reversed(list(enumerate(children)))]
        number += 1


def block_nodes(text: str) -> Iterator[tuple]:
    """C and Java: functions and the braces below them."""
    masked = c_code.mask(text)
    yield 0, None, 0, 0, "File", None, 1, "/File"
    number = 1
    for i, f in enumerate(c_code.functions_of(masked)):
        root, path = number, "/File/Function"
        yield number, 0, i, 1, "Function", f["name"], f["start"], path
        number += 1
        open_ = [root]
        places = [0]
        line = f["start"]
        for c in f["body"][1:-1]:
            line += c == "\n"
            if c == "{":
                yield number, open_[-1], places[-1], len(open_) + 1, "Block", None, line, path + "/Block" * len(open_)
                places[-1] += 1
                open_.append(number)
                places.append(0)
                number += 1
            elif c == "}" and len(open_) > 1:
                open_.pop()
                places.pop()


def nodes(files: DataFrame, deepest: int = 12) -> DataFrame:
    """(path, ...) of every file; files that can't be parsed have none."""
    prepare(files.sparkSession)
    names = ["path", *[c.split()[0] for c in COLUMNS.split(", ")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = remembered(lambda lang, text: python_nodes(text, deepest) if lang == "python" else block_nodes(text))

        def found() -> Iterator[list[tuple]]:
            for pdf in batches:
                for p, lang, t in zip(pdf["path"], pdf["language"], pdf["text"], strict=True):
                    try:
                        yield [(p, *r) for r in made(lang or "", t or "")]
                    except (SyntaxError, ValueError):
                        continue

        yield from framed(found(), names, {c: "Int32" for c in ("node", "parent", "pos", "depth", "line")})

    return files.select("path", "language", "text").mapInPandas(run, f"path string, {COLUMNS}")


def histogram(tree: DataFrame) -> DataFrame:
    """Per file and type: nodes and the greatest depth."""
    return tree.groupBy("path", "type").agg(F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("depth"))


def structural_similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cosine of the node-type counts of two versions of each file."""
    count = lambda d, n: d.groupBy("path", "type").agg(F.count(F.lit(1)).cast("double").alias(n))
    both = count(a, "x").join(count(b, "y"), ["path", "type"], "full").fillna(0.0, subset=["x", "y"])
    norms = F.sqrt(F.sum(F.col("x") * F.col("x"))) * F.sqrt(F.sum(F.col("y") * F.col("y")))
    return both.groupBy("path").agg(F.coalesce(F.try_divide(F.sum(F.col("x") * F.col("y")), norms), F.lit(0.0)).alias("similarity"))


def cohesion(fields: DataFrame) -> DataFrame:
    """Tight class cohesion from (class, method, field) uses: the share of method pairs with a common field."""
    uses = fields.distinct()
    methods = uses.groupBy("class").agg(F.countDistinct("method").cast("double").alias("m"))
    a, b = uses.alias("a"), uses.alias("b")
    pairs = a.join(b, (F.col("a.class") == F.col("b.class")) & (F.col("a.field") == F.col("b.field")) & (F.col("a.method") < F.col("b.method")))
    linked = pairs.select(F.col("a.class").alias("class"), F.col("a.method").alias("x"), F.col("b.method").alias("y")).distinct().groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    return methods.join(linked, "class", "left").select("class", F.coalesce(F.try_divide(F.coalesce("n", F.lit(0)).cast("double"), F.col("m") * (F.col("m") - 1) / 2), F.lit(0.0)).alias("cohesion"))
