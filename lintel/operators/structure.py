"""What classes are made of, from rows of declarations; sizes of spans of tokens, from sums up to each token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lintel.functions.java_code import COUNTS
from lintel.functions.syntax_trees import cohesion
from lintel.session import written

FLAGS = ("starts_line", "identifier", "operator", "literal")


def token_sums(tokens: DataFrame, by: list[str]) -> DataFrame:
    """Tokens with sum_<flag>, the sum of a flag over the file's tokens up to this one, and before, the place of the last equal identifier before it.

    A file is sorted once; that is all that spans need."""
    order = Window.partitionBy(*by).orderBy("i")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    same = Window.partitionBy(*by, F.when(F.col("identifier") == 1, F.col("token"))).orderBy("i")
    return tokens.withColumns({f"sum_{f}": F.sum(f).over(upto) for f in FLAGS} | {"before": F.when(F.col("identifier") == 1, F.lag("i").over(same))})


def span_sizes(sums: DataFrame, spans: DataFrame, by: list[str]) -> DataFrame:
    """spans (by, first, last, ...) with lines, sloc, tokens, identifiers, operators and literals: two lookups a span, at its last token and before its first.

    No token between is read, however long or nested the spans are. A span whose last token doesn't exist is left out. sloc are
    the lines that begin inside the span, and its first."""
    ends = sums.select(*by, F.col("i").alias("last"), F.col("line").alias("end_line"), *[F.col(f"sum_{f}").alias(f"e_{f}") for f in FLAGS])
    starts = sums.select(*by, F.col("i").alias("first"), F.col("line").alias("line"), *[(F.col(f"sum_{f}") - F.col(f)).alias(f"s_{f}") for f in FLAGS], F.col("starts_line").alias("own_start"))
    plain = spans.drop("line", "end_line")
    joined = plain.join(ends.hint("merge"), [*by, "last"]).join(starts.hint("merge"), [*by, "first"])
    between = lambda f: (F.col(f"e_{f}") - F.col(f"s_{f}")).cast("long")
    return joined.select(
        *plain.columns,
        "line",
        "end_line",
        (F.col("end_line") - F.col("line") + 1).alias("lines"),
        (1 + between("starts_line") - F.col("own_start")).alias("sloc"),
        (F.col("last") - F.col("first") + 1).alias("tokens"),
        between("identifier").alias("identifiers"),
        between("operator").alias("operators"),
        between("literal").alias("literals"),
    )


def distinct_identifiers(sums: DataFrame, spans: DataFrame, by: list[str], width: int = 512) -> DataFrame:
    """(by, first, last, distinct): different identifiers in a span. A token counts where the one before it with its name lies before the span.

    Tokens and spans meet by cells of `width` tokens, so a pair is made only for tokens inside a span."""
    named = sums.filter("identifier = 1").select(*by, "i", F.coalesce("before", F.lit(-1)).alias("before"), F.floor(F.col("i") / width).alias("cell"))
    cut = spans.select(*by, "first", "last").distinct().withColumn("cell", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width))))
    inside = cut.hint("merge").join(named, [*by, "cell"]).filter("i BETWEEN first AND last AND before < first")
    return inside.groupBy(*by, "first", "last").agg(F.count(F.lit(1)).alias("distinct"))


def has(modifier: str) -> Column:
    return F.array_contains("modifiers", modifier)


def class_features(declared: DataFrame, sizes: DataFrame, by: list[str]) -> DataFrame:
    """A row a type: numbers of its members, sums, averages and maxima over its methods, sets of what they use, cohesion.

    declared: java_declarations(); sizes: span_sizes() of them, with id. Members are a type's own; types inside it are types of
    their own, but what they refer to counts for the types around them too."""
    key = [*by, "id"]
    rows = written(declared.join(sizes.select(*key, "sloc", "tokens", "lines").hint("merge"), key, "left"), "members")
    callable_ = F.col("kind").isin("method", "constructor")
    method, field = F.col("kind") == "method", F.col("kind") == "field"
    types = rows.filter(~callable_ & ~field)
    interface = types.select(*by, F.col("id").alias("parent"), (F.col("kind") == "interface").alias("of_interface"))
    members = rows.filter("parent IS NOT NULL").join(interface.hint("merge"), [*by, "parent"])
    public = method & (F.col("of_interface") | has("public"))
    statements = F.try_element_at("counts", F.lit("statements"))
    getter = method & F.col("name").rlike("^(get|is)[A-Z_]") & (F.col("parameters") == 0) & (statements <= 1)
    setter = method & F.col("name").rlike("^set[A-Z_]") & (F.col("parameters") == 1) & (statements <= 2)
    of = lambda c: F.when(callable_, c)
    count = lambda name: F.try_element_at("counts", F.lit(name))
    grouped = members.groupBy(*by, F.col("parent").alias("id")).agg(
        F.count_if(method).alias("methods"),
        F.count_if(F.col("kind") == "constructor").alias("constructors"),
        F.count_if(field).alias("fields"),
        F.count_if(~callable_ & ~field).alias("inner_types"),
        F.count_if(public).alias("public_methods"),
        F.count_if(method & has("private")).alias("private_methods"),
        F.count_if(method & has("static")).alias("static_methods"),
        F.count_if(method & ~F.col("has_body")).alias("abstract_methods"),
        F.count_if(field & has("public")).alias("public_fields"),
        F.count_if(field & has("private")).alias("private_fields"),
        F.count_if(field & has("static")).alias("static_fields"),
        F.count_if(field & has("final")).alias("final_fields"),
        F.count_if(getter).alias("getters"),
        F.count_if(setter).alias("setters"),
        F.count_if(public & ~getter & ~setter).alias("public_functional"),
        F.count_if(method & F.array_contains("annotations", "Override")).alias("overrides"),
        F.sum(of(count("complexity"))).alias("wmc"),
        F.avg(of(count("complexity"))).alias("avg_complexity"),
        F.max(of(count("complexity"))).alias("max_complexity"),
        F.sum(of(F.col("sloc"))).alias("method_sloc"),
        F.avg(of(F.col("sloc"))).alias("avg_method_sloc"),
        F.max(of(F.col("sloc"))).alias("max_method_sloc"),
        F.avg(of(F.col("parameters"))).alias("avg_parameters"),
        F.max(of(F.col("parameters"))).alias("max_parameters"),
        F.max(of(count("max_nesting"))).alias("max_nesting"),
        *[F.sum(of(count(c))).alias(c) for c in COUNTS if c not in ("complexity", "max_nesting", "max_chain")],
        F.count_if(method & F.col("has_body") & (F.size("fields_used") > 0)).alias("__using"),
        F.count_if(method & F.col("has_body")).alias("__bodied"),
    )
    targets = members.filter(callable_).select(*by, F.col("parent").alias("id"), F.explode(F.map_keys("targets")).alias("x")).groupBy(*key).agg(F.countDistinct("x").alias("foreign_targets"))
    uses = members.filter(method & F.col("has_body")).select(F.struct(*by, F.col("parent").alias("id")).alias("class"), F.col("id").alias("method"), F.explode("fields_used").alias("field"))
    bodied = members.filter(method & F.col("has_body")).groupBy(*by, F.col("parent").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("m"))
    linked = cohesion_pairs(uses).select("class.*", "n")
    tight = bodied.join(linked.hint("merge"), key, "left").select(*key, F.coalesce(F.try_divide(F.coalesce("n", F.lit(0)).cast("double"), F.col("m") * (F.col("m") - 1) / 2), F.lit(0.0)).alias("cohesion"))
    names = type_names(rows, by)
    zero = [c for c in grouped.columns if c not in key and not c.startswith("__")]
    joined = types.select(*key, "name", "kind", "sloc", "tokens", "lines", "parent", "modifiers", "extends", "implements").join(grouped.hint("merge"), key, "left").join(targets.hint("merge"), key, "left").join(tight.hint("merge"), key, "left").join(names.hint("merge"), key, "left")
    accessors = F.col("getters") + F.col("setters")
    return joined.fillna(0, subset=[*zero, "foreign_targets", "distinct_types"]).fillna(0.0, subset=["cohesion"]).select(
        *key, "name", "kind", "sloc", "tokens", "lines", *zero, "foreign_targets", "distinct_types", "cohesion",
        F.coalesce(F.try_divide(accessors, F.col("methods")), F.lit(0.0)).alias("accessor_ratio"),
        (F.col("methods") - accessors).alias("non_accessors"),
        F.coalesce(F.try_divide(F.col("public_functional"), F.col("public_methods") + F.col("public_fields")), F.lit(1.0)).alias("weight_of_class"),
        F.coalesce(F.try_divide(F.col("__using"), F.col("__bodied")), F.lit(0.0)).alias("using_fields_ratio"),
        F.coalesce(F.try_divide(F.col("fields"), F.col("methods")), F.col("fields").cast("double")).alias("fields_per_method"),
        (F.col("extends") > 0).cast("int").alias("has_superclass"), F.col("implements").alias("interfaces"), F.col("parent").isNotNull().cast("int").alias("is_nested"), has("abstract").cast("int").alias("is_abstract"),
    )


def cohesion_pairs(uses: DataFrame) -> DataFrame:
    """(class, n): pairs of a class's methods that use a common field, from (class, method, field)."""
    once = uses.distinct()
    a, b = once.withColumnRenamed("method", "x"), once.withColumnRenamed("method", "y")
    return a.hint("merge").join(b, ["class", "field"]).filter("x < y").select("class", "x", "y").distinct().groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def type_names(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, id, distinct_types): the types that a type's members name, those of the types inside it included.

    The names of the types inside go up level by level, each level written and small, until no type lies around the last one's."""
    inside = rows.filter(~F.col("kind").isin("method", "constructor", "field") & F.col("parent").isNotNull()).select(*by, "id", F.col("parent").alias("up"))
    every = level = rows.filter("types_used IS NOT NULL AND parent IS NOT NULL").select(*by, F.col("parent").alias("id"), F.explode("types_used").alias("type")).distinct()
    while True:
        level = written(level.join(inside.hint("merge"), [*by, "id"]).select(*by, F.col("up").alias("id"), "type").distinct(), "type-names")
        if level.isEmpty():
            break
        every = every.unionByName(level)
    return every.groupBy(*by, "id").agg(F.countDistinct("type").alias("distinct_types"))
