"""Where an envious method should go: attraction of a method to each class, and why the others lose.

Everything is joins over the facts of lintel.functions.python_scopes, by repository and path: a method, the class its
envied parameter is declared as, is named like, or is handed at calls, and the calls that would have to change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.session import written

FILE = ["repository", "path"]
KEY = [*FILE, "owner", "method"]


def name_key(name: Column) -> Column:
    """Names that mean the same class: letter case, other characters and a plural's s aside."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]", ""), "s+$", "")


def envies(methods: DataFrame, parameters: DataFrame) -> DataFrame:
    """KEY, parameter, accesses, self_accesses and reason: the one parameter whose attributes the method uses most, or why there is none.

    methods (KEY, uses of self, flag: movable, type: nested); parameters (KEY, name, type, uses, flag: assigned). Methods of one name in a class are one."""
    top = parameters.groupBy(*KEY).agg(F.max("uses").alias("accesses"), F.max_by(F.struct("name", "type", "flag"), "uses").alias("p"), F.sort_array(F.collect_list("uses"), False).alias("all"))
    rows = methods.join(top.hint("merge"), KEY, "left")
    tied = F.coalesce(F.try_element_at("all", F.lit(2)) == F.col("accesses"), F.lit(False))
    accesses = F.coalesce("accesses", F.lit(0))
    none = tied | (accesses < 2) | (accesses <= F.col("uses"))
    reason = (
        F.when(~F.col("flag"), "SOURCE_METHOD_NOT_MOVABLE")
        .when(F.col("type").isNotNull(), "NESTED_SCOPE_UNSUPPORTED")
        .when(none, "NO_FEATURE_ENVY_EVIDENCE")
        .when(F.col("p.flag"), "DESTINATION_PARAMETER_REASSIGNED")
    )
    return rows.select(*KEY, "line", "end_line", F.when(~none, F.col("p.name")).alias("parameter"), F.when(~none, F.col("p.type")).alias("declared"), accesses.alias("accesses"), F.col("uses").alias("self_accesses"), reason.alias("reason"))


def attractions(envious: DataFrame, classes: DataFrame, handed: DataFrame) -> DataFrame:
    """KEY, class, declared, named, handed, score: the classes of the file that speak for themselves, and in which way.

    classes (FILE, name); handed (FILE, method, class): what calls of a method's name give it. score: a declared type counts 4, a
    call 2, a name 1, each beside the accesses. The method's own class is among them where something speaks for it."""
    open_ = envious.filter("reason IS NULL")
    known = classes.select(*FILE, F.col("name").alias("class")).distinct()
    by_type = open_.join(known.hint("merge"), (open_["declared"] == known["class"]) & (open_["repository"] == known["repository"]) & (open_["path"] == known["path"])).select(*[open_[c] for c in KEY], "class", F.lit("declared").alias("way"))
    by_name = open_.withColumn("k", name_key(F.col("parameter"))).join(known.withColumn("k", name_key(F.col("class"))).hint("merge"), [*FILE, "k"]).select(*KEY, "class", F.lit("named").alias("way"))
    by_call = open_.join(handed.hint("merge"), [*FILE, "method"]).select(*KEY, "class", F.lit("handed").alias("way"))
    ways = by_type.unionByName(by_name).unionByName(by_call).distinct()
    grouped = ways.groupBy(*KEY, "class").agg(*[F.max(F.col("way") == w).alias(w) for w in ("declared", "named", "handed")])
    weight = 4 * F.col("declared").cast("int") + 2 * F.col("handed").cast("int") + F.col("named").cast("int")
    return grouped.join(open_.select(*KEY, "accesses").hint("merge"), KEY).withColumn("score", F.col("accesses") + weight).drop("accesses")


def call_sites(facts: DataFrame, envious: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(handed, broken): FILE, method, class of what calls hand over; KEY of methods with a call that can't be rewritten.

    A call is fine if it is made on self in the method's class, on a variable of that class or on a new object of it, and
    names what goes to the envied parameter. A mention of the method that is no call isn't. Places inside the method don't count."""
    classes = facts.filter("kind = 'class'").select(*FILE, F.col("name").alias("class")).distinct()
    variables = facts.filter("kind = 'variable'").select(*FILE, F.col("name").alias("variable"), F.col("type").alias("class")).join(classes.hint("merge"), [*FILE, "class"], "left_semi").distinct()
    open_ = envious.filter("reason IS NULL").select(*FILE, F.col("owner").alias("o"), F.col("method").alias("name"), "parameter")
    outside = ~(F.coalesce(F.col("owner") == F.col("o"), F.lit(False)) & F.coalesce(F.col("method") == F.col("name"), F.lit(False)))
    used = facts.filter("kind IN ('call', 'reference')").join(open_.hint("merge"), [*FILE, "name"])
    value = F.when(F.col("flag"), F.col("argument")).otherwise(F.try_element_at("keywords", F.col("parameter")))
    given = used.filter("kind = 'call'").select(*FILE, F.col("name").alias("method"), value.alias("value"))
    new = given.filter("value LIKE 'new %'").select(*FILE, "method", F.substring("value", 5, 1000).alias("class")).join(classes.hint("merge"), [*FILE, "class"], "left_semi")
    through = given.filter("value LIKE 'var %'").select(*FILE, "method", F.substring("value", 5, 1000).alias("variable")).join(variables.hint("merge"), [*FILE, "variable"]).select(*FILE, "method", "class")
    calls = used.filter(outside & (F.col("kind") == "call")).withColumns({"value": value, "receiver": F.regexp_extract("type", "^(?:self|new|var) (.*)$", 1)})
    of_variable = variables.select(*FILE, F.col("variable").alias("receiver"), F.col("class").alias("o"), F.lit(True).alias("known")).distinct()
    told = calls.join(of_variable.hint("merge"), [*FILE, "receiver", "o"], "left")
    fine = ((F.col("type").startswith("self ") | F.col("type").startswith("new ")) & (F.col("receiver") == F.col("o"))) | (F.col("type").startswith("var ") & F.col("known"))
    bad = told.filter(~F.coalesce(fine, F.lit(False)) | F.col("value").isNull()).select(*FILE, "o", "name")
    mentions = used.filter(outside & (F.col("kind") == "reference")).select(*FILE, "o", "name")
    broken = bad.unionByName(mentions).distinct().select(*FILE, F.col("o").alias("owner"), F.col("name").alias("method"))
    return new.unionByName(through).distinct(), broken


def destinations(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(methods, losers) from scopes(), which is read several times, so write it first.

    methods: KEY, destination, parameter, accesses, self_accesses and reason (null where the move is fine). losers: KEY, class, score
    and why the class isn't the destination: it is the method's own, another class speaks as well, or calls can't be changed."""
    methods = facts.filter("kind = 'method'").dropDuplicates(KEY)
    envious = written(envies(methods, facts.filter("kind = 'parameter'").dropDuplicates([*KEY, "name"])), "envious")
    handed, broken = call_sites(facts, envious)
    drawn = written(attractions(envious, facts.filter("kind = 'class'"), handed), "attractions")
    counts = drawn.filter("class <> owner").groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("only"))
    rows = envious.join(counts.hint("merge"), KEY, "left").join(broken.withColumn("broken", F.lit(True)).hint("merge"), KEY, "left")
    n = F.coalesce("n", F.lit(0))
    reason = F.coalesce("reason", F.when(n == 0, "NO_VALID_DESTINATION_CLASS").when(n > 1, "AMBIGUOUS_DESTINATION_CLASS").when(F.col("broken"), "CALL_SITE_REWRITE_FAILED"))
    decided = rows.withColumn("why", reason)
    lost = drawn.join(decided.select(*KEY, "why").hint("merge"), KEY).withColumn("reason", F.when(F.col("class") == F.col("owner"), "SOURCE_AND_DESTINATION_CLASS_MATCH").otherwise(F.col("why"))).filter("reason IS NOT NULL")
    return decided.select(*KEY, F.when(F.col("why").isNull(), F.col("only")).alias("destination"), "parameter", "accesses", "self_accesses", F.col("why").alias("reason")), lost.select(*KEY, "class", "score", "reason")
