"""Categories of smells, their fixes, and what an automatic transformer can do with a fix. Lookups are map literals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.functions.scalars import literal_map

# Categories with their priority, and the smells of each.
PRIORITY = {
    "Bloaters": "critical",
    "Object-Orientation Abusers": "medium",
    "Change Preventers": "critical",
    "Dispensables": "low",
    "Couplers": "medium",
    "Security / Language-Specific": "critical",
    "Uncategorized": "low",
}
MEMBERS = {
    "Bloaters": ("LongMethod", "LongFunction", "LargeClass", "TooManyParameters", "PrimitiveObsession", "DataClumps"),
    "Object-Orientation Abusers": ("SwitchStatements", "RefusedBequest", "TemporaryField", "AlternativeClassesWithDifferentInterfaces"),
    "Change Preventers": ("DuplicateCode", "DivergentChange", "ShotgunSurgery", "ParallelInheritanceHierarchies"),
    "Dispensables": ("DeadCode", "UnreachableCode", "UnusedVariable", "LazyClass", "Comments", "SpeculativeGenerality", "DataClass"),
    "Couplers": ("FeatureEnvy", "InappropriateIntimacy", "MessageChains", "MiddleMan"),
    "Security / Language-Specific": ("UnsafeFunctionUsage", "DeepNesting", "GlobalVariable", "LargeHeaderFile", "BareExcept", "MagicNumber"),
}
CATEGORY_OF = {smell: category for category, smells in MEMBERS.items() for smell in smells}

# Smell, fix, risk, impact.
FIX_OF = {
    "Long Method": ("Extract Method", "low", "high"),
    "God Class": ("Extract Class", "medium", "high"),
    "Feature Envy": ("Move Method", "medium", "high"),
    "Duplicate Code": ("Extract Method", "low", "high"),
    "Long Parameter List": ("Introduce Parameter Object", "low", "high"),
    "Data Clumps": ("Extract Class", "medium", "medium"),
    "Primitive Obsession": ("Replace Data Value with Object", "low", "medium"),
    "Shotgun Surgery": ("Move Method", "medium", "high"),
    "Divergent Change": ("Extract Class", "medium", "medium"),
    "Dead Code": ("Remove Dead Code", "low", "medium"),
    "Comments": ("Rename Method", "low", "low"),
    "Large Class": ("Extract Class", "medium", "high"),
    "Switch Statements": ("Replace Conditional with Polymorphism", "high", "high"),
    "Lazy Class": ("Inline Class", "low", "low"),
    "Speculative Generality": ("Collapse Hierarchy", "medium", "medium"),
    "LongMethod": ("Extract Method", "low", "high"),
    "LongFunction": ("Extract Method", "low", "high"),
    "TooManyParameters": ("Introduce Parameter Object", "low", "high"),
    "SwitchStatements": ("Replace Conditional with Polymorphism", "high", "high"),
    "MessageChains": ("Hide Delegate", "low", "medium"),
    "LargeClass": ("Extract Class", "medium", "high"),
    "LazyClass": ("Inline Class", "low", "low"),
    "PrimitiveObsession": ("Replace Data Value with Object", "low", "medium"),
    "InappropriateIntimacy": ("Move Method", "medium", "medium"),
    "SpeculativeGenerality": ("Collapse Hierarchy", "medium", "medium"),
    "DuplicateCode": ("Extract Method", "low", "high"),
    "FeatureEnvy": ("Move Method", "medium", "high"),
    "DataClumps": ("Extract Class", "medium", "medium"),
    "DeadCode": ("Remove Dead Code", "low", "medium"),
    "MagicNumber": ("Replace Magic Number with Symbolic Constant", "low", "medium"),
    "BareExcept": ("Replace Bare Except with Specific Exception", "low", "medium"),
    "DeepNesting": ("Replace Nested Conditional with Guard Clauses", "medium", "high"),
    "UnsafeFunctionUsage": ("Replace Unsafe Call with Safe Variant", "medium", "high"),
    "GlobalVariable": ("Encapsulate Field", "medium", "medium"),
    "LargeHeaderFile": ("Extract Class", "medium", "medium"),
}
DEFAULT_FIX = ("Rename Method", "low", "low")

# Fixes (in lower case) that a transformer has an action for, and those that need several coordinated edits.
ACTION_OF = {
    "rename function": "rename_symbol",
    "rename method": "rename_symbol",
    "rename variable": "rename_symbol",
    "rename class": "rename_symbol",
    "rename parameter": "rename_symbol",
    "rename field": "rename_symbol",
    "rename attribute": "rename_symbol",
    "extract method": "extract_method",
    "extract constant": "extract_constant",
    "replace magic number with symbolic constant": "extract_constant",
    "introduce constant": "introduce_constant",
    "remove dead code": "remove_dead_code",
    "replace unsafe function": "replace_unsafe_function",
    "encapsulate variable": "encapsulate_variable",
    "replace literal": "replace_literal",
    "replace temp with query": "replace_literal",
}
BY_HAND = (
    "extract class",
    "move method",
    "replace conditional with polymorphism",
    "introduce parameter object",
    "hide delegate",
    "replace data value with object",
    "inline class",
    "collapse hierarchy",
    "pull up method",
    "replace parameter with method call",
)
LANGUAGE_ALIASES = {"py": "python", "python": "python", "python3": "python", "java": "java", "c": "c", "h": "c", "c/c++": "c"}
#: Fixes that candidates for C leave out.
NOT_IN_C = ("Replace Parameter with Method Call", "Replace Conditional with Polymorphism", "Move Method")


def category(smell: Column, stamped: Column | None = None) -> Column:
    """The stamped category if there is one, else the smell's, else Uncategorized."""
    known = F.coalesce(F.try_element_at(literal_map(CATEGORY_OF), smell), F.lit("Uncategorized"))
    return known if stamped is None else F.when(F.trim(stamped) != "", stamped).otherwise(known)


def category_priority(name: Column, stamped: Column | None = None) -> Column:
    known = F.coalesce(F.try_element_at(literal_map(PRIORITY), name), F.lit("low"))
    return known if stamped is None else F.when(F.trim(stamped) != "", stamped).otherwise(known)


def fix_of(smell: Column, default: tuple[str, str, str] | None = None) -> Column:
    """(refactoring, risk, impact) of a smell; without one the default, or null."""
    part = lambda i: F.coalesce(F.try_element_at(literal_map({k: v[i] for k, v in FIX_OF.items()}), smell), F.lit(default[i] if default else None))
    found = F.struct(part(0).alias("refactoring"), part(1).alias("risk"), part(2).alias("impact"))
    return found if default else F.when(part(0).isNotNull(), found)


def action_of(refactoring: Column) -> Column:
    """The transformer's action for a fix, or null."""
    key = F.lower(F.trim(refactoring))
    return F.when(key.startswith("fault injection"), "fault_injection").otherwise(F.try_element_at(literal_map(ACTION_OF), key))


def fix_status(refactoring: Column, exposed: list[str] | None = None) -> Column:
    """executable, advisory, or unknown without a fix; exposed: the actions that a running transformer has."""
    action = action_of(refactoring)
    missing = F.lit(False) if exposed is None else ~action.isin(exposed)
    by_hand = F.lower(F.trim(refactoring)).isin(*BY_HAND)
    return F.when(F.coalesce(F.trim(refactoring), F.lit("")) == "", "unknown").when(by_hand | action.isNull() | missing, "advisory").otherwise("executable")


def capability(smell: Column, exposed: list[str] | None = None) -> Column:
    """(status, refactoring, action, risk, impact) of a smell; risk and impact of an unknown one are medium."""
    fix = fix_of(smell)
    refactoring = fix["refactoring"]
    status = fix_status(refactoring, exposed)
    by_hand = F.lower(refactoring).isin(*BY_HAND)
    return F.struct(
        status.alias("status"),
        refactoring.alias("refactoring"),
        F.when(~by_hand, action_of(refactoring)).alias("action"),
        F.coalesce(fix["risk"], F.lit("medium")).alias("risk"),
        F.coalesce(fix["impact"], F.lit("medium")).alias("impact"),
    )


def step_capability(smell: Column, refactoring: Column, exposed: list[str] | None = None) -> Column:
    """A step's status: its smell's, or, where the smell has no fix, that of the refactoring which the step names."""
    by_smell = fix_status(fix_of(smell)["refactoring"], exposed)
    return F.when(by_smell != "unknown", by_smell).otherwise(fix_status(refactoring, exposed))


def normalize_language(value: Column) -> Column:
    """python, java or c by name or alias; empty for others."""
    return F.coalesce(F.try_element_at(literal_map(LANGUAGE_ALIASES), F.lower(F.trim(value))), F.lit(""))


def by_language(df: DataFrame, language: str, kept: tuple[str, ...] = ("python", "java")) -> DataFrame:
    """Rows of these languages, whatever their case; `part` numbers the languages in the given order."""
    low = F.lower(language)
    parts = F.array(*[F.lit(x) for x in kept])
    return df.filter(low.isin(*kept)).withColumn("part", F.array_position(parts, low).cast("int"))


def without_excluded(candidates: DataFrame, language: str, refactoring: str, languages: tuple[str, ...] = ("c", "cpp"), excluded: tuple[str, ...] = NOT_IN_C) -> DataFrame:
    """Candidates less the fixes that make no sense in a language."""
    return candidates.filter(~(F.lower(F.coalesce(F.col(language), F.lit(""))).isin(*languages) & F.col(refactoring).isin(*excluded)))


def payload(df: DataFrame, by: list[str], smell: Column, stamped: Column, severity: Column) -> DataFrame:
    """Per group: findings, distinct smells and categories, and findings per severity (a map; unknown without one)."""
    rows = df.select(*by, F.coalesce(smell, F.lit("Unknown")).alias("__s"), category(smell, stamped).alias("__c"), F.lower(F.coalesce(F.nullif(severity, F.lit("")), F.lit("unknown"))).alias("__v"))
    wide = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total_smells"), F.count_distinct("__s").alias("type_count"), F.count_distinct("__c").alias("category_count"))
    levels = rows.groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__n")).groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__v", "__n")))).alias("severities"))
    return wide.join(levels, by)
