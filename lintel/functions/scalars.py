"""Column functions: paths and names, safe arithmetic, similarity, times. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
LANGUAGE_OF = {".py": "python", ".java": "java", ".c": "c", ".h": "c"}
SEVERITIES = ("high", "medium", "low")
PENALTY = {"high": 8, "medium": 4, "low": 1}
OTHER_PENALTY = 2
ALIASES = {"LongFunction": "LongMethod"}


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def normalize_path(path: Column) -> Column:
    """Forward slashes, no drive or leading slash, no repeated slashes."""
    slashed = F.trim(F.regexp_replace(path, r"\\", "/"))
    return F.regexp_replace(F.regexp_replace(slashed, "^([A-Za-z]:)?/+", ""), "/+", "/")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def detect_language(path: Column) -> Column:
    """By extension; null for others."""
    return F.try_element_at(literal_map(LANGUAGE_OF), F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)))


def is_test_file(path: Column) -> Column:
    """By file name only: Java classes named Test..., ...Test, ...Tests or ...IT; modules named test_..., ..._test(s), conftest or tests."""
    name = file_name(F.regexp_replace(path, r"\\", "/"))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    java = stem.rlike("^Test[A-Z]|[a-z0-9](Test|Tests|IT)$")
    other = F.lower(stem).rlike("^test_|_tests?$|^conftest$|^tests$")
    return F.when(F.lower(name).endswith(".java"), java).otherwise(other)


def normalize_severity(severity: Column) -> Column:
    low = F.lower(F.trim(severity.cast("string")))
    return F.when(low.isin(*SEVERITIES), low).otherwise("low")


def severity_rank(severity: Column) -> Column:
    """0 is the worst; unknown severities come last."""
    low = F.lower(severity)
    return F.when(low == "high", 0).when(low == "medium", 1).when(low == "low", 2).otherwise(3)


def penalty(severity: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(PENALTY), F.lower(severity)), F.lit(OTHER_PENALTY))


def canonical_smell(smell: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(ALIASES), smell), smell)


def entity_name(code_name: Column, kind: Column) -> Column:
    """a.b.C#m x gives m for functions and methods; a.b.C gives C for the rest."""
    after = F.element_at(F.split(code_name, "#"), -1)
    member = F.element_at(F.split(F.trim(after), r"[ (]"), 1)
    dotted = F.element_at(F.split(F.element_at(F.split(code_name, "#"), 1), r"\."), -1)
    return F.when(F.lower(kind).isin("function", "method") & code_name.contains("#"), member).otherwise(dotted)


def normalize_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", " "))


def content_key(*parts: Column) -> Column:
    """The first 20 hex digits of a SHA-1 over the parts."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])), 1, 20)


def token_fingerprint(tokens: Column) -> Column:
    """The first 20 hex digits of a SHA-1 over tokens with one space between them."""
    return F.substring(F.sha1(F.array_join(tokens, " ")), 1, 20)


def rounded(x: Column, digits: int) -> Column:
    """Rounded half up, after the noise in the last bits of a double is gone."""
    return F.round(F.round(x, 12), digits)


def number(x: Column) -> Column:
    """A finite double, or null."""
    d = x.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def ratio_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(ratio(a, b), F.lit(0.0))


def percent(a: Column, b: Column) -> Column:
    return F.round(ratio(100 * a, b), 1)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def score_scale(x: Column) -> Column:
    """A score on a scale of 1, 10 or 100, brought to 0..1; what lies beyond counts as 1, negatives as 0."""
    value = F.when(x < 0, 0.0).when(x <= 1, x).when(x <= 10, x / 10).when(x <= 100, x / 100).otherwise(1.0)
    basis = F.when(x < 0, "negative").when(x <= 1, "unit").when(x <= 10, "ten").when(x <= 100, "hundred").otherwise("capped")
    return F.when(x.isNotNull(), F.struct(value.alias("value"), basis.alias("basis")))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of numbers; 0 if one is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return ratio_or_zero(dot(a, b), norms)


def bound(make: Callable[..., Column], *values: Column) -> Column:
    """make(*values) with each value made once a row, however often it is named; inside a lambda it would be made for each element."""
    one = F.array(F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)]))
    return F.element_at(F.transform(one, lambda s: make(*[s[f"v{i}"] for i in range(len(values))])), 1)


def cosine_counts(a: Column, b: Column) -> Column:
    """Of two maps from term to count; 1 without any key, 0 if one is zero."""
    number = lambda x: F.coalesce(x, F.lit(0)).cast("double")

    def of_maps(a: Column, b: Column) -> Column:
        square = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + number(x) * number(x))
        both = F.aggregate(F.map_entries(a), F.lit(0.0), lambda s, e: s + number(e["value"]) * number(F.try_element_at(b, e["key"])))
        return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(ratio_or_zero(both, F.sqrt(square(a)) * F.sqrt(square(b))))

    return bound(of_maps, a, b)


def count_similarity(a: Column, b: Column) -> Column:
    most = F.greatest(a, b)
    return F.when(most == 0, 1.0).otherwise(1 - F.abs(a - b) / most)


def min_max(x: Column, low: float = 1.0, high: float = 3.0) -> Column:
    return F.lit(0.5) if low == high else (x - low) / (high - low)


def axis_projection(v: Column, high: Column, low: Column) -> Column:
    """Where a vector lies between two reference vectors."""
    return clamp(0.5 + 1.5 * (cosine(v, high) - cosine(v, low)))


def parse_time(text: Column) -> Column:
    return F.try_to_timestamp(text)


def stamp(moment: Column) -> Column:
    """UTC as text of a fixed width, so that texts sort as times do."""
    return F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def minutes_between(start: Column, end: Column) -> Column:
    """Null if one is missing or the end is before the start."""
    micros = F.timestamp_diff("MICROSECOND", start, end)
    return F.when(end >= start, micros / 6e7)


def backoff_seconds(attempt: Column, first: int = 30, most: int = 900) -> Column:
    return F.least(first * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempt - 1)), F.lit(float(most)))


def capped(items: Column, limit: int) -> Column:
    """The first items and how many were left out."""
    return F.struct(F.slice(items, 1, limit).alias("items"), F.greatest(F.lit(0), F.size(items) - limit).alias("omitted"))


def line_summary(lines: Column, limit: int = 5) -> Column:
    """Distinct sorted numbers: the first few, and how many more."""
    ordered = F.array_sort(F.array_distinct(lines))
    more = F.size(ordered) - limit
    return F.concat(F.array_join(F.slice(ordered, 1, limit), ", "), F.when(more > 0, F.format_string(" and %d more", more)).otherwise(""))


def id_ranges(ids: Column, limit: int = 8) -> Column:
    """Sorted whole numbers as ranges, 1-3, 7; at most `limit` ranges."""
    ordered = F.array_sort(F.array_distinct(ids))
    starts = F.filter(ordered, lambda x: ~F.array_contains(ids, x - 1))
    ends = F.filter(ordered, lambda x: ~F.array_contains(ids, x + 1))
    ranges = F.zip_with(starts, ends, lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat_ws("-", a, b)))
    return F.concat(F.array_join(F.slice(ranges, 1, limit), ", "), F.when(F.size(ranges) > limit, ", ...").otherwise(""))
