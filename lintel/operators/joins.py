"""Joins of findings: overlaps, nearest intervals, containment, fallbacks, frequent pairs, token references.

Every interval join has equal keys first and a residual on the interval, so plans are hash or sort-merge
joins. Keys that repeat very often are bucketed by the interval where the join allows it."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from lintel.session import prepare, widened, written

SKETCH = 256  # parities of a set, one bit each, at least
BLOCK = 1 << 18  # words of sketches in a block of a group's sets, about
PAIRS = 1 << 17  # pairs whose sets meet at once, about
MARKS = 1 << 24  # bits for the keys of the sets that are needed


def lines_match(kind: Column, start: Column, end: Column, other_start: Column, other_end: Column, near: int = 5, class_near: int = 10) -> Column:
    """Do two line ranges mean the same entity? Classes: the other starts inside or close by; the rest: starts close by or ranges overlap. No start: yes."""
    end, other_end = F.coalesce(F.nullif(end, F.lit(0)), start), F.coalesce(F.nullif(other_end, F.lit(0)), other_start)
    close = F.abs(start - other_start)
    in_class = ((other_start >= start) & (other_start <= end)) | (close <= class_near)
    other = (close <= near) | ((start <= other_end) & (other_start <= end))
    return F.coalesce(F.when(kind == "class", in_class).otherwise(other), F.lit(True))


def overlap_edges(df: DataFrame, by: list[str], item: str, start: str, end: str, width: int) -> DataFrame:
    """Pairs a < b of one key whose closed intervals overlap, with the length of the overlap.

    Intervals are dealt to every bucket of `width` that they touch; a pair is made in the bucket where its overlap begins."""
    cut = df.select(*by, item, start, end, F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))).alias("__cell"))
    a = cut.select(*by, "__cell", F.col(item).alias("a"), F.col(start).alias("sa"), F.col(end).alias("ea"))
    b = cut.select(*by, "__cell", F.col(item).alias("b"), F.col(start).alias("sb"), F.col(end).alias("eb"))
    joined = a.join(b, [*by, "__cell"]).filter("a < b AND ea >= sb AND eb >= sa")
    first = F.greatest("sa", "sb")
    return joined.filter(F.floor(first / width) == F.col("__cell")).select(*by, "a", "b", (F.least("ea", "eb") - first).alias("overlap"))


def nearest_interval(left: DataFrame, right: DataFrame, by: list[str], item: str, tolerance: int) -> DataFrame:
    """For each left interval (item, start, end) the right one (other, start, end) of the key with both gaps within the tolerance and the smallest sum; ties to the smaller other."""
    width = max(1, tolerance + 1)
    r = right.select(*by, "other", F.col("start").alias("rs"), F.col("end").alias("re"), F.floor(F.col("start") / width).alias("__cell"))
    near = left.withColumn("__cell", F.explode(F.sequence(F.floor((F.col("start") - tolerance) / width), F.floor((F.col("start") + tolerance) / width))))
    gaps = near.join(r, [*by, "__cell"]).withColumn("gap", F.abs(F.col("start") - F.col("rs"))).withColumn("end_gap", F.abs(F.col("end") - F.col("re")))
    gaps = gaps.filter((F.col("gap") <= tolerance) & (F.col("end_gap") <= tolerance))
    return gaps.groupBy(*by, item).agg(F.min(F.struct((F.col("gap") + F.col("end_gap")).alias("distance"), F.col("other").alias("other"))).alias("m")).select(*by, item, "m.other", "m.distance")


def exists_in_range(df: DataFrame, found: DataFrame, by: list[str], inside: Column) -> DataFrame:
    """Rows of df for which some row of found has the same key and lies inside: a left semi join with a residual."""
    keys = [df[c] == found[c] for c in by]
    condition = inside
    for k in keys:
        condition = k & condition
    return df.join(found, condition, "left_semi")


def hybrid_merge(rules: DataFrame, model: DataFrame, by: list[str]) -> DataFrame:
    """Model findings (id, line, score) fold into the first rule finding (id, start, end) of the key around their line; the rest are added. Ids name findings of a key."""
    hits = model.alias("m").join(rules.alias("r"), [F.col(f"m.{c}") == F.col(f"r.{c}") for c in by]).filter("m.line BETWEEN r.start AND r.end")
    keys = [F.col(f"m.{c}").alias(c) for c in by]
    folded = hits.groupBy(*keys, F.col("m.id").alias("id")).agg(F.min("r.id").alias("rule_id"), F.first("m.score").alias("score"))
    best = folded.groupBy(*by, F.col("rule_id").alias("id")).agg(F.max("score").alias("score"))
    merged = rules.join(best, [*by, "id"], "left").select(*by, "id", F.when(F.col("score").isNull(), "rule").otherwise("rule+ml").alias("source"), "score")
    added = model.join(folded.select(*by, "id"), [*by, "id"], "left_anti").select(*by, "id", F.lit("ml").alias("source"), "score")
    return merged.unionByName(added)


def with_fallback(df: DataFrame, stats: DataFrame, first: str, second: str, measures: list[str]) -> DataFrame:
    """Measures of the exact (first, second) pair, else summed over second, else zeros; `match` tells which."""
    exact = stats.groupBy(first, second).agg(*[F.sum(m).alias(f"__e_{m}") for m in measures])
    rolled = stats.groupBy(second).agg(*[F.sum(m).alias(f"__r_{m}") for m in measures])
    joined = df.join(exact, [first, second], "left").join(rolled, second, "left")
    has, some = F.col(f"__e_{measures[0]}").isNotNull(), F.col(f"__r_{measures[0]}").isNotNull()
    kind = F.when(has, "exact").when(some, "rolled").otherwise("none")
    return joined.select(*df.columns, kind.alias("match"), *[F.coalesce(F.col(f"__e_{m}"), F.col(f"__r_{m}"), F.lit(0)).alias(m) for m in measures])


def frequent_pairs(df: DataFrame, basket: str, item: str, least: int, busiest: int | None = None, task: int = 1 << 21) -> DataFrame:
    """Pairs of baskets that share at least `least` items, with the sorted items. Items in one basket only are dropped before the self join.

    Pairs are counted first, from narrow rows; items are collected for the pairs that reach `least` only. A task counts `task`
    pairs, about, so there are more tasks for more of them, none with a larger table of counts.
    busiest: leave out items in more baskets than this (a definition of noise words, not a default)."""
    rows = df.select(F.col(basket).alias("k"), F.col(item).alias("i")).filter("k IS NOT NULL AND i IS NOT NULL").distinct()
    n = rows.groupBy("i").agg(F.count(F.lit(1)).alias("n")).filter("n > 1" + (f" AND n <= {busiest}" if busiest else ""))
    n = written(n, "busy-items")
    made = n.agg(F.coalesce(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2), F.lit(0.0))).first()[0]
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(made / task))
    shared = written(rows.join(n.select("i").hint("merge"), "i", "left_semi"), "baskets")
    a, b = shared.select(F.col("k").alias("first"), "i"), shared.select(F.col("k").alias("second"), "i")
    pairs = a.join(b.hint("merge"), "i").filter("first < second").repartition(parts, "first", "second")
    pairs = written(pairs.groupBy("first", "second").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= least), "basket-pairs")
    common = pairs.hint("merge").join(a, "first").join(b, ["second", "i"], "left_semi")
    return common.groupBy("first", "second").agg(F.first("shared").alias("shared"), F.array_sort(F.collect_list("i")).alias("items"))


def token_references(entities: DataFrame, name: str, files: DataFrame, path: str, text: str, own: str | None = None, shortest: int = 3) -> DataFrame:
    """Append blast_radius: 1 and the number of other files whose text holds the entity's name as a whole word.

    Words of a text that are no shorter than `shortest` count once, so a file is cut into words once and meets each name
    that it holds in one equi-join, without any scan of texts by name. Names that are no single word, shorter ones and null
    ones have 1. own: a column with the entity's own file, which doesn't count again; entities are told apart by name and own."""
    keys = [name, own] if own else [name]
    asked = entities.select(*keys).filter((F.length(name) >= shortest) & ~F.col(name).rlike(r"\W")).distinct()
    words = files.select(F.col(path).alias("__path"), F.explode(F.array_distinct(F.split(F.col(text), r"\W+"))).alias("__word")).filter(F.length("__word") >= shortest)
    hits = asked.join(words, F.col(name) == F.col("__word"))
    if own:
        hits = hits.filter(~F.col("__path").eqNullSafe(F.col(own)))
    counts = written(hits.select(*keys, "__path").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("__files")), "references").toDF(*[f"__{k}" for k in keys], "__files")
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return entities.join(counts, same, "left").select(*entities.columns, (1 + F.coalesce("__files", F.lit(0))).alias("blast_radius"))


def churn(files: DataFrame, changes: DataFrame, path: str, day: str, until: Column, days: int = 90) -> DataFrame:
    """Changes of each file in the days before a date; 0 without any. changes: a row per change and file."""
    recent = changes.filter((F.col(day) >= F.date_sub(until, days)) & (F.col(day) < until)).groupBy(path).agg(F.count(F.lit(1)).alias("churn"))
    return files.join(recent, path, "left").withColumn("churn", F.coalesce("churn", F.lit(0)))


def tested(files: DataFrame, path: str, shortest: int = 3) -> DataFrame:
    """Append tested: another path that holds "test" or "spec" also holds the file's stem.

    Stems are looked up among the test paths' substrings of stems' lengths: an equi-join, not a comparison of all pairs."""
    low = F.lower(F.col(path))
    stem = F.regexp_replace(F.regexp_extract(low, "[^/]*$", 0), r"\.[^.]*$", "")
    stems = files.select(path, stem.alias("__stem")).filter(F.length("__stem") >= shortest)
    lengths = stems.agg(F.array_sort(F.collect_set(F.length("__stem"))).alias("__lengths"))  # as many as there are lengths of names
    tests = files.filter(low.contains("test") | low.contains("spec")).select(F.col(path).alias("__test"), low.alias("__low")).crossJoin(F.broadcast(lengths))
    cut = F.flatten(F.transform("__lengths", lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.length("__low") - n, F.lit(0))), lambda i: F.substr("__low", i + 1, n))))
    parts = tests.select("__test", F.explode(F.array_distinct(cut)).alias("__stem"))
    hits = stems.join(parts, "__stem").filter(F.col("__test") != F.col(path)).select(path).distinct()
    return files.join(hits.withColumn("tested", F.lit(True)), path, "left").withColumn("tested", F.coalesce("tested", F.lit(False)))


def unique_base_names(paths: DataFrame, path: str) -> DataFrame:
    """(base, full): full paths whose last part no other path has."""
    base = F.element_at(F.split(F.col(path), "/"), -1)
    return paths.groupBy(base.alias("base")).agg(F.min(path).alias("full"), F.countDistinct(path).alias("n")).filter("n = 1").drop("n")


def restore_paths(df: DataFrame, column: str, paths: DataFrame, path: str) -> DataFrame:
    """Values without a slash become the one full path that ends in them, where there is exactly one."""
    found = unique_base_names(paths, path)
    joined = df.join(found, df[column] == found["base"], "left")
    return joined.withColumn(column, F.when(F.instr(column, "/") == 0, F.coalesce("full", F.col(column))).otherwise(F.col(column))).drop("base", "full")


def path_ends(paths: DataFrame, path: str, deepest: int = 64) -> DataFrame:
    """paths with depth and end: a row for each of a path's ends, its last segments in lower case, the shortest first."""
    parts = F.split(F.regexp_replace(F.regexp_replace(F.col(path), r"\\\\", "/"), "^/+", ""), "/")
    n = F.least(F.size(parts), F.lit(deepest))
    ends = F.transform(F.sequence(F.lit(1), n), lambda d: F.struct(d.alias("depth"), F.lower(F.array_join(F.slice(parts, F.size(parts) - d + 1, d), "/")).alias("end")))
    return paths.filter(F.col(path).isNotNull()).select("*", F.inline(ends))


def match_paths(asked: DataFrame, files: DataFrame, path: str, file: str, position: str, by: list[str] | None = None, whole: bool = True) -> DataFrame:
    """asked with match, the file whose path ends in the asked one, and depth, the segments that agree; null and 0 without any.

    File names agree in letter case, folders need not; a folder agrees as a whole. Of several files the first by position is taken.
    whole: all segments must agree; else the file with the most does. Every end of a path is a key, so both are equi-joins."""
    by = by or []
    last = lambda c: F.regexp_extract(F.regexp_replace(F.col(c), r"\\\\", "/"), "[^/]*$", 0)
    known = path_ends(files.select(*by, F.col(file).alias("__file"), F.col(position).alias("__at"), last(file).alias("__name")), "__file")
    wanted = asked.select(*by, F.col(path).alias("__path"), last(path).alias("__name")).distinct()
    ends = path_ends(wanted, "__path")
    if whole:
        ends = ends.withColumn("__most", F.max("depth").over(Window.partitionBy(*by, "__path"))).filter("depth = __most").drop("__most")
    hits = ends.join(known, [*by, "__name", "depth", "end"])
    best = hits.groupBy(*by, "__path").agg(F.min(F.struct((-F.col("depth")).alias("less"), F.col("__at").alias("at"), F.col("__file").alias("match"))).alias("m"))
    same = [asked[c].eqNullSafe(best[c]) for c in by] + [asked[path] == best["__path"]]
    return asked.join(best, same, "left").select(*[asked[c] for c in asked.columns], F.col("m.match").alias("match"), F.coalesce(-F.col("m.less"), F.lit(0)).alias("depth"))


def degrees(edges: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """Fan-in and fan-out per node; repeated edges count."""
    out = edges.groupBy(F.col(source).alias("node")).agg(F.count(F.lit(1)).alias("fan_out"))
    into = edges.groupBy(F.col(target).alias("node")).agg(F.count(F.lit(1)).alias("fan_in"))
    return out.join(into, "node", "full").select("node", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (src, module) to files (path): dotted names as module or package, from the root or the importer's folder; the first that exists."""
    dotted = F.regexp_replace("module", r"\.", "/")
    folder = F.regexp_replace("src", "[^/]*$", "")
    tries = F.array(F.concat(dotted, F.lit(".py")), F.concat(dotted, F.lit("/__init__.py")), F.concat(folder, dotted, F.lit(".py")), F.concat(folder, dotted, F.lit("/__init__.py")))
    candidates = imports.select("src", "module", F.posexplode(tries).alias("priority", "path"))
    return candidates.join(files.select("path").distinct(), "path").groupBy("src", "module").agg(F.min_by("path", "priority").alias("dst")).filter("src <> dst")


def described(sets: DataFrame, whole: bool = False) -> DataFrame:
    """Rows (by, k, group, t) with the name of their group's set of tokens, its size n and, as body, its sketch or, whole, its sorted tokens.

    A sketch has the parity of each bucket of tokens, at least two buckets a token; the sketch of half as many is made of its halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, groups = batch.column("t"), batch.column("group").to_numpy()
            ends = np.cumsum(t.value_lengths().to_numpy())
            names, sizes, bodies = [], [], []
            for group, tokens in zip(groups, np.split(t.flatten().to_numpy(), ends[:-1]) if len(ends) else [], strict=True):
                tokens = np.unique(tokens)
                names.append(hashlib.blake2b(group.tobytes() + tokens.tobytes(), digest_size=16).digest())
                sizes.append(len(tokens))
                width = max(SKETCH, 1 << (2 * len(tokens) - 1).bit_length())
                bodies.append(tokens.tobytes() if whole else np.packbits((np.bincount(tokens & (width - 1), minlength=width) & 1).astype(np.uint8)).tobytes())
            made = [*batch.columns[:3], pa.array(names, pa.binary()), pa.array(sizes, pa.int32()), pa.array(bodies, pa.binary())]
            yield pa.RecordBatch.from_arrays(made, names=["by", "k", "group", "name", "n", "body"])

    return sets.select("by", "k", "group", "t").mapInArrow(run, widened(sets.select("by", "k", "group"), "name binary, n int, body binary"))


def cells_of(classes: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """The classes with their block, and where blocks meet: (group, i, j, block, low, high, words), for the sets of a block from low to high.

    The sets of a group are cut by size into blocks of about BLOCK words of sketches; two blocks meet if they hold sets close enough in size."""
    sizes = classes.groupBy("group", "n").agg(F.count(F.lit(1)).alias("many")).withColumn("unit", F.floor(F.col("n") * 3 / 64) + 8)
    until = F.sum(F.col("many") * F.col("unit")).over(Window.partitionBy("group").orderBy("n"))
    sizes = written(sizes.withColumn("start", until - F.col("many") * F.col("unit")), "token-sizes")
    spans = sizes.select("group", "n", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + (F.col("many") - 1) * F.col("unit")) / BLOCK))).alias("block"), (F.col("many") * F.col("unit")).alias("words"))
    blocks = spans.groupBy("group", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.least(F.sum("words"), F.lit(BLOCK)).alias("words"))
    one, two = blocks.toDF("group", "i", "lo_i", "hi_i", "words_i"), blocks.toDF("group", "j", "lo_j", "hi_j", "words_j")
    cells = one.join(two, "group").filter((F.col("i") <= F.col("j")) & (F.col("hi_i") >= F.lit(least) * F.col("lo_j") - 1e-9))
    first = F.struct(F.col("i").alias("block"), (F.lit(least) * F.col("lo_j") - 1e-9).alias("low"), F.col("hi_i").cast("double").alias("high"), F.col("words_i").alias("words"))
    second = F.struct(F.col("j").alias("block"), F.col("lo_j").cast("double").alias("low"), ((F.col("hi_i") + 1e-9) / F.lit(least)).alias("high"), F.col("words_j").alias("words"))
    meets = cells.select("group", "i", "j", F.inline(F.when(F.col("i") == F.col("j"), F.array(first)).otherwise(F.array(first, second))))
    at = F.col("start") + F.pmod(F.xxhash64("name"), "many") * F.col("unit")
    return classes.join(sizes, ["group", "n"]).withColumn("block", F.floor(at / BLOCK)), written(meets, "token-cells")


def folded(bodies: np.ndarray, bits: np.ndarray, width: int) -> np.ndarray:
    """Words by rows of sketches that have so many bits or more."""
    out = np.empty((len(bodies), width // 64), np.uint64)
    for b in np.unique(bits):
        at = np.flatnonzero(bits == b)
        out[at] = np.bitwise_xor.reduce(np.frombuffer(b"".join(bodies[at]), np.uint64).reshape(len(at), -1, width // 64), axis=1)
    return np.ascontiguousarray(out.T)


def close_pairs(n: np.ndarray, block: np.ndarray, bodies: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of two blocks, or of one with itself, that may be similar by their sizes and sketches, each pair once.

    Two sets differ in no fewer members than their sketches in bits."""
    order = np.lexsort((n, block))
    n, bodies, bits = n[order], bodies[order], np.array([8 * len(x) for x in bodies[order]])
    split = int(np.searchsorted(block[order], block.max())) if block.min() < block.max() else 0
    one, two = np.arange(split or len(n)), np.arange(split, len(n))
    share = (1 - least) / (1 + least)  # of both sizes, in which they may differ
    for width in np.unique(bits[one]):
        a = one[bits[one] == width]
        b = two[(n[two] >= n[a[0]]) & (n[two] * least <= n[a[-1]] + 1e-9)]
        x, y = folded(bodies[a], bits[a], width), folded(bodies[b], bits[b], width)
        for r in range(0, len(a), 64):
            rows = a[r : r + 64]
            until = np.searchsorted(n[b] * least, n[rows[-1]] + 1e-9, "right")
            for s in range(np.searchsorted(n[b], n[rows[0]]), until, 1024):
                others = b[s : min(s + 1024, until)]
                far = np.zeros((len(rows), len(others)), np.int32)
                for u, v in zip(x[:, r : r + 64], y[:, s : s + len(others)], strict=True):
                    far += np.bitwise_count(u[:, None] ^ v)
                p, q = np.nonzero(far <= (share * n[rows] + 1e-6)[:, None] + share * n[others])
                first, second = rows[p], others[q]
                both = n[first] + n[second]
                near = (first < second) & (n[first] >= least * n[second] - 1e-9) & (far[p, q] <= both - 2 * np.ceil(least / (1 + least) * both - 1e-9))
                yield order[first[near]], order[second[near]]


def common_counts(a: np.ndarray, b: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """The number of members that sets a and b have in common, for each pair."""
    ends = np.cumsum([len(x) for x in sets])
    members = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], ends[:-1])
    marked, found = np.zeros(ends[-1], bool), np.empty(len(a), np.int64)
    order = np.argsort(a, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(a[order])) + 1):
        marked[members[a[at[0]]]] = True
        for some in np.split(at, range(1024, len(at), 1024)):
            others = [members[x] for x in b[some]]
            starts = np.cumsum([0, *(len(x) for x in others[:-1])])
            found[some] = np.add.reduceat(marked[np.concatenate(others)], starts, dtype=np.int64)
        marked[members[a[at[0]]]] = False
    return found


def of_keys(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of df with a key of keys' column k, and a few others: keys are marked in a table of fixed size, so no row is shuffled."""
    place = F.pmod(F.xxhash64(F.col("k")), F.lit(MARKS))
    words = keys.select(place.alias("p")).groupBy(F.floor(F.col("p") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(p % 64))")).alias("bits")).toArrow()
    marks = np.zeros(MARKS // 64, np.int64)
    marks[words["word"].to_numpy()] = words["bits"].to_numpy()
    sent = df.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(batch.num_columns - 1).to_numpy()
            found = batch.filter(pa.array((sent.value[p >> 6] >> (p & 63) & 1).astype(bool)))
            yield pa.RecordBatch.from_arrays(found.columns[:-1], schema=pa.schema(list(found.schema)[:-1]))

    return df.select("*", F.pmod(F.xxhash64(key), F.lit(MARKS)).alias("__place")).mapInArrow(run, df.schema)


def similar_pairs(df: DataFrame, by: list[str], key: str, tokens: Column, least: float) -> DataFrame:
    """Pairs of one key whose token sets have a Jaccard similarity of at least `least`. Tokens are compared by 64-bit hashes.

    Sets meet as sketches of about two bits a token, in cells of two blocks of their group, where blocks are cut by size. Tokens
    are moved only of sets that have a near one, once to each cell. Equal sets of a group are one class, whose rows are pairs without
    a comparison; pairs of classes of a row each have their rows at once, the others by joins. Rows without a key, group or token have no partner; of rows with one key, each has its own partners."""
    cores = prepare(df.sparkSession).sparkContext.defaultParallelism
    named = df.dropna(subset=[*by, key])

    def sets(rows: DataFrame) -> DataFrame:
        hashed = rows.filter(F.size(tokens) > 0).select(F.struct(*by).alias("by"), F.col(key).alias("k"), F.xxhash64(*by).alias("group"), F.transform(tokens, lambda t: F.xxhash64(t)).alias("t"))
        return hashed.filter(F.size("t") > 0)

    members = written(described(sets(named)), "token-sketches")
    classes = members.groupBy("name").agg(*[F.first(c).alias(c) for c in ("group", "n", "body")], F.min("k").alias("k"), F.count(F.lit(1)).alias("copies"))
    dealt, meets = cells_of(classes, least)
    words = meets.agg(F.sum("words").alias("words")).first()["words"] or 0
    inside = (F.col("n") >= F.col("low")) & (F.col("n") <= F.col("high"))
    cells = dealt.join(meets.drop("words"), ["group", "block"]).filter(inside).select("group", "i", "j", "block", "n", "body", F.struct("name", "k", "copies").alias("set"))
    cells = cells.repartition(max(cores, -(-words // BLOCK)), "group", "i", "j")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = pa.Table.from_batches(batches).combine_chunks()
        sets = pa.StructArray.from_arrays(cell["set"].combine_chunks().flatten(), names=["name", "k", "copies"])
        place = [cell[c][0].as_py() for c in ("group", "i", "j")]
        found, size, turn = [], 0, 0
        for a, b in close_pairs(cell["n"].to_numpy().astype(np.int64), cell["block"].to_numpy(), np.array(cell["body"].to_pylist(), object), least):
            found.append((a, b))
            size += len(a)
            if size >= PAIRS:
                yield named_pairs([*place, turn], sets, found)
                found, size, turn = [], 0, turn + 1
        if size:
            yield named_pairs([*place, turn], sets, found)

    kind = cells.schema["set"].dataType.simpleString()
    pairs = written(cells.groupBy("group", "i", "j").applyInArrow(meet, f"cell long, a {kind}, b {kind}"), "token-pairs")
    needs = pairs.select("cell", F.explode(F.array("a", "b")).alias("set")).select(F.col("cell").alias("at"), "set.*").distinct()
    bodies = described(sets(of_keys(named, key, needs.select("k").distinct())), whole=True).select("name", "by", "body")
    needed = needs.join(bodies, "name")

    def verify(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        names = sets["name"].combine_chunks()
        a, b = (pc.index_in(pairs[c].combine_chunks().field("name"), names).to_numpy() for c in ("a", "b"))
        bodies = [np.frombuffer(x, np.int64) for x in sets["body"].to_pylist()]
        n, common = np.array([len(x) for x in bodies]), common_counts(a, b, bodies)
        total = n[a] + n[b] - common
        near = common >= least * total - 1e-9
        a, b = a[near], b[near]
        single = sets["copies"].to_numpy() == 1
        of_rows = pa.array(single[a] & single[b])
        ends = [pc.if_else(of_rows, pa.scalar(None, pa.binary()), names.take(pa.array(x))) for x in (a, b)]
        made = [sets["by"].combine_chunks().take(pa.array(a)), sets["k"].take(pa.array(a)), sets["k"].take(pa.array(b)), *ends, common[near], total[near]]
        return pa.table(made, names=["by", "x", "y", "a", "b", "common", "total"])

    schema = StructType([*needed.select("by", F.col("k").alias("x"), F.col("k").alias("y")).schema, *StructType.fromDDL("a binary, b binary, common long, total long")])
    links = written(pairs.groupBy("cell").cogroup(needed.groupBy("at")).applyInArrow(verify, schema), "token-links")
    of_rows = links.filter("a IS NULL AND x <> y").select("by", "x", "y", "common", "total")
    links = links.filter("a IS NOT NULL").select("a", "b", "common", "total")
    copies = members.groupBy("name").count().filter("count > 1").select(F.col("name").alias("a"), F.col("name").alias("b"), F.lit(1).cast("long").alias("common"), F.lit(1).cast("long").alias("total"))
    one, two = members.select(F.col("name").alias("a"), "by", F.col("k").alias("x")), members.select(F.col("name").alias("b"), F.col("k").alias("y"))
    full = links.unionByName(copies).join(one, "a").join(two, "b").filter(F.when(F.col("a") == F.col("b"), F.col("x") < F.col("y")).otherwise(F.col("x") != F.col("y")))
    full = of_rows.unionByName(full.select("by", "x", "y", "common", "total"))
    return full.select("by.*", F.least("x", "y").alias("first"), F.greatest("x", "y").alias("second"), F.round(F.col("common") / F.col("total"), 6).alias("similarity"))


def named_pairs(place: list[int], sets: pa.Array, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Pairs of rows by their sets, with a number for their place."""
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    cell = int.from_bytes(hashlib.blake2b(repr(place).encode(), digest_size=8).digest(), signed=True)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), cell)), sets.take(pa.array(a)), sets.take(pa.array(b))], names=["cell", "a", "b"])
