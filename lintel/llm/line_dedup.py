"""Line dedup: repeated runs of lines, found by winnowing over line hashes.

A run is a sequence of adjacent non-blank lines (stripped of outer white space). A run of min_words words
or more that stood earlier, in a smaller (key, line) position of the same or another document, is deleted;
its first occurrence stays. Runs are maximal: they may be longer than min_words and may overlap.

Method. A line's forward window is the shortest run from it that has min_words words, its backward window
the shortest run up to it. The smallest line hash of a window is its fingerprint; any repeated run of
min_words words holds a whole window, so both occurrences select the same fingerprint (the guarantee of
winnowing, with windows measured in words). Fingerprints that occur once are dropped. The positions of the
others are joined: a window meets the first position of a window with its fingerprint and its lines' hashes,
which is a grouped minimum, so a run that a third of all documents share costs a row for each occurrence,
never a pair. From there the match is extended line by line, backward and forward, as long as the two
documents agree; windows of one document that meet the same document at the same distance are one match.
What is found is a repeated run, and every line of a maximal one lies in a repeated forward or backward
window, so the union of the extended matches is exactly the union of later repeated runs.

Texts are read twice, once for their lines' hashes, which everything between works on, and once to be
rewritten.

Null and empty texts have no lines to delete and stay as they are. Rows of equal key and equal text count
as one document. Blank lines go with the line before them. Line breaks are "\n". Hashes have 64 bits, and
two of them identify a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.session import prepare, widened, written

SIGN = 1 << 63


def signed(h: int) -> int:
    return h - (h & SIGN) * 2


def lines_of(text: str) -> tuple[list[int], list[int], list[int]]:
    """Of the non-blank lines: their numbers, hashes and words."""
    at, hashes, words = [], [], []
    for i, line in enumerate(text.split("\n")):
        if n := len(line.split()):
            at.append(i)
            hashes.append(xxhash.xxh3_64_intdigest(line.strip().encode()))
            words.append(n)
    return at, hashes, words


def windows(words: list[int], min_words: int) -> list[tuple[int, int]]:
    """Forward and backward windows as (first, last) places, without repeats."""
    out, total, end = set(), 0, 0
    for start in range(len(words)):
        while end < len(words) and total < min_words:
            total += words[end]
            end += 1
        if total < min_words:
            break
        out.add((start, end - 1))
        total -= words[start]
    total, start = 0, len(words) - 1
    for end in range(len(words) - 1, -1, -1):
        while start >= 0 and total < min_words:
            total += words[start]
            start -= 1
        if total < min_words:
            break
        out.add((start + 1, end))
        total -= words[end]
    return sorted(out)


def marked(hashes: list[int], words: list[int], min_words: int) -> list[tuple[int, int, int]]:
    """(fingerprint, hash of the window's lines, first line) of every window; hashes are signed."""
    packed = np.array(hashes, np.int64).tobytes()
    return [(min(hashes[a : b + 1]), signed(xxhash.xxh3_64_intdigest(packed[8 * a : 8 * b + 8], seed=b - a)), a) for a, b in windows(words, min_words)]


def fingerprints(hashes: list[int], words: list[int], min_words: int) -> list[int]:
    """The hashes selected in the windows, once for each selected line."""
    return [hashes[p] for p in {min(range(a, b + 1), key=hashes.__getitem__) for a, b in windows(words, min_words)}]


def extended(own: list[int], other: list[int], distance: int, seeds: list[int]) -> list[tuple[int, int]]:
    """Runs of lines (first, last) that two documents share at a distance in lines, from lines that lie in them; seeds in order."""
    runs, end = [], -1
    for p in seeds:
        if p <= end:
            continue
        a = b = p
        while a > max(0, distance) and own[a - 1] == other[a - 1 - distance]:
            a -= 1
        while b + 1 < min(len(own), len(other) + distance) and own[b + 1] == other[b + 1 - distance]:
            b += 1
        runs.append((a, b))
        end = b
    return runs


def without(text: str, runs: list[tuple[int, int]]) -> tuple[str, int, int]:
    """The text without some runs of its non-blank lines; the numbers of non-blank lines and of those deleted."""
    lines = text.split("\n")
    full = [i for i, line in enumerate(lines) if line.strip()]
    gone = bytearray(len(full))
    for a, b in runs:
        gone[a : b + 1] = b"\1" * (b + 1 - a)
    kept, cut, n = [], 0, 0
    for i, line in enumerate(lines):
        if n < len(full) and full[n] == i:
            cut = gone[n]
            n += 1
        if not cut:
            kept.append(line)
    return "\n".join(kept), n, sum(gone)


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """The input with its text rewritten, plus lines_before and lines_deleted (long). Names that clash are replaced."""
    prepare(df.sparkSession)
    base = [c for c in df.columns if c not in ("lines_before", "lines_deleted")]
    docs = df.select(*base)
    narrow = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("version"), F.col(text).alias("text")).filter(F.col("text").isNotNull())

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                rows = [(i, [signed(h) for h in hashes], words) for i, t in enumerate(part.column(2).to_pylist()) for _, hashes, words in [lines_of(t)] if sum(words) >= min_words]
                at, hashes, words = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [])
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(at, pa.int64())) for k in (0, 1)), pa.array(hashes, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int32()))], names=lined.names)

    def in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[int]], list[list[int]]]]:
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                yield part, part.column(2).to_pylist(), part.column(3).to_pylist()

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, hashes, words in in_slices(batches):
            found = [f for h, w in zip(hashes, words, strict=True) for f in fingerprints(h, w, min_words)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["fingerprint"])

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, hashes, words in in_slices(batches):
            found = [(i, *v) for i, (h, w) in enumerate(zip(hashes, words, strict=True)) for v in marked(h, w, min_words)]
            at, *columns = zip(*found, strict=True) if found else ([], [], [], [])
            at, kinds = pa.array(at, pa.int64()), (pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=placed.names)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                found = [extended(*x) for x in zip(*(part.column(k).to_pylist() for k in range(2, 6)), strict=True)]
                at = pa.array([i for i, runs in enumerate(found) for _ in runs], pa.int64())
                ends = [pa.array([r[k] for runs in found for r in runs], pa.int32()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), *ends], names=ran.names)

    pair = narrow.select("key", "version")
    lined, placed, ran = widened(pair, "hashes array<long>, words array<int>"), widened(pair, "fingerprint long, content long, first int"), widened(pair, "first int, last int")
    every = written(narrow.mapInArrow(hashed, lined).dropDuplicates(["key", "version"]), "lines")
    repeated = every.mapInArrow(select, "fingerprint long").groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("fingerprint")
    repeated = written(repeated, "line-fingerprints")
    matches = written(every.mapInArrow(positions, placed).join(repeated, "fingerprint", "left_semi"), "line-windows")
    place = F.struct("key", "version", "first")
    earliest = matches.groupBy("fingerprint", "content").agg(F.min(place).alias("earliest"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    # written, so that the join reads two tables and the rows of a frequent window can be split among tasks
    earliest = written(earliest, "line-earliest")
    later = matches.join(earliest, ["fingerprint", "content"]).filter(place > F.col("earliest"))
    distance = (F.col("first") - F.col("earliest.first")).alias("distance")
    met = later.groupBy("key", "version", F.col("earliest.key").alias("to_key"), F.col("earliest.version").alias("to_version"), distance).agg(F.array_sort(F.collect_set("first")).alias("seeds"))
    met = written(met, "line-matches")
    of = lambda key, version, name: every.select(F.col("key").alias(f"_{key}"), F.col("version").alias(f"_{version}"), F.col("hashes").alias(name)).hint("merge")
    same = lambda key, version: F.col(key).eqNullSafe(F.col(f"_{key}")) & (F.col(version) == F.col(f"_{version}"))
    sides = met.join(of("to_key", "to_version", "other"), same("to_key", "to_version")).drop("_to_key", "_to_version").join(of("key", "version", "own"), same("key", "version"))
    runs = sides.select("key", "version", "own", "other", "distance", "seeds").mapInArrow(extend, ran)
    # a document's runs: at most two for each of its lines
    spans = runs.groupBy("key", "version").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans"))
    spans = written(spans, "line-spans")
    out = widened(docs, "lines_before long, lines_deleted long")
    # a merge join at every size: the list of spans grows with the input
    joined = docs.join(spans.withColumnsRenamed({"key": "__key", "version": "__version"}).hint("merge"), F.col(key).eqNullSafe(F.col("__key")) & (F.xxhash64(F.col(text)) == F.col("__version")), "left")
    here = base.index(text)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                texts, counts = [], []
                for t, s in zip(part.column(here).to_pylist(), part.column(len(base)).to_pylist(), strict=True):
                    t, n, gone = without(t, [(x["first"], x["last"]) for x in s or ()]) if t is not None else (None, 0, 0)
                    texts.append(t)
                    counts.append((n, gone))
                columns = part.columns[: len(base)]
                columns[here] = pa.array(texts, pa.string())
                n, gone = zip(*counts, strict=True)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=out.names)

    return joined.select(*base, "spans").mapInArrow(apply, out)
