"""Vector code compression: product codes whose codebooks are fitted by Lloyd rounds with Elkan's bounds, in integers.

Components become integers; a vector is cut into parts, and each part position has a codebook of entries. A part keeps
an upper bound of the distance to its entry and a lower bound of the distance to every entry; they are written with
the vectors and read by the next round, which first shifts them by how far the entries have moved. A part stays with
its entry without a distance computed if its upper bound is less than half the way from its entry to the nearest
other one; an entry is left out if its lower bound, or half the way to it, is greater than the upper bound. All of
that is strict and has a margin for rounding; what it leaves over is decided by squared distances in integers, ties
to the lower index, so the codes are those of plain Lloyd rounds.

Entries are few (parts * entries rows) and go with the tasks. Each task writes its vectors and one row of sums of its
parts by entry; sums of tasks are added up by position, so what reaches the driver has the size of the codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lintel.session import discard, prepare, written

SAFE = 1 << 24  # components below this, up or down, keep all sums of squares in 64 bits
ROWS = 16_384  # vectors worked on at once
MARGIN = 1e-6  # of bounds, which are kept in 32 bits, relative


@dataclass
class Books:
    """Codebooks, entries by part as integers, and how far each entry has moved in the round before."""

    entries: list[list[list[int]]]
    moved: np.ndarray

    def arrays(self) -> np.ndarray:
        """(part, entry, component): 64-bit integers, or Python's where they could overflow."""
        whole = np.array(self.entries, object)
        return whole.astype(np.int64) if whole.size and max(abs(int(whole.max())), abs(int(whole.min()))) < SAFE else whole

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.entries for entry in part for x in entry).encode()).hexdigest()


def squares(a: np.ndarray) -> np.ndarray:
    return (a * a).sum(-1)


def lengths(square: np.ndarray) -> np.ndarray:
    return np.sqrt(square.astype(float))


def down(x: np.ndarray) -> np.ndarray:
    return x * (1 - MARGIN)


def up(x: np.ndarray) -> np.ndarray:
    return x * (1 + MARGIN)


def assign(x: np.ndarray, entries: np.ndarray, moved: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Move one part position's vectors to their nearest entries; code, upper and lower change in place. Gives the number of distances computed."""
    upper[:] = up(upper) + up(moved)[code]
    lower[:] = np.maximum(down(lower) - up(moved), 0)
    k = len(entries)
    between = lengths(squares(entries[:, None] - entries[None]))
    half = down(between / 2)
    others = half + np.where(np.eye(k, dtype=bool), np.inf, 0)
    rows = np.flatnonzero(upper >= others.min(1)[code])
    if not len(rows):
        return 0
    left = lambda rows: (lower[rows] <= upper[rows, None]) & (others[code[rows]] <= upper[rows, None])
    rows = rows[left(rows).any(1)]
    own = squares(x[rows] - entries[code[rows]])  # the upper bound is made exact before others are looked at
    upper[rows] = up(lengths(own))
    lower[rows, code[rows]] = down(lengths(own))
    at, entry = np.nonzero(left(rows))
    far = squares(x[rows[at]] - entries[entry])
    lower[rows[at], entry] = down(lengths(far))
    best, chosen = own.copy(), code[rows].copy()
    for j in range(k):  # in the order of indices, so that a tie goes to the lower one
        some = at[entry == j]
        d = far[entry == j]
        nearer = (d < best[some]) | ((d == best[some]) & (j < chosen[some]))
        best[some[nearer]], chosen[some[nearer]] = d[nearer], j
    code[rows] = chosen
    upper[rows] = up(lengths(best))
    return len(rows) + len(at)


def integers(vectors: pa.Array, size: int) -> np.ndarray:
    """Rows of floor(4096 x); 64-bit integers, or Python's where squares could overflow."""
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(float) * 4096).reshape(-1, size)
    if not flat.size or np.abs(flat).max() < SAFE:
        return flat.astype(np.int64)
    return np.array([int(v) for v in flat.ravel()], object).reshape(-1, size)


def in_integers(batch: pa.RecordBatch, books: Books) -> tuple[np.ndarray, np.ndarray]:
    """(vectors by part, entries), both of one kind of integers."""
    entries = books.arrays()
    parts, _, d = entries.shape
    part = integers(batch.column(0), parts * d).reshape(batch.num_rows, parts, d)
    if object in (part.dtype, entries.dtype):
        return part.astype(object), entries.astype(object)
    return part, entries


def one_round(batch: pa.RecordBatch, books: Books, sums: np.ndarray | None) -> tuple[list[np.ndarray], int]:
    """(codes, upper and lower bounds by part) of a batch's vectors after a round, and the distances computed; the round's sums of parts and their number are added to sums."""
    part, entries = in_integers(batch, books)
    parts, k, d = entries.shape
    n = batch.num_rows
    given = [batch.column(i) for i in (3, 4, 5)]
    if n and given[0].null_count:
        code, upper, lower = np.zeros((n, parts), np.uint8), np.full((n, parts), np.inf, np.float32), np.zeros((n, parts, k), np.float32)
    else:
        code, upper, lower = (np.frombuffer(b"".join(c.to_pylist()), t).copy() for c, t in zip(given, (np.uint8, np.float32, np.float32), strict=True))
    code, upper, lower = code.reshape(n, parts).astype(np.int64), upper.reshape(n, parts), lower.reshape(n, parts, k)
    made = 0
    for p in range(parts):
        own = [code[:, p].copy(), upper[:, p].astype(float), lower[:, p].astype(float)]
        made += assign(part[:, p], entries[p], books.moved[p], *own)
        code[:, p], upper[:, p], lower[:, p] = own[0], np.nextafter(own[1].astype(np.float32), np.float32(np.inf)), np.nextafter(own[2].astype(np.float32), np.float32(-np.inf))
        if sums is not None:
            total = np.zeros((k, d + 1), part.dtype)
            np.add.at(total[:, :d], own[0], part[:, p])
            total[:, d] = np.bincount(own[0], minlength=k)
            sums[p] += total.astype(object)
    return [code, upper, lower], made


def packed(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def assigned(state: DataFrame, books: Books) -> DataFrame:
    """The vectors with their codes and bounds after a round, and a row a task with the sums of its parts by entry."""
    schema = state.schema
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(schema)
        parts, k, d = books.arrays().shape
        sums, all_made = np.zeros((parts, k, d + 1), object), 0
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                (code, upper, lower), made = one_round(batch, books, sums)
                all_made += made
                n = batch.num_rows
                columns = [*batch.columns[:3], packed(code.astype(np.uint8)), packed(upper), packed(lower.reshape(n, -1)), pa.nulls(n, pa.int64()), pa.nulls(n, kinds.field("sums").type)]
                yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(columns, kinds, strict=True)], names=names)
        last = [pa.nulls(1, t.type) for t in list(kinds)[:6]]
        flat = pa.array([[Decimal(int(x)) for x in sums.ravel()]], kinds.field("sums").type)
        yield pa.RecordBatch.from_arrays([*last, pa.array([all_made], pa.int64()), flat], names=names)

    return state.mapInArrow(run, schema)


def usable(df: DataFrame, id: str, vector: str, label: str, parts: int) -> DataFrame:
    """(vector, id, label) of the rows that take part; zeros fill vectors up to a multiple of parts."""
    v = F.col(vector)
    kept = df.filter(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).select(v.alias("vector"), F.col(id).alias("id"), F.col(label).alias("label"))
    size = kept.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if size is None:
        return kept
    kept = kept.filter(F.size("vector") == size["size"])
    zeros = -size["size"] % parts
    return kept.withColumn("vector", F.concat("vector", F.array_repeat(F.lit(0).cast("float"), zeros))) if zeros else kept


def first_books(kept: DataFrame, parts: int, entries: int) -> Books | None:
    """The parts of the vectors with the smallest ids; equal ids by their vectors, null ids last."""
    rows = kept.orderBy(F.asc_nulls_last("id"), "vector").limit(entries).select("vector").collect()
    if not rows:
        return None
    whole = [[int(np.floor(float(x) * 4096)) for x in r["vector"]] for r in rows]
    d = len(whole[0]) // parts
    return Books([[v[p * d : (p + 1) * d] for v in whole] for p in range(parts)], np.zeros((parts, len(rows))))


def next_books(state: DataFrame, books: Books) -> Books:
    """Entries move to the floored means of their parts; unused ones stay."""
    found = state.filter("sums IS NOT NULL").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("n")).collect()  # parts * entries * (components + 1) rows
    parts, k, d = books.arrays().shape
    sums = np.zeros(parts * k * (d + 1), object)
    for r in found:
        sums[r["pos"]] = int(r["n"])
    sums = sums.reshape(parts, k, d + 1)
    after = [[[int(x) // int(sums[p, j, d]) for x in sums[p, j, :d]] if sums[p, j, d] else books.entries[p][j] for j in range(k)] for p in range(parts)]
    moved = [[float(sum((a - b) ** 2 for a, b in zip(after[p][j], books.entries[p][j], strict=True))) ** 0.5 for j in range(k)] for p in range(parts)]
    return Books(after, np.array(moved))


def fit(kept: DataFrame, parts: int, entries: int, rounds: int) -> tuple[Books | None, DataFrame, list[int]]:
    """(codebooks, the vectors with the last round's codes and bounds, distances computed in each round) of what usable() gives."""
    books = first_books(kept, parts, entries)
    nothing = {n: F.lit(None).cast(t) for n, t in (("code", "binary"), ("upper", "binary"), ("lower", "binary"), ("distances", "long"), ("sums", "array<decimal(38,0)>"))}
    state, made = kept.withColumns(nothing), []
    for _ in range(rounds if books else 0):
        after = written(assigned(state.filter("sums IS NULL"), books), "codes-round")
        if made:
            discard(state)
        state, books = after, next_books(after, books)
        made.append(state.agg(F.sum("distances")).first()[0])
    return books, state, made


def coded(state: DataFrame, books: Books) -> DataFrame:
    """id, label, code and error of the vectors after a last assignment; errors of over 38 digits are null."""
    schema = StructType([state.schema["id"], state.schema["label"], *StructType.fromDDL("code string, error decimal(38,0)").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(schema)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                code = one_round(batch, books, None)[0][0]
                part, entries = in_integers(batch, books)
                error = sum(squares(part[:, p] - entries[p][code[:, p]]) for p in range(entries.shape[0])).tolist()
                columns = [batch.column(1), batch.column(2), pa.array([r.tobytes().hex() for r in code.astype(np.uint8)], pa.string()), pa.array([Decimal(e) if e < 10**38 else None for e in error], kinds.field("error").type)]
                yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(columns, kinds, strict=True)], names=kinds.names)

    return state.filter("sums IS NULL").mapInArrow(run, schema)


def compress(df: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6) -> tuple[DataFrame, Books | None]:
    """(id, code, error, label_error, codebooks_sha256) and the codebooks.

    Components become floor(4096 x). A code has two hex digits a part, its entry's index; error is the squared distance
    to the entries, label_error its sum over the rows of an equal label (nulls together), null where a sum has more than
    63 bits. At most 256 entries. Vectors that are null, empty, of another length than most (ties to the shorter), or
    that hold null or non-finite components take no part; a length that isn't a multiple of parts is filled up with
    zeros. Repeated rows count each time, equal vectors get equal codes; equal ids are ordered by their vectors, null
    ids come last. With fewer vectors than entries there are as many entries as vectors; without any, no rows and no
    codebooks. Other columns are left out, whatever their names."""
    prepare(df.sparkSession)
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part")
    kept = usable(df, id, vector, label, parts)
    books, state, _ = fit(kept, parts, entries, rounds)
    if books is None:
        return kept.select(F.col("id").alias(id), F.lit("").alias("code"), *(F.lit(0).cast("long").alias(c) for c in ("error", "label_error")), F.lit("").alias("codebooks_sha256")), None
    done = written(coded(state, books), "codes")
    if rounds:
        discard(state)
    sums = written(done.groupBy("label").agg(F.when(F.count("error") == F.count(F.lit(1)), F.try_sum("error")).try_cast("long").alias("label_error")), "label-errors").withColumnRenamed("label", "group")
    joined = done.join(sums, F.col("label").eqNullSafe(F.col("group")), "left")
    return joined.select(F.col("id").alias(id), "code", F.col("error").try_cast("long").alias("error"), "label_error", F.lit(books.digest()).alias("codebooks_sha256")), books


def restore(df: DataFrame, books: Books, code: str = "code", out: str = "restored") -> DataFrame:
    """Append the vector that a code stands for: its entries' components / 4096; null codes give null. A column of that name is replaced."""
    prepare(df.sparkSession)
    size = 2 * len(books.entries)
    whole = F.array(*[F.array(*[F.array(*[F.lit(x / 4096) for x in entry]) for entry in part]) for part in books.entries])
    digits = F.sequence(F.lit(1), F.lit(size), F.lit(2))
    index = lambda i: F.conv(F.substring(F.col(code), i, F.lit(2)), 16, 10).cast("int")
    vector = F.flatten(F.transform(digits, lambda i: F.element_at(F.element_at(whole, ((i + 1) / 2).cast("int")), index(i) + 1)))
    return df.withColumn(out, F.when(F.col(code).isNotNull(), vector))
