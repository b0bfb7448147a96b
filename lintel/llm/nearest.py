"""Approximate nearest neighbours with adaptive dimension scan.

Largest inner product becomes smallest distance by one more coordinate (vectors scaled to at most length 1,
the coordinate fills them up to 1; queries have 0 there). Vectors are dealt to lists by their nearest
centroid; neighbouring lists form a group, which is what meets its queries in one task.

Inside a list vectors and queries are rotated by one random rotation and cut into column blocks. Partial
distances grow block by block, and after each block a hypothesis test abandons every candidate whose partial
distance, scaled to all dimensions, is above the k-th best distance by more than (1 + epsilon /
sqrt(dimensions seen))^2. Survivors are scored on the original vectors in double precision.

The k-th best distance is known early: a query first scans its nearest lists, in chunks that grow from a few
vectors, and takes the k-th best score found there along to its other lists; lists whose radius shows that
they hold nothing nearer are left out.

Equal vectors are one class, which keeps its k + 1 smallest ids (more can't be among k nearest), so copies
cost no pairs. Groups are dealt out in blocks of vectors and of queries, so neither a large list nor many
queries of one list meet in one task.

Centroids are fitted on a bounded sample: the `sample` classes with the smallest hash, or four a list if that
is more (there are 16,384 lists at most; beyond about 500 million classes the lists grow). The number of lists
to probe and epsilon are set by brute force inside the sample so that `recall` is reached. Every vector is
indexed. Vectors that are null, zero, of another length than most, or that hold null or non-finite components
take no part, as queries or candidates. Ties go to the smaller id. With fewer candidates than k a query has as
many rows; an empty table gives none. Rows of equal id and vector count once. Other columns, whatever their
names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lintel.session import prepare, written

BLOCK = 4096  # vectors, or queries, of one group in one task
GROUP = 2048  # vectors that neighbouring lists of a group hold together
LISTS = 16_384
COLUMNS = 16  # of a column block
CHUNKS = (64, 128, 256, 512)  # vectors compared at once: few before the k-th best distance is known


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(11).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors scaled by the longest norm, with the coordinate that makes all norms 1."""
    x = x / longest
    return np.column_stack([x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(1)))])


def asked(q: np.ndarray) -> np.ndarray:
    return np.column_stack([q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300), np.zeros(len(q))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T)


def k_means(x: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Centres from a fixed start; an empty cluster keeps its centre."""
    centres = x[np.random.default_rng(5).permutation(len(x))[:lists]].copy()
    for _ in range(rounds):
        near = distances(x, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def centroids_of(x: np.ndarray, lists: int) -> np.ndarray:
    """Centres on two levels where there are many: cells first, then each cell's share of the lists."""
    if lists <= 1024:
        return k_means(x, lists)
    cells = k_means(x, round(lists**0.5))
    near = distances(x, cells).argmin(1)
    return np.concatenate([k_means(part, max(1, round(lists * len(part) / len(x)))) for c in range(len(cells)) if len(part := x[near == c])])


def cuts_of(dims: int) -> list[int]:
    """Ends of the column blocks; a short rest joins the last block."""
    return [*range(COLUMNS, max(COLUMNS, dims - COLUMNS // 2), COLUMNS), dims] if dims > COLUMNS else [dims]


def settings(sample: np.ndarray, longest: float, centres: np.ndarray, k: int, recall: float) -> tuple[int, float]:
    """(lists to probe, epsilon) by which queries find this share of their k nearest of the sample: brute force on 256 of its rows.

    Half of what may be missed is left to each of the two. The nearest of all vectors are nearer than those of
    a sample, so the share of all is no smaller."""
    queries = sample[:256]
    inner = queries @ sample.T
    inner[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    near = np.argsort(-inner, 1, kind="stable")[:, : min(k, len(sample) - 1)]
    if not near.size:
        return 1, 0.0
    share = (1 + recall) / 2
    place = distances(asked(queries), centres).argsort(1, kind="stable").argsort(1)
    needed = np.sort(np.take_along_axis(place, distances(lifted(sample, longest), centres).argmin(1)[near], 1).ravel()) + 1
    turn = rotation(sample.shape[1] + 1)
    gaps = ((asked(queries) @ turn)[:, None] - (lifted(sample, longest) @ turn)[near]) ** 2
    whole = gaps.sum(2)
    worst = np.zeros(whole.shape)
    for seen in cuts_of(gaps.shape[2])[:-1]:
        part = gaps[:, :, :seen].sum(2) * (gaps.shape[2] / seen)
        worst = np.maximum(worst, (np.sqrt(part / np.maximum(whole[:, -1:], 1e-300)) - 1) * seen**0.5)
    at = min(needed.size - 1, int(np.ceil(share * needed.size)))
    return int(needed[at]), float(np.sort(worst.ravel())[at])


class Scan:
    """The k best of the vectors that are shown to it, for each of its queries, by adaptive dimension scan."""

    def __init__(self, queries: np.ndarray, k: int, longest: float, epsilon: float, floor: np.ndarray | None = None):
        """floor: scores that are known to be reached by k vectors elsewhere."""
        self.queries, self.k, self.longest, self.epsilon = queries, k, longest, epsilon
        self.turn = rotation(queries.shape[1] + 1)
        self.cuts = cuts_of(queries.shape[1] + 1)
        self.rotated = self.blocks(asked(queries) @ self.turn)
        self.norms = np.maximum(np.linalg.norm(queries, axis=1), 1e-300)
        self.best = np.full((len(queries), k), -np.inf)
        self.floor = np.full(len(queries), -np.inf) if floor is None else floor.copy()
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0
        self.pairs = np.zeros(len(self.cuts) + 1, np.int64)  # compared in each column block; scored

    def blocks(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.ascontiguousarray(x[:, a:b]) for a, b in zip([0, *self.cuts], self.cuts)]

    def limits(self, who: np.ndarray) -> np.ndarray:
        """The k-th best distances; infinite before k vectors are found."""
        return np.maximum(0.0, 2.0 - 2.0 * np.maximum(self.floor, self.best.min(1))[who] / (self.norms[who] * self.longest))

    def show(self, who: np.ndarray, vectors: np.ndarray, ids: np.ndarray) -> None:
        """Compare the queries at these places with the vectors."""
        x = self.blocks(lifted(vectors, self.longest) @ self.turn)
        low, step = 0, 0
        while low < len(ids):
            size = CHUNKS[-1] if np.isfinite(self.limits(who)).all() else CHUNKS[min(step, len(CHUNKS) - 1)]
            for start in range(0, len(who), 512):
                some = who[start : start + 512]
                qi, xi = self.survivors(some, [b[low : low + size] for b in x])
                if len(qi):
                    self.keep(some[qi], ids[low + xi], np.einsum("ij,ij->i", self.queries[some[qi]], vectors[low + xi]))
            low, step = low + size, step + 1

    def survivors(self, who: np.ndarray, x: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs that no test abandons. Whole tiles are multiplied while many of their pairs are alive, single pairs after that."""
        q, dims, limit = [b[who] for b in self.rotated], self.cuts[-1], self.limits(who)
        far, alive, qi = np.zeros((len(who), len(x[0]))), np.ones((len(who), len(x[0])), bool), None
        for block, seen in enumerate(self.cuts):
            test = 1.0 if seen == dims else (1 + self.epsilon / seen**0.5) ** 2
            most = limit * (test * seen / dims) + 1e-12
            if qi is None:
                self.pairs[block] += np.count_nonzero(alive)
                far += distances(q[block], x[block])
                alive &= far <= most[:, None]
                if seen == dims or np.count_nonzero(alive) * 6 < alive.size:
                    qi, xi = np.nonzero(alive)
                    d = far[qi, xi]
            elif len(qi):
                self.pairs[block] += len(qi)
                gap = q[block][qi] - x[block][xi]
                d = d + np.einsum("ij,ij->i", gap, gap)
                on = d <= most[qi]
                qi, xi, d = qi[on], xi[on], d[on]
        self.pairs[-1] += len(qi)
        return qi, xi

    def keep(self, qi: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        on = scores >= np.maximum(self.floor, self.best.min(1))[qi]
        qi, ids, scores = qi[on], ids[on], scores[on]
        if not len(qi):
            return
        self.found.append((qi, ids, scores))
        self.held += len(qi)
        order = np.lexsort((-scores, qi))
        who, first, n = np.unique(qi[order], return_index=True, return_counts=True)
        rank = np.arange(len(qi)) - np.repeat(first, n)
        wide = np.full((len(who), min(self.k, int(n.max()))), -np.inf)
        inside = rank < wide.shape[1]
        wide[np.repeat(np.arange(len(who)), n)[inside], rank[inside]] = scores[order][inside]
        both = np.concatenate([self.best[who], wide], 1)
        self.best[who] = np.partition(both, both.shape[1] - self.k, 1)[:, -self.k :]
        if self.held > 1_000_000:
            self.found = [self.result()]
            self.held = len(self.found[0][0])

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query places, ids, scores), best first, ties to the smaller id."""
        if not self.found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        qi, ids, scores = (np.concatenate(z) for z in zip(*self.found))
        order = np.lexsort((ids, -scores, qi))
        qi, ids, scores = qi[order], ids[order], scores[order]
        on = np.arange(len(qi)) - np.searchsorted(qi, qi) < self.k
        return qi[on], ids[on], scores[on]


def flat(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length, a list column, as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def packed(x: np.ndarray) -> pa.Array:
    """Rows as byte strings."""
    offsets = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * 8)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x, np.float64).tobytes())])


def unpacked(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dims)


def search(df: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, sample: int = 8192, recall: float = 0.95) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries (key, vector) its k nearest other rows of df."""
    spark = prepare(df.sparkSession)
    good = df.select(F.col(key).alias("id"), F.col(vector).alias("v")).filter(usable(F.col("v")) & F.col("id").isNotNull())
    sizes = good.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = sizes[0]["d"]
    good = good.filter(F.size("v") == dims).withColumn("v", F.transform("v", lambda x: x.cast("double") + F.lit(0.0)))
    # the k + 1 smallest ids of a class; the limit applies before the shuffle
    members = good.dropDuplicates(["id", "v"]).withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("n") <= k + 1)
    members = written(members.withColumn("class", F.min("id").over(Window.partitionBy("v"))), "nearest-members")
    classes = members.filter("n = 1").select("class", "v")
    facts = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("longest")).first()
    longest = float(facts["longest"])
    lists = int(min(LISTS, max(1, round((facts["n"] / 2) ** 0.5))))
    sample = max(sample, 4 * lists)
    # about `sample` classes have a hash up to this; the few beyond are cut in the driver
    spread = F.pmod(F.xxhash64("class"), F.lit(1 << 62))
    chosen = classes.withColumn("h", spread).filter(F.col("h") <= int((1 << 62) * min(1.0, sample / facts["n"]))).toArrow()
    order = np.lexsort((chosen["class"].to_numpy(), chosen["h"].to_numpy()))[:sample]
    fitted = flat(chosen["v"].take(pa.array(order)))
    centres = centroids_of(lifted(fitted, longest), min(lists, len(fitted)))
    tested, epsilon = settings(fitted, longest, centres, k, recall)
    groups = max(1, round(facts["n"] / GROUP))
    group_of = np.arange(len(centres)) if groups >= len(centres) else distances(centres, k_means(centres, groups)).argmin(1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(start, 1024) for start in range(0, b.num_rows, 1024)):
                x = flat(part.column(1))
                far = distances(lifted(x, longest), centres)
                near = far.argmin(1)
                columns = [pa.array(group_of[near], pa.int32()), pa.array(near, pa.int32()), pa.array(np.sqrt(far[np.arange(len(near)), near])), part.column(0), packed(x)]
                yield pa.RecordBatch.from_arrays(columns, names=["group", "list", "gap", "class", "v"])

    index = written(classes.mapInArrow(assign, "group int, list int, gap double, class long, v binary"), "nearest-index")
    sizes = index.groupBy("group", "list").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius")).collect()  # a row a list
    held, radius, load = np.zeros(len(centres), np.int64), np.zeros(len(centres)), {}
    for r in sizes:
        held[r["list"]], radius[r["list"]] = r["n"], r["radius"]
        load[r["group"]] = load.get(r["group"], 0) + r["n"]
    wanted = queries.select(F.col(key).alias("query_id"), F.col(vector).alias("v")).filter(usable(F.col("v")) & F.col("query_id").isNotNull() & (F.size("v") == dims))
    wanted = wanted.withColumn("v", F.transform("v", lambda x: x.cast("double") + F.lit(0.0))).dropDuplicates(["query_id", "v"])
    asks = written(wanted.groupBy("v").agg(F.min("query_id").alias("ask")).select("ask", "v"), "nearest-asks")

    def probe(first: bool):
        """A row for each query and group, with the lists to scan there: the nearest ones that hold 2 (k + 1) vectors at first, the others later."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part in (b.slice(start, 256) for start in range(0, b.num_rows, 256)):
                    q = flat(part.column(1))
                    far = distances(asked(q), centres)
                    order = far.argsort(1, kind="stable")
                    before = np.cumsum(held[order], 1) - held[order]
                    early = before < 2 * (k + 1)
                    wish = early if first else ~early & ((np.arange(len(centres)) < tested) | (before < 50 * k))
                    if not first:
                        floor = part.column(2).to_numpy(zero_copy_only=False)
                        reach = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * floor / (np.maximum(np.linalg.norm(q, axis=1), 1e-300) * longest)))
                        near = np.sqrt(np.take_along_axis(far, order, 1)) - radius[order] <= reach[:, None] + 1e-9
                        wish &= near | np.isnan(floor)[:, None]
                    row, at = np.nonzero(wish & (held[order] > 0))
                    if not len(row):
                        continue
                    at = order[row, at]
                    by = np.lexsort((at, group_of[at], row))
                    row, at = row[by], at[by]
                    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (group_of[at][1:] != group_of[at][:-1])]))
                    scanned = pa.ListArray.from_arrays(pa.array(np.append(new, len(row)).astype(np.int32)), pa.array(at, pa.int32()))
                    floors = pa.nulls(len(new), pa.float64()) if first else part.column(2).take(pa.array(row[new]))
                    columns = [pa.array(group_of[at[new]], pa.int32()), part.column(0).take(pa.array(row[new])), packed(q[row[new]]), floors, scanned]
                    yield pa.RecordBatch.from_arrays(columns, names=["group", "ask", "v", "floor", "lists"])

        return run

    def look(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["ask", "class", "score"]
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        floor = a["floor"].to_numpy()
        scan = Scan(unpacked(a["v"], dims), k + 1, longest, epsilon, np.where(np.isnan(floor), -np.inf, floor))
        x, ids, list_of = unpacked(b["v"], dims), b["class"].to_numpy(), b["list"].to_numpy()
        lists = a["lists"].combine_chunks()
        row, at = np.repeat(np.arange(a.num_rows), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
        for one in np.unique(list_of):
            if len(who := row[at == one]):
                scan.show(who, x[list_of == one], ids[list_of == one])
        qi, found, scores = scan.result()
        return pa.table([a["ask"].to_numpy()[qi], found, scores], names=names)

    top = Window.partitionBy("ask").orderBy(F.desc("score"), "class")

    def phase(first: bool, source: DataFrame) -> DataFrame:
        probed = written(source.mapInArrow(probe(first), "group int, ask long, v binary, floor double, lists array<int>"), "nearest-probes")
        meet = {r["group"]: r["n"] for r in probed.groupBy("group").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a group
        parts = F.broadcast(spark.createDataFrame([(i, -(-n // BLOCK), -(-meet[i] // BLOCK)) for i, n in load.items() if i in meet] or [(-1, 1, 1)], "group int, vector_parts int, query_parts int"))
        left = probed.join(parts, "group").select("group", F.explode(F.sequence(F.lit(0), F.col("vector_parts") - 1)).alias("vp"), F.pmod(F.xxhash64("ask"), F.col("query_parts")).cast("int").alias("qp"), "ask", "v", "floor", "lists")
        right = index.join(parts, "group").select("group", F.pmod(F.xxhash64("class"), F.col("vector_parts")).cast("int").alias("vp"), F.explode(F.sequence(F.lit(0), F.col("query_parts") - 1)).alias("qp"), "list", "class", "v")
        keys = ["group", "vp", "qp"]
        near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(look, "ask long, class long, score double")
        return written(near.withColumn("n", F.row_number().over(top)).filter(F.col("n") <= k + 1), "nearest-found")

    early = phase(True, asks)
    known = early.filter(F.col("n") == k + 1).select("ask", F.col("score").alias("floor"))
    late = phase(False, written(asks.join(known, "ask", "left").select("ask", "v", "floor"), "nearest-asks"))
    near = early.unionByName(late).drop("n").withColumn("n", F.row_number().over(top)).filter(F.col("n") <= k + 1).drop("n")
    rows = wanted.join(asks, "v").select("query_id", "ask").join(near, "ask").join(members.select("class", F.col("id").alias("vec_id")), "class").filter("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
