"""N-gram Jaccard join with set-relation skipping.

A document's set is its distinct word shingles (lower-cased A-Z; words are runs of bytes other than white
space), as 64-bit hashes. Two documents link when scale * intersection >= least * union (85 of 100, say).

1. One pass over the texts gives each document's set size, a hash of its set and a sketch (the parity of its
   shingles in 512 buckets); equal sets are one class, represented by their smallest id. It also counts
   shingles that are frequent inside a task's input; the most frequent of all become the tail of the global
   order of shingles. (Any order is correct; the list is bounded, and no case depends on it.)
2. A second pass indexes each set under its first n - ceil(least * n / scale) + m shingles in that order,
   with m = 1 + n // 50: two linked sets share the smaller m of them. An index list is sorted by position.
   Size and position bounds exclude pairs, and whole blocks of a long list are skipped once the smallest
   position of a block leaves too little overlap: index-level skipping.
3. In short lists all remaining pairs are counted; those that reach the smaller m are candidates. In a long
   list each set is paired with the first sets of the list (few rare shingles before the shared one, so they
   resemble most of the list). Verified links give components, and a set's answer is taken from its hub's
   answer: pairs inside a component need no work (answer-level skipping).
4. Sets of a long list that are outside its ruling component look at the list again, twice. First each is
   paired with its most similar set of another component only, by sketches, and takes over that one's answer
   if they link. Then all pairs of different components are counted that sizes, positions and sketches (two
   sketches differ in no more buckets than their sets differ in shingles) leave over, and the counts are added
   to those of the short lists, so nothing is left unchecked. Every candidate is verified on whole texts.

No link between different sets is lost, so components are exact. Documents without words (null, empty, white
space) have size 0 and link with nothing; very long texts are used whole. Copies cost one row each. A hub's
verifications are dealt out by hub and a salt sized from its number of pairs, and stream past one set at a time.
Lists of frequent shingles are cut into parts by a hash of the set: each part has its own first sets, and on
the second look the sets outside the ruling component visit all parts, which hold SPLIT sets of it each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.components import connected
from lintel.session import prepare, written

FREQUENT = 1 << 20  # length of the list of frequent shingles: 8 MB
LOCALLY, GLOBALLY = 3, 64  # documents of a task, and of all, from which a shingle is frequent
SHORT = 24  # a longer index list works by hubs first
SALT = 64  # verifications of a hub in one group
SPLIT = 4096  # entries of one index list in one part
BUCKETS = 512  # of a sketch
U = np.uint64


class Words(dict):
    """Hashes of words; forgets all when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


WORDS = Words()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> U(30)) * U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> U(27)) * U(0x94D049BB133111EB)
    return x ^ x >> U(31)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; with fewer words, of the whole sequence; without words, none."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, U)
    h = np.fromiter(map(WORDS.__getitem__, words), U, n)
    k = min(size, n)
    total = np.full(n - k + 1, U(k))
    for i in range(k):
        total = mixed(total * U(0x9E3779B97F4A7C15) + h[i : n - k + 1 + i])
    return np.unique(total)


def shared(n):
    """How many indexed shingles two linked sets have in common at least, by the smaller set's size."""
    return 1 + n // 50


def prefix_length(n: int, least: int, scale: int) -> int:
    return min(n, n + least * n // -scale + shared(n))  # n - ceil(least * n / scale) + shared


def set_hash(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes())


def sketch(s: np.ndarray) -> bytes:
    """Parity of the shingles per bucket."""
    return np.packbits(np.bincount((s >> U(64 - 9)).astype(np.int64), minlength=BUCKETS) & 1).tobytes()


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())


def survey(docs: DataFrame, size: int) -> DataFrame:
    """kind 0: a document's (id, n, set, sketch). kind 1: (n documents of one task's input hold shingle id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "id", "n", "set", "sketch"]
        held, count, seen = [], 0, {}

        def fold() -> None:
            nonlocal held, count
            if held:
                tokens, times = np.unique(np.concatenate(held), return_counts=True)
                for t, c in zip(tokens[times >= 2].tolist(), times[times >= 2].tolist(), strict=True):
                    seen[t] = seen.get(t, 0) + c
            held, count = [], 0

        for b in batches:
            for start in range(0, b.num_rows, 512):
                part = b.slice(start, 512)
                sets = [shingles(t, size) for t in part.column(1).to_pylist()]
                for s in sets:
                    held.append(s)
                    count += len(s)
                if count > 2_000_000:
                    fold()
                n = np.array([len(s) for s in sets], np.int64)
                hashes = np.array([set_hash(s) for s in sets], U)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), part.column(0), pa.array(n), as_long(hashes), pa.array(list(map(sketch, sets)), pa.binary())], names=names)
        fold()
        often = [(t, c) for t, c in seen.items() if c >= LOCALLY]
        if often:
            t, c = np.array([x[0] for x in often], U), np.array([x[1] for x in often], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(t), np.int32)), as_long(t), pa.array(c), as_long(t), pa.nulls(len(t), pa.binary())], names=names)

    return docs.mapInArrow(run, "kind int, id long, n long, set long, sketch binary")


def index_entries(docs: DataFrame, size: int, least: int, scale: int, frequent: np.ndarray, parts: np.ndarray) -> DataFrame:
    """(key, token, at = position << 32 | set size, set) for the indexed shingles; copies in one task's input once.

    parts: into how many the list of each frequent shingle is cut. key names a list or a part of one; token is 0 in whole lists, whose key it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for b in batches:
            for start in range(0, b.num_rows, 512):
                keys, tokens, ats, owners = [], [], [], []
                for t in b.column(1).slice(start, 512).to_pylist():
                    s = shingles(t, size)
                    if not len(s):
                        continue
                    own = set_hash(s)
                    if own in done:
                        continue
                    if len(done) > 1_000_000:
                        done.clear()
                    done.add(own)
                    length = prefix_length(len(s), least, scale)
                    if len(frequent):
                        near = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                        common = frequent[near] == s
                        first = s[~common][:length]
                        if len(first) < length:
                            first = np.concatenate([first, s[common][: length - len(first)]])
                    else:
                        first = s[:length]
                    key, token = first, np.zeros(length, U)
                    if len(frequent):
                        near = np.minimum(np.searchsorted(frequent, first), len(frequent) - 1)
                        cut = (frequent[near] == first) & (parts[near] > 1)
                        key = np.where(cut, mixed(first + U(1) + own % parts[near]), first)
                        token = np.where(cut, first, U(0))
                    keys.append(key)
                    tokens.append(token)
                    ats.append(np.arange(length, dtype=np.int64) << 32 | len(s))
                    owners.append(np.full(length, own, U))
                if tokens:
                    yield pa.RecordBatch.from_arrays([as_long(np.concatenate(keys)), as_long(np.concatenate(tokens)), pa.array(np.concatenate(ats)), as_long(np.concatenate(owners))], names=["key", "token", "at", "set"])

    return docs.mapInArrow(run, "key long, token long, at long, set long")


def least_overlap(na: np.ndarray, nb: np.ndarray, least: int, scale: int) -> np.ndarray:
    return -(-least * (na + nb) // (least + scale))


def may_link(pa_: np.ndarray, na: np.ndarray, pb: np.ndarray, nb: np.ndarray, least: int, scale: int) -> np.ndarray:
    """Bounds at each of a linked pair's first shared shingles: sizes, what is left behind the positions, and what differs before them."""
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    overlap = least_overlap(na, nb, least, scale)
    before = shared(small) - 1
    return (scale * small >= least * large) & (np.minimum(na - pa_, nb - pb) >= overlap - before) & (pa_ + pb <= na + nb - 2 * (overlap - before))


class Counts:
    """Pairs of sets with how often they met, smaller hash first; handed on when there are many."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, x: np.ndarray, y: np.ndarray, need: np.ndarray) -> None:
        if len(x):
            self.parts.append(np.stack([np.minimum(x, y), np.maximum(x, y), need]))
            self.size += len(x)

    def take(self, kind: int, least: int = 200_000) -> Iterator[pa.RecordBatch]:
        if self.size >= max(least, 1):
            x, y, need = np.concatenate(self.parts, axis=1)
            order = np.lexsort((y, x))
            x, y, need = x[order], y[order], need[order]
            first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
            n = np.diff(np.append(first, len(x)))
            self.parts, self.size = [], 0
            for i in range(0, len(first), 10_000):
                at = first[i : i + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), *map(pa.array, (x[at], y[at], n[i : i + 10_000], need[at]))], names=["kind", "x", "y", "n", "need"])


def runs_of(batches: Iterator[pa.RecordBatch], columns: int, hold: int = 40_000, lead: int = 4) -> Iterator[tuple[list[np.ndarray], np.ndarray, int]]:
    """Sorted rows as (columns, starts of runs of equal first column, repeated rows).

    Runs come whole up to `hold` rows; a longer one comes in pieces that repeat its first `lead` rows."""
    rest: list[list[np.ndarray]] = []
    size = carried = 0

    def made() -> tuple[list[np.ndarray], np.ndarray]:
        x = [np.concatenate([r[i] for r in rest]) for i in range(columns)]
        return x, np.flatnonzero(np.concatenate([[True], x[0][1:] != x[0][:-1]]))

    for b in batches:
        if not b.num_rows:
            continue
        rest.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(columns)])
        size += b.num_rows
        if size < hold:
            continue
        x, starts = made()
        if len(starts) > 1:
            cut = int(starts[-1])
            yield [c[:cut] for c in x], starts[:-1], carried
            rest, size, carried = [[c[cut:] for c in x]], len(x[0]) - cut, 0
        else:
            yield x, starts, carried
            rest, size, carried = [[c[:lead] for c in x]], lead, lead
    if rest and size > carried:
        yield *made(), carried


PAIRS = "kind int, x long, y long, n long, need long"


def candidates(entries: DataFrame, least: int, scale: int) -> DataFrame:
    """kind 0: pairs (x, y) that met n times in short lists. kind 2: hub x and set y of a long list. kind 1: entries (token x, at y, set n) of long lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "x", "y", "n", "need"]
        counts = Counts()
        hubs: set[tuple[int, int]] = set()
        for (token, part_of, at, own), starts, carried in runs_of(batches, 4):
            length = np.diff(np.append(starts, len(token)))
            many = length > 1
            whole = part_of[starts] == 0
            token = np.where(part_of == 0, token, part_of)
            whole[0] &= not carried  # a piece of a long list
            many |= ~whole  # the other parts may hold partners
            if not many.any():
                continue
            # copies from several tasks stand next to each other, for a set has one position in a list
            pick = np.flatnonzero(np.repeat(many, length))
            run_id = np.repeat(np.arange(many.sum()), length[many])
            o = own[pick]
            fresh = np.concatenate([[True], (o[1:] != o[:-1]) | (run_id[1:] != run_id[:-1])])
            pick, run_id, o = pick[fresh], run_id[fresh], o[fresh]
            p, m = at[pick] >> 32, at[pick] & 0xFFFFFFFF
            size = np.bincount(run_id)
            first = np.concatenate([[0], np.cumsum(size)[:-1]])
            size = np.where(whole[many], size, np.maximum(size, SHORT + 1))
            place, size = np.arange(len(pick)) - first[run_id], size[run_id]
            for gap in range(1, SHORT):  # all pairs of short lists, by distance
                j = np.flatnonzero((size <= SHORT) & (place >= gap))
                if not len(j):
                    break
                i = j - gap
                ok = may_link(p[i], m[i], p[j], m[j], least, scale)
                i, j = i[ok], j[ok]
                counts.add(o[i], o[j], shared(np.minimum(m[i], m[j])))
            yield from counts.take(0)
            long = np.flatnonzero(size > SHORT)
            if len(long):
                open_ = np.ones(len(pick), bool)
                for hub in range(4):  # the first sets of the list, for those that no earlier one may link with
                    j = long[(place[long] > hub) & open_[long]]
                    i = first[run_id[j]] + hub
                    ok = may_link(p[i], m[i], p[j], m[j], least, scale)
                    open_[j[ok]] = False
                    new = [x for x in set(zip(o[i[ok]].tolist(), o[j[ok]].tolist(), strict=True)) if x not in hubs]
                    if len(hubs) > 200_000:
                        hubs.clear()
                    hubs.update(new)
                    if new:
                        x = np.array(new, np.int64)
                        one = pa.array(np.ones(len(new), np.int64))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(new), 2, np.int32)), pa.array(x[:, 0].copy()), pa.array(x[:, 1].copy()), one, one], names=names)
                long = long[pick[long] >= carried]
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(long), np.int32)), *map(pa.array, (token[pick[long]], at[pick[long]], o[long], o[long]))], names=names)
        yield from counts.take(0, 0)

    return entries.repartition("key").sortWithinPartitions("key", "at", "set").mapInArrow(run, PAIRS)


def second_look(lists: DataFrame, known: DataFrame) -> DataFrame:
    """Entries (key, at, set, home, outside, component, sketch) of the long lists (token, at, set) with sets of several components.

    A list has parts by hash of the set; sets outside the component that rules the list visit all of them, home says in which they live."""
    named = written(lists.join(known.select("set", "component"), "set").select("token", "at", "set", "component"), "jaccard-lists")
    held = named.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n"))
    tokens = held.groupBy("token").agg(F.max_by("component", F.struct("n", "component")).alias("ruling"), F.ceil(F.sum("n") / SPLIT).cast("int").alias("parts"), F.count(F.lit(1)).alias("components"))
    tokens = written(tokens.filter("components > 1").drop("components"), "jaccard-tokens")
    rows = named.join(tokens, "token").withColumn("outside", F.col("component") != F.col("ruling")).withColumn("own", F.pmod(F.xxhash64("set"), F.col("parts")).cast("int"))
    rows = rows.withColumn("part", F.explode(F.when(F.col("outside"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("own"))))
    rows = written(rows.select(F.xxhash64("token", "part").alias("key"), "at", "set", (F.col("own") == F.col("part")).alias("home"), "outside", "component"), "jaccard-look")
    return rows.join(known.select("set", "sketch"), "set").select("key", "at", "set", "home", "outside", "component", "sketch")


def crossing(entries: DataFrame, least: int, scale: int, nearest: bool) -> DataFrame:
    """Pairs of sets of different components in the lists of second_look, skipping blocks by position.

    nearest: kind 2, each set outside the ruling component with its most similar partner. Otherwise kind 3, all pairs (x, y) that met n times."""
    block = 512

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, done = Counts(), set()
        for a in lists_of(batches):
            key, at, own, home, outside, component, sketches = a
            c, o, p, n = component, own, at >> 32, at & 0xFFFFFFFF
            # at most this much of a pair may stand before a first shared shingle, whatever the partner's size
            most = n * (1 + scale / least) * (scale - least) / (scale + least) + 2 * shared(n)
            others = np.flatnonzero(outside)
            for low in range(0, len(others), block):
                j = others[low : low + block]
                best, partner = np.full(len(j), BUCKETS + 1), np.zeros(len(j), np.int64)
                for from_ in range(0, len(c), block):
                    i = np.arange(from_, min(from_ + block, len(c)))
                    if p[i[0]] + p[j].min() > most[j].max():
                        break  # sorted by position: no later block can link
                    ok = may_link(p[i][:, None], n[i][:, None], p[j][None], n[j][None], least, scale) & (c[i][:, None] != c[j][None])
                    if not nearest:
                        # two sets outside the ruling component meet once, where the smaller of them lives
                        ok &= ~outside[i][:, None] | (o[i][:, None] < o[j][None]) & home[i][:, None]
                    x, y = np.nonzero(ok)
                    if not len(x):
                        continue
                    apart = np.bitwise_count(sketches[i[x]] ^ sketches[j[y]]).sum(1, dtype=np.int64)
                    na, nb = n[i[x]], n[j[y]]
                    on = apart <= na + nb - 2 * least_overlap(na, nb, least, scale)
                    x, y, apart = x[on], y[on], apart[on]
                    if nearest:
                        order = np.lexsort((x, apart, y))
                        first = order[np.unique(y[order], return_index=True)[1]]
                        first = first[apart[first] < best[y[first]]]
                        best[y[first]], partner[y[first]] = apart[first], o[i[x[first]]]
                    else:
                        counts.add(o[i[x]], o[j[y]], shared(np.minimum(n[i[x]], n[j[y]])))
                if nearest and (best <= BUCKETS).any():
                    found = {(min(u, v), max(u, v)) for u, v in zip(o[j[best <= BUCKETS]].tolist(), partner[best <= BUCKETS].tolist(), strict=True)} - done
                    if len(done) > 200_000:
                        done.clear()
                    done |= found
                    if found:
                        pairs, one = np.array(sorted(found), np.int64), pa.array(np.ones(len(found), np.int64))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), 2, np.int32)), pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), one, one], names=["kind", "x", "y", "n", "need"])
            yield from counts.take(3)
        yield from counts.take(3, 0)

    return entries.repartition("key").sortWithinPartitions("key", "at", "set").mapInArrow(run, PAIRS)


def lists_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of each list in turn, sketches as rows of 64-bit words."""

    def made(held: list[pa.RecordBatch]) -> list[np.ndarray]:
        t = pa.Table.from_batches(held)
        columns = [t.column(i).to_numpy() for i in range(6)]
        return [*columns, np.frombuffer(b"".join(t.column(6).to_pylist()), U).reshape(-1, BUCKETS // 64)]

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy()
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
            if held and held[-1].column(0)[0].as_py() != key[start]:
                yield made(held)
                held = []
            held.append(b.slice(start, end - start))
    if held:
        yield made(held)


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, least: int, scale: int) -> DataFrame:
    """The pairs (x, y) of set hashes that link, as pairs (u, v) of representatives' ids."""
    groups = pairs.groupBy("x").agg(F.ceil(F.count(F.lit(1)) / SALT).alias("parts"))
    dealt = pairs.join(groups, "x").withColumn("part", F.pmod(F.xxhash64("y"), F.col("parts")))
    hubs = dealt.select("x", "part").distinct().select("x", "part", F.lit(0).alias("role"), F.col("x").alias("set"))
    needs = hubs.unionByName(dealt.select("x", "part", F.lit(1).alias("role"), F.col("y").alias("set")))
    needs = needs.join(classes.select("set", F.col("rep").alias("id")), "set").select("x", "part", "role", "id", "set")
    # a merge join at every size: the list of needed texts grows with the input
    texts = written(needs, "jaccard-needs").hint("merge").join(docs, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hub, hub_id = None, np.zeros(0, U), 0
        for b in batches:
            u, v = [], []
            for start in range(0, b.num_rows, 256):
                for x, part, role, i, own, text in zip(*(c.to_pylist() for c in b.slice(start, 256).columns), strict=True):
                    s = shingles(text, size)
                    if np.uint64(set_hash(s)).astype(np.int64) != own:
                        continue  # another text under the same id
                    if role == 0:
                        if (x, part) != key:
                            key, hub, hub_id = (x, part), s, i
                        continue
                    if (x, part) != key:
                        raise RuntimeError("a group without its hub")
                    small, large = sorted((len(s), len(hub)))
                    if scale * small < least * large:
                        continue
                    both = np.concatenate([hub, s])
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    if scale * common >= least * (len(both) - common):
                        u.append(hub_id)
                        v.append(i)
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return texts.select("x", "part", "role", "id", "set", "text").repartition("x", "part").sortWithinPartitions("x", "part", "role").mapInArrow(run, "u long, v long")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, label) after more links (u, v): components of components."""
    of = lambda end: F.coalesce(F.col(f"{end}_label"), F.col(end)).alias(end)
    named = links
    for end in ("u", "v"):
        named = named.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label")), end, "left").select(of(end), *[c for c in named.columns if c != end])
    again = written(connected(written(named.select("u", "v"), "jaccard-named")).select(F.col("node").alias("label"), F.col("label").alias("smaller")), "jaccard-again")
    old = labels.join(again, "label", "left").select("node", F.coalesce("smaller", "label").alias("label"))
    fresh = again.select(F.col("label").alias("node"), F.col("smaller").alias("label")).join(labels.select("node"), "node", "left_anti")
    return written(old.unionByName(fresh), "jaccard-labels")


def components_of(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, least: int = 85, scale: int = 100) -> DataFrame:
    """One row per input row: key, n_shingles and component_id, the smallest key reachable by links.

    Keys are integers and name documents; rows with a null key have no part in links, and a null component. Repeated
    rows repeat. Other columns of df, whatever their names, are not read. An empty table gives no rows."""
    prepare(df.sparkSession)
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    seen = written(survey(docs, size), "jaccard-survey")
    members = seen.filter("kind = 0").select("id", "n", "set", "sketch")
    classes = written(members.filter("n > 0 AND id IS NOT NULL").groupBy("set").agg(F.min("id").alias("rep"), F.first("sketch").alias("sketch")), "jaccard-classes")
    often = written(seen.filter("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).filter(F.col("n") >= GLOBALLY), "jaccard-frequent")
    floor, room = 0, FREQUENT
    for r in often.groupBy(F.floor(F.log2("n")).alias("power")).count().orderBy(F.desc("power")).collect():  # a row a power of two
        room -= r["count"]
        if room < 0:
            floor = 2 ** (r["power"] + 1)
            break
    often = [(r["id"], r["n"]) for r in often.filter(F.col("n") >= floor).select("id", "n").toLocalIterator()]
    frequent, parts = np.array([t for t, _ in often], np.int64).view(U), np.array([-(-n // SPLIT) for _, n in often], U)
    order = np.argsort(frequent)
    entries = index_entries(docs.filter("id IS NOT NULL"), size, least, scale, frequent[order], parts[order])

    found = written(candidates(entries, least, scale), "jaccard-candidates")
    met = found.filter("kind = 0").groupBy("x", "y").agg(F.sum("n").alias("n"), F.max("need").alias("need"))
    flat = lambda d: d.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    hubs = found.filter("kind = 2").select("x", "y").distinct()
    enough = met.filter("n >= need").select("x", "y").join(flat(hubs), ["x", "y"], "left_anti")
    pairs = written(hubs.unionByName(enough).distinct(), "jaccard-pairs")
    labels = written(connected(written(verified(pairs, classes, docs, size, least, scale), "jaccard-links")), "jaccard-labels")

    lists = found.filter("kind = 1").select(F.col("x").alias("token"), F.col("y").alias("at"), F.col("n").alias("set"))
    done = flat(pairs)
    for nearest in (True, False):
        if lists.isEmpty():
            break
        known = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("set", F.coalesce("label", "rep").alias("component"), "sketch")
        again = crossing(second_look(lists, known), least, scale, nearest)
        if nearest:
            more = again.select("x", "y")
        else:
            # one aggregate over both kinds of lists; pairs that met in short lists only were decided above
            both = again.select("x", "y", "n", "need", F.lit(1).alias("again")).unionByName(met.select("x", "y", "n", "need", F.lit(0).alias("again")))
            more = both.groupBy("x", "y").agg(F.sum("n").alias("n"), F.max("need").alias("need"), F.max("again").alias("again")).filter("again = 1 AND n >= need")
        more = written(flat(more).distinct().join(done, ["x", "y"], "left_anti"), "jaccard-more")
        if not more.isEmpty():
            links = written(verified(more, classes, docs, size, least, scale), "jaccard-links")
            labels = labels if links.isEmpty() else merged(labels, links)
            done = done.unionByName(more)
    named = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("set", F.coalesce("label", "rep").alias("component"))
    return members.join(named, "set", "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id")).alias("component_id")
    )
