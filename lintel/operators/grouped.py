"""Order-dependent algorithms per group, in Python: greedy matching, knapsack, sequencing, bootstrap.

Each group is one sample file, workflow or plan. Groups are bounded by what they describe: the findings of one
(language, path, smell), the steps of one workflow. Rows are dealt by group and sorted, and many groups come in one
Arrow batch, so a small group costs no call of its own."""

from __future__ import annotations

import random
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.session import prepare


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, about `rows` long, with the groups' bounds. The input is sorted by its first `keys` columns; nulls are a value."""
    rest: list[pa.RecordBatch] = []
    size = 0

    def made() -> tuple[pa.Table, np.ndarray]:
        t = pa.Table.from_batches(rest).combine_chunks()
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for i in range(keys):
            codes = t.column(i).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        return t, np.append(np.flatnonzero(new), t.num_rows)

    for b in batches:
        if b.num_rows:
            rest.append(b)
            size += b.num_rows
        if size >= rows:
            t, bounds = made()
            if len(bounds) > 2:
                yield t.slice(0, bounds[-2]), bounds[:-1]
                rest = t.slice(bounds[-2]).to_batches()
            size = sum(x.num_rows for x in rest) if len(bounds) > 2 else 0  # a long group waits for as many rows again
    if rest:
        yield made()


def line_window(kind: str, start: float, end: float, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The rule of joins.lines_match on plain values; nan is no line."""
    if np.isnan(start):
        return np.ones(len(starts), bool)
    if kind == "class":
        return np.isnan(starts) | (start <= starts) & (starts <= end) | (np.abs(start - starts) <= 10)
    return np.isnan(starts) | (np.abs(start - starts) <= 5) | (start <= ends) & (starts <= end)


def names_match(a: str | None, b: str | None) -> bool:
    return not a or not b or a in b or b in a


def matched(truth: list[tuple], found: list[tuple]) -> list[int | None]:
    """For each of truth (kind, name, start, end) in order the place of the first unused one of found (name, start, end) that fits."""
    starts, ends = np.array([f[1] for f in found], float), np.array([f[2] for f in found], float)
    order = np.argsort(starts, kind="stable")  # nan last
    known = int(np.count_nonzero(~np.isnan(starts)))
    by_start, free = starts[order], np.ones(len(found), bool)
    longest = max(10.0, float(np.max(ends[order[:known]] - by_start[:known]))) if known else 10.0
    out: list[int | None] = []
    for kind, name, start, end in truth:
        if np.isnan(start):
            near = np.arange(len(found))
        else:  # what begins far away can't fit
            low, high = np.searchsorted(by_start[:known], [start - longest, max(end, start + 10)], side="left")
            high = np.searchsorted(by_start[:known], max(end, start + 10), side="right")
            near = np.sort(np.concatenate([order[low:high], order[known:]]))
        near = near[free[near]]
        near = near[line_window(kind, start, end, starts[near], ends[near])]
        at = next((int(i) for i in near if names_match(name, found[i][0])), None)
        if at is not None:
            free[at] = False
        out.append(at)
    return out


def greedy_match(truth: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """truth (keys, id, kind, name, start, end, pos) to predictions (keys, pid, name, start, end, pos): in order, the first unused one that fits.

    Names are compared trimmed and in lower case; an end that is missing or 0 is the start. Returns keys, id, pid; either is null where the other has no partner."""
    prepare(truth.sparkSession)
    kinds = {"id": truth.schema["id"].dataType.simpleString(), "pid": predictions.schema["pid"].dataType.simpleString()}
    schema = ", ".join([*(f"`{k}` {truth.schema[k].dataType.simpleString()}" for k in keys), f"id {kinds['id']}, pid {kinds['pid']}"])
    name = F.lower(F.trim(F.coalesce("name", F.lit("")))).alias("name")
    end = F.coalesce(F.nullif(F.col("end"), F.lit(0)), F.col("start"))
    lines = [F.col("start").cast("double").alias("start"), end.cast("double").alias("end"), F.col("pos").alias("pos")]
    none = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    left = truth.select(*keys, F.lit(0).alias("side"), "id", none("pid"), F.trim("kind").alias("kind"), name, *lines)
    right = predictions.select(*keys, F.lit(1).alias("side"), none("id"), "pid", F.lit(None).cast("string").alias("kind"), name, *lines)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in whole_groups(batches, n):
            side, kind, names = t["side"].to_numpy(), t["kind"].to_pylist(), t["name"].to_pylist()
            start, stop = (t[c].to_numpy() for c in ("start", "end"))
            own, partner = [], []  # rows of the table; -1 for none
            for a, b in zip(bounds, bounds[1:]):
                cut = a + int(np.searchsorted(side[a:b], 1))
                got = matched([(kind[i], names[i], start[i], stop[i]) for i in range(a, cut)], [(names[i], start[i], stop[i]) for i in range(cut, b)]) if cut < b else [None] * (cut - a)
                used = {g for g in got if g is not None}
                own += [*range(a, cut), *[-1] * (b - cut - len(used))]
                partner += [*[-1 if g is None else cut + g for g in got], *[cut + i for i in range(b - cut) if i not in used]]
            own, partner = np.array(own, np.int64), np.array(partner, np.int64)
            pick = lambda c, rows: t[c].combine_chunks().take(pa.array(rows, mask=rows < 0))
            either = np.where(own >= 0, own, partner)
            yield pa.RecordBatch.from_arrays([*(pick(k, either) for k in keys), pick("id", own), pick("pid", partner)], names=[*keys, "id", "pid"])

    return left.unionByName(right).repartition(*keys).sortWithinPartitions(*keys, "side", "pos").mapInArrow(run, schema)


def knapsacks(values: np.ndarray, costs: np.ndarray, bounds: np.ndarray, budget: int) -> np.ndarray:
    """Which items are in the best selection of their group: most value within the budget, an item only where it adds to it."""
    chosen = np.zeros(len(values), bool)
    sizes = np.diff(bounds)
    order = np.argsort(sizes, kind="stable")
    room = np.arange(budget + 1)
    at = 0
    while at < len(order) and budget > 0:
        # groups of about one size together, in tables of a few million cells
        n = int(sizes[order[at]])
        last = int(np.searchsorted(sizes[order], max(n + 2, n * 5 // 4), side="right"))
        some = order[at : max(at + 1, min(last, at + max(1, 8_000_000 // ((n * 5 // 4 + 2) * (budget + 1)))))]
        at += len(some)
        width = int(sizes[some].max())
        place = bounds[some][:, None] + np.arange(width)
        real = np.arange(width) < sizes[some][:, None]
        place = np.where(real, place, 0)
        v, c = np.where(real, values[place], 0.0), np.where(real, np.minimum(costs[place], budget + 1), budget + 1)
        best, took = np.zeros((len(some), budget + 1)), np.zeros((width, len(some), budget + 1), bool)
        for i in range(width):
            before = room - c[:, i, None]
            better = np.where(before >= 0, np.take_along_axis(best, np.maximum(before, 0), 1) + v[:, i, None], -np.inf)
            took[i] = better > best
            best = np.where(took[i], better, best)
        left, each = np.full(len(some), budget), np.arange(len(some))
        for i in range(width - 1, -1, -1):
            takes = took[i, each, left]
            chosen[place[takes, i]] = True
            left = left - np.where(takes, c[:, i], 0)
    return chosen


#: Named selections: most points, low risk only, or what change makes most expensive to leave.
PRESETS = {"best_value": ("points", 1.0), "safe_wins": ("points", 0.35), "stop_bleeding": ("interest", 1.0)}


def choose(df: DataFrame, by: str, item: str, value: str, cost: str, budget: int, risk: str | None = None, most_risk: float = 1.0) -> DataFrame:
    """Per group the items of the best selection within a budget of whole minutes; rows above the risk limit don't take part.

    Costs are cut to whole numbers, not under 0; null values and costs count as 0."""
    prepare(df.sparkSession)
    rows = df.filter(F.col(risk) <= most_risk) if risk else df
    schema = f"`{by}` {df.schema[by].dataType.simpleString()}, `{item}` {df.schema[item].dataType.simpleString()}, points double, minutes int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in whole_groups(batches, 1):
            on = knapsacks(t["points"].to_numpy(), t["minutes"].to_numpy().astype(np.int64), bounds, budget)
            yield from t.filter(pa.array(on)).combine_chunks().to_batches()

    flat = rows.select(by, item, F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("points"), F.greatest(F.lit(0), F.coalesce(F.col(cost).cast("int"), F.lit(0))).alias("minutes"))
    return flat.repartition(by).sortWithinPartitions(by, item).mapInArrow(run, schema)


def choose_preset(df: DataFrame, by: str, item: str, cost: str, budget: int, risk: str, preset: str = "best_value") -> DataFrame:
    """choose() by name over executable rows (status, points, interest columns); an unknown name is best_value."""
    objective, most = PRESETS.get(preset, PRESETS["best_value"])
    return choose(df.filter("status = 'executable'"), by, item, objective, cost, budget, risk, most)


def ordered_steps(actions: list[str], ranks: list[int], needs: dict[str, set[str]]) -> list[int | None]:
    """Each step's place, from 1: of the steps whose needed actions occur earlier, at least once, or nowhere in the plan, the worst rank first, then the first. Steps of a cycle have no place."""
    there = set(actions)
    waiting = {a: needs.get(a, set()) & there for a in there}
    steps: dict[str, list[int]] = {}
    for i, a in enumerate(actions):
        steps.setdefault(a, []).append(i)
    ready = [(ranks[i], i) for a in there if not waiting[a] for i in steps[a]]
    heapify(ready)
    out: list[int | None] = [None] * len(actions)
    done: set[str] = set()
    place = 0
    while ready:
        _, i = heappop(ready)
        place += 1
        out[i] = place
        if actions[i] not in done:
            done.add(actions[i])
            for a in there:
                if actions[i] in waiting[a]:
                    waiting[a] = waiting[a] - {actions[i]}
                    if not waiting[a]:
                        for k in steps[a]:
                            heappush(ready, (ranks[k], k))
    return out


def sequence_steps(steps: DataFrame, plan: str, needs: list[tuple[str, str]]) -> DataFrame:
    """steps (plan, id, action, rank, pos) to (plan, id, step): per plan an order that respects (action, needed action). A step that waits for itself through others has a null step."""
    prepare(steps.sparkSession)
    needed: dict[str, set[str]] = {}
    for a, n in needs:
        needed.setdefault(a, set()).add(n)
    schema = f"`{plan}` {steps.schema[plan].dataType.simpleString()}, id {steps.schema['id'].dataType.simpleString()}, step int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in whole_groups(batches, 1):
            actions, ranks = t["action"].to_pylist(), t["rank"].to_pylist()
            places: list[int | None] = []
            for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
                places += ordered_steps(actions[a:b], ranks[a:b], needed)
            yield pa.RecordBatch.from_arrays([t[plan].combine_chunks(), t["id"].combine_chunks(), pa.array(places, pa.int32())], names=[plan, "id", "step"])

    rows = steps.select(plan, "id", F.coalesce("action", F.lit("")).alias("action"), F.coalesce("rank", F.lit(99)).alias("rank"), "pos")
    return rows.repartition(plan).sortWithinPartitions(plan, "pos", "id").mapInArrow(run, schema)


def f1(tp: int, fp: int, fn: int) -> float | None:
    return 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else None


def bootstrap_f1(counts: tuple[int, int, int, int], rounds: int = 1000, seed: int = 42) -> tuple[float | None, float | None, float | None]:
    """(F1, 2.5 %, 97.5 %) of resampled outcome counts: the sum of n draws is a multinomial, so no row is needed."""
    n = sum(counts)
    if n < 10:
        return f1(*counts[:3]), None, None
    draws = np.random.default_rng(seed).multinomial(n, np.array(counts) / n, rounds)
    found = sorted(v for v in (f1(*map(int, d[:3])) for d in draws) if v is not None)
    return f1(*counts[:3]), found[int(0.025 * len(found))], found[min(len(found) - 1, int(0.975 * len(found)))]


def bootstrap_ci(df: DataFrame, by: list[str], rounds: int = 1000, seed: int = 42) -> DataFrame:
    """df: a row per group with tp, fp, fn, tn."""
    prepare(df.sparkSession)
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)

    def run(batches):
        for pdf in batches:
            made = [bootstrap_f1(tuple(map(int, x)), rounds, seed) for x in pdf[["tp", "fp", "fn", "tn"]].itertuples(index=False)]
            yield pd.concat([pdf[by].reset_index(drop=True), pd.DataFrame(made, columns=["f1", "low", "high"], dtype=float)], axis=1)

    return df.select(*by, "tp", "fp", "fn", "tn").mapInPandas(run, f"{kinds}, f1 double, low double, high double")


def poisson_weights(cluster: str, round_: str, seed: int):
    """How often a cluster is drawn in a round: Poisson(1) by a hash of both, so that any engine makes the same draws."""
    digits = F.substring(F.md5(F.concat_ws("|", F.col(cluster).cast("string"), F.col(round_).cast("string"), F.lit(str(seed)))), 1, 12)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)
    weight, p, total = F.lit(0), 0.36787944117144233, 0.0
    for k in range(18):  # the tail beyond is under the resolution of u
        total += p
        weight = weight + F.when(u > total, 1).otherwise(0)
        p /= k + 1
    return weight


def f1_column(prefix: str = ""):
    tp, fp, fn = (F.col(prefix + c) for c in ("tp", "fp", "fn"))
    return F.try_divide(2.0 * tp, 2.0 * tp + fp + fn)


def cluster_bootstrap(df: DataFrame, cluster: str, rounds: int = 200, seed: int = 42, by: list[str] | None = None) -> DataFrame:
    """Percentile interval of F1 when whole clusters (tp, fp, fn a row) are drawn with replacement: Poisson(1) weights per cluster and round. by: an interval a group."""
    by = by or []
    draws = df.select(*by, cluster, "tp", "fp", "fn", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    sums = draws.withColumn("w", poisson_weights(cluster, "round", seed)).groupBy(*by, "round").agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in ("tp", "fp", "fn")])
    return sums.select(*by, f1_column().alias("f1")).groupBy(*by).agg(F.count("f1").alias("rounds"), F.percentile("f1", F.lit(0.025)).alias("low"), F.percentile("f1", F.lit(0.975)).alias("high"))


def paired_bootstrap(df: DataFrame, cluster: str, rounds: int = 200, seed: int = 42) -> DataFrame:
    """Difference of two predictions' F1 (a row per cluster with a_tp, a_fp, a_fn and b_...), and its percentile interval: both are scored on the same draws. Rounds without a positive row don't count."""
    names = [f"{side}_{c}" for side in "ab" for c in ("tp", "fp", "fn")]
    gap = lambda: F.coalesce(f1_column("a_"), F.lit(0.0)) - F.coalesce(f1_column("b_"), F.lit(0.0))
    draws = df.select(cluster, *names, F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    sums = draws.withColumn("w", poisson_weights(cluster, "round", seed)).groupBy("round").agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in names])
    found = sums.filter(F.col("a_tp") + F.col("a_fn") > 0).select(gap().alias("d")).agg(F.count("d").alias("rounds"), F.percentile("d", F.lit(0.025)).alias("low"), F.percentile("d", F.lit(0.975)).alias("high"))
    whole = df.agg(*[F.sum(c).alias(c) for c in names]).select(gap().alias("difference"))
    return whole.crossJoin(F.broadcast(found))  # a row each


def random_rows(n: int, seed: int) -> list[tuple]:
    """Seeded feedback rows for tests: (smell, action, severity, accepted, rating)."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        severity = rng.choices(("high", "medium", "low"), (3, 4, 3))[0]
        accepted = rng.random() < {"high": 0.8, "medium": 0.6, "low": 0.4}[severity]
        rows.append((rng.choice(("LongMethod", "MagicNumber", "DeadCode")), rng.choice(("Extract Method", "Remove Dead Code")), severity, int(accepted), min(5, max(1, round(rng.gauss(4 if accepted else 2, 0.8))))))
    return rows
