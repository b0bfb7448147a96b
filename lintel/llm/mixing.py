"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are ranked and cut into blocks of block_docs rows. A fluid schedule would serve
source s at rate w_s / (sum of the weights of sources with documents left); A_s(t) is what it has served
by slot t. Block k of s is released at floor(t) where A_s(t) = k and due at ceil(t) where A_s(t) = k + 1.
One block a slot, earliest deadline first among released blocks, meets every deadline, so after any
number of slots each source is less than one block from its fluid share. When a source ends, the others
share its rate in proportion; every row gets exactly one place, none is dropped or repeated.

The schedule is made from one row per source. Ranking uses hash buckets sized from the source's count, so
a source that holds most rows is spread over many tasks.

Null sources are a source of their own. Sources without a given weight have the default weight. Ties and
repeated rows get places of their own. An empty table gives an empty result. A weight that isn't positive
and finite raises.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from heapq import heappop, heappush
from math import ceil, floor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lintel.session import prepare, written

BUCKET = 8192  # rows ranked together


def fluid_phases(weights: list[Fraction], blocks: list[int]) -> list[tuple[Fraction, Fraction, list[Fraction]]]:
    """(start, sum of weights, served by each source at the start) for each stretch between ends of sources."""
    served = [Fraction(0)] * len(blocks)
    now, phases = Fraction(0), []
    live = [s for s, n in enumerate(blocks) if n]
    while live:
        total = sum(weights[s] for s in live)
        phases.append((now, total, list(served)))
        step = min((blocks[s] - served[s]) * total / weights[s] for s in live)
        for s in live:
            served[s] += step * weights[s] / total
        now += step
        live = [s for s in live if served[s] < blocks[s]]
    return phases


def pfair(weights: list[Fraction], blocks: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """(slot, source, block, release, deadline) of every block, in order of slots."""
    phases = fluid_phases(weights, blocks)
    place = [0] * len(blocks)

    def when(s: int, k: int) -> Fraction:
        """When the fluid schedule has served k blocks of s; asked for rising k only."""
        while place[s] + 1 < len(phases) and phases[place[s] + 1][2][s] < k:
            place[s] += 1
        start, total, served = phases[place[s]]
        return start + (k - served[s]) * total / weights[s]

    begins = [Fraction(0)] * len(blocks)

    def window(s: int, k: int) -> tuple[int, int]:
        end = when(s, k + 1)
        release, begins[s] = floor(begins[s]), end
        return release, ceil(end)

    future: list[tuple[int, int, int, int]] = []  # release, deadline, source, block
    ready: list[tuple[int, int, int, int]] = []  # deadline, source, block, release
    for s, n in enumerate(blocks):
        if n:
            release, deadline = window(s, 0)
            heappush(future, (release, deadline, s, 0))
    for slot in range(sum(blocks)):
        while future and future[0][0] <= slot:
            release, deadline, s, k = heappop(future)
            heappush(ready, (deadline, s, k, release))
        deadline, s, k, release = heappop(ready)
        yield slot, s, k, release, deadline
        if k + 1 < blocks[s]:
            release, deadline = window(s, k + 1)
            heappush(future, (release, deadline, s, k + 1))


def schedule(counts: DataFrame, block_docs: int) -> DataFrame:
    """From (source, weight double, rows long), one row per source, the slots: (source, block, slot, release, deadline)."""
    prepare(counts.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = [b for b in batches if len(b)]
        if not kept:
            return
        table = pd.concat(kept).sort_values("source", na_position="first")
        names = table["source"].tolist()
        weights = [Fraction(str(float(w))) for w in table["weight"]]
        if min(weights) <= 0:
            raise ValueError("weights must be positive")
        rows: list[tuple] = []
        for slot, s, k, release, deadline in pfair(weights, [-(-int(n) // block_docs) for n in table["rows"]]):
            rows.append((names[s], k, slot, release, deadline))
            if len(rows) == 10_000:
                yield pd.DataFrame(rows, columns=["source", "block", "slot", "release", "deadline"])
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=["source", "block", "slot", "release", "deadline"])

    return counts.select("source", "weight", "rows").coalesce(1).mapInPandas(run, "source string, block long, slot long, release long, deadline long")


def ranked(df: DataFrame, source: str, key: Column) -> DataFrame:
    """Append __source and __rank (long, from 0): the row's place in its source by (hash bucket, hash, key)."""
    df = df.withColumn("__source", F.col(source).cast("string")).withColumn("__hash", F.xxhash64(key, F.lit(17)))
    # small tables are written first: their size is then known, and the join needs no shuffle of the rows while they are small
    counts = written(df.groupBy("__source").agg(F.count(F.lit(1)).alias("__n")), "mix-counts")
    sized = lambda d: d.withColumn("__bucket", F.pmod(F.col("__hash"), F.greatest(F.lit(1), F.ceil(F.col("__n") / BUCKET))))
    joined = df.join(counts.withColumnRenamed("__source", "__s"), F.col("__source").eqNullSafe(F.col("__s"))).drop("__s")
    bucketed = sized(joined)
    sizes = bucketed.groupBy("__source", "__bucket").agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(sizes.select(F.col("__source").alias("__s"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset")), "mix-offsets")
    inside = Window.partitionBy("__source", "__bucket").orderBy("__hash", key)
    return (
        bucketed.withColumn("__at", F.row_number().over(inside))
        .join(offsets, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__bucket") == F.col("__b")))
        .withColumn("__rank", F.col("__offset") + F.col("__at") - 1)
        .drop("__s", "__b", "__bucket", "__hash", "__n", "__offset", "__at")
    )


def mix(df: DataFrame, source: str = "source", key: str = "doc_id", weights: dict[str | None, float] | None = None, default: float = 1.0, power: float | None = None, block_docs: int = 64) -> DataFrame:
    """Append mix_block, mix_slot (the block's turn), mix_place (the row's place in the block), release and deadline.

    weights: by source; power: instead, a source's weight is its number of rows to this power. Names that the
    input has already are replaced. Rows are in no order; order by mix_slot, mix_place."""
    new = ["mix_block", "mix_slot", "mix_place", "mix_release", "mix_deadline"]
    kept = [c for c in df.columns if c not in new]
    counts = df.groupBy(F.col(source).cast("string").alias("source")).agg(F.count(F.lit(1)).alias("rows"))
    if power is not None:
        weight = F.round(F.pow(F.col("rows").cast("double"), F.lit(power)), 6)
    else:
        weight = F.lit(float(default))
        for name, w in (weights or {}).items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    slots = written(schedule(counts.withColumn("weight", weight), block_docs), "mix-slots")
    rows = ranked(df.select(*kept), source, F.col(key)).withColumn("mix_block", F.floor(F.col("__rank") / block_docs))
    slots = slots.select(F.col("source").alias("__s"), F.col("block").alias("__b"), F.col("slot").alias("mix_slot"), F.col("release").alias("mix_release"), F.col("deadline").alias("mix_deadline"))
    return rows.join(slots, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("mix_block") == F.col("__b"))).select(
        *kept, "mix_block", "mix_slot", (F.col("__rank") % block_docs).alias("mix_place"), "mix_release", "mix_deadline"
    )
