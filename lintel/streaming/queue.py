"""A job queue as a state machine: events in, transitions out, as a stream with timers or as a fold over a table.

An event (job, ts, seq, kind, worker) asks for a step: `enqueue`, `claim`, `complete` or `fail`. A claim locks a job for
`lock_seconds`; when that time is over the job is queued again, or fails for good once its attempts are used up. A failed
attempt waits longer each time. A job is accepted once: what comes twice is refused, as is a claim of a job that isn't due
and word of a worker that hasn't got the job.

As a stream, a job is one value of state with a timer for its next change, the end of a lock or of a wait, or, for a job that is
over, the time at which it is forgotten; so state is bounded by the jobs of that time. A lock that has ended is also seen by the next
event, so the result doesn't depend on when timers run. Jobs are keys of their own: nothing is collected by queue."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

STATE = "status string, attempts int, due long, locked_at long, worker string, at long, waits boolean"
TRANSITION = "job string, at timestamp, cause string, worker string, accepted boolean, status string, attempts int, due timestamp"
OVER = ("done", "failed")


@dataclass(frozen=True)
class Rules:
    lock_seconds: int = 600
    most: int = 5
    first_wait: int = 30
    longest_wait: int = 900
    keep_seconds: int = 7 * 86400  # a job that is over is known so long

    def wait(self, attempts: int) -> int:
        return min(self.first_wait << min(max(0, attempts - 1), 30), self.longest_wait)


@dataclass
class Job:
    """Times are in milliseconds; a status of None is a job that nobody has asked for."""

    status: str | None = None
    attempts: int = 0
    due: int = 0
    locked_at: int | None = None
    worker: str | None = None
    at: int = 0
    waits: bool = False

    def pass_time(self, rules: Rules, now: int) -> Iterator[tuple[str, int]]:
        """(what, when) of the changes that time alone has brought: a lock that ended before now, a wait that is over."""
        if self.status == "in_progress" and self.locked_at + rules.lock_seconds * 1000 < now:
            end = self.locked_at + rules.lock_seconds * 1000 + 1
            self.status, self.locked_at, self.at = ("failed" if self.attempts >= rules.most else "queued"), None, end
            yield "lock over", end
        if self.status == "queued" and self.waits and self.due <= now:
            self.waits = False
            yield "due", self.due

    def apply(self, rules: Rules, kind: str, worker: str | None, now: int) -> bool:
        """One event, after time has passed up to it; False: it is refused. Events of the past are refused."""
        if self.status is not None and now < self.at:
            return False
        if kind == "enqueue" and self.status is None:
            self.status, self.due = "queued", now
        elif kind == "claim" and self.status == "queued" and self.due <= now:
            self.status, self.attempts, self.locked_at, self.worker = "in_progress", self.attempts + 1, now, worker
        elif kind in ("complete", "fail") and self.status in ("in_progress", "queued") and worker is not None and worker == self.worker:
            self.locked_at, self.worker = None, None
            if kind == "complete":
                self.status = "done"
            elif self.attempts >= rules.most:
                self.status = "failed"
            else:
                self.status, self.due, self.waits = "queued", now + rules.wait(self.attempts) * 1000, True
        else:
            return False
        self.at = now
        return True

    def next_change(self, rules: Rules) -> int | None:
        """When a timer has something to do."""
        if self.status == "in_progress":
            return self.locked_at + rules.lock_seconds * 1000 + 1
        if self.status in OVER:
            return self.at + rules.keep_seconds * 1000
        return self.due if self.status == "queued" and self.waits else None


class QueueProcessor(StatefulProcessor):
    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", STATE)

    def load(self) -> Job:
        return Job(*self.state.get()) if self.state.exists() else Job()

    def keep(self, job: Job) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if job.status is not None:
            self.state.update((job.status, job.attempts, job.due, job.locked_at, job.worker, job.at, job.waits))
            if (at := job.next_change(self.rules)) is not None:
                self.handle.registerTimer(at)

    def shown(self, key: str, job: Job, at: int, cause: str, worker: str | None, accepted: bool) -> Row:
        stamp = lambda ms: None if ms is None else to_time(ms)
        return Row(job=key, at=stamp(at), cause=cause, worker=worker, accepted=accepted, status=job.status, attempts=job.attempts, due=stamp(job.due) if job.status else None)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        job = self.load()
        for r in sorted(rows, key=lambda r: (r["ts"], r["seq"])):
            now = to_ms(r["ts"])
            for cause, at in job.pass_time(self.rules, now):
                yield self.shown(key[0], job, at, cause, None, True)
            accepted = job.apply(self.rules, r["kind"], r["worker"], now)
            yield self.shown(key[0], job, now, r["kind"], r["worker"], accepted)
        self.keep(job)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        job, now = self.load(), expiredTimerInfo.getExpiryTimeInMs()
        if job.status in OVER:
            self.state.clear()
            return
        for cause, at in job.pass_time(self.rules, now):
            yield self.shown(key[0], job, at, cause, None, True)
        self.keep(job)


def to_ms(t) -> int:
    """Milliseconds of a timestamp as Spark hands it to Python, which is in local time."""
    return int(round(t.timestamp() * 1000))


def to_time(ms: int):
    import datetime

    return datetime.datetime.fromtimestamp(ms / 1000)


def transitions(events: DataFrame, rules: Rules = Rules(), late: str = "10 minutes") -> DataFrame:
    """The transitions of a stream of events (job, ts, seq, kind, worker): one for each event, accepted or not, and one for each lock or wait that ends.

    Events that come later than the watermark are dropped. Needs the RocksDB state store, see use_state_store()."""
    marked = events.select("job", "ts", "seq", "kind", "worker").withWatermark("ts", late)
    return marked.groupBy("job").transformWithState(QueueProcessor(rules), StructType.fromDDL(TRANSITION), "Append", "EventTime")


def use_state_store(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


# ---- The same as a fold


def fields(**values: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in values.items()])


def lapsed(s: Column, now: Column, rules: Rules) -> Column:
    over = (s["status"] == "in_progress") & (s["locked_at"] + rules.lock_seconds < now)
    status = F.when(over, F.when(s["attempts"] >= rules.most, "failed").otherwise("queued")).otherwise(s["status"])
    return fields(status=status, attempts=s["attempts"], due=s["due"], locked_at=F.when(~F.coalesce(over, F.lit(False)), s["locked_at"]), worker=s["worker"], refused=s["refused"])


def stepped(s: Column, e: Column, rules: Rules) -> Column:
    """The state after an event. Seconds may have parts."""
    now, kind = e["t"], e["kind"]
    takes = (kind == "enqueue") & s["status"].isNull()
    claims = (kind == "claim") & (s["status"] == "queued") & (s["due"] <= now)
    owns = s["status"].isin("in_progress", "queued") & (e["worker"] == s["worker"])
    completes, fails = (kind == "complete") & owns, (kind == "fail") & owns
    yes = lambda c: F.coalesce(c, F.lit(False))
    takes, claims, completes, fails = map(yes, (takes, claims, completes, fails))
    spent = s["attempts"] >= rules.most
    wait = F.least(rules.first_wait * F.pow(F.lit(2.0), F.greatest(F.lit(0), s["attempts"] - 1)), F.lit(float(rules.longest_wait)))
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    return fields(
        status=F.when(takes, "queued").when(claims, "in_progress").when(completes, "done").when(fails, F.when(spent, "failed").otherwise("queued")).otherwise(s["status"]),
        attempts=s["attempts"] + F.when(claims, 1).otherwise(0),
        due=F.when(takes, now).when(fails & ~spent, now + wait).otherwise(s["due"]),
        locked_at=F.when(claims, now).when(completes | fails, number).otherwise(s["locked_at"]),
        worker=F.when(claims, e["worker"]).when(completes | fails, text).otherwise(s["worker"]),
        refused=s["refused"] + F.when(takes | claims | completes | fails, 0).otherwise(1),
    )


def job_states(events: DataFrame, until: Column, rules: Rules = Rules()) -> DataFrame:
    """job, status, attempts, due, worker and refused events of every job at a time, from its events (job, ts, seq, kind, worker) up to it.

    An event's time counts in seconds and parts; events of a job are sorted by ts and seq. A job has a bounded number of steps,
    so its events are one array; many jobs share a task."""
    t = F.col("ts").cast("timestamp").cast("double")
    rows = events.filter(F.col("ts") <= until).groupBy("job").agg(F.array_sort(F.collect_list(F.struct(t.alias("t"), "seq", "kind", "worker"))).alias("events"))
    none = "CAST(NULL AS {})"
    start = F.struct(F.expr(none.format("string")).alias("status"), F.lit(0).alias("attempts"), F.expr(none.format("double")).alias("due"), F.expr(none.format("double")).alias("locked_at"), F.expr(none.format("string")).alias("worker"), F.lit(0).alias("refused"))
    folded = F.aggregate("events", start, lambda s, e: stepped(lapsed(s, e["t"], rules), e, rules), lambda s: lapsed(s, until.cast("timestamp").cast("double"), rules))
    return rows.select("job", folded.alias("s")).select("job", "s.status", "s.attempts", F.timestamp_seconds("s.due").alias("due"), "s.worker", "s.refused")
