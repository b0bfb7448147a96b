"""The job queue: the stream with timers, the fold and the plain state machine agree."""

from __future__ import annotations

import datetime
import random

from lintel.streaming import jobs, queue
from pyspark.sql import functions as F

RULES = queue.Rules(lock_seconds=600, most=2, first_wait=30, longest_wait=45, keep_seconds=86400)
START = datetime.datetime(2024, 1, 1)
EVENTS = "job string, ts timestamp, seq int, kind string, worker string"


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


def stream_of(spark, batches, folder):
    """Transitions of the events in batches, one micro-batch each."""
    queue.use_state_store(spark)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{folder}/in/{i}")
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(f"{folder}/in")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    out = queue.transitions(events, RULES, "1 minute")
    q = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/point").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    spark.conf.set("spark.sql.shuffle.partitions", before)
    return spark.read.parquet(f"{folder}/out").collect()


def test_stream_with_lost_worker_and_duplicates(spark, tmp_path):
    batches = [
        [("a", at(0), 0, "enqueue", None), ("a", at(0), 1, "enqueue", None), ("a", at(1), 2, "claim", "w1"), ("b", at(1), 3, "enqueue", None), ("b", at(2), 4, "claim", "w2"), ("c", at(2), 5, "claim", "w3")],
        [("b", at(3), 6, "fail", "w2"), ("b", at(3), 7, "claim", "w2"), ("d", at(30), 8, "enqueue", None)],
        [("a", at(31), 9, "claim", "w4"), ("b", at(31), 10, "claim", "w2"), ("b", at(32), 11, "complete", "w1"), ("b", at(32), 12, "fail", "w2"), ("a", at(33), 13, "complete", "w4"), ("d", at(33), 14, "claim", "w1")],
        [("z", at(90), 15, "enqueue", None)],
        [("z", at(91), 16, "claim", "w1")],
    ]
    rows = stream_of(spark, batches, tmp_path)
    seen = sorted((r["job"], r["at"], r["cause"], r["accepted"], r["status"], r["attempts"]) for r in rows)
    steps = lambda job: [(s[2], s[3], s[4], s[5]) for s in seen if s[0] == job]
    assert steps("a") == [("enqueue", False, "queued", 0), ("enqueue", True, "queued", 0), ("claim", True, "in_progress", 1), ("lock over", True, "queued", 1), ("claim", True, "in_progress", 2), ("complete", True, "done", 2)]
    assert steps("b") == [
        ("enqueue", True, "queued", 0), ("claim", True, "in_progress", 1), ("claim", False, "queued", 1), ("fail", True, "queued", 1), ("due", True, "queued", 1), ("claim", True, "in_progress", 2), ("complete", False, "in_progress", 2), ("fail", True, "failed", 2),
    ]
    assert steps("c") == [("claim", False, None, 0)]
    assert ("lock over", True, "queued", 1) in steps("d")
    everything = spark.createDataFrame([r for b in batches for r in b], EVENTS)
    folded = {r["job"]: (r["status"], r["attempts"]) for r in queue.job_states(everything, F.lit(at(91)), RULES).collect()}
    last = {s[0]: s[4:] for s in sorted(seen, key=lambda s: (s[1], s[2] == "lock over"))}
    assert {k: folded[k] for k in "abd"} == {k: last[k] for k in "abd"} and folded["c"] == (None, 0)


def test_fold_equals_the_state_machine(spark):
    rng = random.Random(11)
    rows = []
    for j in range(40):
        t = 0.0
        for k in range(rng.randint(1, 25)):
            t += rng.choice([0, 0.3, 0.5, 0.75, 2, 10, 10.0001, 25])
            rows.append((f"j{j}", at(t), k, rng.choice(["enqueue", "claim", "claim", "fail", "complete", "odd", None]), rng.choice(["w1", "w2", None])))
    want = {}
    for j in {r[0] for r in rows}:
        job = queue.Job()
        refused = 0
        for r in sorted((r for r in rows if r[0] == j), key=lambda r: (r[1], r[2])):
            list(job.pass_time(RULES, queue.to_ms(r[1])))
            refused += not job.apply(RULES, r[3], r[4], queue.to_ms(r[1]))
        list(job.pass_time(RULES, queue.to_ms(at(400))))
        want[j] = (job.status, job.attempts, job.worker, refused)
    got = queue.job_states(spark.createDataFrame(rows, EVENTS), F.lit(at(400)), RULES).collect()
    assert {r["job"]: (r["status"], r["attempts"], r["worker"], r["refused"]) for r in got} == want
    assert queue.job_states(spark.createDataFrame([], EVENTS), F.lit(at(1)), RULES).count() == 0


def test_state_of_batches_is_kept_once(spark, tmp_path):
    """Each batch makes a new version of the state from the one before; a batch that comes again makes the same."""
    path = str(tmp_path / "state")
    apply = jobs.apply_batch(path, ["id"], "t", "tie")
    frame = lambda *rows: spark.createDataFrame(rows, "id string, t int, tie int, v string")
    batches = [frame(("a", 1, 0, "x"), ("b", 1, 0, "y")), frame(("a", 0, 9, "old"), ("b", 2, 0, "z")), frame(("c", 1, 0, "w")), frame(("a", 3, 0, "q"))]
    for i, b in enumerate(batches):
        apply(b, i)
    apply(batches[3], 3)
    assert sorted((r["id"], r["v"]) for r in jobs.state(spark, path).collect()) == [("a", "q"), ("b", "z"), ("c", "w")]
    assert len(list((tmp_path / "state").glob("version=*"))) == 2
