"""Jobs as a stream: transitions against a replay, time-outs, a sink that takes batches once, cancellation of running work."""

from __future__ import annotations

import datetime as dt
import os
import random
import subprocess
import sys
import textwrap
import threading
import time

import pytest
from conftest import REPO
from pyspark.sql import functions as F

from quillspark.operators import snapshots
from quillspark.streaming import cancel, jobs, sinks
from quillspark.streaming import transitions as tr

START = dt.datetime(2024, 1, 1)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def at(seconds: float) -> dt.datetime:
    return START + dt.timedelta(seconds=seconds)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield spark
    spark.conf.set(key, before)


def replay(events, horizon, limits=tr.LIMITS):
    """The transitions of events, one job after the other; a plain reading of the rules."""
    out = []
    for job in sorted({e[0] for e in events}):
        status, progress, seen, waits = None, 0, set(), None  # waits: (step, until)

        def expire(now, job=job):
            nonlocal status, waits
            if waits and waits[1] <= now:
                out.append((job, None, waits[1], "failed", progress, f"{waits[0]}: nothing heard for {limits[waits[0]]} s"))
                status, waits = "failed", None

        for _, seq, when, kind, step, done, message in sorted((e for e in events if e[0] == job), key=lambda e: (e[2], e[1])):
            if (when, seq) in seen:
                continue
            seen.add((when, seq))
            expire(when)
            new = None
            if kind == "create" and status is None:
                new = "pending"
            elif kind == "claim" and status == "pending" or kind == "progress" and status == "processing":
                new = "processing"
            elif kind == "complete" and status == "processing":
                new = "completed"
            elif kind in ("fail", "cancel") and status in ("pending", "processing"):
                new = {"fail": "failed", "cancel": "cancelled"}[kind]
            if new:
                status = new
                progress = 100 if new == "completed" else progress if done is None else done
                waits = (step, when + dt.timedelta(seconds=limits[step])) if new == "processing" and step in limits else None
                out.append((job, seq, when, status, progress, message))
        expire(horizon)
    return out


def drawn(seed: int, n_jobs: int = 12) -> list[tuple]:
    rnd, out = random.Random(seed), []
    for job in range(n_jobs):
        now = rnd.uniform(0, 500)
        for seq in range(rnd.randint(1, 14)):
            now += rnd.choice([0, 1, 30, 300, 590, 600, 601, 1300])
            kind = "create" if seq == 0 and rnd.random() < 0.9 else "claim" if seq == 1 else rnd.choice(["progress"] * 8 + ["create", "claim", "complete", "fail", "cancel", "other"])
            out.append((job, seq, at(round(now, 3)), kind, rnd.choice(["outline", "page", None, "else"]), rnd.choice([None, seq * 5]), rnd.choice([None, f"m{seq}"])))
    return out


def rows_of(df):
    return sorted(((r.job_id, r.seq, r.at, r.status, r.progress, r.message) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_batch_equals_replay(spark, seed):
    events = drawn(seed, 40)
    df = spark.createDataFrame(random.Random(seed).sample(events + events[::3], len(events) + len(events[::3])), tr.EVENT)
    broken = spark.createDataFrame([(None, 1, at(0), "create", None, None, None), (1, None, at(0), "claim", None, None, None), (900, 1, None, "create", None, None, None)], tr.EVENT)
    got = tr.job_transitions(df.union(broken).repartition(5))
    assert rows_of(got) == sorted(replay(events, max(e[2] for e in events)), key=str)
    assert tr.job_transitions(df.limit(0)).collect() == []


def test_stream_equals_replay(rocks, tmp_path):
    """Events in any order within the delay, many of them twice, over several micro-batches."""
    events = drawn(7, 15)
    rnd = random.Random(1)
    sent = sorted(events + rnd.sample(events, len(events) // 2), key=lambda e: e[2] + dt.timedelta(seconds=rnd.uniform(0, 500)))
    source, table = str(tmp_path / "in"), sinks.BatchTable(rocks, str(tmp_path / "out"), "job_id long, seq long, at timestamp, status string, progress int, message string")
    os.makedirs(source)
    stream = tr.job_transitions(rocks.readStream.schema(tr.EVENT).parquet(source), delay="520 seconds")
    q = sinks.written_once(stream, table, str(tmp_path / "cp"))
    try:
        last = at(40_000)
        for part in [sent[i : i + 40] for i in range(0, len(sent), 40)] + [[(-1, 0, last, "create", None, None, None)], [(-2, 0, last, "create", None, None, None)]]:
            rocks.createDataFrame(part, tr.EVENT).coalesce(1).write.mode("append").parquet(source)
            q.processAllAvailable()
    finally:
        q.stop()
    got = table.read()
    assert rows_of(got.where("job_id >= 0")) == sorted(replay(events, last), key=str)
    ended = {e[0] for e in replay(events, last) if e[3] in tr.TERMINAL}
    now = {r.job_id: r.status for r in tr.current_jobs(got.withColumn("place", F.struct("at", "batch"))).collect()}
    assert ended == {k for k, v in now.items() if v in tr.TERMINAL} and ended


def test_silent_job_fails_once_by_the_clock(rocks, tmp_path):
    source, table = str(tmp_path / "in"), sinks.BatchTable(rocks, str(tmp_path / "out"), "job_id long, seq long, at timestamp, status string, progress int, message string")
    os.makedirs(source)
    send = lambda *rows: rocks.createDataFrame(rows, tr.EVENT).coalesce(1).write.mode("append").parquet(source)
    stream = tr.job_transitions(rocks.readStream.schema(tr.EVENT).parquet(source), "arrival", limits={"page": 3, "outline": 3000})
    q = sinks.written_once(stream, table, str(tmp_path / "cp"), processingTime="500 milliseconds")  # the clock makes batches without data

    def heard(n: int) -> None:
        until = time.time() + 60
        while time.time() < until and table.read().count() < n:
            time.sleep(0.3)

    try:
        send((1, 1, at(0), "create", None, None, None), (1, 2, at(1), "claim", "page", 5, "go"), (2, 1, at(0), "create", None, None, None), (2, 2, at(1), "claim", "outline", 5, "go"))
        heard(5)
        send((1, 3, at(2), "complete", None, None, None), (2, 1, at(0), "create", None, None, None), (2, 3, at(2), "complete", None, None, "ok"))
        heard(6)
        time.sleep(4)
    finally:
        q.stop()
    got = [(r.job_id, r.seq, r.status) for r in table.read().orderBy("job_id", "batch", "at").collect()]
    assert got == [(1, 1, "pending"), (1, 2, "processing"), (1, None, "failed"), (2, 1, "pending"), (2, 2, "processing"), (2, 3, "completed")]


def test_table_takes_each_batch_once(spark, tmp_path):
    t = sinks.BatchTable(spark, str(tmp_path / "t"), "x long")
    df = lambda *x: spark.createDataFrame([(i,) for i in x], "x long")
    assert t.read().collect() == [] and t.batches() == [] and t.merge() is None
    t(df(1, 2), 0)
    t(df(9), 0)  # sent again
    (tmp_path / "t" / "batch=1").mkdir()
    (tmp_path / "t" / "batch=1" / "part-0.parquet").write_bytes(b"half a write")
    assert sorted(r.x for r in t.read().collect()) == [1, 2]
    t(df(3), 1)
    t(df(), 2)
    assert t.batches() == [0, 1, 2] and sorted((r.x, r.batch) for r in t.read().collect()) == [(1, 0), (2, 0), (3, 1)]
    t.merge()
    t(df(7), 1)
    t(df(4), 3)
    assert t.batches() == [3] and t.merged() == 2 and sorted((r.x, r.batch) for r in t.read().collect()) == [(1, 0), (2, 0), (3, 1), (4, 3)]
    t.merge()
    assert t.merged() == 3 and sorted(r.x for r in t.read(1).collect()) == [4] and not (tmp_path / "t" / "upto=2").exists()


def test_killed_between_output_and_commit(rocks, tmp_path):
    """A process that dies after a batch's output and before its commit; the next one sends the batch again."""
    script = textwrap.dedent(f"""
        import os, signal, sys
        sys.path.insert(0, {REPO!r})
        from pyspark.sql import SparkSession
        from quillspark.streaming import sinks, transitions as tr
        spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.streaming.stateStore.providerClass", {ROCKS!r}).getOrCreate()
        top, deadly = sys.argv[1], int(sys.argv[2])
        table = sinks.BatchTable(spark, top + "/out", "job_id long, seq long, at timestamp, status string, progress int, message string")
        stream = tr.job_transitions(spark.readStream.schema(tr.EVENT).option("maxFilesPerTrigger", 1).parquet(top + "/in"), delay="0 seconds")
        q = sinks.written_once(stream, table, top + "/cp", lambda df, b: os.kill(os.getpid(), signal.SIGKILL) if b == deadly else None, availableNow=True)
        q.awaitTermination()
    """)
    events = drawn(3, 10)
    os.makedirs(tmp_path / "in")
    for part in ([e for e in events if e[2] < at(700)], [e for e in events if e[2] >= at(700)], [(50, 1, at(40_000), "create", None, None, None)], [(50, 2, at(40_001), "claim", None, None, None)]):
        rocks.createDataFrame(part, tr.EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files in the order of their times
    run = lambda deadly: subprocess.run([sys.executable, "-c", script, str(tmp_path), str(deadly)], cwd=REPO, timeout=300, capture_output=True).returncode
    table = sinks.BatchTable(rocks, str(tmp_path / "out"), "job_id long, seq long, at timestamp, status string, progress int, message string")
    assert run(1) == -9
    assert table.batches()[:2] == [0, 1]
    before = {(r.job_id, r.seq, r.batch) for r in table.read().collect()}
    made = {p: p.stat().st_mtime_ns for p in (tmp_path / "out" / "batch=1").iterdir()}
    assert run(-1) == 0
    got = [(r.job_id, r.seq, r.batch) for r in table.read().collect()]
    assert len(got) == len(set(got)) and before < set(got)
    assert rows_of(table.read().where("job_id < 50")) == sorted(replay(events, at(40_000)), key=str)
    assert made == {p: p.stat().st_mtime_ns for p in (tmp_path / "out" / "batch=1").iterdir()}


# ---- cancellation ----


def _slow(spark, seconds: float):
    wait = F.udf(lambda x: (time.sleep(0.05), x)[1], "long")
    n = int(seconds / 0.05)
    return lambda: spark.range(0, n, 1, 1).select(F.sum(wait("id"))).first()[0]


def test_cancelled_job_stops_and_others_go_on(spark):
    flag, other = threading.Event(), []
    friend = threading.Thread(target=lambda: other.append(cancel.run_job(spark, 2, _slow(spark, 6), lambda: False)))
    friend.start()
    timer = threading.Timer(3, flag.set)
    timer.start()
    began = time.time()
    with pytest.raises(cancel.Cancelled):
        cancel.run_job(spark, 1, _slow(spark, 120), flag.is_set)
    assert time.time() - began < 5
    friend.join()
    assert other == [sum(range(120))]
    assert cancel.run_job(spark, 1, _slow(spark, 0.1), lambda: False) == 1  # the tag is free again
    with pytest.raises(ZeroDivisionError):
        cancel.run_job(spark, 1, lambda: 1 / 0, lambda: False)


def test_worker_stops_a_cancelled_job(spark, tmp_path):
    s = snapshots.Store(spark, str(tmp_path))
    one = spark.createDataFrame([(1, "sync", "pending", at(0))], "id long, type string, status string, created_at timestamp")
    s.change("jobs", lambda j: j.unionByName(one, allowMissingColumns=True))
    w = jobs.Worker.__new__(jobs.Worker)  # without the sweep at start-up
    started = threading.Event()

    def handle(job):
        started.set()
        return {"prompt": _slow(spark, 120)()}

    w.store, w.handle, w.now, w.watch = s, handle, F.current_timestamp, 0.3
    t = threading.Thread(target=w.step)
    t.start()
    started.wait(60)
    s.change("jobs", lambda j: snapshots.cancel(j, 1, F.current_timestamp()))
    t.join(20)
    assert not t.is_alive() and [r.status for r in s.read("jobs").collect()] == ["cancelled"]


def test_a_batch_is_replayed_by_tasks_not_by_calls_for_each_job(spark):
    rows = [(j, s, s * 1000, k, "page", s, None) for j in range(300) for s, k in enumerate(("create", "claim", "progress", "complete" if j % 2 else "progress"))]
    events = spark.createDataFrame(rows, "job_id long, seq long, ms long, kind string, step string, progress int, message string").withColumn("at", F.timestamp_millis("ms"))
    out = tr.job_transitions(events, limits={"page": 0})
    assert "TransformWithState" not in out._jdf.queryExecution().executedPlan().toString()
    ends = {r.job_id: (r.status, r.n) for r in out.groupBy("job_id").agg(F.max_by("status", "at").alias("status"), F.count("*").alias("n")).collect()}
    assert len(ends) == 300 and set(ends.values()) == {("failed", 3)}  # a limit that ends at once
