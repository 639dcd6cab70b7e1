"""The queue worker against a worker in plain Python, in several batches and after restarts."""

import datetime
import os
import random
import shutil
import time

import pytest

from townscribe.streaming import worker

T0 = datetime.datetime(2024, 1, 1)
JOB = "job_id long, enqueued_at timestamp, fails int"


def process(job, attempt):
    if job["fails"] == 9:
        raise RuntimeError("broken bundle")
    return f"attempt {attempt} failed" if attempt <= job["fails"] else None


def plain(jobs, until):
    """The attempts of a worker that sees the whole log, as far as they are due."""
    out = []
    for job, (ts, fails) in jobs.items():
        at, n = ts, 0
        while at <= until:
            n += 1
            failed = n <= fails
            status = "done" if not failed else "dead" if n == 3 else "pending"
            pause = min(120, 5 * 2 ** (n - 1))
            error = None if not failed else "RuntimeError: broken bundle" if fails == 9 else f"attempt {n} failed"
            out.append((job, n, at, status, error, at + datetime.timedelta(seconds=pause) if status == "pending" else None))
            if status != "pending":
                break
            at += datetime.timedelta(seconds=pause)
    return sorted(out)


@pytest.fixture(scope="module")
def log():
    rng = random.Random(4)
    jobs, parts, now = {}, [], T0
    for part in range(5):
        rows = []
        for i in range(30):
            now += datetime.timedelta(milliseconds=rng.randrange(0, 4000))
            job = part * 100 + i
            jobs[job] = (now, rng.choice([0, 0, 1, 2, 3, 9]))
            rows.append((job, *jobs[job]))
            if i % 10 == 3 and part:
                rows.append(((part - 1) * 100 + i, now, 0))  # submitted again
        rows += rows[:2]
        parts.append(rows)
    return jobs, parts, now


def add(spark, folder, part, rows):
    at = f"{folder}-{part}"
    spark.createDataFrame(rows, JOB).coalesce(1).write.parquet(at)
    os.makedirs(folder, exist_ok=True)
    name = next(f for f in os.listdir(at) if f.endswith(".parquet"))
    shutil.move(f"{at}/{name}", f"{folder}/{part:03}.parquet")
    os.utime(f"{folder}/{part:03}.parquet", (1_000_000 + part, 1_000_000 + part))


def run(spark, folder, out, state):
    stream = spark.readStream.schema(JOB).option("maxFilesPerTrigger", 1).parquet(folder)
    worker.put_batches(worker.work(stream, process), out, state).awaitTermination()
    rows = spark.read.parquet(out).collect()
    return sorted((r["job_id"], r["attempt"], r["at"], r["status"], r["error"], r["next_try"]) for r in rows)


def test_batches_and_restart_give_the_plain_workers_attempts(spark, log, tmp_path):
    jobs, parts, end = log
    for part, rows in enumerate(parts[:2]):
        add(spark, f"{tmp_path}/in", part, rows)
    first = run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state")
    seen = {j: v for j, v in jobs.items() if j < 200}
    assert first == plain(seen, max(v[0] for v in seen.values()))
    for part, rows in enumerate(parts[2:], 2):
        add(spark, f"{tmp_path}/in", part, rows)
    again = run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state")  # restarted from the checkpoint
    assert again == plain(jobs, end)
    assert {r[3] for r in again} == {"done", "dead", "pending"} and max(r[1] for r in again) == 3
    whole = run(spark, f"{tmp_path}/in", f"{tmp_path}/out2", f"{tmp_path}/state2")
    assert whole == again
    held = {r["job_id"]: r["status"] for r in worker.standing(spark.read.parquet(f"{tmp_path}/out")).collect()}
    assert held == {r[0]: r[3] for r in again}
    beats = worker.heartbeat(spark.read.parquet(f"{tmp_path}/out"), every="1 hour").collect()
    assert {r["status"]: r["jobs"] for r in beats if r["jobs"]} == {s: list(held.values()).count(s) for s in set(held.values())}


def test_a_batch_that_is_run_again_changes_nothing(spark, log, tmp_path):
    jobs, parts, _ = log
    for part, rows in enumerate(parts[:3]):
        add(spark, f"{tmp_path}/in", part, rows)
    first = run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state")
    commits = f"{tmp_path}/state/commits"
    last = max(int(f) for f in os.listdir(commits) if f.isdigit())
    for f in (f"{commits}/{last}", f"{commits}/.{last}.crc"):  # as if the stream had died before it could say that it was done
        if os.path.exists(f):
            os.remove(f)
    assert run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state") == first


def test_clock(spark, tmp_path):
    """By the clock: retries wait for real time."""
    add(spark, f"{tmp_path}/in", 0, [(1, T0, 0), (2, T0, 1), (3, T0, 9)])
    stream = spark.readStream.schema(JOB).parquet(f"{tmp_path}/in")
    q = worker.put_batches(worker.work(stream, process, clock=True, base=0.2, cap=0.3), f"{tmp_path}/out", f"{tmp_path}/state", processingTime="200 milliseconds")
    try:
        for _ in range(120):
            time.sleep(0.5)
            rows = spark.read.schema(f"job_id long, {worker.ATTEMPT}").parquet(f"{tmp_path}/out").collect() if os.path.isdir(f"{tmp_path}/out") else []
            if len(rows) >= 6:
                break
    finally:
        q.stop()
    by = sorted((r["job_id"], r["attempt"], r["status"]) for r in rows)
    assert by == [(1, 1, "done"), (2, 1, "pending"), (2, 2, "done"), (3, 1, "pending"), (3, 2, "pending"), (3, 3, "dead")]
    at = {(r["job_id"], r["attempt"]): r["at"] for r in rows}
    due = {(r["job_id"], r["attempt"]): r["next_try"] for r in rows}
    assert at[2, 2] >= due[2, 1] and at[3, 3] >= due[3, 2]


def test_settled_jobs_are_forgotten(spark, tmp_path):
    rows = [[(1, T0, 0), (2, T0, 9)], [(7, T0 + datetime.timedelta(hours=3), 0)], [(8, T0 + datetime.timedelta(hours=4), 0), (1, T0 + datetime.timedelta(hours=4), 0)]]
    for part, r in enumerate(rows):
        add(spark, f"{tmp_path}/in", part, r)
    stream = spark.readStream.schema(JOB).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = worker.put_batches(worker.work(stream, process, remember=3600), f"{tmp_path}/out", f"{tmp_path}/state")
    q.awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out").where("job_id = 1").collect()
    assert len(out) == 2  # an hour after it was done it is a new job
    assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 8  # a state and a few timers of jobs 1, 7 and 8

